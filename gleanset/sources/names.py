"""Where catalog names come from: a cache with an age limit, a first source that is read strictly, and a fallback.

The cache keeps versions: names are written to a folder of their own, and only then does a row in the cache's log name
that folder. A reader takes the latest logged version, so that it never sees half of one, and counts it."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAYS = 7
LOG = "version string, fetched_at timestamp, n long"


class MalformedCatalog(ValueError):
    pass


def strict_names(spark: SparkSession, path: str) -> DataFrame:
    """name of each entry, in order of place, of JSON {"data": [strings]} or of a Parquet table with a string column name.

    MalformedCatalog for anything else: no such list, an entry that isn't a string, a null. Repeated names stay."""
    if path.rstrip("/").endswith(".parquet"):
        table = spark.read.parquet(path)
        if dict(table.dtypes).get("name") != "string" or not table.filter("name is null").isEmpty():
            raise MalformedCatalog(f"{path} has no column of names")
        return table.select("name")
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    lists = whole.select(F.try_variant_get("v", "$.data", "array<variant>").alias("data"))
    if lists.isEmpty() or not lists.filter("data is null").isEmpty():
        raise MalformedCatalog(f"{path} has no list of names")
    entries = lists.select(F.posexplode("data").alias("place", "entry"))
    if not entries.filter(F.coalesce(F.schema_of_variant("entry"), F.lit("VOID")) != "STRING").isEmpty():
        raise MalformedCatalog(f"{path} has entries that aren't strings")
    return entries.select(F.variant_get("entry", "$", "string").alias("name"))


def write_cache(names: DataFrame, cache: str, now: datetime | None = None) -> bool:
    """A new version of the cache; False if it can't be written, which is no error: the names are at hand all the same."""
    spark, version = names.sparkSession, uuid.uuid4().hex
    try:
        names.select("name").write.parquet(f"{cache}/versions/{version}")
        n = spark.read.schema("name string").parquet(f"{cache}/versions/{version}").count()
        spark.createDataFrame([(version, now or datetime.now(timezone.utc), n)], LOG).coalesce(1).write.mode("append").parquet(f"{cache}/log")
    except (PySparkException, Py4JJavaError):
        return False
    return True


def read_cache(spark: SparkSession, cache: str, days: int = DAYS, now: datetime | None = None) -> DataFrame | None:
    """name of the latest version that is at most `days` old, or None: no cache, too old, of the future, or not whole."""
    now = now or datetime.now(timezone.utc)
    try:
        log = spark.read.schema(LOG).parquet(f"{cache}/log")
        latest = log.filter(F.col("fetched_at").between(F.lit(now - timedelta(days=days)), F.lit(now))).orderBy(F.desc("fetched_at"), "version").first()
        if latest is None:
            return None
        names = spark.read.schema("name string").parquet(f"{cache}/versions/{latest.version}")
        return names if names.count() == latest.n and names.filter("name is null").isEmpty() else None
    except (PySparkException, Py4JJavaError):
        return None


def load_names(spark: SparkSession, cache: str, first: str, fallback: str | None = None, now: datetime | None = None) -> DataFrame:
    """Names from the cache, else from the first source, else from the fallback; what was read is cached. If neither can be
    read, the first one's error is raised."""
    cached = read_cache(spark, cache, now=now)
    if cached is not None:
        return cached
    try:
        names = strict_names(spark, first)
    except (PySparkException, Py4JJavaError, MalformedCatalog):
        try:
            if fallback is None:
                raise FileNotFoundError
            names = strict_names(spark, fallback)
        except (PySparkException, Py4JJavaError, MalformedCatalog, FileNotFoundError):
            names = None
        if names is None:
            raise
    write_cache(names, cache, now)
    return names
