"""Readers: OCR output as JSON, name catalogs and expected names from files, with fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanset.functions import geometry as g
from gleanset.functions.text import let

ITEM = "text string, score double, poly string"


def ocr_regions(results: DataFrame, column: str = "json") -> DataFrame:
    """scan_id, ord, text, confidence, polygon and box from JSON arrays of {text, score, poly}.

    White space is collapsed; items without text, or with fewer than four points, go; scores are kept within 0 to 1. A
    point is [x, y] or {"x": x, "y": y}; what isn't a number counts as 0."""
    items = results.select("scan_id", F.posexplode(F.from_json(column, f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in ITEM.split(', '))}>>")).alias("ord", "item"))
    number = lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))
    # Points are parsed once each: as a struct of the parsed pair, and after the filter, which only counts them.
    pair = lambda p: let(F.from_json(p, "array<string>"), lambda q: F.struct(number(F.get(q, F.lit(0))).alias("x"), number(F.get(q, F.lit(1))).alias("y")))
    polygon = F.transform(
        "_points", lambda p: F.when(F.startswith(F.ltrim(p), F.lit("[")), pair(p)).otherwise(F.struct(number(F.get_json_object(p, "$.x")).alias("x"), number(F.get_json_object(p, "$.y")).alias("y")))
    )
    score = F.col("item.score")
    rows = items.select(
        "scan_id", F.col("ord").cast("long").alias("ord"), F.trim(F.regexp_replace("item.text", r"\s+", " ")).alias("text"), F.when(score.isNull() | F.isnan(score), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).alias("confidence"), F.from_json("item.poly", "array<string>").alias("_points")
    ).filter((F.col("text") != "") & (F.size("_points") >= 4)).withColumn("polygon", polygon).drop("_points")
    box = g.bounding_box(F.col("polygon"))
    return rows.select("*", *[c.alias(n) for c, n in zip(box, ("x", "y", "width", "height"))])


def read_names(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """card_ord, name from the first path that can be read: JSON {"data": [names]} or Parquet with a name column."""
    for path in paths:
        try:
            if path.rstrip("/").endswith(".parquet"):
                names = spark.read.parquet(path).select("name")
            else:
                names = spark.read.schema("data array<string>").json(path, multiLine=True).select(F.explode("data").alias("name"))
            if not names.isEmpty():
                return numbered(names)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no catalog at {', '.join(paths)}")


def numbered(names: DataFrame) -> DataFrame:
    """Distinct names with card_ord, their place in order."""
    from pyspark.sql import Window

    return names.filter("name is not null").distinct().withColumn("card_ord", F.row_number().over(Window.orderBy("name")) - 1)


def fresh(cache: DataFrame, days: int = 7, now: str | None = None) -> DataFrame:
    """Rows fetched within the last days; a null or later fetched_at is a miss."""
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return cache.filter(F.col("fetched_at").between(at - F.expr(f"interval {int(days)} days"), at))


def expected_names(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """files with the expected names of each file name; none where the catalog doesn't have it."""
    return files.join(catalog.select("filename", "ord", F.col("name").alias("expected")), "filename", "left")
