"""The name catalog: index rows of full names and faces, the lookup of normalised names, and blocking keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset.functions import text as t


def build_index(catalog: DataFrame) -> DataFrame:
    """card_ord, pass (0: full name, 1: a face), name, search_name, normalized. catalog: card_ord, name."""
    full = catalog.select("card_ord", F.lit(0).alias("pass"), "name", F.col("name").alias("search_name"))
    faces = catalog.select("card_ord", F.lit(1).alias("pass"), "name", F.explode(t.split_faces(F.col("name"))).alias("search_name")).filter("search_name <> name")
    return full.unionByName(faces).withColumn("normalized", t.normalize_name(F.col("search_name"))).filter("normalized <> ''")


def lookup(index: DataFrame) -> DataFrame:
    """normalized, name: the first name of each normalised form, full names before faces."""
    return index.groupBy("normalized").agg(F.min_by("name", F.struct("pass", "card_ord")).alias("name"))


def with_keys(index: DataFrame) -> DataFrame:
    """index with what blocking and scoring read: first token, consonants, and the full name's normalised form."""
    if "skeleton" in index.columns:
        return index
    return index.withColumns({
        "first": F.split("normalized", " ")[0], "compact": t.compact(F.col("normalized")), "skeleton": t.consonants(t.compact(F.col("normalized"))), "name_normalized": t.normalize_name(F.col("name")),
    })
