"""Counted lists per scan: lines, unresolved detections, totals, text and JSON forms, and edits of detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanset.functions import text as t


def _counts(d: DataFrame) -> DataFrame:
    return d.filter(F.col("count").isNull() | (F.col("count") != 0))


def _named() -> Column:
    return F.coalesce((F.col("name") != "") & (F.col("status") != "unknown"), F.lit(False))


def lines(detections: DataFrame) -> DataFrame:
    """scan_id, name, count, is_land: copies of each resolved name. Partial counts come before the shuffle."""
    named = _counts(detections).filter(_named())
    return named.groupBy("scan_id", "name").agg(F.sum(F.coalesce("count", F.lit(1))).cast("long").alias("count")).withColumn("is_land", t.is_basic_land(F.col("name")))


def unresolved(detections: DataFrame) -> DataFrame:
    return _counts(detections).filter(~_named())


def totals(detections: DataFrame) -> DataFrame:
    """scan_id, total (copies of resolved names), n_names, n_unresolved: one pass over the detections."""
    d = _counts(detections)
    copies = F.when(_named(), F.coalesce("count", F.lit(1)))
    return d.groupBy("scan_id").agg(F.coalesce(F.sum(copies), F.lit(0)).cast("long").alias("total"), F.count_distinct(F.when(_named(), F.col("name"))).alias("n_names"), F.count_if(~_named()).alias("n_unresolved"))


def in_order() -> list[Column]:
    """Basic lands last, then by name."""
    return [F.col("is_land"), F.collate("name", "UNICODE"), F.col("name")]


def as_text(detections: DataFrame) -> DataFrame:
    """scan_id, decklist: "count name" lines, lands last, then "1 text" for each unresolved detection."""
    named = lines(detections).select("scan_id", F.when(F.col("is_land"), 1).otherwise(0).alias("part"), F.col("name").alias("key"), F.lit(0).cast("long").alias("ord"), F.concat_ws(" ", F.col("count").cast("string"), "name").alias("line"))
    rest = unresolved(detections).select("scan_id", F.lit(2).alias("part"), F.lit("").alias("key"), F.col("ord").cast("long"), F.concat(F.lit("1 "), F.coalesce(F.nullif(F.col("detected_text"), F.lit("")), F.lit("Unknown card"))).alias("line"))
    gathered = named.unionByName(rest).groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("part", "key", "ord", "line"))).alias("all"))
    return gathered.select("scan_id", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("decklist"))


def as_json(detections: DataFrame) -> DataFrame:
    """scan_id, json: cards, unresolved, total and unresolvedCount."""
    cards = lines(detections).groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("is_land", "name", "count"))).alias("cards"))
    rest = unresolved(detections).groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("ord", "detected_text", "confidence"))).alias("rest"))
    both = cards.join(rest, "scan_id", "full")
    cards_out = F.transform(F.coalesce("cards", F.array().cast("array<struct<is_land:boolean,name:string,count:long>>")), lambda c: F.struct(c["name"].alias("name"), c["count"].alias("count")))
    rest_out = F.transform(F.coalesce("rest", F.array().cast("array<struct<ord:long,detected_text:string,confidence:double>>")), lambda c: F.struct(c["detected_text"].alias("detectedText"), c["confidence"].alias("confidence")))
    total = F.aggregate(cards_out, F.lit(0).cast("long"), lambda a, c: a + c["count"])
    return both.select("scan_id", F.to_json(F.struct(cards_out.alias("cards"), rest_out.alias("unresolved"), total.alias("total"), F.size(rest_out).alias("unresolvedCount"))).alias("json"))


def choose_names(detections: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: scan_id, ord, new_name. Chosen names are certain; basic lands keep their count, others count once."""
    both = detections.join(edits, ["scan_id", "ord"], "left")
    chosen, land = F.col("new_name").isNotNull(), t.is_basic_land(F.col("new_name"))
    count = F.when(~chosen, F.col("count")).when(land, F.coalesce("count", F.lit(1))).otherwise(1)
    source = F.when(~chosen, F.col("count_source")).when(land, F.coalesce("count_source", F.lit("manual")))
    return both.withColumns({"count": count.cast("int"), "count_source": source, "name": F.coalesce("new_name", "name"), "status": F.when(chosen, "corrected").otherwise(F.col("status")), "confidence": F.when(chosen, 1.0).otherwise(F.col("confidence"))}).drop("new_name")


def change_counts(detections: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: scan_id, ord, new_count (kept within 1 to 99)."""
    both = detections.join(edits, ["scan_id", "ord"], "left")
    changed = F.col("new_count").isNotNull()
    count = F.when(changed, F.greatest(F.lit(1), F.least(F.lit(99), F.col("new_count")))).otherwise(F.col("count"))
    return both.withColumns({"count": count.cast("int"), "count_source": F.when(changed, "manual").otherwise(F.col("count_source")), "status": F.when(changed, "corrected").otherwise(F.col("status"))}).drop("new_count")


def delete(detections: DataFrame, keys: DataFrame) -> DataFrame:
    return detections.join(keys.select("scan_id", "ord"), ["scan_id", "ord"], "left_anti")


def add_cards(detections: DataFrame, added: DataFrame) -> DataFrame:
    """added: scan_id, ord, name. Rows by hand: certain, counted once, without a box."""
    zero = F.lit(0.0)
    rows = added.select("scan_id", "ord", "name", F.col("name").alias("detected_text"), F.lit(1.0).alias("confidence"), F.lit("corrected").alias("status"), F.lit(1).alias("count"), F.lit("manual").alias("count_source"), *[zero.alias(c) for c in ("x", "y", "width", "height")])
    return detections.unionByName(rows, allowMissingColumns=True)


def overlay(detections: DataFrame, most: int = 28) -> DataFrame:
    """scan_id, ord, label of the detections that are drawn: with a polygon and not counted as 0."""
    drawn = detections.filter(F.col("count").isNull() | (F.col("count") != 0))
    if "polygon" in detections.columns:
        drawn = drawn.filter(F.size("polygon") >= 4)
    label = F.coalesce("name", F.nullif(F.col("detected_text"), F.lit("")), F.lit("Unknown"))
    return drawn.select("scan_id", "ord", t.truncate(F.concat_ws(" ", F.when(F.coalesce("count", F.lit(1)) > 1, F.col("count").cast("string")), label), most).alias("label"))
