"""The whole way from text regions to counted lists, with what each step kept and dropped. Tables of many scans at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset.operators import deck, match, piles, suppress, titles, trace
from gleanset.functions import text as t
from gleanset.sources.tables import written

LAND_ROW = 0.68  # of a scan's height: where its land row begins


@dataclass(frozen=True)
class Scanned:
    """regions: as they came; filtered: those that can't be titles, with why; candidates; detections: with dropped_by and, where kept,
    count and count_source; lines: the counted lists."""

    regions: DataFrame
    filtered: DataFrame
    candidates: DataFrame
    detections: DataFrame
    lines: DataFrame

    def outcomes(self) -> DataFrame:
        """scan_id, ord, outcome, detail for each region: filtered, kept, suppressed, or merged into the candidate before it."""
        judged = self.detections.select("scan_id", "ord", F.when(F.col("dropped_by").isNull(), "kept").otherwise("suppressed").alias("outcome"), F.coalesce("dropped_by", "name").alias("detail"))
        known = self.filtered.select("scan_id", "ord", F.lit("filtered").alias("outcome"), F.col("why").alias("detail")).unionByName(judged)
        rest = self.regions.select("scan_id", "ord").join(known, ["scan_id", "ord"], "left_anti")
        return known.unionByName(rest.select("scan_id", "ord", F.lit("merged").alias("outcome"), F.lit(None).cast("string").alias("detail")))

    def traced(self, expected: DataFrame) -> DataFrame:
        """Why each expected name (scan_id, expected) was found or missed."""
        shown = self.detections.withColumn("text", F.col("detected_text"))
        part = lambda df: df.select("scan_id", "ord", "text")
        kept, dropped = (shown.filter(f"dropped_by is {x}").select("scan_id", "ord", "text", "name") for x in ("null", "not null"))
        return trace.trace(expected, kept, dropped, part(self.candidates), part(self.filtered), part(self.regions))


def scan(regions: DataFrame, index: DataFrame, canvas: tuple[float, float]) -> Scanned:
    """regions: see titles.py; index: see catalog.py. Each step's table is written once and read by all that need it."""
    regions = written(regions.select("scan_id", "ord", "text", "confidence", "x", "y", "width", "height"))
    read = written(titles.with_title_reason(regions))
    likely = written(titles.merge_line_fragments(read.filter("why is null")))
    candidates = written(titles.with_title_reason(likely, "_why", "_garbled").filter(F.col("_why").isNull() & ~F.col("_garbled")).drop("_why", "_garbled"))
    found = match.detections(candidates, index, F.lit(canvas[1]))
    judged = suppress.judged(found, F.lit(canvas[1] * LAND_ROW))
    kept = judged.filter("dropped_by is null")
    counted = piles.settle(piles.pile_counts(kept.filter(t.is_basic_land(F.col("name"))), regions, canvas=canvas))
    counted = counted.select("scan_id", "ord", F.col("count").alias("_n"), F.col("count_source").alias("_source"))
    rows = judged.join(counted, ["scan_id", "ord"], "left")
    # A land whose pile another one counts has no source of its own.
    source = F.when(F.col("_n") > 0, F.col("_source")).otherwise(F.col("count_source"))
    detections = written(rows.withColumns({"count": F.coalesce("_n", "count"), "count_source": source}).drop("_n", "_source"))
    return Scanned(regions, read.filter("why is not null"), candidates, detections, deck.lines(detections.filter("dropped_by is null")))
