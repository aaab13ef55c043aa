"""Human labels: stored boxes put back on detections, what is stored, and the report on them."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset.functions import geometry as g
from gleanset.functions import text as t
from gleanset.operators.folds import fold_groups
from gleanset.operators.spatial import boxes, pairs

MIN_IOU = 0.35
BOX = "struct<x:double,y:double,width:double,height:double>"
STORED = f"struct<version:int,filename:string,updatedAt:string,detections:array<struct<box:{BOX},detectedText:string,name:string,verdict:string,correctedText:string>>,added:array<struct<box:{BOX},text:string>>>"


def read_store(json: DataFrame, column: str = "json") -> DataFrame:
    """filename and labels of stored JSON values of version 1; others are left out."""
    parsed = json.select(F.from_json(column, STORED).alias("labels")).filter("labels.version = 1")
    return parsed.select(F.col("labels.filename").alias("filename"), "labels")


def upsert(store: DataFrame, new: DataFrame, key: str = "filename") -> DataFrame:
    return store.join(new.select(key), key, "left_anti").unionByName(new)


def clear(store: DataFrame, keys: DataFrame, key: str = "filename") -> DataFrame:
    return store.join(keys.select(key), key, "left_anti")


def meaningful(store: DataFrame) -> DataFrame:
    return store.filter((F.size("labels.detections") > 0) | (F.size("labels.added") > 0))


def with_verdicts(detections: DataFrame, annotations: DataFrame) -> DataFrame:
    """detections with verdict ("unreviewed" where there is none) and corrected_text."""
    both = detections.join(annotations.select("scan_id", "ord", "verdict", "corrected_text"), ["scan_id", "ord"], "left")
    return both.withColumn("verdict", F.coalesce("verdict", F.lit("unreviewed")))


def verdict_counts(rows: DataFrame) -> DataFrame:
    """scan_id and how many detections have each verdict. rows: see with_verdicts()."""
    return rows.groupBy("scan_id").agg(*[F.count_if(F.col("verdict") == v).alias(v.replace("-", "_")) for v in ("correct", "corrected", "not-card", "unreviewed")])


def stored_rows(rows: DataFrame, width: float, height: float) -> DataFrame:
    """What is stored of reviewed detections: boxes on the unit square, text, name, verdict and correction."""
    w, h = F.lit(float(width)), F.lit(float(height))
    return rows.filter("verdict <> 'unreviewed'").select("scan_id", "ord", g.normalized(g.rect(), w, h).struct().alias("box"), "detected_text", "name", "verdict", "corrected_text")


def _assign(pairs: list[dict]) -> list[tuple]:
    """One scan's saved labels in order, each to the free detection it overlaps most (the first of equals)."""
    taken, out = set(), []
    for saved, rows in groupby(pairs, lambda r: r["saved_ord"]):
        if free := [r for r in rows if r["ord"] not in taken]:
            best = max(free, key=lambda r: r["overlap"])
            taken.add(best["ord"])
            out.append((best["scan_id"], saved, best["ord"], best["overlap"]))
    return out


def reattach(saved: DataFrame, detections: DataFrame) -> DataFrame:
    """scan_id, saved_ord, ord, overlap: one detection for each saved box (scan_id, saved_ord, x, y, width, height)."""
    overlap = g.iou(g.rect("x"), g.rect("y"))
    box = ("x", "y", "width", "height")
    met = pairs(saved.filter("saved_ord is not null").select("scan_id", "saved_ord", *box), detections.select("scan_id", "ord", *box), boxes(), boxes(), (overlap > MIN_IOU) & ~F.isnan(overlap))
    flat = met.select(F.col("x.scan_id").cast("long").alias("scan_id"), F.col("x.saved_ord").cast("long").alias("saved_ord"), F.col("y.ord").cast("long").alias("ord"), overlap.cast("double").alias("overlap"))
    return fold_groups(flat, ["scan_id"], ["saved_ord", "ord"], "scan_id long, saved_ord long, ord long, overlap double", _assign)


def report_rows(rows: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """scan_id, section, n and lines of the label report. Corrections and added regions without text are in no section.

    rows: see with_verdicts(); added: scan_id, ord, text and a box."""
    box = g.rect()
    numbers = F.concat(F.lit(" ["), F.concat_ws(", ", *[t.round_half_up(c).cast("string") for c in box]), F.lit("]"))
    label = F.coalesce("name", "detected_text", F.lit("(no text)"))
    fixed = F.trim(F.coalesce("corrected_text", F.lit("")))
    section = F.when((F.col("verdict") == "corrected") & (fixed == ""), None).otherwise(F.col("verdict"))
    line = F.when(F.col("verdict") == "corrected", F.concat(F.lit('- detected "'), F.coalesce(F.nullif(F.col("detected_text"), F.lit("")), F.lit("(empty OCR)")), F.lit('" -> should be "'), fixed, F.lit('"'), numbers))
    line = line.otherwise(F.concat(F.lit('- "'), label, F.lit('"'), numbers, F.when(F.col("verdict") == "not-card", " (not a card title)").otherwise("")))
    listed = rows.select("scan_id", section.alias("section"), "ord", line.alias("line")).filter("section is not null")
    if added is not None:
        missed = F.concat(F.lit('- "'), F.trim("text"), F.lit('"'), numbers)
        listed = listed.unionByName(added.filter(F.trim("text") != "").select("scan_id", F.lit("missed").alias("section"), "ord", missed.alias("line")))
    found = listed.groupBy("scan_id", "section").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    return found.withColumn("lines", F.when(F.col("section") == "unreviewed", "").otherwise(F.col("lines")))


#: The sections of a report in order: verdict, heading.
SECTIONS = (("correct", "Correct detections"), ("corrected", "Wrong names to fix"), ("not-card", "False positives to suppress"), ("missed", "Missed titles to detect"))
OPENING = "Use this hand-labeled scan to improve how titles are found, matched and counted."
CLOSING = "Corrected and missed items are the truth; false positives should go. Changes that hold for other scans are better than exceptions for these texts."


def report_text(rows: DataFrame, scans: DataFrame, added: DataFrame | None = None, opening: str = OPENING, closing: str = CLOSING) -> DataFrame:
    """scan_id, report: one text a scan, with opening and closing lines around its sections; empty ones say so.

    scans: scan_id, filename, width, height, a report each, with detections or not; rows, added: see report_rows()."""
    found = report_rows(rows, added)
    per_scan = found.groupBy("scan_id").agg(*[F.max(F.when(F.col("section") == v, F.struct("n", "lines"))).alias(v) for v, _ in (*SECTIONS, ("unreviewed", ""))])
    lines = [
        F.lit(opening), F.lit(""), F.concat(F.lit("Sample: "), "filename"),
        F.concat(F.lit("Prepared image: "), t.round_half_up(F.col("width")).cast("string"), F.lit("x"), t.round_half_up(F.col("height")).cast("string"), F.lit(" px (every box below is [x, y, width, height] in these pixels).")), F.lit(""),
    ]
    for verdict, heading in SECTIONS:
        part = F.col(f"`{verdict}`")
        lines += [F.concat(F.lit(f"{heading} ("), F.coalesce(part["n"], F.lit(0)).cast("string"), F.lit("):")), F.coalesce(part["lines"], F.lit("- none marked")), F.lit("")]
    unreviewed = F.concat(F.lit("Unreviewed detections (not labeled): "), F.col("unreviewed.n").cast("string"), F.lit("\n"))
    text = F.concat_ws("\n", *lines, unreviewed, F.lit(closing))  # a null line is left out
    return scans.select("scan_id", "filename", "width", "height").join(per_scan, "scan_id", "left").select("scan_id", text.alias("report"))


def restored_counts(assigned: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """scan_id, restored: how many stored labels came back, on detections (see reattach()) and as added regions."""
    both = assigned.select("scan_id") if added is None else assigned.select("scan_id").unionByName(added.select("scan_id"))
    return both.groupBy("scan_id").agg(F.count("*").alias("restored"))
