"""Planning of title bands to read again: columns of titles, gaps in them, and the budget of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanset.functions import geometry as g
from gleanset.functions import text as t
from gleanset.sources.tables import written
from gleanset.operators.folds import fold_groups
from gleanset.operators.spatial import boxes, pairs
from gleanset.operators.titles import body_text_reason, likely_titles, merge_line_fragments, select_titles, with_title_reason

ENOUGH_TITLES, DENSE_LINES = 28, 100


def upper_median(c: Column | str) -> Column:
    """The value at half the number of values, rounded down, in order; null without values."""
    all_values = F.sort_array(F.collect_list(c))
    return F.try_element_at(all_values, F.floor(F.size(all_values) / 2).cast("int") + 1)


def percentile(c: Column | str, p: float) -> Column:
    """The value at p times the number of values, rounded down and kept in range, in order."""
    all_values = F.sort_array(F.collect_list(c))
    n = F.size(all_values)
    return F.try_element_at(all_values, F.greatest(F.lit(0), F.least(n - 1, F.floor(n * p))).cast("int") + 1)


def anchors(regions: DataFrame, likely: DataFrame | None = None) -> DataFrame:
    """Title candidates, and regions that pass looser rules, each text once where boxes overlap by more than 0.4 (IoU).

    likely: likely_titles() of the regions, where they are known."""
    titles = written(select_titles(regions, likely=likely).withColumn("_first", F.lit(0)))
    text = F.col("text")
    loose = (body_text_reason(text).isNull()) & (F.size(t.words(text)) <= 6) & F.col("height").between(6, 140) & (t.count_letters(text) >= 2)
    rest = regions.filter(loose).select(*titles.columns[:-1]).join(titles.select("scan_id", "ord", "text"), ["scan_id", "ord", "text"], "left_anti").withColumn("_first", F.lit(1))
    both = written(titles.unionByName(rest).withColumn("_text", t.normalize_text(text)))
    place = lambda side: F.col(f"{side}._first") * F.lit(1 << 40) + F.col(f"{side}.ord")
    again = pairs(both, both, boxes(), boxes(), (place("y") < place("x")) & (g.iou(g.rect("x"), g.rect("y")) > 0.4), ("scan_id", "_text"))
    again = again.select("x.scan_id", "x._first", "x.ord").distinct()
    return both.join(again, ["scan_id", "_first", "ord"], "left_anti").drop("_first", "_text")


def with_columns(rows: DataFrame) -> DataFrame:
    """Anchors with column_id: by centre x, a gap over clamp(0.55 * upper-median width, 24, 72) starts a new column."""
    center = F.col("x") + F.col("width") / 2
    limits = rows.groupBy("scan_id").agg(F.greatest(F.lit(24.0), F.least(F.lit(72.0), F.coalesce(F.nullif(upper_median("width"), F.lit(0.0)), F.lit(48.0)) * 0.55)).alias("_limit"))
    order = Window.partitionBy("scan_id").orderBy("_center", "ord")
    joined = rows.join(limits, "scan_id").withColumn("_center", center)
    new = F.when(F.col("_center") - F.lag("_center").over(order) <= F.col("_limit"), 0).otherwise(1)
    return joined.withColumn("_new", new).withColumn("column_id", F.sum("_new").over(order)).drop("_new", "_limit", "_center")


def columns(rows: DataFrame) -> DataFrame:
    """scan_id, column_id, left_x, right_x, center_x, n, height (upper median). rows: see with_columns()."""
    found = rows.groupBy("scan_id", "column_id").agg(F.count("*").alias("n"), F.min("x").alias("_l"), F.max(F.col("x") + F.col("width")).alias("_r"), upper_median("height").alias("height"))
    pad = F.greatest(F.lit(6.0), F.coalesce(F.nullif("height", F.lit(0.0)), F.lit(14.0)) * 0.25)
    found = found.withColumns({"left_x": F.col("_l") - pad, "right_x": F.col("_r") + pad}).drop("_l", "_r")
    return found.withColumn("center_x", (F.col("left_x") + F.col("right_x")) / 2)


def gaps(rows: DataFrame) -> DataFrame:
    """Anchors with gap: how far below the one before in the column they stand."""
    order = Window.partitionBy("scan_id", "column_id").orderBy("y", "ord")
    return rows.withColumn("gap", F.col("y") - F.lag("y").over(order))


def pitches(rows: DataFrame) -> DataFrame:
    """scan_id, column_id, stack_pitch (upper median of gaps of 32 to 90, else 0) and gap_pitch (least gap of 45 to 190)."""
    between = lambda a, b: F.when(F.col("gap").between(a, b), F.col("gap"))
    return gaps(rows).groupBy("scan_id", "column_id").agg(F.coalesce(upper_median(between(32, 90)), F.lit(0.0)).alias("stack_pitch"), F.min(between(45, 190)).alias("gap_pitch"))


def _bands(rows: DataFrame, y: Column, height: Column, reason: str, priority: Column) -> DataFrame:
    band = g.title_band(F.col("center_x"), F.col("right_x") - F.col("left_x"), y, height)
    return rows.select("scan_id", F.lit(reason).alias("reason"), priority.alias("priority"), band.struct().alias("rect"))


def gap_bands(rows: DataFrame) -> DataFrame:
    """Bands evenly set in gaps of a column that are over 1.55 times its pitch and 68 pixels or more."""
    at = gaps(rows).join(columns(rows).withColumnRenamed("height", "col_height"), ["scan_id", "column_id"]).join(pitches(rows), ["scan_id", "column_id"])
    wide = at.filter((F.col("gap") > F.col("gap_pitch") * 1.55) & (F.col("gap") >= 68))
    steps = F.greatest(F.lit(1), t.round_half_up(F.col("gap") / F.col("gap_pitch"))).cast("int")
    each = wide.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    each = each.withColumn("_y", F.col("y") - F.col("gap") + F.col("gap") * F.col("_i") / (F.col("_n") + 1))
    height = F.coalesce(F.nullif("col_height", F.lit(0.0)), F.lit(16.0))
    rect_y = F.col("_y") - F.greatest(F.lit(6.0), height * 0.45)
    return _bands(each, F.col("_y"), height, "column-gap", 200 + rect_y)


def stack_bands(rows: DataFrame, canvas_height: Column) -> DataFrame:
    """Bands at the column's pitch above its first and below its last title over the land row: five up, eight down."""
    land_top = canvas_height * 0.58
    ends = rows.groupBy("scan_id", "column_id").agg(F.min(F.when(F.col("y") < land_top, F.col("y"))).alias("_t"), F.max(F.when(F.col("y") < land_top, F.col("y"))).alias("_b"), F.min("y").alias("_t0"), F.max("y").alias("_b0"))
    each = ends.join(columns(rows), ["scan_id", "column_id"]).join(pitches(rows), ["scan_id", "column_id"])
    pitch = F.coalesce(F.nullif("stack_pitch", F.lit(0.0)), F.lit(56.0))
    up = F.filter(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.coalesce("_t", "_t0") - pitch * i), lambda y: y >= 6)
    down = F.filter(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.coalesce("_b", "_b0") + pitch * i), lambda y: y < land_top - 48)
    each = each.withColumn("_y", F.explode(F.concat(up, down)))
    height = F.coalesce(F.nullif("height", F.lit(0.0)), F.lit(16.0))
    return _bands(each, F.col("_y"), height, "column-gap", 160 + F.col("_y") - F.greatest(F.lit(6.0), height * 0.45))


def land_bands(rows: DataFrame, canvas_width: Column, canvas_height: Column) -> DataFrame:
    """A band for each column at its lowest title in the land row, or where one would stand below its spells."""
    line = canvas_height * 0.58
    lowest = rows.groupBy("scan_id", "column_id").agg(F.max_by(F.struct("y", "height"), F.struct("y", "ord")).alias("_low"))
    each = lowest.join(columns(rows), ["scan_id", "column_id"])
    low = F.col("_low.y") >= line
    y, height = F.when(low, F.col("_low.y")).otherwise(canvas_height * 0.7), F.when(low, F.col("_low.height")).otherwise(F.coalesce(F.nullif("height", F.lit(0.0)), F.lit(16.0)))
    return _bands(each, y, height, "land-row", 100 - F.col("center_x") / F.greatest(F.lit(1), canvas_width))


def weak_bands(rows: DataFrame) -> DataFrame:
    """A band at each title."""
    each = rows.join(columns(rows).drop("height"), ["scan_id", "column_id"])
    return _bands(each, F.col("y"), F.col("height"), "weak-title", 300 + F.col("y") - F.greatest(F.lit(6.0), F.col("height") * 0.45))


def missing_land_bands(rows: DataFrame, canvas_width: Column, canvas_height: Column) -> DataFrame:
    """Bands at the pitch of the land row's columns, from the leftmost to 0.96 of the canvas; occupied: one of the columns is there."""
    top = canvas_height * 0.655
    lands = rows.filter((F.col("y") + F.col("height") / 2 >= top) & (F.col("y") <= canvas_height * 0.795)).groupBy("scan_id", "column_id").agg(F.min_by("height", F.struct("y", "ord")).alias("_h"))
    each = lands.join(columns(rows), ["scan_id", "column_id"]).withColumn("_w", F.col("right_x") - F.col("left_x"))
    order = Window.partitionBy("scan_id").orderBy("center_x")
    spaced = each.withColumn("_gap", F.col("center_x") - F.lag("center_x").over(order))
    pitch = upper_median(F.when(F.col("_gap").between(40, 220), F.col("_gap")))
    per_scan = spaced.groupBy("scan_id").agg(F.count("*").alias("_n"), pitch.alias("_pitch"), upper_median("_h").alias("_h"), upper_median("_w").alias("_w"), F.min("center_x").alias("_left"), F.collect_list("center_x").alias("_centers"))
    per_scan = per_scan.filter((F.col("_n") >= 2) & (F.col("_pitch") >= 40) & (F.col("_left") <= canvas_width * 0.96))
    steps = F.floor((canvas_width * 0.96 - F.col("_left")) / F.col("_pitch")).cast("int")
    each = per_scan.withColumn("_i", F.explode(F.sequence(F.lit(0), steps)))
    center = F.col("_left") + F.col("_pitch") * F.col("_i")
    occupied = F.exists("_centers", lambda c: F.abs(c - center) < F.col("_pitch") * 0.38)
    band = g.title_band_at(center, F.coalesce(F.nullif("_w", F.lit(0.0)), F.lit(70.0)), top, F.coalesce(F.nullif("_h", F.lit(0.0)), F.lit(18.0)))
    return each.select("scan_id", F.lit("land-row").alias("reason"), (50 - band.x / F.greatest(F.lit(1), canvas_width)).alias("priority"), band.struct().alias("rect"), occupied.alias("occupied"))


def without_strong_title(bands: DataFrame, regions: DataFrame, likely: DataFrame | None = None) -> DataFrame:
    """The bands in which the scan's regions make no title: those inside are filtered and their fragments joined as if the
    band were a scan of its own, so that two fragments that only together make a title count.

    likely: likely_titles() of the regions as a written table, where it is there."""
    band, box = g.rect("rect"), g.rect()
    inside = [(band.x, band.right), (band.y, band.bottom)]
    middle = [(box.x, box.right), (box.center_y, box.center_y)]
    # Written, so that no reader of the plan's tables computes them again.
    likely = (written(likely_titles(regions)) if likely is None else likely).select("scan_id", "ord", "text", "confidence", "x", "y", "width", "height")
    bands = written(bands)
    places = written(bands.select("scan_id", "rect").distinct())
    met = pairs(places, likely, inside, middle, g.in_band(g.rect("y"), g.rect("x.rect"))).select("x.scan_id", "x.rect", *[f"y.{c}" for c in likely.columns[1:]])
    # What bands share is judged once: most fragments are joined with none, or with the same ones in many bands.
    merged = written(merge_line_fragments(met, ("scan_id", "rect")))
    titles = with_title_reason(merged, "_why", "_garbled").filter(F.col("_why").isNull() & ~F.col("_garbled"))
    strong = written(titles.select("scan_id", "rect").distinct())
    return bands.join(strong, ["scan_id", "rect"], "left_anti")


def plan(regions: DataFrame, canvas_width: Column, canvas_height: Column) -> DataFrame:
    """scan_id, reason, priority, rect of all planned bands; of those that overlap by more than 0.55 (IoU), the first by priority."""
    from gleanset.operators.suppress import greedy_nms

    regions = written(regions)
    # Both the anchors and the bands ask for them: the rules over all texts are run once.
    likely = written(likely_titles(regions))
    at = written(with_columns(anchors(regions, likely)))
    slots = written(missing_land_bands(at, canvas_width, canvas_height))
    unsure = stack_bands(at, canvas_height).unionByName(land_bands(at, canvas_width, canvas_height)).unionByName(weak_bands(at)).unionByName(slots.filter("occupied").drop("occupied"))
    strip = g.land_row_strip(canvas_width, canvas_height)
    strips = at.select("scan_id").distinct().select("scan_id", F.lit("land-row-strip").alias("reason"), F.lit(0.0).alias("priority"), strip.struct().alias("rect"))
    free = slots.filter("not occupied").drop("occupied")
    everything = strips.unionByName(gap_bands(at)).unionByName(without_strong_title(unsure, regions, likely)).unionByName(free)
    numbered = written(everything).withColumn("ord", F.row_number().over(Window.partitionBy("scan_id").orderBy("priority", "reason", "rect")).cast("long"))
    flat = written(numbered.select("*", *[F.col(f"rect.{c}").alias(c) for c in ("x", "y", "width", "height")]))
    return greedy_nms(flat, 0.55, [F.col("priority"), F.col("ord")]).filter("kept").select("scan_id", "ord", "reason", "priority", "rect")


def attempts(planned: DataFrame, settings: DataFrame) -> DataFrame:
    """The planned bands in order of priority, as many as the scan's settings allow."""
    order = Window.partitionBy("scan_id").orderBy("priority", "ord")
    ranked = planned.withColumn("attempt", F.row_number().over(order)).join(settings.filter("enabled").select("scan_id", "max_attempts"), "scan_id")
    return ranked.filter("attempt <= max_attempts").drop("max_attempts")


def budget(stats: DataFrame) -> DataFrame:
    """stats (scan_id, raw_lines, titles, mode, fast, memory_gb) with enabled, max_attempts, allow_expand, enhance and note."""
    off = (F.col("mode") == "off") | F.coalesce("fast", F.lit(False))
    full, minimal = F.col("mode") == "full", F.col("mode") == "minimal"
    enough = F.col("titles") >= ENOUGH_TITLES
    dense, low = (F.col("raw_lines") >= DENSE_LINES) | enough, F.coalesce(F.col("memory_gb") <= 4, F.lit(False))
    number = F.when(off, 0).when(full, 36).when(minimal, 10).when((dense | low) & enough, 0).when(low, 8).when(dense, 12).otherwise(24)
    enabled = F.when(off, False).when(full, True).when(minimal, ~enough).when(dense & enough, False).otherwise(True)
    generous = F.when(off, False).when(full, True).when(minimal, False).otherwise(~(dense | low))
    note = F.when(off, "title re-OCR disabled").when(full, None).when(minimal & enough, "enough titles from first pass").when(minimal, "minimal re-OCR").when(enough, "skipped re-OCR (dense photo, first pass enough)").when(dense, "capped re-OCR (dense photo)").when(low, "capped re-OCR (low memory)")
    return stats.withColumns({"enabled": enabled, "max_attempts": number, "allow_expand": generous, "enhance": generous, "note": note})


MERGED = "scan_id long, ord long, text string, confidence double, x double, y double, width double, height double"


def _taken_in(rows: list[dict]) -> list[tuple]:
    """One scan's regions: added ones (later) against what is there by then, one after the other."""
    there: list[dict] = []
    for r in rows:
        if not r["later"]:
            there.append(r)
            continue
        near = [k for k, o in enumerate(there) if _iou(o, r) > 0.45]
        if any(there[k]["squeezed"] == r["squeezed"] for k in near):
            continue
        if not near:
            there.append(r)
            continue
        old = there[near[0]]
        if r["sure"] > old["sure"] or old["rejected"] and not r["rejected"]:
            there[near[0]] = {**r, "ord": old["ord"]}
    return [tuple(r[f.split()[0]] for f in MERGED.split(", ")) for r in there]


def _iou(a: dict, b: dict) -> float:
    if any(r[c] is None for r in (a, b) for c in ("x", "y", "width", "height")):
        return 0.0
    w = min(a["x"] + a["width"], b["x"] + b["width"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["height"], b["y"] + b["height"]) - max(a["y"], b["y"])
    shared = w * h if w > 0 and h > 0 else 0.0
    return shared / (a["width"] * a["height"] + b["width"] * b["height"] - shared) if shared else 0.0


def merge_regions(base: DataFrame, added: DataFrame) -> DataFrame:
    """base with regions read again, which come in one by one in order. One that overlaps (IoU over 0.45) a region of the same
    text goes; else it takes the place of the first region that it overlaps, if it is more confident or the first that can
    be a title; else, overlapping none, it is added. Scans are independent; what depends on the order is one scan's.
    A confidence that is null compares as 0; a box that is null overlaps none."""
    flat = lambda rows, later: with_title_reason(rows, "_why").select(
        *[F.col(c).cast(kind).alias(c) for c, kind in (f.split() for f in MERGED.split(", "))], F.lit(later).alias("later"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("sure"), t.normalize_text(F.col("text")).alias("squeezed"), F.col("_why").isNotNull().alias("rejected"),
    )
    return fold_groups(flat(base, False).unionByName(flat(added, True)), ["scan_id"], ["later", "ord"], MERGED, _taken_in)
