"""Pile sizes of basic lands: dice near a title, fanned edges, and titles of one land close together."""

from __future__ import annotations

from functools import cmp_to_key

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanset.functions import geometry as g
from gleanset.functions import text as t
from gleanset.operators.bands import percentile
from gleanset.operators.folds import fold_groups
from gleanset.operators.spatial import boxes, pairs
from gleanset.sources.tables import written


SIDES = ("x", "y", "width", "height")


def die_faces(regions: DataFrame) -> DataFrame:
    """Regions whose text is a die value, with value and area."""
    # Three characters at most and perhaps a line end: longer texts needn't be put to the patterns.
    short = regions.filter(F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))) <= 4)
    return short.withColumn("value", t.parse_die_value(F.col("text"))).filter("value is not null").withColumn("area", F.col("width") * F.col("height"))


def on_canvas(lands: DataFrame, canvas: tuple[float, float] | DataFrame | None) -> DataFrame:
    """lands with their card bodies and art, on the canvas: card (the whole body), body (clipped), art (of the clipped body) and art_shown (clipped).

    canvas: width and height, or a table of scan_id, width and height; boxes of scans without a size aren't clipped."""
    if isinstance(canvas, DataFrame):
        sizes = canvas.select("scan_id", F.col("width").cast("double").alias("_w"), F.col("height").cast("double").alias("_h"))
        lands = lands.join(sizes, "scan_id", "left")
    else:
        lands = lands.withColumns({c: F.lit(v).cast("double") for c, v in zip(("_w", "_h"), canvas or (None, None))})
    title, w, h = g.rect(), F.col("_w"), F.col("_h")
    kept = [c for c in lands.columns if c not in ("_w", "_h")]

    def put(df: DataFrame, name: str, r: g.Rect) -> DataFrame:
        # As plain columns: Spark computes those once, but would write a struct's expressions out at each use of a field.
        return df.withColumns({f"_{name}_{c}": v.cast("double") for c, v in zip(SIDES, r)})

    def got(name: str) -> g.Rect:
        return g.Rect(*(F.col(f"_{name}_{c}") for c in SIDES))

    rows = put(lands, "card", g.card_body(title))
    rows = put(rows, "body", g.clip_pixels(got("card"), w, h))
    rows = put(rows, "art", g.art_rect(got("body"), title))
    rows = put(rows, "art_shown", g.clip_pixels(got("art"), w, h))
    return rows.select(*kept, *[got(name).struct().alias(name) for name in ("card", "body", "art", "art_shown")])


def land_faces(lands: DataFrame, regions: DataFrame, canvas: tuple[float, float] | DataFrame | None = None) -> DataFrame:
    """Dice of each land: scan_id, ord, kind, face_ord, value, area, confidence, score, center_x, center_y and the box.

    kind is "near" for dice in the search window, of fitting size and off the title, and "other" for any others over the
    art; score is the nearness to the art's middle. lands: detections of lands."""
    return _faces(written(on_canvas(lands.select("scan_id", "ord", "x", "y", "width", "height"), canvas).drop("card", "body")), regions)


def _faces(placed: DataFrame, regions: DataFrame) -> DataFrame:
    """land_faces() of lands on their canvas. Both sides of the join are written tables: it reads each of them twice, and a filter
    on what is derived from a box would be pushed below all that derives it, its expressions written out at each use."""
    faces = written(die_faces(regions).select("scan_id", "ord", "value", "area", "confidence", "x", "y", "width", "height"))
    search, art, title, face = g.die_search(g.rect("art")), g.rect("x.art_shown"), g.rect("x"), g.rect("y")
    window = [(search.x, search.right), (search.y, search.bottom)]
    seen = g.die_search(g.rect("x.art"))
    near = g.overlaps(face, seen) & (g.iou(face, title) <= 0.2) & (F.col("y.area") >= 16) & (F.col("y.area") <= seen.width * seen.height * 0.35)
    met = pairs(placed.select("scan_id", "ord", *SIDES, "art", "art_shown"), faces, window, boxes(), near | g.overlaps(face, art))
    score = g.die_center_score(face, art.center_x, art.center_y)
    return met.select(
        "x.scan_id", "x.ord", F.when(near, "near").otherwise("other").alias("kind"), F.col("y.ord").alias("face_ord"), "y.value", "y.area", "y.confidence", score.alias("score"),
        art.center_x.alias("center_x"), art.center_y.alias("center_y"), *[F.col(f"y.{c}").alias(c) for c in ("x", "y", "width", "height")], g.overlaps(face, art).alias("over_art"),
    )


def joined_digits(faces: DataFrame) -> DataFrame:
    """Faces with pairs of neighbouring single digits joined to one value of at most 24; pairs are taken from the left.

    The box of a pair covers both digits, so its nearness is that of the pair. single: was one digit, alone or joined."""
    w = Window.partitionBy("scan_id", "ord").orderBy("x", "face_ord")
    single = faces.filter("value <= 9")
    after = {f"n_{c}": F.lead(c).over(w) for c in ("value", "area", "confidence", "x", "y", "width", "height")}
    at = single.withColumns(after)
    gap = F.col("n_x") - (F.col("x") + F.col("width"))
    fits = (gap >= -4) & (gap <= F.greatest(F.lit(10), F.col("width") * 1.2)) & (F.abs(F.col("y") - F.col("n_y")) <= F.greatest(F.lit(8), F.col("height") * 0.7)) & (F.col("value") * 10 + F.col("n_value")).between(1, 24)
    at = at.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    # In a run of faces that fit the next one, every other face begins a pair: the first, third and so on.
    start = F.when(F.col("_fits") & ~F.coalesce(F.lag("_fits").over(w), F.lit(False)), F.row_number().over(w))
    at = at.withColumn("_start", F.last(start, True).over(w)).withColumn("_place", F.row_number().over(w) - F.col("_start"))
    at = at.withColumn("_begins", F.col("_fits") & (F.coalesce("_place", F.lit(1)) % 2 == 0))
    at = at.withColumn("_taken", F.coalesce(F.lag("_begins").over(w), F.lit(False))).filter("not _taken")
    pick = lambda c, pair: F.when(F.col("_begins"), pair).otherwise(F.col(c)).alias(c)
    changed = {
        "value": F.col("value") * 10 + F.col("n_value"), "area": F.col("area") + F.col("n_area"), "confidence": F.least("confidence", "n_confidence"), "y": F.least("y", "n_y"),
        "width": F.col("n_x") + F.col("n_width") - F.col("x"), "height": F.greatest("height", "n_height"),
    }
    kept = [c for c in faces.columns if c != "score"]
    out = at.select(*[pick(c, changed[c]) if c in changed else c for c in kept], F.lit(True).alias("single"))
    return out.unionByName(faces.filter("value > 9").select(*kept, F.lit(False).alias("single")))


def _compared(a: dict, b: dict) -> float:
    """Below 0 if face a comes before b. A comparison with tolerances: only pairs of faces can be put to it."""
    if abs(b["score"] - a["score"]) > 0.12:
        return b["score"] - a["score"]
    larger = max(a["area"], b["area"])
    digits = (b["value"] >= 10) - (a["value"] >= 10)
    if digits and abs(a["area"] - b["area"]) < larger * 0.4:
        return digits
    if abs(b["area"] - a["area"]) > larger * 0.15:
        return b["area"] - a["area"]
    return b["confidence"] - a["confidence"]


def _picked(rows: list[dict]) -> list[tuple]:
    """One land's faces: those that were two digits or more as they came, then the others from the left."""
    own = [r for r in rows if r["single"]]
    rows = sorted(rows, key=lambda r: r["face_ord"]) if len(own) < 2 else [r for r in rows if not r["single"]] + own
    best = sorted(rows, key=cmp_to_key(_compared))[0]
    return [(best["scan_id"], best["ord"], best["value"], best["kind"], None)]


def _unread(rows: list[dict], error: Exception) -> list[tuple]:
    return [(rows[0]["scan_id"], rows[0]["ord"], None, None, f"{type(error).__name__}: {error}")]


def best_face(faces: DataFrame) -> DataFrame:
    """scan_id, ord, die, kind, error: by nearness to the art's middle (over 0.12), two digits (of faces of similar area), area
    (over 15 %), confidence (null: 0). A land whose faces can't be compared has an error instead of a die."""
    score = g.die_center_score(g.rect(), F.col("center_x"), F.col("center_y"))
    flat = faces.select(
        *[F.col(c).cast("long").alias(c) for c in ("scan_id", "ord", "face_ord")], F.col("value").cast("int").alias("value"), *[F.col(c).cast("double").alias(c) for c in ("area", "x")],
        F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), score.alias("score"), "single", "kind",
    )
    order = ["single", "x", "face_ord"]
    return fold_groups(flat, ["scan_id", "ord"], order, "scan_id long, ord long, die int, kind string, error string", _picked, _unread)


def siblings(lands: DataFrame, canvas: tuple[float, float] | DataFrame | None = None) -> DataFrame:
    """scan_id, ord, sibling: other lands of the same name whose card bodies' centres are close. A land's own body is clipped
    to the canvas, the others' aren't."""
    return _siblings(written(on_canvas(lands.filter("name is not null").select("scan_id", "ord", "name", "x", "y", "width", "height"), canvas).drop("art", "art_shown")))


def _siblings(placed: DataFrame) -> DataFrame:
    """siblings() of lands on their canvas."""
    placed = placed.filter("name is not null").select("scan_id", "ord", "name", *SIDES, "card", "body")
    a, b = g.rect("x.body"), g.rect("y.card")
    # Closer than 1.35 of the wider body: the spans are half of that about each centre, and so meet.
    about = lambda r: [(c - r.width * 1.35, c + r.width * 1.35) for c in (r.center_x, r.center_y)]
    close = (F.col("x.ord") != F.col("y.ord")) & (g.center_distance(a, b) < F.greatest(a.width, b.width) * 1.35)
    met = pairs(placed, placed, about(g.rect("body")), about(g.rect("card")), close, ("scan_id", "name"))
    return met.select("x.scan_id", "x.ord", F.col("y.ord").alias("sibling"))


def pile_counts(lands: DataFrame, regions: DataFrame, fans: DataFrame | None = None, pips: DataFrame | None = None, canvas: tuple[float, float] | DataFrame | None = None) -> DataFrame:
    """scan_id, ord, count, source, siblings, rank_score and note for each land: dice, else pips, else a fan, else close titles.

    fans (scan_id, ord, fan) and pips (scan_id, ord, pips) come from pixels.py, where images are. A land whose dice can't be
    judged counts as one card, takes no others in, and has the note "count failed"."""
    lands = written(on_canvas(lands.select("scan_id", "ord", "name", "confidence", *SIDES), canvas))
    faces = written(_faces(lands, regions))
    # Dice over the art only count for lands that have none in their window.
    has = F.max((F.col("kind") == "near").cast("int")).over(Window.partitionBy("scan_id", "ord")) == 1
    die = best_face(joined_digits(faces.withColumn("_has", has).filter((F.col("kind") == "near") | ~F.col("_has") & F.col("over_art")).drop("_has", "over_art")))
    close = _siblings(lands).groupBy("scan_id", "ord").agg(F.sort_array(F.collect_list("sibling")).alias("siblings"))
    rows = lands.join(die, ["scan_id", "ord"], "left").join(close, ["scan_id", "ord"], "left")
    for table, name in ((fans, "fan"), (pips, "pips")):
        rows = rows.withColumn(name, F.lit(None).cast("int")) if table is None else rows.join(table, ["scan_id", "ord"], "left")
    failed = F.col("error").isNotNull()
    none = F.array().cast("array<long>")
    rows = rows.withColumn("siblings", F.when(failed, none).otherwise(F.coalesce("siblings", none)))
    clustered = F.size("siblings") + 1
    pip = F.when(F.col("pips").between(1, 6), F.col("pips"))
    dice = F.when(~failed, F.coalesce("die", pip))
    fan = F.when(~failed & F.col("fan").between(4, 8) & (F.col("fan") >= clustered), F.col("fan"))
    source = F.when(dice.isNotNull(), "dice").when(fan.isNotNull(), "fan").otherwise("ocr")
    note = (
        F.when(failed, F.lit("count failed")).when(F.col("die").isNotNull(), F.concat(F.when(F.col("kind") == "near", "raw OCR ").otherwise("art OCR "), F.col("die").cast("string")))
        .when(pip.isNotNull(), F.concat(pip.cast("string"), F.lit(" pips"))).when(fan.isNotNull(), F.concat(fan.cast("string"), F.lit(" edges"))).when(clustered > 1, "clustered titles")
    )
    rows = rows.withColumns({"count": F.coalesce(dice, fan, clustered).cast("int"), "count_source": source, "note": note})
    rank = F.when(F.col("count_source") == "dice", 400).when(F.col("count_source") == "fan", 300).otherwise(100) + F.col("count") * 2 + F.coalesce("confidence", F.lit(0.0))
    return rows.select("scan_id", "ord", "name", "count", "count_source", "siblings", rank.alias("rank_score"), "note")


def _winners(rows: list[dict]) -> list[tuple]:
    """The best-ranked land of a scan counts for itself and its siblings, which count 0, and so on."""
    used, out = set(), {}
    for r in sorted(rows, key=lambda r: (-r["rank_score"], r["ord"])):
        if r["ord"] not in used:
            out[r["ord"]] = r["count"]
            used.update([r["ord"], *r["siblings"]])
    return [(r["scan_id"], r["ord"], out.get(r["ord"], 0), r["count_source"]) for r in rows]


def settle(counts: DataFrame) -> DataFrame:
    """scan_id, ord, count, count_source after each pile is counted once. counts: see pile_counts()."""
    flat = counts.select(F.col("scan_id").cast("long").alias("scan_id"), F.col("ord").cast("long").alias("ord"), "count", "count_source", "siblings", "rank_score")
    return fold_groups(flat, ["scan_id"], ["ord"], "scan_id long, ord long, count int, count_source string", _winners)


def smoothed(profile: DataFrame, radius: int = 3) -> DataFrame:
    """profile (case_id, i, v) with s: the mean over radius values to either side, as many as there are."""
    w = Window.partitionBy("case_id").orderBy("i").rowsBetween(-radius, radius)
    return profile.withColumn("s", F.avg("v").over(w))


def fan_peaks(profile: DataFrame) -> DataFrame:
    """case_id, i, s of the smoothed profile's local maxima over the floor max(1.8 * 55th percentile, 0.22 * maximum)."""
    s = smoothed(profile)
    floors = s.groupBy("case_id").agg(F.greatest(percentile("s", 0.55) * 1.8, F.greatest(F.lit(0.0), F.max("s")) * 0.22).alias("floor"), F.count("*").alias("n"))
    w = Window.partitionBy("case_id").orderBy("i")
    at = s.withColumns({"before": F.lag("s").over(w), "after": F.lead("s").over(w)}).join(floors, "case_id")
    return at.filter((F.col("n") >= 8) & F.col("i").between(2, F.col("n") - 3) & (F.col("s") >= F.col("floor")) & (F.col("s") >= F.col("before")) & (F.col("s") >= F.col("after"))).select("case_id", "i", "s")


def fan_counts(profile: DataFrame, min_spacing: Column) -> DataFrame:
    """case_id, fan: how many cards the regular edges of a profile show; 1 where there is no fan."""
    item = "struct<i:int,s:double>"
    peaks = fan_peaks(profile).groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), "s"))).alias("p"))
    last = lambda done: F.element_at(done, -1)
    # Of peaks closer than the spacing the higher stays, the earlier of equals.
    spaced = F.aggregate("p", F.array().cast(f"array<{item}>"), lambda done, p: F.when((F.size(done) == 0) | (p["i"] - F.try_element_at(done, F.lit(-1))["i"] >= min_spacing), F.concat(done, F.array(p))).when(p["s"] > last(done)["s"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(p))).otherwise(done))
    at = peaks.withColumn("q", F.transform(spaced, lambda p: p["i"].cast("double")))
    gaps = F.filter(F.zip_with("q", F.slice("q", F.lit(2), F.greatest(F.size("q"), F.lit(1))), lambda a, b: b - a), lambda d: d.isNotNull())
    at = at.withColumn("d", F.sort_array(gaps)).withColumn("n", F.size("d"))
    half = F.floor(F.col("n") / 2).cast("int")
    middle = F.when(F.col("n") % 2 == 1, F.try_element_at("d", half + 1)).otherwise((F.try_element_at("d", F.greatest(half, F.lit(1))) + F.try_element_at("d", half + 1)) / 2)
    at = at.withColumn("m", middle)
    regular = F.size(F.filter("d", lambda x: (x > F.col("m") * 0.55) & (x < F.col("m") * 1.7)))
    fan = F.when(F.size("q") <= 2, 1).when(F.col("m") < min_spacing, F.greatest(F.lit(1), t.round_half_up(F.size("q") / 2))).when(regular < 2, 1).otherwise(F.greatest(F.lit(1), t.round_half_up((F.element_at("q", -1) - F.element_at("q", 1)) / F.col("m")) + 1))
    return profile.select("case_id").distinct().join(at.select("case_id", fan.cast("int").alias("fan")), "case_id", "left").withColumn("fan", F.coalesce("fan", F.lit(1)))
