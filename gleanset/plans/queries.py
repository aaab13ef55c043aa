"""The engine's own queries: each applies an operator to its whole role table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanset.functions import geometry as g
from gleanset.functions import similarity as s
from gleanset.functions import text as t
from gleanset.operators import bands, catalog, deck, labels, match, piles, pixels, suppress, titles, trace
from gleanset.plans import inputs, scan
from gleanset.sources import names, ocr
from gleanset.sources.tables import scratch_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
W, H = inputs.CANVAS


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _boxes(df: DataFrame, **boxes: g.Rect) -> DataFrame:
    """scan_id, ord and the four numbers of each box, rounded."""
    return df.select("scan_id", "ord", *[F.round(c, 6).alias(f"{n}_{k}") for n, box in boxes.items() for k, c in zip(("x", "y", "w", "h"), box)])


# Counted lists


@query
def a1_decklist(spark, d):
    return deck.lines(inputs.detections(spark, d)).select("scan_id", "name", "count", "is_land")


@query
def a10_totals(spark, d):
    return deck.totals(inputs.detections(spark, d))


@query
def t6_deck_order(spark, d):
    w = Window.partitionBy("scan_id").orderBy(*deck.in_order())
    return deck.lines(inputs.detections(spark, d)).select("scan_id", "name", "count", F.row_number().over(w).alias("place"))


@query
def k1_decklist_text(spark, d):
    return deck.as_text(inputs.detections(spark, d))


@query
def k2_decklist_json(spark, d):
    return deck.as_json(inputs.detections(spark, d))


@query
def k6_overlay(spark, d):
    return deck.overlay(inputs.detections(spark, d), 12)


@query
def d1_choose_names(spark, d):
    rows = inputs.detections(spark, d)
    edits = rows.filter("pk % 11 = 0").selectExpr("scan_id", "ord", "CASE WHEN pk % 2 = 0 THEN 'Forest' ELSE 'red ring' END AS new_name")
    return deck.choose_names(rows, edits).select("scan_id", "ord", "name", "count", "count_source", "status", "confidence")


@query
def d2_change_counts(spark, d):
    rows = inputs.detections(spark, d)
    return deck.change_counts(rows, rows.filter("pk % 13 = 0").selectExpr("scan_id", "ord", "CAST(pk % 150 AS INT) AS new_count")).select("scan_id", "ord", "count", "count_source", "status")


@query
def d3_delete(spark, d):
    rows = inputs.detections(spark, d)
    return deck.delete(rows, rows.filter("pk % 5 = 0")).select("scan_id", "ord", "name")


@query
def d4_add_cards(spark, d):
    rows = inputs.detections(spark, d)
    added = rows.filter("ord = 1").selectExpr("scan_id", "1000 + ord AS ord", "'Swamp' AS name")
    return deck.lines(deck.add_cards(rows, added)).select("scan_id", "name", "count")


# Text


@query
def f1_normalize(spark, d):
    return inputs.table(spark, d, "documents").select("doc_id", F.md5(t.normalize_name(F.col("text"))).alias("normalized"))


@query
def f2_split_faces(spark, d):
    return inputs.catalog(spark, d).select("card_ord", F.posexplode(t.split_faces(F.col("name"))).alias("face_no", "face"))


@query
def f3_sanitize(spark, d):
    return inputs.sentences(spark, d).select("scan_id", "ord", t.sanitize(F.col("text")).alias("clean"), t.normalize_text(F.col("text")).alias("squeezed"))


@query
def f5_clean_query(spark, d):
    q = inputs.queries(spark, d).withColumn("n", t.normalize_name(t.sanitize(F.col("text"))))
    return q.select("query_id", "n", t.clean_query(F.col("n")).alias("cleaned"), t.distinctive_query(F.col("n")).alias("distinctive"))


@query
def f8_text_measures(spark, d):
    x = F.col("text")
    return inputs.sentences(spark, d).select(
        "scan_id", "ord", t.consonants(x).alias("skeleton"), t.count_letters(x).alias("letters"), t.count_digits(x).alias("digits"), t.short_junk_words(x).alias("junk"), t.consonant_run(x).alias("run"), t.token_gibberish(x).alias("gibberish"), t.truncate(x, 28).alias("short")
    )


@query
def f9_edit_distance(spark, d):
    names = inputs.table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), "p_name")
    return inputs.queries(spark, d).join(names, "query_id").select("query_id", F.levenshtein("text", "p_name").alias("distance"), F.levenshtein("text", "p_name", 2).alias("within_two"))


@query
def f10_pair_measures(spark, d):
    names = inputs.table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), "p_name")
    pairs = inputs.queries(spark, d).join(names, "query_id").select("query_id", t.normalize_name(F.col("text")).alias("q"), t.normalize_name(F.col("p_name")).alias("n"))
    return pairs.select("query_id", *[s.pair_udf(f)("q", "n").alias(f.__name__) for f in (s.lcs, s.consonant_similarity, s.token_similarity, s.name_similarity, s.alignment, s.coverage)])


@query
def f29_type_hits(spark, d):
    return inputs.sentences(spark, d).select("scan_id", "ord", t.type_line_hits(F.col("text")).alias("hits"))


@query
def f31_garbled_ratio(spark, d):
    return inputs.sentences(spark, d).select("scan_id", "ord", F.round(t.garbled_word_ratio(F.col("text")), 6).alias("ratio"))


@query
def f35_die_values(spark, d):
    k = F.get_json_object("props", "$.k")
    return inputs.table(spark, d, "events").select("event_id", t.parse_die_value(k).alias("value"), t.parse_die_value(F.translate(k, "0158", "OlSB")).alias("read"))


@query
def f38_status(spark, d):
    return inputs.detections(spark, d).select("scan_id", "ord", t.status_for_score(F.col("confidence")).alias("status"), F.round(t.combined_score(F.col("confidence"), F.col("confidence")), 6).alias("score"), F.round(t.length_affinity(F.col("detected_text"), F.coalesce("name", F.lit(""))), 6).alias("affinity"))


# Geometry


@query
def g1_overlaps(spark, d):
    rows = inputs.detections(spark, d).select("scan_id", "ord", "x", "y", "width", "height")
    a, b = g.rect("a"), g.rect("b")
    pairs = rows.alias("a").join(rows.alias("b"), (F.col("a.scan_id") == F.col("b.scan_id")) & (F.col("a.ord") < F.col("b.ord")))
    return pairs.select(F.col("a.scan_id").alias("scan_id"), F.col("a.ord").alias("ord"), F.col("b.ord").alias("other"), F.round(g.iou(a, b), 6).alias("iou"), F.round(g.horizontal_overlap(a, b), 6).alias("overlap_x"), g.overlaps(a, b).alias("touches"), g.in_band(a, b).alias("in_band"))


@query
def g11_boxes(spark, d):
    r = g.rect()
    body = g.card_body(r)
    w, h = F.lit(W), F.lit(H)
    return _boxes(inputs.detections(spark, d), body=body, art=g.art_rect(body, r), clipped=g.clip(body, w, h), wider=g.expand(r, w, h, 0.1, 0.25), unit=g.normalized(r, w, h), band=g.title_band(r.center_x, r.width, r.y, r.height))


@query
def g9_crop_scale(spark, d):
    r = g.rect()
    polygon = g.to_polygon(r)
    mapped = g.bounding_box(g.map_to_canvas(polygon, g.Rect(F.lit(5.0), F.lit(7.0), r.width, r.height), F.lit(2.0)))
    return inputs.detections(spark, d).select("scan_id", "ord", F.round(g.band_crop_scale(r), 6).alias("scale"), F.round(g.polygon_angle(polygon, r), 6).alias("angle"), F.round(mapped.x, 6).alias("mapped_x"), F.round(mapped.height, 6).alias("mapped_h"))


@query
def m1_medians(spark, d):
    return inputs.detections(spark, d).groupBy("scan_id").agg(bands.upper_median("height").alias("upper"), F.median("height").alias("middle"), bands.percentile("height", 0.55).alias("p55"))


# Catalog and matching


@query
def s16_catalog_index(spark, d):
    return inputs.index(spark, d).select("card_ord", "pass", "name", "search_name", "normalized")


@query
def a2_lookup(spark, d):
    return catalog.lookup(inputs.index(spark, d)).select("normalized", "name")


@query
def j1_exact(spark, d):
    return match.exact(match.prepared(inputs.queries(spark, d)), inputs.index(spark, d)).select("query_id", "name")


@query
def j2_prefix(spark, d):
    return match.prefix_candidates(match.prepared(inputs.queries(spark, d)), inputs.index(spark, d)).select("query_id", "name").distinct()


@query
def t1_match_top6(spark, d):
    return match.ranked(inputs.queries(spark, d), inputs.index(spark, d)).withColumn("score", F.round("score", 6))


@query
def t5_search(spark, d):
    return match.search(inputs.queries(spark, d), inputs.index(spark, d)).withColumn("score", F.round("score", 6))


# Titles


@query
def p1_filter_reason(spark, d):
    return inputs.regions(spark, d).select("scan_id", "ord", titles.title_filter_reason(F.col("text"), g.rect()).alias("why"))


@query
def p2_body_reason(spark, d):
    return inputs.sentences(spark, d).select("scan_id", "ord", titles.body_text_reason(F.col("text")).alias("why"))


@query
def p3_garbled(spark, d):
    return inputs.sentences(spark, d).select("scan_id", "ord", titles.garbled_title(F.col("text")).alias("garbled"))


@query
def p5_select_titles(spark, d):
    return titles.select_titles(inputs.regions(spark, d)).select("scan_id", "ord", "text", "x", "width")


@query
def s8_ocr_regions(spark, d):
    r = g.rect()
    item = F.struct(F.col("text").alias("text"), (F.col("confidence") * 1.2 - 0.1).alias("score"), F.transform(g.to_polygon(r), lambda p: F.array(p["x"], p["y"])).alias("poly"))
    raw = inputs.regions(spark, d).groupBy("scan_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("ord", item.alias("item")))), lambda x: x["item"])).alias("json"))
    return ocr.ocr_regions(raw).select("scan_id", "ord", "text", F.round("confidence", 6).alias("confidence"), "x", "y", "width", "height")


# Suppression


@query
def st1_nms(spark, d):
    return suppress.greedy_nms(inputs.detections(spark, d)).select("scan_id", "ord", "kept")


@query
def j8_smaller_rereads(spark, d):
    return suppress.drop_smaller_rereads(inputs.detections(spark, d)).select("scan_id", "ord")


@query
def j9_land_rereads(spark, d):
    return suppress.drop_land_rereads(inputs.detections(spark, d), F.lit(300.0)).select("scan_id", "ord")


@query
def j10_nearest_above(spark, d):
    return suppress.nearest_above(inputs.detections(spark, d)).select("scan_id", "ord", F.col("above.ord").alias("above"))


@query
def j13_row_peers(spark, d):
    return suppress.row_peers(inputs.detections(spark, d))


@query
def w2_land_row(spark, d):
    return suppress.land_row(inputs.detections(spark, d)).select("scan_id", "land_y")


@query
def st9_tokens(spark, d):
    rows = inputs.detections(spark, d).withColumn("name", F.when(F.col("pk") % 10 == 1, F.concat(F.lit("Treasure "), "name")).when(F.col("pk") % 10 == 2, F.lit("Food")).otherwise(F.col("name")))
    return suppress.drop_tokens(rows).select("scan_id", "ord")


@query
def st7_suppress(spark, d):
    return suppress.suppress_overlapping(inputs.detections(spark, d), F.lit(H * 0.68)).select("scan_id", "ord", "name")


@query
def j20_trace(spark, d):
    rows = written(inputs.detections(spark, d).select("scan_id", "ord", "pk", "name", F.col("detected_text").alias("text")))
    expected = rows.filter("ord <= 2").selectExpr("scan_id", "CASE WHEN pk % 2 = 0 THEN text ELSE 'red ring' END AS expected")
    part = lambda k: rows.filter(F.col("pk") % 5 == k)
    return trace.trace(expected, part(0), part(1), part(2).drop("name"), part(3).drop("name"), rows.drop("name"))


# Bands


@query
def w1_title_columns(spark, d):
    return bands.with_columns(inputs.detections(spark, d)).select("scan_id", "ord", F.col("column_id").cast("long").alias("column_id"))


@query
def a4_column_extents(spark, d):
    found = bands.columns(bands.with_columns(inputs.detections(spark, d)))
    return found.select("scan_id", F.col("column_id").cast("long").alias("column_id"), "n", F.round("left_x", 6).alias("left_x"), F.round("right_x", 6).alias("right_x"), F.round("center_x", 6).alias("center_x"), "height")


@query
def a5_pitches(spark, d):
    return bands.pitches(bands.with_columns(inputs.detections(spark, d))).select("scan_id", F.col("column_id").cast("long").alias("column_id"), "stack_pitch", "gap_pitch")


@query
def w4_gap_bands(spark, d):
    found = bands.gap_bands(bands.with_columns(inputs.detections(spark, d)))
    return found.select("scan_id", "reason", F.round("priority", 6).alias("priority"), F.round("rect.x", 6).alias("x"), F.round("rect.y", 6).alias("y"))


@query
def st11_plan_bands(spark, d):
    found = bands.plan(inputs.regions(spark, d), F.lit(W), F.lit(H))
    return found.select("scan_id", "ord", "reason", F.round("priority", 6).alias("priority"), F.round("rect.x", 6).alias("x"), F.round("rect.y", 6).alias("y"))


@query
def b1_budget(spark, d):
    stats = inputs.table(spark, d, "orders").selectExpr(
        "o_orderkey AS scan_id", "CAST(o_custkey % 200 AS INT) AS raw_lines", "CAST(o_custkey % 60 AS INT) AS titles", "CASE o_orderkey % 5 WHEN 0 THEN 'off' WHEN 1 THEN 'full' WHEN 2 THEN 'minimal' ELSE 'auto' END AS mode",
        "o_orderkey % 17 = 0 AS fast", "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 9 AS DOUBLE) END AS memory_gb",
    )
    return bands.budget(stats).select("scan_id", "enabled", "max_attempts", "allow_expand", "enhance", "note")


@query
def u2_merge_regions(spark, d):
    base = inputs.detections(spark, d).withColumn("text", F.col("detected_text"))
    again = base.filter("pk % 3 = 0").withColumns({"ord": F.col("ord") + 1000, "x": F.col("x") + 3, "confidence": F.least(F.lit(1.0), F.col("confidence") + 0.1), "text": F.concat("text", F.lit("s"))})
    return bands.merge_regions(base, again).select("scan_id", "ord", "text", F.round("confidence", 6).alias("confidence"), "x")


# Piles


@query
def j17_siblings(spark, d):
    return piles.siblings(inputs.lands(spark, d), inputs.CANVAS)


@query
def j18_land_faces(spark, d):
    return piles.land_faces(inputs.lands(spark, d), inputs.dice(spark, d), inputs.CANVAS).filter("kind = 'near'").select("scan_id", "ord", "face_ord", "value", "area", F.round("score", 6).alias("score"))


@query
def j19_art_faces(spark, d):
    found = piles.land_faces(inputs.lands(spark, d), inputs.dice(spark, d), inputs.CANVAS).filter("over_art")
    return found.select("scan_id", "ord", "face_ord", "value", F.round("center_x", 6).alias("center_x"), F.round("score", 6).alias("score"))


@query
def st13_pile_counts(spark, d):
    return piles.pile_counts(inputs.lands(spark, d), inputs.dice(spark, d), canvas=inputs.CANVAS).select("scan_id", "ord", "name", "count", "count_source", F.round("rank_score", 6).alias("rank_score"), "note")


@query
def st5_settled_piles(spark, d):
    return piles.settle(piles.pile_counts(inputs.lands(spark, d), inputs.dice(spark, d), canvas=inputs.CANVAS))


@query
def m4_smoothed(spark, d):
    p = inputs.pixels(spark, d).selectExpr("image_id AS case_id", "i", "CAST(r AS DOUBLE) AS v")
    return piles.smoothed(p).select("case_id", "i", F.round("s", 6).alias("s"))


@query
def w6_fan_counts(spark, d):
    p = inputs.pixels(spark, d).selectExpr("image_id AS case_id", "i", "CAST(CASE WHEN i % 20 = image_id % 20 THEN 100 ELSE r % 5 END AS DOUBLE) AS v")
    return piles.fan_counts(p, F.lit(8))


# Pixels


@query
def a11_histogram(spark, d):
    return pixels.histogram(pixels.with_luma(inputs.pixels(spark, d)))


@query
def m7_contrast_bounds(spark, d):
    return pixels.contrast_bounds(pixels.histogram(pixels.with_luma(inputs.pixels(spark, d))))


@query
def i1_stretched(spark, d):
    p = pixels.with_luma(inputs.pixels(spark, d))
    bounds = pixels.contrast_bounds(pixels.histogram(p))
    return p.join(bounds, "image_id").select("image_id", "i", pixels.stretched(F.col("luma"), F.col("low"), F.col("high")).cast("long").alias("value"))


@query
def p11_die_pixels(spark, d):
    return inputs.pixels(spark, d).select("image_id", "i", g.is_die_pixel(F.col("r"), F.col("g"), F.col("b")).alias("die"))


@query
def a12_edge_profile(spark, d):
    gray = pixels.with_luma(inputs.pixels(spark, d)).select("image_id", "x", "y", F.col("luma").cast("double").alias("gray"))
    return pixels.edge_profile(gray).select("image_id", "x", F.round("v", 6).alias("v"))


@query
def i4_pips(spark, d):
    p = inputs.pixels(spark, d)
    masks = p.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", (F.col("r") < 110).cast("int").alias("bit")))), lambda x: x["bit"]).alias("bits"))
    return masks.select("image_id", pixels.pips_udf(F.lit(20), "bits").alias("pips"))


@query
def s6_image_types(spark, d):
    magic = "CASE p_partkey % 6 WHEN 0 THEN 'FFD8FFE0' WHEN 1 THEN '89504E470D0A' WHEN 2 THEN '47494638' WHEN 3 THEN '524946460000000057454250' WHEN 4 THEN '00' ELSE '' END"
    files = inputs.table(spark, d, "part").selectExpr("p_partkey", f"unhex({magic}) AS content", "CASE WHEN p_partkey % 12 = 4 THEN 'image/tiff' ELSE '' END AS declared")
    return pixels.image_types(files).select("p_partkey", "mime")


# Labels


@query
def j22_verdicts(spark, d):
    return labels.with_verdicts(inputs.detections(spark, d), inputs.annotations(spark, d)).select("scan_id", "ord", "verdict", "corrected_text")


@query
def a7_verdict_counts(spark, d):
    return labels.verdict_counts(labels.with_verdicts(inputs.detections(spark, d), inputs.annotations(spark, d)))


@query
def a8_report(spark, d):
    return labels.report_rows(labels.with_verdicts(inputs.detections(spark, d), inputs.annotations(spark, d)))


@query
def d6_stored_labels(spark, d):
    rows = labels.stored_rows(labels.with_verdicts(inputs.detections(spark, d), inputs.annotations(spark, d)), W, H)
    return rows.select("scan_id", "ord", F.round("box.x", 6).alias("x"), F.round("box.height", 6).alias("h"), "verdict", F.trim("corrected_text").alias("corrected"))


@query
def j21_reattach(spark, d):
    rows = inputs.detections(spark, d)
    saved = rows.filter("pk % 3 = 0").selectExpr("scan_id", "ord AS saved_ord", "x + 2 AS x", "y + 1 AS y", "width", "height")
    return labels.reattach(saved, rows).select("scan_id", "saved_ord", "ord", F.round("overlap", 6).alias("overlap"))


@query
def k5_report_text(spark, d):
    rows = labels.with_verdicts(inputs.detections(spark, d), inputs.annotations(spark, d))
    scans = inputs.table(spark, d, "orders").selectExpr("o_orderkey AS scan_id", "concat('scan', o_orderkey, '.jpg') AS filename", "900.4 AS width", "700.5 AS height")
    added = inputs.detections(spark, d).filter("pk % 17 = 0").selectExpr("scan_id", "ord", "CASE WHEN pk % 34 = 0 THEN ' ' ELSE concat(' ', detected_text) END AS text", "x", "y", "width", "height")
    return labels.report_text(rows, scans, added)


@query
def a9_restored(spark, d):
    rows = inputs.detections(spark, d)
    saved = rows.filter("pk % 3 = 0").selectExpr("scan_id", "ord AS saved_ord", "x + 2 AS x", "y + 1 AS y", "width", "height")
    return labels.restored_counts(labels.reattach(saved, rows), rows.filter("pk % 17 = 0"))


# Sources


@query
def s4_catalog_cache(spark, d):
    folder = scratch_dir(spark)
    names.write_cache(inputs.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct(), folder)
    return ocr.numbered(names.read_cache(spark, folder)).select(F.col("card_ord").cast("long").alias("card_ord"), "name")


@query
def s14_first_images(spark, d):
    declared = "CASE l_partkey % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'image/jpeg' END AS declared"
    return pixels.first_images(inputs.table(spark, d, "lineitem").selectExpr("l_orderkey AS upload_id", "CAST(l_linenumber * 1000000 + l_partkey AS BIGINT) AS ord", declared))


@query
def t9_largest_crops(spark, d):
    p = inputs.pixels(spark, d)
    die = g.is_die_pixel(F.col("r"), F.col("g"), F.col("b"))
    masks = p.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", die.cast("int").alias("bit")))), lambda x: x["bit"]).alias("bits"))
    # The role table's images are 20 pixels wide: dice of 3 by 3 and more.
    return pixels.largest_crops(masks.select("image_id", F.lit(20).alias("width"), "bits"), pixels.CropLimits(least_pixels=6, least_side=3, margin=1))


# From regions to lists


@query
def scan_decklist(spark, d):
    return scan.scan(inputs.seen_names(spark, d), inputs.index(spark, d), inputs.CANVAS).lines.select("scan_id", "name", "count", "is_land")


@query
def scan_outcomes(spark, d):
    return scan.scan(inputs.seen_names(spark, d), inputs.index(spark, d), inputs.CANVAS).outcomes()


@query
def scan_traces(spark, d):
    expected = inputs.detections(spark, d).filter("ord <= 2 and name is not null").selectExpr("scan_id", "name AS expected")
    return scan.scan(inputs.seen_names(spark, d), inputs.index(spark, d), inputs.CANVAS).traced(expected)
