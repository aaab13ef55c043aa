"""What keeps the cost of a query in proportion to its input."""

import time

from pyspark.sql import functions as F

from gleanset.functions import text as t
from gleanset.operators import labels, piles, spatial, titles


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


BOX = "scan_id long, ord long, x double, y double, width double, height double"


def test_reattach_folds_scans_without_a_frame_each(spark):
    rows = spark.createDataFrame([(s, o, 100.0 * o, 0.0, 50.0, 10.0) for s in range(3) for o in range(3)] + [(9, 0, None, 0.0, 5.0, 5.0)], BOX)
    saved = rows.selectExpr("scan_id", "2 - ord AS saved_ord", "x + 1 AS x", "y", "width", "height")
    found = labels.reattach(saved, rows)
    assert {(r.scan_id, r.saved_ord, r.ord) for r in found.collect()} == {(s, 2 - o, o) for s in range(3) for o in range(3)}
    assert "InPandas" not in plan(found)
    assert {(r.scan_id, r.restored) for r in labels.restored_counts(found).collect()} == {(s, 3) for s in range(3)}


def test_settle_folds_scans_without_a_frame_each(spark):
    rows = [(1, 1, 2, "ocr", [2], 104.0), (1, 2, 3, "dice", [1], 406.0), (1, 3, 1, "ocr", [], 102.0), (2, 1, 2, "ocr", [2], 104.0), (2, 2, 2, "ocr", [1], 104.0)]
    found = piles.settle(spark.createDataFrame(rows, "scan_id long, ord long, count int, count_source string, siblings array<long>, rank_score double"))
    assert {tuple(r) for r in found.collect()} == {(1, 1, 0, "ocr"), (1, 2, 3, "dice"), (1, 3, 1, "ocr"), (2, 1, 2, "ocr"), (2, 2, 0, "ocr")}
    assert "InPandas" not in plan(found)


def test_long_texts_are_judged_in_proportion_to_their_words(spark):
    rows = spark.createDataFrame([("steam vENts of brght " * 5000,)], "text string")
    began = time.time()
    ratio, garbled = rows.select(t.garbled_word_ratio(F.col("text")), titles.garbled_title(F.col("text"))).first()
    assert (ratio, garbled) == (0.5, True) and time.time() - began < 20


def test_type_words_are_judged_once_each(spark):
    rows = spark.createDataFrame([("Legendary creatures, Gobln",), ("of the",), (None,), ("elv elk elks",)], "text string")
    found = rows.select(t.type_line_hits(F.col("text")).alias("n"))
    assert [r.n for r in found.collect()] == [3, 0, None, 2] and "ArrowEvalPython" in plan(found)


def test_few_boxes_meet_in_one_cell(spark):
    # Seven boxes a scan, and one scan of forty: both ways give all pairs that touch.
    rows = [(s, o, 7.0 * o, 5.0 * (o % 3), 3.0 + 11 * (o % 4), 6.0) for s, n in ((1, 7), (2, 7), (3, 40)) for o in range(n)]
    df = spark.createDataFrame(rows, BOX)
    met = spatial.pairs(df, df, spatial.boxes(), spatial.boxes(), F.col("x.ord") < F.col("y.ord"))
    touch = lambda a, b: all(a[k] <= b[k] + b[k + 2] and b[k] <= a[k] + a[k + 2] for k in (2, 3))
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and touch(a, b)}
    found = met.select("x.scan_id", F.col("x.ord").alias("a"), F.col("y.ord").alias("b"), F.col("x._key.level").alias("level")).collect()
    assert sorted((r.scan_id, r.a, r.b) for r in found) == sorted(want)
    assert {r.level < 0 for r in found if r.scan_id < 3} == {True} and {r.level < 0 for r in found if r.scan_id == 3} == {False}


def test_dice_and_lands_are_placed_once(spark):
    lands = spark.createDataFrame([(1, o, "Island", 0.9, 100.0 * o, 50.0, 60.0, 12.0) for o in range(4)], "scan_id long, ord long, name string, confidence double, x double, y double, width double, height double")
    dice = lands.selectExpr("scan_id", "ord", "string(ord + 3) AS text", "confidence", "x + 20 AS x", "y + 40 AS y", "8.0D AS width", "9.0D AS height")
    found = piles.land_faces(lands, dice, (900.0, 700.0))
    assert {(r.ord, r.face_ord, r.value) for r in found.collect()} >= {(o, o, o + 3) for o in range(4)}
    # Before, each side was made twice, with all that derives a box and reads a die written out again in a filter.
    optimized = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in optimized and "regexp" not in optimized.lower() and "0.055" not in optimized
    assert {(r.ord, r["count"]) for r in piles.pile_counts(lands, dice, canvas=(900.0, 700.0)).collect()} == {(o, o + 3) for o in range(4)}


def test_a_die_is_read_by_one_search(spark):
    texts = ["", "0", "00", "1", "07", "9.", "10", "19;", "24", "25", "99", "100", " 1l ", "O8", "Zo", "x", "2 4", None, "-1", "3..", "12\n"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", t.parse_die_value(F.col("text")).alias("value"))
    assert [r.value for r in rows.collect()] == [None, None, None, 1, 7, 9, 10, 19, 24, None, None, None, 11, 8, 20, None, None, None, None, None, 12]
    assert plan(rows).count("regexp_extract") == 1
