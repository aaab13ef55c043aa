"""Piles on a canvas, joined digits, and lands whose dice can't be judged; titles in bands; null confidence."""

import pytest
from pyspark.sql import functions as F

from gleanset.functions import geometry as g
from gleanset.operators import bands, piles, titles
from gleanset.operators.folds import fold_groups

LAND = "scan_id long, ord long, name string, confidence double, x double, y double, width double, height double"
DIE = "scan_id long, ord long, text string, confidence double, x double, y double, width double, height double"


def clip(x, y, w, h, canvas=(900, 700)):
    on = lambda v, low, high: max(low, min(high, int((v + 0.5) // 1)))
    left, top = on(x, 0, canvas[0]), on(y, 0, canvas[1])
    return left, top, on(x + w, left, canvas[0]) - left, on(y + h, top, canvas[1]) - top


def body_of(x, y, w, h):
    tall = max(h / 0.055, w * 1.8, 80)
    wide = max(w / 0.55, tall / (88 / 63))
    return x - wide * 0.12, y - tall * 0.03, wide, tall


def art_of(body, title):
    y = max(body[1], title[1] + title[3])
    return body[0], y, body[2], max(24, body[1] + body[3] - y) * 0.92


@pytest.mark.parametrize("sizes", ["pair", "table", "none"])
def test_lands_at_the_edges(spark, sizes):
    """Lands at the left, right and bottom edge: bodies and art are clipped, and with them the centre that dice are near to."""
    found = [(1, 0, "Island", 0.9, 5.0, 100.0, 80.0, 12.0), (1, 1, "Island", 0.9, 840.0, 300.0, 80.0, 12.0), (1, 2, "Island", 0.9, 300.3, 640.2, 81.0, 11.0)]
    lands = spark.createDataFrame(found, LAND)
    canvas = {"pair": (900.0, 700.0), "table": spark.createDataFrame([(1, 900, 700)], "scan_id long, width int, height int"), "none": None}[sizes]
    got = {r.ord: r for r in piles.on_canvas(lands, canvas).collect()}
    for row in found:
        title = row[4:]
        body = body_of(*title) if sizes == "none" else clip(*body_of(*title))
        art = art_of(body, title)
        shown = art if sizes == "none" else clip(*art)
        for name, want in (("body", body), ("art", art), ("art_shown", shown)):
            assert tuple(got[row[1]][name]) == pytest.approx(want)
    dice = spark.createDataFrame([(1, 10, "8", 0.9, 870.0, 400.0, 20.0, 20.0)], DIE)
    face = piles.land_faces(lands, dice, canvas).collect()
    art = got[1].art_shown
    want = 1 / (1 + ((880 - art.x - art.width / 2) ** 2 + (410 - art.y - art.height / 2) ** 2) ** 0.5 / 40)
    assert [(f.ord, f.kind) for f in face] == [(1, "near")] and face[0].score == pytest.approx(want)


def test_a_joined_pair_is_as_near_as_its_box(spark):
    """1 and 2 make 12: the pair's box counts, not the left digit's."""
    lands = spark.createDataFrame([(1, 0, "Island", 0.9, 100.0, 100.0, 80.0, 12.0)], LAND)
    regions = [(1, 5, "1", 0.9, 140.0, 200.0, 30.0, 30.0), (1, 6, "2", 0.9, 172.0, 200.0, 30.0, 30.0)]
    faces = piles.joined_digits(piles.land_faces(lands, spark.createDataFrame(regions, DIE)))
    row = faces.select("value", "x", "width", g.die_center_score(g.rect(), F.col("center_x"), F.col("center_y")).alias("score"), "center_x", "center_y").collect()
    assert [(r.value, r.x, r.width) for r in row] == [(12, 140.0, 62.0)]
    assert row[0].score == pytest.approx(1 / (1 + ((171 - row[0].center_x) ** 2 + (215 - row[0].center_y) ** 2) ** 0.5 / 40))
    assert "score" not in faces.columns


FACE = "scan_id long, ord long, kind string, face_ord long, value int, area double, confidence double, x double, y double, width double, height double, center_x double, center_y double"


@pytest.mark.parametrize("found,want", [
    ([(7, 40.0, 0.99, None), (15, 220.0, 0.9, None), (9, 55.0, 0.95, None)], 15),
    ([(7, 90.0, 0.96, (80.0, 40.0, 14.0, 16.0)), (12, 120.0, 0.82, (36.0, 28.0, 22.0, 18.0))], 12),
    ([(1, 100.0, None, (0.0, 0.0, 8.0, 10.0)), (3, 100.0, 0.5, (200.0, 0.0, 8.0, 10.0))], 1),
])
def test_best_face(spark, found, want):
    rows = [(1, 1, "near", i, v, a, c, *(box or (None,) * 4), 42.0, 32.0) for i, (v, a, c, box) in enumerate(found)]
    assert [r.die for r in piles.best_face(piles.joined_digits(spark.createDataFrame(rows, FACE))).collect()] == [want]


def test_one_bad_land_counts_as_one(spark):
    """A land whose dice can't be compared has the default count; the others of its scan and task are counted."""
    lands = spark.createDataFrame([(1, i, "Island", 0.9, 100.0, 50.0 + 30 * i, 80.0, 12.0) for i in range(4)] + [(2, 0, "Swamp", 0.8, 100.0, 100.0, 80.0, 12.0)], LAND)
    regions = spark.createDataFrame([(1, 9, "5", 0.9, 120.0, 150.0, 20.0, 20.0), (2, 9, "7", 0.9, 120.0, 180.0, 20.0, 20.0), (2, 10, "20", 0.9, 140.0, 190.0, 20.0, 20.0)], DIE)
    compared, picked = piles._compared, piles._picked

    def poisoned(rows):
        if rows[0]["scan_id"] == 1 and rows[0]["ord"] == 2:
            raise ValueError("bad land")
        return picked(rows)

    try:
        piles._picked = poisoned
        got = {(r.scan_id, r.ord): (r["count"], r.count_source, r.note, r.siblings) for r in piles.pile_counts(lands, regions).collect()}
    finally:
        piles._picked = picked
    assert piles._compared is compared
    assert got[1, 2] == (1, "ocr", "count failed", [])
    assert {got[1, i][:3] for i in (0, 1, 3)} == {(5, "dice", "raw OCR 5")} and got[2, 0][1] == "dice"


def test_a_group_that_raises(spark):
    rows = spark.createDataFrame([(k, v) for k in range(6) for v in (1, 2, 0 if k == 3 else 4)], "k long, v long")
    schema = "k long, v double, why string"
    fold = lambda group: [(group[0]["k"], sum(1 / r["v"] for r in group), None)]
    got = fold_groups(rows, ["k"], ["v"], schema, fold, lambda group, e: [(group[0]["k"], None, type(e).__name__)]).collect()
    assert sorted((r.k, r.v, r.why) for r in got if r.k != 3) == [(k, 1.75, None) for k in (0, 1, 2, 4, 5)]
    assert [tuple(r) for r in got if r.k == 3] == [(3, None, "ZeroDivisionError")]
    with pytest.raises(Exception, match="division by zero"):
        fold_groups(rows, ["k"], ["v"], schema, fold).collect()


def regions_of(spark, rows):
    return spark.createDataFrame([(1, i, text, 0.9, float(x), float(y), float(w), float(h)) for i, (text, x, y, w, h) in enumerate(rows)], titles.REGION)


def test_a_title_of_two_fragments_in_a_band(spark):
    """Alone each is too short to be a title, or its word is; together they are one, so the band needs no other reading."""
    places = spark.createDataFrame([(1, "weak-title", 1.0, (90.0, 30.0, 200.0, 40.0)), (1, "weak-title", 2.0, (90.0, 300.0, 200.0, 40.0)), (2, "weak-title", 1.0, (90.0, 30.0, 200.0, 40.0))], "scan_id long, reason string, priority double, rect struct<x:double,y:double,width:double,height:double>")
    two = regions_of(spark, [("Wear x", 100, 40, 70, 20), ("Tear Down", 176, 41, 68, 19), ("Draw a card.", 100, 310, 100, 20)])
    left = {(r.scan_id, r.rect.y) for r in bands.without_strong_title(places, two).collect()}
    assert left == {(1, 300.0), (2, 30.0)}
    # Two titles on one line that together have too many words are no title any more.
    wide = regions_of(spark, [("Some Long Title Here", 100, 40, 90, 20), ("Another Long Title Here", 192, 40, 95, 20)])
    alone = titles.title_filter_reason(F.col("text"), g.rect()).isNull()
    assert wide.filter(alone).count() == 2
    assert {(r.scan_id, r.rect.y) for r in bands.without_strong_title(places, wide).collect()} == {(1, 30.0), (1, 300.0), (2, 30.0)}


def test_merge_regions_without_confidence(spark):
    base = spark.createDataFrame([(1, 0, "Steam Vents", None, 0.0, 0.0, 100.0, 20.0), (1, 1, "Frost Lynx", 0.5, 0.0, 100.0, 100.0, 20.0), (1, 2, "No box", 0.5, None, None, None, None)], titles.REGION)
    added = spark.createDataFrame([(1, 10, "Steam Vent", 0.1, 2.0, 0.0, 100.0, 20.0), (1, 11, "Frost Lynk", None, 0.0, 100.0, 100.0, 20.0), (1, 12, "Box less", None, None, None, None, None)], titles.REGION)
    got = bands.merge_regions(base, added).orderBy("ord").collect()
    assert [(r.ord, r.text, r.confidence) for r in got] == [(0, "Steam Vent", 0.1), (1, "Frost Lynx", 0.5), (2, "No box", 0.5), (12, "Box less", None)]
