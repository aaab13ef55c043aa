"""Text, geometry and similarity functions on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from gleanset.functions import geometry as g
from gleanset.functions import similarity as s
from gleanset.functions import text as t
from gleanset.operators import bands, catalog, deck, labels, match, pixels, piles, suppress, titles, trace


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_normalize(spark):
    assert column(spark, ["Jötun's  Gruñt", "Æther ﬁre ½", "  ", None], t.normalize_name) == ["jotuns grunt", "ther fire 1 2", "", None]


def test_die_values(spark):
    assert column(spark, ["8", "15", "269", "4/4", "S", "l2", "Bog", "", None], t.parse_die_value) == [8, 15, None, None, 5, 12, None, None, None]


def test_clean_query(spark):
    assert column(spark, ["a gobtin king x", "swons to per"], t.clean_query) == ["goblin king", "swords to per"]


def test_garbled_ratio(spark):
    assert column(spark, ["", "xx yy the", "Abc strngth abc"], t.garbled_word_ratio) == [1.0, pytest.approx(2 / 3), pytest.approx(1 / 3)]


def test_titles(spark):
    reasons = column(spark, ["Draw a card.", "Creature - Elf", "Add one mana", "Steam Vents", "a+b", "{T}: x", "This land is new", ""], titles.body_text_reason)
    assert reasons == ["sentence punctuation", "looks like a type line (dash)", "mana ability", None, "contains a rules symbol", "leading punctuation", "rules phrase", "empty"]


def region_table(spark, rows):
    return spark.createDataFrame([(1, i, r[0], 0.9, *map(float, r[1:])) for i, r in enumerate(rows)], titles.REGION)


def test_fragments_of_a_line_are_joined(spark):
    joined = titles.merge_line_fragments(region_table(spark, [("Steam", 100, 40, 70, 20), ("Vents", 176, 41, 68, 19), ("Island", 100, 90, 70, 20)])).orderBy("ord").collect()
    assert [(r.text, r.x, r.width) for r in joined] == [("Steam Vents", 100.0, 144.0), ("Island", 100.0, 70.0)]


def test_lcs_and_edits():
    random.seed(5)
    for _ in range(300):
        a, b = ("".join(random.choice("abcd") for _ in range(random.randint(0, 9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, c in enumerate(a, 1):
            for j, d in enumerate(b, 1):
                table[i][j] = table[i - 1][j - 1] + 1 if c == d else max(table[i - 1][j], table[i][j - 1])
        assert s.lcs(a, b) == table[-1][-1]
    assert s.edits("kitten", "sitting") == 3


def test_ordered_lcs(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", "a"), ("abc", "abc")], "a string, b string")
    assert [r[0] for r in df.select(s.ordered_lcs(F.col("a"), F.col("b"))).collect()] == [4, 0, 3]


NAMES = ["Lightning Bolt", "Scorching Dragonfire", "Frost Lynx", "Frost Titan", "Grotag Bug-Catcher", "Wear // Tear", "Emeritus of Conflict // Lightning Bolt", "Sacred Foundry", "Treasure", "Mountain"]


def test_matching(spark):
    index = catalog.build_index(spark.createDataFrame(list(enumerate(NAMES)), "card_ord long, name string"))
    cases = [(1, "Scorchlng Dragonflre", 0.91, False), (2, "Frost Lyny", 0.8, False), (3, "Wear", 0.95, False), (4, "Grotag", 0.9, False), (5, "Sacred Foi", 0.96, True), (6, "TUEASURI", 0.7, False), (7, "Lightning Bolt", 1.0, False), (8, "", 0.5, False), (9, None, 0.5, False)]
    found = {}
    for r in match.ranked(spark.createDataFrame(cases, "query_id long, text string, confidence double, prefer_lands boolean"), index).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.name, r.score))
    assert found[1][0][0] == "Scorching Dragonfire" and found[1][0][1] > 0.7
    assert [n for n, _ in found[2]][:2] == ["Frost Lynx", "Frost Titan"]
    assert found[3][0][0] == "Wear // Tear" and found[4][0][0] == "Grotag Bug-Catcher" and found[5][0][0] == "Sacred Foundry" and found[7][0][0] == "Lightning Bolt"
    assert not {6, 8, 9} & found.keys()


def detections(spark, rows):
    schema = "scan_id long, ord long, name string, detected_text string, confidence double, status string, count int, count_source string, x double, y double, width double, height double"
    return spark.createDataFrame([(1, i, r[0], r[0] or r[1], r[2], "confirmed" if r[0] else "unknown", r[3], None, *map(float, r[4:])) for i, r in enumerate(rows)], schema)


def test_smaller_reread_goes(spark):
    rows = detections(spark, [("Mox", "", 0.7, None, 283, 536, 67, 33), ("Mox", "", 0.9, None, 284, 669, 63, 13), ("Mox", "", 0.8, None, 283, 300, 67, 32)])
    assert sorted(r.ord for r in suppress.drop_smaller_rereads(rows).collect()) == [0, 2]
    assert sorted(r.ord for r in suppress.greedy_nms(detections(spark, [("A", "", 0.5, None, 0, 0, 10, 10), ("B", "", 0.9, None, 1, 1, 10, 10), ("C", "", 0.4, None, 50, 0, 10, 10)])).filter("kept").collect()) == [1, 2]


def test_decklist(spark):
    rows = detections(spark, [("Mountain", "", 0.9, 8, 0, 0, 9, 9), ("Lightning Bolt", "", 0.9, None, 0, 0, 9, 9), ("Island", "", 0.9, 0, 0, 0, 9, 9), (None, "smudge", 0.3, None, 0, 0, 9, 9)])
    assert deck.as_text(rows).first().decklist == "1 Lightning Bolt\n8 Mountain\n1 smudge"
    t1 = deck.totals(rows).first()
    assert (t1.total, t1.n_names, t1.n_unresolved) == (9, 2, 1)


def test_piles(spark):
    profile = [(1, i, 100.0 if i % 20 == 0 and 20 <= i <= 120 else 1.0) for i in range(200)] + [(2, i, 100.0 if i in (20, 120) else 1.0) for i in range(200)] + [(3, i, 1.0) for i in range(4)]
    df = spark.createDataFrame(profile, "case_id long, i int, v double")
    assert {r.case_id: r.fan for r in piles.fan_counts(df, F.lit(8)).collect()} == {1: 6, 2: 1, 3: 1}
    faces = spark.createDataFrame([(1, 1, i, v, 80.0, 0.9, 0.5, x, 10.0, 8.0, 10.0) for i, (v, x) in enumerate([(1, 10.0), (2, 20.0), (3, 30.0)])], "scan_id long, ord long, face_ord long, value int, area double, confidence double, score double, x double, y double, width double, height double")
    assert sorted(r.value for r in piles.joined_digits(faces).collect()) == [3, 12]


def test_pips():
    import numpy as np

    mask = np.zeros((20, 20), bool)
    for y, x in ((1, 1), (1, 12), (12, 1), (12, 12)):
        mask[y : y + 5, x : x + 5] = True
    assert pixels.count_pips(mask) == 4
    flat = np.full((4, 4), 9, np.uint8)
    assert (pixels.sharpen(flat) == flat).all()


def test_clip_and_iou(spark):
    row = spark.range(1).select(*g.clip(g.Rect(*map(F.lit, (0.5, 0.5, 767.5, 1023.5))), F.lit(768), F.lit(1024))).first()
    assert tuple(row) == (1, 1, 767, 1023)
    iou = spark.range(1).select(g.iou(g.Rect(*map(F.lit, (0.0, 0.0, 10.0, 10.0))), g.Rect(*map(F.lit, (5.0, 5.0, 10.0, 10.0))))).first()[0]
    assert iou == pytest.approx(25 / 175)


def test_labels(spark):
    rows = detections(spark, [("A", "", 0.9, None, 0, 0, 50, 20), ("B", "", 0.9, None, 100, 0, 50, 20)])
    saved = spark.createDataFrame([(1, 0, 1.0, 1.0, 50.0, 20.0), (1, 1, 101.0, 1.0, 50.0, 20.0), (1, 2, 0.0, 0.0, 50.0, 20.0), (1, 3, 500.0, 0.0, 9.0, 9.0)], "scan_id long, saved_ord long, x double, y double, width double, height double")
    assert {(r.saved_ord, r.ord) for r in labels.reattach(saved, rows).collect()} == {(0, 0), (1, 1)}
    store = spark.createDataFrame([('{"version":1,"filename":"a","detections":[],"added":[{"text":"x"}]}',), ('{"version":2,"filename":"b"}',), ("junk",)], "json string")
    assert [r.filename for r in labels.meaningful(labels.read_store(store)).collect()] == ["a"]


def test_trace(spark):
    one = lambda rows: spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "scan_id long, ord long, text string, name string")
    expected = spark.createDataFrame([(1, n) for n in ("Bolt", "Lynx", "Titan", "Vents", "Ghost")], "scan_id long, expected string")
    got = trace.trace(expected, one([("bolt", "Bolt"), ("Lynx", "Frost Lynx")]), one([("titan x", None)]), one([("steam vents", None)]), one([("zz", None)]), one([("qq", None)]))
    assert {r.expected: r.reason for r in got.collect()} == {"Bolt": "matched", "Lynx": "ocr-wrong-match", "Titan": "suppressed", "Vents": "ocr-unmatched", "Ghost": "not-detected"}


def test_merge_regions(spark):
    base = region_table(spark, [("Steam Vents", 0, 0, 100, 20), ("x", 0, 100, 100, 20)])
    added = spark.createDataFrame([(1, 10, "Steam Vent", 0.95, 2.0, 0.0, 100.0, 20.0), (1, 11, "x", 0.99, 0.0, 100.0, 100.0, 20.0), (1, 12, "New", 0.5, 300.0, 0.0, 90.0, 20.0)], titles.REGION)
    got = bands.merge_regions(base, added).orderBy("ord").collect()
    assert [(r.ord, r.text) for r in got] == [(0, "Steam Vent"), (1, "x"), (12, "New")]


def test_merge_regions_in_order(spark):
    """A copy of one of two overlapping regions goes; a region that overlaps two takes the first one's place only."""
    base = region_table(spark, [("Steam Vents", 0, 0, 100, 20), ("Sleam Vnts", 4, 0, 100, 20)])
    one = lambda text, confidence: spark.createDataFrame([(1, 10, text, confidence, 2.0, 0.0, 100.0, 20.0)], titles.REGION)
    texts = lambda added: [r.text for r in bands.merge_regions(base, added).orderBy("ord").collect()]
    assert texts(one("Steam Vents", 0.99)) == ["Steam Vents", "Sleam Vnts"]
    assert texts(one("Frost Lynx", 0.99)) == ["Frost Lynx", "Sleam Vnts"]


def test_art_die_only_without_another(spark):
    """A large die over the art counts for a land that has no die within the limits."""
    land = "scan_id long, ord long, name string, confidence double, x double, y double, width double, height double"
    lands = spark.createDataFrame([(1, 1, "Island", 0.9, 100.0, 100.0, 80.0, 12.0)], land)
    die = lambda x, y, w, h, text="8": spark.createDataFrame([(1, 5, text, 0.9, x, y, w, h)], "scan_id long, ord long, text string, confidence double, x double, y double, width double, height double")
    count = lambda regions: piles.pile_counts(lands, regions).collect()[0]
    assert (count(die(90.0, 105.0, 150.0, 130.0)).count_source, count(die(90.0, 105.0, 150.0, 130.0))["count"]) == ("dice", 8)
    assert count(die(900.0, 900.0, 20.0, 20.0)).count_source == "ocr"


def test_pips_of_whole_images(spark, small):
    import numpy as np

    from gleanset.plans import inputs
    from gleanset.plans.queries import QUERIES

    bits = {}
    for r in inputs.pixels(spark, small).select("image_id", "i", "r").orderBy("i").collect():
        bits.setdefault(r.image_id, []).append(r.r < 110)
    want = {k: pixels.count_pips(np.array(b + [False] * (-len(b) % 20)).reshape(-1, 20)) for k, b in bits.items()}
    assert {r.image_id: r.pips for r in QUERIES["i4_pips"](spark, small).collect()} == want
