"""Work that is shared or kept narrow, so that figures grow no faster than the input."""

import os

from pyspark.sql import functions as F

from gleanset.functions import geometry as g
from gleanset.functions import text as t
from gleanset.operators import bands, catalog, match, piles, suppress, titles, trace
from gleanset.sources import ocr, tables


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_queries_read_alike_are_ranked_once(spark):
    names = spark.createDataFrame([(i, n) for i, n in enumerate(("Island", "Lightning Bolt", "Lightning Helix", "Steam Vents"))], "card_ord long, name string")
    rows = [(i, ("Lightn1ng Bolt", "Island", "Steam Vents", "")[i % 4], (0.9, None)[i // 4 % 2], (True, False, None)[i % 3]) for i in range(48)]
    queries = spark.createDataFrame(rows, "query_id long, text string, confidence double, prefer_lands boolean")
    index = catalog.build_index(names)
    for found in (match.ranked(queries, index), match.search(queries, index)):
        # What is ranked are readings, not queries: no window and no sort is over the queries' ids.
        assert "Window" not in plan(found)
        by_id = {}
        for r in found.collect():
            by_id.setdefault(r.query_id, set()).add((r["rank"], r.name, r.score))
        assert set(by_id) == {i for i in range(48) if i % 4 < 3}
        for i in by_id:
            assert by_id[i] == by_id[i % 24] and min(by_id[i])[1] == ("Lightning Bolt", "Island", "Steam Vents")[i % 4]


def test_bands_are_judged_on_written_tables(spark):
    rows = [(1, 1, "Lightning", 0.9, 10.0, 100.0, 90.0, 16.0), (1, 2, "Helix", 0.9, 106.0, 100.0, 60.0, 16.0), (1, 3, "draw a card.", 0.9, 10.0, 300.0, 90.0, 16.0)]
    regions = spark.createDataFrame(rows, "scan_id long, ord long, text string, confidence double, x double, y double, width double, height double")
    places = [(1, "weak-title", 1.0, (0.0, 90.0, 180.0, 40.0)), (1, "land-row", 1.0, (0.0, 90.0, 180.0, 40.0)), (1, "land-row", 2.0, (0.0, 290.0, 180.0, 40.0)), (2, "land-row", 3.0, (0.0, 90.0, 180.0, 40.0))]
    planned = spark.createDataFrame(places, f"scan_id long, reason string, priority double, rect struct<{', '.join(f'{c}: double' for c in ('x', 'y', 'width', 'height'))}>")
    left = bands.without_strong_title(planned, regions)
    # The regions' rules, written out again at each use, made a plan over all bands that never came to run.
    assert plan(left).count("Relation [") + plan(left).count("LogicalRDD") <= 2 and "rlike" not in plan(left).lower()
    assert sorted((r.scan_id, r.priority) for r in left.collect()) == [(1, 2.0), (2, 3.0)]


def test_texts_of_detections_are_judged_once(spark):
    rows = [
        (1, 1, "Steam Vents", "Steam Vents", 0.9, "confirmed", 100.0, 10.0, 90.0, 16.0), (1, 2, None, "draw a card.", 0.9, "unknown", 100.0, 80.0, 90.0, 16.0),
        (1, 3, None, "draw a card.", 0.9, "unknown", 400.0, 300.0, 90.0, 16.0), (1, 4, "Food", "Food", 0.9, "confirmed", 600.0, 10.0, 90.0, 16.0),
    ]
    df = spark.createDataFrame(rows, "scan_id long, ord long, name string, detected_text string, confidence double, status string, x double, y double, width double, height double")
    steps = {"token": suppress.drop_tokens, "body text": lambda r: suppress.drop_body_text(r, F.lit(476.0)), "weak unknown": lambda r: suppress.drop_weak_unknowns(r, F.lit(476.0))}
    want = {"token": [1, 2, 3], "body text": [1, 4], "weak unknown": [1, 4]}
    for name, step in steps.items():
        found = step(df)
        assert found.columns == df.columns and sorted(r.ord for r in found.collect()) == want[name], name
        # The rules over texts are in a table of distinct texts, not in the plan over detections.
        assert "rlike" not in plan(found).lower() and "regexp_replace" not in plan(found).lower(), name


def test_title_rules_of_repeated_texts(spark):
    texts = ["Steam Vents", "draw a card.", "", None, "Legendary Creature", "x", "A. Brazen Borrower", "sTeAm vENts of tHe"]
    rows = [(i, i, texts[i % 8], 0.5, 1.5 * i, 2.0, (90.0, 17.0, 700.0)[i % 3], (16.0, 7.0, 150.0, 8.5)[i // 3 % 4]) for i in range(96)]
    regions = spark.createDataFrame(rows, "scan_id long, ord long, text string, confidence double, x double, y double, width double, height double")
    found = titles.with_title_reason(regions, "shared").withColumn("own", titles.title_filter_reason(F.col("text"), g.rect()))
    got = [(r.ord, r.shared, r.own) for r in found.collect()]
    assert len(got) == 96 and all(a == b for _, a, b in got) and len({a for _, a, _ in got}) > 6
    merged = bands.merge_regions(regions, regions.withColumn("ord", F.col("ord") + 1000))
    # Before, the rules over texts stood in the plan of each region.
    assert "battlefield" not in plan(merged) and merged.count() == 96


def test_title_rules_name_each_part_once(spark):
    rows = [(1, 1, "Steam Vents", 0.9, 10.0, 20.0, 90.0, 40.0), (1, 2, "Steam Vents", 0.9, 10.0, 90.0, 30.0, 80.0), (1, 3, "word " * 20, 0.9, 10.0, 300.0, 90.0, 40.0)]
    regions = spark.createDataFrame(rows, "scan_id long, ord long, text string, confidence double, x double, y double, width double, height double")
    # Before, the angle of a box stood 20 times and more in the rules, with all its edges each time.
    assert plan(regions.select(titles.title_filter_reason(F.col("text"), g.rect()).alias("why"))).lower().count("hypot") == 1
    shaped = plan(titles.select_titles(regions))
    assert shaped.index("ArrowEvalPython", shaped.index("merge") if "merge" in shaped else 0) < shaped.rindex("Filter transform")
    assert [(r.ord, r.text) for r in titles.select_titles(regions).collect()] == [(1, "Steam Vents")]
    shapes = [((0.0, 0.0), (3.0, 3.0), (2.0, 4.0), (-1.0, 1.0)), ((0.0, 0.0), (1.0, 0.0), (1.0, 5.0), (0.0, 5.0)), ((5.0, 0.0), (0.0, 5.0), (-1.0, 4.0), (4.0, -1.0)), ()]
    turned = spark.createDataFrame([(i, list(p), 0.0, 0.0, 30.0, 30.0) for i, p in enumerate(shapes)], "i int, polygon array<struct<x: double, y: double>>, x double, y double, width double, height double")
    angles = turned.orderBy("i").select(F.round(g.polygon_angle(F.col("polygon"), g.rect()), 6).alias("a")).collect()
    assert [r.a for r in angles] == [45.0, 90.0, -45.0, 0.0]


def test_expected_names_meet_all_steps_in_one_join(spark):
    rows = spark.createDataFrame([(1, 1, "Steam Vents", "Steam Vents"), (1, 2, "Steam Vent", "Steam Vents"), (1, 3, "red", None), (2, 1, "Opt", "Opt")], "scan_id long, ord long, text string, name string")
    expected = spark.createDataFrame([(1, "Steam Vents"), (1, "red ring"), (2, "Opt"), (3, "Opt"), (1, "Steam")], "scan_id long, expected string")
    none = rows.limit(0)
    found = trace.trace(expected, rows.filter("ord = 1 and scan_id = 1"), rows.filter("ord = 2"), none.drop("name"), rows.filter("scan_id = 2"), rows.drop("name"))
    want = {(1, "Steam Vents", "matched", "Steam Vents"), (1, "red ring", "ocr-unmatched", "red"), (2, "Opt", "filtered", "Opt"), (3, "Opt", "not-detected", None), (1, "Steam", "suppressed", "Steam Vent")}
    assert {tuple(r) for r in found.collect()} == want
    # Before, each of the five steps had two joins of its own.
    assert plan(found).count("Join ") == 2


def test_points_are_only_counted_by_the_filter(spark):
    raw = spark.createDataFrame([(1, '[{"text": " a  b ", "score": 2, "poly": [[1, 2], {"x": 5, "y": 2}, [5, "x"], [1, 4.5]]}, {"text": "c", "score": 0.5, "poly": [[1, 2], [3, 4]]}, {"text": "d"}]')], "scan_id long, json string")
    found = ocr.ocr_regions(raw)
    assert [(r.ord, r.text, r.confidence, r.x, r.y, r.width, r.height) for r in found.collect()] == [(0, "a b", 1.0, 1.0, 0.0, 4.0, 4.5)]
    # Before, the filter parsed every point of every item for their number.
    assert [line for line in plan(found).split("\n") if "Filter" in line and "try_cast" in line.lower()] == [] and "get_json_object" not in [line for line in plan(found).split("\n") if "Filter" in line][0]


def test_texts_that_repeat_are_put_in_form_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(match, "written", lambda df: (seen.append(plan(df)), df)[1])
    rows = spark.createDataFrame([("Steam  Vents",), ("Steam  Vents",), ("?",), ("",), (None,)], "text string")
    assert [(r.text, r.normalized, r.cleaned) for r in match.read_texts(rows, t.sanitize).collect()] == [("Steam  Vents", "steam vents", "steam vents")]
    # Below the aggregate are the rows: a filter on a form that was moved there would make it for each of them.
    below = seen[0][seen[0].index("Aggregate") :].split("\n", 1)[1]
    assert "regexp_replace" not in below and "translate" not in below, below


def test_garbled_titles_of_repeated_texts(spark):
    texts = ["Steam Vents", "sTeAm vENts of tHe", "", None, "a. xX", " 7ab", "Plains", "fooBar baz qux"]
    regions = spark.createDataFrame([(1, i, texts[i % 8], 0.5, 1.5, 2.0, 90.0, 16.0) for i in range(32)], "scan_id long, ord long, text string, confidence double, x double, y double, width double, height double")
    found = titles.with_title_reason(regions, "why", "shared")
    assert "rlike" not in plan(found).lower()
    assert all(r.shared == r.own for r in found.withColumn("own", titles.garbled_title(F.col("text"))).collect())


def test_long_texts_are_not_read_as_dice(spark):
    texts = ["7", " 12 ", "\t\nl2.\r\n", "24;", "25", "0", "07,", "007", "5\u2028", "Steam Vents", "", None, "1 2", "    ", "O9:"]
    rows = spark.createDataFrame([(i, x, 2.0, 3.0) for i, x in enumerate(texts)], "ord long, text string, width double, height double")
    found = piles.die_faces(rows)
    want = {r.ord: r.value for r in rows.withColumn("value", t.parse_die_value(F.col("text"))).collect() if r.value is not None}
    assert {r.ord: r.value for r in found.collect()} == want and want[8] == 5 and want[2] == 12
    assert "btrim" in plan(found).lower() or "length" in plan(found).lower()


def test_angle_of_a_box(spark):
    odd = [None, float("nan"), float("inf"), -3.0, 0.0, 0.1, 7.0, 20.0, 90.0]
    rows = spark.createDataFrame([(x, 1.3, w, h) for x in (None, 0.1) for w in odd for h in odd], "x double, y double, width double, height double")
    box = g.rect()
    for r in rows.select("*", g.box_angle(box).alias("short"), g.polygon_angle(g.to_polygon(box), box).alias("long")).collect():
        assert r.short == r.long or str(r.short) == str(r.long) == "nan", r


def test_suppression_leaves_no_steps_behind(spark):
    rows = [(1, 1, "Steam Vents", "Steam Vents", 0.9, "confirmed", 100.0, 10.0, 90.0, 16.0), (1, 2, None, "draw a card.", 0.9, "unknown", 100.0, 80.0, 90.0, 16.0)]
    df = spark.createDataFrame(rows, "scan_id long, ord long, name string, detected_text string, confidence double, status string, x double, y double, width double, height double")
    folder = tables.scratch_dir(spark).rsplit("/", 1)[0].removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = suppress.judged(df, F.lit(476.0))
    # Rows, facts of texts (made once or more) and the step that each row fell to; no step's own table.
    sizes = {d: set(spark.read.parquet(f"{folder}/{d}").columns) for d in set(os.listdir(folder)) - before}
    assert not [d for d, columns in sizes.items() if {"_body", "scan_id"} <= columns], sizes
    assert {r.ord: r.dropped_by for r in found.collect()} == {1: None, 2: "body text"}


def test_bands_are_planned_with_one_pass_of_the_title_rules(spark, monkeypatch):
    seen = []
    shown = titles.title_filter_reason
    for module in (titles, bands):
        monkeypatch.setattr(module, "title_filter_reason", lambda *a: (seen.append(1), shown(*a))[1], raising=False)
    rows = [(1, 1, "Lightning", 0.9, 10.0, 100.0, 90.0, 16.0), (1, 2, "Helix", 0.9, 106.0, 100.0, 60.0, 16.0), (1, 3, "draw a card.", 0.9, 10.0, 300.0, 90.0, 16.0)]
    regions = spark.createDataFrame(rows, "scan_id long, ord long, text string, confidence double, x double, y double, width double, height double")
    assert bands.plan(regions, F.lit(900.0), F.lit(700.0)).count() > 0
    # Over all regions and over joined ones; what bands share is judged by its distinct texts.
    assert len(seen) == 2
