"""Catalog sources and cache, report texts, blobs and crops, and the whole way from regions to lists."""

import json
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanset.operators import catalog, labels, pixels, titles
from gleanset.plans import scan
from gleanset.sources import names

NOW = datetime(2024, 5, 1, tzinfo=timezone.utc)


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def listed(df):
    return sorted(r.name for r in df.collect())


def test_strict_names(spark, tmp_path):
    good = put(tmp_path / "good.json", {"object": "catalog", "data": ["Bolt", "Ætherling", "Bolt", "7"]})
    assert listed(names.strict_names(spark, good)) == ["7", "Bolt", "Bolt", "Ætherling"]
    assert listed(names.strict_names(spark, put(tmp_path / "none.json", {"data": []}))) == []
    for i, bad in enumerate(({"data": ["a", 7]}, {"data": ["a", None]}, {"data": [["a"]]}, {"data": "a"}, {"names": ["a"]}, ["a"], "not json", "")):
        with pytest.raises(names.MalformedCatalog):
            names.strict_names(spark, put(tmp_path / f"bad{i}.json", bad)).collect()
    spark.createDataFrame([("a",), (None,)], "name string").write.parquet(str(tmp_path / "null.parquet"))
    spark.createDataFrame([(1,)], "name int").write.parquet(str(tmp_path / "int.parquet"))
    for bad in ("null", "int"):
        with pytest.raises(names.MalformedCatalog):
            names.strict_names(spark, str(tmp_path / f"{bad}.parquet"))


def test_load_names(spark, tmp_path):
    """The five ways: cached; read first and cached; fallback; first malformed; nothing to be had."""
    first, local = put(tmp_path / "first.json", {"data": ["New", "Newer"]}), put(tmp_path / "local.json", {"data": ["Local"]})
    broken, gone, cache = put(tmp_path / "broken.json", {"data": [1]}), str(tmp_path / "gone.json"), str(tmp_path / "cache")
    assert names.read_cache(spark, cache, now=NOW) is None
    assert listed(names.load_names(spark, cache, first, local, NOW)) == ["New", "Newer"]
    assert listed(names.load_names(spark, cache, gone, None, NOW + timedelta(days=7))) == ["New", "Newer"]  # cached, the last day
    assert names.read_cache(spark, cache, now=NOW + timedelta(days=7, seconds=1)) is None
    assert names.read_cache(spark, cache, now=NOW - timedelta(seconds=1)) is None  # fetched in the future
    assert listed(names.load_names(spark, cache, gone, local, NOW + timedelta(days=9))) == ["Local"]
    assert listed(names.read_cache(spark, cache, now=NOW + timedelta(days=9))) == ["Local"]
    other = str(tmp_path / "other")
    assert listed(names.load_names(spark, other, broken, local, NOW)) == ["Local"]
    with pytest.raises(names.MalformedCatalog):
        names.load_names(spark, str(tmp_path / "third"), broken, gone, NOW)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        names.load_names(spark, str(tmp_path / "third"), gone, None, NOW)


def test_half_written_cache_is_a_miss(spark, tmp_path):
    cache = tmp_path / "cache"
    old, new = (spark.createDataFrame([(n,) for n in ns], "name string") for ns in (["a"], ["b", "c"]))
    assert names.write_cache(old, str(cache), NOW)
    new.write.parquet(str(cache / "versions" / "halfway"))  # written, not logged: the old version stays
    assert listed(names.read_cache(spark, str(cache), now=NOW)) == ["a"]
    assert names.write_cache(new, str(cache), NOW + timedelta(hours=1))
    assert listed(names.read_cache(spark, str(cache), now=NOW + timedelta(hours=2))) == ["b", "c"]
    for version in (cache / "versions").iterdir():
        for part in [*version.glob("part-*"), *version.glob(".part-*")]:
            part.unlink()
    assert names.read_cache(spark, str(cache), now=NOW + timedelta(hours=2)) is None
    put(tmp_path / "file", "no folder")
    assert not names.write_cache(old, str(tmp_path / "file"), NOW)


LABEL = "scan_id long, ord long, detected_text string, name string, verdict string, corrected_text string, x double, y double, width double, height double"


def test_report_text(spark):
    rows = spark.createDataFrame([
        (1, 0, "Lightning Bolt", "Lightning Bolt", "correct", None, 10.0, 20.0, 100.0, 24.0), (1, 1, "Scorching Dragonfi", "Scorching Dragonfire", "corrected", " Scorching Dragonfire", 5.0, 6.0, 200.0, 30.0),
        (1, 2, "Destroy all creatures.", None, "not-card", None, 1.0, 2.0, 300.0, 20.0), (1, 3, "Opt", "Opt", "unreviewed", None, 0.0, 0.0, 40.0, 18.0), (2, 0, "Foo", None, "corrected", "   ", 0.0, 0.0, 10.0, 10.0),
    ], LABEL)
    added = spark.createDataFrame([(1, 0, " Swamp ", 50.0, 60.0, 120.0, 28.5), (2, 0, "  ", 0.0, 0.0, 10.0, 10.0)], "scan_id long, ord long, text string, x double, y double, width double, height double")
    scans = spark.createDataFrame([(1, "a.jpg", 1920.0, 1079.5), (2, "b.jpg", 10.0, 20.0), (3, "c.jpg", 1.0, 2.0)], "scan_id long, filename string, width double, height double")
    got = {r.scan_id: r.report.split("\n") for r in labels.report_text(rows, scans, added, "Opening.", "Closing.").collect()}
    boxes = "(every box below is [x, y, width, height] in these pixels)."
    assert got[1] == [
        "Opening.", "", "Sample: a.jpg", f"Prepared image: 1920x1080 px {boxes}", "", "Correct detections (1):", '- "Lightning Bolt" [10, 20, 100, 24]', "", "Wrong names to fix (1):",
        '- detected "Scorching Dragonfi" -> should be "Scorching Dragonfire" [5, 6, 200, 30]', "", "False positives to suppress (1):", '- "Destroy all creatures." [1, 2, 300, 20] (not a card title)', "",
        "Missed titles to detect (1):", '- "Swamp" [50, 60, 120, 29]', "", "Unreviewed detections (not labeled): 1", "", "Closing.",
    ]
    empty = [x for h in ("Correct detections", "Wrong names to fix", "False positives to suppress", "Missed titles to detect") for x in (f"{h} (0):", "- none marked", "")]
    for k, name, size in ((2, "b", "10x20"), (3, "c", "1x2")):
        assert got[k] == ["Opening.", "", f"Sample: {name}.jpg", f"Prepared image: {size} px {boxes}", "", *empty, "Closing."]


def test_restored_and_first_images(spark):
    assigned, added = (spark.createDataFrame([(k,) for k in ks], "scan_id long") for ks in ([1, 1, 2], [2, 3]))
    assert sorted(map(tuple, labels.restored_counts(assigned, added).collect())) == [(1, 2), (2, 2), (3, 1)]
    uploads = spark.createDataFrame([(1, 2, "image/png"), (1, 1, "text/plain"), (1, 3, "image/jpeg"), (2, 1, None), (2, 2, "")], "upload_id long, ord long, declared string")
    assert [tuple(r) for r in pixels.first_images(uploads).collect()] == [(1, 2, "image/png")]


def flooded(mask):
    """4-connected parts by a flood from each pixel in reading order."""
    seen, out = np.zeros(mask.shape, bool), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        stack, cells = [(y, x)], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            cells.append((a, b))
            for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not seen[c, d]:
                    seen[c, d] = True
                    stack.append((c, d))
        ys, xs = zip(*cells)
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(cells)))
    return out


def test_blobs_equal_a_flood():
    rng = np.random.default_rng(1)
    for share in (0.1, 0.45, 0.6, 0.75, 1.0):
        for shape in ((1, 1), (1, 40), (40, 1), (23, 31), (60, 60)):
            mask = rng.random(shape) < share
            assert pixels.blobs(mask) == [tuple(map(int, b)) for b in flooded(mask)]
    spiral = np.zeros((41, 41), bool)
    for k in range(0, 20, 2):
        spiral[k, k : 41 - k] = spiral[k : 41 - k, 40 - k] = spiral[40 - k, k : 41 - k] = True
        spiral[k + 2 : 41 - k, k] = True
    assert pixels.blobs(spiral) == [tuple(map(int, b)) for b in flooded(spiral)]
    assert pixels.blobs(np.zeros((3, 3), bool)) == []


def test_die_crops(spark):
    mask = np.zeros((200, 300), bool)
    for y, x, h, w in ((0, 0, 20, 20), (30, 100, 30, 25), (100, 10, 40, 40), (100, 200, 24, 22), (170, 100, 10, 10), (100, 100, 18, 60)):
        mask[y : y + h, x : x + w] = True
    want = [(2, 92, 56, 56), (92, 22, 41, 46), (192, 92, 38, 40)]
    assert pixels.die_crops(mask) == want  # the corner's is the fourth, the small one and the long one are none
    rows = [(1, 300, mask.astype(int).ravel().tolist()), (2, 300, None), (3, 10, []), (4, 300, [1] * 50)]
    got = pixels.largest_crops(spark.createDataFrame(rows, "image_id long, width int, bits array<int>")).orderBy("rank").collect()
    assert [(r.image_id, r["rank"], r.x, r.y, r.width, r.height) for r in got] == [(1, i + 1, *c) for i, c in enumerate(want)]


def test_scan(spark):
    """Regions of two scans to lists: a filtered line, a fragment, a re-read, a land pile counted once, and why names are missed."""
    found = ["Lightning Bolt", "Frost Lynx", "Steam Vents", "Island", "Swamp"]
    index = catalog.build_index(spark.createDataFrame(list(enumerate(found)), "card_ord long, name string"))
    rows = [
        (1, 0, "Lightning Bolt", 0.95, 100.0, 50.0, 120.0, 16.0), (1, 1, "Steam", 0.9, 300.0, 50.0, 50.0, 16.0), (1, 2, "Vents", 0.9, 356.0, 51.0, 45.0, 16.0),
        (1, 3, "Draw a card.", 0.9, 300.0, 250.0, 100.0, 14.0), (1, 4, "Lightning Bolt", 0.6, 102.0, 51.0, 118.0, 16.0),
        (1, 5, "Island", 0.9, 500.0, 560.0, 60.0, 18.0), (1, 6, "Island", 0.9, 500.0, 590.0, 60.0, 18.0), (1, 7, "7", 0.9, 520.0, 640.0, 20.0, 20.0),
        (2, 0, "Swamp", 0.9, 100.0, 600.0, 60.0, 18.0),
    ]
    done = scan.scan(spark.createDataFrame(rows, titles.REGION), index, (900.0, 700.0))
    assert sorted((r.scan_id, r.name, r["count"]) for r in done.lines.collect()) == [(1, "Island", 7), (1, "Lightning Bolt", 1), (1, "Steam Vents", 1), (2, "Swamp", 1)]
    outcomes = {(r.scan_id, r.ord): (r.outcome, r.detail) for r in done.outcomes().collect()}
    assert len(outcomes) == len(rows)
    assert outcomes[1, 0] == ("kept", "Lightning Bolt") and outcomes[1, 4] == ("suppressed", "overlap") and outcomes[1, 2] == ("merged", None)
    assert outcomes[1, 3][0] == "filtered" and outcomes[1, 7][0] == "filtered"
    expected = spark.createDataFrame([(1, n) for n in found] + [(2, "Swamp")], "scan_id long, expected string")
    reasons = {(r.scan_id, r.expected): r.reason for r in done.traced(expected).collect()}
    assert reasons == {(1, "Lightning Bolt"): "matched", (1, "Frost Lynx"): "not-detected", (1, "Steam Vents"): "matched", (1, "Island"): "matched", (1, "Swamp"): "not-detected", (2, "Swamp"): "matched"}
