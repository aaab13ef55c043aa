import json

from gleanset.streaming.regions import follow


def test_region_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for scan in (1, 2):
        rows = [{"scan_id": scan, "ord": i, "text": text, "confidence": 0.9, "x": 10.0, "y": 40.0 * i, "width": 90.0, "height": 20.0} for i, text in enumerate(["Steam Vents", "Draw a card."])]
        (source / f"{scan}.json").write_text("\n".join(map(json.dumps, rows)))
        follow(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.scan_id, r.text, r.batch) for r in got) == [(1, "Steam Vents", 0), (2, "Steam Vents", 1)]
