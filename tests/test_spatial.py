"""Joins of boxes by cells, and the greedy choice over overlaps, against comparing all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanset.functions import geometry as g
from gleanset.operators import spatial, suppress

BOX = "scan_id long, ord long, x double, y double, width double, height double, confidence double, name string"


def boxes(rng, scans, n, canvas, longest):
    out = []
    for s in range(scans):
        for i in range(n):
            w, h = (rng.choice([rng.uniform(0, longest), rng.randint(1, 8) * 8]) for _ in range(2))
            if rng.random() < 0.02:
                w = canvas * rng.choice([0.5, 3])
            out.append((s, i, rng.choice([rng.uniform(-50, canvas), rng.randint(0, canvas // 16) * 16.0]), rng.uniform(-20, canvas), float(w), float(h), rng.randint(0, 9) / 10, rng.choice(["Island", "Forest", None])))
    return out


def iou(a, b):
    w, h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
    union = a[4] * a[5] + b[4] * b[5] - w * h
    return w * h / union if w > 0 and h > 0 and union > 0 else 0.0


def touch(a, b, axes):
    return all(a[k] <= b[k] + b[k + 2] and b[k] <= a[k] + a[k + 2] for k in ((2, 3) if axes == 2 else (2,)))


@pytest.mark.parametrize("axes", [1, 2])
def test_pairs(spark, axes):
    rows = boxes(random.Random(axes), 3, 70, 400, 90)
    df = spark.createDataFrame([*rows, (0, 900, None, 1.0, 5.0, 5.0, 0.1, "x"), (0, 901, 1.0, 1.0, -5.0, 5.0, 0.1, "x")], BOX)
    spans = spatial.boxes() if axes == 2 else spatial.across()
    found = spatial.pairs(df.filter("ord % 2 = 0"), df, spans, spans, F.lit(True)).select("x.scan_id", F.col("x.ord").alias("a"), F.col("y.ord").alias("b")).collect()
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] % 2 == 0 and touch(a, b, axes))
    assert sorted(map(tuple, found)) == want


def fold(rows, limit):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if all(iou(r, k) <= limit for k in kept if k[0] == r[0]):
            kept.append(r)
    return sorted((r[0], r[1]) for r in kept)


def test_greedy_choice(spark):
    rows = boxes(random.Random(3), 6, 60, 300, 120)
    # A staircase: each box overlaps the next one, confidence falls along it.
    rows += [(50, i, i * 10.0, 0.0, 30.0, 10.0, 1 - i / 100, "s") for i in range(60)]
    rows += [(51, i, 5.0, 5.0, 20.0, 20.0, 0.5, "same") for i in range(30)] + [(52, 0, 0.0, 0.0, 0.0, 0.0, 0.5, "none")]
    for limit in (0.3, 0.05):
        got = suppress.greedy_nms(spark.createDataFrame(rows, BOX).repartition(5), limit)
        assert sorted((r.scan_id, r.ord) for r in got.filter("kept").collect()) == fold(rows, limit)
        assert got.count() == len(rows)


def test_a_dense_scan_costs_by_its_overlaps(spark):
    """One scan of 20,000 boxes: what the join forms is a few times the pairs that overlap, not their square."""
    rng = np.random.default_rng(4)
    n = 20_000
    x, y, w, h = rng.uniform(0, 12_000, n), rng.uniform(0, 12_000, n), rng.uniform(20, 120, n), rng.uniform(10, 40, n)
    w[:5] = 12_000  # some over the whole width
    df = spark.createDataFrame([(1, i, *map(float, v), 0.5, None) for i, v in enumerate(zip(x, y, w, h))], BOX).cache()
    overlaps = sum(int(((x[i] <= x + w) & (x <= x[i] + w[i]) & (y[i] <= y + h) & (y <= y[i] + h[i])).sum()) for i in range(n))
    assert spatial.pairs(df, df, spatial.boxes(), spatial.boxes(), F.lit(True)).count() == overlaps
    own = F.col("_own")
    top = df.select(F.max(spatial._level(spatial.boxes()))).first()[0]
    keys = [df.withColumn("_own", spatial._level(spatial.boxes())).select(F.explode(spatial._keys(spatial.boxes(), own, F.lit(top), *flags)).alias("k")).groupBy("k").count() for flags in (((True, False), (True,)), ((True,), (False,)))]
    formed = keys[0].join(keys[1].withColumnRenamed("count", "other"), "k").agg(F.sum(F.col("count") * F.col("other"))).first()[0]
    assert formed < 40 * overlaps < n * n / 4


def test_steps_equal_all_pairs(spark):
    rows = boxes(random.Random(6), 4, 50, 300, 90)
    df = spark.createDataFrame(rows, BOX).withColumns({"detected_text": F.lit("Some title"), "status": F.lit("unknown")})
    a, b = g.rect("a"), g.rect("b")
    both = df.alias("a").join(df.alias("b"), (F.col("a.scan_id") == F.col("b.scan_id")) & (F.col("a.ord") != F.col("b.ord")))
    plain = lambda c: {tuple(r) for r in both.filter(c).select("a.scan_id", "a.ord").distinct().collect()}
    keys = lambda found: {(r.scan_id, r.ord) for r in found.select("scan_id", "ord").collect()}
    everything = keys(df)
    assert everything - keys(suppress.drop_smaller_rereads(df)) == plain((F.col("a.name") == F.col("b.name")) & (g.horizontal_overlap(a, b) > 0.5) & (b.height > a.height * 1.5))
    assert everything - keys(suppress.drop_land_rereads(df, F.lit(100.0))) == plain((F.col("a.name") == F.col("b.name")) & (a.y > 128) & (b.y <= 128) & (g.horizontal_overlap(a, b) > 0.35))
    assert {(r.scan_id, r.ord, r.peers) for r in suppress.row_peers(df).collect()} == {tuple(r) for r in both.filter(F.abs(a.y - b.y) < 24).groupBy("a.scan_id", "a.ord").count().collect()}
    above = {(r.scan_id, r.ord): r.above and r.above.ord for r in suppress.nearest_above(df).collect()}
    for r in rows:
        best = [(o[3], -o[1]) for o in rows if o[0] == r[0] and o[1] != r[1] and o[3] + o[5] <= r[3] and (w := min(r[2] + r[4], o[2] + o[4]) - max(r[2], o[2])) > 0 and w / max(1, min(r[4], o[4])) >= 0.28]
        assert above[r[0], r[1]] == (-max(best)[1] if best else None)
