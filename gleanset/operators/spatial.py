"""Pairs of boxes that meet, by cells: a scan with many boxes costs by its overlaps and not by the square of its boxes.

Boxes have a level by their longest side; a level's cells are FACTOR times as wide as those of the one below, and at its own level a
box is in two cells an axis at most. Two boxes meet at the higher of their levels, where one is at home and the other a visitor,
in the cell that holds the lower left corner of what they share: each pair is formed there once, whatever the sizes.
Spans that are null, or end before they begin, meet nothing. Where few boxes could meet they are in one cell, once each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL, FACTOR = 16.0, 4.0
FEW = 256  # as many comparisons of all with all cost less than cells do
Span = tuple[Column, Column]  # where a box begins and ends on one axis


def _level(spans: list[Span]) -> Column:
    longest = F.greatest(*[high - low for low, high in spans], F.lit(0.0)) if len(spans) > 1 else spans[0][1] - spans[0][0]
    fits = reduce(Column.__and__, [high >= low for low, high in spans])
    return F.when(fits, F.greatest(F.lit(0), F.ceil(F.log(FACTOR, F.greatest(longest, F.lit(CELL)) / CELL)).cast("int")))


def _side(level: Column) -> Column:
    return F.lit(CELL) * F.pow(F.lit(FACTOR), level)


def _cells(spans: list[Span], level: Column) -> Column:
    """The cells of a level that a box is in: arrays of one number an axis."""
    ranges = [F.sequence(F.floor(low / _side(level)), F.floor(high / _side(level))) for low, high in spans]
    if len(ranges) == 1:
        return F.transform(ranges[0], lambda i: F.array(i))
    return F.flatten(F.transform(ranges[0], lambda i: F.transform(ranges[1], lambda j: F.array(i, j))))


def _keys(spans: list[Span], own: Column, top: Column, home: tuple[bool, ...], away: tuple[bool, ...]) -> Column:
    """A key for each cell, and for each of the flags: home at the box's own level, away at those above."""
    at = lambda level, flags: F.flatten(F.transform(F.array(*map(F.lit, flags)), lambda f: F.transform(_cells(spans, level), lambda c: F.struct(f.alias("f"), level.cast("int").alias("level"), c.alias("c")))))
    above = F.when(top > own, F.flatten(F.transform(F.sequence(own + 1, top), lambda level: at(level, away))))
    return F.concat(at(own, home), F.coalesce(above, F.slice(at(own, home), F.lit(1), F.lit(0))))


def pairs(xs: DataFrame, ys: DataFrame, x_spans: list[Span], y_spans: list[Span], condition: Column, on: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """Rows of xs (as x) and ys (as y) with equal on whose spans, one or two axes, touch or overlap, under the condition."""
    placed = []
    for df, spans in ((xs, x_spans), (ys, y_spans)):
        # Each step's columns are plain ones, so that Spark computes them once.
        df = df.withColumns({f"_{k}{i}": v.cast("double") for i, span in enumerate(spans) for k, v in zip(("low", "high"), span)})
        own = [(F.col(f"_low{i}"), F.col(f"_high{i}")) for i in range(len(spans))]
        placed.append((df.withColumn("_own", _level(own)), own))
    counted = [df.groupBy(*on).agg(F.count("*").alias(f"_n{name}"), F.max("_own").alias(f"_top{name}")) for name, (df, _) in zip("xy", placed)]
    tops = counted[0].join(counted[1], list(on)).select(*on, F.greatest("_topx", "_topy").alias("_top"), (F.col("_nx") * F.col("_ny") <= FEW).alias("_few"))
    # Home or away meets home (true), home meets away (false): two visitors are no pair. Few boxes are all in one cell of no level.
    sides = []
    one = F.array(F.struct(F.lit(True).alias("f"), F.lit(-1).alias("level"), F.array().cast("array<bigint>").alias("c")))
    for name, (rows, spans), home, away in (("x", placed[0], (True, False), (True,)), ("y", placed[1], (True,), (False,))):
        keys = F.when(F.col("_few"), one).otherwise(_keys(spans, F.col("_own"), F.col("_top"), home, away))
        keyed = rows.join(tops, list(on)).filter("_own is not null").withColumn("_key", F.explode(keys))
        sides.append(keyed.drop("_own", "_top", "_few").alias(name))
    side = _side(F.col("x._key.level"))
    met = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*on, "_key")]
    few = F.col("x._key.level") < 0
    for i in range(len(x_spans)):
        met.append(few | (F.get("x._key.c", F.lit(i)) == F.floor(F.greatest(f"x._low{i}", f"y._low{i}") / side)))
        met.append((F.col(f"x._low{i}") <= F.col(f"y._high{i}")) & (F.col(f"y._low{i}") <= F.col(f"x._high{i}")))
    return sides[0].join(sides[1], reduce(Column.__and__, met) & condition)


def across() -> list[Span]:
    """The columns that a box covers, whatever its height."""
    return [(F.col("x"), F.col("x") + F.col("width"))]


def boxes() -> list[Span]:
    return [*across(), (F.col("y"), F.col("y") + F.col("height"))]
