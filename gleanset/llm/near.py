"""Linking of near-equal sets by buckets, with exact verification, and connected components. DataFrame operations only.

members has a row for each bucket that an item (a distinct set, by id) falls into. Each item is first compared with one
member of its largest bucket; verified links merge items into components. Then, in buckets that hold several components,
the members outside the bucket's largest component are compared with a few members of it. What is left after that, members of one bucket in different components, is compared under a join condition that their heads
(sizes, sketches, samples) must meet, so no link between items that share a bucket is lost. A group of near copies costs rows in proportion to its size for as long as its members link; only
pairs that stay in different components, and that their heads can't tell from links, are met one by one. An operator can give
link() a sharper condition for these, on what is only made for members of such buckets: then few pairs are left to
verify, though each pair of a bucket is still put to the conditions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from gleanset.llm.common import forget, free_shuffles, keyed, written

#: In a round, the least ids of a component XORed with each of the round's numbers are compared.
LEADERS = ((0x2545F4914F6CDD1D, 0x6A09E667F3BCC908, 0x3C6EF372FE94F82B, 0x510E527FADE682D1, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179),)
FEW = 16  # items of a bucket that are compared without the sharper condition: a pair takes less to verify than a sketch to make


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root), root < id, for every id in edges (a, b) but the roots: the least id of its component, as a written table.

    Alternating large stars and small stars (Kiveris et al., 2014): a logarithmic number of rounds, no driver-side links."""
    now = written(_small_star(edges.select("a", "b")))
    for _ in range(max_rounds):
        if _are_stars(now):
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before, now = now, written(_small_star(_large_star(now)))
        forget(before)
    raise RuntimeError(f"components aren't complete after {max_rounds} rounds")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each a has one b, and no b is an a: then each b is the least of its component."""
    several = edges.groupBy("a").count().filter("count > 1").select("a")
    inner = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").select("a")
    return several.unionByName(inner).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    lower = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (id, root) after links (a, b) between its ids: only the graph of the roots is searched."""
    a, b = (roots.select(F.col("id").alias(k), F.col("root").alias(f"root_{k}")) for k in ("a", "b"))
    edges = links.join(a, "a").join(b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).filter("a <> b")
    moved = components(edges).select(F.col("id").alias("root"), F.col("root").alias("to"))
    return written(roots.join(moved, "root", "left").select("id", F.coalesce("to", "root").alias("root")))


def _plain(heads: DataFrame) -> DataFrame:
    """heads with numbers that can't be null. Conditions on pairs read many of them, and with a test for null at each one a
    join's code is longer than the 8,000 bytes that the JVM compiles: it would be interpreted for each pair."""
    return heads.withColumns({f.name: F.coalesce(f.name, F.lit(0).cast(f.dataType)) for f in heads.schema if f.name != "id" and isinstance(f.dataType, NumericType)})


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of each row's id and leader."""
    return rows.filter("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()


def link(
    members: DataFrame, heads_of: Callable[[DataFrame], DataFrame], may: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame],
    sharper: tuple[Callable[[DataFrame], DataFrame], Callable[[str, str], Column]] | None = None,
) -> DataFrame:
    """(id, root) of each item that shares a bucket with another one. members: bucket, id, each pair once.

    heads_of: ids to id and what may(left, right) reads; may must hold for every link; verify: the links among
    pairs (a, b) of heads_of's ids, as a written table. sharper: from ids to id and what a second condition like may reads,
    and that condition, for the members of different components that are left at the end."""
    # Most buckets hold one item. The members are shuffled once: counted and left out where they land.
    here = Window.partitionBy("bucket")
    counted = members.select("bucket", "id", F.count("*").over(here).alias("n"), F.min("id").over(here).alias("leader"))
    shared = written(counted.filter("n > 1"))
    free_shuffles(members.sparkSession)
    ids = written(shared.select("id").distinct())
    heads = written(heads_of(keyed(ids)))
    forget(ids)
    free_shuffles(members.sparkSession)

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = _plain(heads).alias("x"), _plain(heads).alias("y")
        close = pairs.join(x, F.col("a") == F.col("x.id")).join(y, (F.col("b") == F.col("y.id")) & may("x", "y")).select("a", "b")
        return verify(close)

    largest = shared.groupBy("id").agg(F.max(F.struct("n", "leader")).alias("top")).select("id", "top.leader")
    found = verified(_pairs(largest))
    roots = merged(heads.select("id", F.col("id").alias("root")), found)
    forget(found)
    free_shuffles(members.sparkSession)
    for round_no, numbers in enumerate((*LEADERS, None)):
        rows = shared.select("bucket", "id", "n").join(roots, "id")
        leaders = F.array(*[F.min(F.col("id").bitwiseXOR(F.lit(c))).bitwiseXOR(F.lit(c)) for c in numbers or (0,)])
        parts = rows.drop("n").groupBy("bucket", "root").agg(F.count("*").alias("n"), leaders.alias("leaders"))
        tops = parts.groupBy("bucket").agg(F.max(F.struct("n", "root", "leaders")).alias("top"), F.count("*").alias("k")).filter("k > 1").select("bucket", F.col("top.root").alias("top"), "top.leaders")
        active = written(rows.join(tops, "bucket"))
        outside = active.filter("root <> top")
        if outside.isEmpty():
            forget(active)
            break
        if numbers:
            # Each outsider in one of its buckets, another one in each round.
            one = outside.groupBy("id").agg(F.max_by("leaders", F.xxhash64(F.lit(round_no), "bucket")).alias("leaders"))
            pairs = _pairs(one.select("id", F.explode("leaders").alias("leader")))
        else:
            pairs = _across(active, outside, heads, may, sharper)
        found = verified(pairs) if numbers else verify(pairs)
        if not found.isEmpty():
            before, roots = roots, merged(roots, found)
            forget(before)
        forget(found, active)
        free_shuffles(members.sparkSession)
    forget(shared, heads)
    return roots


def _across(active: DataFrame, outside: DataFrame, heads: DataFrame, may: Callable[[str, str], Column], sharper=None) -> DataFrame:
    """Pairs of members of one bucket in different components whose heads allow a link."""
    heads = _plain(heads)
    if sharper:
        # Only for members of large buckets: elsewhere a sketch costs more than the few pairs that it saves.
        sharp = sharper[0](active.filter(F.col("n") > FEW).select("id").distinct()).withColumn("_sharp", F.lit(True))
        heads = _plain(heads.join(sharp, "id", "left")).withColumn("_sharp", F.coalesce("_sharp", F.lit(False)))
    x, y = (rows.select("bucket", "id", "root", "top").join(heads, "id") for rows in (outside, active))
    once = (F.col("y.root") == F.col("y.top")) | (F.col("x.id") < F.col("y.id"))
    parts = [F.col("x.bucket") == F.col("y.bucket"), F.col("x.root") != F.col("y.root"), once, may("x", "y")]
    if sharper:
        parts.append(~F.col("x._sharp") | ~F.col("y._sharp") | sharper[1]("x", "y"))
    # A pair is met in each bucket that it shares, for a test of which is the first would take longer than the conditions.
    return x.alias("x").join(y.alias("y"), reduce(Column.__and__, parts)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
