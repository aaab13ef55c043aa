"""Near-duplicate vectors by iterative quantisation: binary codes, multi-index Hamming tables, and cosines of the vectors.

Codes: rotations are learned that bring the vectors close to corners of a cube (Gong and Lazebnik, 2011), each from another
start, and their signs make one long code. Vectors aren't centred: signs about the origin keep cosines whatever the mean is.
Tables: the code is cut into keys of key_bits bits, about log2 of the number of vectors, so that a bucket holds few
vectors that aren't alike. Vectors that share a key, and whose first 128 bits differ in no more places than vectors at
the limit do, are candidates. Tables are added until pairs of sample vectors at exactly the limit share a key in `recall` of
the cases; closer pairs do so more often.
Rerank: cosines of the original vectors, in double precision, decide.

Groups: each vector first meets the least vector of each of its buckets. If their angle is at most half of the limit's, it
joins that one's ball: by the triangle inequality all of a ball's members link, and are counted, not paired. Tables then
hold balls instead of members, and the angle between two centres and both radii tell for most balls that all of their members
link, or none. Only in between are members compared, with the other centre first. So a group of near copies costs rows in
proportion to its size; only vectors that are near the limit of each other are met one by one.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components have no links; so do rows without
an id, whose component_id is null and which are kept. Vectors of different lengths don't link. Equal vectors are one vector
with several rows, each of them another vector's link, rows that repeat an id too. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, ceil, cos, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanset.llm.common import bounded_sample, written
from gleanset.llm.near import components

SCHEMA = "vec_id long, n_links long, component_id long, kept boolean"
CHECK_BITS = 128
SLACK = 1e-6  # radians; far above the error of an angle from a cosine


@dataclass(frozen=True)
class Search:
    limit: float = 0.9
    recall: float = 0.97
    sample_rows: int = 8192  # rows that the rotations are learned from
    rounds: int = 20
    least_key_bits: int = 16
    most_tables: int = 96
    most_dims: int = 256  # longer vectors are projected to so many principal directions


@dataclass(frozen=True)
class Model:
    projection: np.ndarray  # a column for each bit
    tables: int
    key_bits: int
    most_apart: dict[float, int]  # by multiples of the limit's angle: in how many of the check bits vectors so far apart differ

    def bits(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.projection >= 0


def units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotation(v: np.ndarray, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """The rotation that makes v's signs fit v best, from a random start."""
    r = np.linalg.qr(rng.standard_normal((v.shape[1],) * 2))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (left @ right).T
    return r


def apart(x: np.ndarray, angle: float, rng: np.random.Generator) -> np.ndarray:
    """A partner for each row of x at the angle, in the direction of another row."""
    other = x[rng.permutation(len(x))] + 1e-3 * rng.standard_normal(x.shape)
    other -= (other * x).sum(1, keepdims=True) * x
    size = np.sqrt((other * other).sum(1, keepdims=True))
    return cos(angle) * x + np.sin(angle) * other / np.where(size > 0, size, 1)


def fit(sample: np.ndarray, n: int, how: Search) -> Model:
    """sample: unit vectors; n: how many vectors the tables are for."""
    rng = np.random.default_rng(7)
    dims = min(sample.shape[1], how.most_dims)
    main = np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, :dims]
    key_bits = min(30, max(how.least_key_bits, ceil(log2(max(2, n)))))
    n_bits = key_bits * how.most_tables
    v = sample @ main
    projection = np.hstack([main @ rotation(v, rng, how.rounds) for _ in range(ceil(n_bits / dims))])[:, :n_bits]
    theta = acos(how.limit)
    own = sample[rng.permutation(len(sample))[:2048]]
    code = own @ projection >= 0
    differ = {f: code != (apart(own, f * theta, rng) @ projection >= 0) for f in (0.5, 1.0, 1.5, 2.0)}
    same = ~differ[1.0].reshape(len(own), how.most_tables, key_bits).any(2)
    found = (np.cumsum(same, 1) > 0).mean(0)
    tables = int(np.argmax(found >= how.recall)) + 1 if found[-1] >= how.recall else how.most_tables
    tables = max(tables, ceil(CHECK_BITS / key_bits))
    most = {}
    for f, d in differ.items():
        p = f * theta / pi
        most[f] = max(ceil(CHECK_BITS * p + 5 * sqrt(CHECK_BITS * p * (1 - p))), int(d[:, :CHECK_BITS].sum(1).max(initial=0)))
    return Model(projection[:, : tables * key_bits].copy(), tables, key_bits, most)


def _matrix(col: pa.ListArray, at: np.ndarray, dim: int) -> np.ndarray:
    return units(col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim))


def coded(vectors: DataFrame, models: dict[int, Model]) -> DataFrame:
    """id, keys, c1, c2 of vectors (id, embedding): a key for each table, and the check bits."""
    weights = 1 << np.arange(63, -1, -1, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2048):
                batch = whole.slice(first, 2048)
                ids, col = batch.column(0), batch.column(1)
                sizes = col.value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(sizes):
                    at, m = np.nonzero(sizes == dim)[0], models[int(dim)]
                    bits = m.bits(_matrix(col, at, dim))
                    keys = bits.reshape(len(at), m.tables, m.key_bits) @ (1 << np.arange(m.key_bits, dtype=np.int64))
                    keys += (np.arange(m.tables, dtype=np.int64) << 32) + (np.int64(dim) << 40)
                    check = (bits[:, :CHECK_BITS].reshape(len(at), 2, 64) * weights).sum(2, dtype=np.uint64).astype(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * m.tables), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), lists, pa.array(check[:, 0]), pa.array(check[:, 1])], ["id", "keys", "c1", "c2"])

    return vectors.select("id", "embedding").mapInArrow(run, "id long, keys array<long>, c1 long, c2 long")


def with_cosine(pairs: DataFrame, vectors: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with cosine, of the vectors with the ids in the columns a and b."""
    kept = pairs.schema
    x, y = (vectors.select(F.col("id").alias(c), F.col("embedding").alias(f"_{c}")) for c in (a, b))
    rows = pairs.join(x, a).join(y, b).select(*kept.names, f"_{a}", f"_{b}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            sizes, cosine = left.value_lengths().to_numpy(zero_copy_only=False), np.zeros(batch.num_rows)
            for dim in np.unique(sizes):
                at = np.nonzero(sizes == dim)[0]
                cosine[at] = (_matrix(left, at, dim) * _matrix(right, at, dim)).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(cosine)], [*kept.names, "cosine"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", cosine double")


def _valid(v: Column) -> Column:
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def _angle(cosine: Column) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def _apart(x: str, y: str) -> Column:
    """In how many of the check bits two sides of a join differ."""
    return sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in ("c1", "c2")), F.lit(0))


def models_for(vectors: DataFrame, how: Search = Search()) -> dict[int, Model]:
    """A model for each length of the vectors (id, dim, embedding), from a sample of how.sample_rows rows at most."""
    out = {}
    for r in vectors.groupBy("dim").count().collect():
        rows = bounded_sample(vectors.filter(F.col("dim") == r.dim), F.col("id"), how.sample_rows).select("embedding").toArrow().column(0).combine_chunks()
        out[r.dim] = fit(_matrix(rows, np.arange(len(rows)), r.dim), r["count"], how)
    return out


def _balls(vectors: DataFrame, codes: DataFrame, most: int, half: float) -> DataFrame:
    """id, ball, cosine: the centre whose ball a vector is in, for those that aren't centres themselves."""
    rows = codes.select(F.explode("keys").alias("bucket"), "id", "c1", "c2")
    firsts = rows.groupBy("bucket").agg(F.min(F.struct("id", "c1", "c2")).alias("lead"), F.count("*").alias("n")).filter("n > 1").select("bucket", "lead.*")
    pairs = rows.alias("x").join(firsts.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") != F.col("y.id")) & (_apart("x", "y") <= most))
    near = with_cosine(pairs.select(F.col("x.id").alias("id"), F.col("y.id").alias("ball")).distinct(), vectors, "id", "ball").filter(F.col("cosine") >= cos(half - SLACK))
    near = written(near)
    # A vector that is itself near a lesser one is no centre.
    free = near.join(near.select(F.col("id").alias("ball")).distinct(), "ball", "left_anti")
    return written(free.groupBy("id").agg(F.min(F.struct("ball", "cosine")).alias("m")).select("id", "m.*"))


def _ball_pairs(codes: DataFrame, inside: DataFrame, most: dict[float, int]) -> DataFrame:
    """a, b: centres of two balls with members that share a bucket, each pair once. A single vector is its own ball."""
    centre = inside.select(F.col("ball").alias("id")).distinct().join(codes, "id").select("id", "c1", "c2")
    centre = written(centre.select(F.col("id").alias("ball"), "c1", "c2"))
    group = inside.select("id", "ball").unionByName(centre.select(F.col("ball").alias("id"), "ball"))
    single = codes.join(group, "id", "left_anti").select(F.explode("keys").alias("bucket"), F.col("id").alias("ball"), F.lit(False).alias("many"), "c1", "c2")
    several = codes.select("id", "keys").join(group, "id").select(F.explode("keys").alias("bucket"), "ball").distinct().join(centre, "ball")
    rows = written(single.unionByName(several.select("bucket", "ball", F.lit(True).alias("many"), "c1", "c2")))
    bound = F.when(F.col("x.many") & F.col("y.many"), most[2.0]).when(F.col("x.many") | F.col("y.many"), most[1.5]).otherwise(most[1.0])
    met = rows.alias("x").join(rows.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.ball") < F.col("y.ball")) & (_apart("x", "y") <= bound))
    return met.select(F.col("x.ball").alias("a"), F.col("y.ball").alias("b")).distinct()


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", how: Search = Search()) -> DataFrame:
    """SCHEMA for each row: how many other rows link with it, and the least id of its component."""
    own, vector = F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col)
    flat = rows.select(own, F.when(_valid(vector) & F.col(id_col).isNotNull(), vector).alias("embedding"))
    good = flat.filter("embedding is not null").withColumn("h", F.xxhash64("embedding"))
    distinct = good.groupBy("h", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    vectors = written(distinct.select(F.monotonically_increasing_id().alias("id"), "h", "embedding", F.size("embedding").alias("dim"), "least", "n"))
    found = written(_linked(vectors, how))
    placed = good.join(vectors.select("h", "embedding", "id"), ["h", "embedding"]).select("vec_id", "id").join(found, "id")
    out = placed.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    odd = flat.filter("embedding is null")
    return out.unionByName(odd.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))


def _linked(vectors: DataFrame, how: Search) -> DataFrame:
    """id, n_links, component_id of distinct vectors (id, embedding, dim, least, n)."""
    theta = acos(how.limit)
    models = models_for(vectors, how)
    most = {f: max((m.most_apart[f] for m in models.values()), default=0) for f in (0.5, 1.0, 1.5, 2.0)}
    codes = written(coded(vectors, models))
    inside = _balls(vectors, codes, most[0.5], theta / 2)
    member = written(vectors.select("id", "n", "least").join(inside, "id", "left").select("id", "n", "least", F.coalesce("ball", "id").alias("ball"), F.coalesce(_angle(F.col("cosine")), F.lit(0.0)).alias("r")))
    balls = written(member.groupBy("ball").agg(F.sum("n").alias("size"), F.max("r").alias("radius"), F.count("*").alias("members")))
    pairs = with_cosine(_ball_pairs(codes, inside, most), vectors, "a", "b")
    both = written(pairs.select("a", "b", "cosine").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")))
    a = balls.select(F.col("ball").alias("a"), F.col("radius").alias("r_a"), F.col("members").alias("n_a"))
    b = balls.select(F.col("ball").alias("b"), F.col("radius").alias("r_b"), F.col("members").alias("n_b"), F.col("size").alias("size_b"))
    alone = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    angle, reach = _angle(F.col("cosine")), F.col("r_a") + F.col("r_b")
    whole = F.when(alone, F.col("cosine") >= how.limit).otherwise(angle + reach <= theta - SLACK)
    judged = written(both.join(a, "a").join(b, "b").withColumns({"all": whole, "some": ~alone & ~whole & (angle - reach <= theta + SLACK)}).filter("all or some"))
    sure = judged.filter("all").select("a", "b", "size_b")
    # Members of one ball against the other's centre; where its radius leaves it open, against its members.
    one = member.select(F.col("id").alias("x"), F.col("ball").alias("a"))
    met = with_cosine(judged.filter("some").select("a", "b", "r_b", "n_b", "size_b").join(one, "a"), vectors, "x", "b")
    whole = F.when(F.col("n_b") == 1, F.col("cosine") >= how.limit).otherwise(_angle(F.col("cosine")) + F.col("r_b") <= theta - SLACK)
    met = written(met.withColumns({"all": whole, "some": (F.col("n_b") > 1) & ~whole & (_angle(F.col("cosine")) - F.col("r_b") <= theta + SLACK)}).filter("all or some"))
    other = member.select(F.col("id").alias("y"), F.col("ball").alias("b"), F.col("n").alias("n_y"))
    close = with_cosine(met.filter("some").select("a", "b", "x").join(other, "b"), vectors, "x", "y").filter(F.col("cosine") >= how.limit)
    by_member = written(met.filter("all").select("a", "b", "x", F.col("size_b").alias("k")).unionByName(close.groupBy("a", "b", "x").agg(F.sum("n_y").alias("k"))))
    edges = sure.select("a", "b").unionByName(by_member.select("a", "b")).filter("a < b").distinct()
    root = components(edges)
    counts = sure.groupBy(F.col("a").alias("ball")).agg(F.sum("size_b").alias("k_ball"))
    extra = by_member.groupBy(F.col("x").alias("id")).agg(F.sum("k").alias("k_own"))
    rooted = member.join(balls.select("ball", "size"), "ball").join(root.select(F.col("id").alias("ball"), "root"), "ball", "left").withColumn("root", F.coalesce("root", "ball"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    zero = F.lit(0).cast("long")
    every = rooted.join(least, "root").join(counts, "ball", "left").join(extra, "id", "left")
    return every.select("id", (F.col("size") - 1 + F.coalesce("k_ball", zero) + F.coalesce("k_own", zero)).alias("n_links"), "component_id")
