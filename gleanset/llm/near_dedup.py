"""MinHash near-dedup with odd sketches.

A document's set is its distinct word shingles, by their 64-bit hashes; rows with equal sets (equal 64-bit hashes of the
sorted hashes) are one class from the start. Each class gets MinHash samples. Groups of them are its buckets; others, of
one permutation, are folded into an odd sketch, a bitmap of parities, whose XOR with another one's has a population count
that tells high similarities apart sharply. Members of a bucket are candidates (near.py says which); sizes and sketches
sort out most, and full sets confirm each link. Components are distributed.

Defined results: words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text of fewer words than a shingle has the whole
sequence as one shingle; null, empty and blank texts have an empty set and are linked with nothing, each its own
component. component_id is the smallest id of the component; a null id is in no comparison and keeps null. Repeated rows
are in one class; each gets its row. Whole texts are read; other columns aren't.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanset.llm.common import forget, id_and_text, keyed, map_arrow, words, written
from gleanset.llm.near import link

SKETCH_BITS = 2048
SAMPLE_BITS = 12  # one-permutation MinHash: the least hash in each of 2**12 ranges of hashes
WORDS = SKETCH_BITS // 64


@dataclass(frozen=True)
class Near:
    shingle: int = 4
    percent: int = 80
    bands: int = 30
    rows: int = 6  # 30 bands of 6 miss 0.01 % of the pairs at a similarity of 0.8
    deviations: float = 4.5  # from what two sketches at the least similarity are expected to differ by
    seed: int = 42


class _Hashes(dict):
    """Words to 64-bit hashes; a bounded number is kept."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000:
            self[word] = found
        return found


_HASHES = _Hashes()
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted."""
    listed = words(text)
    if not listed:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, listed), np.uint64, len(listed))
    n = min(size, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total = _mixed(total * _MULTIPLIER + h[i : len(h) - n + 1 + i])
    return np.unique(total)


def _set_id(items: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(items.tobytes())
    return h - (1 << 64) if h >> 63 else h


def signature(items: np.ndarray, near: Near, multipliers: np.ndarray) -> np.ndarray:
    """MinHash samples: the least of items times each odd multiplier, modulo 2**64."""
    out = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 512):
        np.minimum(out, (items[at : at + 512, None] * multipliers).min(axis=0), out=out)
    return out


def odd_sketch(items: np.ndarray) -> np.ndarray:
    """The parities of how many MinHash samples of sorted items fall on each bit, as 64-bit words.

    The samples are the least item in each range of hashes (one permutation), so a small set is sampled nearly whole."""
    part = items >> np.uint64(64 - SAMPLE_BITS)
    samples = items[np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))]
    bits = _mixed(samples * _MULTIPLIER) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def signed(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, n_shingles, id (of the set; null if empty), buckets and sketch, for each row."""
    multipliers = np.random.default_rng(near.seed).integers(0, 1 << 63, near.bands * near.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    band = np.arange(1, near.bands + 1, dtype=np.uint64)

    def rows(ids, texts):
        sizes, sets, buckets, sketches = [], [], [], []
        for text in texts:
            items = shingle_set(text, near.shingle)
            sizes.append(len(items))
            if not len(items):
                sets.append(None)
                buckets.append(items)
                sketches.append(items)
                continue
            sets.append(_set_id(items))
            total = band
            for r in signature(items, near, multipliers).reshape(near.bands, near.rows).T:
                total = _mixed(total * _MULTIPLIER + r)
            buckets.append(total)
            sketches.append(odd_sketch(items))
        return [ids, sizes, sets, _lists(buckets), _lists(sketches)]

    return map_arrow(docs, "doc_id long, n_shingles long, id long, buckets array<long>, sketch array<long>", rows)


def _limit(near: Near, size: Column) -> Column:
    """In how many bits the sketches of two sets of such a size differ at most, if they may be linked.

    At the least similarity, the union's size, and from it the samples that both or one of them have, are known up to their
    deviation. The samples that only one has fall on the bits of the XOR, at most one each."""
    least, ranges = near.percent / 100, float(1 << SAMPLE_BITS)
    taken = lambda n: ranges * (1 - F.exp(-n / ranges))
    union = 2 * size / (1 + least)
    differ = 2 * taken(size) - 2 * least * taken(union)
    spread = 2 * F.sqrt(F.greatest(taken(union) * (1 - taken(union) / union) * least * (1 - least), F.lit(0.0)))
    seen = SKETCH_BITS / 2 * (1 - F.exp(-2 * differ / SKETCH_BITS))
    deviation = F.sqrt(F.pow(spread * F.exp(-2 * differ / SKETCH_BITS), F.lit(2.0)) + seen)
    return F.least(differ + near.deviations * spread + 2, seen + near.deviations * deviation)


def _may(near: Near):
    """Whether sizes and sketches allow two sets to be linked. Short: it runs for each pair, and longer code isn't compiled."""

    def may(left: str, right: str) -> Column:
        col = lambda c: (F.col(f"{left}.{c}"), F.col(f"{right}.{c}"))
        odd = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in (col(f"sketch{i}") for i in range(WORDS))), F.lit(0))
        return (100 * F.least(*col("n_shingles")) >= near.percent * F.greatest(*col("n_shingles"))) & (odd <= F.greatest(*col("limit")))

    return may


def near_duplicates(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) for each row."""
    texts = id_and_text(docs, id_col, text_col)
    rows = written(signed(texts, near))
    sets = rows.filter("id is not null and doc_id is not null")
    classes = written(sets.groupBy("id").agg(F.min("doc_id").alias("first_id")))
    own = sets.join(classes, "id").filter("doc_id = first_id")
    members = own.select("id", F.explode("buckets").alias("bucket")).distinct()

    sources: list[DataFrame] = []

    def heads_of(ids: DataFrame) -> DataFrame:
        # The texts of what shares a bucket, so that no later step reads the others.
        wanted = written(classes.join(ids, "id", "left_semi").select(F.col("first_id").alias("doc_id")).distinct())
        sources.append(written(texts.join(keyed(wanted), "doc_id", "left_semi")))
        forget(wanted)
        return own.join(ids, "id", "left_semi").dropDuplicates(["id"]).select("id", "n_shingles", _limit(near, F.col("n_shingles")).alias("limit"), *[F.col("sketch")[i].alias(f"sketch{i}") for i in range(WORDS)])

    def items(_, found):
        full = [shingle_set(t, near.shingle) for t in found]
        return [[_set_id(s) for s in full], _lists(full)]

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs)
        ids = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        wanted = written(classes.join(keyed(ids), "id", "left_semi").select(F.col("first_id").alias("doc_id")))
        full = map_arrow(sources[0].join(keyed(wanted), "doc_id", "left_semi"), "id long, items array<long>", items)
        sets = written(full.join(keyed(ids), "id", "left_semi").dropDuplicates(["id"]))
        both = pairs.join(sets.alias("x"), F.col("a") == F.col("x.id")).join(sets.alias("y"), F.col("b") == F.col("y.id"))
        both = both.select("a", "b", (F.size("x.items") + F.size("y.items")).alias("sum"), F.size(F.array_intersect("x.items", "y.items")).alias("both"))
        found = written(both.filter(100 * F.col("both") >= near.percent * (F.col("sum") - F.col("both"))).select("a", "b"))
        forget(pairs, ids, wanted, sets)
        return found

    roots = link(members, heads_of, _may(near), verify)
    forget(*sources)
    least = classes.join(roots, "id").groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = roots.join(least, "root").select("id", "component_id")
    named = classes.join(linked, "id", "left").select("id", F.coalesce("component_id", "first_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("id")).alias("id")).join(named, "id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_first(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """The pipeline's form: one document of each component, with the columns that came in. Rows without an id stay."""
    found = near_duplicates(docs, near)
    gone = found.filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
