"""Helpers that the training-data operators share: words, Arrow maps and intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanset.sources.tables import forget, free_shuffles, written  # noqa: F401

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased. bytes.lower() and bytes.split() know ASCII only, as the contracts ask."""
    return text.encode().lower().split() if text else []


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns, under fixed names: other columns can't clash and aren't read."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded rows and bytes, so that few Python objects exist at a time; one row at least."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(c.type):
            size += 8 * pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(total, before + SLICE_BYTES, "right"))))
        yield batch.slice(at, end - at)
        at = end


def map_arrow(df: DataFrame, schema: str, rows: Callable[..., Iterator[list] | list]) -> DataFrame:
    """Each Arrow batch's columns as Python lists through rows(), which returns the output columns as lists or arrays."""
    out = pa.schema([(f.name, _arrow_type(f.dataType)) for f in _struct(schema)])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                cols = rows(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(cols, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def _struct(schema: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema)


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def keyed(keys: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """A written table of one long column, marked for broadcast if it has max_rows at most (some 8 MB), else for a hashed join."""
    return keys.hint("broadcast" if keys.count() <= max_rows else "shuffle_hash")


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """True for rows that crc32(id as text) leaves out of training; a null id is in training."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


def word_counts(docs: DataFrame, keep: Callable[[str], bool] | None = None, flush_at: int = 400_000) -> DataFrame:
    """(word, n): how often each lower-cased word stands in all texts. Tasks count first and pass a row for each word on."""
    from collections import Counter

    def run(batches):
        counts: Counter = Counter()

        def rows():
            pairs = [(w, n) for w, n in ((w.decode(), n) for w, n in counts.items()) if keep is None or keep(w)]
            counts.clear()
            for at in range(0, len(pairs), 50_000):
                part = pairs[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words(text))
                if len(counts) > flush_at:
                    yield from rows()
        yield from rows()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, size: int) -> list[tuple[str, int]]:
    """(word, n) of the size most frequent words (all, if there are fewer), most frequent first, ties by text.

    Which of the words with equal n make the limit full is decided by a hash of the word. Histograms of n on a log scale,
    of n, and of the hash say where the limit falls, so that no task or driver gets more than about size words."""
    step, part = F.floor(F.log2("n") * 16), F.pmod(F.xxhash64("word"), F.lit(1 << 16))

    def cut(rows: DataFrame, key: Column, room: int) -> tuple[int | None, int]:
        """The key where the room ends when rows are taken from the largest key on, and what is left of it there."""
        for r in sorted(rows.groupBy(key.alias("key")).count().collect(), key=lambda r: -r.key):
            if r["count"] > room:
                return r.key, room
            room -= r["count"]
        return None, room

    at, room = cut(counts, step, size)
    if at is None:
        found = counts
    else:
        edge = counts.filter(step == at)
        n, room = cut(edge, F.col("n"), room)
        tier = edge.filter(F.col("n") == n)
        h, room = cut(tier, part, room)
        last = tier.filter(part == h).orderBy(F.xxhash64("word"), "word").limit(room)
        found = counts.filter((step > at) | (step == at) & ((F.col("n") > n) | (F.col("n") == n) & (part > h))).select("word", "n").unionByName(last.select("word", "n"))
    found = found.select("word", "n").toArrow()
    return sorted(zip(found.column("word").to_pylist(), found.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))


def bounded_sample(rows: DataFrame, key: Column, max_rows: int) -> DataFrame:
    """All rows if there are at most max_rows, else about as many, by a hash of the key: no sort, and the same on each run."""
    n = rows.count()
    return rows if n <= max_rows else rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
