"""Grouping of spelling variants by full neighbourhood generation.

Every word emits all distinct strings that one deletion, replacement or insertion over the observed alphabet makes of it;
those that equal a word of the vocabulary, found by a hash join, are its near words. No distance is computed.

A word of length L over an alphabet of A characters has some (2 * L + 1) * A neighbours, nearly all of them no words. Their
polynomial hashes come from prefix and suffix hashes of the word, a few numpy operations for each; only those whose hash
the vocabulary's filter knows are written out as strings and joined. The filter is a bitmap of FILTER_BITS bits with two
bits for each word, a fixed 16 MB whatever the vocabulary's size: it loses nothing, and in a vocabulary of hundreds of
millions of words it only stops sparing rows.

Defined results: null and empty texts have no words. A null id counts as an empty one in the hash that decides deletions.
Rows with equal ids and texts count each. Very long runs are words like others. Other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanset.llm.common import id_and_text, slices, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR, THINNED = 7, 2, 10, 31
FILTER_BITS = 27
BASE = 0x9E3779B97F4A7C15  # odd, so that products modulo 2 ** 64 lose nothing
CELLS = 1 << 19  # neighbours that a task looks at together


def thinned(doc_id: int | None, run: str) -> str:
    """The run, without one of its characters if the hash of id and run is a multiple of THINNED."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % THINNED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, flush_at: int = 200_000, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts. Tasks count first and pass a row for each word on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows():
            pairs = list(counts.items())
            counts.clear()
            for at in range(0, len(pairs), 50_000):
                part = pairs[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    # bytes.lower() knows ASCII only. Equal runs of a document are thinned alike.
                    own = Counter(RUN.findall(text.encode().lower().decode())) if text else {}
                    for w, n in own.items():
                        if len(w) >= least_length:
                            w = thinned(doc_id, w)
                            if len(w) >= least_length:
                                counts[w] += n
                    if len(counts) > flush_at:
                        yield from rows()
        yield from rows()

    found = id_and_text(docs).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _codes(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, BASE, np.uint64), dtype=np.uint64)])


def _ends(codes: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes and all suffixes of each row. The hash of x + y is hash(x) * BASE ** len(y) + hash(y)."""
    rows, n = codes.shape
    before, after = np.zeros((rows, n + 1), np.uint64), np.zeros((rows, n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            before[:, i + 1] = before[:, i] * power[1] + codes[:, i]
            after[:, n - 1 - i] = codes[:, n - 1 - i] * power[i] + after[:, n - i]
    return before, after


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the filter, of mixed bits of a hash."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(29))
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return h & mask, (h >> np.uint64(FILTER_BITS)) & mask


def word_hashes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for n in {len(w) for w in words}:
        at = [i for i, w in enumerate(words) if len(w) == n]
        out[at] = _ends(_codes([words[i] for i in at]), _powers(n))[0][:, n]
    return out


def neighbours(words: list[str], alphabet: np.ndarray, known) -> Iterator[tuple[int, str]]:
    """(place of the word, neighbour) for words of one length: all distinct ones whose hash known() takes."""
    n = len(words[0])
    step = max(1, CELLS // (len(alphabet) * (n + 1)))
    for first in range(0, len(words), step):
        part = words[first : first + step]
        codes, power = _codes(part), _powers(n + 1)
        before, after = _ends(codes, power)
        width = max(1, CELLS // (len(part) * len(alphabet)))
        seen: set[tuple[int, str]] = set()
        with np.errstate(over="ignore"):
            for a in range(0, n + 1, width):
                i = np.arange(a, min(a + width, n + 1))
                r = i[i < n]
                if len(r):
                    hits = np.argwhere(known(before[:, r] * power[n - 1 - r] + after[:, r + 1]))
                    seen.update((int(w), part[w][: r[j]] + part[w][r[j] + 1 :]) for w, j in hits)
                    put = before[:, r, None] * np.uint64(BASE) + alphabet
                    hits = np.argwhere(known(put * power[n - 1 - r][:, None] + after[:, r + 1, None]) & (codes[:, r, None] != alphabet))
                    seen.update((int(w), part[w][: r[j]] + chr(alphabet[c]) + part[w][r[j] + 1 :]) for w, j, c in hits)
                put = before[:, i, None] * np.uint64(BASE) + alphabet
                hits = np.argwhere(known(put * power[n - i][:, None] + after[:, i, None]))
                seen.update((int(w), part[w][: i[j]] + chr(alphabet[c]) + part[w][i[j] :]) for w, j, c in hits)
        yield from ((first + w, s) for w, s in seen)


def _filter(spark: SparkSession, words: DataFrame):
    """The vocabulary's filter as a broadcast array of bytes; tasks set bits, and bitmaps of 4 KB come together by a union."""

    def run(batches):
        for batch in batches:
            one, two = _bits(word_hashes(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([one, two]).astype(np.int64))], ["bit"])

    bits = words.select("word").mapInArrow(run, "bit long")
    part = F.floor(F.col("bit") / 32768)
    maps = bits.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("map")).collect()
    held = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for m in maps:
        held[m.part * 4096 : (m.part + 1) * 4096] = np.frombuffer(m.map, np.uint8)
    return spark.sparkContext.broadcast(held)


def near_words(words: DataFrame) -> DataFrame:
    """word, near: each pair of words that one inserted, deleted or replaced character makes equal, in both directions."""
    spark = words.sparkSession
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().filter("c <> ''").collect()
    alphabet = np.array(sorted(ord(r.c) for r in letters), np.uint64)
    held = _filter(spark, words)

    def known(h: np.ndarray) -> np.ndarray:
        bitmap = held.value
        one, two = _bits(h)
        found = (bitmap[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8)) & 1
        at = np.nonzero(found)
        out = np.zeros(h.shape, bool)
        out[at] = (bitmap[two[at] >> np.uint64(3)] >> (two[at] & np.uint64(7)).astype(np.uint8)) & 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([s for _, s in found], pa.string())], ["word", "near"])

        for batch in batches:
            listed = batch.column(0).to_pylist()
            for n in sorted({len(w) for w in listed}):
                same, out, size = [w for w in listed if len(w) == n], [], 0
                for w, s in neighbours(same, alphabet, known):
                    out.append((same[w], s))
                    size += 2 * n
                    if size > 1 << 20:
                        yield rows(out)
                        out, size = [], 0
                if out:
                    yield rows(out)

    # Few bytes make many neighbours, so the words are dealt out to a set number of tasks.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    emitted = words.select("word").repartition(parts, "word").mapInArrow(run, "word string, near string") if len(alphabet) else words.select("word", F.col("word").alias("near")).filter("false")
    return emitted.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def roots(forms: DataFrame, rounds: int = 6) -> DataFrame:
    """word, root: the end of each word's chain of forms. A form is FORM_FACTOR times as frequent as its word, so that counts
    of 64 bits allow chains of 18; each round doubles the reach."""
    now = written(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if after.filter("moved").isEmpty():
            break
    return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary."""
    words = written(vocabulary(docs))
    pairs = written(near_words(words))
    top = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("top"))
    judged = words.join(top.select("word", "n_near", F.col("top.near").alias("form"), (-F.col("top.n")).alias("form_n")), "word", "left")
    takes = F.col("form_n") >= FORM_FACTOR * F.col("n")
    judged = written(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("form")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n")))
    ends = roots(judged.filter("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
