"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

A window of text is embedded by the random walk of Chakraborty, Goldenberg and Koucky (2016): at step j it puts out the
character it stands on, and moves on if the j-th random bit of that character says so. Two windows at a small edit
distance give walks that meet again after an edit, so their outputs are at a small Hamming distance, and agree in
stretches. Each of several walks is sampled at many stretches of steps; windows with an equal sample are candidates.

Window sizes follow the items' lengths by factors of 1.25: three quarters of a class's least length. Documents have a
window at every stride-th character, a quarter of the length at most, and items one at each offset under the stride, so
an occurrence of an item holds a document window whose start is one of the item's. All window sizes share the walks, as
a shorter window's walk is the start of a longer one's. A candidate says which item begins where; there, the item's
least edit distance to any substring (Myers' bit-parallel form, semi-global) decides, up to max_edits of its length.

target_recall sets how many walks there are, from the measured share of items with max_edits edits that one walk misses.

The benchmark is a stated query set. It is broadcast in blocks of at most block_chars characters, one pass over the
documents for each block; documents are never shuffled.

Defined results: A-Z count as a-z and each white-space character as a space; offsets are code points of the whole text,
end exclusive. Null and empty texts hold nothing; null and empty items are never reported. Items of under ten code points
allow no edit. An item that a document holds several times is reported once: the smallest distance, then the first place.
Repeated document rows are reported each; an empty table on either side gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset.llm.common import id_and_text, map_arrow, slices

SHORT = 64  # items under so many characters have windows of nearly their whole length, and more samples
LONGEST = 1024  # characters; longer items have windows of this length's class
STRETCH, EVERY = 20, 5  # steps in a sample, and from one sample's start to the next one's
MOST_SAMPLES = 24  # about, of a window by one walk
MISSED = 0.2  # by one walk, of items with a tenth of their characters edited (measured, the worst length class)


@dataclass(frozen=True)
class Search:
    max_edits: float = 0.1
    target_recall: float = 0.95
    seed: int = 20160618

    @property
    def walks(self) -> int:
        return max(2, math.ceil(math.log(1 - self.target_recall) / math.log(MISSED)))


@dataclass(frozen=True)
class Size:
    """The windows of items of least to most characters; samples are (first step, number of steps)."""

    least: int
    most: float
    window: int
    stride: int
    samples: tuple[tuple[int, int], ...]


def sizes_for(search: Search) -> list[Size]:
    out, least = [], 1
    while least <= LONGEST:
        after = max(least + 1, int(least * 1.25))
        stride = 1 << max(0, (least // (4 if least >= SHORT else 8)).bit_length() - 1)
        edits = int(search.max_edits * (after - 1))
        window = least - stride + 1
        if not edits:
            samples = [(0, window)]  # a walk of so many steps can't leave the window: no unedited occurrence is missed
        elif least < SHORT:
            run = (least - edits) // (edits + 1)  # characters without an edit, somewhere
            stretch = max(5, 2 * run - 2)
            samples = [(b, stretch) for b in range(0, max(1, 2 * window - stretch), 2)]
        else:
            window = min(window, 3 * least // 4)
            steps, every = int(1.7 * window), EVERY
            while steps > MOST_SAMPLES * every:
                every *= 2
            samples = [(b, STRETCH) for b in range(0, max(1, steps - STRETCH + 1), every)]
        out.append(Size(least, after if after <= LONGEST else math.inf, window, stride, tuple(samples)))
        least = after
    return out


FOLD = np.arange(0x110000, dtype="<u4")
FOLD[65:91] += 32
FOLD[[9, 10, 11, 12, 13]] = 32


def folded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return FOLD[points]


def _text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


_BASE = 0x9E3779B97F4A7C15


def _bits(search: Search, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier and the addend that make each step's bit of a character."""
    random = np.random.default_rng([search.seed, walk])
    return random.integers(0, 128, 2 * LONGEST, dtype=np.uint8) * np.uint8(2) + np.uint8(1), random.integers(0, 256, 2 * LONGEST, dtype=np.uint8)


def walked(symbols: np.ndarray, places: np.ndarray, at: np.ndarray, wanted: dict[tuple[int, int], int], search: Search, walk: int):
    """For each sample in wanted (sample: stride): the sample, which of the walks took it, and 64-bit hashes of what they put out.

    Walks begin at the symbols' positions at, places characters from their text's start; a sample is taken by those whose
    place is a multiple of its stride. The hash of a stretch is the difference of two running hashes."""
    multipliers, addends = _bits(search, walk)
    ends: dict[int, list[tuple[int, int]]] = {}
    for b, n in wanted:
        ends.setdefault(b + n, []).append((b, n))
    begins, last = {b for b, _ in wanted}, max(ends, default=0)
    needed = np.zeros(last + 1, np.int64)  # the stride from each step on
    for (b, n), stride in wanted.items():
        needed[: b + n + 1] = np.where(needed[: b + n + 1] == 0, stride, np.minimum(needed[: b + n + 1], stride))
    rows, now, total, kept, stride = np.arange(len(at)), at.astype(np.int32), np.zeros(len(at), np.uint64), {}, 0
    for j in range(last + 1):
        if needed[j] > stride:
            stride = int(needed[j])
            here = np.flatnonzero(places[rows] % stride == 0)
            rows, now, total = rows[here], now[here], total[here]
            kept = {b: x[here] for b, x in kept.items()}
        for b, n in ends.get(j, ()):
            sums = total - kept[b] * np.uint64(pow(_BASE, n, 1 << 64))
            if wanted[b, n] > stride:
                here = np.flatnonzero(places[rows] % wanted[b, n] == 0)
                yield (b, n), rows[here], sums[here]
            else:
                yield (b, n), rows, sums
        if j in begins:
            kept[j] = total.copy()
        if j < last:
            c = symbols[now]
            total *= np.uint64(_BASE)
            total += c
            now += (c * multipliers[j] + addends[j]) >> 7


def edit_search(pattern: str, text: str) -> tuple[int, int]:
    """The pattern's least edit distance to any substring of the text, and that substring's end (the first such)."""
    m = len(pattern)
    if not m:
        return 0, 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(across | plus)), plus & across
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~((eq | minus) | up)), up & (eq | minus)
        if score < best:
            best, end = score, at
    return best, end


def edit_start(pattern: str, text: str) -> int:
    """Where the shortest suffix of text at the least distance to the pattern starts: the search backwards, tied to the end."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(reversed(pattern)):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, start = m, len(text)
    for n, c in enumerate(reversed(text), 1):
        eq = masks.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(across | plus)), plus & across
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | (full & ~((eq | minus) | up)), up & (eq | minus)
        if score < best:
            best, start = score, len(text) - n
    return start


def _runs(points: np.ndarray) -> np.ndarray:
    """A 12-bit code of the three characters from each place on."""
    return ((points[:-2] * 961 + points[1:-1] * 31 + points[2:]) & 4095).astype(np.int64)


class Index:
    """The samples of one block of items, by walk and sample: sorted hashes and whose they are."""

    def __init__(self, items: list[tuple[int, str]], search: Search = Search()):
        self.search = search
        points = [folded(t) for _, t in items]
        self.items = [(i, _text(p)) for (i, _), p in zip(items, points)]
        self.codes = [_runs(p) for p in points]
        sizes = sizes_for(search)
        of = [next((k for k, z in enumerate(sizes) if z.least <= len(p) <= z.most - 1), None) for p in points]
        self.wanted: dict[tuple[int, int], int] = {}
        parts, begins, owner, offset, by_size, at = [], [], [], [], {}, 0
        for n, (p, k) in enumerate(zip(points, of)):
            if k is None:
                continue
            z = sizes[k]
            by_size.setdefault(k, []).append(np.arange(len(owner), len(owner) + z.stride))
            owner += [n] * z.stride
            offset += range(z.stride)
            begins += range(at, at + z.stride)
            parts += [p.astype(np.uint8), np.zeros(2 * LONGEST + 1, np.uint8)]
            at += len(p) + 2 * LONGEST + 1
            for sample in z.samples:
                self.wanted[sample] = min(self.wanted.get(sample, z.stride), z.stride)
        self.owner, self.offset, begins = np.array(owner, np.int32), np.array(offset, np.int32), np.array(begins, np.int64)
        self.stride, self.shortest = min((sizes[k].stride for k in by_size), default=1), min((sizes[k].window for k in by_size), default=1)
        self.tables: dict[tuple[int, tuple[int, int]], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if not by_size:
            return
        symbols = np.concatenate(parts)
        uses = {s: np.concatenate([x for k, lists in by_size.items() if s in sizes[k].samples for x in lists]) for s in self.wanted}
        none = np.zeros(len(owner), np.int64)
        for walk in range(search.walks):
            for sample, _, sums in walked(symbols, none, begins, self.wanted, search, walk):
                entries = uses[sample]
                order = np.argsort(sums[entries], kind="stable")
                bits = min(20, max(10, (8 * len(entries)).bit_length()))
                present = np.zeros(1 << bits, bool)
                present[(sums[entries] >> np.uint64(64 - bits)).astype(np.int64)] = True
                self.tables[walk, sample] = sums[entries][order], entries[order].astype(np.int32), present

    def leaks(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item_id, start, end, distance) of the items it holds."""
        points = [folded(t or "") for t in texts]
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        gap = np.zeros(64, np.uint8)
        parts, starts, places, docs, at = [], [], [], [], 0
        for d, p in enumerate(points):
            if len(p) >= self.shortest:
                x = np.arange(0, len(p) - self.shortest + 1, self.stride)
                starts.append(x + at)
                places.append(x)
                docs.append(np.full(len(x), d))
                parts += [p.astype(np.uint8), gap]
                at += len(p) + len(gap)
        if not starts or not self.tables:
            return [[] for _ in texts]
        starts, places, docs = np.concatenate(starts), np.concatenate(places), np.concatenate(docs)
        symbols = np.concatenate([*parts, np.zeros(2 * LONGEST + 1, np.uint8)])
        guesses = []
        for walk in range(self.search.walks):
            for sample, rows, sums in walked(symbols, places, starts, self.wanted, self.search, walk):
                listed, entries, present = self.tables[walk, sample]
                hit = np.flatnonzero(present[(sums >> np.uint64(64 - len(present).bit_length() + 1)).astype(np.int64)])
                a, b = np.searchsorted(listed, sums[hit], "left"), np.searchsorted(listed, sums[hit], "right")
                n = b - a
                if not n.any():
                    continue
                r = np.repeat(rows[hit], n)
                e = entries[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                guesses.append((docs[r] * len(self.items) + self.owner[e] << 32) + places[r] - self.offset[e] + LONGEST)
        if guesses:
            self._verify(points, np.unique(np.concatenate(guesses)), found)
        return [[(self.items[n][0], *x) for n, x in sorted(f.items())] for f in found]

    def _verify(self, points: list[np.ndarray], guesses: np.ndarray, found: list[dict]) -> None:
        """guesses: text and item, times 2**32, plus where in the text the item may begin (by LONGEST more), in order."""
        there, last, text_no, codes, tried = np.zeros(4096, bool), -1, -1, np.empty(0, np.int64), 0
        for pair, start in zip((guesses >> 32).tolist(), ((guesses & 0xFFFFFFFF) - LONGEST).tolist()):
            if pair != last:
                d, n = divmod(pair, len(self.items))
                item, p = self.items[n][1], points[d]
                m = len(item)
                slack = int(self.search.max_edits * m)
                if d != text_no:
                    text_no, codes = d, _runs(p)
            elif start - tried <= slack // 2:  # the place tried before reaches as far, to within what its margin adds
                continue
            last, tried = pair, start
            lo, hi = max(0, start - slack), min(len(p), start + m + 2 * slack)
            if slack:
                # An edit changes at most three of the item's runs of three characters: the others stand in the text.
                here = codes[lo : max(lo, hi - 2)]
                there[here] = True
                held = np.count_nonzero(there[self.codes[n]])
                there[here] = False
                if held < m - 2 - 3 * slack:
                    continue
            text = _text(p[lo:hi])
            exact = text.find(item)
            if exact < 0 and not slack:
                continue
            distance, end = (0, exact + m) if exact >= 0 else edit_search(item, text)
            if distance <= slack:
                begin = lo + (exact if exact >= 0 else edit_start(item, text[:end]))
                old = found[d].get(n)
                if old is None or (distance, begin) < (old[2], old[0]):
                    found[d][n] = (begin, lo + end, distance)


def blocks(benchmark: DataFrame, block_chars: int = 500_000, id_col: str = "item_id", text_col: str = "text"):
    """The items in blocks of bounded size, read from one partition of the table after the other."""
    block, size = [], 0
    items = benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    for item, text in items.toLocalIterator():
        if text:
            if block and size + len(text) > block_chars:
                yield block
                block, size = [], 0
            block.append((item, text))
            size += len(text)
    if block:
        yield block


SCHEMA = "doc_id long, item_id long, start long, end long, distance long"


def leaks(docs: DataFrame, benchmark: DataFrame, search: Search = Search(), block_chars: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA: a row for each document and item that it holds."""
    texts = id_and_text(docs, id_col, text_col)
    out = None
    for block in blocks(benchmark, block_chars):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, search))

        def rows(ids, batch, index=index):
            flat = [(i, *x) for i, found in zip(ids, index.value.leaks(batch)) for x in found]
            return [list(c) for c in zip(*flat)] if flat else [[] for _ in range(5)]

        part = map_arrow(texts, SCHEMA, rows)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def without_leaks(docs: DataFrame, benchmark: DataFrame, search: Search = Search(), block_chars: int = 500_000) -> DataFrame:
    """The pipeline's form: the documents that hold no item, with the columns that came in."""
    at = docs.columns.index("text")
    for block in blocks(benchmark, block_chars):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, search))

        def run(batches, index=index):
            for b in batches:
                for part in slices(b):
                    yield part.filter(pa.array([not x for x in index.value.leaks(part.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
