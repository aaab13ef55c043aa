"""Catalog names near a text: the generators of match candidates, exact to their thresholds and with their own top ranks.

The measures are ratios of common subsequences with limits of 0.42 to 0.58. Random names often reach these (on the tests'
2,000 names a third of all pairs pass the first-token limit), and a common subsequence of half the characters needs no
common pair of neighbours, so no index of character groups keeps all links and still leaves out most pairs. What bounds
the work is the number of ranks: each generator gives six names a form. So distinct forms meet the catalog in blocks, by a cogroup
on (slice of forms, block of names); a task compares a form with a block's names bit-parallel, all at once, and passes on
each generator's best ranks of the block alone. No pair is a row. The blocks' ranks are merged by a window.

Forms cost in proportion to their distinct number and to the catalog; memory is that of a slice and a block. A name's rows
are in one block, so that a block's rank of a name is never below its rank in the catalog.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanset.functions import similarity as s
from gleanset.functions import text as t
from gleanset.functions.bitparallel import Compared, Strings

SLICE_FORMS, BLOCK_NAMES = 512, 8192
DIGITS = 12
GENERATORS = ("search", "prefix", "first", "consonant", "inner")
SCHEMA = "form string, variant string, generator string, name string, score double, place long"


@dataclass(frozen=True)
class Limits:
    """Fixed values of the generators."""

    ranks: int = 6
    search_ranks: int = 16
    search: float = 0.5
    first: float = 0.42
    first_name: float = 0.45
    consonant: float = 0.5
    consonant_name: float = 0.45
    consonant_weight: float = 0.96
    inner: float = 0.58
    inner_name: float = 0.42
    length_gap: int = 6


class Block:
    """Some names of the catalog. rows: (name, name_normalized, normalized, place), all rows of a name."""

    def __init__(self, rows: list[tuple[str, str, str, int]], how: Limits):
        self.how = how
        self.names = sorted({r[0] for r in rows})
        at = {n: i for i, n in enumerate(self.names)}
        self.name = np.array([at[r[0]] for r in rows])
        self.place = np.array([r[3] for r in rows], np.int64)
        whole = dict.fromkeys(self.names, "")
        whole |= {r[0]: r[1] for r in rows}
        self.whole = [whole[n].split() for n in self.names]
        joined = ["".join(w) for w in self.whole]
        self.joined, self.joined_bones = Strings(joined), Compared(joined)
        parts = [r[2].split() for r in rows]
        listed = sorted({w for ws in (*parts, *self.whole) for w in ws})
        number = {w: i for i, w in enumerate(listed)}
        self.tokens = Compared(listed)
        self.name_tokens, self.row_tokens = self._numbers(self.whole, number), self._numbers(parts, number)
        self.first_size = np.array([len(p[0]) if p else 0 for p in parts])
        self.first_bones = self.tokens.bones.size[np.maximum(self.row_tokens[:, 0], 0)]
        self.row_joined = Compared(["".join(p) for p in parts])
        self.several = np.array([len(p) > 1 for p in parts])
        self.long_token = np.array([len(w) >= 5 for w in listed], bool)
        self._token: dict[str, np.ndarray] = {}
        self._consonant: dict[str, np.ndarray] = {}

    @staticmethod
    def _numbers(lists: list[list[str]], number: dict[str, int]) -> np.ndarray:
        out = np.full((len(lists), max(1, max(map(len, lists), default=1))), -1)
        for i, ws in enumerate(lists):
            out[i, : len(ws)] = [number[w] for w in ws]
        return out

    def token(self, text: str) -> np.ndarray:
        """Similarity of a token with each of the block's; kept for the forms of a slice, which share tokens."""
        if text not in self._token:
            self._token[text], self._consonant[text] = self.tokens.token(text), self.tokens.consonant(text)
        return self._token[text]

    def name_similarity(self, query: str) -> np.ndarray:
        """s.name_similarity(query, name) for each name, rounded."""
        q, joined = query.split(), "".join(query.split())
        words = np.array([len(w) for w in self.whole])
        total = np.zeros(len(self.names))
        for k, w in enumerate(q[: self.name_tokens.shape[1]]):
            at = self.name_tokens[:, k]
            total += np.where(at >= 0, self.token(w)[np.maximum(at, 0)], 0.0)
        by_token = total / np.maximum(np.minimum(len(q), words) + 0.35 * np.maximum(words - len(q), 0) + 0.5 * np.maximum(len(q) - words, 0), 1e-9)
        size, n, common = self.joined.size, len(joined), self.joined.lcs(joined)
        longest = np.maximum(size, n)
        out = np.maximum.reduce([by_token, 0.92 * (1 - self.joined.edits(joined) / np.maximum(longest, 1)), 0.9 * (2 * common / np.maximum(size + n, 1)), 0.88 * self.joined_bones.consonant(joined)])
        for i in np.nonzero(common == np.minimum(size, n))[0]:
            if n >= 4 and self.joined.values[i].startswith(joined):
                out[i] = max(out[i], 0.55 + 0.4 * n / len(self.joined.values[i]))
            if self.whole[i] == q:
                out[i] = 1.0
        # Sums in another order differ in their last bits: they shall tie.
        return np.where(size > 0, np.round(out, DIGITS), 0.0)

    def _top(self, score: np.ndarray, ok: np.ndarray, k: int) -> list[tuple[str, float, int]]:
        """The k best names by the best of their rows, ties by the first row that passes. score, ok: for each row."""
        at = np.nonzero(ok)[0]
        if not len(at):
            return []
        best, first = np.full(len(self.names), -1.0), np.full(len(self.names), np.iinfo(np.int64).max)
        np.maximum.at(best, self.name[at], score[at])
        np.minimum.at(first, self.name[at], self.place[at])
        found = np.nonzero(best >= 0)[0]
        return [(self.names[i], float(best[i]), int(first[i])) for i in found[np.lexsort((first[found], -best[found]))[:k]]]

    def near(self, variant: str, distinctive: str, generators: tuple[str, ...]) -> list[tuple[str, str, float, int]]:
        """(generator, name, score, place) of the best names of each generator. distinctive: only for inner tokens."""
        how, out = self.how, []
        if variant:
            similar = self.name_similarity(variant)[self.name]
            q, joined = variant.split(), "".join(variant.split())
            first, firsts = q[0], np.maximum(self.row_tokens[:, 0], 0)
            if "search" in generators:
                out += [("search", *x) for x in self._top(similar, similar >= how.search, how.search_ranks)]
            if "prefix" in generators and len(variant) >= 4 and len(first) >= 4:
                same = np.array([w == first for w in self.tokens.values], bool)
                out += [("prefix", *x) for x in self._top(similar, same[firsts] & (self.first_size > 0), how.ranks)]
            if "first" in generators and len(first) >= 4:
                alike = np.maximum(self.token(first), self._consonant[first])[firsts]
                ok = (self.first_size >= 4) & (np.abs(self.first_size - len(first)) <= how.length_gap) & (alike >= how.first) & (similar >= how.first_name)
                out += [("first", *x) for x in self._top(similar, ok, how.ranks)]
            bones = len(s.skeleton(joined))
            if "consonant" in generators and len(joined) >= 6 and bones >= 4:
                best = np.where(np.abs(self.row_joined.bones.size - bones) <= how.length_gap, self.row_joined.consonant(joined), 0.0)
                if len(q) == 1:
                    self.token(joined)
                    own = self.several & (np.abs(self.first_bones - bones) <= how.length_gap)
                    best = np.maximum(best, np.where(own, self._consonant[joined][firsts], 0.0))
                score = np.maximum(similar, np.round(how.consonant_weight * best, DIGITS))
                out += [("consonant", *x) for x in self._top(score, (best >= how.consonant) & (score >= how.consonant_name), how.ranks)]
        if "inner" in generators and distinctive and (tokens := [w for w in distinctive.split() if len(w) >= 5]):
            alike = np.maximum.reduce([self.token(w) for w in tokens]) >= how.inner
            met = (alike & self.long_token)[np.maximum(self.row_tokens, 0)] & (self.row_tokens >= 0)
            if (ok := met.any(1)).any():
                similar = self.name_similarity(distinctive)[self.name]
                out += [("inner", *x) for x in self._top(similar, ok & (similar >= how.inner_name), how.ranks)]
        return out


def _each(n: int) -> Column:
    """A row for each number under n."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def near_names(forms: DataFrame, index: DataFrame, generators: tuple[str, ...] = GENERATORS, how: Limits = Limits(), slice_forms: int = SLICE_FORMS, block_names: int = BLOCK_NAMES) -> DataFrame:
    """SCHEMA: the ranks of each form's variants. forms: query_id (unique string), normalized, cleaned; index: see catalog.with_keys.

    place orders index rows: full names before faces, each by card_ord; a name that occurs again counts by its first row."""
    place = F.min(F.col("pass") * F.lit(1 << 40) + F.col("card_ord")).alias("place")
    names = index.groupBy("name", "name_normalized", "normalized").agg(place)
    slices, blocks = (max(1, -(-df.count() // size)) for df, size in ((forms, slice_forms), (names, block_names)))
    variants = F.array_distinct(F.filter(F.array("normalized", "cleaned"), lambda v: v != ""))
    asked = forms.select(
        F.pmod(F.xxhash64("query_id"), F.lit(slices)).alias("slice"), _each(blocks).alias("block"),
        F.col("query_id").alias("form"), variants.alias("variants"), t.distinctive_query(F.col("normalized")).alias("distinctive"),
    )
    held = names.select(_each(slices).alias("slice"), F.pmod(F.xxhash64("name"), F.lit(blocks)).alias("block"), "name", "name_normalized", "normalized", "place")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(list(zip(*(right.column(c).to_pylist() for c in ("name", "name_normalized", "normalized", "place")))), how) if right.num_rows and left.num_rows else None
        rows: list[tuple] = []
        if block:
            for form, found, distinctive in zip(*(left.column(c).to_pylist() for c in ("form", "variants", "distinctive"))):
                for k, v in enumerate(found):
                    # The inner tokens are of the form, not of a variant: once.
                    rows += [(form, "" if g == "inner" else v, g, *x) for g, *x in block.near(v, distinctive if k == 0 else "", generators)]
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64())
        cols = zip(*rows) if rows else [[] for _ in kinds]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["form", "variant", "generator", "name", "score", "place"])

    best = asked.groupBy("slice", "block").cogroup(held.groupBy("slice", "block")).applyInArrow(run, SCHEMA)
    if blocks == 1:
        return best
    order = Window.partitionBy("form", "variant", "generator").orderBy(F.desc("score"), "place")
    kept = F.when(F.col("generator") == "search", how.search_ranks).otherwise(how.ranks)
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= kept).drop("rank")
