"""Similarity of short names: small pair measures, run over Arrow batches of (query, name) pairs that joins made."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanset.functions.text import FUNCTION_WORDS

_KEEP = 1 << 16
_VOWELS = frozenset("aeiouy")


@lru_cache(_KEEP)
def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, in bits of whole numbers (Hyyro, 2004)."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@lru_cache(_KEEP)
def edits(a: str, b: str) -> int:
    """Levenshtein distance."""
    if len(a) < len(b):
        a, b = b, a
    row = range(len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def skeleton(x: str) -> str:
    return "".join(c for c in x.lower() if "a" <= c <= "z" and c not in _VOWELS)


def _shared(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b))


def _alike(a: str, b: str) -> float:
    return 1 - edits(a, b) / max(len(a), len(b))


@lru_cache(_KEEP)
def consonant_similarity(a: str, b: str) -> float:
    a, b = skeleton(a), skeleton(b)
    if not a or not b:
        return 0.0
    return 1.0 if a == b else max(_shared(a, b), _alike(a, b))


@lru_cache(_KEEP)
def token_similarity(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if a in FUNCTION_WORDS and FUNCTION_WORDS[a] == FUNCTION_WORDS.get(b, b):
        return 0.92
    longest, shortest = max(len(a), len(b)), min(len(a), len(b))
    prefix = 0.72 + 0.28 * shortest / longest if a.startswith(b) or b.startswith(a) else 0.0
    return max(_alike(a, b), prefix, _shared(a, b), 0.94 * consonant_similarity(a, b))


def name_similarity(query: str, name: str) -> float:
    """Both normalised. The best of aligned tokens, prefix, edits, common subsequence and consonants."""
    if not query or not name:
        return 0.0
    if query == name:
        return 1.0
    q, c = query.split(), name.split()
    aligned = min(len(q), len(c))
    by_token = sum(map(token_similarity, q, c)) / (aligned + 0.35 * max(0, len(c) - len(q)) + 0.5 * max(0, len(q) - len(c)))
    whole_q, whole_c = "".join(q), "".join(c)
    prefix = 0.55 + 0.4 * len(whole_q) / len(whole_c) if len(whole_q) >= 4 and whole_c.startswith(whole_q) else 0.0
    return max(by_token, prefix, 0.92 * _alike(whole_q, whole_c), 0.9 * _shared(whole_q, whole_c), 0.88 * consonant_similarity(whole_q, whole_c))


def _either(a: str, b: str) -> float:
    return max(token_similarity(a, b), consonant_similarity(a, b))


def _best_free(token: str, names: list[str], free: set[int], at: int) -> tuple[float, int]:
    place = lambda j: 1.12 if j == at else 1.04 if abs(j - at) == 1 else 0.98 if j == at + 2 else 1.0
    scored = [(_either(token, names[j]) * place(j), -j) for j in free]
    best = max(scored, default=(0.0, 1))
    return (best[0], -best[1]) if best[0] > 0 else (0.0, -1)


def alignment(query: str, name: str) -> float:
    """How well the query's tokens of two characters or more fit the name's, in order, each name token used once."""
    q, c = [x for x in query.split() if len(x) > 1], name.split()
    if not q or not c:
        return 0.0
    if len(q) == 1:
        token = q[0]
        score = max(_either(token, c[0]), *(0.96 * token_similarity(token, x) for x in c))
        if len(token) >= 7 and len(c[0]) < 0.65 * len(token):
            score *= 0.7
        return score * 0.75 if len(token) >= 8 and len(c[0]) <= 7 else score
    free, total, weight, i = set(range(len(c))), 0.0, 0.0, 0
    while i < len(q):
        own = 1.6 if i == 0 else 0.55 if len(q[i]) <= 3 else 1.0
        score, at = _best_free(q[i], c, free, i)
        step = 1
        if i + 1 < len(q):
            joined, joined_at = _best_free(q[i] + q[i + 1], c, free, i)
            if joined_at >= 0 and joined > score + 0.06:
                score, at, own, step = joined, joined_at, max(own, 1.2), 2
        free.discard(at)
        total, weight, i = total + score * own, weight + own, i + step
    return total / weight


def coverage(query: str, name: str) -> float:
    """Share of the query's tokens that some token of the name is like."""
    q, c = [x for x in query.split() if len(x) > 1], name.split()
    if not q:
        return 0.0
    best = lambda x: max((token_similarity(x, y) for y in c), default=0.0)
    if len(q) == 1:
        return max(best(q[0]), consonant_similarity(q[0], "".join(c)))
    found = sum(max(token_similarity(x, c[i]) if i < len(c) else 0.0, 0.82 * best(x), best(x + q[i + 1]) if i + 1 < len(q) else 0.0) >= 0.5 for i, x in enumerate(q))
    return found / len(q)


def land_affinity(query: str) -> float:
    from gleanset.functions.text import BASICS

    joined = "".join(query.split())
    return max(_either(joined, b) for b in BASICS) if joined else 0.0


def pair_udf(measure) -> "Column":
    """A measure of two strings as a function of two columns; null counts as empty."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(measure(x or "", y or "")) for x, y in zip(a, b)], dtype="float64")

    return run


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("similarity", "alignment", "coverage")]))
def name_features(query: pd.Series, cleaned: pd.Series, name: pd.Series) -> pd.DataFrame:
    """The best of the query's two forms for each feature of a (query, name) pair; all normalised."""
    rows = [[max(f(q, n), f(c, n)) for f in (name_similarity, alignment, coverage)] for q, c, n in zip(query, cleaned, name)]
    return pd.DataFrame(rows, columns=["similarity", "alignment", "coverage"], dtype="float64")


@F.pandas_udf(T.DoubleType())
def land_affinity_udf(query: pd.Series) -> pd.Series:
    return pd.Series([land_affinity(q or "") for q in query], dtype="float64")


def ordered_lcs(a: Column, b: Column) -> Column:
    """Longest common subsequence in the JVM, a row of the table for each character of a. For short strings."""
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    start = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def row(before: Column, c: Column) -> Column:
        # Cells from left to right: the cell to the left is the last of those that are done.
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))), F.array(F.lit(0)),
            lambda done, j: F.concat(done, F.array(F.when(F.substring(b, j, F.lit(1)) == c, F.element_at(before, j) + 1).otherwise(F.greatest(F.element_at(before, j + 1), F.element_at(done, -1))))),
        )

    return F.when((a == "") | (b == ""), 0).otherwise(F.element_at(F.aggregate(chars(a), start, row), -1))
