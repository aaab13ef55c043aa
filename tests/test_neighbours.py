"""Bit-parallel measures against the plain ones, and the generators' ranks against scoring every pair."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanset.functions import similarity as s
from gleanset.functions.bitparallel import Compared, Strings
from gleanset.operators import catalog, match
from gleanset.operators.neighbours import GENERATORS, Block, Limits, near_names

HOW = Limits()
SYLLABLES = ["storm", "bol", "light", "ning", "drag", "on", "fi", "re", "ska", "th", "mo", "un", "tain", "wiz", "ard", "of", "the", "el", "ves", "qua", "rt", "z"]


def token(rng):
    return rng.choice(["of", "the", "to", "ef"]) if rng.random() < 0.15 else "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def name(rng):
    return " ".join(token(rng) for _ in range(rng.randint(1, 4)))


def misread(rng, x):
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(x) + 1)
        x = rng.choice([x[:at] + x[at + 1 :], x[:at] + rng.choice("aeiou xyz1") + x[at:], x[:at] + rng.choice("bcdfg") + x[at + 1 :]])
    return " ".join(x.split()) or "x"


def test_measures():
    rng = random.Random(4)
    values = [misread(rng, token(rng)).replace(" ", "") for _ in range(300)] + ["", "a", "of", "oe", "plow", "per", "x" * 64, "ab" * 32, "ab" * 40, "q" * 70]
    many, compared = Strings(values), Compared(values)
    for text in [*values[::9], "", "ef", "per", "shares", "ab" * 33, "ba" * 50]:
        assert many.lcs(text).tolist() == [s.lcs(v, text) for v in values]
        assert many.edits(text).tolist() == [s.edits(v, text) for v in values]
        assert np.allclose(compared.consonant(text), [s.consonant_similarity(text, v) for v in values], atol=1e-12)
        assert np.allclose(compared.token(text), [s.token_similarity(text, v) for v in values], atol=1e-12)


def rows_of(rng, n):
    """(name, name_normalized, normalized, place): some names have faces."""
    names = sorted({name(rng) for _ in range(n)})
    rows = [(x, x, x, i) for i, x in enumerate(names)]
    for i, x in enumerate(names[:: 7]):
        if " " in x:
            rows += [(x, x, f, (1 << 40) + 7 * i) for f in (x.split(" ", 1)[0], x.split(" ", 1)[1])]
    return rows


def ranks(found, k):
    """The k best names of (name, score, place) rows: best score, ties by the first row."""
    best, first = {}, {}
    for n, score, place in found:
        score = round(score, 12)
        best[n], first[n] = max(best.get(n, -1), score), min(first.get(n, place), place)
    return [(n, best[n], first[n]) for n in sorted(best, key=lambda n: (-best[n], first[n]))[:k]]


def plain(rows, variant, distinctive):
    """Each generator by scoring every pair with the plain measures."""
    q = variant.split()
    first, joined = q[0], "".join(q)
    bones = len(s.skeleton(joined))
    out = {g: [] for g in GENERATORS}
    inner = [w for w in distinctive.split() if len(w) >= 5]
    for n, whole, own, place in rows:
        similar, c = s.name_similarity(variant, whole), own.split()
        if similar >= HOW.search:
            out["search"].append((n, similar, place))
        if len(variant) >= 4 and len(first) >= 4 and (own == variant or own.startswith(variant + " ") or own == first or own.startswith(first + " ")):
            out["prefix"].append((n, similar, place))
        if min(len(first), len(c[0])) >= 4 and abs(len(first) - len(c[0])) <= 6 and max(s.token_similarity(first, c[0]), s.consonant_similarity(first, c[0])) >= 0.42 and similar >= 0.45:
            out["first"].append((n, similar, place))
        if len(joined) >= 6 and bones >= 4:
            targets = [c[0], "".join(c)] if len(q) == 1 and len(c) > 1 else ["".join(c)]
            best = max([s.consonant_similarity(joined, x) for x in targets if abs(len(s.skeleton(x)) - bones) <= 6], default=0)
            if best >= 0.5 and max(similar, 0.96 * best) >= 0.45:
                out["consonant"].append((n, max(similar, 0.96 * best), place))
        if any(s.token_similarity(a, b) >= 0.58 for a in inner for b in c if len(b) >= 5) and (score := s.name_similarity(distinctive, whole)) >= 0.42:
            out["inner"].append((n, score, place))
    return {g: ranks(found, HOW.search_ranks if g == "search" else HOW.ranks) for g, found in out.items()}


def same(got, want):
    assert [(n, p) for n, _, p in got] == [(n, p) for n, _, p in want]
    assert np.allclose([x for _, x, _ in got], [x for _, x, _ in want], atol=1e-12)


def test_generators_equal_all_pairs():
    """2,000 names: every generator's ranks are those of the join by its thresholds."""
    rng = random.Random(8)
    rows = rows_of(rng, 2000)
    block, passed = Block(rows, HOW), 0
    for _ in range(20):
        variant = misread(rng, rng.choice(rows)[0])
        distinctive = misread(rng, variant)
        got = block.near(variant, distinctive, GENERATORS)
        want = plain(rows, variant, distinctive)
        for g in GENERATORS:
            same([x[1:] for x in got if x[0] == g], want[g])
        passed += sum(max(s.token_similarity(variant.split()[0], r[2].split()[0]), s.consonant_similarity(variant.split()[0], r[2].split()[0])) >= 0.42 for r in rows)
    assert passed > 0.1 * 20 * len(rows)  # why no index of the thresholds alone would be selective


@pytest.mark.parametrize("slice_forms,block_names", [(7, 50), (1000, 100_000)])
def test_blocks_merge_to_the_same_ranks(spark, slice_forms, block_names):
    rng = random.Random(9)
    names = sorted({name(rng) for _ in range(240)})
    index = catalog.with_keys(catalog.build_index(spark.createDataFrame([(i, x.replace(" ", " // ", 1) if i % 6 == 0 else x) for i, x in enumerate([*names, names[0]])], "card_ord long, name string")))
    asked = sorted({misread(rng, rng.choice(names)) for _ in range(40)})
    forms = spark.createDataFrame([(x, x, x.split(" ", 1)[-1]) for x in asked], "query_id string, normalized string, cleaned string").cache()
    near = near_names(forms, index, slice_forms=slice_forms, block_names=block_names).cache()
    rows = {(r.name, r.name_normalized, r.normalized): (1 << 40) * r["pass"] + r.card_ord for r in index.orderBy(F.desc("pass"), F.desc("card_ord")).collect()}
    rows = [(*k, v) for k, v in rows.items()]
    got = {}
    for r in near.orderBy(F.desc("score"), "place").collect():
        got.setdefault((r.form, r.variant, r.generator), []).append((r.name, r.score, r.place))
    distinctive = {r[0]: r[1] for r in forms.select("query_id", match.t.distinctive_query(F.col("normalized"))).collect()}
    for x in asked:
        for k, v in enumerate(dict.fromkeys([x, x.split(" ", 1)[-1]])):
            want = plain(rows, v, distinctive[x])
            for g in GENERATORS[:4]:
                same(got.get((x, v, g), []), want[g])
            if k == 0:
                same(got.get((x, "", "inner"), []), want["inner"])
    assert near.groupBy("form", "variant", "generator").count().filter("count > if(generator = 'search', 16, 6)").isEmpty()


def test_search_equals_a_full_scan(spark):
    rng = random.Random(10)
    names = sorted({name(rng) for _ in range(300)})
    index = catalog.build_index(spark.createDataFrame(list(enumerate(names)), "card_ord long, name string"))
    asked = [(i, misread(rng, rng.choice(names))) for i in range(30)] + [(100, names[3].upper()), (101, "!!"), (102, None), (103, names[3].upper())]
    got = {}
    for r in match.search(spark.createDataFrame(asked, "query_id long, text string"), index).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.name, round(r.score, 9)))
    for i, x in asked:
        x = (x or "").lower().replace("!", "").strip()
        scored = sorted(((-s.name_similarity(x, n), len(n), n) for n in names if x and s.name_similarity(x, n) >= 0.5))
        # Sixteen by score and place, then six by score, length and text: equal but where ties cross the sixteenth rank.
        assert [round(-a, 9) for a, _, _ in scored[:6]] == [b for _, b in got.get(i, [])], x
    assert got[100] == got[103] and got[100][0] == (names[3], 1.0) and 101 not in got and 102 not in got


def test_a_larger_catalog_gives_no_more_rows(spark):
    rng = random.Random(11)
    forms = spark.createDataFrame([(x, x, x) for x in sorted({name(rng) for _ in range(30)})], "query_id string, normalized string, cleaned string").cache()
    counts = []
    for n in (40, 4000):
        names = [(i, f"{name(rng)} {token(rng)}") for i in range(n)]
        index = catalog.with_keys(catalog.build_index(spark.createDataFrame(names, "card_ord long, name string")))
        counts.append(near_names(forms, index, block_names=1000).count())
    assert counts[1] <= forms.count() * (16 + 4 * 6)
