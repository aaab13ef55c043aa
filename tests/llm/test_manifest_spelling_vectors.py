"""The Merkle manifest, spelling variants and near vectors, against SQL and plain Python."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter
from itertools import groupby

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanset.llm import merkle, spelling, vectors
from gleanset.llm.oracle import ORACLE_SQL
from gleanset.llm.queries import QUERIES

DOCS = "doc_id long, source string, lang string, n_chars long, text string, idx long, g string, word string"


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_merkle_manifest"])
def test_sql(spark, small, name):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, small)
    assert sorted(got.columns) == sorted(names)
    rows = sorted((tuple(r[c] for c in names) for r in got.collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str) and rows


# Merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grown(nodes, arity):
    """The top of the nodes' tree, and for each node its siblings to the left and right, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // arity * arity : i // arity * arity + arity]
            paths[k].append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
        nodes, at = [H(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)], [i // arity for i in at]
    return nodes[0], paths


def expected(rows, arity):
    first = lambda x: (x is not None, x)
    leaves = sorted(((r[1], r[0], leaf_of(r[:5])) for r in rows), key=lambda x: (first(x[0]), first(x[1]), x[2]))
    groups = [(g, list(v)) for g, v in groupby(leaves, key=lambda x: x[0])]
    tops = [grown([d for _, _, d in v], arity) for _, v in groups]
    root, over = grown([t for t, _ in tops], arity)
    return sorted(((i, d, top, root, H(*(a + b for a, b in p + q))) for (_, v), (top, paths), q in zip(groups, tops, over) for (_, i, d), p in zip(v, paths)), key=str)


def forest(sizes, seed=3):
    rng = random.Random(seed)
    out, at = [], 0
    for k, n in enumerate(sizes):
        for _ in range(n):
            at += 1
            out.append((at * 7919 % 100_003, None if k == 0 else f"s{'é' if k % 2 else ''}{k}", rng.choice(["en", None]), rng.choice([None, at]), rng.choice(["", None, "Text É", "x" * 50_000, f"t{at}"]), 1, "g", "w"))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("arity,sizes", [(2, [1, 2, 3, 9, 64, 65]), (3, [40]), (16, [1, 15, 16, 17, 257, 300]), (4, [1])])
def test_manifest(spark, arity, sizes):
    rows = forest(sizes)
    rows += [rows[0], rows[0], (None, *rows[-1][1:]), (rows[-1][0], *rows[-1][1:4], "same id, other text", *rows[-1][5:])]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    found = merkle.manifest(docs, arity=arity)
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof")).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, arity)
    assert found.filter(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == len(rows)


def test_manifest_tampered(spark):
    rows = [r[:5] + r[5:] for r in forest([20, 40])]
    got = {(r.doc_id, r.leaf): r for r in merkle.tampered_manifest(spark.createDataFrame(rows, DOCS)).collect()}
    for r in rows:
        changed = zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None and r[4] != "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
        assert got[r[0], leaf_of(r[:5])].verified is not changed
    assert {r.verified for r in got.values()} == {True, False}


def test_manifest_empty(spark):
    found = merkle.tampered_manifest(spark.createDataFrame([], DOCS))
    assert found.collect() == [] and found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


# Spelling


def near_of(words):
    """Pairs that one insertion, deletion or replacement makes equal, by comparing all."""

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    return {(a, b) for a in words for b in words if a != b and one(a, b)}


def variants(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    near = {w: [] for w in n}
    for a, b in near_of(n):
        near[a].append(b)
    form = {w: f for w, found in near.items() if found and n[f := min(found, key=lambda x: (-n[x], x))] >= 10 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out, key=str)


def test_variants(spark):
    rng = random.Random(5)
    base = ["straßen", "Élégante", "aaaaaaaa", "aaaaaaaaa", "mississippi", "colours", "colors", "colourss", "naïveté", "x÷y×zabc", "Zürichsee", "zürichsee", "z" * 3000]
    docs = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = rng.choice(base[:7])
            if rng.random() < 0.06:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aeéz") + w[at:], w[:at] + rng.choice("aoß") + w[at + 1 :]])
            words.append(w)
        docs.append((i * 31, " ".join(words + [rng.choice(base)] * 2)))
    long_ones = [f"{'z' * 3000}", "z" * 2999, "z" * 1500 + "y" + "z" * 1500]
    docs += [(None, "colours colours"), (7, None), (8, ""), (9, " 1 2 "), (10, " ".join(long_ones * 3)), docs[0], docs[0]]
    # A chain of forms, each ten times as frequent as the one before.
    docs += [(20_000 + i, " ".join(["chained"] * 300 + ["chainedd"] * 30 + ["chaineddd"] * 3)) for i in range(3)]
    got = spelling.spelling_variants(spark.createDataFrame([(i, t, "x", "y", 1) for i, t in docs], "doc_id long, text string, word string, near string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == variants(docs)
    by = {r[0]: r for r in found}
    assert by["chaineddd"][1:3] == ("chainedd", "chained") and by["chainedd"][1] == "chained"
    assert by["z" * 3000][4] == 2 and sum(r[1] is not None for r in found) > 20


def test_variants_empty(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, "short words only")], "doc_id long, text string")).collect() == []


def test_neighbours():
    alphabet = np.array(sorted(map(ord, "abé")), np.uint64)
    for w in ("aab", "bé", "a", "abéab"):
        got = {s for _, s in spelling.neighbours([w], alphabet, lambda h: np.ones(h.shape, bool))}
        want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abé"} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abé"}
        assert got == want - {w}
        assert {int(h) for h in spelling.word_hashes(sorted(got))} and len(set(spelling.word_hashes(sorted(got)).tolist())) == len(got)


# Vectors


def brute(rows, limit=0.9):
    """n_links, component and kept of each row by comparing all, in the order of rows."""
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = Counter(), {i: i for i in ok}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for dim in {len(rows[i][1]) for i in ok}:
        at = [i for i in ok if len(rows[i][1]) == dim]
        u = vectors.units(np.array([rows[i][1] for i in at], np.float64))
        for a, b in np.argwhere(np.triu(u @ u.T >= limit, 1)):
            links[at[a]] += 1
            links[at[b]] += 1
            a, b = find(at[a]), find(at[b])
            parent[max(a, b, key=lambda i: rows[i][0])] = min(a, b, key=lambda i: rows[i][0])
    least = {}
    for i in ok:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return [(k, links[i], least[find(i)] if i in parent else k, True if i not in parent else k == least[find(i)]) for i, (k, _) in enumerate(rows)]


def around(rng, centre, cosine, n):
    x = rng.standard_normal((n, len(centre)))
    x -= (x @ centre)[:, None] * centre
    x /= np.linalg.norm(x, axis=1)[:, None]
    return cosine * centre + np.sqrt(1 - cosine**2) * x


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    unit = lambda n, d: (x := rng.standard_normal((n, d))) / np.linalg.norm(x, axis=1)[:, None]
    found = [*unit(300, 32)]
    for spread in (0.999, 0.99, 0.97, 0.955, 0.94):
        found += [*around(rng, unit(1, 32)[0], spread, 60)]
    centre = unit(1, 32)[0]
    for a in np.linspace(0, 1.2, 40):  # an arc: neighbours link, the ends don't
        found.append(np.cos(a) * centre + np.sin(a) * found[0])
    found += [*found[:20], *(3 * v for v in found[20:40]), *([found[5]] * 30)]
    rows = [(int(i * 37 % 10_007), [float(np.float32(x)) for x in v]) for i, v in enumerate(found)]
    rows += [(1, None), (2, []), (3, [0.0] * 32), (4, [float("nan")] * 32), (5, [None, *[1.0] * 31]), (6, [float("inf"), *[1.0] * 31]), (None, rows[0][1]), (20_000, [1.0, 0.0]), (20_001, [1.0, 0.1]), (20_002, [0.0, 1.0]), rows[7], rows[7], (20_003, [3e38, *[0.0] * 31]), (20_004, [1e-40, *[0.0] * 31])]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<float>, id long, keys string").repartition(5)
    got = sorted(map(tuple, vectors.near_vectors(df).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [r[0] for r in got] == [r[0] for r in want]
    missed = sum(b[1] - a[1] for a, b in zip(got, want))
    assert all(a[1] <= b[1] for a, b in zip(got, want)) and 0 <= missed <= 0.02 * sum(r[1] for r in want)
    assert sum(a[2:] != b[2:] for a, b in zip(got, want)) <= 0.02 * len(want)
    exact = {r[0] for r in want if r[1] == 0}
    assert {r[0] for r in got if r[1] == 0} >= exact and len(exact) > 200


def test_recall_at_the_limit(spark):
    """Pairs at a cosine just over the limit, among vectors that aren't alike, with the query's parameters."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    pairs = np.vstack([around(rng, b, 0.9001, 1) for b in base])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.vstack([base, pairs]))]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.filter("n_links > 0").count() >= 0.95 * len(rows)


def test_group_of_near_vectors_costs_in_proportion(spark):
    """Members of a tight group are counted, not paired: the tables hold its ball."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)
    for n in (400, 800):
        rows = [(i, [float(x) for x in v]) for i, v in enumerate(around(rng, centre, 0.992, n))]
        df = spark.createDataFrame(rows, "id long, embedding array<double>").withColumn("dim", F.size("embedding"))
        models = vectors.models_for(df)
        codes = vectors.coded(df, models).cache()
        inside = vectors._balls(df, codes, models[64].most_apart[0.5], 0.5 * np.arccos(0.9))
        assert inside.count() >= 0.95 * n and inside.select("ball").distinct().count() <= 4
        assert vectors._ball_pairs(codes, inside, models[64].most_apart).count() <= n // 10
        assert [r.n_links for r in vectors.near_vectors(df.withColumnRenamed("id", "vec_id")).select("n_links").distinct().collect()] == [n - 1]


def test_near_vectors_empty(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])]):
        got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert [tuple(r) for r in got.collect()] == [(k, 0, k, True) for k, _ in rows]
