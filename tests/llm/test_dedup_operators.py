"""Operators that compare texts: near-duplicates, lines, spans, benchmark items; and the pipeline."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleanset.llm import decontaminate, line_dedup, near, near_dedup, span_dedup
from gleanset.llm.common import written

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, bucket string"
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(f"{rng.choice(VOCABULARY)}{'.' if i % 9 == 8 else ''}" for i in range(n))


def changed(rng, text, share):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in text.split(" "))


def corpus(seed=1):
    """Copies, near copies in chains, short, empty, null and long texts, ids far apart, a repeated row."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(40)]
    texts = [*base, *base[:10], *(changed(rng, t, 0.02) for t in base[:30]), *(changed(rng, base[0], 0.03) for _ in range(60)), None, "", " \n ", "one two", "one two", "ONE two", prose(rng, 20_000)]
    chain = base[35]
    for _ in range(6):
        chain = changed(rng, chain, 0.03)
        texts.append(chain)
    rows = [(10**6 * i % 999_983, t, "en", "s", len(t or ""), 1, "b") for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, base[0], None, None, None, None, None)]


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def linked(sets, percent=80):
    keys = sorted(sets)
    return [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (n := len(sets[a] & sets[b])) and 100 * n >= percent * len(sets[a] | sets[b])]


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(-300, 300), rng.randint(-300, 300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r.id: r.root for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == {n: r for n, r in components({n for e in real for n in e}, real).items() if n != r}
    assert near.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    sets = {}
    for i, text, *_ in rows:
        if i is not None:
            w = (text or "").encode().lower().split()
            sets[i] = set(zip(*(w[k:] for k in range(4)))) if len(w) >= 4 else {tuple(w)} if w else set()
    want = components(sets, linked(sets))
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values()) | {None}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_members_apart_are_compared_exactly(spark):
    """One bucket, a hundred sets in a row, each linked with its neighbours only."""
    sets = {i: set(range(i * 10, i * 10 + 100)) for i in range(100)}
    members = spark.createDataFrame([(1, i) for i in sets], "bucket long, id long")
    table = spark.createDataFrame([(i, [1], sorted(s)) for i, s in sets.items()], "id long, buckets array<long>, items array<long>")

    def verify(pairs):
        both = F.size(F.array_intersect("x.items", "y.items"))
        found = pairs.join(table.alias("x"), F.col("a") == F.col("x.id")).join(table.alias("y"), F.col("b") == F.col("y.id"))
        return written(found.filter(100 * both >= 80 * (200 - both)).select("a", "b"))

    close = lambda x, y: F.abs(F.col(f"{x}.items")[0] - F.col(f"{y}.items")[0]) <= 30
    got = {r.id: r.root for r in near.link(members, lambda ids: table.join(ids, "id"), close, verify).collect()}
    assert got == dict.fromkeys(range(100), 0)


def test_sketches_let_links_through_and_stop_the_rest(spark):
    """Pairs of sets by size and similarity: all at 0.8 or more pass, nearly none at 0.65."""
    import numpy as np

    rng, rows = np.random.default_rng(2), []
    for size in (3, 10, 40, 150, 600, 2500, 10_000):
        for similarity in (0.8, 0.85, 0.65):
            for _ in range(20):
                n = int(np.ceil(size * similarity))  # in both, of the union's size
                own = (size - n) // 2
                union = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:size]
                order = rng.permutation(len(union))
                a, b = np.sort(union[order[: n + own]]), np.sort(union[np.concatenate([order[:n], order[n + own :]])])
                true = n / len(union)
                rows.append((size, true, *[(len(s), *near_dedup.odd_sketch(s).view(np.int64).tolist()) for s in (a, b)]))
    head = f"struct<n_shingles:long,{','.join(f'sketch{i}:long' for i in range(near_dedup.WORDS))}>"
    how = near_dedup.Near()
    pairs = spark.createDataFrame(rows, f"size int, true double, x {head}, y {head}")
    pairs = pairs.withColumns({k: F.col(k).withField("limit", near_dedup._limit(how, F.col(f"{k}.n_shingles"))) for k in "xy"})
    got = pairs.select("size", "true", near_dedup._may(how)("x", "y").alias("may")).collect()
    assert all(r.may for r in got if r.true >= 0.8)
    assert sum(r.may for r in got if r.size >= 150 and r.true < 0.7) <= 2


def test_lines(spark):
    rows = [(i, t.replace(". ", ".\n") if t else t, *r) for i, t, *r in corpus(3)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    at, sets = [], {}
    for i, text in {(i, t) for i, t, *_ in rows if i is not None}:
        for n, line in enumerate((text or "").split("\n")):
            line = line.lower().strip(line_dedup.SPACE)
            if line:
                at.append((i, n, line))
                sets[line] = {line[k : k + 5] for k in range(max(1, len(line) - 4))}
    root = components(sets, linked(sets))
    first = {}
    for i, n, line in sorted(at):
        first.setdefault(root[line], (i, n))
    want = defaultdict(list)
    for i, n, line in sorted(at):
        want[i] += [n] * (first[root[line]] != (i, n))
    got = {r.doc_id: r for r in line_dedup.removed_lines(docs).collect()}
    wrong = [i for i in got if list(got[i].removed) != want[i]]
    assert set(got) == {i for i, _, _ in at} and len(wrong) <= 0.02 * len(got)
    out = line_dedup.without_near_lines(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    i = next(i for i in got if 0 < got[i].n_removed < got[i].n_lines and i not in wrong)
    text = next(t for d, t, *_ in rows if d == i)
    assert texts[i] == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in want[i])
    assert line_dedup.removed_lines(docs.limit(0)).count() == 0


def test_lines_with_one_changed_character(spark):
    """Against plain shingles of five characters, written out here."""
    rng, texts = random.Random(12), []
    for n in [*range(3, 18)] * 12:
        line = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))
        k = rng.randrange(len(line))
        texts += [line, f"{line[:k]}z{line[k + 1:]}"]
    texts += ["abc", "abd", "añb\u2028", "a😀bcd", "x" * 4000, "".join(rng.choice("ñbcdef😀") for _ in range(1500))]
    sets = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in texts]
    near_pairs = [k for k in range(0, len(texts), 2) if 5 * len(sets[k] & sets[k + 1]) >= 4 * len(sets[k] | sets[k + 1])]
    got = {r.doc_id for r in line_dedup.removed_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("n_removed > 0").collect()}
    want = {k + 1 for k in near_pairs}
    assert len(want) > 100 and got <= want and len(got) >= 0.98 * len(want)


def test_line_shingles(spark):
    """Rows of hashes and arrays of hashes are the same set, as large as the plain one: characters of one to four bytes, block ends."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é字😀x") for _ in range(n)) for n in (1, 4, 5, 6, 19, 20, 21, 36, 37, 300, 4095, 4096, 4097, 4100, 4101, 9000)]
    texts += ["abc" * 3000, "a" * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    arrays = {r.id: r.s for r in rows.select("id", line_dedup.shingle_set("line").alias("s")).collect()}
    sets = defaultdict(set)
    for r in line_dedup.hashed(rows).collect():
        sets[r.id] |= set(r[1:])
    for i, text in enumerate(texts):
        assert len(arrays[i]) == len({text[k : k + 5] for k in range(max(1, len(text) - 4))})
        assert set(arrays[i]) == sets[i]


def test_line_plans_are_native(spark):
    docs = spark.createDataFrame(corpus()[:5], DOCS)
    plan = line_dedup.removed_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_spans(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    how, first, gone = span_dedup.Spans(), {}, defaultdict(set)
    for i, text in sorted({(i, t or "") for i, t, *_ in rows if i is not None}):
        cut = [w for _, w in span_dedup.sentences(text, how.max_words)]
        for a in range(len(cut)):
            b = next((b for b in range(a + 2, len(cut) + 1) if sum(map(len, cut[a:b])) >= how.min_words), None)
            if b and first.setdefault(tuple(w for s in cut[a:b] for w in s), (i, a)) != (i, a):
                gone[i].update(range(a, b))
    got = span_dedup.without_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_removed == len(gone[r.doc_id])
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        cut = [s for s, _ in span_dedup.sentences(text or "", how.max_words)] + [len(text or "")]
        if r.n_removed:
            assert r.text == text[: cut[0]] + "".join(text[a:b] for k, (a, b) in enumerate(zip(cut, cut[1:])) if k not in gone[r.doc_id])
        else:
            assert r.text == text
    assert span_dedup.without_repeats(docs.limit(0)).count() == 0


def test_long_passage_without_a_mark_is_cut(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"Start one here. {passage}"), (2, f"Other words. {passage}")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in span_dedup.without_repeats(docs).collect()}[2] == "Other words. "


def test_passages_without_marks_inside_sentences(spark):
    """Passages at random word positions of two documents without sentence marks."""
    rng, rows, sizes = random.Random(21), [], {}
    some = lambda n: [f"x{rng.randrange(10**6)}" for _ in range(n)]
    for k in range(60):
        passage = some(size := (55, 80, 120)[k % 3])
        for copy in (0, 1):
            rows.append((2 * k + copy, " ".join(some(rng.randint(20, 90)) + passage + some(rng.randint(20, 90)))))
        sizes[2 * k + 1] = size
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = dict(rows)
    lost = {r.doc_id: len(before[r.doc_id].split()) - len(r.text.split()) for r in span_dedup.without_repeats(docs).collect()}
    assert all(lost[i] == 0 for i in before if i not in sizes)
    shares = [lost[i] / n for i, n in sizes.items()]
    assert sum(x == 0 for x in shares) <= 1 and sum(shares) >= 0.8 * len(shares) and max(shares) <= 1


def brute(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row), row.index(min(row))


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice(["", "z", out[k] + "q"])
    return "".join(out)


def test_edit_search():
    rng = random.Random(3)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(2))
        assert decontaminate.edit_search(p, t) == brute(p, t)


def test_leaks(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(8, 60))) for i in range(12)] + [(50, "tiny thing here now"), (51, None), (52, "")]
    text = dict(items)
    rows = [(i, prose(rng, 150), 0) for i in range(20)]
    for i in range(12):
        hidden = text[i] if i % 2 else edited(rng, text[i].upper(), len(text[i]) // 30)
        rows.append((100 + i, f"{prose(rng, 40)} {hidden} {prose(rng, 40)}", 0))
    rows += [(200, None, 0), (201, "", 0), (202, "A TINY\tthing here now.", 0), (203, prose(rng, 30_000), 0), (101, rows[21][1], 0)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(100 + i, i) for i in range(12)} | {(202, 50)} and len(got) == 14
    by = {r.doc_id: r for r in got}
    assert by[101].distance == 0 and rows[21][1][by[101].start : by[101].end] == text[1]
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, block_chars=200).collect()} == {(r.doc_id, r.item_id) for r in got}
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()} == {*range(20), 200, 201, 203}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_recall_of_edited_items():
    rng = random.Random(4)
    items = [(i, prose(rng, 50)) for i in range(60)]
    index = decontaminate.Index(items)
    texts = [f"{prose(rng, 30)} {edited(rng, t, int(0.06 * len(t)))} {prose(rng, 30)}" for _, t in items]
    found = index.leaks(texts)
    assert sum(i in {x[0] for x in f} for (i, _), f in zip(items, found)) >= 0.9 * len(items)


@pytest.mark.parametrize("size", [1, 3, 5, 9, 10, 12, 19, 24, 30, 50, 63, 64, 80, 100, 120, 300, 1000])
def test_recall_by_length(size):
    """At the edit limit, for the shortest and other items of length classes. Unedited items are all found."""
    rng = random.Random(size)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvw ") for _ in range(n))
    items = [(i, some(size)) for i in range(100 if size < 500 else 30)]
    index = decontaminate.Index(items)
    for n in {0, size // 10}:
        texts = [f"{some(rng.randint(30, 60))}{edited(rng, t, n)}{some(50)}" for _, t in items]
        hits = sum(i in {x[0] for x in f} for (i, _), f in zip(items, index.leaks(texts)))
        assert hits >= (0.93 if n else 1) * len(items)


def test_leaks_are_those_of_all_pairs():
    """Against the exact distance of every item to every text: nothing that isn't there, nearly all of what is."""
    rng = random.Random(31)
    items = [(i, prose(rng, rng.randint(1, 30))) for i in range(25)]
    texts = [f"{prose(rng, 10)} {edited(rng, t, rng.randint(0, len(t) // 8))} {prose(rng, 12)}" for _, t in items] + [None, "", "w1"]
    want = {(k, i): brute(t.lower(), x.lower())[0] for k, x in enumerate(texts) if x for i, t in items if 10 * brute(t.lower(), x.lower())[0] <= len(t)}
    got = {(k, x[0]): x[3] for k, f in enumerate(decontaminate.Index(items).leaks(texts)) for x in f}
    assert len(got) >= 0.95 * len(want) and all(want[k] == d for k, d in got.items())


def test_edit_start_of_a_long_hit():
    rng = random.Random(2)
    item = prose(rng, 250)
    text = "x" * 50 + edited(rng, item, 40)
    distance, end = decontaminate.edit_search(item, text)
    start = decontaminate.edit_start(item, text[:end])
    assert brute(item, text[start:end])[0] == distance == brute(text[start:end], item)[0]


def test_pipeline(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = out.count()
        out = spark.createDataFrame(stage(spark, out, small).collect(), docs.schema)
        assert out.columns == docs.columns and 0 < out.count() <= before, name
    ends = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in ends.collect()} == {r.doc_id for r in out.collect()} and ends.filter("not round_trip").count() == 0


def test_lines_a_little_too_far_apart_are_not_verified_in_pairs(spark):
    """Lines with a word of their own each, at some 0.7: twice the lines don't give four times the pairs; links aren't lost."""
    rng, word = random.Random(5), lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    base = [word() for _ in range(7)]
    met = []
    for n in (150, 300):
        texts = []
        for i in range(n):
            at = i % len(base)
            texts.append(" ".join([*base[:at], word(), *base[at + 1 :]]))
            if i % 50 == 0:
                texts.append(texts[-1][:-1] + "z")  # a link
        sets = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, t in enumerate(texts)}
        rows = line_dedup.parities(spark.createDataFrame(list(enumerate(texts)), "id long, line string"))
        assert {r.id: r.n for r in rows.collect()} == {i: len(s) for i, s in sets.items()}
        pairs = {(r.a, r.b) for r in rows.alias("x").join(rows.alias("y"), (F.col("x.id") < F.col("y.id")) & line_dedup.may_share("x", "y")).selectExpr("x.id AS a", "y.id AS b").collect()}
        assert len(linked(sets)) >= n // 50 and set(linked(sets)) <= pairs
        met.append(len(pairs))
    assert met[0] <= 150 and met[1] <= 300, met


def test_linking_with_a_sharper_condition(spark):
    """A bucket of lines in a row, each near its neighbours only: all of them are one component."""
    rng = random.Random(6)
    text = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(90)]
    lines = []
    for i in range(90):
        text[(7 * i) % 90] = rng.choice("0123456789")
        lines.append("".join(text))
    lines = list(dict.fromkeys(lines))
    sets = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, t in enumerate(lines)}
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    members, heads = texts.selectExpr("7L AS bucket", "id"), line_dedup.signed(texts).withColumn("buckets", F.expr("array(7L)"))

    def verify(pairs):
        x, y = texts.selectExpr("id AS a", "line AS line_a"), texts.selectExpr("id AS b", "line AS line_b")
        return written(line_dedup.similar(pairs.join(x, "a").join(y, "b")))

    sharper = (lambda ids: line_dedup.parities(texts.join(ids, "id", "left_semi")), line_dedup.may_share)
    got = {r.id: r.root for r in near.link(members, lambda ids: heads.join(ids, "id"), line_dedup._may, verify, sharper).collect()}
    assert got == components(sets, linked(sets))


def test_conditions_on_pairs_are_compiled(spark):
    """The JVM compiles no method over 8,000 bytes: a longer join condition is interpreted for each pair."""
    texts = spark.createDataFrame([(i, f"line {i} of some that share a bucket") for i in range(20)], "id long, line string")
    heads = written(line_dedup.signed(texts).withColumn("buckets", F.expr("array(7L)")))
    active = written(texts.selectExpr("7L AS bucket", "id", "20L AS n", "id AS root", "0L AS top"))
    sharper = (lambda ids: line_dedup.parities(texts.join(ids, "id", "left_semi")), line_dedup.may_share)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = near._across(active, active.filter("root <> top"), heads, line_dedup._may, sharper)
        plan = pairs._sc._jvm.PythonSQLUtils.explainString(pairs._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan)]
    assert sizes and max(sizes) < 8000
