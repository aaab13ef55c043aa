"""Fuzzy line dedup by MinHash, in DataFrame functions only.

A line's set is its shingles of five characters, one from every character, by their 64-bit hashes; a shorter line is its
only shingle. 40 MinHash samples of the set are dealt twice into eight groups of five, the line's 16 buckets; near.py links
lines whose sets have a Jaccard similarity of 0.8 or more, checked exactly. By simulation the groups miss
0.8 % of the pairs at 0.8, and 0.1 % at 0.85. Of each component of lines the first one stays, by document id and line
number; equal lines (equal 64-bit hashes) are one item from the start.

Defined results: lines are compared in lower case without spaces around them; blank lines always stay and are compared
with nothing. Null and empty texts have no lines to remove. Rows with equal ids are one document: what happens to a line
number happens in all of them. Rows without an id stay as they are. Very long lines are one item of many shingles; a task holds
four bytes for each character of one line, so a line can have up to some 500 million characters.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanset.llm.common import forget, free_shuffles, id_and_text, keyed, written
from gleanset.llm.near import link

SIZE = 5
SAMPLES, PERCENT, ROWS = 40, 80, 5
SEEDS = random.Random(9).sample(range(1 << 62), SAMPLES)
ORDERS = [random.Random(100 + k).sample(range(SAMPLES), SAMPLES) for k in range(2)]
GROUPS = [order[at : at + ROWS] for order in ORDERS for at in range(0, SAMPLES, ROWS)]
MOST_BITS = 148  # of 640 bits of samples that differ in a pair; at a similarity of 0.8 about 64 do, with a deviation of 21
LANES = 4  # samples in a long, of 16 bits each
PACKED = [f"p{k}" for k in range(SAMPLES // LANES)]
LONG, SHORT = 4096, 16  # shingles in a block of a line that is compared, and in a row of hashes
WIDTH = 4  # bytes of a character in _codes()
SPAN = SIZE * WIDTH
WORDS = 32  # of 64 bits in parities()
SPACE = " \t\n\x0b\x0c\r"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line and id (of the compared form), for the lines that aren't blank."""
    split = docs.filter("doc_id is not null").select("doc_id", F.posexplode(F.split(F.lower("text"), "\n")).alias("line_no", "raw"))
    return split.select("doc_id", "line_no", F.btrim("raw", F.lit(SPACE)).alias("line")).filter("line <> ''").withColumn("id", F.xxhash64("line"))


def _codes(text: Column) -> Column:
    """A text as bytes, WIDTH for each character: a place in it is found without counting characters."""
    return F.encode(text, "UTF-32")


def _starts(n: Column, size: int) -> Column:
    """Where blocks of size shingles begin in n characters or bytes, from 1."""
    return F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size))


def hashed(rows: DataFrame, column: str = "line") -> DataFrame:
    """rows with h0, h1, ... instead of a column of text: the hashes of the shingles, in rows of SHORT (the last one of a line
    repeats its first hash).

    A row for several shingles shares what a row costs, and code is generated for it, so that a shingle takes a fraction of
    what functions over arrays of them take."""
    keys = [c for c in rows.columns if c != column]
    coded = rows.select(*keys, _codes(F.col(column)).alias(column))
    starts = coded.select(*keys, column, F.explode(_starts(F.length(column) - SPAN + WIDTH, SHORT * WIDTH)).alias("_at"))
    cut = starts.select(*keys, F.substring(column, F.col("_at"), F.lit(SPAN + (SHORT - 1) * WIDTH)).alias(column))
    here = lambda j: F.xxhash64(F.substring(column, WIDTH * j + 1, SPAN))
    return cut.select(*keys, *[(F.when(F.length(column) >= WIDTH * j + SPAN, here(j)).otherwise(here(0)) if j else here(j)).alias(f"h{j}") for j in range(SHORT)])


def _sample(hash_: Column, i: int) -> Column:
    """The hash in the order of sample i: its bits turned by a number of its own, and some of them inverted.

    The least value in such an order is about as good as one of a new hash, and takes a few plain operations."""
    turn = 13 * i % 64
    turned = F.shiftleft(hash_, turn).bitwiseOR(F.shiftrightunsigned(hash_, 64 - turn)) if turn else hash_
    return turned.bitwiseXOR(F.lit(SEEDS[i]))


def signed(distinct: DataFrame) -> DataFrame:
    """id, p0, p1, ... of each distinct line (id, line): the low 16 bits of its MinHash samples, four in a long."""
    h = [F.col(f"h{j}") for j in range(SHORT)]
    least = hashed(distinct.select("id", "line")).groupBy("id").agg(*[F.min(F.least(*[_sample(x, i) for x in h])).alias(f"s{i}") for i in range(SAMPLES)])
    lane = lambda i: F.shiftleft(F.col(f"s{i}").bitwiseAND(F.lit(0xFFFF)), 16 * (i % LANES))
    return least.select("id", *[reduce(Column.bitwiseOR, [lane(k * LANES + j) for j in range(LANES)]).alias(name) for k, name in enumerate(PACKED)])


def _buckets() -> Column:
    lane = lambda i: F.shiftrightunsigned(PACKED[i // LANES], 16 * (i % LANES)).bitwiseAND(F.lit(0xFFFF))
    return F.array(*[F.xxhash64(F.lit(b), *[lane(i) for i in group]) for b, group in enumerate(GROUPS)])


def _may(left: str, right: str) -> Column:
    """Whether few enough bits of the samples differ: none of an equal sample, half of another one's. Short: see near._plain()."""
    return sum((F.bit_count(F.col(f"{left}.{p}").bitwiseXOR(F.col(f"{right}.{p}"))) for p in PACKED), F.lit(0)) <= MOST_BITS


def shingle_set(line: str) -> Column:
    """The distinct hashes of a text column's shingles as an array, for the few lines that are compared in pairs.

    Blocks are lambda variables: a column's bytes would be copied for each shingle."""
    blocks = F.transform(_starts(F.length(line) - SIZE + 1, LONG), lambda at: _codes(F.substring(line, at, F.lit(LONG + SIZE - 1))))
    hashes = lambda block: F.transform(_starts(F.length(block) - SPAN + WIDTH, WIDTH), lambda at: F.xxhash64(F.substring(block, at, F.lit(SPAN))))
    return F.array_distinct(F.flatten(F.transform(blocks, hashes)))


def similar(pairs: DataFrame) -> DataFrame:
    """The (a, b) of pairs (a, b, line_a, line_b) whose lines' sets have the similarity.

    The sets go through explode(), for a condition on them could be moved to where it builds each set anew at each use."""
    sets = pairs.select("a", "b", F.explode(F.array(F.struct(shingle_set("line_a").alias("x"), shingle_set("line_b").alias("y")))).alias("of"))
    both = F.size(F.array_intersect("of.x", "of.y"))
    return sets.filter((100 + PERCENT) * both >= PERCENT * (F.size("of.x") + F.size("of.y"))).select("a", "b")


def parities(mine: DataFrame) -> DataFrame:
    """id, n and w0, w1, ... of lines (id, line): how many shingles the set has, and for each of 64 * WORDS remainders of their
    hashes whether an odd number of them has it (an odd sketch)."""
    bit = F.pmod("shingle", F.lit(64 * WORDS))
    # A line's array is made distinct, not rows of all lines: a task holds no table of shingles.
    each = mine.select("id", F.explode(shingle_set("line")).alias("shingle"))
    each = each.select("id", F.shiftrightunsigned(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    odd = [F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WORDS)]
    return written(each.groupBy("id").agg(F.count("*").alias("n"), *odd))


def may_share(left: str, right: str) -> Column:
    """Holds for all similar sets: two sketches differ in no more bits than the sets in shingles."""
    unequal = sum((F.bit_count(F.col(f"{left}.w{k}").bitwiseXOR(F.col(f"{right}.w{k}"))) for k in range(WORDS)), F.lit(0))
    return (100 + PERCENT) * unequal <= (100 - PERCENT) * (F.col(f"{left}.n") + F.col(f"{right}.n"))


def line_roots(found: DataFrame) -> DataFrame:
    """(id, root) of the lines that share a bucket with another line. found: see lines(), as a written table, which goes."""
    # Lines are dealt out by id once, made distinct and signed where they land; a text that is compared is read again.
    items = written(signed(found.groupBy("id").agg(F.first("line").alias("line"))))
    free_shuffles(found.sparkSession)
    members = items.select("id", F.explode(_buckets()).alias("bucket"))

    def lines_of(ids: DataFrame) -> DataFrame:
        ids = written(ids)
        mine = written(found.select("id", "line").join(keyed(ids), "id", "left_semi").groupBy("id").agg(F.first("line").alias("line")))
        forget(ids)
        return mine

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs)
        mine = lines_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        x, y = mine.select(F.col("id").alias("a"), F.col("line").alias("line_a")), mine.select(F.col("id").alias("b"), F.col("line").alias("line_b"))
        links = written(similar(pairs.join(x, "a").join(y, "b")))
        forget(pairs, mine)
        return links

    roots = link(members, lambda ids: items.join(ids, "id", "left_semi"), _may, verify, (lambda ids: parities(lines_of(ids)), may_share))
    forget(found, items)
    return roots


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines (not blank), n_removed and removed (their numbers), for each document with a line that isn't blank."""
    found = written(lines(id_and_text(docs, id_col, text_col)))
    places = written(found.select("doc_id", "line_no", "id").distinct())
    roots = line_roots(found)
    at = written(places.join(roots, "id", "left").select("doc_id", "line_no", F.coalesce("root", "id").alias("root")))
    forget(places, roots)
    first = written(at.groupBy("root").agg(F.min(F.struct("doc_id", "line_no")).alias("first")))
    stays = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))
    judged = at.join(first, "root").select("doc_id", "line_no", stays.alias("stays"))
    return judged.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if(~F.col("stays")).alias("n_removed"), F.sort_array(F.collect_list(F.when(~F.col("stays"), F.col("line_no")))).alias("removed")
    )


def without_near_lines(docs: DataFrame) -> DataFrame:
    """The pipeline's form: the documents without the lines that are near an earlier one, with the columns that came in.

    A document that loses all its lines goes."""
    names = docs.columns
    gone = removed_lines(docs).filter("n_removed > 0").select("doc_id", F.struct("removed", (F.col("n_removed") == F.col("n_lines")).alias("all")).alias("gone"))
    # Everything that came in goes into one struct: no name of it can clash.
    both = docs.select(F.struct(*[docs[n] for n in names]).alias("row"), docs["doc_id"].cast("long").alias("doc_id")).join(gone, "doc_id", "left").filter("not coalesce(gone.all, false)")
    kept = F.filter(F.split("row.text", "\n"), lambda _, i: ~F.array_contains("gone.removed", i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    both = both.withColumn("text", text)
    chars = {"text": F.col("text"), **({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})}
    return both.select(*[chars.get(n, F.col("row")[n]).alias(n) for n in names])
