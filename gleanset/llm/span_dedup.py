"""Substring dedup by sliding sentence spans.

A text is cut into sentences: at sentence marks before white space, at line ends, and, within sentences of more than
max_words words, after each pair of words whose hash is a multiple of CUT, and after max_words words without such a pair.
Copies of a passage are cut alike from its first such pair on, wherever in a sentence they start. From each sentence a span runs over the fewest consecutive sentences, two
at least, that hold min_words words. Spans are hashed and joined over all documents; every sentence that a repeated
span covers goes, except in the span's first place by document id and sentence number.

Hashes are of 64 bits and over lower-cased words: white space doesn't matter. With n spans about n * n / 2**65 pairs of
different ones share a hash.

Defined results: null and empty texts have no sentences and stay as they are; a text that ends before a span is full has
none from there. Rows with equal ids are one document. Rows without an id stay as they are and are compared with nothing.
Spans of one document repeat like those of several. Other columns aren't read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset.llm.common import id_and_text, map_arrow, written

BOUNDARY = re.compile(r"""[.!?…]["'”»)\]]*\s+|[。！？]\s*|\n\s*""")
CUT = 5  # one pair of words in so many ends a piece of a long sentence
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Spans:
    sentences: int = 2
    min_words: int = 12
    max_words: int = 16


def pieces(found: list[bytes], max_words: int) -> list[tuple[int, int]]:
    """(first word, end) of the pieces of a long sentence."""
    out, at, last = [], 0, len(found)
    for i in range(1, last + 1):
        if i == last or i - at == max_words or (i > 1 and xxhash.xxh3_64_intdigest(b"%b %b" % (found[i - 2], found[i - 1])) % CUT == 0):
            out.append((at, i))
            at = i
    return out


def sentences(text: str, max_words: int) -> list[tuple[int, list[bytes]]]:
    """(start, words) of each sentence with a word; a sentence reaches to the next one's start."""
    out, at = [], 0
    for end in [*(m.end() for m in BOUNDARY.finditer(text)), len(text)]:
        found = text[at:end].encode().lower().split()
        if len(found) > max_words:
            starts = [m.start() for m in WORDS.finditer(text, at, end)]
            out += [(starts[a], found[a:b]) for a, b in pieces(found, max_words)]
        elif found:
            out.append((at, found))
        at = end
    return out


def spans(text: str | None, how: Spans) -> list[tuple[int, int, int]]:
    """(first sentence, number of sentences, hash as a signed 64-bit number) of a text's spans."""
    cut = [w for _, w in sentences(text or "", how.max_words)]
    out, end, held = [], 0, 0
    for i, own in enumerate(cut):
        while end < len(cut) and (end - i < how.sentences or held < how.min_words):
            held += len(cut[end])
            end += 1
        if end - i < how.sentences or held < how.min_words:
            break
        h = xxhash.xxh3_64_intdigest(b" ".join([w for s in cut[i:end] for w in s]))
        out.append((i, end - i, h - (1 << 64) if h >> 63 else h))
        held -= len(own)
    return out


def span_table(docs: DataFrame, how: Spans) -> DataFrame:
    """doc_id, first, size and hash of all spans. docs: doc_id, text."""

    def rows(ids, texts):
        flat = [(i, *s) for i, t in zip(ids, texts) for s in spans(t, how)]
        return [list(c) for c in zip(*flat)] if flat else [[] for _ in range(4)]

    return map_arrow(docs.filter("doc_id is not null"), "doc_id long, first int, size int, hash long", rows)


def repeats(docs: DataFrame, how: Spans = Spans(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first, size and first_doc of the repeated spans, but for each one's first place."""
    found = written(span_table(id_and_text(docs, id_col, text_col), how))
    # Written, so that the join has two plain sides and a very common span's rows can be split among tasks.
    seen = written(found.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1").drop("n"))
    again = written(found.join(seen, "hash"))
    first = again.filter("doc_id = first_doc").groupBy("hash").agg(F.min("first").alias("first_at"))
    return again.join(first, "hash").filter("doc_id <> first_doc or first <> first_at").select("doc_id", "first", "size", "first_doc")


SCHEMA = "doc_id long, n_sentences long, n_removed long, removed string, text string"


def without_repeats(docs: DataFrame, how: Spans = Spans(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA for each row: the text without its repeated sentences; removed: their code points in the old text, as start:end,..."""
    texts = id_and_text(docs, id_col, text_col)
    cover = repeats(docs, how, id_col, text_col).select("doc_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("size") - 1)).alias("s")).distinct()
    gone = cover.groupBy("doc_id").agg(F.collect_list("s").alias("gone"))

    def rows(ids, found, lists):
        out = []
        for text, gone in zip(found, lists):
            cut = [s for s, _ in sentences(text or "", how.max_words)]
            ends = [*cut[1:], len(text or "")]
            lost = sorted(set(gone or ()))
            if not lost:
                out.append((len(cut), 0, "", text))
                continue
            kept, at, ranges = [], 0, []
            for s in lost:
                kept.append(text[at : cut[s]])
                at = ends[s]
                if ranges and ranges[-1][1] == cut[s]:
                    ranges[-1][1] = at
                else:
                    ranges.append([cut[s], at])
            out.append((len(cut), len(lost), ",".join(f"{a}:{b}" for a, b in ranges), "".join([*kept, text[at:]])))
        return [ids, *zip(*out)]

    return map_arrow(texts.join(gone, "doc_id", "left").select("doc_id", "text", "gone"), SCHEMA, rows)
