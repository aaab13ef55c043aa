"""Line-first quality rules.

Every line of a text is judged by itself: punctuation, navigation, boilerplate and symbol rules. Failing lines go; a
document whose failing lines hold more than max_lost of its words is rejected, as is one that fails the document base
(too few words, or mostly repeated word triples).

Defined results: a null or empty text has no words and is rejected; a text of blank lines likewise. Lines without a word
are kept as they are and never count as duplicates. Repeated rows are judged one by one; an empty table gives an empty
table; columns other than the id and the text are not read. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset.llm.common import SPACES, id_and_text, map_arrow

SYMBOLS = "#*$%&|<>"
SENTENCE_MARKS = re.compile(r"[.!?…。！？]")
SEPARATORS = re.compile(r"(?:^|[ \t])[|»›·•/>](?=[ \t]|$)")
SHOUTED = re.compile(rb"[!?]{2,}$")
BOILERPLATE = re.compile(
    r"all rights reserved|licen[sc]ed under|released under the|privacy policy|cookie policy|terms of (?:use|service)|"
    r"enable javascript|subscribe to our|sign up for our|click here|follow us on|skip to (?:main )?content|lorem ipsum",
    re.IGNORECASE,
)
#: Words that stand alone in menus.
MENU_WORDS = frozenset(b"home login logout register search menu about contact help faq sitemap next previous prev back top share print rss".split())

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines long, n_failed_lines long, failed_words long, clean_text string"
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat: float = 0.5
    max_lost: float = 0.4
    max_symbols_per_word: float = 0.5
    max_shouted: float = 0.5
    min_separators: int = 3
    unpunctuated_words: int = 3


def line_failure(line: str, line_words: list[bytes], rules: Rules = Rules()) -> str | None:
    """The first rule that a line with words fails, or None."""
    n = len(line_words)
    if sum(map(line.count, SYMBOLS)) > rules.max_symbols_per_word * n:
        return "symbols"
    if len(SEPARATORS.findall(line)) >= rules.min_separators or n <= 6 and all(w.strip(b"|>.,:;-").lower() in MENU_WORDS for w in line_words):
        return "navigation"
    if BOILERPLATE.search(line):
        return "boilerplate"
    if n >= rules.unpunctuated_words and not SENTENCE_MARKS.search(line):
        return "no sentence mark"
    if n >= 3 and sum(1 for w in line_words if SHOUTED.search(w)) > rules.max_shouted * n:
        return "shouted"
    return None


def repeat_words(text_words: list[bytes]) -> int:
    """Words that stand in a window of three words that the text has twice or more."""
    if len(text_words) < 4:
        return 0
    windows = list(zip(text_words, text_words[1:], text_words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered_to = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, covered_to)
            covered_to = i + 3
    return total


def judge(text: str | None, rules: Rules = Rules()) -> tuple:
    """The columns of SCHEMA but doc_id for one text."""
    text = text or ""
    all_words = text.encode().split()
    n_words = len(all_words)
    seen, clean = set(), []
    dup = lines = failed = lost = 0
    for line in text.split("\n"):
        line_words = line.encode().split()
        if not line_words:
            clean.append(line)
            continue
        lines += 1
        dup += line in seen
        seen.add(line)
        if line_failure(line, line_words, rules):
            failed += 1
            lost += len(line_words)
        else:
            clean.append(line)
    repeats = repeat_words(all_words)
    base_failed = n_words < rules.min_words or repeats > rules.max_repeat * n_words
    kept = not base_failed and lost <= rules.max_lost * n_words
    return n_words, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeats, base_failed, kept, lines, failed, lost, "\n".join(clean)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """SCHEMA, a row for each input row; clean_text is the text without its failing lines. No shuffle."""
    return map_arrow(id_and_text(docs, id_col, text_col), SCHEMA, lambda ids, texts: [ids, *zip(*(judge(t, rules) for t in texts))])


def keep_clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The pipeline's form: documents that pass, their failing lines removed, with the columns that came in."""
    from pyspark.sql.types import StringType

    names = docs.columns
    at = names.index("text")
    schema = docs.schema
    schema[at].dataType = StringType()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            judged = [judge(t, rules) for t in b.column(at).to_pylist()]
            keep = pa.array([j[6] for j in judged], pa.bool_())
            yield b.set_column(at, names[at], pa.array([j[10] for j in judged], b.column(at).type)).filter(keep)

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
