"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark column expressions.

Boosted trees of small depth are grown on labelled documents' statistics; every path from a root is a rule, a conjunction
of comparisons. A logistic regression with an L1 penalty weights the rules (most get none) and the standardised
statistics; the weighted rules become one column expression, so scoring is a projection beside the statistics.

Defined results: a null or empty text has all statistics 0 and gets the score of these. A label table with repeated rows
counts them; null labels are left out. With labels of one kind only, every score is that label; with none, 0.5. Extra
columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanset.llm.common import bounded_sample, id_and_text, map_arrow

STATS = (
    "log_words", "mean_word", "upper_share", "digit_share", "symbol_rate", "shout_rate", "pipe_rate", "comma_rate", "sentence_rate", "log_lines", "words_per_line",
    "dup_line_share", "unpunctuated_lines", "distinct_share", "repeat_share", "top_word_share", "long_word_share", "title_share",
)
_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def statistics(text: str | None) -> tuple[float, ...]:
    """STATS of one text; shares and rates are of its words, lines or bytes."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    size = sum(map(len, words))
    lines = [x for x in (line.strip() for line in raw.split(b"\n")) if x]
    counts = Counter(words)
    distinct, top = len(counts), max(counts.values()) / n
    pairs = len(set(zip(words, words[1:])))
    upper = size - len(raw.translate(None, _UPPER).translate(None, b" \t\n\r\x0b\x0c"))
    return (
        math.log1p(n), size / n, upper / size, (len(raw) - len(raw.translate(None, _DIGIT))) / size, sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">"))) / n, (raw.count(b"!!") + raw.count(b"??")) / n,
        raw.count(b"|") / n, raw.count(b",") / n, (raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")) / n, math.log1p(len(lines)), n / len(lines),
        1 - len(set(lines)) / len(lines), sum(x[-1:] not in b'.!?"' for x in lines) / len(lines), distinct / n, 1 - pairs / max(1, n - 1), top, sum(len(w) > 12 for w in words) / n, sum(b"A" <= w[:1] <= b"Z" for w in words) / n,
    )


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and a double column for each of STATS, over whole texts."""
    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATS)
    return map_arrow(id_and_text(docs, id_col, text_col), schema, lambda ids, texts: [ids, *zip(*map(statistics, texts))])


Condition = tuple[str, bool, float]  # a statistic, whether it is above, a bound


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)
    linear: list[tuple[str, float]] = field(default_factory=list)

    def score(self) -> Column:
        """The probability of label 1 as one expression over the statistics' columns."""
        z = F.lit(self.intercept)
        for conditions, weight in self.rules:
            holds = None
            for name, above, bound in conditions:
                c = F.col(name) > bound if above else F.col(name) <= bound
                holds = c if holds is None else holds & c
            z = z + F.when(holds, weight).otherwise(0.0)
        for name, weight in self.linear:
            z = z + F.col(name) * weight
        return 1 / (1 + F.exp(-z))


def tree_rules(text: str) -> list[tuple[Condition, ...]]:
    """The conjunctions on all paths of trees in the text form of pyspark.ml's ensembles: one for each node but the roots."""
    found, path = [], []
    for line in text.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-0-9.Ee]+)\)", line)
        if re.match(r" *Tree \d+", line):
            path, base = [], len(line) - len(line.lstrip()) + 2
        elif m:
            path = [*path[: len(m[1]) - base], (STATS[int(m[3])], m[4] == ">", float(m[5]))]
            found.append(tuple(path))
    return list(dict.fromkeys(found))


def fit(labelled: DataFrame, max_rows: int = 20_000, trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 11) -> RuleEnsemble:
    """labelled: doc_id, label and STATS. Fitted on about max_rows rows, by a hash of the id: the documented bound."""
    rows = labelled.filter("label is not null").select(F.col("label").cast("double").alias("label"), *STATS, "doc_id")
    rows = bounded_sample(rows, F.col("doc_id"), max_rows).drop("doc_id").repartition(4).cache()
    try:
        n, ones = rows.agg(F.count("*"), F.sum("label")).first()
        if not n:
            return RuleEnsemble(0.0)
        if ones in (0.0, float(n)):
            return RuleEnsemble(30.0 if ones else -30.0)
        ready = VectorAssembler(inputCols=list(STATS), outputCol="features").transform(rows)
        rules = tree_rules(GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed).fit(ready.select("features", "label")).toDebugString)
        holds = []
        for conditions in rules:
            c = F.lit(True)
            for name, above, bound in conditions:
                c = c & (F.col(name) > bound if above else F.col(name) <= bound)
            holds.append(c.cast("double"))
        table = rows.select("label", F.array(*holds, *(F.col(s) for s in STATS)).alias("x"))
        from pyspark.ml.functions import array_to_vector

        table = table.select("label", array_to_vector("x").alias("features")).cache()
        lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=True).fit(table)
        table.unpersist()
        w = [float(x) for x in lasso.coefficients.toArray()]
        return RuleEnsemble(float(lasso.intercept), [(r, x) for r, x in zip(rules, w) if x], [(s, x) for s, x in zip(STATS, w[len(rules) :]) if x])
    finally:
        rows.unpersist()


def quality_scores(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted (1 if score >= threshold) for each row."""
    return with_statistics(docs, id_col, text_col).select("doc_id", model.score().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
