"""URL filter: host and path rules, and gradient-boosted trees over lexical features for the URLs that no rule decides.

The trees learn from labelled URLs (url, label: 1 to block). Features: lengths, depth, digit ratio, entropy, counts of
parameters and marks, and suffix statistics: the smoothed share of blocked URLs among the labelled ones of a host's
suffix, of its suffix with the path's first part, and of that part alone.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and is left to the trees. Of
two rules that fit, the longer wins; rules are distinct, and equally long ones that fit one URL have one verdict or the
first by text. Repeated URLs get the same verdict. With fewer than two labels in training, the verdict is the one label
there is (allow if none). Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanset.llm.common import bounded_sample, written

#: Parts of host names that mark a labelled URL as one to block.
SEED_WORDS = "ads adult bet bets bonus casino cheap click coupon dating escort free-download gambling hack loan lottery malware phish pills poker porn promo sex spam torrent track tracker viagra warez win xxx".split()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIX_STATS = ("suffix", "suffix_part", "part")
FEATURES = ("url_length", "host_length", "host_labels", "host_hyphens", "host_digits", "path_length", "depth", "n_params", "has_fragment", "digit_ratio", "entropy", "marks", "https", *(f"p_{s}" for s in SUFFIX_STATS))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. rules: (host/path, allow or block)."""
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        rule_host, _, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rule_path}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    nothing = F.lit(None).cast("string")
    return (rule, verdict) if rules else (nothing, nothing)


def seed_label(host: Column) -> Column:
    """1 for hosts with a seed word between dots and hyphens, else 0: labels by a block list, which the trees generalise."""
    return F.regexp_like(host, F.lit(rf"(^|[.-])({'|'.join(SEED_WORDS)})([.-]|$)")).cast("double")


def lexical(urls: DataFrame) -> DataFrame:
    """The lexical features of a url column, beside what is there; host and path must be there."""
    url = F.coalesce(F.col("url"), F.lit(""))
    chars = F.filter(F.split(url, ""), lambda c: c != "")
    n = F.greatest(F.length(url), F.lit(1))
    # Entropy by sorted runs: distinct characters, and how often each stands in the url.
    entropy = F.aggregate(
        F.array_distinct(chars), F.lit(0.0),
        lambda acc, c: acc - ((F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n) * F.log2(F.greatest(F.length(url) - F.length(F.replace(url, c, F.lit(""))), F.lit(1)) / n),
    )
    labels = F.split("host", r"\.")
    part = F.regexp_extract("path", r"^/([^/]*)", 1)
    suffix = F.element_at(labels, -1)
    return urls.withColumns(
        {
            "url_length": F.length(url), "host_length": F.length("host"), "host_labels": F.size(labels), "host_hyphens": F.regexp_count("host", F.lit("-")), "host_digits": F.regexp_count("host", F.lit("[0-9]")),
            "path_length": F.length("path"), "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")), "n_params": F.when(F.contains(url, F.lit("?")), F.regexp_count(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("&")) + 1).otherwise(0),
            "has_fragment": F.contains(url, F.lit("#")).cast("int"), "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / n, "entropy": entropy, "marks": F.regexp_count(url, F.lit("[^A-Za-z0-9]")), "https": F.startswith(url, F.lit("https:")).cast("int"),
            "suffix": suffix, "part": part, "suffix_part": F.concat_ws("/", suffix, part),
        }
    )


@dataclass
class UrlModel:
    """stats: for each suffix statistic a map of the smoothed block share of its most frequent keys; rest: tables (key, share) of all
    its other keys; prior: for keys that weren't seen."""

    stats: dict[str, dict[str, float]]
    prior: float
    trees: object | None
    rest: dict[str, DataFrame] = field(default_factory=dict)

    def score(self, urls: DataFrame) -> DataFrame:
        """urls with block_score (0 to 1)."""
        names = urls.columns
        if self.trees is None:
            return urls.withColumn("block_score", F.lit(self.prior))
        rows = self._features(lexical(urls))
        return self.trees.transform(rows).select(*names, vector_to_array("probability")[1].alias("block_score"))

    def _features(self, rows: DataFrame) -> DataFrame:
        for name, shares in self.stats.items():
            known = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]) if shares else None
            share = F.try_element_at(known, F.col(name)) if shares else F.lit(None).cast("double")
            if name in self.rest:
                # Rows whose key the map knows match nothing and are dealt out by their URL, so that no frequent key is one task's.
                rows = rows.withColumn("_share", share).withColumns({"_key": F.when(F.col("_share").isNull(), F.col(name)), "_deal": F.when(F.col("_share").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) + 1)})
                others = self.rest[name].select(F.col("key").alias("_key"), F.lit(0).cast("long").alias("_deal"), F.col("share").alias("_other"))
                rows = rows.join(others, ["_key", "_deal"], "left")
                share = F.coalesce("_share", "_other")
            rows = rows.withColumn(f"p_{name}", F.coalesce(share, F.lit(self.prior))).drop("_key", "_deal", "_share", "_other")
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.withColumns({c: F.col(c).cast("double") for c in FEATURES}))


def train(labelled: DataFrame, max_rows: int = 40_000, max_keys: int = 500, trees: int = 10, depth: int = 4, seed: int = 7) -> UrlModel:
    """labelled: url, host, path, label (1 to block).

    The suffix statistics count every labelled row and keep every key: the max_keys most frequent ones as a map, the others as
    a table that URLs are joined with. The trees are fitted on about max_rows labelled URLs, by a hash of the URL: the
    documented bound of the training sample.
    """
    smooth = 20.0
    rows = lexical(labelled.select("url", "host", "path", F.col("label").cast("double").alias("label")))
    total = rows.agg(F.count("*").alias("n"), F.sum("label").alias("s")).first()
    if not total.n or total.s in (0.0, float(total.n)):
        return UrlModel({}, float(bool(total.n and total.s)), None)
    prior, stats, rest = total.s / total.n, {}, {}
    for name in SUFFIX_STATS:
        counts = rows.groupBy(F.col(name).alias("key")).agg(F.count("*").alias("n"), F.sum("label").alias("s"))
        by_key = written(counts.withColumn("share", (F.col("s") + smooth * prior) / (F.col("n") + smooth)))
        top = by_key.orderBy(F.desc("n"), "key").limit(max_keys).collect()
        stats[name] = {r.key: r.share for r in top}
        if len(top) == max_keys:
            others = by_key.filter((F.col("n") < top[-1].n) | (F.col("n") == top[-1].n) & (F.col("key") > top[-1].key)) if top else by_key
            size = others.agg(F.count("*").alias("n"), F.sum(F.octet_length("key") + 16).alias("bytes")).first()
            if size.n:
                rest[name] = others.hint("broadcast" if size.bytes <= 4 << 20 else "shuffle_hash")
    model = UrlModel(stats, prior, None, rest)
    sample = bounded_sample(rows, F.col("url"), max_rows)
    # In the order of the URLs, whatever the joins' was, so that the trees' splits are the same on each run.
    fitted = model._features(sample).select("features", "label", "url").repartition(4, "url").sortWithinPartitions("url", "label").select("features", "label").cache()
    try:
        model.trees = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.3).fit(fitted)
    finally:
        fitted.unpersist()
    return model


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """The id, host, path, rule, verdict and block_score of each row. Without a model, the pages' own URLs are labelled by seed_label()."""
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "rule_verdict": verdict})
    if model is None:
        model = train(urls.withColumn("label", seed_label(F.col("host"))))
    scored = model.score(urls)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("block_score") >= threshold, "block").otherwise("allow")).alias("verdict"), "block_score")
