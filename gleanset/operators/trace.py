"""Why an expected name was found or missed: staged lookups in what each step kept and dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanset.functions import text as t


def _prepared(rows: DataFrame) -> DataFrame:
    name = t.normalize_name(F.coalesce("name", F.lit(""))) if "name" in rows.columns else F.lit("")
    return rows.select("scan_id", "ord", "text", t.normalize_name(F.coalesce("text", F.lit(""))).alias("norm"), name.alias("name_norm"))


def trace(expected: DataFrame, kept: DataFrame, suppressed: DataFrame, candidates: DataFrame, filtered: DataFrame, raw: DataFrame) -> DataFrame:
    """scan_id, expected, reason, ocr_text. expected: scan_id, expected (distinct); the others: scan_id, ord, text, and name."""
    e = expected.select("scan_id", "expected").distinct().withColumn("norm", t.normalize_name(F.col("expected")))
    en, rn, name = F.col("e.norm"), F.col("r.norm"), F.col("r.name_norm")
    same = rn == en
    within = same | F.contains(rn, en) | F.contains(en, rn)
    steps = {
        "k": (kept, (name == en) | same), "s": (suppressed, (name == en) | within), "c": (candidates, within), "f": (filtered, same | F.contains(en, rn)),
        "r": (raw, same | F.contains(en, rn) | F.contains(rn, F.split(en, " ")[0])),
    }
    # All steps' rows meet the expected names in one join: of each step the first row of the scan, by ord.
    rows = reduce(DataFrame.unionByName, [_prepared(df).withColumn("step", F.lit(c)) for c, (df, _) in steps.items()])
    meets = reduce(lambda case, c: case.when(F.col("r.step") == c, steps[c][1]), steps, F.when(F.lit(False), F.lit(False)))
    pairs = e.alias("e").join(rows.alias("r"), (F.col("e.scan_id") == F.col("r.scan_id")) & meets)
    first = lambda c: F.min_by(F.when(F.col("r.step") == c, F.struct(F.col("r.text").alias("text"), F.col("r.name_norm").alias("name"))), F.when(F.col("r.step") == c, F.col("r.ord"))).alias(c)
    found = pairs.groupBy(F.col("e.scan_id").alias("scan_id"), F.col("e.expected").alias("expected")).agg(*[first(c) for c in steps])
    e = e.join(found, ["scan_id", "expected"], "left")
    reason = F.when(F.col("k.name") == F.col("norm"), "matched").when(F.col("k").isNotNull(), "ocr-wrong-match").when(F.col("s").isNotNull(), "suppressed").when(F.col("c").isNotNull(), "ocr-unmatched")
    reason = reason.when(F.col("f").isNotNull(), "filtered").when(F.col("r").isNotNull(), "ocr-unmatched").otherwise("not-detected")
    return e.select("scan_id", "expected", reason.alias("reason"), F.coalesce(*[F.col(f"{c}.text") for c in "kscfr"]).alias("ocr_text"))


def misses(traced: DataFrame) -> DataFrame:
    return traced.groupBy("scan_id").agg(F.count("*").alias("n_expected"), F.count_if(F.col("reason") != "matched").alias("n_missed"))
