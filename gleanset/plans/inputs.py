"""The role tables (catalog, queries, detections, regions ...) made from the star schema's tables.

Each is an expression per column, so that a check in another engine can build the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from gleanset.operators.catalog import build_index
from gleanset.sources.ocr import numbered

DETECTION = {
    "scan_id": "scan_id", "ord": "ord", "name": "CASE WHEN pk % 9 = 0 THEN NULL WHEN pk % 7 = 0 THEN 'Island' WHEN pk % 7 = 1 THEN 'Mountain' ELSE p_name END",
    "detected_text": "CASE WHEN pk % 4 = 1 THEN replace(p_name, 'o', '0') ELSE p_name END", "confidence": "CAST((pk * 7 + ord * 13) % 100 AS DOUBLE) / 100",
    "status": "CASE WHEN pk % 9 = 0 THEN 'unknown' WHEN pk % 3 = 0 THEN 'uncertain' ELSE 'confirmed' END", "count": "CAST(CASE WHEN q % 5 = 0 THEN NULL ELSE q % 4 END AS INT)",
    "count_source": "CASE WHEN q % 5 = 0 THEN NULL ELSE 'dice' END", "x": "CAST((pk % 6) * 60 + sk % 9 AS DOUBLE)", "y": "CAST((sk % 25) * 28 + ord % 5 AS DOUBLE)",
    "width": "CAST(30 + (pk * 7) % 60 AS DOUBLE)", "height": "CAST(8 + (sk * 3 + ord) % 16 AS DOUBLE)", "pk": "pk",
}
REGION = {
    "scan_id": "scan_id", "ord": "ord", "text": "text", "confidence": "CAST((ord * 7 + scan_id * 11) % 100 AS DOUBLE) / 100", "x": "CAST((ord * 97 + scan_id * 31) % 900 AS DOUBLE)",
    "y": "CAST((ord * 43 + scan_id * 17) % 700 AS DOUBLE)", "width": "CAST(12 + (ord * 29 + scan_id * 7) % 240 AS DOUBLE)", "height": "CAST(6 + (ord * 13 + scan_id * 3) % 30 AS DOUBLE)",
}
QUERY_TEXT = "CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 1 THEN replace(p_name, 'o', '0') WHEN p_partkey % 4 = 2 THEN substring(p_name, 1, length(p_name) - 2) ELSE concat('x ', p_name, '!') END"
CANVAS = (900.0, 700.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detection for each line item; its order is the scan."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select("*", F.row_number().over(w).cast("long").alias("ord"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey AS scan_id", "ord", "p_name", "l_partkey AS pk", "l_suppkey AS sk", "CAST(l_quantity AS BIGINT) AS q")
    return rows.selectExpr(*[f"{e} AS {c}" for c, e in DETECTION.items()])


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_id, ord, text: every stretch of a document between line ends and full stops."""
    # Dealt out by document: a file with few row groups would keep all the work on texts in as few tasks.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    cut = docs.select(F.col("doc_id").alias("scan_id"), F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit(".")), r"\.")).alias("ord", "text"))
    return cut.select("scan_id", F.col("ord").cast("long").alias("ord"), "text")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text region for each sentence; its document is the scan."""
    return sentences(spark, sf_dir).selectExpr(*[f"{e} AS {c}" for c, e in REGION.items()])


def seen_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text region for each detection: its text and box."""
    return detections(spark, sf_dir).select("scan_id", "ord", F.col("detected_text").alias("text"), "confidence", "x", "y", "width", "height")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """card_ord, name: the parts' names; every fifth has two faces."""
    names = numbered(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))
    return names.select("card_ord", F.expr("CASE WHEN card_ord % 5 = 0 THEN replace(name, ' ', ' // ') ELSE name END").alias("name"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_index(catalog(spark, sf_dir))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text, confidence, prefer_lands: each part's name, misread in one of four ways."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS query_id", f"{QUERY_TEXT} AS text", "CAST(50 + p_partkey % 50 AS DOUBLE) / 100 AS confidence", "p_partkey % 3 = 0 AS prefer_lands")


def dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with numbers, one beside each detection."""
    return detections(spark, sf_dir).selectExpr("scan_id", "ord", "CAST((pk + ord) % 30 AS STRING) AS text", "confidence", "x + 10 AS x", "y + 25 AS y", "CAST(8 AS DOUBLE) AS width", "CAST(9 AS DOUBLE) AS height")


def lands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).filter("name in ('Island', 'Mountain')")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_id, ord, verdict, corrected_text for most detections."""
    verdict = "CASE pk % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'corrected' WHEN 2 THEN 'not-card' WHEN 3 THEN 'unreviewed' END"
    rows = detections(spark, sf_dir).selectExpr("scan_id", "ord", f"{verdict} AS verdict", "CASE WHEN pk % 5 = 1 AND pk % 10 = 1 THEN concat(' ', detected_text, ' ') ELSE '' END AS corrected_text")
    return rows.filter("verdict is not null")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, r, g, b: a pixel for each line item, on the image of its supplier."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", (F.row_number().over(w) - 1).cast("long").alias("i"))
    return rows.selectExpr("l_suppkey AS image_id", "i % 20 AS x", "CAST(floor(i / 20) AS BIGINT) AS y", "i", "(l_partkey * 7 + l_orderkey) % 256 AS r", "(l_partkey * 3) % 256 AS g", "l_orderkey % 256 AS b")
