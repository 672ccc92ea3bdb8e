"""Stand-ins: the engine's tables as views of the test tables, in both engines' terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.operators.regions import number_regions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on a 1024 x 1536 canvas from lineitem by integer arithmetic."""
    li = table(spark, sf_dir, "lineitem")
    boxes = li.select(
        F.col("l_orderkey").alias("sample_id"),
        ((F.col("l_partkey") * 37) % 900).cast("int").alias("x"),
        ((F.col("l_suppkey") * 53 + F.col("l_linenumber") * 101) % 1400).cast("int").alias("y"),
        (8 + F.col("l_partkey") % 100).cast("int").alias("w"),
        (6 + F.col("l_suppkey") % 40).cast("int").alias("h"),
        F.lit(1024).alias("iw"),
        F.lit(1536).alias("ih"),
    )
    return number_regions(boxes)


REGIONS_SQL = """
boxes AS (
  SELECT l_orderkey AS sample_id, CAST((l_partkey * 37) % 900 AS INT) AS x,
         CAST((l_suppkey * 53 + l_linenumber * 101) % 1400 AS INT) AS y,
         CAST(8 + l_partkey % 100 AS INT) AS w, CAST(6 + l_suppkey % 40 AS INT) AS h, 1024 AS iw, 1536 AS ih
  FROM lineitem),
regions AS (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY y, x, h, w) - 1 AS ord FROM boxes)
"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as image rows: group, label, split and a few attributes."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("sample_id"),
        F.col("o_custkey").alias("group_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "ai_generated").otherwise("non_ai_generated").alias("label"),
        F.when(F.col("o_custkey") % 7 == 0, "test").when(F.col("o_custkey") % 7 == 1, "validation").when(F.col("o_orderkey") % 11 == 0, F.lit(None)).when(F.col("o_orderkey") % 97 == 0, "test").otherwise("train").alias("split"),
        F.col("o_orderpriority").alias("format"),
        F.col("o_orderstatus").alias("acquisition"),
        F.col("o_totalprice").alias("price"),
    )


MANIFEST_SQL = """
manifest AS (
  SELECT o_orderkey AS sample_id, o_custkey AS group_id,
         CASE WHEN o_orderkey % 3 = 0 THEN 'ai_generated' ELSE 'non_ai_generated' END AS label,
         CASE WHEN o_custkey % 7 = 0 THEN 'test' WHEN o_custkey % 7 = 1 THEN 'validation' WHEN o_orderkey % 11 = 0 THEN NULL
              WHEN o_orderkey % 97 = 0 THEN 'test' ELSE 'train' END AS split,
         o_orderpriority AS format, o_orderstatus AS acquisition, o_totalprice AS price
  FROM orders)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score in [0, 1) and a second feature."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("n_chars").cast("double")
    return d.select(
        F.col("doc_id").alias("sample_id"), F.col("quality").cast("int").alias("label"), F.col("toxic").cast("int").alias("toxic"),
        ((F.col("n_chars") % 997) / 997.0).alias("score"), n.alias("length"), F.when(F.col("n_chars") % 5 != 0, n * n).alias("square"),
        (F.col("n_chars") % 13).cast("double").alias("noise"),
    )


SCORED_SQL = """
scored AS (
  SELECT d.doc_id AS sample_id, CAST(quality AS INT) AS label, CAST(toxic AS INT) AS toxic, CAST(n_chars % 997 AS DOUBLE) / 997.0::DOUBLE AS score,
         CAST(n_chars AS DOUBLE) AS length, CASE WHEN n_chars % 5 <> 0 THEN CAST(n_chars AS DOUBLE) * CAST(n_chars AS DOUBLE) END AS square,
         CAST(n_chars % 13 AS DOUBLE) AS noise
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""
