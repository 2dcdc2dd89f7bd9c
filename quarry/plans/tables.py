"""The analytics tables that queries run on, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: What orders the lines of an order: no two columns of it are unique together.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, src, dst: the part before each part of an order, where 48 or more were bought."""
    own = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER).withColumn("src", F.lag("l_partkey").over(own))
    return lines.filter("l_quantity >= 48 AND src IS NOT NULL").select(F.lit("p").alias("project"), "src", F.col("l_partkey").alias("dst")).withColumns(
        {"src": F.col("src").cast("string"), "dst": F.col("dst").cast("string")}
    )


def part_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_partkey % 100 = 0").select(F.lit("p").alias("project"), F.col("p_partkey").cast("string").alias("node"))


EDGES_SQL = """
edges AS (
  SELECT DISTINCT src, dst FROM (
    SELECT lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS src,
      l_partkey AS dst, l_quantity FROM lineitem) WHERE l_quantity >= 48 AND src IS NOT NULL
)"""
ALL_EDGES_SQL = EDGES_SQL.replace("SELECT DISTINCT src, dst", "SELECT src, dst")
REACHED_SQL = f"""
WITH RECURSIVE {EDGES_SQL.strip()},
reached(node) AS (
  SELECT p_partkey FROM part WHERE p_partkey % 100 = 0
  UNION SELECT e.dst FROM reached r JOIN edges e ON e.src = r.node
)"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, line, line_text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "line_text")).withColumn("line", F.col("at") + 1).drop("at")


LINES_SQL = """
lines AS (
  SELECT doc_id, source, lang, generate_subscripts(ls, 1) AS line, unnest(ls) AS line_text
  FROM (SELECT doc_id, source, lang, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
)"""
