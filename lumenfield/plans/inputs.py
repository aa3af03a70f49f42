"""The tables of a data folder in the form the queries use: redelivered rows once, the basis joined to its vectors.

The basis is the nodes 0 to 98 with the vectors of the same ids; the remaining vectors are the terms. A node's root and
pattern are the label of its vector. Missing positions of the basis count as the origin, a missing level as 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

BASIS = 99


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "poincare_data_v3").dropDuplicates(["node_id"])


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_log").dropDuplicates(["log_id"])


def passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passages").dropDuplicates(["id"])


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pairs").dropDuplicates(["pair_id"])


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def basis(spark: SparkSession, d: str) -> DataFrame:
    """(name, ar, px, py, level, root, vec) of the 99 names."""
    vectors = table(spark, d, "embeddings").where(F.col("vec_id") < BASIS).select(F.col("vec_id").alias("name"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("root"))
    placed = nodes(spark, d).where(F.col("node_id") < BASIS).select(F.col("node_id").alias("name"), "ar", F.coalesce("px", F.lit(0.0)).alias("px"), F.coalesce("py", F.lit(0.0)).alias("py"), F.coalesce("level", F.lit(1)).alias("level"))
    return vectors.join(placed, "name", "left").select("name", "ar", F.coalesce("px", F.lit(0.0)).alias("px"), F.coalesce("py", F.lit(0.0)).alias("py"), F.coalesce("level", F.lit(1)).alias("level"), "root", "vec")


def terms(spark: SparkSession, d: str) -> DataFrame:
    """(term, label, vec) of the vectors that are no basis names."""
    return table(spark, d, "embeddings").where(F.col("vec_id") >= BASIS).select(F.col("vec_id").alias("term"), "label", F.col("embedding").cast("array<double>").alias("vec"))


#: The same in DuckDB, as common table expressions.
SQL = {
    "nodes": "nodes as (select distinct node_id, ar, px, py, r, level from poincare_data_v3)",
    "log": "log as (select distinct on (log_id) * from query_log)",
    "passages": "psg as (select distinct * from passages)",
    "pairs": "prs as (select distinct on (pair_id) * from pairs)",
    "basis": """basis as (select e.vec_id as name, n.ar, coalesce(n.px, 0) as px, coalesce(n.py, 0) as py, coalesce(n.level, 1) as level, e.label as root, e.embedding::double[] as vec
        from embeddings e left join (select distinct node_id, ar, px, py, level from poincare_data_v3) n on n.node_id = e.vec_id where e.vec_id < 99)""",
    "terms": "terms as (select vec_id as term, label, embedding::double[] as vec from embeddings where vec_id >= 99)",
}


def cte(*names: str) -> str:
    return "with " + ", ".join(SQL[n] for n in names)
