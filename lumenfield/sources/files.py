"""Reading and writing the formats in use: JSON documents, tolerant JSON lines, plain text, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The log record, with what older and newer writers leave out nullable.
_NAMES = T.ArrayType(T.StructType([T.StructField("ar", T.StringType()), T.StructField("sim", T.DoubleType())]))
_POSITION = T.StructType([T.StructField("px", T.DoubleType()), T.StructField("py", T.DoubleType()), T.StructField("r", T.DoubleType()), T.StructField("level", T.IntegerType()), T.StructField("level_label", T.StringType())])
RECORD = T.StructType([
    T.StructField("term_ar", T.StringType()), T.StructField("term_undiacritized", T.StringType()), T.StructField("top_name_attractors", _NAMES), T.StructField("bottom_names", _NAMES),
    T.StructField("estimated_position", _POSITION), T.StructField("dominant_wazn", T.StringType()), T.StructField("query_wazn", T.StringType()), T.StructField("query_wazn_status", T.StringType()),
    T.StructField("cluster_wazn", T.StringType()), T.StructField("poincare_dist_to_primary", T.DoubleType()), T.StructField("abjad_value", T.IntegerType()), T.StructField("timestamp", T.StringType()), T.StructField("pipeline", T.StringType()),
])
NODE = T.StructType([T.StructField("ar", T.StringType()), T.StructField("px", T.DoubleType()), T.StructField("py", T.DoubleType()), T.StructField("r", T.DoubleType()), T.StructField("level", T.IntegerType())])


def read_lines(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> tuple[DataFrame, DataFrame]:
    """(records, rejected): JSON lines under a schema; malformed lines go to the second table with their first 200 characters.

    Names written as pairs [ar, sim] are read as structs.
    """
    pairs = {f.name for f in schema.fields if f.dataType == _NAMES}
    loose = T.StructType([T.StructField(f.name, T.ArrayType(T.StringType()) if f.name in pairs else f.dataType) for f in schema.fields] + [T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", loose, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = parsed.where("r is not null and r._corrupt is null")

    def names(c: str):
        one = lambda x: F.when(x.startswith("["), F.struct(F.get(F.from_json(x, "array<string>"), F.lit(0)).alias("ar"), F.get(F.from_json(x, "array<string>"), F.lit(1)).cast("double").alias("sim"))).otherwise(F.from_json(x, _NAMES.elementType))
        return F.transform(F.col(f"r.{c}"), one)

    records = good.select(*[(names(f.name) if f.name in pairs else F.col(f"r.{f.name}")).alias(f.name) for f in schema.fields])
    return records, parsed.where("r is null or r._corrupt is not null").select(F.substring("value", 1, 200).alias("raw"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a disk document ({"nodes": [...]})."""
    document = spark.read.schema(T.StructType([T.StructField("nodes", T.ArrayType(NODE))])).json(path, multiLine=True)
    return document.select(F.explode("nodes").alias("n")).select("n.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_table(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A table by the suffix of its path: parquet, orc, json (lines) or csv."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    return spark.read.options(**options).format({"jsonl": "json", "ndjson": "json"}.get(kind, kind)).load(path)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, one directory; text stays as it is, not escaped."""
    df.write.mode("errorifexists").json(path)


def checksum(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256): the SHA-256 of files, in capitals."""
    return spark.read.format("binaryFile").load(path).select("path", F.upper(F.sha2("content", 256)).alias("sha256"))
