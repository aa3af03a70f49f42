"""The append-only log as a stream: records are stored if their key hasn't been stored before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import strip_diac

KEY = "term_key"


def keyed(records: DataFrame) -> DataFrame:
    """Add the key records are stored under, without vowel marks; records without one are dropped."""
    key: Column = F.coalesce(F.col("term_undiacritized"), strip_diac("term_ar"))
    return records.withColumn(KEY, key).where(F.col(KEY).isNotNull() & (F.col(KEY) != ""))


def unseen(records: DataFrame) -> DataFrame:
    """Only the first record of every key, over the whole life of the stream (the state keeps all keys, as the log does)."""
    return keyed(records).dropDuplicates([KEY])


def append_unseen(spark: SparkSession, source: str, target: str, checkpoint: str, schema) -> StreamingQuery:
    """Follow a folder of parquet files and append unseen records to the target once each; runs until what is there is read."""
    stream = unseen(spark.readStream.schema(schema).parquet(source))
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def append_batch(stored: DataFrame, records: DataFrame, order: str) -> DataFrame:
    """The batch form: what of new records is to be appended to what is stored (first of each key, in the order)."""
    from ..operators.hygiene import first_of_key

    fresh = first_of_key(keyed(records), F.col(KEY), order)
    return fresh.join(keyed(stored).select(KEY), KEY, "left_anti")
