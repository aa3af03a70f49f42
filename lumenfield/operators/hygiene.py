"""Hygiene of term records: noise rules, validation, keys, cleaning with an audit, contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import nfc, strip_diac, stripped

#: Number words that calibrate a model and are no terms.
NUMBER_WORDS = "واحد اثنان اثنين ثلاثة أربعة خمسة ستة سبعة ثمانية تسعة عشرة عشرون ثلاثون أربعون خمسون ستون سبعون ثمانون تسعون مائة مائتان مئة مئتان ألف ألفان مليون".split()
DIGITS = "[0-9\\u0660-\\u0669]"
LIVE_MARKERS = "[ÃÂØÙÐ]"


def is_noise(term: Column) -> Column:
    """The live rule: number words (article and marks aside), digits, garbled characters. Null counts as the empty term."""
    t = stripped(F.coalesce(term, F.lit("")))
    bare = F.regexp_replace(strip_diac(t), "^ال", "")
    return bare.isin(NUMBER_WORDS) | t.isin(NUMBER_WORDS) | t.rlike(DIGITS) | t.rlike(LIVE_MARKERS)


def noise_reason(term: Column) -> Column:
    """The first reason to drop a term, or null; marks stay on, so vowelled number words pass. Null counts as empty."""
    t = nfc(stripped(F.coalesce(term, F.lit(""))))
    bare = F.regexp_replace(t, "^ال", "")
    return (
        F.when(bare.isin(NUMBER_WORDS) | t.isin(NUMBER_WORDS), "calibration_number_word")
        .when(t.rlike(DIGITS), "contains_digits")
        .when(t.rlike("[A-Za-z]") & ~t.rlike("[\\u0600-\\u06FF]"), "non_arabic")
        .when(F.length(F.regexp_replace(t, "[^\\u0600-\\u06FF]", "")) < 2, "too_short")
    )


def validation(r: Column, px: Column, py: Column) -> Column:
    """What is wrong with a position, or null."""
    return F.when((r < 0) | (r > 1), F.concat(F.lit("r_out_of_range:"), r.cast("string"))).when(F.sqrt(px * px + py * py) > 1 + 1e-9, "outside_poincare_disk")


def term_key(*candidates: Column) -> Column:
    """The first candidate that isn't null or empty, trimmed and composed."""
    return nfc(stripped(F.coalesce(*[F.when(c != "", c) for c in candidates])))


def cleaned(records: DataFrame, key: Column, order: str, repaired: Column | None = None) -> DataFrame:
    """Add ``reason``: why a record is dropped (noise, a bad position, a repeated key), or null for those kept.

    The first record of a key in the order is kept; only records without another reason compete. Expects term, r, px, py.
    """
    term = repaired if repaired is not None else F.col("term")
    judged = records.withColumn("reason", F.coalesce(noise_reason(term), validation(F.col("r"), F.col("px"), F.col("py")))).withColumn("__key", key)
    place = F.row_number().over(W.partitionBy("__key").orderBy(F.col("reason").isNotNull(), order))
    return judged.withColumn("__n", place).withColumn("reason", F.coalesce("reason", F.when(F.col("__n") > 1, "duplicate"))).drop("__n", "__key")


def first_of_key(records: DataFrame, key: Column, order: str) -> DataFrame:
    """The first record of every key; null keys are dropped."""
    keyed = records.withColumn("__key", key).where("__key is not null")
    return keyed.withColumn("__n", F.row_number().over(W.partitionBy("__key").orderBy(order))).where("__n = 1").drop("__n", "__key")


def contract(rows: DataFrame, expected: int, columns: list[str], name: str, level: str) -> DataFrame:
    """(check, passed) of a basis table: row count, columns, distinct names, levels."""
    got = set(rows.columns)
    facts = rows.agg(F.count("*").alias("n"), F.countDistinct(name).alias("names"), F.count(F.when(~F.col(level).isin(0, 1, 2) | F.col(level).isNull(), 1)).alias("odd"))
    checks = [("row_count", F.col("n") == expected), ("missing_columns", F.lit(not set(columns) - got)), ("extra_columns", F.lit(not got - set(columns))), ("names_distinct", F.col("names") == F.col("n")), ("levels", F.col("odd") == 0)]
    return facts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), ok.alias("passed")) for c, ok in checks])).alias("c")).select("c.check", "c.passed")


def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with ``side`` left or right; repeated rows count."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
