"""Bring visually identical text to one consistent form.

Method. Distinct values are exploded to positioned code points; a broadcast join with the decomposition table replaces
full-width, presentation and other compatibility forms, drops what is invisible and turns every kind of space into the
ordinary one; a second broadcast join with the look-alike table moves letters of another script into the script of
their word; combining marks are ordered by their class behind their base, base and marks are recomposed, and the strings
are rebuilt. Every table has a size bound by Unicode itself (30,000 rows), not by the data.

The script of a word is the one most of its unmistakable letters have (letters without a look-alike in another script of
the word, and Latin letters under an accent); words wholly in one script are never changed into another. Vowel marks and kashida are visible and stay.

Null stays null; the empty text, and text of nothing but invisible characters, becomes the empty text. Values are
exploded once each, however often they occur, so a hot value costs as much as any other. A value may have any length:
its code points are spread over rows, numbered by running counts, and gathered again word by word and group by group, so the work
is in proportion to the length.

Letters that Persian, Urdu and other languages write for an Arabic shape are standard letters there. ``arabic_only`` says whether
they are taken for dirty spellings of Arabic (the default, as the tables of this project hold Arabic words); otherwise they stay.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import sized, written

#: Letters that look like a Latin letter, by script, written as pairs (letter, Latin letter).
LATIN_LOOKS = {
    "Cyrillic": "аa еe оo рp сc уy хx ѕs іi јj һh ӏl ԁd ԛq ԝw ԍg ѵv АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT ХX ҮY ԚQ ԜW ԌG",
    "Greek": "οo ιi νv αa ρp υu ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX",
    "Armenian": "օo ոn սu հh ցg քp զq յj ՏS ՕO Սu",
}
#: Letters of the Arabic block that other languages write for the same shape, and the standard letter.
ARABIC_LOOKS = "یي کك ھه ہه ەه ٮب ڪك ېي"
#: Invisible characters that are no format characters by category.
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), 0x2800]

SCRIPTS = {"LATIN": "Latin", "FULLWIDTH": "Latin", "CYRILLIC": "Cyrillic", "GREEK": "Greek", "ARMENIAN": "Armenian", "ARABIC": "Arabic", "HEBREW": "Hebrew"}


def _script(char: str) -> str:
    """The script of a letter, empty for what has none (marks, digits, punctuation, modifier letters)."""
    if unicodedata.category(char) not in ("Ll", "Lu", "Lt", "Lo"):
        return ""
    first = unicodedata.name(char, "").split(" ")[0]
    return SCRIPTS.get(first, first.title())


def _target(char: str) -> str:
    """The compatibility decomposition of a character, spaces as the ordinary space, nothing for the invisible."""
    if ord(char) in INVISIBLE or unicodedata.category(char) in ("Cf", "Cc") and char not in "\t\n\r":
        return ""
    if unicodedata.category(char) in ("Zs", "Zl", "Zp") or char in "\t\n\r":
        return " "
    if unicodedata.category(char) == "Mn" or char in "´¨¯¸·΄΅ˆ˜˘˙˚˛˝":  # a spacing accent is no accent behind a space
        return unicodedata.normalize("NFD", char)
    return unicodedata.normalize("NFKD", char)


@lru_cache(maxsize=1)
def _decompositions() -> list[tuple[str, list[tuple[str, int, str]]]]:
    """Characters that aren't their own decomposition or that combine: (character, [(code point, class, script)])."""
    out = []
    for code in range(0x110000):
        char = chr(code)
        if unicodedata.category(char) in ("Cn", "Cs", "Co") or 0xAC00 <= code <= 0xD7A3:  # Hangul syllables stay composed
            continue
        target = _target(char)
        if target != char or unicodedata.combining(char):
            out.append((char, [(c, unicodedata.combining(c), _script(c)) for c in target]))
    return out


@lru_cache(maxsize=1)
def _looks() -> list[tuple[str, str, str]]:
    """(letter, script of the word, the letter that word is written with), both ways for Latin and Cyrillic."""
    out = []
    for script, listed in LATIN_LOOKS.items():
        for pair in listed.split(" "):
            out.append((pair[0], "Latin", pair[1]))
            if script in ("Cyrillic", "Greek"):
                out.append((pair[1], script, pair[0]))
    out += [(pair[0], "Arabic", pair[1]) for pair in ARABIC_LOOKS.split(" ")]
    seen: dict[tuple[str, str], str] = {}
    for letter, script, right in out:
        seen.setdefault((letter, script), right)
    return [(letter, script, right) for (letter, script), right in seen.items()]


@lru_cache(maxsize=1)
def _compositions() -> dict[str, str]:
    """base + mark -> composed letter, for all of Unicode but the Hangul syllables, which are never taken apart."""
    out = {}
    for code in range(0x110000):
        char = chr(code)
        parts = unicodedata.decomposition(char)
        if parts and "<" not in parts and len(parts.split()) == 2 and unicodedata.normalize("NFC", char) == char:
            out["".join(chr(int(x, 16)) for x in parts.split())] = char
    return out


def _tables(spark: SparkSession, arabic_only: bool) -> tuple[DataFrame, DataFrame]:
    part = T.StructType([T.StructField("c", T.StringType()), T.StructField("ccc", T.IntegerType()), T.StructField("script", T.StringType())])
    decompositions = spark.createDataFrame(_decompositions(), T.StructType([T.StructField("char", T.StringType()), T.StructField("parts", T.ArrayType(part))]))
    looks = [row for row in _looks() if arabic_only or row[1] != "Arabic"]
    return decompositions, spark.createDataFrame(looks, "c string, word_script string, look string")


def _recomposed(base, marks):
    """A base and its ordered marks composed: each mark joins the base unless a mark of its class stands in between."""
    table = F.from_json(F.lit(json.dumps(_compositions())), T.MapType(T.StringType(), T.StringType()))
    start = F.struct(base.alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(state, mark):
        joined = F.try_element_at(table, F.concat(state["base"], mark["c"]))
        free = (state["rest"] == "") | (state["last"] < mark["ccc"])
        takes = joined.isNotNull() & free
        return F.struct(
            F.when(takes, joined).otherwise(state["base"]).alias("base"),
            F.when(takes, state["rest"]).otherwise(F.concat(state["rest"], mark["c"])).alias("rest"),
            F.when(takes, state["last"]).otherwise(mark["ccc"]).alias("last"),
        )

    return F.aggregate(marks, start, step, lambda s: F.concat(s["base"], s["rest"]))


def plain_spelling(values: DataFrame, column: str, arabic_only: bool = True) -> DataFrame:
    """(``column``, ``plain``) for every distinct non-null value of a column."""
    spark = values.sparkSession
    decompositions, looks = _tables(spark, arabic_only)
    distinct = values.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    distinct = written(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-values")
    # positioned code points, decomposed
    points = distinct.select("id", F.posexplode(F.split("value", "")).alias("pos", "char")).where(F.col("char") != "")
    own = F.array(F.struct(F.col("char").alias("c"), F.lit(0).alias("ccc"), _script_of("char").alias("script")))
    parts = (
        points.join(F.broadcast(decompositions), "char", "left")
        .select("id", "pos", F.posexplode(F.coalesce("parts", own)).alias("sub", "part"))
        .select("id", "pos", "sub", "part.c", "part.ccc", "part.script")
    )
    # a running count of spaces numbers the words, one of bases the groups of a base and its marks; all that follows stays with its value
    order = W.partitionBy("id").orderBy("pos", "sub")
    count = lambda c: F.sum(c.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    numbered = parts.select("id", "pos", "sub", "c", "ccc", "script", count(F.col("c") == " ").alias("word"), count(F.col("ccc") == 0).alias("base"), F.lead("ccc", 1, 0).over(order).alias("next"))
    letter = F.struct("pos", "sub", "base", "c", "ccc", "script", "next")
    words = numbered.where(F.col("c") != " ").groupBy("id", "word").agg(F.sort_array(F.collect_list(letter)).alias("letters"))
    looked = (
        words.withColumn("word_script", _word_script(F.col("letters")))
        .select("id", "word", "word_script", F.explode("letters").alias("p"))
        .select("id", "word", "word_script", "p.pos", "p.sub", "p.base", "p.c", "p.ccc")
        .join(F.broadcast(looks), ["c", "word_script"], "left")
        .select("id", "word", "base", "pos", "sub", "ccc", F.coalesce("look", "c").alias("c"))
    )
    gathered = looked.groupBy("id", "word", "base").agg(F.sort_array(F.collect_list(F.struct("pos", "sub", "ccc", "c"))).alias("g"))
    mark = lambda p: F.struct(p["ccc"].alias("ccc"), p["pos"].alias("pos"), p["sub"].alias("sub"), p["c"].alias("c"))
    marks = F.when(F.size("g") > 1, F.array_sort(F.transform(F.slice("g", F.lit(2), F.size("g")), mark)))
    groups = gathered.select("id", "word", "base", F.get("g", F.lit(0))["c"].alias("first"), marks.alias("marks"))
    groups = written(groups.select("id", "word", "base", "first", F.transform("marks", lambda m: m["c"]).alias("marks"), F.transform("marks", lambda m: m["ccc"]).alias("classes")), "letter-groups")
    # the third join: every distinct group of a base and its marks is composed once
    several = groups.where("marks is not null").select("first", "marks", "classes").distinct()
    composed = written(several.select("first", "marks", _recomposed(F.col("first"), F.zip_with("marks", "classes", lambda m, k: F.struct(m.alias("c"), k.alias("ccc")))).alias("composed")), "composed-groups")
    whole = groups.join(sized(composed), ["first", "marks"], "left").select("id", "word", "base", F.coalesce("composed", "first").alias("text"))
    joined = lambda of: F.array_join(F.transform(F.sort_array(F.collect_list(of)), lambda x: x["text"]), "")
    spelled = whole.groupBy("id", "word").agg(joined(F.struct("base", "text")).alias("text"))
    plain = spelled.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ").alias("plain"))
    return distinct.join(plain, "id", "left").select(F.col("value").alias(column), F.coalesce("plain", F.lit("")).alias("plain"))


def _script_of(name: str):
    """The script of a letter that is its own decomposition, for the scripts that have look-alikes."""
    col = F.col(name)
    return (
        F.when(col.rlike("^[A-Za-z\\u00C0-\\u024F\\u1E00-\\u1EFF]$"), "Latin")
        .when(col.rlike("^[\\u0400-\\u052F]$"), "Cyrillic")
        .when(col.rlike("^[\\u0370-\\u03FF\\u1F00-\\u1FFF]$"), "Greek")
        .when(col.rlike("^[\\u0531-\\u0587]$"), "Armenian")
        .when(col.rlike("^[\\u0620-\\u063F\\u0641-\\u064A\\u066E-\\u06D3\\u06D5]$"), "Arabic")
        .when(col.rlike("^[\\u05D0-\\u05EA]$"), "Hebrew")
        .otherwise("")
    )


def _word_script(letters):
    """The script most unmistakable letters of a word have; of all letters where none is unmistakable; the first of equals."""
    mistakable = {}
    for letter, script, _ in _looks():
        mistakable.setdefault(_script(letter), set()).add(letter)
    names = ["Latin", "Cyrillic", "Greek", "Armenian", "Arabic", "Hebrew"]

    def count(name: str):
        own = "".join(sorted(mistakable.get(name, ())))
        sure = F.size(F.filter(letters, lambda p: (p["script"] == name) & (~F.lit(own).contains(p["c"]) | (p["next"] > 0 if name == "Latin" else F.lit(False)))))
        every = F.size(F.filter(letters, lambda p: p["script"] == name))
        return F.struct((sure * 1000 + every).alias("n"), F.lit(-names.index(name)).alias("order"), F.lit(name).alias("name"))

    mixed = F.size(F.array_distinct(F.filter(F.transform(letters, lambda p: p["script"]), lambda s: s != ""))) > 1
    arabic = F.exists(letters, lambda p: p["script"] == "Arabic")
    return F.when(mixed, F.array_max(F.array(*[count(n) for n in names]))["name"]).when(arabic, "Arabic").otherwise("")


def irregular_cells(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(``row_key``, ``field``, ``value``, ``plain``) for the cells of the columns that aren't in plain spelling, each once."""
    cells = df.select(F.col(key).alias("row_key"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("cell")).select("row_key", "cell.field", "cell.value").where("value is not null")
    dirty = sized(written(plain_spelling(cells, "value").where("plain <> value"), "irregular"))
    return cells.join(dirty, "value").select("row_key", "field", "value", "plain").dropDuplicates(["row_key", "field", "value"])
