"""Passage retrieval: windows of sentences, BM25, TF-IDF over words and word pairs, explanations.

Passages are (id, text), queries (query, text). Only passages that share a token with a query are scored: the rest scores
zero and is dropped, as a report does. Null texts hold no token. Ties rank by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import letters as L
from ..functions import morphology as M
from ..functions import text as T
from ..functions.expr import let
from ..session import sized, written

K1, B = 1.5, 0.75


def build_passages(sentences: Column, window: int) -> Column:
    """The passages of an array of sentences: each sentence with ``window`` neighbours on either side."""

    def made(s: Column, at: Column) -> Column:
        first = F.greatest(at - window, F.lit(0))
        last = F.least(at + window, F.size(sentences) - 1)
        return let(F.array_join(F.slice(sentences, first + 1, last - first + 1), " "), lambda t: F.struct(passage_id(t, at).alias("id"), at.alias("index"), first.alias("start_sentence"), last.alias("end_sentence"), t.alias("text")))

    return F.transform(sentences, made)


def passage_id(text: Column, index: Column) -> Column:
    return F.concat(F.lit("p"), F.lpad(index.cast("string"), 6, "0"), F.lit("_"), F.substring(F.sha1(text), 1, 10))


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.round("score", 9).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(passages: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query, id, score, rank): the k best passages of every query; a token asked twice counts twice."""
    asked = queries.select("query", F.explode(T.tokenize("text")).alias("token")).groupBy("query", "token").agg(F.count("*").alias("times"))
    lengths = passages.select("id", T.tokenize("text").alias("tokens")).withColumn("length", F.size("tokens"))
    whole = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    asked = written(asked, "asked-tokens")
    vocabulary = sized(written(asked.select("token").distinct(), "vocabulary"))
    tf = lengths.select("id", "length", F.explode("tokens").alias("token")).join(vocabulary, "token", "left_semi").groupBy("id", "length", "token").agg(F.count("*").alias("tf"))
    tf = written(tf, "asked-frequencies")
    df = written(tf.groupBy("token").agg(F.count("*").alias("df")), "document-frequencies")
    weighted = tf.join(sized(df), "token").join(F.broadcast(whole), F.lit(True))  # a row per asked token; one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.greatest("mean", F.lit(1.0))))
    scored = weighted.select("id", "token", gain.alias("gain")).join(sized(asked), "token").groupBy("query", "id").agg(F.sum(F.col("gain") * F.col("times")).alias("score"))
    return _best(scored, k)


def _grams(words: Column) -> Column:
    """Words and pairs of neighbouring words."""
    return let(words, lambda w: F.concat(w, F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array())))


def tfidf(passages: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query, id, score, rank): cosine of sublinear TF-IDF over words and word pairs; passages are split at white space as they are, queries are cleaned."""
    words = F.filter(F.split("text", "\\s+"), lambda t: t != "")
    asked = queries.select("query", F.explode(_grams(T.tokenize("text"))).alias("gram")).groupBy("query", "gram").agg((1 + F.log(F.count("*"))).alias("qtf"))
    tf = passages.where("text is not null").select("id", F.explode(_grams(words)).alias("gram")).groupBy("id", "gram").agg((1 + F.log(F.count("*"))).alias("tf"))
    tf = written(tf, "term-frequencies")
    n = passages.count()
    df = written(tf.groupBy("gram").agg(F.count("*").alias("df")).withColumn("idf", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).select("gram", "idf"), "inverse-frequencies")
    known = asked.join(df, "gram").withColumn("q", F.col("qtf") * F.col("idf"))
    known = written(known.withColumn("q", F.col("q") / F.sqrt(F.sum(F.col("q") * F.col("q")).over(W.partitionBy("query")))).select("query", "gram", "q", "idf"), "asked-grams")
    hits = tf.join(sized(known), "gram").groupBy("query", "id").agg(F.sum(F.col("tf") * F.col("idf") * F.col("q")).alias("dot"))
    hits = written(hits, "hits")
    # norms are needed of the passages that were hit alone; a hot gram is one row of the weights, so the side that is joined is small
    held = tf.join(hits.select("id").distinct(), "id", "left_semi")
    norms = held.join(sized(df), "gram").groupBy("id").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"))
    return _best(hits.join(norms, "id").select("query", "id", (F.col("dot") / F.col("norm")).alias("score")), k)


def lexical_score(query: Column, passage: Column) -> Column:
    """The share of the query's distinct tokens the passage holds; 0 if either has none."""
    asked = F.array_distinct(query)
    return F.when((F.size(query) <= 0) | (F.size(passage) <= 0), 0.0).otherwise(F.size(F.array_intersect(query, passage)) / F.greatest(F.size(asked), F.lit(1)))


def shared_root_hits(query: Column, passage: Column, most: int = 12) -> Column:
    """Distinct passage tokens with a root of the query, by token."""
    roots = F.array_distinct(F.filter(F.transform(query, lambda t: M.extract_root(t)), lambda r: r != ""))
    pairs = F.transform(F.array_sort(F.array_distinct(passage)), lambda t: F.struct(t.alias("token"), M.extract_root(t).alias("root")))
    return let(roots, lambda r: F.slice(F.filter(pairs, lambda p: F.array_contains(r, p["root"])), 1, most))


def nearest_value_links(query: Column, passage: Column, most: int = 8) -> Column:
    """For every query token with a value the first passage token of nearest value; smallest differences first."""
    valued = lambda tokens: F.transform(tokens, lambda t, at: F.struct(L.letter_value(t).alias("value"), at.alias("at"), t.alias("token")))

    def linked(own: Column, others: Column) -> Column:
        def one(q: Column) -> Column:
            best = F.array_min(F.transform(others, lambda p: F.struct(F.abs(p["value"] - q["value"]).alias("delta"), p["at"].alias("at"), p["token"].alias("token"), p["value"].alias("value"))))
            return let(best, lambda b: F.struct(b["delta"].alias("delta"), q["at"].alias("at"), q["token"].alias("query_token"), q["value"].alias("query_value"), b["token"].alias("passage_token"), b["value"].alias("passage_value")))

        return F.when(F.size(others) > 0, F.slice(F.array_sort(F.transform(F.filter(own, lambda q: q["value"] != 0), one)), 1, most))

    return let(valued(query), lambda own: let(valued(passage), lambda others: linked(own, others)))


def explained(found: DataFrame, passages: DataFrame, queries: DataFrame) -> DataFrame:
    """Add to (query, id, score, rank) the overlap, the root hits, the value links and the passage."""
    texts = found.join(passages.select("id", "text"), "id").join(F.broadcast(queries.select("query", F.col("text").alias("asked"))), "query")
    tokens = texts.withColumn("q", T.tokenize("asked")).withColumn("p", T.tokenize("text"))
    return tokens.select("query", "id", "rank", F.round("score", 6).alias("score"), F.array_sort(F.array_intersect("q", "p")).alias("token_overlap"), shared_root_hits(F.col("q"), F.col("p")).alias("shared_root_hits"), nearest_value_links(F.col("q"), F.col("p")).alias("links"), "text")


def reported(results: DataFrame) -> DataFrame:
    """(query, report): a Markdown report of the results of every query; a top-k list, so a report is small."""
    hits = F.array_join(F.transform("shared_root_hits", lambda h: F.concat_ws(":", h["token"], h["root"])), ", ")
    links = F.array_join(F.transform("links", lambda x: F.concat(F.lit("- "), x["query_token"], F.lit("("), x["query_value"].cast("string"), F.lit(") -> "), x["passage_token"], F.lit("("), x["passage_value"].cast("string"), F.lit("), delta="), x["delta"].cast("string"))), "\n")
    none = lambda c: F.when(c == "", "none").otherwise(c)
    part = F.concat_ws("\n", F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". "), "id"), F.lit(""), F.concat(F.lit("Token overlap: "), none(F.array_join("token_overlap", ", "))), F.lit(""), F.concat(F.lit("Shared root hits: "), none(hits)), F.lit(""), F.lit("Nearest value links:"), links, F.lit(""), "text", F.lit(""))
    per = results.select("query", "rank", part.alias("part")).groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda p: p["part"]), "\n").alias("body"))
    return per.select("query", F.concat(F.lit("# "), F.col("query").cast("string"), F.lit("\n\n"), "body").alias("report"))


def report(results: DataFrame, query: str) -> str:
    """The report of the results of one query under a title."""
    found = reported(results).first()
    return f"# {query}\n" + (found.report.split("\n", 1)[1] if found else "")
