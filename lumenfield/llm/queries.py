"""The registered queries of this subpackage: one function (spark, sf_dir) -> DataFrame each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import sized, table, written
from . import abuse, cooccur, knn, leakage, lookalikes, mojibake, packing, pieces, sentences

# ---------------------------------------------------------------------------------------------------------------- P1


def _cells(spark: SparkSession, d: str, columns: tuple[str, ...] = ("word_i", "word_j")) -> DataFrame:
    """(basket, word): the words of every sentence, once each, before anything is joined to them."""
    pairs = table(spark, d, "pairs").select("sentence_id", *columns).where("sentence_id is not null")
    cells = pairs.select(F.col("sentence_id").alias("basket"), F.explode(F.array(*columns)).alias("word")).where("word is not null")
    return written(cells.distinct(), "cells")


def _lexicon_cells(spark: SparkSession, d: str) -> DataFrame:
    """(basket, grp, item) of the cells of ``pairs`` that look like a lexicon word: sentence, language, word id."""
    cells = _cells(spark, d)
    lexicon = table(spark, d, "lexicon").select(F.col("form").alias("plain"), F.col("lang").alias("grp"), F.col("word_id").alias("item"))
    known = written(lookalikes.plain_spelling(cells, "word").join(sized(lexicon), "plain").select("word", "grp", "item"), "lexicon-words")
    return cells.join(sized(known), "word").select("basket", "grp", "item")


def _word_cells(spark: SparkSession, d: str, columns: tuple[str, ...] = ("word_i", "word_j")) -> DataFrame:
    """(basket, grp, item) of all cells of ``pairs``: sentence, one group, the word in plain spelling."""
    cells = _cells(spark, d, columns)
    plain = written(lookalikes.plain_spelling(cells, "word").select("word", F.col("plain").alias("item")).where("item <> ''"), "plain-words")
    return cells.join(sized(plain), "word").select("basket", F.lit("").alias("grp"), "item")


def _scores(spark: SparkSession, cells: DataFrame) -> DataFrame:
    return cooccur.PairTable(spark).apply(cooccur.changes(None, cooccur.baskets(cells))).scores()


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every two words that share a sentence, in plain spelling, with counts and lift over all sentences."""
    return _scores(spark, _word_cells(spark, d)).select(F.col("a").alias("word_a"), F.col("b").alias("word_b"), "n_ab", "n_a", "n_b", "n_all", F.round("lift", 6).alias("lift"))


def p1_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same over the words as they are written, without any change of spelling."""
    cells = _cells(spark, d).select("basket", F.lit("").alias("grp"), F.col("word").alias("item"))
    return _scores(spark, cells).select(F.col("a").alias("word_a"), F.col("b").alias("word_b"), "n_ab", "n_a", "n_b", "n_all", F.round("lift", 6).alias("lift"))


def p1_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The same table made in two steps: first the sentences as their first words alone show them, then the change to the whole
    sentences, merged into the counts that are there. The rows are the scores that this change affects."""
    first, whole = (cooccur.baskets(_word_cells(spark, d, c)) for c in (("word_i",), ("word_i", "word_j")))
    pairs = cooccur.PairTable(spark)
    pairs.apply(cooccur.changes(None, first), "first words").apply(cooccur.changes(first, whole), "whole sentences")
    return pairs.scores(pairs.affected).select(F.col("a").alias("word_a"), F.col("b").alias("word_b"), "n_ab", "n_a", "n_b", "n_all", F.round("lift", 6).alias("lift"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of lexicon words of one language that belong together."""
    strong = (F.col("n_ab") >= 4) & (F.col("n_ab") * 500 >= F.col("n_all")) & (F.col("n_ab") * F.col("n_all") >= 4 * F.col("n_a") * F.col("n_b"))
    return _scores(spark, _lexicon_cells(spark, d)).where(strong).select(F.col("a").alias("word_id_a"), F.col("b").alias("word_id_b"))


# ---------------------------------------------------------------------------------------------------------------- P2


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest other nodes of every node, with both names."""
    nodes = table(spark, d, "poincare_data_v3").select("node_id", "px", "py", "ar")
    named = nodes.select("node_id", "ar").dropDuplicates(["node_id"])
    near = knn.neighbours(nodes, 5)
    near = near.join(named, "node_id").join(named.select(F.col("node_id").alias("neighbour_id"), F.col("ar").alias("neighbour_ar")), "neighbour_id")
    return near.select("node_id", "ar", "neighbour_id", "neighbour_ar", "rank", F.round("distance", 6).alias("distance"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nodes of which one is among the other's five nearest."""
    near = knn.neighbours(table(spark, d, "poincare_data_v3").select("node_id", "px", "py"), 5)
    return near.select(F.least("node_id", "neighbour_id").alias("node_a"), F.greatest("node_id", "neighbour_id").alias("node_b")).distinct()


# ---------------------------------------------------------------------------------------------------------------- P3


def _whole_passages(spark: SparkSession, d: str) -> DataFrame:
    """(id, lang, text) of the passages with text that no wrong decoding damaged, each id once."""
    passages = table(spark, d, "passages").select("id", "lang", "text").where("id is not null and trim(text) <> ''").dropDuplicates(["id"])
    return mojibake.repaired(passages, "text", "lang").where("not damaged").select("id", "lang", "text")


def p3_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every undamaged passage: number, end and text."""
    whole = _whole_passages(spark, d)
    model = sentences.fitted(table(spark, d, "passages"), "id", "text")
    each = sentences.with_ends(whole, "text", model).select("id", "text", "ends", F.posexplode("ends").alias("number", "end_char"))
    start = F.when(F.col("number") > 0, F.get("ends", F.col("number") - 1)).otherwise(0)
    return each.withColumn("start", start).select("id", "number", "end_char", F.expr("trim(BOTH ' \n\t\r' FROM substring(text, start + 1, end_char - start))").alias("sentence"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Ends of the sentences of the undamaged passages."""
    model = sentences.fitted(table(spark, d, "passages"), "id", "text")
    return sentences.with_ends(_whole_passages(spark, d), "text", model).select("id", F.explode("ends").alias("end_char"))


def p3_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the sentences of every passage with text, damaged or not, by language: their ends ascend, none stands behind a
    blank, and the last is the last character that isn't blank."""
    passages = table(spark, d, "passages").select("id", "lang", "text").where("id is not null and text is not null").dropDuplicates(["id"])
    found = sentences.with_ends(passages, "text", sentences.fitted(passages, "id", "text"))
    e = F.col("ends")
    unordered = F.exists(F.zip_with(e, F.slice(e, F.lit(2), F.size(e)), lambda a, b: b <= a), lambda x: x)
    blank = F.exists(e, lambda k: F.substr("text", k, F.lit(1)).rlike("^[\\s\\p{Z}]$"))
    rest = F.regexp_replace(F.substr("text", F.element_at(e, -1) + 1, F.length("text")), "[\\s\\p{Z}]+", "")
    facts = found.where(F.size("ends") > 0).select("lang", unordered.cast("int").alias("u"), blank.cast("int").alias("b"), (rest != "").cast("int").alias("r"))
    return facts.groupBy("lang").agg(F.count("*").alias("texts"), F.coalesce(F.sum("u"), F.lit(0)).alias("out_of_order"), F.sum("b").alias("behind_blanks"), F.sum("r").alias("unfinished"))


# ---------------------------------------------------------------------------------------------------------------- P4


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Names and passages that were garbled, with the restored text."""
    names = table(spark, d, "poincare_data_v3").select(F.col("node_id").cast("string").alias("row_key"), F.col("ar").alias("text")).where("text is not null")
    passages = table(spark, d, "passages").select(F.col("id").alias("row_key"), "text", "lang").where("text is not null and row_key is not null")
    names = mojibake.repaired(names, "text").withColumn("tbl", F.lit("poincare_data_v3"))
    passages = mojibake.repaired(passages, "text", "lang").drop("lang").withColumn("tbl", F.lit("passages"))
    return names.unionByName(passages).where("damaged").select("tbl", "row_key", "text", "restored", "complete").dropDuplicates(["tbl", "row_key"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the garbled rows."""
    return p4_repaired(spark, d).select("tbl", "row_key")


# ---------------------------------------------------------------------------------------------------------------- P5


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    """(id, lang, text, limit, overlap, start_sentence, end_sentence) of the passages above the limit of their language, each once.

    A language without a row of its own takes that of ``*``; without either it has no limit and nothing of it is cut.
    """
    limits = table(spark, d, "piece_limits")
    any_ = limits.where("lang = '*'").agg(F.max("max_chars").alias("m"), F.max("overlap_chars").alias("o")).first()  # one row
    own = limits.where("lang <> '*'").groupBy("lang").agg(F.max("max_chars").alias("max_chars"), F.max("overlap_chars").alias("overlap_chars"))
    passages = table(spark, d, "passages").select("id", "lang", "text", "start_sentence", "end_sentence").where("id is not null and text is not null")
    limited = passages.join(F.broadcast(own), "lang", "left")  # a row a language
    limited = limited.withColumns({"limit": F.coalesce("max_chars", F.lit(any_.m)), "overlap": F.coalesce("overlap_chars", F.lit(any_.o), F.lit(0))})
    return limited.where(F.length("text") > F.col("limit")).select("id", "lang", "text", "limit", "overlap", "start_sentence", "end_sentence").dropDuplicates(["id"])


def _cut(spark: SparkSession, d: str) -> DataFrame:
    model = sentences.fitted(table(spark, d, "passages"), "id", "text")
    return pieces.with_pieces(_oversized(spark, d), "text", "limit", "overlap", model, "start_sentence", "end_sentence")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every passage longer than the limit of its language."""
    each = _cut(spark, d).select("id", "text", F.posexplode_outer("pieces").alias("number", "p"))  # an oversized blank text has no piece, but stays listed
    return each.select("id", "number", F.col("p.start").alias("start_char"), F.col("p.end").alias("end_char"), F.col("p.first").alias("start_sentence"), F.col("p.last").alias("end_sentence"), F.expr("substring(text, p.start + 1, p.end - p.start)").alias("piece"))


def p5_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the pieces, by language: none above the limit, none out of order, and no other character
    than blanks between them or outside."""
    one = _cut(spark, d).where("trim(text) <> ''")
    p, n = F.col("pieces"), F.size("pieces")
    over = F.size(F.filter(p, lambda x: x["end"] - x["start"] > F.col("limit")))
    behind = F.transform(p, lambda x, k: F.when(k > 0, (x["start"] <= F.get(p, k - 1)["start"]) | (x["end"] <= F.get(p, k - 1)["end"])).otherwise(F.lit(False)))
    before = lambda x, k: F.when(k > 0, F.get(p, k - 1)["end"]).otherwise(F.lit(0))
    seen = lambda c: F.regexp_replace(c, "[\\s\\p{Z}\\u001C-\\u001F\\u0085]+", "")
    gaps = F.transform(p, lambda x, k: seen(F.substr("text", before(x, k) + 1, F.greatest(x["start"] - before(x, k), F.lit(0)))))
    tail = seen(F.substr("text", F.get(p, n - 1)["end"] + 1, F.length("text")))
    lost = F.size(F.filter(gaps, lambda g: g != "")) + (tail != "").cast("int")
    facts = one.select("lang", over.alias("over"), F.size(F.filter(behind, lambda x: x)).alias("unordered"), lost.alias("lost"))
    return facts.groupBy("lang").agg(F.count("*").alias("texts"), F.sum("over").alias("over_limit"), F.sum("unordered").alias("out_of_order"), F.sum("lost").alias("lost"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the passages that had to be cut."""
    return p5_pieces(spark, d).select("id").distinct()


# ---------------------------------------------------------------------------------------------------------------- P6


def p6_spelled(spark: SparkSession, d: str) -> DataFrame:
    """Cells that aren't in plain spelling, with their plain spelling."""
    nodes = table(spark, d, "poincare_data_v3").select("node_id", "ar").where("ar is not null")
    whole = mojibake.repaired(nodes, "ar").where("not damaged").select("node_id", "ar")
    names = lookalikes.irregular_cells(whole, "node_id", ["ar"]).withColumn("tbl", F.lit("poincare_data_v3"))
    words = lookalikes.irregular_cells(table(spark, d, "pairs"), "pair_id", ["word_i", "word_j"]).withColumn("tbl", F.lit("pairs"))
    return names.unionByName(words).select("tbl", "row_key", "field", "value", "plain")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the cells that aren't in plain spelling."""
    return p6_spelled(spark, d).select("tbl", "row_key", "field")


# ---------------------------------------------------------------------------------------------------------------- P7


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every part of a document above the capacity, for every container class."""
    classes = [(r.container_class, r.capacity_tokens) for r in table(spark, d, "containers").select("container_class", "capacity_tokens").where("capacity_tokens > 0").distinct().orderBy("capacity_tokens", "container_class").limit(packing.MAX_CLASSES + 1).collect()]
    sized = packing.with_tokens(table(spark, d, "documents").select("doc_id", "text").where("doc_id is not null and text is not null"), "text")
    return packing.pack(sized, classes)


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers, by class: every document with text is in, none is filled above its capacity, and only
    documents above it are divided, into parts that follow each other without a gap."""
    packed = written(p7_packed(spark, d), "packed")
    full = packed.groupBy("container_class", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("used")).groupBy("container_class", "capacity_tokens").agg(F.sum((F.col("used") > F.col("capacity_tokens")).cast("long")).alias("overfull"))
    per = packed.groupBy("container_class", "capacity_tokens", "doc_id").agg(F.count("*").alias("parts"), F.sum("tokens").alias("tokens"), F.max(F.col("token_start") + F.col("tokens")).alias("last"))
    wrong = ((F.col("parts") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))) | (F.col("last") != F.col("tokens")) | (F.col("parts") != F.ceil(F.col("tokens") / F.col("capacity_tokens")))
    docs = per.groupBy("container_class", "capacity_tokens").agg(F.count("*").alias("documents"), F.sum(wrong.cast("long")).alias("wrongly_divided"))
    return docs.join(full, ["container_class", "capacity_tokens"])


def p7_usage(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of every class are."""
    each = p7_packed(spark, d).groupBy("container_class", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("used"), F.count("*").alias("parts"))
    return each.groupBy("container_class", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("parts").alias("parts"), F.sum("used").alias("tokens"), F.max("used").alias("most"), F.round(F.sum("used") / (F.count("*") * F.first("capacity_tokens")), 6).alias("filled"))


# ---------------------------------------------------------------------------------------------------------------- P8


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold passages of evaluation items, with the number of words they share in order."""
    items = [(r.item_id, r.text) for r in table(spark, d, "eval_items").select("item_id", "text").where("item_id is not null and text is not null").collect()]  # the evaluation set is fixed and small
    return leakage.leaks(leakage.index(table(spark, d, "documents")), items)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items that leaked into them."""
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


# ---------------------------------------------------------------------------------------------------------------- P9


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    return abuse.scored(table(spark, d, "documents").select("doc_id", "source", "text"), "text").select("doc_id", "source", "score", "kinds")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of abusive documents of every source."""
    abusive = F.sum((F.col("score") >= abuse.SCORE).cast("long"))
    return p9_scores(spark, d).groupBy("source").agg(F.count("*").alias("documents"), abusive.alias("abusive"), F.round(abusive / F.count("*"), 6).alias("rate"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are abusive."""
    return p9_scores(spark, d).where(F.col("score") >= abuse.SCORE).select("doc_id").distinct()


def queries() -> dict:
    """All registered queries of this subpackage, by name."""
    return {name: f for name, f in sorted(globals().items()) if name[0] == "p" and name[1:2].isdigit() and callable(f)}
