"""Statistics on pairs and vectors: lift, ranks, partial rank correlation, nulls, tests, pairwise summaries."""

from __future__ import annotations

import hashlib
import math
import random
import tempfile
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.letters import ABJAD_BASE
from ..session import ship, sized, written

WINDOW, STEP, LEAST = 40, 20, 2
#: Upper ends of the distance bins and their names.
BINS = [(10, "<=10"), (25, "11-25"), (50, "26-50"), (100, "51-100"), (200, "101-200")]
LAST_BIN = ">200"
FEWEST = 50
#: A vocabulary of at most this many words is numbered, and the pairs of its words are counted within tasks.
LISTED = 20_000
#: Counts of pairs that a task holds, and windows whose pairs it numbers at once.
COUNTED, WINDOWS = 1 << 22, 8192
#: Rows of an Arrow batch that a task returns.
BATCH = 10_000
#: Folded pairs that a task of permutations holds, at some 50 bytes each; more are ranked by shuffles.
FOLDED = 10_000_000
#: Controls that at least so many folded pairs share are folded again for every permutation.
SHARED = 4096


def lift(texts: DataFrame, tokens: Column, vocabulary: DataFrame, window: int = WINDOW, step: int = STEP, least: int = LEAST) -> DataFrame:
    """(w1, w2, n, lift) with w1 < w2: words of a vocabulary (word) that share windows of a text, at least ``least`` windows.

    Windows begin every ``step`` tokens and are complete; what a text has beyond its last is dropped. Windows, their words and
    the pairs of a window are made within one row; a window holds ``window`` words at most, so its pairs are bounded.
    """
    known = written(vocabulary.select("word").where("word is not null").distinct(), "vocabulary")
    if known.count() <= LISTED:
        return _listed_lift(texts, tokens, sorted(r.word for r in known.collect()), window, step, least)
    whole = texts.select(tokens.alias("t")).where(F.size("t") > window)
    at = whole.select("t", F.explode(F.sequence(F.lit(0), F.floor((F.size("t") - window - 1) / step).cast("int"))).alias("k"))
    held = written(at.select(F.monotonically_increasing_id().alias("w"), F.array_distinct(F.slice("t", F.col("k") * step + 1, window)).alias("words")), "windows")
    n = held.count()
    sets = held.select("w", F.explode("words").alias("word")).join(sized(known), "word", "left_semi").groupBy("w").agg(F.sort_array(F.collect_list("word")).alias("words"))
    single = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    first = sets.select("words", F.posexplode("words").alias("i", "w1"))
    pairs = first.select("w1", F.explode(F.slice("words", F.col("i") + 2, F.size("words"))).alias("w2")).groupBy("w1", "w2").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    both = pairs.join(single.select(F.col("word").alias("w1"), F.col("n").alias("n1")), "w1").join(single.select(F.col("word").alias("w2"), F.col("n").alias("n2")), "w2")
    return both.select("w1", "w2", "n", _lifted(n))


def _lifted(n: int) -> Column:
    return ((F.col("n") / n) / ((F.col("n1") / n) * (F.col("n2") / n) + 1e-10)).alias("lift")


def _listed_lift(texts: DataFrame, tokens: Column, words: list[str], window: int, step: int, least: int) -> DataFrame:
    """The same for a sorted list of words: a task counts the pairs of its windows by number, so no window and no pair of one is emitted.

    Counts are one number a pair while all pairs of words are at most ``COUNTED``, else sorted numbers, emitted before they are more.
    """
    spark = texts.sparkSession
    ship(spark)
    size = len(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, windows = pa.array(words, pa.string()), 0
        every = np.zeros(size * size, dtype=np.int64) if size * size <= COUNTED else None
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for b in batches:
            t = b.column(0)
            lengths = t.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = pc.index_in(t.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            number = np.where(lengths > window, (lengths - window - 1) // step + 1, 0)
            before = np.cumsum(number) - number
            starts = np.repeat(np.cumsum(lengths) - lengths - before * step, number) + np.arange(number.sum()) * step
            windows += len(starts)
            for at in range(0, len(starts) if size else 0, WINDOWS):
                held = np.sort(codes[starts[at : at + WINDOWS, None] + np.arange(window)], axis=1).astype(np.int64)
                held[:, 1:][held[:, 1:] == held[:, :-1]] = -1
                held.sort(axis=1)  # each word once, at the end of its row
                held = held[:, max(0, window - int((held >= 0).sum(axis=1).max())) :]
                wide = held.shape[1]
                new = np.concatenate([(held[:, : wide - k] * size + held[:, k:])[held[:, : wide - k] >= 0] for k in range(wide)] or [keys[:0]])  # a word with itself: its windows
                if every is not None:
                    every += np.bincount(new, minlength=len(every))
                    continue
                new, n = np.unique(new, return_counts=True)
                keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, n]), len(keys)).astype(np.int64)
                if len(keys) > COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])
                    keys, counts = keys[:0], counts[:0]
        if every is not None:
            keys = np.flatnonzero(every)
            counts = every[keys]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, -1)), pa.array(np.append(counts, windows))], ["key", "n"])

    counted = written(texts.select(tokens.alias("t")).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "window-counts")
    n = counted.where("key = -1").agg(F.sum("n")).first()[0] or 0
    placed = counted.where("key >= 0").select(F.expr(f"key div {max(1, size)}").alias("a"), F.expr(f"key % {max(1, size)}").alias("b"), "n")
    named = spark.createDataFrame(pa.table({"k": pa.array(range(size), pa.int64()), "word": pa.array(words, pa.string())})).join(placed.where("a = b").select(F.col("a").alias("k"), F.col("n").alias("m")), "k")
    one = F.broadcast(written(named, "window-words"))  # LISTED rows at most
    both = placed.where((F.col("a") < F.col("b")) & (F.col("n") >= least))
    for side, name, total in (("a", "w1", "n1"), ("b", "w2", "n2")):
        both = both.join(one.select(F.col("k").alias(side), F.col("word").alias(name), F.col("m").alias(total)), side)
    return both.select("w1", "w2", "n", _lifted(n))


def with_lift(pairs: DataFrame, lifts: DataFrame, small: bool = False) -> DataFrame:
    """Add ``cooc``: the lift of a pair's words in either order, 0 where there is none."""
    keyed = pairs.withColumn("w1", F.least("word_i", "word_j")).withColumn("w2", F.greatest("word_i", "word_j"))
    held = lifts.select("w1", "w2", "lift")
    if small:  # what a partition of lifts holds fits a hash table, so neither side is sorted
        held = held.hint("shuffle_hash")
    return keyed.join(held, ["w1", "w2"], "left").withColumn("cooc", F.coalesce("lift", F.lit(0.0))).drop("w1", "w2", "lift")


def once(df: DataFrame, key: str) -> DataFrame:
    """One row of each key, as ``dropDuplicates``, which would sort rows that hold strings."""
    ship(df.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            codes = pc.dictionary_encode(rows[key], null_encoding="encode").combine_chunks().indices.to_numpy()
            yield from rows.take(pa.array(np.unique(codes, return_index=True)[1])).to_batches(max_chunksize=BATCH)

    return df.repartition(key).mapInArrow(first, df.schema)


def sentence_pairs(words: Column, value) -> Column:
    """All pairs i < j of an array of words with positions, values and differences; the array is a sentence, so bounded."""
    placed = F.transform(words, lambda w, at: F.struct(w.alias("word"), at.alias("pos"), value(w).alias("value")))

    def with_later(a: Column) -> Column:
        later = F.filter(placed, lambda b: b["pos"] > a["pos"])
        return F.transform(later, lambda b: F.struct(a["word"].alias("word_i"), b["word"].alias("word_j"), a["pos"].alias("pos_i"), b["pos"].alias("pos_j"), (b["pos"] - a["pos"]).alias("pos_distance"), a["value"].alias("value_i"), b["value"].alias("value_j"), F.abs(a["value"] - b["value"]).alias("value_distance")))

    return F.flatten(F.transform(placed, with_later))


def distance_bin(distance: Column) -> Column:
    out = None
    for end, name in BINS:
        out = F.when(distance <= end, name) if out is None else out.when(distance <= end, name)
    return out.otherwise(LAST_BIN)


def binned(pairs: DataFrame, distance: str, outcome: str) -> DataFrame:
    """(bin, n, mean, median, std) of the outcome; empty bins have n = 0."""
    known = pairs.where(F.col(distance).isNotNull() & F.col(outcome).isNotNull())
    stats = known.groupBy(distance_bin(F.col(distance)).alias("bin")).agg(F.count("*").alias("n"), F.avg(outcome).alias("mean"), F.median(outcome).alias("median"), F.stddev_pop(outcome).alias("std"))
    every = pairs.sparkSession.createDataFrame([(name,) for _, name in BINS] + [(LAST_BIN,)], "bin string")
    return every.join(F.broadcast(stats), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def average_ranks(df: DataFrame, column: str, name: str, groups: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Ranks with ties averaged (from 1), per group or over all rows, without one window over all rows.

    Distinct values are counted and sorted into ranges; the rank of a value is the count of the ranges before, of the values
    before it in its own range, and half of its own count.
    """
    groups = groups or []
    counted = df.groupBy(*groups, column).agg((F.sum(weight) if weight else F.count("*")).alias("__c"))
    ranged = counted.repartitionByRange(*groups, column).withColumn("__part", F.spark_partition_id())
    own = W.partitionBy("__part", *groups).orderBy(column).rowsBetween(W.unboundedPreceding, -1)
    ranged = written(ranged.withColumn("__in", F.coalesce(F.sum("__c").over(own), F.lit(0))), "ranges")
    parts = ranged.groupBy(*groups, "__part").agg(F.sum("__c").alias("__n"))
    order = W.partitionBy(*groups).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = parts.withColumn("__before", F.coalesce(F.sum("__n").over(order), F.lit(0))).drop("__n")  # a row per range
    table = ranged.join(F.broadcast(before), [*groups, "__part"]).select(*groups, column, (F.col("__before") + F.col("__in") + (F.col("__c") + 1) / 2).alias(name))
    return df.join(table, [*groups, column])


def placed_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """The rows of ``df`` (numbers without nulls in ``column``) with ``name``, their rank with ties averaged (from 1), in place of the column.

    Rows are sent into ranges once, whole; a range is ranked as arrays and its rows are written with their rank in it. So it is
    for columns of many distinct values; ``average_ranks`` folds equal ones first and joins.
    """
    ship(df.sparkSession)
    kept = [c for c in df.columns if c != column]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        values = rows[column].to_numpy()
        order = np.argsort(values)
        in_order = values[order]
        starts = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
        many = np.diff(np.append(starts, len(values)))
        out = np.empty(len(values))
        out[order] = np.repeat(starts + (many + 1) / 2, many)
        part = np.full(len(values), TaskContext.get().partitionId(), dtype=np.int32)
        yield from rows.select(kept).append_column("__in", pa.array(out)).append_column("__part", pa.array(part)).to_batches(max_chunksize=BATCH)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    ranged = df.withColumn(column, F.col(column) + 0.0).repartitionByRange(column)  # no -0.0
    placed = written(ranged.mapInArrow(rank, ", ".join([f"`{c}` {kinds[c]}" for c in kept] + ["__in double, __part int"])), "ranges")
    parts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = parts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")  # a row per range
    return placed.join(F.broadcast(before), "__part").select(*kept, (F.col("__before") + F.col("__in")).alias(name))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(rho, n): the rank correlation of two columns, rows with a null left out."""
    known = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("__w"))
    known = written(known, "rank-pairs")  # equal pairs fold before anything is sorted
    ranked = average_ranks(average_ranks(known, a, "ra", weight="__w"), b, "rb", weight="__w")
    w, x, y = F.col("__w"), F.col("ra"), F.col("rb")
    m = ranked.agg(F.sum(w).alias("n"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"))
    spread = lambda s, t: F.col(s) / F.col("n") - (F.col(t) / F.col("n")) ** 2
    below = F.sqrt(spread("xx", "x") * spread("yy", "y"))
    return m.select(F.when(below > 0, (F.col("xy") / F.col("n") - F.col("x") * F.col("y") / F.col("n") / F.col("n")) / below).alias("rho"), F.coalesce("n", F.lit(0)).alias("n"))


def rank_correlation(df: DataFrame, a: str, b: str) -> float | None:
    """The same of two columns of many distinct numbers without nulls: each is sent into ranges once and nothing is joined.

    A range of ``a`` returns its sums with the ranks within it; how many rows are before it is added on the driver.
    """
    ranked = placed_ranks(df.select(a, b), b, "rank")
    each = ranked.groupBy((F.col(a) + 0.0).alias(a)).agg(F.count("*").alias("c"), F.sum("rank").alias("s"), F.sum(F.col("rank") * F.col("rank")).alias("q"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if held:
            rows = pa.Table.from_batches(held)
            value, c, s, q = (rows[k].to_numpy() for k in (a, "c", "s", "q"))
            order = np.argsort(value)
            own = np.empty(len(c))
            own[order] = np.cumsum(c[order]) - (c[order] - 1) / 2
            found = (TaskContext.get().partitionId(), int(c.sum()), s.sum(), q.sum(), (own * s).sum(), (own * c).sum(), (own * own * c).sum())
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in found], RANGE_SUMS)

    rows = sorted(each.repartitionByRange(a).mapInArrow(sums, ", ".join(f"{k} {'long' if k in ('part', 'n') else 'double'}" for k in RANGE_SUMS)).collect())  # a row a range
    n, before, xx, xy, yy = sum(r.n for r in rows), 0, 0.0, 0.0, 0.0
    mean = (n + 1) / 2
    for r in rows:  # about the mean, so no large sums are subtracted
        off = before - mean
        xx += r.xx + 2 * off * r.x + off * off * r.n
        xy += r.xs + off * r.s - mean * (r.x + off * r.n)
        yy += r.q - 2 * mean * r.s + mean * mean * r.n
        before += r.n
    return xy / math.sqrt(xx * yy) if xx > 0 and yy > 0 else None


RANGE_SUMS = ["part", "n", "s", "q", "xs", "x", "xx"]


def ols(df: DataFrame, controls: list[str], targets: list[str]) -> dict[str, np.ndarray]:
    """Coefficients (intercept first) of each target on the controls: one aggregate of products, solved on the driver."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in controls]]
    k = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(x[i] * F.col(t).cast("double")).alias(f"t{n}_{i}") for n, t in enumerate(targets) for i in range(k)]
    row = df.agg(*sums).first()
    gram = np.array([[float(row[f"g{min(i, j)}_{max(i, j)}"] or 0) for j in range(k)] for i in range(k)])
    return {t: np.linalg.lstsq(gram, np.array([float(row[f"t{n}_{i}"] or 0) for i in range(k)]), rcond=None)[0] for n, t in enumerate(targets)}


def residual(target: str, controls: list[str], beta: np.ndarray) -> Column:
    """A target minus its fit, rounded to 12 digits so that equal inputs tie."""
    fit = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], controls):
        fit = fit + F.lit(float(b)) * F.col(c)
    return F.round(F.col(target) - fit, 12)


def partial_spearman(df: DataFrame, target: str, outcome: str, controls: list[str]) -> DataFrame:
    """(rho, n, p, error): the rank correlation of the residuals of target and outcome on the controls; below 50 rows none."""
    spark = df.sparkSession
    known = written(df.select(target, outcome, *controls).dropna(), "residuals")  # read by the fit and by either ranking
    n = known.count()
    if n < FEWEST:
        return spark.createDataFrame([(None, n, None, "insufficient data")], "rho double, n long, p double, error string")
    beta = ols(known, controls, [target, outcome])
    rho = rank_correlation(known.select(residual(target, controls, beta[target]).alias("a"), residual(outcome, controls, beta[outcome]).alias("b")), "a", "b")
    return spark.createDataFrame([(rho, n, spearman_p(rho, n), None)], "rho double, n long, p double, error string")


def spearman_p(rho: float | None, n: int) -> float | None:
    """The two-sided p of a rank correlation, by Student's t."""
    if rho is None or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return _beta_tail((n - 2) / (n - 2 + t2), (n - 2) / 2, 0.5)


def _beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for m in range(400):
        k = m // 2
        if m == 0:
            numerator = 1.0
        elif m % 2 == 0:
            numerator = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        else:
            numerator = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / max(1 + numerator * d, 1e-300) if 1 + numerator * d > 0 else 1 / min(1 + numerator * d, -1e-300)
        c = 1 + numerator / c if c else 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def verdict(rho: Column, p: Column) -> Column:
    return F.when(rho.isNull(), "insufficient").when((p < 0.05) & (rho < 0), "positive").when((p < 0.05) & (rho > 0), "falsifying").otherwise("null")


# -------------------------------------------------------------------------------------------------------------- nulls


def permuted_mappings(count: int, seed: int = 42, bins: list[list[str]] | None = None) -> list[dict[str, int]]:
    """Shuffled letter values, within bins of letters if given; draws are the driver's, so they can be repeated."""
    rng = random.Random(seed)
    letters = list(ABJAD_BASE)
    out = []
    for _ in range(count):
        mapping: dict[str, int] = {}
        for own in bins or [letters]:
            values = [ABJAD_BASE[c] for c in own]
            rng.shuffle(values)
            mapping |= dict(zip(own, values))
        out.append(mapping)
    return out


def frequency_bins(words: DataFrame, column: str, bins: int) -> DataFrame:
    """(letter, n, bin): base letters by the number of distinct words they occur in, in equal bins; unseen letters last."""
    from ..functions.letters import letters, to_base_letters

    spark = words.sparkSession
    seen = words.select(column).where(F.col(column).isNotNull()).distinct().select(F.explode(letters(to_base_letters(F.col(column)))).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    alphabet = spark.createDataFrame(list(enumerate(ABJAD_BASE)), "place int, letter string")
    counted = alphabet.join(F.broadcast(seen), "letter", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.withColumn("bin", F.ntile(bins).over(W.orderBy(F.col("n").desc(), "place"))).select("letter", "n", "bin")  # 28 rows


def mapped_distances(pairs: DataFrame, mappings: list[dict[str, int]], keep: list[str]) -> DataFrame:
    """(perm, keep..., value_distance): the distances of the pairs' words under every mapping.

    A word's value under all mappings is its vector of letter counts times the matrix of values, made per Arrow batch, so
    no table of words is joined or shipped. Run in blocks of mappings to bound what one pass emits.
    """
    from ..functions.letters import ABJAD_VARIANTS

    ship(pairs.sparkSession)
    letters = {c: k for k, c in enumerate(ABJAD_BASE)} | {v: list(ABJAD_BASE).index(b) for v, b in {**ABJAD_VARIANTS, "ٱ": "ا"}.items()}
    matrix = np.array([[m[c] for m in mappings] for c in ABJAD_BASE])

    def values(words: pd.Series) -> np.ndarray:
        codes, distinct = pd.factorize(words)
        counts = np.zeros((len(distinct), len(ABJAD_BASE)), dtype=np.int64)
        for row, word in enumerate(distinct):
            for c in word:
                k = letters.get(c)
                if k is not None:
                    counts[row, k] += 1
        return (counts @ matrix)[codes]

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = np.abs(values(b.word_i) - values(b.word_j))
            for k in range(len(mappings)):
                yield b[keep].assign(perm=k, value_distance=d[:, k])

    kinds = dict(pairs.dtypes)
    known = pairs.select("word_i", "word_j", *keep).dropna()
    return known.mapInPandas(spread, ", ".join([f"{c} {kinds[c]}" for c in keep] + ["perm int", "value_distance long"]))


def permutation_null(pairs: DataFrame, mappings: list[dict[str, int]], outcome: str = "mean_attention", block: int = 50) -> DataFrame:
    """(perm, rho): the rank correlation of permuted distances with an outcome (rows with nulls left out).

    Outcome ranks are made once. Distances are whole numbers, so per permutation counts and rank sums per distance say all:
    the join to pairs is aggregated at once and nothing of the size pairs x permutations is kept.
    """
    ranked = written(average_ranks(pairs.select("word_i", "word_j", outcome).dropna(), outcome, "rank").select("word_i", "word_j", "rank"), "outcome-ranks")
    moments = ranked.agg(F.count("*").alias("n"), F.avg("rank").alias("mean"), F.stddev_pop("rank").alias("std"))
    out = None
    for at in range(0, len(mappings), block):
        per = mapped_distances(ranked, mappings[at : at + block], ["rank"]).groupBy("perm", "value_distance").agg(F.count("*").alias("c"), F.sum("rank").alias("s"))
        own = W.partitionBy("perm").orderBy("value_distance").rowsBetween(W.unboundedPreceding, -1)
        placed = per.withColumn("r", F.coalesce(F.sum("c").over(own), F.lit(0)) + (F.col("c") + 1) / 2)
        joined = placed.join(F.broadcast(moments), F.lit(True))
        rho = joined.groupBy("perm").agg(((F.sum(F.col("r") * F.col("s")) / F.first("n") - F.first("mean") * F.first("mean")) / (F.first("std") * F.sqrt(F.sum(F.col("c") * F.col("r") * F.col("r")) / F.first("n") - F.first("mean") * F.first("mean")))).alias("rho"))
        part = rho.select((F.col("perm") + at).alias("perm"), "rho")
        out = part if out is None else out.unionByName(part)
    return out


def letter_differences(words_i: pd.Series, words_j: pd.Series) -> np.ndarray:
    """Counts of the base letters of one word less those of the other, a row a pair, the first that differs counted up."""
    from ..functions.letters import ABJAD_VARIANTS

    size = len(ABJAD_BASE)
    place = {c: k for k, c in enumerate(ABJAD_BASE)} | {v: list(ABJAD_BASE).index(b) for v, b in {**ABJAD_VARIANTS, "ٱ": "ا"}.items()}
    codes, distinct = pd.factorize(pd.concat([words_i, words_j], ignore_index=True))
    last = max(map(ord, place)) + 1
    places = np.full(last + 1, -1)
    places[[ord(c) for c in place]] = list(place.values())
    letter = places[np.minimum(np.frombuffer("".join(distinct).encode("utf-32-le"), dtype=np.uint32), last)]
    cell = np.repeat(np.arange(len(distinct)) * size, [len(w) for w in distinct]) + letter
    counts = np.bincount(cell[letter >= 0], minlength=len(distinct) * size).astype(np.int16).reshape(-1, size)
    out = counts[codes[: len(words_i)]] - counts[codes[len(words_i) :]]
    first = out[np.arange(len(out)), (out != 0).argmax(axis=1)] if len(out) else out[:, 0]
    return np.where(first[:, None] < 0, -out, out)


class FoldedPairs:
    """Pairs of equal letter difference and controls as one row (letters, controls.., c, s, q): their number, the sum of the ranks
    of the outcome's residuals and the sum of the squares of these. Written once, for any number of permutations.

    Rows with nulls are left out. ``rows`` is None below 50 pairs.
    """

    def __init__(self, pairs: DataFrame, controls: list[str], outcome: str = "mean_attention") -> None:
        self.controls, self.rows, self.packed = controls, None, None
        ship(pairs.sparkSession)
        known = pairs.select("word_i", "word_j", outcome, *[F.col(c).cast("double").alias(c) for c in controls]).dropna()
        if known.count() < FEWEST:
            return
        beta = ols(known, controls, [outcome])[outcome]
        ranked = placed_ranks(known.select("word_i", "word_j", *controls, residual(outcome, controls, beta).alias("__o")), "__o", "rank")
        equal = ranked.groupBy("word_i", "word_j", *controls).agg(F.count("*").alias("c"), F.sum("rank").alias("s"), F.sum(F.col("rank") * F.col("rank")).alias("q"))

        def lettered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b[[*controls, "c", "s", "q"]].assign(letters=[x.tobytes() for x in letter_differences(b.word_i, b.word_j)])

        folded = equal.mapInPandas(lettered, ", ".join(f"{c} double" for c in controls) + ", c long, s double, q double, letters binary")
        self.rows = written(folded.groupBy("letters", *controls).agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("q").alias("q")), "folded-pairs")
        n = self.rows.agg(F.count("*").alias("n"), F.sum("q").alias("q")).first()
        self.count, self.squares = int(n.n), float(n.q)

    def blocks(self) -> tuple[DataFrame, np.ndarray]:
        """(letters, at, code, x, cs): the rows as arrays, some thousands to a row; and the values of those controls that many rows share.

        ``letters`` has every difference of a block once and ``at`` its place; ``code`` is the place of shared controls, -1 where
        ``x`` has a row's own.
        """
        if self.packed:
            return self.packed
        controls = self.controls
        shared = self.rows.groupBy(*controls).agg(F.count("*").alias("n")).where(F.col("n") >= SHARED).drop("n").collect()  # a row for SHARED rows at least
        values = np.array(shared, dtype=float).reshape(-1, len(controls))
        known = F.broadcast(self.rows.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(shared)], ", ".join(f"{c} double" for c in controls) + ", code int"))
        coded = self.rows.join(known, controls, "left").select("letters", *controls, F.coalesce("code", F.lit(-1)).alias("code"), "c", "s")

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                letters = np.frombuffer(b"".join(b.letters), dtype=np.int16).reshape(-1, len(ABJAD_BASE))
                new = np.concatenate([[True], (letters[1:] != letters[:-1]).any(axis=1)])
                code = b.code.to_numpy(dtype=np.int32)
                x = b.loc[code < 0, controls].to_numpy(dtype=float)
                arrays = (letters[new], (np.cumsum(new) - 1).astype(np.int32), code, x, b[["c", "s"]].to_numpy(dtype=float))
                yield pd.DataFrame([[np.ascontiguousarray(a).tobytes() for a in arrays]], columns=PACKED)

        near = coded.repartition("letters").sortWithinPartitions("letters")  # so a block has few differences
        self.packed = written(near.mapInPandas(pack, ", ".join(f"{c} binary" for c in PACKED)), "packed-pairs"), values
        return self.packed


PACKED = ["letters", "at", "code", "x", "cs"]


class Mapped:
    """An array that grows in a file without a name and is read from there: what many tasks only read needn't be memory of each."""

    def __init__(self, kind: type) -> None:
        self.file, self.kind = tempfile.TemporaryFile(), np.dtype(kind)

    def add(self, part: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(part, dtype=self.kind).tobytes())

    def array(self) -> np.ndarray:
        self.file.flush()
        size = self.file.tell() // self.kind.itemsize
        return np.asarray(np.memmap(self.file, dtype=self.kind, mode="r", shape=(size,))) if size else np.zeros(0, dtype=self.kind)


class HeldPairs:
    """All blocks of folded pairs in one task: permutations are correlated one after the other, with nothing left out.

    Rows of shared controls fold once more, by distance, without a sort; the others are sorted. What is only read lies in files;
    large arrays to work in are made once and used again, as new memory for every step costs more than the steps.
    """

    def __init__(self, batches: Iterator[pd.DataFrame], shared: np.ndarray, squares: float) -> None:
        letters, offset = [], 0
        many_at, code, many_c, many_s, own_at, own_cs, *own_x = (Mapped(t) for t in (np.int32, np.int32, float, float, np.int32, float, *[float] * shared.shape[1]))
        for b in batches:
            for r in b.itertuples():
                first = np.frombuffer(r.letters, dtype=np.int16).reshape(-1, len(ABJAD_BASE))
                at, where, cs = np.frombuffer(r.at, dtype=np.int32) + np.int32(offset), np.frombuffer(r.code, dtype=np.int32), np.frombuffer(r.cs).reshape(-1, 2)
                one = where < 0
                letters.append(first.astype(np.int8 if np.abs(first).max(initial=0) < 128 else np.int16))
                for to, part in zip((many_at, code, many_c, many_s, own_at, own_cs, *own_x), (at[~one], where[~one], cs[~one, 0], cs[~one, 1], at[one], cs[one], *np.frombuffer(r.x).reshape(-1, shared.shape[1]).T)):
                    to.add(part)
                offset += len(first)
        self.letters, self.shared, self.squares, size = letters, shared, squares, offset
        self.many_at, self.code, self.many_c, self.many_s, self.own_at, self.own_cs, *self.own_x = (x.array() for x in (many_at, code, many_c, many_s, own_at, own_cs, *own_x))
        self.own_cs = self.own_cs.reshape(-1, 2)
        # sums by letter difference of counts times controls: a product with the distances gives the right sides of all fits
        own_c, of_code = self.own_cs[:, 0], np.bincount(self.code, self.many_c, len(shared))
        wide = np.hstack([np.ones((len(shared), 1)), shared])
        full = [np.ones(len(own_c)), *self.own_x]
        self.gram = (wide * of_code[:, None]).T @ wide + np.array([[(a * b * own_c).sum() for a in full] for b in full])
        self.weights = np.column_stack([np.bincount(self.many_at, self.many_c * wide[self.code, k], size) + np.bincount(self.own_at, own_c * x, size) for k, x in enumerate(full)])
        self.room = len(own_c) + len(self.many_at)

    def distances(self, values: np.ndarray) -> np.ndarray:
        """A row a permutation: the distance of every letter difference, whole numbers."""
        return np.ascontiguousarray(np.concatenate([np.abs(x.astype(np.float32) @ values) for x in self.letters]).T)

    def rho(self, d: np.ndarray) -> float | None:
        fit = np.linalg.lstsq(self.gram, d.astype(float) @ self.weights, rcond=None)[0]
        k, many, code, c, s = len(self.shared), None, self.code, self.many_c, self.many_s
        if len(code):
            whole = d.astype(np.int64)
            span = (int(whole.max()) + 1) * k
            if span <= 4 * len(code):
                cell = (whole * k)[self.many_at]
                cell += code
                c, s = np.bincount(cell, c, span), np.bincount(cell, s, span)
                at = np.flatnonzero(c)
                many, code, c, s = (at // k).astype(float), at % k, c[at], s[at]
        if many is None:
            many = d[self.many_at].astype(float)
        n, first = len(self.own_at) + len(many), len(self.own_at)
        if not hasattr(self, "cs") or len(self.cs) < n:  # the room of a first permutation, and some more for others
            room = min(self.room, n + (n - first) // 2)
            self.both, self.key, self.places = np.empty(2 * room), np.empty(room, dtype=np.int64), np.arange(room, dtype=np.int32)
            cs = np.empty((room, 2))
            cs[:first], self.cs = self.cs[:first] if hasattr(self, "cs") else self.own_cs, cs
            self.own_cs = None  # it is the first part of cs from here on
        r, work, key = self.both[:n], self.both[n : 2 * n], self.key[:n]
        self.cs[first:n, 0], self.cs[first:n, 1] = c, s
        r[:first], r[first:] = d[self.own_at], many
        r -= fit[0]
        for slope, x, values in zip(fit[1:], self.own_x, self.shared.T):
            np.multiply(x, slope, out=work[:first])
            np.multiply(values[code], slope, out=work[first:])
            r -= work
        np.round(r, 12, out=r)
        return _ranked_rho(r, self.cs[:n], self.squares, work, key, self.places[:n], self.both[: 2 * n].view(complex))


def _ranked_rho(r: np.ndarray, cs: np.ndarray, squares: float, work: np.ndarray, key: np.ndarray, places: np.ndarray, found: np.ndarray) -> float | None:
    """The rank correlation of values ``r``, each for a number of rows whose ranks of the other side have a sum (``cs``).

    ``squares`` is the sum of the squares of those ranks; the last four are room to work in, ``places`` is 0 to n - 1, ``found`` may
    be the room of ``r`` and ``work``. Integers of value and place are sorted, which is faster than argsort; what they can't tell
    apart is sorted again by its values.
    """
    n, low, high = len(r), r.min(), r.max()
    bits = max(1, (n - 1).bit_length())
    np.subtract(r, low, out=work)
    work *= 2.0 ** (62 - bits) / (high - low) if high > low else 0.0
    np.copyto(key, work, casting="unsafe")
    key <<= bits
    key |= places
    key.sort()
    value = np.right_shift(key, bits, out=work.view(np.int64))
    key &= (1 << bits) - 1
    near, ties = value[1:] == value[:-1], None
    if near.any():
        at = np.flatnonzero(np.concatenate([near, [False]]) | np.concatenate([[False], near]))
        own = key[at]
        key[at] = own = own[np.lexsort((r[own], value[at]))]
        ties = at[1:][(at[1:] == at[:-1] + 1) & (r[own[1:]] == r[own[:-1]])]  # the places that equal the one before
    np.take(cs.view(complex).ravel(), key, out=found, mode="clip")
    c, s = found.real, found.imag
    if ties is not None and len(ties):
        starts = np.delete(np.arange(n), ties)
        c, s = np.add.reduceat(c, starts), np.add.reduceat(s, starts)
    rank = np.cumsum(c, out=key.view(float)[: len(c)])
    total = rank[-1]
    rank -= (c - 1) / 2
    mean = (total + 1) / 2
    below = (squares / total - mean * mean) * (np.dot(c * rank, rank) / total - mean * mean)
    return float((np.dot(rank, s) / total - mean * mean) / math.sqrt(below)) if below > 1e-12 else None


def partial_null(pairs: DataFrame, mappings: list[dict[str, int]], controls: list[str], outcome: str = "mean_attention", most: int = FOLDED, block: int = 50, folded: FoldedPairs | None = None) -> DataFrame:
    """(perm, rho): the partial rank correlation of permuted distances with an outcome given controls (rows with nulls left out).

    The outcome's residual ranks are made once. A distance depends on the difference of two words' letters alone, so pairs of
    equal difference and controls fold to one row; ``folded`` is given where that is done already. Permutations are the tasks,
    each reads up to ``most`` such rows as arrays; more are ranked by shuffles, a block of permutations at a time. Below 50
    pairs every rho is null.
    """
    spark = pairs.sparkSession
    ship(spark)
    folded = folded or FoldedPairs(pairs, controls, outcome)
    if folded.rows is None:
        return spark.range(len(mappings)).select(F.col("id").cast("int").alias("perm"), F.lit(None).cast("double").alias("rho"))
    squares = folded.squares
    values = np.array([[m[c] for m in mappings] for c in ABJAD_BASE], dtype=np.float32)

    if folded.count <= most:
        blocks, shared = folded.blocks()

        tasks = max(1, min(len(mappings), 2 * spark.sparkContext.defaultParallelism))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            first = next(batches)
            own = range(int(first.task.iloc[0]), len(mappings), tasks)
            held = HeldPairs(chain([first], batches), shared, squares)
            for at in range(0, len(own), 4):
                perms = list(own[at : at + 4])
                yield pd.DataFrame({"perm": perms, "rho": pd.array([held.rho(d) for d in held.distances(values[:, perms])], dtype="Float64")})

        # a product by partitions: each task reads all blocks and has each ``tasks``-th permutation (a union of one-partition scans would be one task)
        each = spark.range(0, tasks, 1, tasks).withColumnRenamed("id", "task").hint("shuffle_replicate_nl").crossJoin(blocks.coalesce(1))
        return written(each.mapInPandas(run, "perm int, rho double"), "nulls")

    rows = folded.rows

    def arrays(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        letters = np.frombuffer(b"".join(b.letters), dtype=np.int16).reshape(-1, len(ABJAD_BASE)).astype(np.float32)
        return letters, np.column_stack([np.ones(len(b)), *[b[c].to_numpy() for c in controls]]), b.c.to_numpy(dtype=float), b.s.to_numpy()

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            letters, x, c, _ = arrays(b)
            sums = np.abs(letters @ values).astype(float).T @ (x * c[:, None])
            yield pd.DataFrame({"perm": np.repeat(np.arange(len(sums)), x.shape[1]), "i": np.tile(np.arange(x.shape[1]), len(sums)), "t": sums.ravel()})

    right = np.zeros((len(mappings), len(controls) + 1))
    for row in rows.mapInPandas(moments, "perm int, i int, t double").groupBy("perm", "i").agg(F.sum("t").alias("t")).collect():  # a few numbers a permutation
        right[row.perm, row.i] = row.t
    x = [F.lit(1.0), *[F.col(c) for c in controls]]
    sums = rows.agg(*[F.sum(F.col("c") * a * b) for a in x for b in x]).first()
    fits = np.linalg.lstsq(np.array(sums, dtype=float).reshape(len(x), len(x)), right.T, rcond=None)[0]

    def spread(batches: Iterator[pd.DataFrame], at: int) -> Iterator[pd.DataFrame]:
        for b in batches:
            letters, x, c, s = arrays(b)
            for k in range(at, min(at + block, len(mappings))):
                yield pd.DataFrame({"perm": k, "r": np.round(np.abs(letters @ values[:, k]).astype(float) - x @ fits[:, k], 12), "c": c, "s": s})

    out = None
    for at in range(0, len(mappings), block):
        per = rows.mapInPandas(lambda batches, at=at: spread(batches, at), "perm int, r double, c double, s double").groupBy("perm", "r").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
        own = W.partitionBy("perm").orderBy("r").rowsBetween(W.unboundedPreceding, -1)
        placed = per.withColumn("rank", F.coalesce(F.sum("c").over(own), F.lit(0.0)) + (F.col("c") + 1) / 2)
        n = F.sum("c")
        mean = (n + 1) / 2
        below = (F.lit(squares) / n - mean * mean) * (F.sum(F.col("c") * F.col("rank") * F.col("rank")) / n - mean * mean)
        part = written(placed.groupBy("perm").agg(F.when(below > 1e-12, (F.sum(F.col("rank") * F.col("s")) / n - mean * mean) / F.sqrt(below)).alias("rho")), "nulls")
        out = part if out is None else out.unionByName(part)
    return out


def null_summary(nulls: DataFrame, observed: float, plus_one: bool = False) -> DataFrame:
    """(n, mean, sd, p, low, high, passed): observed against a null; with ``plus_one`` p is (k + 1)/(n + 1), sd ddof 0, passed p < .05."""
    hit = F.sum((F.abs("rho") >= abs(observed)).cast("int"))
    p = (hit + 1) / (F.count("*") + 1) if plus_one else hit / F.count("*")
    sd = F.stddev_pop("rho") if plus_one else F.stddev_samp("rho")
    out = nulls.agg(F.count("*").alias("n"), F.avg("rho").alias("mean"), sd.alias("sd"), p.alias("p"), F.percentile("rho", F.lit(0.025)).alias("low"), F.percentile("rho", F.lit(0.975)).alias("high"), F.percentile(F.abs("rho"), F.lit(0.95)).alias("edge"))
    return out.withColumn("passed", F.col("p") < 0.05 if plus_one else F.lit(abs(observed)) > F.col("edge")).drop("edge")


def mapping_digest(mapping: dict[str, int]) -> str:
    return hashlib.md5(" ".join(f"{c}{v}" for c, v in sorted(mapping.items())).encode()).hexdigest()


def resumed(nulls_path: str, mappings: list[dict[str, int]], pairs: DataFrame, controls: list[str] | None = None, folded: FoldedPairs | None = None) -> DataFrame:
    """(perm, rho): permutations (partial ones with controls) that a table of results still lacks are run and appended; then all results.
    ``folded``: the pairs folded with these controls, where that is done already.

    A stored result counts only if it was made with the same mapping (so the same seed), the same number of pairs and the same
    controls; others stay in the table but are neither trusted nor returned.
    """
    spark = pairs.sparkSession
    run = f"{pairs.count()} {' '.join(controls or [])}"
    wanted = spark.createDataFrame([(k, mapping_digest(m)) for k, m in enumerate(mappings)], "perm int, mapping string")
    schema = "perm int, rho double, mapping string, run string"

    def stored() -> DataFrame:
        known = spark.read.schema(schema).parquet(nulls_path).where(F.col("run") == run)
        return known.join(F.broadcast(wanted), ["perm", "mapping"]).dropDuplicates(["perm"])

    try:
        done = {r[0] for r in stored().select("perm").collect()}  # one number a permutation
    except Exception:  # noqa: BLE001 - no table yet
        done = set()
    left = [k for k in range(len(mappings)) if k not in done]
    if left:
        own = [mappings[k] for k in left]
        fresh = partial_null(pairs, own, controls, folded=folded) if controls else permutation_null(pairs, own)
        number = F.array(*[F.lit(k) for k in left])
        named = fresh.select(F.get(number, F.col("perm")).alias("perm"), "rho").join(F.broadcast(wanted), "perm")
        named.select("perm", "rho", "mapping", F.lit(run).alias("run")).write.mode("append").parquet(nulls_path)
    return stored().select("perm", "rho")


def scrambled(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Pairs with the second word of another row and a position distance drawn evenly from the range of all.

    Rows are set off against each other by a seeded order, one shift apart.
    """
    from .geometry import ordinal_ranks

    draw = lambda k: seeded_column(F.concat(F.lit(f"{k}-"), F.col("pair_id").cast("string")))
    keyed = pairs.withColumn("__h", draw(seed))
    placed = ordinal_ranks(keyed.select("pair_id", "word_i", "word_j", "mean_attention", "pos_distance", "__h"), ["__h", "pair_id"], "__k")
    others = placed.select("__k", "word_j")
    n = others.count()
    ends = pairs.agg(F.min("pos_distance"), F.max("pos_distance")).first()
    low, high = ends[0] or 0, ends[1] or 0
    drawn = placed.drop("word_j").withColumn("pos_distance", (draw(seed + 1) % (high - low + 1) + low).cast("int"))
    return drawn.join(others.select(F.pmod(F.col("__k") + 1, F.lit(max(1, n))).alias("__k"), "word_j"), "__k").drop("__k", "__h")


# ---------------------------------------------------------------------------------------------------- tests on vectors

BLOCK = 512


def pairwise(vectors: DataFrame, group: str, key: str, vec: str, against: dict | None = None) -> DataFrame:
    """(group, pairs, mean, std, min, max) of the cosines of all pairs of a group.

    A group is cut into blocks of about ``BLOCK`` vectors; every two blocks meet once as a matrix product in one task that
    returns sums, so no pair is emitted and no task holds a group. With ``against`` (group, or None for all -> a bounded list
    of values) ``u`` is added: for how many pairs and values the pair is greater, half for equals.
    """
    spark = vectors.sparkSession
    ship(spark)
    known = vectors.where(f"{group} is not null and {vec} is not null").select(group, key, vec)
    sizes = written(known.groupBy(group).agg(F.count("*").alias("__n")), "group-sizes").withColumn("__blocks", F.greatest(F.lit(1), F.ceil(F.col("__n") / BLOCK)).cast("long"))
    blocked = known.join(sized(sizes), group).withColumn("__b", F.pmod(F.xxhash64(key), "__blocks")).groupBy(group, "__b").agg(F.collect_list(vec).alias("v"), F.first("__blocks").alias("__blocks"))
    blocked = written(blocked, "blocks")
    one = F.col("__b")
    left = blocked.select(F.col(group).alias("g"), one.alias("i"), F.explode(F.sequence(one, F.col("__blocks") - 1)).alias("j"), F.col("v").alias("a"))
    right = blocked.select(F.col(group).alias("g"), F.explode(F.sequence(F.lit(0), one)).alias("i"), one.alias("j"), F.col("v").alias("b"))
    both = left.join(right, ["g", "i", "j"])  # by block pair, so a hot group is spread
    shared = spark.sparkContext.broadcast({k: np.sort(v) for k, v in (against or {}).items()})

    def unit(v) -> np.ndarray:
        m = np.stack([np.asarray(x, dtype=float) for x in v])
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.where(n == 0, 0, m / np.where(n == 0, 1, n))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = shared.value
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                s = unit(r.a) @ unit(r.b).T
                s = s[np.triu_indices(len(s), 1)] if r.i == r.j else s.ravel()
                if len(s):
                    other = values.get(None, values.get(r.g, np.zeros(0)))
                    u = (np.searchsorted(other, s, side="left").sum() + np.searchsorted(other, s, side="right").sum()) / 2
                    rows.append((r.g, len(s), s.sum(), (s * s).sum(), s.min(), s.max(), u))
            yield pd.DataFrame(rows, columns=["g", "n", "s", "q", "lo", "hi", "u"])

    kind = dict(vectors.dtypes)[group]
    met = both.mapInPandas(meet, f"g {kind}, n long, s double, q double, lo double, hi double, u double")
    total = met.groupBy(F.col("g").alias(group)).agg(F.sum("n").alias("pairs"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum("u").alias("u"))
    mean = F.col("s") / F.col("pairs")
    return total.select(group, "pairs", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("pairs") - mean * mean)).alias("std"), "min", "max", *(["u"] if against is not None else []))


def greater_p(u: float, n1: int, n2: int) -> tuple[float, float]:
    """(z, p) that values of the first sample tend to be greater, by normal approximation, continuity corrected; p = 1 below 3 values."""
    sd = math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    z = (u - n1 * n2 / 2 - 0.5) / sd if sd else 0.0
    return z, 0.5 * math.erfc(z / math.sqrt(2)) if n1 >= 3 and n2 >= 3 else 1.0


def sims_at(vectors: DataFrame, order: list[str], vec: str, drawn: list[tuple[int, int]]) -> list[float]:
    """The cosines of drawn pairs of rows, given by their places in an order; a bounded list, so the driver gets it."""
    from .geometry import ordinal_ranks

    spark = vectors.sparkSession
    placed = ordinal_ranks(vectors.select(*order, vec), order, "__place").select("__place", vec)
    asked = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(drawn)], "k int, a long, b long")
    ends = asked.select("k", F.lit(0).alias("side"), F.col("a").alias("__place")).unionByName(asked.select("k", F.lit(1).alias("side"), F.col("b").alias("__place")))
    found = placed.join(F.broadcast(ends), "__place").groupBy("k").pivot("side", [0, 1]).agg(F.first(vec))
    from .field import cosine

    rows = found.select("k", cosine(F.col("0"), F.col("1")).alias("s")).collect()
    return [r.s for r in sorted(rows)]


def crossed(sizes: dict, count: int, name: str = "cross") -> list[tuple[int, int]]:
    """Seeded draws of two rows of different groups, as places in the order of group and key; none below two groups."""
    groups = sorted(sizes)
    start, at = {}, 0
    for g in groups:
        start[g] = at
        at += sizes[g]
    out = []
    for k in range(count if len(groups) > 1 else 0):
        x, y = seeded(f"{name}-{k}-a") % len(groups), seeded(f"{name}-{k}-b") % (len(groups) - 1)
        a, b = groups[x], groups[y + (y >= x)]
        out.append((start[a] + seeded(f"{name}-{k}-pa") % sizes[a], start[b] + seeded(f"{name}-{k}-pb") % sizes[b]))
    return out


DRAWN = 1000


def density(vectors: DataFrame, group: str, key: str, vec: str) -> dict:
    """How much closer vectors of a group are than vectors of two: all pairs within against seeded draws across.

    Draws: three for a pair within, ``DRAWN`` at most. Null vectors lower the coverage and take no part.
    """
    whole = vectors.where(f"{group} is not null").agg(F.count("*").alias("n"), F.count(vec).alias("known")).first()
    known = vectors.where(f"{group} is not null and {vec} is not null")
    sizes = {r[0]: r[1] for r in known.groupBy(group).count().collect()}  # a row a group
    within = sum(n * (n - 1) // 2 for n in sizes.values())
    cross = np.array(sims_at(known, [group, key], vec, crossed(sizes, min(DRAWN, 3 * within))))
    s = pairwise(known, group, key, vec, {None: cross})
    row = s.agg(F.sum("pairs").alias("n"), F.sum(F.col("mean") * F.col("pairs")).alias("s"), F.sum((F.col("std") ** 2 + F.col("mean") ** 2) * F.col("pairs")).alias("q"), F.sum("u").alias("u")).first()
    n = int(row.n or 0)
    out = {"families": len(sizes), "coverage_pct": 100.0 * whole.known / whole.n if whole.n else 0.0, "intra_pairs": n, "cross_pairs": len(cross)}
    mean = row.s / n if n else None
    std = math.sqrt(max(0.0, row.q / n - mean * mean)) if n else None
    both = bool(n and len(cross))
    gap = mean - float(cross.mean()) if both else None
    pooled = math.sqrt((std**2 + float(cross.std()) ** 2) / 2) if both else 0.0
    z, p = greater_p(float(row.u), n, len(cross)) if both else (None, 1.0)
    return out | {"intra_mean": mean, "intra_std": std, "cross_mean": float(cross.mean()) if both else None, "cross_std": float(cross.std()) if both else None, "gap": gap, "cohen_d": (gap / pooled if pooled else 0.0) if both else None, "z": z, "p": p, "significant": p < 0.05}


def attention_pool(weights: DataFrame) -> DataFrame:
    """(sentence, i, j, attention) with i < j, from (sentence, layer, head, i, j, weight): the mean over layers and heads of either
    direction, then of both; a direction that is missing or null takes no part, a word with itself neither."""
    known = weights.where("i <> j and weight is not null")
    ways = known.groupBy("sentence", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), (F.col("i") < F.col("j")).alias("onward")).agg(F.avg("weight").alias("w"))
    return ways.groupBy("sentence", F.col("a").alias("i"), F.col("b").alias("j")).agg(F.avg("w").alias("attention"))


def ranks_among(guesses: DataFrame, every: DataFrame, digits: int = 9) -> DataFrame:
    """(key, rank) for guesses (key, vec, sim): one more than the number of vectors (vec) of greater cosine, compared at ``digits``.

    Blocks of guesses meet blocks of vectors as matrix products that return a count a guess.
    """
    ship(guesses.sparkSession)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BLOCK):
                part = b.iloc[at : at + BLOCK]
                yield pd.DataFrame({c: [[x for x in part[c]]] for c in part.columns})

    asked = written(guesses.select("key", "vec", "sim").mapInPandas(gather, "key array<long>, vec array<array<double>>, sim array<double>"), "guesses")
    held = every.select(F.col("vec").alias("other")).mapInPandas(gather, "other array<array<double>>")

    def unit(v) -> np.ndarray:
        m = np.stack([np.asarray(x, dtype=float) for x in v])
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.where(n == 0, 0, m / np.where(n == 0, 1, n))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                s = np.round(unit(r.vec) @ unit(r.other).T, digits)
                yield pd.DataFrame({"key": r.key, "n": (s > np.round(np.asarray(r.sim, dtype=float), digits)[:, None]).sum(axis=1)})

    met = held.crossJoin(asked).mapInPandas(meet, "key long, n long")  # a row a pair of blocks
    return met.groupBy("key").agg((F.sum("n") + 1).alias("rank"))


def mann_whitney_greater(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(u, p, n1, n2): whether values of a tend to be greater, by normal approximation with ties and continuity corrected.

    Either sample below 3 gives p = 1.
    """
    both = a.select(F.lit(1).alias("first"), F.col(column).alias("v")).unionByName(b.select(F.lit(0).alias("first"), F.col(column).alias("v"))).where("v is not null")
    ranked = average_ranks(both, "v", "rank")
    ties = both.groupBy("v").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.pow("c", 3) - F.col("c")), F.lit(0.0)).alias("ties")).first()[0]
    r = ranked.agg(F.sum(F.when(F.col("first") == 1, F.col("rank"))).alias("r"), F.sum("first").alias("n1"), F.count("*").alias("n")).first()
    n1, n = int(r.n1 or 0), int(r.n)
    n2 = n - n1
    u, p = None, 1.0
    if n1 and n2:
        u = float(r.r) - n1 * (n1 + 1) / 2
        sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) if n > 1 else 0.0
        if n1 >= 3 and n2 >= 3 and sd:
            p = 0.5 * math.erfc((u - n1 * n2 / 2 - 0.5) / sd / math.sqrt(2))
    return a.sparkSession.createDataFrame([(u, p, n1, n2)], "u double, p double, n1 long, n2 long")


def seeded(text: str) -> int:
    """A draw that any engine with MD5 can repeat: the first 32 bits of the digest of a name."""
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def seeded_column(text: Column) -> Column:
    """The same as an expression."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
