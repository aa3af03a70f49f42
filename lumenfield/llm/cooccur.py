"""Items that appear together: an incremental table of pair counts and association scores.

Method. A basket is the set of the items of one record. Changed baskets (new, altered or gone) emit signed pair and
marginal deltas: -1 for every pair of the old version, +1 for every pair of the new one; unchanged baskets emit nothing.
Deltas are summed before the shuffle and after it, merged into counts that persist in hash buckets, and only touched
buckets are written again. Scores (``lift`` = n(ab) N / (n(a) n(b))) are recomputed for the pairs that a change affects: those
that hold an item whose own count changed (so those whose own count did), and all pairs of a group whose total N changed.

A table lives in a folder: versions of buckets, and a manifest for every version, written last and by one rename. So a session
can be closed and the table opened again, a change that failed half way isn't seen, and one that is applied a second time under
its name does nothing. The number of buckets follows the number of counts (``BUCKET_ROWS`` each, ``MOST_BUCKETS`` at most; a bucket
beyond that size has several files); a table that outgrew its buckets four times is laid out anew.

Pairs form only inside one ``grp`` of items (for instance a language), which has its own total N: the baskets that hold
any of its items.

Null baskets and null items are ignored, repeated items of a basket count once, a basket of one item counts for N and for
its marginal alone. An empty change leaves the table as it is; an empty table has no pairs. A basket of more than ``PART`` items
is kept in parts of about that size; every two parts meet in a row of their own, so the pairs of a hot basket are spread.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import own_folder, sized, written

BUCKET_ROWS = 500_000
MOST_BUCKETS = 1024
PART = 1024


def baskets(rows: DataFrame) -> DataFrame:
    """(basket, grp, part, parts, items) from rows of (basket, grp, item): the sorted distinct items, in parts if they are many."""
    known = written(rows.where("basket is not null and item is not null").select("basket", "grp", "item").distinct(), "basket-items")
    large = written(known.groupBy("basket", "grp").agg(F.count("*").alias("n")).where(F.col("n") > PART).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).drop("n"), "large-baskets")
    keys = ["basket", "grp"]
    listed = F.sort_array(F.collect_list("item")).alias("items")
    if large.isEmpty():
        return known.groupBy(*keys).agg(listed).select(*keys, F.lit(0).alias("part"), F.lit(1).alias("parts"), "items")
    small = known.join(sized(large), keys, "left_anti").groupBy(*keys).agg(listed).select(*keys, F.lit(0).alias("part"), F.lit(1).alias("parts"), "items")
    split = known.join(sized(large), keys).withColumn("part", F.pmod(F.xxhash64("item"), "parts").cast("int"))
    return small.unionByName(split.groupBy(*keys, "part", "parts").agg(listed).select(*keys, "part", "parts", "items"))


def changes(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(basket, grp, part, parts, items, sign) of the baskets that differ between two versions; ``old`` is None where there was nothing."""
    if old is None:
        return new.withColumn("sign", F.lit(1))
    keys = ["basket", "grp", "part"]
    a = old.select(*keys, F.col("parts").alias("parts_0"), F.col("items").alias("before"))
    b = new.select(*keys, F.col("parts").alias("parts_1"), F.col("items").alias("after"))
    both = written(a.join(b, keys, "full").withColumn("differs", ~(F.col("before").eqNullSafe(F.col("after")) & F.col("parts_0").eqNullSafe(F.col("parts_1")))), "versions")
    # a part that stays the same still meets the changed parts of its basket
    large = both.where("differs and greatest(parts_0, parts_1) > 1").select("basket", "grp").distinct()
    other = both.where("not differs and parts_0 > 1").join(large, ["basket", "grp"], "left_semi")
    moved = both.where("differs").unionByName(other)
    versions = F.array(F.struct(F.col("before").alias("items"), F.col("parts_0").alias("parts"), F.lit(-1).alias("sign")), F.struct(F.col("after").alias("items"), F.col("parts_1").alias("parts"), F.lit(1).alias("sign")))
    return moved.select(*keys, F.explode(versions).alias("v")).select(*keys, "v.parts", "v.items", "v.sign").where("items is not null")


def pair_deltas(changed: DataFrame) -> DataFrame:
    """(grp, a, b, n): the signed counts of pairs, a before b."""
    first = changed.select("grp", "sign", "items", F.posexplode("items").alias("i", "a"))
    within = first.select("grp", "sign", "a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("b"))
    large = changed.where("parts > 1")
    keys = ["basket", "grp", "sign", "i", "j"]
    left = large.where(F.col("part") + 1 < F.col("parts")).select("basket", "grp", "sign", F.col("part").alias("i"), F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("j"), F.col("items").alias("x"))
    right = large.where("part > 0").select("basket", "grp", "sign", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("i"), F.col("part").alias("j"), F.col("items").alias("y"))
    met = left.join(right, keys).select("grp", "sign", F.explode("x").alias("x"), "y").select("grp", "sign", "x", F.explode("y").alias("y"))
    across = met.select("grp", "sign", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return within.unionByName(across).groupBy("grp", "a", "b").agg(F.sum("sign").alias("n"))


def item_deltas(changed: DataFrame) -> DataFrame:
    """(grp, a, b, n): the marginals as pairs of an item with itself; a row without items is the total of the group."""
    each = changed.select("grp", "sign", F.explode("items").alias("a")).groupBy("grp", "a").agg(F.sum("sign").alias("n")).select("grp", "a", F.col("a").alias("b"), "n")
    whole = changed.groupBy("basket", "grp", "sign").agg(F.lit(1).alias("one")) if "basket" in changed.columns else changed
    total = whole.groupBy("grp").agg(F.sum("sign").alias("n"))
    return each.unionByName(total, allowMissingColumns=True)


class PairTable:
    """Counts of pairs, items and baskets in hash buckets below one folder; every change is a new version of the touched buckets."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        """Open the table of a folder, or begin one; without a folder the table lasts as long as the application."""
        self.spark = spark
        self.folder = (folder or f"{own_folder(spark)}/pair-table-{uuid.uuid4().hex}").rstrip("/")
        self.version = 0
        self.buckets = 0
        self.rows = 0
        self.schema = ""
        #: bucket -> version that holds its newest counts; as many entries as buckets
        self.where: dict[int, int] = {}
        #: names of the changes that are in the table
        self.applied: list[str] = []
        self.affected: DataFrame | None = None
        self._open()

    # -- manifest

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _open(self) -> None:
        files, path = self._files()
        if not files.exists(path):
            return
        names = [s.getPath().getName() for s in files.listStatus(path)]
        versions = sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))
        if versions:
            known = json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.folder}/manifest-{versions[-1]}.json").collect()))  # one small file
            self.version, self.buckets, self.rows, self.schema, self.applied = known["version"], known["buckets"], known["rows"], known["schema"], known["applied"]
            self.where = {int(k): v for k, v in known["where"].items()}

    def _commit(self) -> None:
        """Write the manifest of this version: readers see the change from its rename on."""
        files, _ = self._files()
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        known = {"version": self.version, "buckets": self.buckets, "rows": self.rows, "schema": self.schema, "applied": self.applied, "where": {str(k): v for k, v in self.where.items()}}
        new = Path(f"{self.folder}/.manifest-{uuid.uuid4().hex}")
        out = files.create(new)
        out.write(bytearray(json.dumps(known).encode()))
        out.close()
        if not files.rename(new, Path(f"{self.folder}/manifest-{self.version}.json")):
            raise RuntimeError(f"version {self.version} of {self.folder} was written by another")

    # -- counts

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.hash("grp", "a", "b"), F.lit(self.buckets)))

    def counts(self, only: list[int] | None = None) -> DataFrame:
        """(grp, a, b, n, bucket) of the newest versions."""
        by: dict[int, list[int]] = {}
        for bucket, version in self.where.items():
            if only is None or bucket in only:
                by.setdefault(version, []).append(bucket)
        if not by:
            return self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{v}").where(F.col("bucket").isin(b)) for v, b in sorted(by.items())]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _write(self, counts: DataFrame, rows: int) -> None:
        files = max(1, -(-rows // (self.buckets * BUCKET_ROWS)))  # of a bucket
        spread = counts.select("grp", "a", "b", "n", "bucket").where("n <> 0").repartition(self.buckets * files, F.col("bucket"), F.pmod(F.xxhash64("a", "b"), F.lit(files)))
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/v{self.version + 1}")

    def apply(self, changed: DataFrame, name: str | None = None) -> "PairTable":
        """Merge the deltas of changed baskets; ``affected`` then holds (grp, a, n) of the items and, with a null item, the totals that changed.

        A change of a name that was applied before does nothing.
        """
        name = name or uuid.uuid4().hex
        self.affected = self.spark.createDataFrame([], "grp string, a string, n long")
        if name in self.applied:
            return self
        changed = written(changed, "changed-baskets")
        marginal = written(item_deltas(changed).where("n <> 0"), "marginal-deltas")
        deltas = written(pair_deltas(changed).where("n <> 0").unionByName(marginal), "deltas")
        number = deltas.count()
        if not number:
            return self
        if not self.where:
            self.buckets = min(MOST_BUCKETS, max(1, -(-number // BUCKET_ROWS)))
            self.schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in deltas.schema) + ", bucket int"
            self._write(self._bucketed(deltas), number)
            touched = list(range(self.buckets))
        else:
            if self.rows + number > 4 * self.buckets * BUCKET_ROWS and self.buckets < MOST_BUCKETS:
                before = self.counts().drop("bucket")
                self.buckets = min(MOST_BUCKETS, -(-(self.rows + number) // BUCKET_ROWS))
                touched = list(range(self.buckets))
            else:
                touched = [r[0] for r in self._bucketed(deltas).select("bucket").distinct().collect()]  # at most MOST_BUCKETS rows
                before = self.counts(touched).drop("bucket")
            merged = before.unionByName(deltas).groupBy("grp", "a", "b").agg(F.sum("n").alias("n"))
            self._write(self._bucketed(merged), self.rows + number)
        self.version += 1
        self.where = {b: v for b, v in self.where.items() if b < self.buckets and b not in set(touched)} | {b: self.version for b in touched}
        self.rows += number
        self.applied.append(name)
        self._commit()
        self.affected = marginal.select("grp", "a", "n")
        return self

    # -- scores

    def scores(self, affected_by: DataFrame | None = None) -> DataFrame:
        """(grp, a, b, n_ab, n_a, n_b, n_all, lift) of all pairs, or of those that a change affects, as ``affected`` has it."""
        if not self.where:
            return self.spark.createDataFrame([], "grp string, a string, b string, n_ab long, n_a long, n_b long, n_all long, lift double")
        counts = self.counts().drop("bucket")
        pairs = counts.where("a <> b")
        if affected_by is not None:
            groups = affected_by.where("a is null").select("grp").distinct()
            items = affected_by.where("a is not null").select("grp", "a").distinct()
            whole = pairs.join(groups, pairs["grp"].eqNullSafe(groups["grp"]), "left_semi")
            rest = pairs.join(groups, pairs["grp"].eqNullSafe(groups["grp"]), "left_anti")
            by_a = rest.join(items, ["grp", "a"], "left_semi")
            by_b = rest.join(items, ["grp", "a"], "left_anti").join(items.withColumnRenamed("a", "b"), ["grp", "b"], "left_semi")
            pairs = whole.unionByName(by_a.select("grp", "a", "b", "n")).unionByName(by_b.select("grp", "a", "b", "n"))
        single = counts.where("a = b").select("grp", "a", F.col("n").alias("n_item"))
        totals = counts.where("a is null").select("grp", F.col("n").alias("n_all"))
        single = written(single.join(sized(written(totals, "totals")), "grp"), "single-counts")
        out = pairs.join(sized(single.withColumnRenamed("n_item", "n_a")), ["grp", "a"]).join(sized(single.select("grp", F.col("a").alias("b"), F.col("n_item").alias("n_b"))), ["grp", "b"])
        return out.select("grp", "a", "b", F.col("n").alias("n_ab"), "n_a", "n_b", "n_all", lift().alias("lift"))


def lift() -> Column:
    return F.col("n") * F.col("n_all") / (F.col("n_a") * F.col("n_b"))
