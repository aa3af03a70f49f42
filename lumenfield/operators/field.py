"""Semantic-field scoring: terms against the fixed basis, profiles, votes, placement.

The basis is bounded (99 names): its matrix is shipped to every task and terms are scored as matrix products on Arrow
batches, one row of similarities per term, so that rankings, votes and placements of a term need no shuffle.

Vectors of another length than the basis and null vectors score null. Ties rank in the order of the names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import let
from ..session import ship
from . import geometry as G

#: The basis travels with every task; a larger one is refused.
MAX_BASIS = 10_000


class Basis:
    """The basis on the driver: names, positions, levels, roots, vectors in the order of the names."""

    def __init__(self, df: DataFrame) -> None:
        rows = df.select("name", "ar", "px", "py", "level", "root", "vec").limit(MAX_BASIS + 1).toPandas().sort_values("name")
        if len(rows) > MAX_BASIS:
            raise ValueError(f"the basis has more than {MAX_BASIS} names")
        self.names = rows.name.tolist()
        self.ar = rows.ar.tolist()
        self.px, self.py = rows.px.to_numpy(dtype=float), rows.py.to_numpy(dtype=float)
        self.level = np.minimum(rows.level.to_numpy(dtype=int), 2)
        self.root = rows.root.tolist()
        self.matrix = np.array(rows.vec.tolist(), dtype=float)
        self.centre = self.matrix.mean(axis=0)

    def centered(self, vectors: np.ndarray) -> np.ndarray:
        """Cosines of centered vectors with the centered names; 0 where a norm vanishes."""
        a, b = vectors - self.centre, self.matrix - self.centre
        below = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None]
        return np.where(below <= 1e-10, 0.0, a @ b.T / np.maximum(below, 1e-10))

    def field_zero(self) -> np.ndarray:
        """The mean similarity of every name to the others."""
        s = self.centered(self.matrix)
        return (s.sum(axis=1) - np.diag(s)) / max(1, len(s) - 1)


#: How many attractors place a term.
PLACED = 5


def profiles(terms: DataFrame, basis: Basis, key: str = "term", vec: str = "vec") -> DataFrame:
    """Add ``sims``: the similarities with the names, in the order of the basis."""
    return _scored(terms, basis, vec, False)


def placed_profiles(terms: DataFrame, basis: Basis, key: str = "term", vec: str = "vec") -> DataFrame:
    """Add ``sims`` and ``place`` (x, y, r): the barycentre of the first names, weighted by positive similarity, the origin if there
    is none. Both are made in one step, so that no Python function waits for the result of another."""
    return _scored(terms, basis, vec, True)


def _scored(terms: DataFrame, basis: Basis, vec: str, place: bool) -> DataFrame:
    spark = terms.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(basis)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        b = shared.value
        width = b.matrix.shape[1]
        at = b.px + 1j * b.py
        for batch in batches:
            good = np.array([v is not None and len(v) == width for v in batch], dtype=bool)
            sims: list = [None] * len(batch)
            spots = np.full(len(batch), np.nan, dtype=complex)
            if good.any():
                s = b.centered(np.stack(batch[good].to_list()).astype(float))
                for k, row in zip(np.flatnonzero(good), s):
                    sims[k] = row
                if place:
                    first = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :PLACED]
                    weights = np.maximum(np.take_along_axis(s, first, axis=1), 0.0)
                    spots[good] = np.where((weights > 0).any(axis=1), G.karcher(at[first], weights), 0)
            frame = pd.DataFrame({"sims": pd.Series(sims, dtype=object)})
            yield frame.assign(x=spots.real, y=spots.imag, r=np.abs(spots)) if place else frame

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    made = F.pandas_udf(score, "sims array<double>" + (", x double, y double, r double" if place else "")).asNondeterministic()(F.col(vec))  # else a filter on the result repeats it
    out = terms.withColumn("__scored", made).withColumn("sims", F.col("__scored.sims"))
    if place:
        some = F.col("sims").isNotNull()
        out = out.withColumn("place", F.when(some, F.struct("__scored.x", "__scored.y", "__scored.r")))
    return out.drop("__scored")


def profile_gram(scored: DataFrame, width: int) -> np.ndarray:
    """Products of the columns of ``sims`` over all rows, with a column of ones last: summed per batch, then (width + 1)^2 numbers."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 1, width + 1))
        for b in batches:
            rows = [np.append(x, 1.0) for x in b.sims]
            if rows:
                m = np.stack(rows)
                total += m.T @ m
        yield pd.DataFrame({"g": [total.ravel()]})

    parts = scored.where("sims is not null").select("sims").mapInPandas(grams, "g array<double>")
    summed = parts.select(F.posexplode("g").alias("at", "g")).groupBy("at").agg(F.sum("g").alias("g")).collect()
    out = np.zeros((width + 1) ** 2)
    for r in summed:
        out[r["at"]] = r.g
    return out.reshape(width + 1, width + 1)


def constants(basis: Basis) -> Column:
    """The names as one array literal, folded once by the optimizer however many names there are."""
    rows = [{"name": int(n), "px": float(x), "py": float(y), "level": int(v), "root": int(r)} for n, x, y, v, r in zip(basis.names, basis.px, basis.py, basis.level, basis.root)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<name:bigint,px:double,py:double,level:int,root:int>>")


def ranked(sims: Column, basis: Basis, digits: int = 12) -> Column:
    """The names as structs (sim, name, px, py, level, root), most similar first; equals in the order of the names."""
    fixed = constants(basis)
    order = F.sort_array(F.transform(sims, lambda s, at: F.struct((-F.round(s, digits)).alias("key"), at.alias("at"), s.alias("sim"))))
    return F.transform(order, lambda o: let(F.get(fixed, o["at"]), lambda n: F.struct(o["sim"].alias("sim"), n["name"].alias("name"), n["px"].alias("px"), n["py"].alias("py"), n["level"].alias("level"), n["root"].alias("root"))))


def vote(top: Column, field: str) -> Column:
    """The value of a field with the largest sum of positive similarities; among equals the one met first."""
    values = F.array_distinct(F.transform(top, lambda t: t[field]))
    summed = F.transform(values, lambda v, at: F.struct(F.aggregate(top, F.lit(0.0), lambda acc, t: acc + F.when(t[field] == v, F.greatest(t["sim"], F.lit(0.0))).otherwise(0.0)).alias("votes"), (-at).alias("order"), v.alias("value")))
    return F.array_max(summed)["value"]


def placed_euclid(top: Column) -> Column:
    """The flat weighted mean instead."""
    weight = F.aggregate(top, F.lit(0.0), lambda acc, t: acc + F.greatest(t["sim"], F.lit(0.0)))
    mean = lambda c: F.when(weight > 0, F.aggregate(top, F.lit(0.0), lambda acc, t: acc + F.greatest(t["sim"], F.lit(0.0)) * t[c]) / weight).otherwise(0.0)
    return F.struct(mean("px").alias("x"), mean("py").alias("y"))


def array_mean(vectors: DataFrame, group: list[str], vec: str = "vec") -> DataFrame:
    """The element-wise mean of the vectors of each group, as an ordered array."""
    each = vectors.select(*group, F.posexplode(vec).alias("at", "v"))
    per = each.groupBy(*group, "at").agg(F.avg("v").alias("v"))
    return per.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias(vec))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 if a norm is 0."""
    below = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(below == 0, 0.0).otherwise(dot(a, b) / below)
