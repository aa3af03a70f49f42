"""Operators on point sets of the disk: means, cluster statistics, nearest neighbours, depth statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hyperbolic import CLAMP, EPS, MAX_NORM
from ..session import ship

#: Statistics over all pairs of a group are quadratic; larger groups are refused, never cut.
MAX_GROUP = 5000
#: Points of a block.
BLOCK = 2048

# ------------------------------------------------------------------------------------------ kernels, on complex arrays


def _clip(z: np.ndarray) -> np.ndarray:
    n = np.abs(z)
    return np.where(n >= MAX_NORM, z * (MAX_NORM / np.maximum(n, EPS)), z)


def distance(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    u, v = _clip(u), _clip(v)
    room = np.maximum((1 - np.abs(u) ** 2) * (1 - np.abs(v) ** 2), EPS)
    return np.arccosh(np.maximum(1.0, 1 + 2 * np.abs(u - v) ** 2 / room))


def distance_clamped(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    room = (1 - np.minimum(np.abs(u) ** 2, CLAMP)) * (1 - np.minimum(np.abs(v) ** 2, CLAMP))
    return np.arccosh(np.maximum(1.0, 1 + 2 * np.abs(u - v) ** 2 / room))


def _add(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    u, v = _clip(u), _clip(v)
    dot = (u * np.conj(v)).real
    uu, vv = np.abs(u) ** 2, np.abs(v) ** 2
    return _clip(((1 + 2 * dot + vv) * u + (1 - uu) * v) / np.maximum(1 + 2 * dot + uu * vv, EPS))


def _lam(x: np.ndarray) -> np.ndarray:
    return 2 / np.maximum(1 - np.abs(x) ** 2, EPS)


def log_at(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    moved = _add(-x, p)
    n = np.abs(moved)
    return np.where(n < EPS, 0, 2 / _lam(x) * np.arctanh(np.minimum(n, MAX_NORM)) * moved / np.maximum(n, EPS))


def exp_at(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    n = np.abs(t)
    return np.where(n < EPS, x, _add(x, np.tanh(_lam(x) * n / 2) * t / np.maximum(n, EPS)))


def karcher(points: np.ndarray, weights: np.ndarray, rounds: int = 64, tol: float = 1e-7) -> np.ndarray:
    """Weighted barycentres of many small sets at once: (n, k) points and weights (0 for an empty place) -> (n,)."""
    w = np.maximum(weights, 0)
    flat = w.sum(axis=1) < EPS
    w = np.where(flat[:, None], np.isfinite(points) & (weights > -np.inf), w).astype(float)
    w = w / np.maximum(w.sum(axis=1, keepdims=True), EPS)
    z = np.where(np.isfinite(points), points, 0)
    x = _clip((w * z).sum(axis=1))
    live = np.ones(len(x), dtype=bool)
    for _ in range(rounds):
        if not live.any():
            break
        g = (w[live] * log_at(x[live, None], z[live])).sum(axis=1)
        moving = np.abs(g) >= tol
        at = np.flatnonzero(live)
        x[at[moving]] = exp_at(x[at[moving]], g[moving])
        live[at[~moving]] = False
    return x


def frechet(points: np.ndarray, rounds: int = 256, tol: float = 1e-9) -> complex:
    """The intrinsic mean of one set, by descent with step halving."""
    z = _clip(np.asarray(points))
    if len(z) == 1:
        return complex(z[0])
    if len(z) == 2:
        return complex(z[0]) if abs(z[0] - z[1]) < EPS else complex(exp_at(z[:1], 0.5 * log_at(z[:1], z[1:]))[0])
    cost = lambda c: float(np.mean(distance(np.array([c]), z) ** 2))
    x = complex(_clip(np.array([z.mean()]))[0])
    for _ in range(rounds):
        g = complex(np.mean(log_at(np.array([x]), z)))
        if abs(g) < tol:
            break
        now, step = cost(x), 1.0
        while step > 1e-8:
            trial = complex(exp_at(np.array([x]), np.array([step * g]))[0])
            if cost(trial) < now - 1e-12:
                x = trial
                break
            step /= 2
        else:
            break
    return x


def mean_pairwise(points: np.ndarray) -> float:
    """The mean distance over unordered pairs, 0 below two points."""
    n = len(points)
    if n < 2:
        return 0.0
    return float(sum(distance(points[k], points[k + 1 :]).sum() for k in range(n - 1)) / (n * (n - 1) / 2))


# ------------------------------------------------------------------------------------------------------- operators


_XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


@F.pandas_udf(_XY)
def karcher_mean(xs: pd.Series, ys: pd.Series, ws: pd.Series) -> pd.DataFrame:
    """The barycentre of the points of each row (three arrays of equal length); null for null or empty arrays."""
    sizes = [len(x) if x is not None else 0 for x in xs]
    k = max(sizes, default=0)
    points = np.full((len(xs), max(k, 1)), np.nan, dtype=complex)
    weights = np.full(points.shape, -np.inf)
    for row, (x, y, w, n) in enumerate(zip(xs, ys, ws, sizes)):
        if n:
            points[row, :n] = np.asarray(x, dtype=float) + 1j * np.asarray(y, dtype=float)
            weights[row, :n] = np.asarray(w, dtype=float)
    made = karcher(points, weights)
    some = np.array(sizes, dtype=int) > 0
    return pd.DataFrame({"x": pd.Series(made.real).where(some), "y": pd.Series(made.imag).where(some)})


def frechet_statistics(points: DataFrame, group: str, baseline: float | None = None) -> DataFrame:
    """(group, n, x, y, variance, dispersion, mean_pairwise, tightness) of (group, px, py); null points take no part.

    A group larger than ``MAX_GROUP`` raises an error; tightness is null without a positive baseline.
    """
    ship(points.sparkSession)
    known = points.where("px is not null and py is not null")

    def measured(own: pd.DataFrame) -> pd.DataFrame:
        if len(own) > MAX_GROUP:
            raise ValueError(f"a group has more than {MAX_GROUP} points")
        own = own.sort_values(["px", "py"])
        z = _clip(own.px.to_numpy() + 1j * own.py.to_numpy())
        centre = frechet(z)
        variance = float(np.mean(distance(np.array([centre]), z) ** 2))
        pairwise = mean_pairwise(z)
        tight = pairwise / baseline if baseline and baseline > EPS else None
        return pd.DataFrame({group: [own[group].iloc[0]], "n": [len(own)], "x": [centre.real], "y": [centre.imag], "variance": [variance], "dispersion": [variance**0.5], "mean_pairwise": [pairwise], "tightness": [tight]})

    kind = dict(points.dtypes)[group]
    return known.select(group, "px", "py").groupBy(group).applyInPandas(measured, f"{group} {kind}, n int, x double, y double, variance double, dispersion double, mean_pairwise double, tightness double")


def _blocks(df: DataFrame, key: str, x: str, y: str, names: tuple[str, str, str]) -> DataFrame:
    """Points gathered into rows of three arrays, as they come in Arrow batches: a block holds a bounded number of them."""

    def gather(batches):
        for b in batches:
            for at in range(0, len(b), BLOCK):
                part = b.iloc[at : at + BLOCK].sort_values(key, kind="stable")
                yield pd.DataFrame({n: [part[c].to_numpy()] for n, c in zip(names, (key, x, y))})

    return df.select(key, x, y).mapInPandas(gather, f"{names[0]} array<long>, {names[1]} array<double>, {names[2]} array<double>")


def nearest(candidates: DataFrame, targets: DataFrame, k: int, same: bool = False, clamped: bool = False) -> DataFrame:
    """(target, id, distance, rank): for each target (target, x, y) its k nearest candidates (id, px, py), ties by id.

    The targets are a stated query set: blocks of targets meet blocks of candidates as distance matrices, each meeting keeps
    its own k best per target, and only those are shuffled. With ``same`` a candidate may be the target itself, ``clamped``
    chooses the distance of clamped norms. Targets and candidates with a null take no part.
    """
    ship(candidates.sparkSession)
    metric = distance_clamped if clamped else distance
    own = _blocks(candidates.where("id is not null and px is not null and py is not null"), "id", "px", "py", ("ids", "cx", "cy"))
    asked = _blocks(targets.where("target is not null and x is not null and y is not null"), "target", "x", "y", ("ts", "tx", "ty"))

    def meet(batches):
        for batch in batches:
            for r in batch.itertuples():
                d = metric((r.tx + 1j * r.ty)[:, None], (r.cx + 1j * r.cy)[None])
                if not same:
                    d = np.where(r.ids[None] == r.ts[:, None], np.inf, d)
                few = min(k, d.shape[1])
                pick = np.argsort(d, axis=1, kind="stable")[:, :few]
                best = np.take_along_axis(d, pick, axis=1)
                t, c = np.nonzero(np.isfinite(best))
                yield pd.DataFrame({"target": r.ts[t], "id": r.ids[pick[t, c]], "distance": best[t, c]})

    met = own.crossJoin(asked).mapInPandas(meet, "target long, id long, distance double")  # a row per pair of blocks
    order = W.partitionBy("target").orderBy("distance", "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tier_statistics(nodes: DataFrame) -> DataFrame:
    """(tier, n, mean, std, min, max) of r by level, capped at 2; null levels and radii take no part."""
    known = nodes.where("level is not null and r is not null").withColumn("tier", F.least("level", F.lit(2)))
    return known.groupBy("tier").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.min("r").alias("min"), F.max("r").alias("max"))


def band_overlap(tiers: DataFrame) -> DataFrame:
    """(tier_a, tier_b, overlap) of the radius bands of every two tiers (three tiers at most)."""
    a, b = tiers.select(F.col("tier").alias("tier_a"), F.col("min").alias("min_a"), F.col("max").alias("max_a")), tiers.select(F.col("tier").alias("tier_b"), F.col("min").alias("min_b"), F.col("max").alias("max_b"))
    width = F.least("max_a", "max_b") - F.greatest("min_a", "min_b")
    return a.join(F.broadcast(b), F.col("tier_a") < F.col("tier_b")).select("tier_a", "tier_b", F.greatest(F.lit(0.0), width).alias("overlap"))


def ordinal_ranks(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Ranks 0, 1, ... in a total order, without one window over all rows.

    The table is sorted into ranges, ranges are counted, and each rank is the count of the ranges before plus the place
    within its own.
    """
    ranged = df.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order]).withColumn("__part", F.spark_partition_id())
    ranged = ranged.withColumn("__at", F.row_number().over(W.partitionBy("__part").orderBy(*order)))
    from ..session import written

    ranged = written(ranged, "ranked")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    return ranged.join(F.broadcast(before.drop("__n")), "__part").withColumn(name, F.col("__before") + F.col("__at") - 1).drop("__part", "__at", "__before")


def depth_correlation(nodes: DataFrame) -> DataFrame:
    """(spearman_level_r): the correlation of ordinal ranks of level and radius; equal values rank in the order of node_id."""
    known = nodes.where("level is not null and r is not null").select("node_id", F.least("level", F.lit(2)).alias("tier"), "r")
    ranked = ordinal_ranks(ordinal_ranks(known, ["tier", "node_id"], "rank_level"), ["r", "node_id"], "rank_r")
    return ranked.agg(F.corr(F.col("rank_level").cast("double"), F.col("rank_r").cast("double")).alias("spearman_level_r"))


#: Groups whose barycentres the driver follows at once.
MAX_GROUPS = 10_000
#: Up to this many folded points are gathered once, as a pass over so few takes less time than it takes to begin it.
GATHERED = 100_000


def grouped_karcher(points: DataFrame, group: str, rounds: int = 64, tol: float = 1e-7) -> DataFrame:
    """(group, x, y): weighted barycentres of groups of any size, from (group, px, py, w).

    Equal points are folded first. Every round is one pass in which each task sums the tangent vectors of its own points per
    group; only those sums travel. More than ``MAX_GROUPS`` groups are refused.
    """
    from ..session import written

    spark = points.sparkSession
    ship(spark)
    kind = dict(points.dtypes)[group]
    folded = points.where("px is not null and py is not null").groupBy(group, "px", "py").agg(F.sum(F.greatest("w", F.lit(0.0))).alias("w"), F.count("*").alias("n"))
    folded = written(folded, "points")
    start = folded.groupBy(group).agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("px")).alias("sx"), F.sum(F.col("w") * F.col("py")).alias("sy"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("px")).alias("nx"), F.sum(F.col("n") * F.col("py")).alias("ny")).limit(MAX_GROUPS + 1).toPandas()
    if len(start) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    flat = start.sw < EPS
    centre = _clip(np.where(flat, start.nx + 1j * start.ny, start.sx + 1j * start.sy) / np.where(flat, start.n, start.sw.where(~flat, 1)))
    keys = [None if v != v else v for v in start[group].tolist()] if len(start) else []
    at = {k: n for n, k in enumerate(keys)}
    live = np.ones(len(keys), dtype=bool)
    few = folded.toPandas() if folded.count() <= GATHERED else None
    for _ in range(rounds):
        if not live.any():
            break
        state = (at, centre, live, flat.to_numpy())
        shared = spark.sparkContext.broadcast(state) if few is None else None

        def tangents(batches, shared=shared, state=None):
            at, centre, live, flat = state or shared.value
            sums = np.zeros((3, len(centre)))
            for b in batches:
                own = np.array([at[None if v != v else v] for v in b[group]], dtype=int)
                keep = live[own]
                own, part = own[keep], b[keep]
                w = np.where(flat[own], part.n, part.w)
                g = w * log_at(centre[own], part.px.to_numpy() + 1j * part.py.to_numpy())
                for row, v in enumerate((g.real, g.imag, w)):
                    sums[row] += np.bincount(own, weights=v, minlength=len(centre))
            some = np.flatnonzero(sums[2])
            yield pd.DataFrame({"k": some, "x": sums[0, some], "y": sums[1, some], "w": sums[2, some]})

        if few is None:
            moved = folded.mapInPandas(tangents, "k int, x double, y double, w double").groupBy("k").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("w").alias("w")).toPandas()
        else:
            moved = next(tangents([few], state=state))
        g = (moved.x + 1j * moved.y).to_numpy() / moved.w.to_numpy()
        k = moved.k.to_numpy()
        going = np.abs(g) >= tol
        centre[k[going]] = exp_at(centre[k[going]], g[going])
        live[:] = False
        live[k[going]] = True
    rows = [(k, float(c.real), float(c.imag)) for k, c in zip(keys, centre)]
    return spark.createDataFrame(rows, f"{group} {kind}, x double, y double")
