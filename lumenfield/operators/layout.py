"""Fitting names on the disk. The basis is bounded, so the descent is one numpy loop; only its input comes from tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .field import Basis

#: Radius of each level, spread around it, weights of the edges, steps and rate of the descent, seed.
RADII = (0.30, 0.55, 0.78)
SPREAD = 0.04
LEAST_PULL, PUSH = 0.05, 0.6
STEPS, RATE, SEED = 500, 0.05, 42


def edges(sims: np.ndarray, near: int = 5, far: int = 3) -> Iterator[tuple[int, int, str, float]]:
    """(from, to, kind, weight): the most similar others attract, the least similar oppose; ties by order."""
    for i, row in enumerate(np.round(sims, 12)):
        others = [j for j in range(len(row)) if j != i]
        order = sorted(others, key=lambda j: (-row[j], j))
        for j in order[:near]:
            yield i, j, "attract", max(float(sims[i, j]), LEAST_PULL)
        for j in order[len(order) - far :]:
            yield i, j, "oppose", PUSH


def angles(sims: np.ndarray, levels: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(theta, radius): all angles move together, towards attracting and away from opposing names."""
    rng = np.random.default_rng(seed)
    theta = rng.uniform(0, 2 * np.pi, len(levels))
    radius = np.array(RADII)[np.minimum(levels, 2)] + SPREAD * (rng.random(len(levels)) - 0.5)
    listed = list(edges(sims))
    source = np.array([e[0] for e in listed])
    target = np.array([e[1] for e in listed])
    pull = np.array([w if kind == "attract" else -w for _, _, kind, w in listed])
    for _ in range(STEPS):
        turn = np.bincount(source, weights=pull * np.sin(theta[target] - theta[source]), minlength=len(theta))
        theta = theta + RATE * turn
    return theta % (2 * np.pi), radius


def fitted(spark: SparkSession, basis: Basis) -> DataFrame:
    """(name, px, py, r, level) of the fitted names, rounded to 4 digits."""
    theta, radius = angles(basis.centered(basis.matrix), basis.level)
    rows = [(int(n), round(float(r * np.cos(t)), 4), round(float(r * np.sin(t)), 4), round(float(r), 4), int(v)) for n, t, r, v in zip(basis.names, theta, radius, basis.level)]
    return spark.createDataFrame(rows, "name long, px double, py double, r double, level int")
