"""Hyperbolic geometry of the unit disk (curvature -1) as Column expressions over points, structs of two doubles.

Three distances are kept apart, as they differ close to the rim: ``dist`` clips points to the disk, ``dist_clamped`` clamps
squared norms, ``dist_sentinel`` gives a fixed value where the denominator vanishes. Null coordinates give null.

Intermediate points are bound once (``let``), so that the trees of nested operations stay small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let

#: Fixed values.
EPS = 1e-9
MAX_NORM = 1 - 1e-5
CLAMP = 0.9999
SENTINEL = 9.99
TIERS = ["Dhāt", "Ṣifāt", "Afʿāl"]


def point(x: Column | str | float, y: Column | str | float) -> Column:
    x, y = (F.col(c) if isinstance(c, str) else F.lit(c) if isinstance(c, float) else c for c in (x, y))
    return F.struct(x.alias("x"), y.alias("y"))


def square(p: Column) -> Column:
    return p["x"] * p["x"] + p["y"] * p["y"]


def norm(p: Column) -> Column:
    return F.sqrt(square(p))


def gap(u: Column, v: Column) -> Column:
    """The squared Euclidean distance."""
    return (u["x"] - v["x"]) * (u["x"] - v["x"]) + (u["y"] - v["y"]) * (u["y"] - v["y"])


def times(p: Column, factor: Column | float) -> Column:
    return point(p["x"] * factor, p["y"] * factor)


def clip(p: Column) -> Column:
    """A point outside the largest norm is pulled back to it."""
    return let(p, lambda q: F.when(norm(q) >= MAX_NORM, times(q, F.lit(MAX_NORM) / norm(q))).otherwise(point(q["x"], q["y"])))


def _acosh1(c: Column) -> Column:
    return F.acosh(F.greatest(F.lit(1.0), c))


def dist(u: Column, v: Column) -> Column:
    return let(clip(u), lambda a: let(clip(v), lambda b: _acosh1(1 + 2 * gap(a, b) / F.greatest((1 - square(a)) * (1 - square(b)), F.lit(EPS)))))


def dist_clamped(u: Column, v: Column) -> Column:
    room = (1 - F.least(square(u), F.lit(CLAMP))) * (1 - F.least(square(v), F.lit(CLAMP)))
    return F.when(F.isnull(square(u)) | F.isnull(square(v)), None).otherwise(_acosh1(1 + 2 * gap(u, v) / room))


def dist_sentinel(u: Column, v: Column) -> Column:
    return let((1 - square(u)) * (1 - square(v)), lambda room: F.when(room <= 1e-10, F.lit(SENTINEL)).otherwise(_acosh1(1 + 2 * gap(u, v) / room)))


def mobius_add(u: Column, v: Column) -> Column:
    def added(a: Column, b: Column) -> Column:
        dot = a["x"] * b["x"] + a["y"] * b["y"]
        below = F.greatest(1 + 2 * dot + square(a) * square(b), F.lit(EPS))
        left, right = 1 + 2 * dot + square(b), 1 - square(a)
        return point((left * a["x"] + right * b["x"]) / below, (left * a["y"] + right * b["y"]) / below)

    return clip(let(clip(u), lambda a: let(clip(v), lambda b: added(a, b))))


def negative(p: Column) -> Column:
    return times(p, -1.0)


def _along(p: Column, length: Callable[[Column], Column]) -> Column:
    """The direction of a vector with another length; the zero vector below EPS."""
    return let(p, lambda q: let(norm(q), lambda n: F.when(n < EPS, point(0.0, 0.0)).otherwise(times(q, length(n) / n))))


def exp0(t: Column) -> Column:
    return clip(_along(t, F.tanh))


def log0(p: Column) -> Column:
    return _along(clip(p), F.atanh)


def _lambda(x: Column) -> Column:
    return F.lit(2.0) / F.greatest(1 - square(x), F.lit(EPS))


def log_x(x: Column, p: Column) -> Column:
    """The tangent vector at x that leads to p."""
    return let(x, lambda a: _along(mobius_add(negative(a), p), lambda n: F.lit(2.0) / _lambda(a) * F.atanh(F.least(n, F.lit(MAX_NORM)))))


def exp_x(x: Column, t: Column) -> Column:
    """The point reached from x along a tangent vector."""
    return let(x, lambda a: let(t, lambda b: F.when(norm(b) < EPS, point(a["x"], a["y"])).otherwise(mobius_add(a, _along(b, lambda n: F.tanh(_lambda(a) * n / 2))))))


def midpoint(u: Column, v: Column) -> Column:
    """Half way along the geodesic; u itself if both are the same."""
    return let(clip(u), lambda a: let(clip(v), lambda b: F.when(F.sqrt(gap(a, b)) < EPS, point(a["x"], a["y"])).otherwise(exp_x(a, times(log_x(a, b), 0.5)))))


def legs(u: Column, v: Column) -> Column:
    """struct of the radial and angular leg of the L-shaped path, their shares (null without length), angle, path, geodesic."""

    def measured(a: Column, b: Column) -> Column:
        r1, r2 = F.least(norm(a), F.lit(MAX_NORM)), F.least(norm(b), F.lit(MAX_NORM))
        raw = F.abs(F.atan2(a["y"], a["x"]) - F.atan2(b["y"], b["x"]))
        return F.struct(F.abs(2 * F.atanh(r1) - 2 * F.atanh(r2)).alias("radial"), F.least(r1, r2).alias("low"), F.when(raw > F.pi(), 2 * F.pi() - raw).otherwise(raw).alias("angle"))

    def turned(m: Column) -> Column:
        return dist(point(m["low"], F.lit(0.0)), point(m["low"] * F.cos(m["angle"]), m["low"] * F.sin(m["angle"])))

    def shared(m: Column, angular: Column, total: Column) -> Column:
        none = F.when(total < EPS, None)
        return F.struct(m["radial"].alias("radial"), angular.alias("angular"), none.otherwise(m["radial"] / total).alias("radial_share"), none.otherwise(angular / total).alias("angular_share"), F.degrees(m["angle"]).alias("delta_theta_deg"), total.alias("path_length"), dist(u, v).alias("geodesic"))

    return let(clip(u), lambda a: let(clip(v), lambda b: let(measured(a, b), lambda m: let(turned(m), lambda g: shared(m, g, m["radial"] + g)))))


def gloss(radial_share: Column, angular_share: Column) -> Column:
    """What the shares (rounded to 3) say."""
    return (
        F.when(radial_share.isNull(), "coincident positions")
        .when(radial_share >= 0.65, "depth-dominated: same field, different differentiation")
        .when(angular_share >= 0.65, "field-dominated: comparable depth, different semantic field")
        .otherwise("mixed: separation runs through both depth and field")
    )


def dual_distance(u: Column, v: Column) -> Column:
    """struct of flat and hyperbolic distance and their ratio (null for coincident points)."""
    pair = F.struct(F.sqrt(gap(u, v)).alias("flat"), dist_clamped(u, v).alias("deep"))
    return let(pair, lambda d: F.struct(F.round(d["flat"], 4).alias("distance_euclidean"), F.round(d["deep"], 4).alias("distance_hyperbolic"), F.when(d["flat"] > 1e-6, F.round(d["deep"] / d["flat"], 3)).alias("hierarchy_load")))


def tier_label(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.least(level, F.lit(2)) + 1)
