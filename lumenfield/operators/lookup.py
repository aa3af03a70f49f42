"""Composite queries: term lookup, neighbours in the log, comparison, projection. All are pure: nothing is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hyperbolic as H
from ..functions import letters as L
from ..functions import text as T
from ..functions.expr import let
from . import field as E
from . import geometry as G

TOP = 5
BOTTOM = 3


def lookup(terms: DataFrame, basis: E.Basis, mu: list[float], key: str = "term") -> DataFrame:
    """The whole profile of every term: attractors, repelled names, position, tier and root votes, centered rankings.

    Positions are rounded to 4 digits, except for the distance to the primary name, which takes the placement as it is.
    ``bottom_names`` keeps descending order, so the most repelled name is the last.
    """
    scored = E.placed_profiles(terms, basis, key).where("sims is not null")
    zero = F.array(*[F.lit(float(m)) for m in mu])
    wide = scored.select(key, "place", E.ranked(F.col("sims"), basis).alias("order"), E.ranked(F.zip_with("sims", zero, lambda s, m: s - m), basis).alias("centered"))
    wide = wide.select(key, "place", F.slice("order", 1, TOP).alias("top"), F.slice("order", -BOTTOM, BOTTOM).alias("bottom"), F.slice("centered", 1, TOP).alias("top_centered"), F.slice("centered", -BOTTOM, BOTTOM).alias("bottom_centered"))
    wide = wide.withColumn("level", E.vote(F.col("top"), "level")).withColumn("cluster", E.vote(F.col("top"), "root"))
    short = lambda c: F.transform(c, lambda t: F.struct(t["name"].alias("name"), F.round(t["sim"], 4).alias("sim")))
    primary = F.col("top")[0]
    position = F.struct(F.round("place.x", 4).alias("px"), F.round("place.y", 4).alias("py"), F.round("place.r", 4).alias("r"), F.col("level"), H.tier_label(F.col("level")).alias("level_label"))
    return wide.select(
        key, short("top").alias("top_names"), short("bottom").alias("bottom_names"), position.alias("position"), F.col("cluster").alias("cluster_pattern"),
        short("top_centered").alias("attractors_centered"), short("bottom_centered").alias("repelled_centered"),
        F.round(H.dist_sentinel(F.col("place"), H.point(primary["px"], primary["py"])), 4).alias("dist_to_primary"),
    )


def letters_of(term: Column) -> Column:
    """struct(value, breakdown) of a term without its vowel marks; null for null."""
    return let(T.strip_diac(term), lambda t: F.struct(F.when(t.isNotNull(), L.letter_value(t).cast("long")).alias("value"), L.breakdown(t).alias("breakdown")))


def log_records(log: DataFrame, *more: str) -> DataFrame:
    """(log_id, key, term_ar, px, py, r, level_label, attractors, bottoms, and ``more`` columns) of the log, first record of each key in arrival order."""
    from pyspark.sql import Window as W

    key = F.coalesce("term_undiacritized", F.regexp_replace("term_ar", "[\\u064B-\\u065F\\u0670\\u0640]", ""))
    rows = log.withColumn("key", key).where("key is not null")
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("log_id"))).where("n = 1")
    p = F.col("estimated_position")
    return first.select("log_id", "key", "term_ar", *more, p["px"].alias("px"), p["py"].alias("py"), p["r"].alias("r"), p["level_label"].alias("level_label"), F.col("top_name_attractors.ar").alias("attractors"), F.col("bottom_names.ar").alias("bottoms"))


def neighbours(records: DataFrame, targets: DataFrame, k: int = 10, least: float = 0.1, most: float = 0.95) -> DataFrame:
    """(target, id, rank, distance): the k nearest records of each target (target, x, y) with a radius in the band."""
    band = records.where(F.col("r").between(least, most)).select(F.col("log_id").alias("id"), "px", "py")
    return G.nearest(band, targets, k)


def compared(a: Column, b: Column) -> Column:
    """The comparison of two records: attractors in common and apart, opposing poles, distances, gloss; sets are sorted."""
    poles = F.array_union(F.array_intersect(a["attractors"], b["bottoms"]), F.array_intersect(b["attractors"], a["bottoms"]))
    u, v = H.point(a["px"], a["py"]), H.point(b["px"], b["py"])
    return let(
        H.dual_distance(u, v),
        lambda d: F.struct(
            F.array_sort(F.array_intersect(a["attractors"], b["attractors"])).alias("shared"), F.array_sort(F.array_except(a["attractors"], b["attractors"])).alias("only_1"),
            F.array_sort(F.array_except(b["attractors"], a["attractors"])).alias("only_2"), F.array_sort(poles).alias("opposing"),
            d["distance_euclidean"].alias("distance_euclidean"), d["distance_hyperbolic"].alias("distance_hyperbolic"), d["hierarchy_load"].alias("hierarchy_load"),
        ),
    )


def projected(candidates: DataFrame, context: DataFrame) -> tuple[DataFrame, tuple[float, float] | None]:
    """(concept, form, fit, rank, and all other columns) of candidates (concept, form, px, py, ...) by closeness to the barycentre of
    the context, and that barycentre.

    The context is (px, py, r), of any size; without any row the fit is null and candidates keep their order of form.
    """
    from pyspark.sql import Window as W

    whole = G.grouped_karcher(context.select(F.lit(1).alias("g"), "px", "py", F.greatest("r", F.lit(1e-3)).alias("w")), "g").collect()  # one row
    centre = (float(whole[0].x), float(whole[0].y)) if whole else None
    fit = F.lit(None).cast("double")
    if centre:
        fit = F.round(1 / (1 + H.dist_clamped(H.point("px", "py"), H.point(*centre))), 4)
    order = W.partitionBy("concept").orderBy(F.col("fit").desc_nulls_last(), "form")
    return candidates.withColumn("fit", fit).withColumn("rank", F.row_number().over(order)), centre
