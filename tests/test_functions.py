"""Text, letters, morphology and geometry on small fixtures, and the properties of the hyperbolic operations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.functions import hyperbolic as H
from lumenfield.functions import letters as L
from lumenfield.functions import morphology as M
from lumenfield.functions import text as T
from lumenfield.operators import geometry as G


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(("term", "status", "wazn"), [("سكوت", "ambiguous_vocalization", "faʿūl / fuʿūl"), ("كاتب", "parsed", "fāʿil"), ("سكينة", "parsed", "faʿīlah"), ("استحضار", "parsed", "istifʿāl"), ("إدراك", "not_parsed", None), ("عتبة", "ambiguous_vocalization", "faʿlah / fiʿlah / fuʿlah"), ("مكتوب", "ambiguous_structure", "mafʿūl / muftaʿil / muftaʿal"), ("مكتب", "ambiguous_structure", "mufaʿʿil / mufaʿʿal / mafʿal / mifʿal")])
def test_patterns(spark, term, status, wazn):
    r = one(spark, term, M.parse_pattern)
    assert (r.query_wazn_status, r.query_wazn) == (status, wazn)


def test_vowels_narrow(spark):
    df = spark.createDataFrame([("ذكر", "ذِكْر"), ("ذكر", None), ("كاتب", "كَاتِب")], "t string, v string")
    got = [tuple(r.p) for r in df.select(M.parse_vocalized(F.col("t"), F.col("v")).alias("p")).collect()]
    assert got[0] == ("fiʿl", "parsed")
    assert got[1][1] == "ambiguous_vocalization" and got[2] == ("fāʿil", "parsed")


def test_letters(spark):
    assert one(spark, "رحمة", L.abjad_value) == 200 + 8 + 40 + 400
    assert one(spark, "ماء", lambda c: L.letter_value_canonical(c)["value"]) == 42
    assert one(spark, "الرحمن", lambda c: L.letter_value_canonical(c)["value"]) + 31 == one(spark, "الرحمن", lambda c: L.letter_value_canonical(c, True)["value"])
    assert one(spark, "با", L.breakdown) == "ب=2 + ا=1 = 3"
    assert one(spark, "שלום", L.gematria_value) == 376
    assert one(spark, "", L.abjad_value) == 0 and one(spark, None, L.abjad_value) is None


def test_text(spark):
    assert one(spark, "  الآيَة ", T.normalize_term) == "ءاية"
    assert one(spark, "كـتَاب 12 x،", T.clean_arabic) == "كـتاب ،"
    assert one(spark, "<b>שָׁלוֹם</b> a", T.clean_hebrew) == "שלום"
    assert one(spark, "", T.tokenize) == [] and one(spark, None, T.clean_arabic) is None
    assert one(spark, "Ø±Ø\xadÙ…Ø©", T.repair_utf8) == "رحمة"


def test_roots(spark):
    assert one(spark, "والكتاب", M.extract_root) == "كتب" and one(spark, "ماء", M.extract_root) == ""
    assert one(spark, "مكتبة", M.extract_root) == "مكت"
    assert one(spark, "رحمة", M.extract_root) == "رحم"
    assert one(spark, "", M.root_hebrew) == ""


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(42)
    v = rng.normal(size=(600, 2))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * rng.uniform(0, 0.9, (600, 1))
    rows = [(k, *map(float, v[k]), *map(float, v[k + 300])) for k in range(300)]
    return spark.createDataFrame(rows, "k int, ux double, uy double, vx double, vy double").select("k", H.point("ux", "uy").alias("u"), H.point("vx", "vy").alias("v"))


def test_exp_undoes_log(points):
    back = points.select("k", "u", "v", H.log_x(F.col("u"), F.col("v")).alias("t")).select(F.sqrt(H.gap(H.exp_x(F.col("u"), F.col("t")), F.col("v"))).alias("e"))
    assert back.agg(F.max("e")).first()[0] < 1e-9


def test_midpoint_is_equidistant(points):
    m = points.select("u", "v", H.midpoint(F.col("u"), F.col("v")).alias("m")).select((H.dist(F.col("u"), F.col("m")) - H.dist(F.col("v"), F.col("m"))).alias("e"), (H.dist(F.col("u"), F.col("m")) * 2 - H.dist(F.col("u"), F.col("v"))).alias("f"))
    assert m.agg(F.max(F.abs("e")), F.max(F.abs("f"))).first()[0] < 1e-7


def test_legs(spark, points):
    l = points.select(H.legs(F.col("u"), F.col("v")).alias("l"))
    assert l.where("l.path_length < l.geodesic - 1e-9").count() == 0
    fixed = spark.createDataFrame([(0.2, 0.0, 0.7, 0.0), (0.5, 0.0, 0.0, 0.5), (0.3, 0.3, 0.3, 0.3)], "a double, b double, c double, d double").select(H.legs(H.point("a", "b"), H.point("c", "d")).alias("l")).select("l.*").collect()
    assert fixed[0].angular == 0 and fixed[0].radial_share == 1
    assert fixed[1].radial == 0 and fixed[1].angular_share == 1
    assert fixed[2].radial_share is None


def test_rim_distances_differ(spark):
    r = spark.createDataFrame([(0.999999, 0.0)], "x double, y double").select(H.dist_clamped(H.point("x", "y"), H.point(0.0, 0.0)).alias("a"), H.dist(H.point("x", "y"), H.point(0.0, 0.0)).alias("b"), H.dist_sentinel(H.point("x", "y"), H.point(0.0, 0.0)).alias("c")).first()
    assert [round(x, 4) for x in r] == [10.5967, 12.2061, 14.5087]


def test_frechet_beats_its_surroundings():
    rng = np.random.default_rng(1)
    for z in (np.array([0.85, 0.85j, -0.85]), rng.uniform(-0.5, 0.5, 9) + 1j * rng.uniform(-0.5, 0.5, 9)):
        c = G.frechet(z)
        cost = lambda p: float(np.mean(G.distance(np.array([p]), z) ** 2))
        assert all(cost(c) <= cost(c + d) + 1e-9 for d in 0.02 * (rng.normal(size=200) + 1j * rng.normal(size=200)) if abs(c + d) < 0.99)


def test_golden_legs(spark):
    """Published positions are rounded, so are the legs."""
    d = spark.createDataFrame([(-0.75, 0.15, 0.72, -0.2)], "a double, b double, c double, d double")
    m = d.select(H.midpoint(H.point("a", "b"), H.point("c", "d")).alias("m"), H.point("a", "b").alias("u"), H.point("c", "d").alias("v")).select(H.dist(F.col("m"), F.col("u")).alias("x"), H.dist(F.col("m"), F.col("v")).alias("y"), H.dist(F.col("u"), F.col("v")).alias("z")).first()
    assert abs(m.x - m.y) < 1e-7 and abs(m.x * 2 - m.z) < 1e-7


def test_nearest_edges(spark):
    c = spark.createDataFrame([(1, 0.1, 0.0), (2, 0.1, 0.0), (3, None, 0.0), (4, 0.5, 0.0)], "id long, px double, py double")
    t = spark.createDataFrame([(1, 0.1, 0.0), (9, None, None)], "target long, x double, y double")
    assert [(r.target, r.id, r["rank"]) for r in G.nearest(c, t, 5).orderBy("rank").collect()] == [(1, 2, 1), (1, 4, 2)]
    assert G.nearest(c.where("false"), t, 5).count() == 0


def test_grouped_karcher_matches_rows(spark):
    rows = [("a", 0.1, 0.2, 1.0), ("a", -0.3, 0.1, 0.5), ("a", 0.5, -0.2, 0.0), ("b", 0.6, 0.1, 1.0), (None, 0.2, 0.2, 0.0)]
    got = {r.g: (r.x, r.y) for r in G.grouped_karcher(spark.createDataFrame(rows, "g string, px double, py double, w double"), "g").collect()}
    want = G.karcher(np.array([[0.1 + 0.2j, -0.3 + 0.1j, 0.5 - 0.2j]]), np.array([[1.0, 0.5, 0.0]]))[0]
    assert abs(complex(*got["a"]) - want) < 1e-6 and got["b"] == pytest.approx((0.6, 0.1)) and got[None] == pytest.approx((0.2, 0.2))
