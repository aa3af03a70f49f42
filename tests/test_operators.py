"""Hygiene, sources, streaming, retrieval and statistics on small fixtures."""

import json
import math
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfield.operators import hygiene as Y
from lumenfield.operators import retrieval as R
from lumenfield.operators import stats as S
from lumenfield.sources import files
from lumenfield.streaming import log as stream


def test_noise_and_validation(spark):
    rows = [("سكينة", 0.5, 0.3, 0.4), ("ثلاثة", 0.5, 0.3, 0.4), ("الف1", 0.5, 0.1, 0.1), ("abc", 0.5, 0.1, 0.1), ("ن", 0.5, 0.1, 0.1), ("سكينة", 0.5, 0.3, 0.4), ("رحمة", 1.2, 0.3, 0.4), ("نور", 0.5, 0.9, 0.9), (None, None, None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "line int, term string, r double, px double, py double")
    got = {r.line: r.reason for r in Y.cleaned(df, F.col("term"), "line").collect()}
    assert got == {0: None, 1: "calibration_number_word", 2: "contains_digits", 3: "non_arabic", 4: "too_short", 5: "duplicate", 6: "r_out_of_range:1.2", 7: "outside_poincare_disk", 8: "too_short"}


def test_contract_and_mismatches(spark):
    good = spark.createDataFrame([(1, 0), (2, 1)], "name int, level int")
    assert {r.check: r.passed for r in Y.contract(good, 2, ["name", "level"], "name", "level").collect()} == dict.fromkeys(["row_count", "missing_columns", "extra_columns", "names_distinct", "levels"], True)
    bad = {r.check: r.passed for r in Y.contract(good.unionByName(good), 3, ["name", "x"], "name", "level").collect()}
    assert not any(bad[c] for c in ("row_count", "missing_columns", "extra_columns", "names_distinct"))
    assert Y.mismatches(good, good.where("name = 1")).count() == 1


def test_tolerant_lines(spark, tmp_path):
    lines = [json.dumps({"term_ar": "نور", "top_name_attractors": [["a", 0.5], ["b", 0.25]], "estimated_position": {"px": 0.1, "py": 0.2, "r": 0.3, "level": 1, "level_label": "x"}}, ensure_ascii=False), "{broken", "", json.dumps({"term_ar": "روح"})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines), encoding="utf-8")
    good, rejected = files.read_lines(spark, str(tmp_path / "log.jsonl"))
    got = {r.term_ar: r for r in good.collect()}
    assert set(got) == {"نور", "روح"} and got["نور"].top_name_attractors[1].sim == 0.25 and got["روح"].estimated_position is None
    assert [r.raw for r in rejected.collect()] == ["{broken"]


def test_nodes_documents_checksum_tables(spark, tmp_path):
    (tmp_path / "disk.json").write_text(json.dumps({"nodes": [{"ar": "a", "px": 0.1, "py": 0.2, "r": 0.3, "level": 1}], "meta": {"n": 1}}))
    assert files.read_nodes(spark, str(tmp_path / "disk.json")).first().px == 0.1
    (tmp_path / "a.txt").write_text("x\ny")
    assert files.read_documents(spark, str(tmp_path / "a.txt")).first().text == "x\ny"
    assert len(files.checksum(spark, str(tmp_path / "a.txt")).first().sha256) == 64
    df = spark.range(3)
    for kind in ("parquet", "orc", "json"):
        df.write.format(kind).save(str(tmp_path / f"t.{kind}"))
        assert files.read_table(spark, str(tmp_path / f"t.{kind}")).count() == 3
    files.write_lines(df, str(tmp_path / "lines"))
    with pytest.raises(Exception):
        files.write_lines(df, str(tmp_path / "lines"))


def test_stream_appends_unseen_once(spark, tmp_path):
    schema = "log_id long, term_ar string, term_undiacritized string"
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([(1, "نُور", None), (2, "نور", "نور"), (3, None, None)], schema).coalesce(1).write.parquet(source)
    stream.append_unseen(spark, source, target, state, schema).awaitTermination()
    spark.createDataFrame([(4, "نور", "نور"), (5, "روح", "روح")], schema).coalesce(1).write.mode("append").parquet(source)
    stream.append_unseen(spark, source, target, state, schema).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(target).select(stream.KEY).collect()) == ["روح", "نور"]


def test_ranks_and_spearman(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 400), rng.integers(0, 30, 400)
    df = spark.createDataFrame([(int(x), int(y + x)) for x, y in zip(a, b)] + [(None, 1), (2, None)], "a int, b int")
    import pandas as pd

    want = pd.DataFrame({"a": a, "b": a + b}).corr(method=lambda x, y: np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]).iloc[0, 1]
    got = S.spearman(df, "a", "b").first()
    assert got.n == 400 and abs(got.rho - want) < 1e-9
    assert S.spearman(df.where("false"), "a", "b").first().n == 0


def test_p_values():
    assert abs(S.spearman_p(0.5, 20) - 0.0248) < 2e-4
    assert S.spearman_p(0.0, 30) == pytest.approx(1.0) and S.spearman_p(None, 9) is None and S.spearman_p(1.0, 9) == 0.0


def test_partial_needs_rows(spark):
    r = S.partial_spearman(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), "a", "b", ["c"]).first()
    assert r.rho is None and r.error == "insufficient data"


def test_mann_whitney(spark):
    a, b = (spark.createDataFrame([(float(x),) for x in v], "v double") for v in ([5, 6, 7, 8, 8], [1, 2, 3, 5, 5]))
    r = S.mann_whitney_greater(a, b, "v").first()
    assert r.u == 24.0 and 0.0 < r.p < 0.02
    assert S.mann_whitney_greater(a.limit(2), b, "v").first().p == 1.0


def test_pairwise_is_blockwise(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 7)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(1, k, [float(x) for x in row]) for k, row in enumerate(v)], "g int, k int, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = (u @ u.T)[np.triu_indices(40, 1)]
    r = S.pairwise(df, "g", "k", "v").first()
    assert r.pairs == 780 and np.allclose([r["mean"], r["std"], r["min"], r["max"]], [s.mean(), s.std(), s.min(), s.max()])


def test_permutation_null_against_brute_force(spark):
    words = ["نور", "روح", "قلب", "علم", "حكم", "شمس", "قمر", "بحر"]
    rng = np.random.default_rng(5)
    rows = [(words[i], words[j], float(rng.random())) for i in range(8) for j in range(8) if i != j]
    maps = S.permuted_mappings(3)
    got = {r.perm: r.rho for r in S.permutation_null(spark.createDataFrame(rows, "word_i string, word_j string, mean_attention double"), maps, block=2).collect()}
    import pandas as pd

    for k, m in enumerate(maps):
        d = pd.DataFrame({"d": [abs(sum(m[c] for c in a) - sum(m[c] for c in b)) for a, b, _ in rows], "o": [r[2] for r in rows]}).rank()
        assert abs(got[k] - d.corr().iloc[0, 1]) < 1e-9


def test_lift_windows(spark):
    tokens = ["a", "b"] * 31  # 62 tokens: windows at 0 and 20, the one at 40 is incomplete
    df = spark.createDataFrame([(tokens,), (["a"] * 40,), ([],), (None,)], "t array<string>")
    r = S.lift(df, F.col("t"), spark.createDataFrame([("a",), ("b",)], "word string")).collect()
    assert len(r) == 1 and r[0].n == 2 and math.isclose(r[0].lift, 1.0, rel_tol=1e-6)


def test_retrieval_edges(spark):
    p = spark.createDataFrame([("1", "نور على نور"), ("2", ""), ("3", None)], "id string, text string")
    q = spark.createDataFrame([(1, "نور"), (2, ""), (3, None)], "query int, text string")
    assert [(r.query, r.id) for r in R.bm25(p, q).collect()] == [(1, "1")]
    assert [(r.query, r.id) for r in R.tfidf(p, q).collect()] == [(1, "1")]
    assert R.bm25(p.where("false"), q).count() == 0
    assert "نور" in R.report(R.explained(R.bm25(p, q), p, q), "نور")


def test_partial_null_against_brute_force(spark):
    """Distances and outcome both follow the position here, so the raw correlation is another number; either path gives the same."""
    rng = np.random.default_rng(4)
    letters = list(S.ABJAD_BASE)
    rows = []
    for _ in range(120):
        x = int(rng.integers(1, 12))
        i, j = letters[int(rng.integers(28))], "".join(str(c) for c in rng.choice(letters, x))
        rows.append((i, j, float(x + rng.integers(0, 4)), x, float(rng.choice([0.0, 1.5, 3.0]))))
    rows += rows[:15] + [("ا", None, 1.0, 1, 0.0)]
    df = spark.createDataFrame(rows, "word_i string, word_j string, mean_attention double, pos_distance int, cooc double")
    maps = S.permuted_mappings(4)
    known = [r for r in rows if r[1]]
    x = np.array([[1, r[3], r[4]] for r in known], dtype=float)
    left = lambda t: np.round(t - x @ np.linalg.lstsq(x, t, rcond=None)[0], 9)
    rank = lambda v: pd.Series(v).rank().to_numpy()
    o = np.array([r[2] for r in known])
    for most in (1000, 0):
        got = {r.perm: r.rho for r in S.partial_null(df, maps, ["pos_distance", "cooc"], most=most, block=3).collect()}
        assert sorted(got) == [0, 1, 2, 3]
        for k, m in enumerate(maps):
            d = np.array([abs(sum(m[c] for c in r[0]) - sum(m[c] for c in r[1])) for r in known], dtype=float)
            assert got[k] == pytest.approx(np.corrcoef(rank(left(d)), rank(left(o)))[0, 1], abs=1e-6)
            assert abs(got[k] - np.corrcoef(rank(d), rank(o))[0, 1]) > 0.01
    assert [r.rho for r in S.partial_null(df.limit(9), maps[:1], ["pos_distance", "cooc"]).collect()] == [None]


def test_ranked_rho_against_brute_force():
    """Weighted ranks of values with ties and with neighbours that the sorted integers can't tell apart."""
    rng = np.random.default_rng(8)
    for values in (rng.integers(0, 30, 500) / 7, np.concatenate([[-1e9, 1e9], 1 + rng.integers(0, 9, 498) * 1e-12]), rng.normal(size=500), np.ones(500)):
        c, o = rng.integers(1, 4, 500), rng.normal(size=500)
        every = pd.DataFrame({"r": np.repeat(values, c), "o": np.repeat(o, c), "k": np.repeat(np.arange(500), c)})
        ranks = every[["r", "o"]].rank()
        cs = np.column_stack([c.astype(float), ranks.o.groupby(every.k).sum()])
        got = S._ranked_rho(values.copy(), cs, float((ranks.o**2).sum()), np.empty(500), np.empty(500, dtype=np.int64), np.arange(500, dtype=np.int32), np.empty(500, dtype=complex))
        want = ranks.corr().iloc[0, 1] if len(set(values)) > 1 else None
        assert got == (None if want is None else pytest.approx(want, abs=1e-12))


def test_partial_null_folds_once(spark, monkeypatch):
    """Blocks of shared and own controls and the path by shuffles give the same, from one folding for any number of runs."""
    rng = np.random.default_rng(6)
    letters = list("ابجدهوز")
    rows = [("".join(rng.choice(letters, 3)), "".join(rng.choice(letters, 3)), float(rng.normal()), int(k % 3), float(rng.uniform()) if k % 4 == 0 else 0.0) for k in range(400)]
    df = spark.createDataFrame(rows, "word_i string, word_j string, mean_attention double, pos_distance int, cooc double")
    controls, maps = ["pos_distance", "cooc"], S.permuted_mappings(3)
    monkeypatch.setattr(S, "SHARED", 20)
    folded = S.FoldedPairs(df, controls)
    monkeypatch.setattr(S, "average_ranks", None)  # nothing is ranked again
    got = {r.perm: r.rho for r in S.partial_null(df, maps, controls, folded=folded).collect()}
    assert len(S.partial_null(df, maps, controls, folded=folded).inputFiles()) == 3  # as many tasks as permutations, not one
    values = folded.blocks()[1]
    other = {r.perm: r.rho for r in S.partial_null(df, maps, controls, most=0, folded=folded).collect()}
    assert len(values) == 3 and not values[:, 1].any() and sorted(got) == [0, 1, 2]
    assert all(got[k] == pytest.approx(other[k], abs=1e-12) for k in got)


def test_scramble_draws_positions(spark):
    df = spark.range(200).selectExpr("id as pair_id", "'w' as word_i", "'v' as word_j", "0.5 as mean_attention", "cast(if(id = 0, 9, 1) as int) as pos_distance")
    drawn = {r.pos_distance for r in S.scrambled(df).collect()}
    assert drawn == set(range(1, 10))


def test_nulls_are_of_the_references_size():
    from lumenfield.plans import stats_queries as Q

    assert Q.DRAWS == 1000 and Q.CONTROLS == ["pos_distance", "cooc"]


def test_scrambled_keeps_every_row(spark):
    df = spark.createDataFrame([(k, f"a{k}", f"b{k}", 0.1, 1) for k in range(20)], "pair_id long, word_i string, word_j string, mean_attention double, pos_distance int")
    rows = S.scrambled(df).collect()
    assert len(rows) == 20 and {r.word_j for r in rows} == {f"b{k}" for k in range(20)} and all(r.word_i[1:] != r.word_j[1:] for r in rows)


def test_resume_trusts_only_its_own_run(spark, tmp_path):
    rng = np.random.default_rng(5)
    letters = "ابجدهوز"
    rows = [("".join(rng.choice(list(letters), 3)), "".join(rng.choice(list(letters), 3)), float(rng.normal()), int(k % 7), float(rng.uniform())) for k in range(120)]
    pairs = spark.createDataFrame(rows, "word_i string, word_j string, mean_attention double, pos_distance int, cooc double")
    at = str(tmp_path / "nulls")
    controls = ["pos_distance", "cooc"]
    first = S.permuted_mappings(4, seed=1)
    S.resumed(at, first[:2], pairs, controls)
    whole = {r.perm: r.rho for r in S.resumed(at, first, pairs, controls).collect()}
    other = {r.perm: r.rho for r in S.resumed(at, S.permuted_mappings(4, seed=2), pairs, controls).collect()}
    again = {r.perm: r.rho for r in S.resumed(at, first, pairs, controls).collect()}
    fewer = {r.perm: r.rho for r in S.resumed(at, first, pairs.limit(100), controls).collect()}
    assert set(whole) == set(other) == set(fewer) == {0, 1, 2, 3} and whole == again and other != whole and fewer != whole


def test_attention_pool(spark):
    w = spark.createDataFrame([(1, 0, 0, 0, 1, 0.2), (1, 0, 1, 0, 1, 0.4), (1, 0, 0, 1, 0, 0.6), (1, 0, 0, 2, 2, 0.9), (1, 0, 0, 2, 0, None), (2, 0, 0, 5, 3, 0.5)], "sentence int, layer int, head int, i int, j int, weight double")
    got = {(r.sentence, r.i, r.j): round(r.attention, 9) for r in S.attention_pool(w).collect()}
    assert got == {(1, 0, 1): 0.45, (2, 3, 5): 0.5}
    assert S.attention_pool(w.where("false")).count() == 0


def test_pairwise_counts_against_values(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 4))
    df = spark.createDataFrame([(k % 2, k, [float(x) for x in v[k]]) for k in range(40)], "g int, id int, vec array<double>")
    values = np.array([-0.3, 0.0, 0.5])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for r in S.pairwise(df, "g", "id", "vec", {None: values}).collect():
        own = u[r.g :: 2]
        s = (own @ own.T)[np.triu_indices(len(own), 1)]
        assert r.pairs == len(s) and r.u == (s[:, None] > values[None]).sum()


def test_density_edges(spark):
    schema = "family int, id int, vec array<double>, u double"
    empty = S.density(spark.createDataFrame([], schema), "family", "id", "vec")
    assert (empty["families"], empty["intra_pairs"], empty["gap"], empty["p"]) == (0, 0, None, 1.0)
    one = S.density(spark.createDataFrame([(1, 1, [1.0, 0.0], 0.0), (1, 2, [0.0, 1.0], 0.0)], schema), "family", "id", "vec")
    assert one["intra_pairs"] == 1 and one["cross_pairs"] == 0 and one["gap"] is None
    rows = [(f, k, [float(f == 1), float(f == 2), 0.1 * k], 0.0) for f in (1, 2) for k in range(4)] + [(1, 9, None, 0.0), (None, 8, [1.0, 1.0, 1.0], 0.0)]
    both = S.density(spark.createDataFrame(rows, schema), "family", "id", "vec")
    assert both["families"] == 2 and both["gap"] > 0 and both["significant"] and round(both["coverage_pct"], 3) == 88.889


def test_ranks_and_reports_of_nothing(spark):
    g = spark.createDataFrame([], "key long, vec array<double>, sim double")
    v = spark.createDataFrame([([1.0, 0.0],)], "vec array<double>")
    assert S.ranks_among(g, v).count() == 0
    p = spark.createDataFrame([], "id string, text string")
    q = spark.createDataFrame([(1, "نور")], "query int, text string")
    assert R.reported(R.explained(R.tfidf(p, q), p, q)).count() == 0


def test_large_vocabularies_count_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(["a", "b", "it's", "c"] * 30,)], "t array<string>")
    words = spark.createDataFrame([("a",), ("it's",), ("c",), (None,)], "word string")
    counted = lambda: sorted((r.w1, r.w2, r.n, round(r.lift, 9)) for r in S.lift(df, F.col("t"), words).collect())
    small = counted()
    monkeypatch.setattr(S, "LISTED", 1)
    assert small == counted() and len(small) == 3


def test_written_tables_can_be_released(spark):
    from pathlib import Path

    from lumenfield.session import own_folder, release, sized, written

    t = written(spark.range(10), "ten")
    assert sized(t).count() == 10 and Path(own_folder(spark).removeprefix("file://")).exists()
    release(spark)
    assert not Path(own_folder(spark).removeprefix("file://")).exists()
    assert written(spark.range(3), "three").count() == 3


def test_lift_counts_pairs_within_tasks(spark, monkeypatch):
    """Windows and their pairs are never written; dense counts, sorted ones that overflow, and a long vocabulary give what brute force gives."""
    rng = np.random.default_rng(12)
    vocabulary = [chr(97 + k) for k in range(9)] + ["é", "𐎠", "it's"]
    texts = [[str(w) for w in rng.choice([*vocabulary, "x", "y", "z"], int(rng.integers(0, 30)))] for _ in range(60)] + [None, []]
    sets = [set(t[k : k + 8]) & set(vocabulary) for t in texts if t for k in range(0, len(t) - 8, 4)]
    single, both = Counter(w for s in sets for w in s), Counter(p for s in sets for p in combinations(sorted(s), 2))
    want = {p: (n, (n / len(sets)) / (single[p[0]] / len(sets) * (single[p[1]] / len(sets)) + 1e-10)) for p, n in both.items() if n >= 2}
    df, words = spark.createDataFrame([(t,) for t in texts], "t array<string>"), spark.createDataFrame([(w,) for w in [*vocabulary, "a", None, "unseen"]], "word string")
    names, old = [], S.written
    monkeypatch.setattr(S, "written", lambda df, name: names.append(name) or old(df, name))
    for limits in ({}, {"COUNTED": 5, "WINDOWS": 7}, {"LISTED": 1}):
        for name, value in limits.items():
            monkeypatch.setattr(S, name, value)
        if "LISTED" not in limits:
            names.clear()
        got = {(r.w1, r.w2): (r.n, r.lift) for r in S.lift(df, F.col("t"), words, window=8, step=4).collect()}
        assert ("windows" in names) == ("LISTED" in limits)
        assert got.keys() == want.keys() and all(got[p] == (want[p][0], pytest.approx(want[p][1], rel=1e-12)) for p in want)
    monkeypatch.undo()
    assert S.lift(df, F.col("t"), words.where("false")).count() == 0 and S.lift(df.where("false"), F.col("t"), words).count() == 0


def test_once_sorts_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a"), (None, "c"), (None, "c"), (3, None)], "id long, w string")
    got = S.once(df, "id")
    assert sorted((r.id or 0, r.w or "") for r in got.collect()) == [(0, "c"), (1, "a"), (2, "b"), (3, "")]
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString() and S.once(df.where("false"), "id").count() == 0


def test_rank_correlation_joins_nothing(spark):
    """Ties, negative zeros and many ranges; the rows of ranked ranges keep their other columns."""
    rng = np.random.default_rng(13)
    a = np.concatenate([rng.integers(-3, 4, 300) / 2, rng.normal(size=300)])
    b = np.concatenate([-0.0 * np.ones(50), np.zeros(50), a[100:] + rng.normal(size=500)])
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(zip(a, b))], "k long, a double, b double").repartition(5)
    ranks = pd.DataFrame({"a": a, "b": b}).rank()
    got = {r.k: r["rank"] for r in S.placed_ranks(df.select("k", "b"), "b", "rank").collect()}
    assert [got[k] for k in range(600)] == ranks.b.tolist()
    assert S.rank_correlation(df, "a", "b") == pytest.approx(ranks.corr().iloc[0, 1], abs=1e-12)
    assert S.rank_correlation(df.select(F.lit(1.0).alias("a"), "b"), "a", "b") is None


def test_held_pairs_lie_in_files():
    """What a task only reads is mapped, and the room to work in is 44 bytes a row; later permutations give what first ones give."""
    rng = np.random.default_rng(14)
    shared, ranks = np.array([[1.0, 0.0], [2.0, 0.0]]), rng.permutation(900).reshape(3, 300) + 1.0

    def blocks():
        for own in ranks:
            letters, at = rng.integers(-3, 4, (40, 28)).astype(np.int16), np.sort(rng.integers(0, 40, 300)).astype(np.int32)
            code = rng.integers(-1, 2, 300).astype(np.int32)
            x = np.column_stack([rng.integers(1, 9, (code < 0).sum()).astype(float), rng.random((code < 0).sum())])
            yield pd.DataFrame([[a.tobytes() for a in (letters, at, code, x, np.column_stack([np.ones(300), own]))]], columns=S.PACKED)

    held = S.HeldPairs(blocks(), shared, float((ranks**2).sum()))
    assert all(isinstance(a.base, np.memmap) or isinstance(a.base.base, np.memmap) for a in (held.many_at, held.code, held.many_c, held.many_s, held.own_at, held.own_cs, *held.own_x))
    values = np.array([[m[c] for m in S.permuted_mappings(3)] for c in S.ABJAD_BASE], dtype=np.float32)
    d = held.distances(values)
    first = [held.rho(x) for x in d]
    assert first == [held.rho(x) for x in d] and all(-1 < r < 1 for r in first) and held.own_cs is None
    assert held.cs.nbytes + held.both.nbytes + held.key.nbytes + held.places.nbytes == 44 * len(held.cs)
