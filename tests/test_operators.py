"""Joins, series, metrics and splits against numpy and literal cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkline import models
from larkline.functions import arrays, text
from larkline.operators import joins, metrics, retrieval, splits, timeseries, turns


def test_interpolation_and_nearest(spark):
    rng = np.random.default_rng(0)
    t, y = np.sort(rng.random(40)) * 10, rng.random(40)
    g = np.linspace(-1, 12, 60)
    s = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(t, y, strict=True)], "k string, t double, y double")
    got = {r.t: r.y for r in joins.interpolate(spark.createDataFrame([("k", float(x)) for x in g], "k string, t double"), s, ["k"], "t", ["y"]).collect()}
    assert np.allclose([got[x] for x in g], np.interp(g, t, y))
    near = joins.asof_nearest(spark.createDataFrame([("k", 1.0)], "k string, t double"), spark.createDataFrame([("k", 0.0, "a"), ("k", 2.0, "b")], "k string, t double, y string"), ["k"], "t", ["y"])
    assert near.first().y == "a"  # a tie goes back


def test_overlap_join_has_each_pair_once(spark):
    rng = np.random.default_rng(1)
    a = [(1, i, int(x), int(x + w)) for i, (x, w) in enumerate(zip(rng.integers(0, 500, 60), rng.integers(1, 90, 60), strict=True))]
    b = [(1, i, int(x), int(x + w)) for i, (x, w) in enumerate(zip(rng.integers(0, 500, 60), rng.integers(1, 90, 60), strict=True))]
    got = joins.overlap_join(spark.createDataFrame(a, "k int, i int, lo int, hi int"), spark.createDataFrame(b, "k int, j int, slo int, shi int"), ["k"], ("lo", "hi"), ("slo", "shi"), 40)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((x[1], y[1]) for x in a for y in b if y[3] > x[2] and y[2] < x[3])


def test_band_match_falls_through(spark):
    left = spark.createDataFrame([("s", 1, 1000, 2000), ("s", 2, 5000, 6000)], "k string, i int, lo int, hi int")
    right = spark.createDataFrame([("s", 1, 1101, 2000, 0), ("s", 9, 1100, 1900, 1), ("s", 2, 5000, 6000, 3), ("s", 7, 5001, 6001, 2)], "k string, j int, rlo int, rhi int, pos int")
    got = joins.band_match(left, right, ["k"], "i", ("i", "j"), ("lo", "hi"), ("rlo", "rhi"), "pos")
    assert sorted((r.i, r.j) for r in got.collect()) == [(1, 9), (2, 2)]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 3000), st.integers(1, 16))
def test_bin_formula(n, k):
    edges = np.linspace(0, n, k + 1).astype(int)
    rows = np.arange(n)
    want = np.searchsorted(edges, rows, side="right") - 1
    assert (((rows + 1) * k - 1) // n == np.minimum(want, k - 1)).all()


def test_downsample_positions(spark):
    for n in (50, 100, 101, 257, 600):
        df = spark.range(n).withColumn("k", F.lit(1))
        got = sorted(r.id for r in timeseries.downsample(df, ["k"], [F.col("id")], 100).collect())
        want = sorted(set(np.linspace(0, n - 1, 100).astype(int).tolist())) if n > 100 else list(range(n))
        assert got == want


def test_early_stop(spark):
    df = spark.createDataFrame([([3.0, 2.0, 1.99995, 2.5, 2.5, 2.5, 2.5, 1.0],)], "x array<double>")
    s = df.select(timeseries.early_stop(F.col("x")).alias("s")).first().s
    assert (s.best, s.at, s.stop) == (2.0, 1, 6)


def test_array_series(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],)], "x array<double>")
    r = df.select(timeseries.pad_zero(F.col("x"), 4).alias("a"), timeseries.patches(F.col("x"), 4).alias("b"), timeseries.zscore_array(F.col("x"), 0, "clamp", 1e-6).alias("z"), arrays.unit(F.col("x")).alias("u"), arrays.softmax(F.col("x")).alias("s")).first()
    x = np.arange(1.0, 6)
    assert r.a == [1, 2, 3, 4, 5, 0, 0, 0] and r.b is None
    assert np.allclose(r.z, (x - x.mean()) / x.std()) and np.allclose(r.u, x / np.linalg.norm(x)) and np.allclose(r.s, np.exp(x) / np.exp(x).sum())


def test_speaker_turns_skip_blanks(spark):
    rows = [(1, 0, "Client", 0, 1, "a"), (1, 1, "client ", 1, 2, "b"), (1, 2, "x", 2, 3, " "), (1, 3, "client", 3, 9, "c"), (1, 4, "therapist", 4, 5, "d")]
    df = spark.createDataFrame(rows, "s int, pos int, sp string, lo int, hi int, t string")
    got = [(r.turn_index, r.speaker, r.start, r.end, r.text) for r in turns.merge_speakers(df, "s", [F.col("pos")], "sp", "lo", "hi", "t").orderBy("turn_index").collect()]
    assert got == [(0, "client", 0, 9, "a b c"), (1, "therapist", 4, 5, "d")]


def test_balanced_batches(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("a" * 10 + "b" * 4 + "c" * 6)], "i int, c string")
    got = splits.balanced_batches(df, "c", "i", 2).groupBy("batch", "c").count().collect()
    assert {(r.batch, r.c): r["count"] for r in got} == {(b, c): 2 for b in (0, 1) for c in "abc"}


@pytest.mark.parametrize(("pred", "want"), [(["a", "b", "c", "d"], 100.0), (["a", "b", "c", "x"], 75.0), (["A", "B", "C", "D"], 0.0)])
def test_accuracy_cases(spark, pred, want):
    df = spark.createDataFrame(list(zip("abcd", pred, strict=True)), "g string, p string")
    assert models.evaluate(df, "exact", "g", "p").first().score == want


def test_class_sets(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "z"), ("b", "a"), ("q", "a"), (None, "a")], "g string, p string")
    open_set = {r["class"]: (r.tp, r.fp, r.fn) for r in metrics.class_counts(df, "g", "p").collect()}
    assert open_set == {"a": (1, 2, 1), "b": (0, 0, 1), "q": (0, 0, 1), "z": (0, 1, 0)}
    seeded = {r["class"]: (r.tp, r.fp, r.fn) for r in metrics.class_counts(df, "g", "p", labels=["a", "b", "c"], skip_unknown_gold=True).collect()}
    assert seeded == {"a": (1, 1, 1), "b": (0, 0, 1), "c": (0, 0, 0)}


def test_auc_and_regression(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert metrics.roc_auc(df, "s", "y").first().auc == 0.75
    r = metrics.regression(spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "y double, x double"), "y", "x").first()
    assert r.r == 0.0 and r.mse == pytest.approx(2 / 3)


def test_text(spark):
    rows = [("why. Answer: N2<eos>", "the cat sat", "a cat sat down"), ("walking", "", ""), ("Answer: Answer: Stage 4.", "x x", "x")]
    df = spark.createDataFrame(rows, "t string, a string, b string")
    got = df.select(text.answer("t").alias("x"), text.sleep_stage(text.answer("t")).alias("s"), text.token_f1(F.col("a"), F.col("b")).alias("f")).collect()
    assert [(r.x, r.s) for r in got] == [("N2", "non-rem stage 2"), ("walking", "walking"), ("Stage 4", "non-rem stage 3")]
    assert [round(r.f, 4) for r in got] == [round(4 / 7, 4), 1.0, round(2 / 3, 4)]
    packed = spark.createDataFrame([("One two three. Four five. Six. " + "w " * 9,)], "t string").select(text.pack_sentences("t", 4).alias("c"), text.wrap("t", 12).alias("w")).first()
    assert packed.c == ["One two three.", "Four five. Six.", "w w w w", "w w w w", "w"]
    assert max(map(len, packed.w.split("\n"))) <= 12
    assert spark.createDataFrame([([1.5, -0.25, float("nan")],)], "x array<double>").select(arrays.digits("x")).first()[0] == "1 5 0 0, -2 5 0, NaN, "
    assert spark.createDataFrame([("The two, cats!",)], "x string").select(text.normal_answer("x")).first()[0] == "2 cats"


def test_top_k(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(200, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id long, v array<double>").repartition(5)
    got = retrieval.top_k(df, df.filter("id % 50 = 0"), "id", "v", 3).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 50, 100, 150):
        s = u @ u[q]
        s[q] = -9
        assert [r.neighbour for r in sorted((r for r in got if r.query == q), key=lambda r: r["rank"])] == np.lexsort((np.arange(200), -np.round(s, 9)))[:3].tolist()


def test_ridge_leave_one_group_out(spark):
    rng = np.random.default_rng(5)
    x, g = rng.normal(size=(80, 3)), rng.integers(0, 4, 80)
    y = x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.1, 80)
    df = spark.createDataFrame([(str(a), *map(float, b), float(c)) for a, b, c in zip(g, x, y, strict=True)], "g string, a double, b double, c double, y double")
    got = {r.g: r.mse for r in models.ridge_by_group(df, "g", ["a", "b", "c"], "y").collect()}
    for k in range(4):
        tr, te = g != k, g == k
        m, s = x[tr].mean(0), x[tr].std(0)
        z = (x[tr] - m) / s
        w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y[tr] - y[tr].mean()))
        assert got[str(k)] == pytest.approx(np.mean((y[te] - ((x[te] - m) / s @ w + y[tr].mean())) ** 2))


def test_assignment_against_all_permutations(spark):
    import itertools
    import random

    from larkline.operators import joins

    rnd = random.Random(1)
    ms = [[[rnd.randint(-3, 9) / 3 for _ in range(k)] for _ in range(n)] for n, k in [(rnd.randint(1, 5), rnd.randint(1, 5)) for _ in range(40)]]
    df = spark.createDataFrame([*enumerate(ms), (100, None), (101, []), (102, [[1.0], [1.0, 2.0]]), (103, [[0.1]])], "id long, m array<array<double>>")
    got = {}
    for r in joins.assign(df, "id", "m", -99.0).collect():
        got.setdefault(r.id, []).append((r.i, r.j, r.score))
    assert set(got) == {*range(40), 103}
    for i, m in enumerate(ms):
        wide = m if len(m) <= len(m[0]) else [list(x) for x in zip(*m, strict=True)]
        best = max(sum(wide[a][b] for a, b in enumerate(p)) for p in itertools.permutations(range(len(wide[0])), len(wide)))
        assert abs(sum(s for _, _, s in got[i]) - best) < 1e-9
        assert len({a for a, _, _ in got[i]}) == len({b for _, b, _ in got[i]}) == len(got[i]) == len(wide)
    assert joins.assign(df.filter("id = 103"), "id", "m", 0.5).count() == 0


def test_registries_fit(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from larkline import models

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    rows = [(Vectors.dense(a), float(2 * a[0] - a[1] + 0.3 * rng.normal()), float(a[0] + a[1] > 0)) for a in x]
    df = spark.createDataFrame(rows, ["features", "y", "kind"])
    y = np.array([r[1] for r in rows])
    z = (x - x.mean(0)) / x.std(0, ddof=1)  # the scaler divides by the sample deviation
    for a in (0.1, 10.0):
        want = np.linalg.solve(z.T @ z + a * np.eye(2), z.T @ (y - y.mean()))
        got = models.regressors(200, float(y.std(ddof=1)), label="y")[f"Ridge(a={a:g})"].fit(df).stages[-1]
        assert np.allclose(got.coefficients.toArray(), want, rtol=0.02)
    logistic = models.classifiers(200, label="kind")["LogReg(C=10)"].fit(df).transform(df)
    assert logistic.selectExpr("avg(cast(prediction = kind as int)) a").first().a > 0.95
    assert set(models.regressors(9)) == {"Ridge(a=0.1)", "Ridge(a=1)", "Ridge(a=10)", "Lasso(a=0.1)", "RF(100)", "GBR(100)"} and len(models.classifiers(9)) == 6


def test_hot_groups_are_ranked_in_order(spark):
    from pyspark.sql import functions as F

    from larkline.operators import splits

    df = spark.range(3000).withColumn("l", F.when(F.col("id") % 10 == 0, "rare").otherwise("hot")).withColumn("_n", F.lit("x"))
    got = splits.stratified_split(df.drop("_n"), "l", "id").groupBy("l", "split").count().collect()
    assert {(r.l, r.split): r["count"] for r in got} == {("hot", "test"): 270, ("hot", "val"): 135, ("hot", "train"): 2295, ("rare", "test"): 30, ("rare", "val"): 15, ("rare", "train"): 255}
    parts = {r.part: r["count"] for r in splits.fraction_split(spark.range(10), "id", 0.05).groupBy("part").count().collect()}
    assert parts == {"a": 1, "b": 9}
    assert splits.stratified_split(df.limit(0), "l", "id").count() == 0 and splits.balanced_batches(df.limit(0), "l", "id", 2).count() == 0


def test_nearest_over_several_blocks(spark, monkeypatch):
    import numpy as np

    from larkline.operators import retrieval

    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None)], "id long, v array<double>")
    one = {(r.query, r["rank"]): r.neighbour for r in retrieval.top_k(df, df.filter("id < 20"), "id", "v", 3).collect()}
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    assert {(r.query, r["rank"]): r.neighbour for r in retrieval.top_k(df, df.filter("id < 20"), "id", "v", 3).collect()} == one
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u[:20] @ u.T
    c[np.arange(20), np.arange(20)] = -9
    assert one == {(q, k + 1): int(np.argsort(-c[q])[k]) for q in range(20) for k in range(3)}
    assert retrieval.top_k(df, df.limit(0), "id", "v", 3).count() == 0
