"""Solvers, projections, bootstraps and accumulators against numpy and their own conditions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import resample, solve


def system(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    m = np.diag(rng.random(n) + 0.5)
    for _ in range(3 * n):
        i, j = rng.integers(0, n, 2)
        v = rng.random()
        m[[i, j, i, j], [i, j, j, i]] += [v, v, -v, -v] if i != j else [0] * 4
    b = rng.normal(size=n)
    rows = [(int(i), int(j), float(m[i, j]) / 2) for i, j in zip(*np.nonzero(m)) for _ in range(2)]  # entries add up
    return m, b, spark.createDataFrame(rows, "i long, j long, a double"), spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)], "i long, b double")


def test_conjugate_gradients(spark):
    m, b, matrix, rhs = system(spark, 8)
    x = np.array([r.x for r in sorted(solve.conjugate_gradients(matrix, rhs).collect())])
    assert np.abs(m @ x - b).max() < 1e-8 and np.allclose(x, np.linalg.solve(m, b))
    start = spark.createDataFrame([(i, float(v), i % 4 != 0) for i, v in enumerate(x + 1)], "i long, x double, open boolean")
    warm = np.array([r.x for r in sorted(solve.conjugate_gradients(matrix, rhs, start, F.col("open")).collect())])
    held = np.arange(8) % 4 == 0
    assert np.array_equal(warm[held], (x + 1)[held]) and np.abs((m @ warm - b)[~held]).max() < 1e-8
    zero = solve.conjugate_gradients(matrix, rhs.withColumn("b", F.lit(0.0)))
    assert {r.x for r in zero.collect()} == {0.0}


def test_bounds_hold_and_the_gradient_agrees(spark):
    m, b, matrix, rhs = system(spark, 6, 3)
    found = sorted(solve.bounded_solve(matrix, rhs, F.lit(-0.1), F.when(F.col("i") != 2, 0.15)).collect())
    x, g = np.array([r.x for r in found]), None
    g = m @ x - b
    top = np.where(np.arange(6) == 2, np.inf, 0.15)
    assert (x >= -0.1 - 1e-12).all() and (x <= top + 1e-12).all() and any(r.held for r in found)
    for i in range(6):
        assert abs(g[i]) < 1e-7 or (x[i] == -0.1 and g[i] > 0) or (x[i] == top[i] and g[i] < 0)


def test_projection_is_feasible_and_nearest():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 8, 15):
        x = np.cumsum(rng.integers(1, 4, n)).astype(float)
        t, w = rng.normal(size=n) * 3, rng.random(n) + 0.2
        lo, hi = np.full(n, -2.0), np.full(n, 2.5)
        y = solve.project(x, t, w, lo, hi, -0.2, np.full(n, 0.8))
        slope = np.diff(y) / np.diff(x)
        assert (y >= lo - 1e-9).all() and (y <= hi + 1e-9).all() and (slope >= -0.2 - 1e-9).all() and (slope <= 0.8 + 1e-9).all()
        # nearest: no feasible curve lies on the other side of the plane through y
        for _ in range(200):
            z = solve.project(x, y + rng.normal(size=n), np.ones(n), lo, hi, -0.2, np.full(n, 0.8))
            assert (w * (t - y)) @ (z - y) < 1e-6
        assert np.allclose(solve.project(x, y, w, lo, hi, -0.2, np.full(n, 0.8)), y)  # what is inside stays
    assert np.isnan(solve.project(np.array([0.0, 1.0]), np.zeros(2), np.ones(2), np.array([0.0, 5.0]), np.array([0.0, 5.0]), 0, np.ones(2))).all()


def test_curves_of_a_table(spark):
    rows = [("a", x, float(x % 3), 1.0) for x in range(10) for _ in range(2)] + [("b", 1, 4.0, 2.0), ("b", None, 1.0, 1.0), (None, 1, 1.0, 1.0), ("c", 1, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x int, y double, w double")
    got = {(r.k, r.x): r for r in solve.project_curves(df, "k", "x", F.col("y"), F.col("w"), F.lit(None), F.lit(None), 0.0, 9.0).collect()}
    values = [got["a", float(x)].value for x in range(10)]
    assert len(got) == 11 and got["b", 1.0].value == 4 and got["a", 3.0].mass == 2
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:])) and sum(values) == pytest.approx(sum(x % 3 for x in range(10)))


def test_bootstrap_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(5, 2, 600)
    df = spark.createDataFrame([(None if i % 50 == 0 else "ab"[i % 2], i, float(x)) for i, x in enumerate(v)], "k string, id long, v double")
    one, many = (sorted(map(repr, resample.bootstrap(df.repartition(n), "k", "id", F.round("v", 3)).select("k", "replicate", "n", F.round("mean", 9)).collect())) for n in (1, 7))
    assert one == many
    got = {r.k: (r.low, r.high) for r in resample.intervals(resample.bootstrap(df, "k", "id", F.col("v"), replicates=1000), "k").collect()}
    for k, start in (("a", 0), ("b", 1)):
        own = np.array([x for i, x in enumerate(v) if i % 2 == start and i % 50])
        exact = own[rng.integers(0, len(own), (4000, len(own)))].mean(axis=1)
        assert got[k] == pytest.approx(tuple(np.quantile(exact, [0.025, 0.975])), abs=0.06)


def test_draws_are_poisson():
    times = np.searchsorted(resample.poisson_steps(), resample.draws(np.arange(2000)[:, None], np.arange(100)[None, :]), side="right")
    assert times.mean() == pytest.approx(1, abs=0.02) and times.var() == pytest.approx(1, abs=0.03)
    assert abs(np.corrcoef(times[:, 0], times[:, 1])[0, 1]) < 0.08 and abs(np.corrcoef(times[0], times[1])[0, 1]) < 0.3


def test_splits_merge_to_one_pass(spark):
    rows = [("r", i % 4, "m" + str(i % 3), None if i % 7 == 0 else float(i % 5), None if i % 11 == 0 else 2.0) for i in range(90)] + [("r", 1, "only omitted", None, 1.0)]
    df = spark.createDataFrame(rows, "run string, part int, metric string, got double, want double")
    whole = resample.report(resample.partial_errors(df, ["run"], "metric", F.col("got"), F.col("want")), ["run"])
    split = resample.partial_errors(df, ["run", "part"], "metric", F.col("got"), F.col("want"))
    twice = resample.merge(resample.merge(split.where("part < 2"), ["run"]).unionByName(resample.merge(split.where("part >= 2"), ["run"])), ["run"])
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, resample.report(twice, ["run"]).collect()))
    lines = {r.metric: r for r in whole.collect()}
    assert lines["only omitted"].mae is None and lines["only omitted"].omit == 1 and lines["m0"].low is False
    saved = split.where("part < 2")
    assert sorted(map(repr, resample.resumed(saved, split, "part", ["run"]).collect())) == sorted(map(repr, split.collect()))


def test_low_marks_and_gaps(spark):
    rows = [("r", "few", 1.0, 0.0)] * 19 + [("r", "enough", 3.0, 0.0)] * 20
    state = resample.partial_errors(spark.createDataFrame(rows, "run string, metric string, got double, want double"), ["run"], "metric", F.col("got"), F.col("want"))
    assert {r.metric: r.low for r in resample.report(state, ["run"]).collect()} == {"few": True, "enough": False}
    (g,) = resample.gaps(state, ["run"], F.lit(10.0)).collect()
    assert g.gap == pytest.approx(100 * (0.1 + 0.3) / 2) and g.weighted_gap == pytest.approx(100 * (19 * 0.1 + 20 * 0.3) / 39)
    (g,) = resample.gaps(state, ["run"], F.lit(10.0), F.lit(4), F.lit(51.0)).collect()
    assert g.gap == pytest.approx(100 * (0.4 + 0.05) / 3)
