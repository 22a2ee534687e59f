"""Ranks spread over ranges, against numpy, with a hot key, null keys, ties and zero weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import fits, matching, measures, ranks, records, stats

SCHEMA = "k string, v double, w double"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    keys = ["hot"] * 4 + ["b", None, "zero"]
    out = []
    for _ in range(900):
        k = keys[rng.integers(0, len(keys))]
        w = 0.0 if k == "zero" else None if rng.random() < 0.03 else float(rng.integers(0, 5))
        out.append((k, None if rng.random() < 0.03 else float(rng.integers(-20, 20)) / 4, w))
    return [*out, ("one", 7.5, 2.0), ("none", None, 1.0)]


@pytest.fixture(params=[1, 8])
def table(spark, rows, request):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


def by_key(rows):
    out = {}
    for k, v, w in rows:
        if v is not None:
            out.setdefault(k, []).append((v, w or 0.0))
    return {k: sorted(x) for k, x in out.items()}


def test_interpolated_quantiles(table, rows):
    qs = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    got = {r[0]: list(r[1:]) for r in ranks.interpolated_quantiles(table, "k", "v", F.col("w"), qs).collect()}
    want = {}
    for k, x in by_key(rows).items():
        v, w = (np.array(c) for c in zip(*x))
        c = np.cumsum(w if w.sum() > 0 else np.ones(len(w)))
        # numpy takes the last of equal shares, rows without weight carry the value on; the first that reaches a share is meant
        i = [int(np.searchsorted(c, q * c[-1] * (1 - 1e-15), side="left")) for q in qs]
        own = w if w.sum() > 0 else np.ones(len(w))
        want[k] = [v[j] if j == 0 or own[j] == 0 else v[j - 1] + (v[j] - v[j - 1]) * (q * c[-1] - c[j - 1]) / own[j] for j, q in zip(i, qs)]
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9), k


def test_interpolation_is_numpys_without_ties(spark):
    rng = np.random.default_rng(1)
    v, w = rng.permutation(500) / 7, rng.random(500) + 0.1
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(v, w)], SCHEMA)
    o = np.argsort(v)
    qs = [0.0, 0.01, 0.2, 0.5, 0.77, 1.0]
    (r,) = ranks.interpolated_quantiles(df, "k", "v", F.col("w"), qs).collect()
    assert list(r[1:]) == pytest.approx(np.interp(qs, np.cumsum(w[o]) / w.sum(), v[o]))


def test_running_sums_and_last(table, rows):
    df = table.where("v IS NOT NULL").groupBy("k", "v").agg(F.sum("w").alias("w"))
    got = {(r.k, r.v): (r.w_below, r.w_all, r.last_before) for r in ranks.running(df, ["k"], ["v"], {"w": "w"}, last="v").collect()}
    for k, x in by_key(rows).items():
        values = sorted({v for v, _ in x})
        for i, v in enumerate(values):
            assert got[k, v] == (sum(w for a, w in x if a < v), sum(w for _, w in x), values[i - 1] if i else None)


def test_medians_and_deviations(table, rows):
    got = {r.k: (r.median, r.upper, r.n) for r in ranks.medians(table, "k", "v").collect()}
    want = {k: (float(np.median([v for v, _ in x])), x[len(x) // 2][0], len(x)) for k, x in by_key(rows).items()}
    assert got == want
    d = {r.k: (r.med, r.mad) for r in ranks.deviations(table, "k", "v").collect() if r.v is not None}
    assert d == {k: (want[k][0], float(np.median([abs(v - want[k][0]) for v, _ in x]))) for k, x in by_key(rows).items() if k is not None}


def test_neighbours_carry_over_ranges(table):
    df = table.select("k", "v", F.when(F.col("w") > 2, F.col("w")).alias("mark")).where("v IS NOT NULL").withColumn("id", F.monotonically_increasing_id())
    df = df.sparkSession.createDataFrame(df.collect(), df.schema)
    got = {r.id: (r.lo, r.hi) for r in ranks.between(df, ["k"], ["v", "id"], "mark").collect()}
    for k in {r.k for r in df.collect()}:
        x = sorted((r for r in df.collect() if r.k == k), key=lambda r: (r.v, r.id))
        for i, r in enumerate(x):
            assert got[r.id] == (next((a.mark for a in x[i::-1] if a.mark is not None), None), next((a.mark for a in x[i:] if a.mark is not None), None))


def test_the_plan_has_no_window_over_a_bare_key(table):
    plan = stats.weighted_quantiles(table, "k", "v", "w", [0.5])._jdf.queryExecution().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__part" in line.split("],")[1] for line in windows)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ranks.interpolated_quantiles(df, "k", "v", F.col("w"), [0.5]).collect() == []
    assert ranks.deviations(df, "k", "v").collect() == [] and measures.mass_bands(df, "k", "v", "w", 3).collect() == []
    assert fits.quantile_map(df, df, "k", "v", F.col("w")).collect() == []


def test_no_frame_is_read_anew_for_each_row(spark):
    rows = spark.createDataFrame([(1, "k", float(i)) for i in range(50)], "id long, k string, x double")
    found = [
        ranks.between(rows, ["k"], ["x", "id"], "id"),
        records.nearest_within(rows, rows.withColumnRenamed("id", "r"), "k", "x", "id", "r", 3.0),
        matching.bracket_lerp(rows, rows, "k", "x", "x"),
        fits.quantile_map(rows, rows, "k", "x", F.lit(1)),
    ]
    for df in found:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" in plan and "currentrow$(), unboundedfollowing$()" not in plan
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert all("__part" in line for line in windows)
