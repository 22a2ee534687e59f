"""Search by blocks against brute force, with copies, zero vectors and small blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import pairing, search
from sparkloom.plans import registry


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 4))
    v[20:30], v[40:44], v[50] = v[0], v[3] * 2, 0
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(60, None), (None, [1.0] * 4), (61, [1.0, None, 0.0, 0.0])]
    return v, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.fixture(autouse=True)
def small(monkeypatch):
    for name, value in {"QUERY_BLOCK": 4, "VECTOR_BLOCK": 16, "LEAST_BLOCK": 8, "HELD": 20}.items():
        monkeypatch.setattr(search, name, value)


def sides(df, step=5):
    return search.rows_of(df.where(F.col("vec_id") % step == 0), "query_id"), search.rows_of(df)


def cosine(a, b):
    dot = lambda x, y: sum(float(s) * float(t) for s, t in zip(x, y))
    return dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5)


def scored(v, step=5):
    ids = [i for i in range(60) if i != 50]
    return {q: {i: cosine(v[q], v[i]) for i in ids if i != q} for q in ids if q % step == 0}


def test_nearest_and_moments(table):
    v, df = table
    q, r = sides(df)
    want = scored(v)
    got = {(x.query_id, x["rank"]): (x.vec_id, round(x.score, 12)) for x in search.nearest(q, r, 3).collect()}
    best = {a: sorted(s.items(), key=lambda x: (-x[1], x[0]))[:3] for a, s in want.items()}
    assert got == {(a, k + 1): (i, round(s, 12)) for a, b in best.items() for k, (i, s) in enumerate(b)}
    for x in search.moments(q, r).collect():
        s = list(want[x.query_id].values())
        assert abs(x.center - np.mean(s)) < 1e-12 and abs(x.spread - np.std(s)) < 1e-12
    assert search.nearest(q.limit(0), r, 3).collect() == []


def test_no_pair_is_a_row(table):
    v, df = table
    plan = search.nearest(*sides(df), 3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan


def test_no_spread(spark):
    df = spark.createDataFrame([(i, [0.1, 0.7, 0.3]) for i in range(10)], "vec_id long, embedding array<double>")
    assert {(x.center, x.spread) for x in search.moments(*sides(df)).collect()} == {(0.0, 1.0)}
    assert {(x.query_id, x.vec_id) for x in search.nearest(*sides(df), 2).collect()} == {(0, 1), (0, 2), (5, 0), (5, 1)}


def test_diverse(table):
    v, df = table
    want = set()
    for q, s in scored(v).items():
        taken = []
        for i in sorted(s, key=lambda i: (-s[i], i)):
            if len(taken) < 3 and all(cosine(v[i], v[t]) < 0.1 for t in taken):
                taken.append(i)
        want |= {(q, k + 1, i) for k, i in enumerate(taken)}
    assert {(x.query_id, x["rank"], x.vec_id) for x in search.diverse(*sides(df), 3, 0.1).collect()} == want


def test_mutual_nearest(table):
    v, df = table
    s = scored(v)
    ahead = {q: min(x, key=lambda i: (-x[i], i)) for q, x in s.items()}
    back = {b: min((q for q in s if q != b), key=lambda q: (-s[q][b], q)) for b in ahead.values()}
    assert {(x.a, x.b) for x in search.mutual_nearest(*sides(df)).collect()} == {(a, b) for a, b in ahead.items() if back[b] == a}


@pytest.mark.parametrize("block", [8, 1000])
def test_mutual_pairs_of_all_rows(spark, table, monkeypatch, block):
    monkeypatch.setattr(search, "SELF_BLOCK", block)
    monkeypatch.setattr(search, "LEAST_BLOCK", block)
    v, df = table
    best = {q: min(x, key=lambda i: (-x[i], i)) for q, x in scored(v, 1).items()}
    longer = spark.createDataFrame([(i, [1.0, float(i), 2.0, 0.5, 3.0]) for i in (70, 71)] + [(80, [2.0])], "vec_id long, embedding array<double>")
    got = {(x.query_id, x.vec_id) for x in search.nearest_of_each(search.rows_of(df.union(longer))).collect()}
    assert got == set(best.items()) | {(70, 71), (71, 70)}
    pairs = {(x.a, x.b) for x in search.mutual_pairs(search.rows_of(df)).collect()}
    assert pairs == {(a, b) for a, b in best.items() if best[b] == a} and any(a % 5 and b % 5 for a, b in pairs)
    assert search.mutual_pairs(search.rows_of(df.limit(0))).collect() == []


def test_mutual_query_looks_at_all_rows(spark, tmp_path):
    """Rows 1 and 3 are each other's best, and the best of row 20 is row 1, which has a better one."""
    rows = [(20, [1.0, 0.3]), (1, [1.0, 0.0]), (3, [1.0, 0.01]), (40, [-1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {(x.a, x.b) for x in registry.QUERIES["mutual_nn"](spark, str(tmp_path)).collect()} == {(1, 3), (3, 1)}


def test_retrieve_weighted(table):
    v, df = table
    want = set()
    for q, s in scored(v).items():
        gaps = [abs(q - i) for i in s]
        cost = {i: 1 - c + 0.3 * (abs(q - i) - np.mean(gaps)) / np.std(gaps) for i, c in s.items()}
        want |= {(q, k + 1, i) for k, i in enumerate(sorted(cost, key=lambda i: (round(cost[i], 12), i))[:4])}
    assert {(x.query_id, x["rank"], x.vec_id) for x in pairing.retrieve_weighted(*sides(df), lambda a, b: abs(a - b), 0.3).collect()} == want
