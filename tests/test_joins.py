"""Lookup joins and components with broadcast, hot and rare keys forced."""

import random
import subprocess
import sys

import pytest

from sparkloom import staging
from sparkloom.operators import joins
from sparkloom.operators.graph import connected_components


def both_ways(monkeypatch, how):
    if how != "broadcast":
        monkeypatch.setattr(staging, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(joins, "HOT_SHARE", {"hot": 10**9, "rare": 1, "mixed": 20}[how])


@pytest.mark.parametrize("path", ["broadcast", "hot", "rare", "mixed"])
def test_lookup_is_a_join(spark, monkeypatch, path):
    rows = [(i, 7 if i % 3 else i % 40, "r") for i in range(200)] + [(i, None, "n") for i in range(30)]
    left = spark.createDataFrame(rows, "id int, k int, v string")
    right = spark.createDataFrame([(k, f"t{k}") for k in range(0, 60, 2)] + [(7, "t7")], "k int, w string")
    want = {how: sorted(map(str, left.join(right, "k", how).collect())) for how in ("inner", "left", "left_semi", "left_anti")}
    both_ways(monkeypatch, path)
    for how, w in want.items():
        out = joins.lookup(left, right, "k", how)
        assert sorted(map(str, out.collect())) == w
        assert joins.lookup(left.limit(0), right, ["k"], how).collect() == []


@pytest.mark.parametrize("path", ["broadcast", "hot", "rare", "mixed"])
def test_components(spark, monkeypatch, path):
    both_ways(monkeypatch, path)
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 50)] + [(100 + i, 101 + i) for i in range(20)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)] + [(300, 300), (None, 4), (5, None)]
    label = {n: n for e in edges if None not in e for n in e}
    for _ in range(60):
        for a, b in edges:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {r.node: r.label for r in got.collect()} == label


def test_the_library_imports_without_the_numbered_operators():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'scene_search_topk' in q and 'op1_simhash' not in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_few_rows_do_not_make_all_keys_frequent(spark, monkeypatch):
    monkeypatch.setattr(joins.staging, "BROADCAST_BYTES", 10_000)
    monkeypatch.setattr(joins, "HOT_BYTES", 10_000, raising=False)
    written = []
    write = joins.staging.materialize
    monkeypatch.setattr(joins.staging, "materialize", lambda df, name: written.append(write(df, name)) or written[-1])
    left = spark.createDataFrame([(i, i % 20) for i in range(40)] + [(100 + i, 3) for i in range(30)], "id int, k int")
    right = spark.createDataFrame([(k, f"w{k}" * 100) for k in range(20)], "k int, w string")
    want = sorted(map(str, left.join(right, "k").collect()))
    assert sorted(map(str, joins.lookup(left, right, "k", row_bytes=1000).collect())) == want
    assert [[r.k for r in t.collect()] for t in written] == [[3]]
