import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import sharding


@given(st.integers(1, 5000), st.integers(0, 2**63))
@settings(max_examples=60, deadline=None)
def test_permutation_is_a_bijection(n, seed):
    p = sharding.FeistelPermutation(n, seed)(np.arange(n))
    assert sorted(p) == list(range(n))


def test_shards_are_even_gapless_and_reproducible(spark):
    rows = [(i, "t" * (i % 50)) for i in range(1000)] + [(None, None), (5, "dup"), (5, "dup"), (2000, ""), (2001, "é")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    one = sharding.shard_rows(df).collect()
    two = sharding.shard_rows(df.repartition(5)).collect()
    assert sorted(one, key=str) == sorted(two, key=str)
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in one), key=str) == want
    slots = {}
    for r in one:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = [r.doc_id for r in sorted(one, key=lambda r: (r.shard, r.slot)) if r.shard == 0]
    assert order != sorted(order, key=lambda x: x or -1)


def test_empty_table(spark):
    assert sharding.shard_rows(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_many_equal_rows_and_buckets(spark, monkeypatch):
    df = spark.createDataFrame([(None, None)] * 400 + [(7, "x")] * 90 + [(i, str(i)) for i in range(50)], "doc_id long, text string")
    want = sorted(sharding.shard_rows(df).collect(), key=str)
    monkeypatch.setattr(sharding, "REPEATS", 32)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 4)
    assert sorted(sharding.shard_rows(df).collect(), key=str) == want
    places = sorted(r.slot * 16 + r.shard for r in want)
    assert places == list(range(540))
