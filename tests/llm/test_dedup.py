"""SimHash and exact deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import exact_dedup, near_text, simhash

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "É é"), (7, "é é"), (8, "a b"), (None, "a b"), (9, "x y z w"), (9, "X y z w"), (10, "word " * 5000), (11, "İ"), (12, "a b c d")]
SCHEMA = "doc_id long, text string"


def slow_fingerprint(text):
    words, cur = [], ""
    for c in (text or "").translate(TABLE):
        if c in " \t\n\x0b\x0c\r":
            words, cur = words + [cur] * bool(cur), ""
        else:
            cur += c
    words += [cur] * bool(cur)
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@given(st.text(alphabet="aB c\n\té \x1c", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_is_the_plain_definition(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_masks_cover_every_pair_in_the_radius():
    masks = simhash.covering_masks(3)
    assert len(masks) == 15 and all(30 <= m.bit_count() <= 36 for m in masks)
    rng = random.Random(1)
    for _ in range(3000):
        diff = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3)))
        assert any(m & diff == 0 for m in masks)


def brute(rows):
    n = len(rows)
    root = list(range(n))
    fps = [slow_fingerprint(t) for _, t in rows]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_components_against_brute_force(spark):
    rng, rows = random.Random(7), list(EDGE)
    base = ["w%d" % rng.randrange(400) for _ in range(300)]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(300)] = "v%d" % rng.randrange(9)
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, " ".join("u%d" % rng.randrange(50) for _ in range(rng.randrange(1, 9)))) for i in range(80)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", fp string, component_id int")
    assert got(simhash.simhash_components(df)) == brute(rows)


@pytest.mark.parametrize("most", [2048, 5])
def test_dense_buckets_by_forest_and_by_further_masks(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BUCKET_MEMBERS", most)
    rng = random.Random(3)
    fps = {0, 2**64 - 1}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            for i in rng.sample(range(64), rng.randint(0, 2)):
                x ^= 1 << i
            fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64).view(np.int64)
    want = simhash.spanning_roots(fps, 3)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    for links in (simhash.near_links(df),):
        root = {int(x): int(x) for x in fps}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links.collect():
            root[find(a)] = find(b)
        first = {}
        assert [first.setdefault(find(int(x)), i) for i, x in enumerate(fps)] == list(want)


def test_near_duplicates_leave_one_row_each(spark):
    rows = [(1, "a b c d"), (2, "A b c d"), (3, "other words here now"), (None, "lone text of nobody")]
    df = spark.createDataFrame([(*r, "s") for r in rows], SCHEMA + ", source string")
    assert [tuple(r) for r in simhash.keep_one_of_each(df).orderBy("doc_id").collect()] == [(None, rows[3][1], "s"), (1, "a b c d", "s"), (3, rows[2][1], "s")]


def brute_exact(rows):
    norm = [(t or "").translate(TABLE) for _, t in rows]
    out = []
    for (d, _), n in zip(rows, norm):
        ids = [r[0] for r, m in zip(rows, norm) if m == n]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup_against_brute_force(spark):
    df = spark.createDataFrame([(*r, 3) for r in EDGE], SCHEMA + ", digest int")
    assert got(exact_dedup.exact_dedup(df)) == brute_exact(EDGE)
    kept = exact_dedup.keep_first_of_each(df)
    assert kept.columns == ["doc_id", "text", "digest"]


def test_colliding_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: exact_dedup.F.lit("00"))
    df = spark.createDataFrame(EDGE, SCHEMA)
    assert got(exact_dedup.exact_dedup(df)) == brute_exact(EDGE)


@pytest.mark.parametrize("f", [simhash.simhash_components, exact_dedup.exact_dedup])
def test_empty_table(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("f", [simhash.keep_one_of_each, exact_dedup.keep_first_of_each])
def test_an_id_repeated_with_two_texts_loses_none(spark, f):
    first, other = "first text of some words", "quite another text in here"
    low = f is simhash.keep_one_of_each
    rows = [(5, first), (4 if low else 9, first), (5, other), (7, "same row"), (7, "same row"), (None, first), (None, "nobody's"), (None, "nobody's")]
    want = [(5, other), (4 if low else 9, first), (7, "same row"), (None, "nobody's")]
    assert got(f(spark.createDataFrame(rows, SCHEMA))) == sorted(want, key=str)


@pytest.mark.parametrize("share", [1, 10, 10**9])
def test_hot_keys_are_joined_alike(spark, monkeypatch, share):
    from sparkloom import staging
    from sparkloom.operators import joins

    monkeypatch.setattr(staging, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_SHARE", share)
    rng, rows = random.Random(9), list(EDGE) + [(500 + i, "the same text in many rows") for i in range(40)] + [(None, "")] * 3
    base = ["w%d" % rng.randrange(400) for _ in range(300)]
    for i in range(30):
        words = list(base)
        words[rng.randrange(300)] = "v%d" % rng.randrange(9)
        rows.append((100 + i, " ".join(words)))
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(simhash.simhash_components(df)) == brute(rows)
    assert got(exact_dedup.exact_dedup(df)) == brute_exact(rows)


def test_whole_sets_are_not_broadcast(spark, monkeypatch):
    """One text with many near copies, and sets beyond the bound of broadcast tables: plans of the verification stay small."""
    rng = random.Random(5)
    base = [str(rng.randrange(10**6)) for _ in range(300)]
    rows = [(i, " ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(0, 300, 5)] + [(1000 + i, " ".join(str(rng.randrange(10**6)) for _ in range(50))) for i in range(20)]
    plans, write = {"near-links": [], "near-tried": []}, near_text.materialize

    def noted(df, name):
        if name in plans:
            plans[name].append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(near_text, "materialize", noted)
    monkeypatch.setattr("sparkloom.staging.BROADCAST_BYTES", 0)
    got = sorted(r.doc_id for r in near_text.keep_one_of_each(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [0, *range(1000, 1020)]
    assert plans["near-links"] and all("BroadcastExchange" not in p and p.count("SortMergeJoin") == 2 for p in plans["near-links"])
    assert plans["near-tried"] and all("Union" not in p for p in plans["near-tried"])  # one join with the heads, none for frequent keys beside it


def test_long_texts_are_told_apart_before_they_are_read(spark, monkeypatch):
    """Long texts that share rare passages pass the small sketch; pairs on both sides of the bounds of size stay whole."""
    rng, rows = random.Random(6), []
    passage = ["p%d" % i for i in range(40)]
    for i, n in enumerate([1500, 1500, 1600, 3000, 3200, 3100]):
        rows.append((i, " ".join(passage + ["u%d" % rng.randrange(10**9) for _ in range(n)])))
    for i, n in enumerate([620, 640, 2540, 2600]):
        words = ["c%d_%d" % (i, j) for j in range(n + 30)]
        rows += [(100 + 10 * i + k, " ".join(words[: n + 30 * k])) for k in range(2)]
    read, write = [], near_text.materialize

    def noted(df, name):
        out = write(df, name)
        if name == "near-full":
            read.append(out.count())
        return out

    monkeypatch.setattr(near_text, "materialize", noted)
    got = sorted(r.doc_id for r in near_text.keep_one_of_each(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [0, 1, 2, 3, 4, 5, 100, 110, 120, 130]
    assert sum(read) == 8


def test_lookup_with_known_counts(spark, monkeypatch):
    from sparkloom import staging
    from sparkloom.operators import joins

    monkeypatch.setattr(staging, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_SHARE", 3)
    rows = spark.createDataFrame([(1, i) for i in range(20)] + [(2, 90), (3, 91), (None, 92)], "k int, v int")
    table = spark.createDataFrame([(1,), (2,)], "k int")
    monkeypatch.setattr(staging, "materialize", lambda df, name, f=staging.materialize: (hot.append(df.collect()), f(df, name))[1])
    hot = []
    got = joins.lookup(rows, table, "k", counts=spark.createDataFrame([(1, 20), (2, 1)], "k int, __rows long"))
    assert sorted(r.v for r in got.collect()) == [*range(20), 90] and [[r.k for r in h] for h in hot] == [[1]]
