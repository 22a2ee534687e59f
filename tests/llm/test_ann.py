import numpy as np
import pytest

from sparkloom.llm import ann


def brute(rows, every, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 8:
            ok.setdefault(i, []).append(np.array(v, float))
    out = []
    for q in sorted(i for i in ok if i % every == 0):
        scores = {c: max(float(ann.cosine(a[None], b[None])[0]) for a in ok[q] for b in vs) for c, vs in ok.items() if c != q}
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, n + 1, c, s) for n, (c, s) in enumerate(best)]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(60)]
    rows += [(60 + i, rows[0][1]) for i in range(20)]  # copies: ties go to the smaller id
    rows += [(100, None), (101, []), (102, [0.0] * 8), (103, [float("nan")] + [1.0] * 7), (104, [None] + [1.0] * 7), (105, [float("inf")] * 8), (106, [1.0]), (None, [1.0] * 8), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = sorted(tuple(r) for r in ann.nearest(df, every=5).collect())
    want = brute(rows, 5, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-15)
    assert ann.nearest(df.limit(0)).collect() == [] and ann.nearest(df.limit(1), every=1).collect() == []


def test_blocks_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [(400 + i, [1.0] * 8) for i in range(200)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, ann.nearest(df, every=10).collect()))
    monkeypatch.setattr(ann, "BLOCK_ROWS", 30)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    assert sorted(map(tuple, ann.nearest(df, every=10).collect())) == want


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    t = df.toPandas()
    x, ids = ann._unit(np.array(t.embedding.tolist(), float)), t.vec_id.to_numpy()
    hits = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        hits += len(set(ids[np.argsort(-s)[:5]]) & set(found))
    assert len(got) == (ids % 50 == 0).sum() and hits / (5 * len(got)) > 0.9


def test_few_distinct_vectors_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 20)
    rng = np.random.default_rng(4)
    sizes = [200, 100, 40, 1, 2, 3, 1, 1, 4, 2]
    kinds = rng.permutation(np.repeat(np.arange(len(sizes)), sizes))
    vectors = [[float(np.float32(x)) for x in rng.normal(size=8)] for _ in sizes]
    rows = [(i, vectors[c]) for i, c in enumerate(kinds)]
    got = sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=1).collect())
    few = [i for i, c in enumerate(kinds) if sizes[c] < 5] + [0, 7]
    want = {w[:3] for w in brute(rows, 1, 5) if w[0] in few}
    assert len(got) == 5 * len(rows) and {g[:3] for g in got if g[0] in few} == want


def test_scores_at_the_ends_of_double(spark):
    vectors = [(0, [1e-320, 0.0]), (1, [1.0, 0.0]), (2, [1e200, 1e200]), (3, [5e-324, 5e-324]), (4, [-1.7e308, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest(df).collect()}
    root = 0.5**0.5
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in {(0, 1): 1.0, (0, 2): root, (0, 3): root, (0, 4): -1.0}.items()}
