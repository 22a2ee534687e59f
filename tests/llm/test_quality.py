import zlib

import numpy as np

from sparkloom.llm import quality


def test_scores_follow_held_out_labels(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert len(scored) > 300
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in scored)
    right = np.mean([r.predicted == r.quality for r in scored])
    good, bad = ([r.score for r in scored if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert right > 0.97 and auc > 0.98, (right, auc)


def test_training_ignores_held_out_rows(spark):
    rows = [(i, ("good text here " if i % 3 else "BAD!! ### ") * (1 + i % 4)) for i in range(300)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    kept = [(i, int(i % 3 > 0)) for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    lies = [(i, int(i % 3 == 0)) for i, _ in rows if not zlib.crc32(str(i).encode()) % 5]
    schema = "doc_id long, quality int"
    one = quality.train(docs, spark.createDataFrame(kept, schema))
    two = quality.train(docs.repartition(3), spark.createDataFrame(kept + lies + [(1, None), (None, 1), (2, 7)], schema))
    assert (one.weights == two.weights).all() and one.shift == two.shift
    got = {r.doc_id: r for r in quality.score(docs, one).collect()}
    assert all(got[i].predicted == int(i % 3 > 0) for i, _ in rows)
    assert quality.keep_good(docs, one).count() == 200 and quality.keep_good(docs, one).columns == docs.columns


def test_edges(spark):
    schema = "doc_id long, text string, held_out string"
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (3, "a", "x"), (4, "é" * 100000, "x"), (3, "a", "x")], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5} and not any(r.held_out for r in rows if r.doc_id is None)
    assert quality.score(docs.limit(0), model).collect() == [] and quality.keep_good(docs, model).count() == 5


def test_chunks_and_runs(monkeypatch):
    text = b"some words words words that go on " * 50
    whole = np.sort(quality.Indicators()(text))
    monkeypatch.setattr(quality, "_CHUNK", 100)
    assert (np.sort(quality.Indicators()(text)) == whole).all()
    assert [quality.longest_run(t.split()) for t in (b"", b"a", b"a a", b"b a a a b b")] == [0, 1, 2, 3]
