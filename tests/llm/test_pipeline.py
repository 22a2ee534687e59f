import random

import corpus_pipeline
import __spark_entry__ as entry


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_stages_and_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = out
        seen.append({r.doc_id: r.text for r in docs.collect()})
    first, good, exact, near = seen
    assert all(set(b) <= set(a) for a, b in zip(seen, seen[1:]))
    assert all(i in good for i, q in labels.items() if q == 1)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last = {}
    for i, t in sorted(good.items()):
        last[t.translate(lower)] = i
    assert set(exact) == set(last.values())
    sets = {i: shingle_set(t) for i, t in exact.items()}
    least = {i: i for i in exact}
    ids = sorted(exact)
    pairs = [(i, j) for n, i in enumerate(ids) for j in ids[:n] if similar(sets[i], sets[j])]
    for _ in ids:
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    assert pairs and set(near) == set(least.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {p.doc_id for p in pieces} == set(near)


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_near_stage_drops_all_near_copies_by_their_texts(spark, sf_dir):
    rng, rows = random.Random(5), [(1, None), (2, ""), (3, "one two"), (4, "One  two"), (9, "x"), (9, "y z"), (None, "x"), (5, "same row"), (5, "same row"), (None, "lone text of nobody")]
    for group in range(4):
        base = ["g%dw%d" % (group, rng.randrange(300)) for _ in range(120)]
        for i in range(90 if group == 0 else 12):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(120)] = "v%d" % rng.randrange(10**6)
            rows.append((100 * (group + 1) + i, " ".join(words)))
    line = "this very common line is a part of all these texts"
    rows += [(1000 + i, " ".join([line] + ["u%d" % rng.randrange(10**6) for _ in range(rng.randrange(3, 12))])) for i in range(100)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in [(t or "").lower().split() for _, t in rows]]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old = label[a]
                label = [label[b] if x == old else x for x in label]
    want = {min((rows[i] for i in range(len(rows)) if label[i] == k), key=lambda r: (r[0] is None, r[0])) for k in set(label)}
    out = corpus_pipeline.near_dedup_stage(spark, df, sf_dir)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(want) and {i for i, _ in got} == {i for i, _ in want} and sum(i == 9 for i, _ in got) == 2


def test_odd_tables_go_through_all_stages(spark, sf_dir, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "plain words " * 20, None, None, 3), (2, "plain words " * 20, None, None, 3), (3, "x" * 50000, "en", "s", 1), (4, "word " * 30000, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, label int, node long"
    docs = spark.createDataFrame([(*r, "d", 1, 2) for r in rows], schema)
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        out, before = table, table.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= before
        pieces = corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).collect()
        assert len({(p.doc_id, p.start) for p in pieces}) == len(pieces) and bool(pieces) == (before > 0)
