"""Divergence audit against plain Python with whole numbers, and against SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import divergence as D
from sparkloom.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, value int, rank string"


def brute(rows, least):
    docs = [(x or "", lang or "", source or "") for _, x, lang, source, *_ in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, *_ in docs]
    out = []
    for lang in {d[1] for d in docs}:
        seen = Counter(t for ts, d in zip(terms, docs) if d[1] == lang for t in set(ts))
        kept = sorted((t for t, n in seen.items() if n >= least), key=str.encode)
        counts = defaultdict(Counter)
        for ts, d in zip(terms, docs):
            if d[1] == lang:
                counts[d[2]].update(t for t in ts if t in set(kept))
        v = len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            best = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", best, 10)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def some_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "THE", "cat-dog", "Été", "été", "naïve", "a1b", "x_y", "@home[z]", "日本", "", "\x00q", "`w{e}", "\U0001f600ab"]
    langs, sources = ["en", "de", None, "", "xx"], ["s1", "s2", None, "", "é", "z"]
    rows = [(i, None if rng.random() < 0.05 else " ".join(rng.choice(words, rng.integers(0, 30))), langs[rng.integers(0, 4)], sources[rng.integers(0, 6)], 1, "r") for i in range(n)]
    return rows + rows[:5] + [(n, "once only", "xx", "s1", 1, "r"), (n, "", "xx", "s2", 1, "r")]


def found(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_equals_plain_arithmetic(spark):
    rows = some_rows(150)
    assert found(D.audit(spark.createDataFrame(rows, SCHEMA), 4)) == brute(rows, 4)


def test_pieces_blocks_and_buckets_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 40)
    monkeypatch.setattr(D, "PIECE_DOCS", 3)
    rows = some_rows(60, 1) + [(999, "long " * 50 + "w" * 200 + " tail", "en", "s1", 1, "r")] * 4
    assert D.long_text_counts(rows[-1][1].encode()) == {b"long": 50, b"w" * 200: 1, b"tail": 1}
    g, names, n, docs = D.piece_counts([b"A a B", b"a", b""], np.array([0, 1, 0]))
    assert sorted(zip(g.tolist(), names, n.tolist(), docs.tolist())) == [(0, b"a", 2, 1), (0, b"b", 1, 1), (1, b"a", 1, 1)]
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("text", pa.binary())])
    batch = pa.RecordBatch.from_arrays([pa.array([(r[i] or "").encode() if i == 1 else r[i] or "" for r in rows], kinds.types[k]) for k, i in enumerate((2, 3, 1))], schema=kinds)
    sums = defaultdict(lambda: np.zeros(2, int))
    for b in D._count_terms([batch]):
        for lang, source, term, n, docs in zip(*(c.to_pylist() for c in b.columns)):
            sums[lang, source, term] += n, docs
    table = spark.createDataFrame(rows, SCHEMA)
    assert {k: tuple(v) for k, v in sums.items()} == {(r.lang, r.source, r.term): (r.n, r.docs) for r in D.term_counts(table).collect()}
    assert found(D.audit(table, 4, 7, 2)) == brute(rows, 4)


@pytest.mark.parametrize("digest", [lambda b: 7, lambda b: len(b)])
def test_collisions_are_told_apart(digest):
    text = np.frombuffer(b"ab cd ab abc cd xyz xy", dtype=np.uint8)
    starts, ends = D.term_bounds(text)
    number, first = D.group_slices(text, starts, ends, digest)
    words = bytes(text).split()
    assert all((number[i] == number[j]) == (a == b) for i, a in enumerate(words) for j, b in enumerate(words))
    assert [words[first[k]] for k in number] == words


def test_shares_do_not_overflow():
    big = np.array([10**12, 3, 0], dtype=np.int64)
    total, terms = np.full(3, 4 * 10**12 + 1), np.full(3, 10**7)
    assert D.shares(big, total, terms).tolist() == [1 + 10**9 * (int(c) + 2) // (4 * 10**12 + 1 + 2 * 10**7) for c in big]


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_sql(spark, sf_dir):
    df = queries.op13_divergence(spark, sf_dir)
    want = duckdb.sql(queries.ORACLE_SQL["op13_divergence"].replace("FROM documents", f"FROM '{sf_dir}/documents.parquet'")).select(*(duckdb.ColumnExpression(c) for c in df.columns))
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
