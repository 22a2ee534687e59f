"""Encoding, token counts and packing against the tokenizer libraries."""

import hashlib
import zlib

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import bpe, byte_bpe, packing, token_counts
from sparkloom.llm.queries import BYTE_BPE

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "  \n\n ", "It's a test.", "It's a test.", "naïve café 漢字 🙂", "a\n\nb  c\n", "x" * 700, "ab " * 9000, "<|endoftext|> is text", "tab\tand \xa0 space", "line one\nline two\r\nthree"]
ROWS = [(i if i else None, t, "clash") for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def rank_lib():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def json_lib():
    return Tokenizer.from_file(BYTE_BPE[0])


ALPHABET = st.text(alphabet=st.sampled_from(list("aeT's1² \n\té漢🙂.!\xa0́")) | st.characters(max_codepoint=0x52F), max_size=80)


@given(ALPHABET)
@settings(max_examples=300, deadline=None)
def test_encoders_agree_with_the_libraries(rank_lib, json_lib, text):
    encoder, tokens = bpe.rank_codec(RANKS, P.PATTERN)
    (ids,) = encoder.encode([text])
    assert ids.tolist() == rank_lib.encode_ordinary(text)
    assert byte_bpe.decode_bytes(ids, tokens) == text.encode()
    (ids,) = bpe.library_codec(*BYTE_BPE)([text])
    assert ids.tolist() == json_lib.encode(text, add_special_tokens=False).ids


def test_long_pieces_and_cut_texts(rank_lib, monkeypatch):
    monkeypatch.setattr(bpe, "_TOGETHER", 64)
    monkeypatch.setattr(bpe, "_CACHED_CHUNKS", 10)
    texts = [t or "" for t in TEXTS] + ["aAbB" * 500, "é" * 900, "1" * 257]
    encoder, _ = bpe.rank_codec(RANKS, P.PATTERN)
    assert [i.tolist() for i in encoder.encode(texts)] == [rank_lib.encode_ordinary(t) for t in texts]


def test_round_trip_digests(spark, rank_lib):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted((tuple(r) for r in byte_bpe.round_trip_digests(df, RANKS, P.PATTERN).collect()), key=str)
    ids = [rank_lib.encode_ordinary(t or "") for t in TEXTS]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(r[0], len(i), sha(np.array(i, "<u4").tobytes()), sha((r[1] or "").encode())) for r, i in zip(ROWS, ids)]
    assert got == sorted(want, key=str)
    encoded = byte_bpe.encode_texts(df, RANKS, P.PATTERN)
    assert sorted((r.text for r in byte_bpe.decode_ids(encoded, RANKS, P.PATTERN).collect())) == sorted(t or "" for t in TEXTS)


def test_counts_by_line(spark, json_lib):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {}
    for r in token_counts.count_by_section(df, *BYTE_BPE).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens))
    for doc_id, text, _ in ROWS:
        text = text or ""
        lines = text.splitlines(keepends=True) if "\r" not in text else ["line one\n", "line two\r\n", "three"]
        lines = lines or [""]
        ends = np.cumsum([len(x) for x in lines])
        counts = [0] * len(lines)
        for start, _ in json_lib.encode(text, add_special_tokens=False).offsets:
            counts[int(np.searchsorted(ends, start, side="right"))] += 1
        assert sorted(got[doc_id]) == [(i, int(e) - len(x), int(e), c) for i, (x, e, c) in enumerate(zip(lines, ends, counts))], text


def test_given_sections_and_rules(spark, json_lib):
    from pyspark.sql import functions as F

    text = "Hello wonderful world, good morning"
    spans = [tuple(s) for s in json_lib.encode(text, add_special_tokens=False).offsets]
    sections = [(0, 7), (7, 15), (20, 24)]
    col = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in sections))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for rule in token_counts.RULES:
        want, crossing = {}, {}
        for a, b in spans:
            over = [(max(0, min(b, e) - max(a, s)), i) for i, (s, e) in enumerate(sections)]
            met = [(n, i) for n, i in over if n]
            key = -1 if not met else {"first": met[0][1], "last": met[-1][1], "most": max(met, key=lambda x: (x[0], -x[1]))[1]}[rule]
            want[key] = want.get(key, 0) + 1
            if met and (len(met) > 1 or met[0][0] < b - a):
                crossing[key] = crossing.get(key, 0) + 1
        rows = token_counts.count_by_section(df, *BYTE_BPE, rule=rule, sections=col).collect()
        assert {r.section: r.n_tokens for r in rows if r.n_tokens} == want
        assert {r.section: r.n_crossing for r in rows if r.n_crossing} == crossing
        assert sum(r.n_tokens for r in rows) == len(spans)


def check_packing(rows, ids, capacity):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, want in ids.items():
        want = np.array([*want, 0], "<u4")
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [(p.piece, p.start, p.length) for p in pieces] == [(i, s, n) for i, (s, n) in enumerate(packing.cut(len(want), capacity))]
        assert all(p.ids_crc32 == zlib.crc32(want[p.start : p.start + p.length].tobytes()) for p in pieces)
        assert all(p.length == capacity for p in pieces[1:]) and sum(p.length for p in pieces) == len(want)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def test_packing_is_whole_and_tight(spark, sf_dir, json_lib):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs, *BYTE_BPE).collect()
    ids = {r.doc_id: json_lib.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    n = check_packing(rows, ids, 2048)
    assert n <= -(-sum(len(i) + 1 for i in ids.values()) // 2048) + 1


def test_packing_edge_rows(spark, json_lib):
    df = spark.createDataFrame([r for r in ROWS if r[0]] + [(50 + i, "", "") for i in range(60)], SCHEMA).repartition(5)
    rows = packing.pack(df, *BYTE_BPE, capacity=64).collect()
    ids = {r[0]: json_lib.encode(r[1] or "", add_special_tokens=False).ids for r in ROWS if r[0]} | {50 + i: [] for i in range(60)}
    n = check_packing(rows, ids, 64)
    assert n <= -(-sum(len(i) + 1 for i in ids.values()) // 64) + 2
    assert packing.pack(df.limit(0), *BYTE_BPE).collect() == []


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=20))
@settings(max_examples=60, deadline=None)
def test_plans_hold_exactly_the_histogram(hist):
    h = np.zeros(41, dtype=np.int64)
    for k, n in hist.items():
        h[k] = n
    plan = packing.make_plan(h, 40)
    used = np.zeros(41, dtype=np.int64)
    for _, copies, kinds, times in plan.runs:
        assert (kinds * times).sum() <= 40
        used[kinds] += copies * times
    assert (used == h).all()
    best = sum(packing._best_fit(h.copy(), {}, 40).values())
    assert plan.sequences <= best + max(1, best // 20)


@pytest.mark.parametrize("f", [lambda d: byte_bpe.round_trip_digests(d, RANKS, P.PATTERN), lambda d: token_counts.count_by_section(d, *BYTE_BPE)])
def test_empty_tables(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("scale", [1, 40])
def test_the_program_packs(scale):
    rng = np.random.default_rng(3)
    h = scale * np.bincount(np.clip(rng.lognormal(4.5, 1, 6000).astype(int), 1, 400), minlength=401)
    x, prices = packing.solve_lp(h, 400)
    used = np.zeros(401)
    for config, v in x.items():
        assert sum(config) <= 400 and v > 0
        for length in config:
            used[length] += v
    assert np.allclose(used, h)
    bound = max(packing.dual_bound(h, np.arange(401.0), 400), packing.dual_bound(h, prices, 400))
    assert bound - 1e-6 <= sum(x.values()) <= 1.02 * bound
    whole, rest = packing.floors(x, h)
    n = packing.make_plan(h, 400).sequences
    assert (rest >= 0).all() and sum(whole.values()) >= 0.9 * n and n <= bound + 2


def test_packing_null_and_repeated_ids(spark, json_lib):
    rows = [(None, "some text here"), (None, None), (3, "x" * 700), (3, "x" * 700), (3, "other"), (4, "word " * 3000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, length int").repartition(4)
    got = packing.pack(df, *BYTE_BPE, capacity=64).collect()
    want = []
    for i, t in rows:
        ids = np.array([*json_lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 64))]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 64
