"""Language-model scoring: counts by brute force, the model against a plain version of itself, probabilities that sum to one."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import lm, queries

SCHEMA = "doc_id long, text string, score int, word string"
RANKS = queries.BYTE_BPE[1:]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def tokens(text):
    return [*lower(text).encode().split(), b""]  # bytes are split at 0x20 and 0x09-0x0D


def brute_base(rows):
    counts = Counter(t for i, text, *_ in rows if not is_held_out(i) for t in tokens(text))
    below = np.log10(sum(counts.values()) + len(counts) + 1)
    return sorted((-1 if i is None else i, is_held_out(i), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), sum(counts.values()), round(sum(np.log10(counts[t] + 1) - below for t in tokens(x)), 8)) for i, x, *_ in rows)


def some_rows(n=60, seed=0):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "cat", "Été", "été", "sat on", "日本", "mat.", "\t\n", "\x1fx", "", "zz" * 40]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40))), 1, "w") for i in range(n)]
    return [*rows, *rows[:3], (None, "null id", 1, "w"), (n, None, 1, "w"), (n + 1, "", 1, "w"), (n + 2, "word " * 3000 + "x" * 5000, 1, "w")]


@pytest.mark.parametrize("known_words", [lm.KNOWN_WORDS, 3, 0])
def test_counts_equal_brute_force(spark, known_words):
    rows = some_rows()
    df = lm.score(spark.createDataFrame(rows, SCHEMA).repartition(3), *RANKS, known_words)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8)) for r in df.collect())
    assert got == brute_base(rows)


def test_words_are_split_at_ascii_space_alone():
    texts = ["  a b ", "", "x\x0b\x0cy\tz\n\r q\x1fr\x1c", "\u00a0k l\u2003m", " ", "\x85n"]
    words, sizes = lm.split_words(pa.array(["skipped", *texts]).slice(1))
    assert [w.encode() for w in words.to_pylist()] == [w for t in texts for w in t.encode().split()] and sizes.tolist() == [len(t.encode().split()) for t in texts]
    assert list(lm.pieces(pa.array(texts))) == [(0, 6)] and list(lm.pieces(pa.array([], pa.string()))) == []


def plain_model(texts, seed=0, size=50):
    """A model with the tables of some texts of few ids and random weights."""
    end = size - 1
    every = np.concatenate([[end], *(x for t in texts for x in (t, [end]))])
    pairs = np.zeros((size, size), dtype=np.int64)
    np.add.at(pairs, (every[:-1], every[1:]), 1)
    bins = np.zeros((size, lm.BINS), dtype=np.int64)
    np.add.at(bins.T, lm.bin_of(np.arange(size)), pairs)
    n, target = pairs.sum(axis=0), lm.classes_of(bins)
    group = np.minimum(np.arange(size), lm.GROUPS - 1)
    after = np.stack([np.bincount(target, weights=r, minlength=lm.CLASSES) for r in pairs])
    cells = np.flatnonzero(pairs)
    rng = np.random.default_rng(seed)
    p = {k: (v + rng.normal(0, 0.5, v.shape)).astype(np.float32) for k, v in lm.fresh_parameters().items()}
    return lm.Model(lm.Tables(target, target[::-1].copy(), lm.class_shares(after, n, target)), group, n, cells, pairs.ravel()[cells], p)


def plain_log10(m, text):
    """Each token by itself, in float64, from the definition."""
    p = {k: v.astype(float) for k, v in m.parameters.items()}
    end, lead = len(m.group) - 1, lm.WINDOW - lm.STRIDE
    seq, out = [end, *text.tolist(), end], 0.0
    for i in range(len(seq) - 1):
        first = i // lm.STRIDE * lm.STRIDE - lead  # the window that scores this place
        seen = [j for j in range(first, i + 1) if j >= 0]
        h = np.array([p["E"][m.tables.input[seq[j]]] + p["P"][j - first] for j in seen])
        s = (h[-1] @ p["Q"]) @ (h @ p["K"]).T / lm.WIDTH**0.5
        a = np.exp(s - s.max())
        o = h[-1] + (a / a.sum()) @ (h @ p["V"]) @ p["O"]
        z = o @ p["U"] + p["b"] + p["s"] * m.tables.after[seq[i]]
        shares = z - z.max() - np.log(np.exp(z - z.max()).sum())
        out += shares[m.tables.target[seq[i + 1]]] + m.within[m.group[seq[i]], seq[i + 1]]
    return out / np.log(10)


def test_windows_score_each_token_once(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 49, n).astype(np.uint16) for n in (0, 1, 23, 24, 25, 47, 48, 200, 3)]
    m = plain_model(texts)
    want = [plain_log10(m, t) for t in texts]
    assert np.allclose(m.log10(texts), want, atol=1e-3, rtol=1e-5)
    monkeypatch.setattr(lm, "SCORED", 2)
    monkeypatch.setattr(lm, "TEXT_IDS", 30)
    assert np.allclose(m.log10(texts), want, atol=1e-3, rtol=1e-5)


def test_probabilities_sum_to_one():
    texts = [np.array([3, 4, 5], dtype=np.uint16)] * 4
    m, size = plain_model(texts), 50
    start = m.log10([np.zeros(0, np.uint16)])[0]
    # a text [a, b] less the end: over all b, what follows [a] sums to one
    window = lm.Windows([np.array([7, 9], np.uint16)], size - 1).take(slice(0, 1))
    x, after, _ = m.tables.look_up(window)
    z = lm.attend(m.parameters, x)[0].reshape(-1, lm.WIDTH) @ m.parameters["U"] + m.parameters["b"] + after * m.parameters["s"]
    share = np.exp(z[1] - z[1].max()) / np.exp(z[1] - z[1].max()).sum()
    assert share[m.tables.target] @ np.exp(m.within[m.group[7]]) == pytest.approx(sum(share[c] for c in set(m.tables.target.tolist())), abs=1e-5)
    assert start < 0


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, lm.CLASSES, (5, lm.WINDOW)), rng.integers(-1, lm.CLASSES, (5, lm.STRIDE))
    x[:2, : lm.WINDOW - lm.STRIDE] = lm.PAD
    after = rng.normal(size=(5 * lm.STRIDE, lm.CLASSES))
    p = {k: v.astype(float) * 3 for k, v in lm.fresh_parameters().items()}
    g, _ = lm.gradient(p, x, after, y)
    for k in lm.SHAPES:
        at = (int(x[4, 20]), 3) if k == "E" else tuple(rng.integers(0, n) for n in lm.SHAPES[k])
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert g[k][at] == pytest.approx((lm.gradient(up, x, after, y)[1] - lm.gradient(down, x, after, y)[1]) / 2e-5, rel=1e-3, abs=1e-9)


def test_large_logits_stay_finite():
    m = plain_model([np.array([1, 2, 3], np.uint16)])
    m.parameters["U"] *= 1e4
    m.parameters["Q"] *= 1e3
    assert np.isfinite(m.log10([np.array([1, 2, 3], np.uint16)])).all()


def test_held_out_texts_are_foretold(spark):
    """Words that alternate: the model learns what follows, which word counts alone cannot say."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        names = rng.permutation(["red", "green", "blue", "grey"])
        rows.append((i, " ".join(w for n in rng.integers(0, 4, 40) for w in (names[n], "light", "on")), 1, "w"))
    df = lm.score(spark.createDataFrame(rows, SCHEMA), *RANKS)
    s = df.where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).collect()[0]
    assert s.base < s.score < 0


def test_words_are_encoded_together():
    encoding = lm._encoding(*RANKS)
    opens = np.array([encoding.decode_single_token_bytes(i)[:1] == b" " for i in range(encoding.n_vocab)])
    for words in (["the", "été", "x1.", "日本", "\x1f"], ["a\u00a0", "\u00a0b", "c"], ["\u2003", "d\u2003"], []):
        got = lm.encode_words([w.encode() for w in words], encoding, opens)
        assert [np.frombuffer(g, np.uint16).tolist() for g in got] == [encoding.encode_ordinary(" " + w) for w in words]


def test_empty_and_untrained_tables(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA), *RANKS).collect() == []
    held = next(i for i in range(100) if is_held_out(i))
    (r,) = lm.score(spark.createDataFrame([(held, "a b", 1, "w")], SCHEMA), *RANKS).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and np.isfinite(r.score) and r.score < 0


def test_every_window_trains_once():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 50, n).astype(np.uint16) for n in (0, 1, 23, 24, 700, 5)]
    rounds = [r for k in range(lm.ROUNDS) for r in lm.round_windows(texts, np.arange(6) % lm.ROUNDS, k, 50)]
    every = lm.Windows(texts, 50).take(slice(None))
    assert sorted(map(bytes, np.concatenate(rounds))) == sorted(map(bytes, every))


def test_shares_are_looked_up_without_the_whole_table():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 49, n).astype(np.uint16) for n in (0, 1, 500, 24)]
    m = plain_model(texts)
    target = np.append(rng.integers(0, 5, 49), lm.CLASSES - 1)
    m = lm.Model(lm.Tables(target, m.tables.input, m.tables.after), np.append(np.arange(48) % 7 + 500, [511, 3]), m.counts, *np.unique(m.cells % 50 + (m.cells // 50 % 7 + 500) * 50, return_counts=True), m.parameters)
    got = m.log10(texts)
    assert "within" not in vars(m)
    last, wanted = (a.ravel() for a in np.meshgrid(np.arange(50), np.arange(50)))
    want = m.within[m.group[last], wanted]
    assert np.allclose(m.inside(last, wanted), want, rtol=1e-6, atol=1e-6) and len(np.unique(want)) > 100
    assert np.allclose(got, [plain_log10(m, t) for t in texts], atol=1e-3, rtol=1e-5)
