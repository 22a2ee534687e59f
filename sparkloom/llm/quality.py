"""Quality classifier: support vector machine on n-gram indicators scaled by naive Bayes ratios."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets that n-grams are hashed to, and the lengths of the byte n-grams.
BUCKETS, GRAMS = 1 << 18, (2, 3, 4)
#: Word n-grams of one repeated word: an indicator for each length that a text reaches.
REPEATS = (3, 5, 10)
#: The classifier is fitted on at most this many labelled rows, chosen by a hash of their id.
SAMPLE_ROWS = 4000
#: Bytes of a text whose n-grams are looked up at a time.
_CHUNK = 1 << 20


class Indicators:
    """Distinct hashed n-grams of a text; keeps one scratch array for all texts."""

    def __init__(self):
        self.last = np.zeros(BUCKETS, dtype=np.int64)

    def __call__(self, text: bytes) -> np.ndarray:
        found = [self._distinct(text[at : at + _CHUNK + max(GRAMS) - 1]) for at in range(0, len(text), _CHUNK)]
        grams = found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        run = longest_run(text.split())
        return np.append(grams, [BUCKETS + i for i, n in enumerate(REPEATS) if run >= n]).astype(np.int64)

    def _distinct(self, text: bytes) -> np.ndarray:
        b = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
        hashed, code = [], b
        for n in range(2, max(GRAMS) + 1):
            code = (code[:-1] << np.uint32(8)) | b[n - 1 :]  # four bytes at most
            if n in GRAMS:
                hashed.append(((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
            if len(code) < 2:
                break
        at = np.concatenate(hashed).astype(np.int64) if hashed else np.zeros(0, np.int64)
        order = np.arange(len(at))
        self.last[at] = order  # the last of equal n-grams stays
        return at[self.last[at] == order]


def longest_run(words: list[bytes]) -> int:
    """How often a word is written one after the other, at most."""
    new = np.flatnonzero(np.fromiter((a != b for a, b in zip(words, words[1:])), dtype=bool, count=max(0, len(words) - 1)))
    return int(np.diff(np.concatenate([[-1], new, [len(words) - 1]])).max()) if words else 0


def values_of(features: np.ndarray) -> np.ndarray:
    """Byte n-grams share one unit of length, so that long texts don't weigh more; repeats count in full."""
    return np.where(features < BUCKETS, 1 / max(1, len(features)) ** 0.5, 1.0)


@dataclass
class Model:
    """Weights per bucket, and the line that turns a margin into a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, features: np.ndarray) -> float:
        """Probability of label 1."""
        margin = self.margin(features)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))

    def margin(self, features: np.ndarray) -> float:
        return self.bias + float(self.weights[features] @ values_of(features))


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 12, alpha: float = 1.0, seed: int = 42) -> Model:
    """Naive Bayes log-count ratios, then dual coordinate descent on the hinge loss.

    A fifth of the rows calibrates the margins. With labels of one class only,
    or none, the score is the smoothed share of label 1 for every text.
    """
    y = np.asarray(labels)
    share = (float(y.sum()) + 1) / (len(y) + 2)
    constant = Model(np.zeros(BUCKETS + len(REPEATS), np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    if len(y) < 10 or not 0 < y.sum() < len(y):
        return constant
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    counts = np.full((2, BUCKETS + len(REPEATS)), alpha)
    for i in train:
        counts[int(y[i]), rows[i]] += 1
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))

    values = [(ratio[r] * values_of(r)).astype(np.float32) for r in rows]
    square = np.array([float(v @ v) + 1 for v in values])  # the 1 is the bias
    w, bias, dual, sign = np.zeros(len(ratio)), 0.0, np.zeros(len(y)), np.where(y > 0, 1.0, -1.0)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(train):
            r, v = rows[i], values[i]
            gradient = sign[i] * (w[r] @ v + bias) - 1
            new = min(max(dual[i] - gradient / square[i], 0.0), c)
            if (step := (new - dual[i]) * sign[i]) != 0:
                dual[i] = new
                w[r] += step * v
                bias += step
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    model = Model((w * ratio).astype(np.float32), float(bias), 1.0, 0.0)
    margins = np.array([model.margin(rows[i]) for i in held])
    model.slope, model.shift = _platt(margins, y[held], share)
    return model


def _platt(margins: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic calibration with smoothed targets, by Newton steps; the slope is kept positive."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, theta = np.column_stack([margins, np.ones(len(margins))]), np.array([1.0, np.log(share / (1 - share))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        g, h = x.T @ (p - target) + 1e-3 * theta, (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        theta = theta - step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit the model on labelled rows that are not held out.

    At most ``sample_rows`` of them, those with the smallest hash of their id,
    are turned into features by the executors and collected. Ids with null or
    contradicting labels, and labels other than 0 and 1, teach nothing.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    chosen = known.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators = Indicators()
        for b in batches:
            found = [indicators(t.as_py() or b"").astype(np.int32).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["label", "features"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    # repeated ids are one row: the bound holds, and the order does not depend on the partitions
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text").mapInArrow(run, "label int, features binary")
    table = sorted(((bytes(f), y) for f, y in rows.select("features", "label").collect()))
    return fit([np.frombuffer(f, dtype=np.int32) for f, _ in table], np.array([y for _, y in table]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text; only the text enters the score.

    Null and empty texts have no n-grams and get the score of the bias alone.
    Null ids are not held out. Other columns are ignored; an empty table gives
    no rows. There is no shuffle.
    """
    model_sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators, m = Indicators(), model_sent.value
        for b in batches:
            scores = np.fromiter((m.score(indicators(t.as_py() or b"")) for t in b.column(1)), dtype=np.float64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores)], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns; no shuffle."""
    model_sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indicators, m = Indicators(), model_sent.value
        for b in batches:
            at = b.schema.get_field_index(text_col)
            good = [m.score(indicators((t.as_py() or "").encode())) >= threshold for t in b.column(at)]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
