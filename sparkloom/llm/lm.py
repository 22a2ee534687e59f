"""Language-model scoring: causal self-attention on classes of subword ids, trained in numpy.

A text is its words and an end. Words are encoded as subword ids (with a
leading space, which marks where a word begins). The model gives the class of
the next id by causal self-attention over the ids before it, added to the log
shares of classes after the last id, and the id within its class by counts
after groups of ids; so the probabilities of all ids sum to one. Classes of
targets group ids that follow similar ids, classes of inputs group ids that
similar ids follow.

The corpus enters through sums that Spark makes over all training texts:
counts of words and of neighbouring ids (their tables are bounded by the number
of ids), and rounds of training on windows of every training text, whose
results are averaged.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.text import ascii_lower
from sparkloom.staging import materialize

#: Most words whose counts are sent to all workers; the counts of others are joined by shuffle.
KNOWN_WORDS = 300_000
#: Classes of ids (one is the end), bins of neighbouring ids, and groups of preceding ids: the most frequent ids, and classes for all others.
CLASSES, BINS, GROUPS = 64, 32, 512
#: What is added to counts of ids; the weight of all texts beside the counts after an id, and after a group.
SMOOTH, AFTER_ID, AFTER_GROUP = 0.5, 20.0, 10.0
#: Inputs a window sees, tokens it scores (the last ones), and the width of the model.
WINDOW, STRIDE, WIDTH = 32, 24, 16
#: Every window of each training text trains the attention, in one of so many rounds.
ROUNDS = 4
#: Windows of a training task in a round, at least (fewer: one task).
TASK_WINDOWS = 16_384
#: Windows a step of Adam, its rate, and windows scored at a time.
BATCH, RATE, SCORED = 64, np.float32(0.01), 96
#: Ids of texts that are scored together, and words kept by a worker.
TEXT_IDS, _CACHE = 1 << 20, 1 << 18
#: Bytes of text whose words are looked up together.
_PIECE = 1 << 21
SHAPES = {"E": (CLASSES + 1, WIDTH), "P": (WINDOW, WIDTH), "Q": (WIDTH, WIDTH), "K": (WIDTH, WIDTH), "V": (WIDTH, WIDTH), "O": (WIDTH, WIDTH), "U": (WIDTH, CLASSES), "b": (CLASSES,), "s": (1,)}
#: The input before the start of a text.
PAD = CLASSES

# ---------------------------------------------------------------- the model

Parameters = dict[str, np.ndarray]
_CAUSAL = np.where(np.arange(WINDOW)[None, :] <= np.arange(WINDOW - STRIDE, WINDOW)[:, None], 0.0, -1e9).astype(np.float32)


def fresh_parameters(seed: int = 42) -> Parameters:
    """Small random weights that leave the shares after the last id nearly as they are."""
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 0.1 if k in "EP" else WIDTH**-0.5, s).astype(np.float32) for k, s in SHAPES.items()}
    p["U"] *= np.float32(0.1)
    return p | {"b": np.zeros(CLASSES, np.float32), "s": np.ones(1, np.float32)}


def flat(p: Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray) -> Parameters:
    ends = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])
    return {k: v.reshape(s).astype(np.float32, copy=False) for (k, s), v in zip(SHAPES.items(), np.split(values, ends[:-1]))}


def _exp(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(a - shift), the sums of its rows, and the shift: 0, or the largest of each row where sums would leave the range."""
    with np.errstate(over="ignore"):
        e, one = np.exp(a), np.ones(a.shape[-1], a.dtype)
        total = (e.reshape(-1, a.shape[-1]) @ one).reshape(*a.shape[:-1], 1)
    if not total.size or 1e-25 < total.min() and total.max() < 1e30:
        return e, total, 0.0
    shift = a.max(axis=-1, keepdims=True)
    e = np.exp(a - shift)
    return e, (e.reshape(-1, a.shape[-1]) @ one).reshape(*a.shape[:-1], 1), shift


def attend(p: Parameters, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """What attention adds at the last `STRIDE` places of each window, and what the gradient needs.

    ``x`` holds `WINDOW` classes a window; a place attends to itself and those
    before it, but not to `PAD`.
    """
    h = np.take(p["E"], x, axis=0)
    h += p["P"]
    own = np.ascontiguousarray(h[:, -STRIDE:])
    q = own @ (p["Q"] * np.asarray(WIDTH**-0.5, p["Q"].dtype))
    k, v = h @ p["K"], h @ p["V"]
    a = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
    a += _CAUSAL
    if (x[:, 0] == PAD).any():
        a += np.where(x == PAD, np.float32(-1e9), np.float32(0))[:, None, :]
    a, total, _ = _exp(a)
    c = a @ v
    c /= total
    o = c @ p["O"]
    o += own
    return o, h, own, q, k, v, a, total, c


def log_shares(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of the classes ``y`` under the logits ``z`` (0 where y is below 0); shares of all classes, and their sums."""
    own = np.take(z.ravel(), np.arange(len(z)) * z.shape[1] + np.maximum(y, 0).ravel())
    e, total, shift = _exp(z)
    own = own - np.log(total[:, 0]) - (shift[:, 0] if isinstance(shift, np.ndarray) else 0)
    return np.where(y.ravel() >= 0, own, 0), e, total


def gradient(p: Parameters, x: np.ndarray, after: np.ndarray, y: np.ndarray) -> tuple[Parameters, float]:
    """Of the mean negative log probability of the classes ``y`` (those below 0 don't count), and that mean.

    ``after`` has the log shares of the classes after the id at each scored place.
    """
    o, h, own, q, k, v, a, total, c = attend(p, x)
    a /= total
    z = o.reshape(-1, WIDTH) @ p["U"] + p["b"] + after * p["s"]
    real = y.ravel() >= 0
    n = max(1, int(real.sum()))
    found, dz, sums = log_shares(z, y)
    loss = -float(found.sum()) / n
    dz /= sums
    dz[np.arange(len(dz)), np.maximum(y, 0).ravel()] -= 1
    dz *= (real / n)[:, None].astype(dz.dtype)
    root = np.asarray(WIDTH**-0.5, p["Q"].dtype)

    def outer(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.reshape(-1, left.shape[-1]).T @ right.reshape(-1, right.shape[-1])

    g = {"U": outer(o, dz), "b": dz.sum(axis=0), "s": np.array([np.vdot(dz, after)])}
    do = (dz @ p["U"].T).reshape(o.shape)
    g["O"] = outer(c, do)
    dc = do @ p["O"].T
    da = dc @ np.ascontiguousarray(v.transpose(0, 2, 1))
    dv = np.ascontiguousarray(a.transpose(0, 2, 1)) @ dc
    ds = a * (da - ((da * a).reshape(-1, WINDOW) @ np.ones(WINDOW, a.dtype)).reshape(*a.shape[:-1], 1))
    dq = (ds @ k) * root
    dk = np.ascontiguousarray(ds.transpose(0, 2, 1)) @ q  # q holds the root already
    g["Q"], g["K"], g["V"] = outer(own, dq), outer(h, dk), outer(h, dv)
    dh = dk @ p["K"].T + dv @ p["V"].T
    dh[:, -STRIDE:] += do + dq @ p["Q"].T
    g["P"] = dh.sum(axis=0)
    each, places = dh.reshape(-1, WIDTH), x.ravel()
    g["E"] = np.stack([np.bincount(places, weights=each[:, j], minlength=CLASSES + 1) for j in range(WIDTH)], axis=1)
    return g, loss


def descend(p: Parameters, tables: Tables, windows: np.ndarray, seed: int) -> Parameters:
    """Adam over the windows, once, in a shuffled order."""
    order = np.random.default_rng(seed).permutation(len(windows))
    values = flat(p)
    first, second = np.zeros_like(values), np.zeros_like(values)
    for step, at in enumerate(range(0, len(windows), BATCH), 1):
        g = flat(gradient(shaped(values), *tables.look_up(windows[order[at : at + BATCH]]))[0]).astype(np.float32)
        first += np.float32(0.1) * (g - first)
        second += np.float32(0.01) * (g * g - second)
        values -= RATE * (first / np.float32(1 - 0.9**step)) / (np.sqrt(second / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return shaped(values)


# ------------------------------------------------------------------- texts


@lru_cache(maxsize=2)
def _encoding(rank_path: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(rank_path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_words(words: list[bytes], encoding: tiktoken.Encoding, opens: np.ndarray) -> list[bytes]:
    """The ids of each word with a space before it, as uint16 bytes; all are encoded as one text.

    ``opens`` says which ids begin with a space. Where white space beyond ASCII
    hides the border of words, they are encoded one by one.
    """
    ids = np.array(encoding.encode_ordinary("".join(" " + w.decode() for w in words)), dtype=np.uint16)
    first = np.flatnonzero(opens[ids])
    if len(first) != len(words) or len(ids) and first[0]:
        return [np.array(encoding.encode_ordinary(" " + w.decode()), dtype=np.uint16).tobytes() for w in words]
    raw, ends = ids.tobytes(), np.append(first[1:], len(ids)) * 2
    return [raw[a:b] for a, b in zip((first * 2).tolist(), ends.tolist())]


class WordTable:
    """Words as numbers, with the ids of each word, its part of the base, and whether it has a count: 1 yes, 0 no, -1 not known here."""

    def __init__(self, encoding: tiktoken.Encoding, known: dict[bytes, int], complete: bool, below: float):
        self.encoding, self.known, self.complete, self.below = encoding, known, complete, below
        self.opens = np.array([encoding.decode_single_token_bytes(i)[:1] == b" " for i in range(encoding.n_vocab)])
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.base, self.state, self.length, self.ids = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def _learn(self, words: list[bytes]) -> None:
        self.number |= zip(words, range(len(self.number), len(self.number) + len(words)))
        counts = np.array([self.known.get(w, 0 if self.complete else -1) for w in words], dtype=np.int64)
        ids = encode_words(words, self.encoding, self.opens)
        self.base = np.append(self.base, np.where(counts < 0, 0.0, np.log10(np.maximum(counts, 0) + 1) - self.below))
        self.state = np.append(self.state, np.sign(counts))
        self.length = np.append(self.length, [len(i) // 2 for i in ids])
        self.ids = np.append(self.ids, np.frombuffer(b"".join(ids), dtype=np.uint16))

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """The number of each word; new ones are learned, after the others were forgotten if there are many."""
        if len(self.number) > _CACHE:
            self._clear()
        out = np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        if len(missing := np.flatnonzero(out < 0)):
            self._learn(list({words[i] for i in missing.tolist()}))
            out[missing] = [self.number[words[i]] for i in missing.tolist()]
        return out

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence of words, and where each word's ids end."""
        starts, length = np.concatenate([[0], np.cumsum(self.length)])[numbers], self.length[numbers]
        ends = np.cumsum(length)
        at = np.repeat((starts - ends + length).astype(np.int32), length)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], ends


class Windows:
    """Windows of several texts: every id of a text and its end are scored once, in the last `STRIDE` places of one window.

    The windows of a text overlap by the rest; ``owner`` is the text of each.
    """

    def __init__(self, texts: list[np.ndarray], end: int):
        lead = WINDOW - STRIDE
        counts = np.array([-(-(len(t) + 1) // STRIDE) for t in texts], dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(lead + counts * STRIDE + 1)])
        self.ids = np.full(begins[-1], end + 1, dtype=np.uint16)  # what is before and after a text
        for t, b in zip(texts, (begins[:-1] + lead).tolist()):
            self.ids[b] = self.ids[b + len(t) + 1] = end
            self.ids[b + 1 : b + 1 + len(t)] = t
        self.owner = np.repeat(np.arange(len(texts)), counts)
        self.number = np.arange(len(self.owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.starts = begins[:-1][self.owner] + self.number * STRIDE

    def take(self, which: np.ndarray | slice) -> np.ndarray:
        """The ids of some windows: those that are seen, and the one after them."""
        return self.ids[self.starts[which][:, None] + np.arange(WINDOW + 1)]


@dataclass
class Tables:
    """What counts say of each id: its classes as target and as input (the last id is the end), and log shares of classes after it."""

    target: np.ndarray
    input: np.ndarray
    after: np.ndarray

    def __post_init__(self):
        self.inputs, self.targets = np.append(self.input, PAD), np.append(self.target, -1)

    def look_up(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, shares after the scored places, and the classes to be scored (-1: none)."""
        last, wanted = windows[:, WINDOW - STRIDE : -1], windows[:, WINDOW - STRIDE + 1 :]
        return np.take(self.inputs, windows[:, :-1]), np.take(self.after, last.ravel(), axis=0, mode="clip"), np.take(self.targets, wanted)


@dataclass
class Model:
    """The tables, group of each id, counts of ids after groups (cell group * ids + id, and its count), and the attention's parameters."""

    tables: Tables
    group: np.ndarray
    counts: np.ndarray
    cells: np.ndarray
    times: np.ndarray
    parameters: Parameters

    @cached_property
    def seen(self) -> tuple[np.ndarray, ...]:
        """Of the table `within` what it takes to look cells up: a bit for each cell with a count, the counts before each 64 bits, the log shares of these cells, and the parts of all others."""
        size, target = len(self.group), self.tables.target
        group, of = np.divmod(self.cells, size)
        raised = self.counts + SMOOTH
        alone = AFTER_GROUP * raised / np.bincount(target, weights=raised, minlength=CLASSES)[target]
        total = np.bincount(group * CLASSES + target[of], weights=self.times, minlength=GROUPS * CLASSES) + AFTER_GROUP
        bits = np.zeros(-(-GROUPS * size // 64) * 8, np.uint8)
        np.bitwise_or.at(bits, self.cells >> 3, np.uint8(1) << (self.cells & 7).astype(np.uint8))
        bits = bits.view("<u8")
        before = np.cumsum(np.bitwise_count(bits), dtype=np.int32) - np.bitwise_count(bits)
        return bits, before, np.append(np.log((self.times + alone[of]) / total[group * CLASSES + target[of]]), 0).astype(np.float32), np.log(alone), np.log(total)

    def inside(self, last: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The cells of `within` of the ids ``wanted`` after the ids ``last``, without that table: it has 100 MB."""
        bits, before, shares, alone, total = self.seen
        group = np.take(self.group, last)
        cell = group * len(self.group) + wanted
        word, at = np.take(bits, cell >> 6), (cell & 63).astype(np.uint64)
        place = np.take(before, cell >> 6) + np.bitwise_count(word & ((np.uint64(1) << at) - np.uint64(1)))
        other = np.take(alone, wanted) - np.take(total, group * CLASSES + np.take(self.tables.target, wanted))
        return np.where(word >> at & np.uint64(1), np.take(shares, place), other)

    @cached_property
    def within(self) -> np.ndarray:
        """Log shares of ids within their class after each group: the whole table, by rows; `log10` looks its cells up by `inside`."""
        size = len(self.group)
        out = np.empty((GROUPS, size), dtype=np.float32)
        begins = np.searchsorted(self.cells, np.arange(GROUPS + 1) * size)
        for g in range(GROUPS):
            row = np.zeros(size)
            row[self.cells[begins[g] : begins[g + 1]] - g * size] = self.times[begins[g] : begins[g + 1]]
            out[g] = id_shares(row, self.counts, self.tables.target)
        return out

    @cached_property
    def scaled(self) -> Tables:
        """The tables with the shares as they enter the logits."""
        return replace(self.tables, after=self.tables.after * self.parameters["s"] + self.parameters["b"])

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text, given as its ids without the end."""
        end, p, tables = len(self.group) - 1, self.parameters, self.scaled
        out = np.zeros(len(texts))
        ends = np.cumsum([len(t) for t in texts]) // TEXT_IDS
        for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
            w = Windows([texts[i] for i in some], end)
            for at in range(0, len(w.owner), SCORED):
                ids = w.take(slice(at, at + SCORED))
                x, z, y = tables.look_up(ids)
                z += attend(p, x)[0].reshape(-1, WIDTH) @ p["U"]
                last, wanted = ids[:, WINDOW - STRIDE : -1].ravel(), ids[:, WINDOW - STRIDE + 1 :].ravel()
                found = log_shares(z, y)[0] + np.where(y.ravel() >= 0, self.inside(np.minimum(last, end), np.minimum(wanted, end)), 0)
                out[some] += np.bincount(w.owner[at : at + SCORED], weights=found.reshape(y.shape).sum(axis=1, dtype=np.float64), minlength=len(some))
        return out / np.log(10)


def classes_of(pairs: np.ndarray, seed: int = 42, rounds: int = 12) -> np.ndarray:
    """A class for each id by the bins of its neighbours: k-means on roots of shares, weighted by counts; the end has the last class."""
    n = pairs.sum(axis=1)
    seen = np.flatnonzero(n[:-1])
    out = np.zeros(len(n), dtype=np.int64)
    out[-1] = CLASSES - 1
    if not len(seen):
        return out
    points, weight = np.sqrt(pairs[seen] / n[seen, None]), n[seen].astype(float)
    rng, near = np.random.default_rng(seed), np.full(len(seen), np.inf)
    centres = points[[int(weight.argmax())]]
    for _ in range(CLASSES - 2):
        near = np.minimum(near, ((points - centres[-1]) ** 2).sum(axis=1))
        mass = near * weight
        if not mass.sum() > 0:
            break
        centres = np.vstack([centres, points[rng.choice(len(seen), p=mass / mass.sum())]])
    for _ in range(rounds):
        own = (points @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        mass = np.bincount(own, weights=weight, minlength=len(centres))
        sums = np.stack([np.bincount(own, weights=weight * points[:, j], minlength=len(centres)) for j in range(points.shape[1])], axis=1)
        centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-9)[:, None], centres)
    out[seen] = (points @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
    return out


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype=np.uint16) for v in column]


def bin_of(ids: np.ndarray) -> np.ndarray:
    return (ids * 2654435761 % (1 << 32)) >> (32 - BINS.bit_length() + 1)


def neighbours(encoded: DataFrame, end: int) -> DataFrame:
    """(a, b, n): how often id ``b`` follows id ``a`` in all training texts; an end stands before and after each text.

    Tasks count pieces by sorting pairs, so a row for each distinct pair of a piece is shuffled.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _ids(b.column(0))
            ends = np.cumsum([len(t) for t in texts]) // (4 * TEXT_IDS)
            for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
                stop = np.array([end], dtype=np.uint16)
                every = np.concatenate([stop, *(x for i in some for x in (texts[i], stop))]).astype(np.uint32)
                pairs = np.sort(every[:-1] << np.uint32(16) | every[1:])
                new = np.flatnonzero(np.diff(pairs, prepend=~pairs[:1]))
                found = pairs[new].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found >> 16), pa.array(found & 0xFFFF), pa.array(np.diff(new, append=len(pairs)))], names=["a", "b", "n"])

    return encoded.where("NOT held_out").select("ids").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _tables(pairs: DataFrame, cells: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], sizes: list[int]) -> list[np.ndarray]:
    """Sums of the counts of ``pairs`` over the cells that ``cells`` gives for (a, b), one table of each size; at most ``sum(sizes)`` numbers are collected."""
    first = np.cumsum([0, *sizes])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [at + cell for at, cell in zip(first, cells(b.column(0).to_numpy(), b.column(1).to_numpy()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.concat_arrays([b.column(2)] * len(found))], names=["cell", "n"])

    found = pairs.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(first[-1], dtype=np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return np.split(out, first[1:-1])


def round_windows(texts: list[np.ndarray], first: np.ndarray, k: int, end: int) -> Iterator[np.ndarray]:
    """The windows of round ``k``, some at a time; each window of a text is in one of the `ROUNDS`, its first one in that of ``first``."""
    w = Windows(texts, end)
    some = np.flatnonzero((w.number + first[w.owner]) % ROUNDS == k)
    for at in range(0, len(some), TASK_WINDOWS):
        yield w.take(some[at : at + TASK_WINDOWS])


def _train_attention(encoded: DataFrame, tables: Tables) -> Parameters:
    """Rounds in which each task descends from the same parameters over its windows; their mean, weighted by windows, begins the next round."""
    spark, end = encoded.sparkSession, len(tables.target) - 1
    sent = spark.sparkContext.broadcast(tables)

    # which round trains on a window: from a place that the text itself decides, so that short texts take part as often as long ones
    texts = encoded.where("NOT held_out").select(F.pmod(F.xxhash64("ids"), F.lit(ROUNDS)).alias("first"), "ids")
    windows = texts.agg(F.coalesce(F.sum(F.ceil((F.octet_length("ids") / 2 + 1) / STRIDE)), F.lit(0))).first()[0]
    p, tasks = fresh_parameters(), max(1, int(windows) // (ROUNDS * TASK_WINDOWS))
    for k in range(ROUNDS):
        start = spark.sparkContext.broadcast(flat(p))

        def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, n = shaped(start.value), 0
            for b in batches:
                for rows in round_windows(_ids(b.column(1)), b.column(0).to_numpy(), k, end):
                    own = descend(own, sent.value, rows, n)
                    n += len(rows)
            values = flat(own)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values.astype(np.float64) * n), pa.array(np.full(len(values), n))], names=["at", "value", "n"])

        sums = texts.coalesce(tasks).mapInArrow(learn, "at long, value double, n long").groupBy("at").agg((F.sum("value") / F.sum("n")).alias("value")).toArrow().sort_by("at")
        if sums.num_rows:
            p = shaped(sums["value"].to_numpy())
        start.destroy()
    return p


def train(encoded: DataFrame, size: int) -> Model:
    """The model of the rows of ``encoded`` (ids, held_out) that are not held out; ``size`` ids, the last of them the end."""
    found = materialize(neighbours(encoded, size - 1), "neighbours")
    before, behind = _tables(found, lambda a, b: [b * BINS + bin_of(a), a * BINS + bin_of(b)], [size * BINS] * 2)
    n = before.reshape(size, BINS).sum(axis=1)
    target, source = classes_of(before.reshape(size, BINS)), classes_of(behind.reshape(size, BINS))
    group = target.copy()
    often = np.argsort(-n[:-1], kind="stable")[: GROUPS - CLASSES]
    group[often] = np.arange(CLASSES, CLASSES + len(often))
    after, pairs = _tables(found, lambda a, b: [a * CLASSES + target[b], group[a] * size + b], [size * CLASSES, GROUPS * size])
    tables = Tables(target, source, class_shares(after.reshape(size, CLASSES), n, target))
    some = np.flatnonzero(pairs)
    return Model(tables, group, n, some.astype(np.int32), pairs[some], _train_attention(encoded, tables))


def class_shares(after: np.ndarray, n: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log shares of target classes after each id, with the shares in all texts added with weight `AFTER_ID`."""
    prior = np.bincount(target, weights=n + SMOOTH, minlength=CLASSES) + 1e-3
    return np.log((after + AFTER_ID * prior / prior.sum()) / (after.sum(axis=1, keepdims=True) + AFTER_ID)).astype(np.float32)


def id_shares(row: np.ndarray, n: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log shares of ids within their class by their counts after a group, with the shares in all texts added with weight `AFTER_GROUP`."""
    raised = n + SMOOTH
    alone = AFTER_GROUP * raised / np.bincount(target, weights=raised, minlength=CLASSES)[target]
    return np.log((row + alone) / (np.bincount(target, weights=row, minlength=CLASSES)[target] + AFTER_GROUP))


# -------------------------------------------------------------------- words


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def pieces(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of pieces of a column of about `_PIECE` bytes."""
    ends = np.cumsum(np.maximum(pc.binary_length(column).to_numpy(zero_copy_only=False), 1)) // _PIECE
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(column)]
    return ((a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (runs of bytes other than 0x20 and 0x09-0x0D), and how many each text has."""
    parts = pc.ascii_split_whitespace(texts)
    offsets, flat = parts.offsets.to_numpy() - parts.offsets[0].as_py(), parts.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty part
    upto = np.concatenate([[0], np.cumsum(real)])
    return flat.filter(pa.array(real)), np.diff(upto[offsets])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of the column text, and the end as the empty word; tasks add up before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in pieces(b.column(0)):
                found = split_words(b.column(0).slice(at, n))[0].value_counts()
                words, counts = found.field("values").cast(pa.binary()), found.field("counts")
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([b""])]), pa.concat_arrays([counts, pa.array([n], pa.int64())])], names=["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _known_words(counts: DataFrame, most: int) -> tuple[dict[bytes, int], bool]:
    """The counts of the most frequent words, at most ``most`` of them, and whether these are all words."""
    level = F.floor(F.log2("c") * 16)
    sizes = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for at, n in sizes:
        if total + n > most:
            break
        total, least = total + n, at
    if least is None:
        return {}, not sizes
    found = counts.where(level >= least).select("word", "c").toArrow()
    return dict(zip(found["word"].to_pylist(), found["c"].to_pylist())), least == sizes[-1][0]


def score(docs: DataFrame, rank_path: str, pattern: str, known_words: int = KNOWN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    The base adds log10((c + 1) / (N + V + 1)) over words and the end; the
    score is the model's log10 probability. Null and empty texts are an end
    alone; null ids are not held out; repeated rows are texts like others.
    Other columns are ignored; an empty table gives no rows; without training
    texts all counts are 0.

    Counts of frequent words go to all workers; the words that a worker does
    not know are joined with their counts by shuffle, none of them frequent.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), ascii_lower(F.col(text_col)).alias("text"))
    counts = materialize(word_counts(rows.where("NOT held_out").select("text")), "word-counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("c"))), F.lit(0)).alias("ends")).collect()[0]
    below = float(np.log10(sums.n + sums.v + 1))
    known, complete = _known_words(counts, known_words)
    sent = spark.sparkContext.broadcast(known)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = WordTable(_encoding(rank_path, pattern), sent.value, complete, below), float(np.log10(sums.ends + 1)) - below

        item = pa.struct([("word", pa.binary()), ("n", pa.int64())])
        for b in batches:
            for at, n in pieces(b.column(1)):
                words, sizes = split_words(b.column(1).slice(at, n))
                code = words.dictionary_encode()
                names, codes = code.dictionary.cast(pa.binary()), code.indices.to_numpy().astype(np.int64)
                numbers, doc = table.look_up(names.to_pylist())[codes], np.repeat(np.arange(n), sizes)
                ids, ends = table.ids_of(numbers)
                cuts = np.append(0, ends)[np.concatenate([[0], np.cumsum(sizes)])] * 2
                state = table.state[numbers]
                base = np.bincount(doc, weights=table.base[numbers], minlength=n) + end
                known = np.bincount(doc[state > 0], minlength=n) + int(sums.ends > 0)
                strange, times = np.unique(doc[state < 0] * max(1, len(names)) + codes[state < 0], return_counts=True)
                owner, name = np.divmod(strange, max(1, len(names)))
                rare = pa.StructArray.from_arrays([names.take(pa.array(name)), pa.array(times)], fields=list(item))
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), rare)
                raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(ids.tobytes())])
                same = [b.column(i).slice(at, n) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(sizes + 1), pa.array(known), pa.array(base), raw, rare], names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "ids", "rare"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    numbered = rows.select("doc_id", "text", "held_out", F.monotonically_increasing_id().alias("row"))
    encoded = numbered.mapInArrow(encode, f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, ids binary, rare array<struct<word:binary,n:long>>")
    encoded = materialize(encoded, "encoded")
    sent.destroy()
    model = spark.sparkContext.broadcast(train(encoded.select("held_out", "ids"), _encoding(rank_path, pattern).n_vocab + 1))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.value.log10(_ids(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found)], names=[*b.schema.names[:-1], "score"])

    out = encoded.select("doc_id", "held_out", "row", "n_tokens", "n_known", "base", "ids").mapInArrow(judge, f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, score double")
    if not complete:
        rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(counts, "word", "left").select("row", "n", F.coalesce("c", F.lit(0)).alias("c"))
        more = rare.groupBy("row").agg(F.sum(F.col("n") * (F.log10(F.col("c") + 1) - below)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("found"))
        out = out.join(more, "row", "left").withColumn("base", F.col("base") + F.coalesce("more", F.lit(0.0))).withColumn("n_known", F.col("n_known") + F.coalesce("found", F.lit(0)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(sums.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
