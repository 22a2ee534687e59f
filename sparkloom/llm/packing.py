"""Packing token sequences: configuration linear program over the length histogram, then rounding.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the
driver; the plan it returns is as small, and pieces find their places by rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.bpe import library_codec
from sparkloom.staging import materialize

CAPACITY = 2048
#: Prior weights: how much dearer than its length a piece of full length is, so that long pieces fill what they can and short ones last.
LONG_FIRST = 1.0
#: Learning rate of the weights, and fillings that count as equal in price (one of them is drawn).
RATE, TIE = 0.05, 1e-4
#: Each column takes this share of what it could take; a column is near-best within this slack at first.
SHARE, SLACK = 0.5, 0.02
#: A filling without empty room is taken if it is worth at most this share less than the best one.
FULL = 0.05
#: A round that moves less than this share of the demand left counts as idle; after so many idle rounds the slack doubles.
PROGRESS, PATIENCE = 0.001, 3

# ------------------------------------------------------------------- the plan


def price_fill(price: np.ndarray, capacity: int, rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value that fills each room 0 .. capacity exactly, and the last length taken.

    ``price[l]`` is the value of one piece of length l; lengths of price 0 or
    less are left out. Rooms that cannot be filled have the value -inf. With
    ``rng`` one of the choices within `TIE` is drawn, so that different rooms
    are filled by different lengths.
    """
    best, last = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, dtype=np.int64)
    best[0] = 0.0
    sizes = np.flatnonzero(price > 0)
    value_of = price[sizes]
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    draws = rng.random(capacity + 1).tolist() if rng else None
    for room in range(1, capacity + 1):
        if n := fitting[room]:
            value = value_of[:n] + best[room - sizes[:n]]
            k = int(value.argmax())
            if draws and value[k] > -np.inf:
                ties = np.flatnonzero(value >= value[k] * (1 - TIE))
                k = ties[int(draws[room] * len(ties))]
            best[room], last[room] = value[k], sizes[k]
    return best, last


def unfold(last: np.ndarray, room: int) -> list[int]:
    """The lengths that fill ``room``."""
    out = []
    while room > 0:
        out.append(int(last[room]))
        room -= out[-1]
    return out


def dual_bound(demand: np.ndarray, price: np.ndarray, capacity: int) -> float:
    """No packing has fewer sequences: prices scaled so that no sequence is worth more than 1."""
    best = price_fill(price, capacity)[0].max()
    return float(demand @ price) / best if best > 0 else 0.0


def solve_lp(demand: np.ndarray, capacity: int, seed: int = 42) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Multiplicative weights for the covering program: min sum x_c, every length l covered ``demand[l]`` times.

    A length's weight falls exponentially with the share of its demand that is
    covered, against the mean share; its price is its length times its weight.
    Each round prices all configurations "one piece of length l and the best
    filling of the rest" by one knapsack dynamic program, lets the near-best
    ones cover a share of what they can, and drops lengths that are covered.
    Where rounds move little, more configurations count as near-best. So every
    length is covered exactly as often as demanded, and nothing need be scaled.

    Returns the solution and the last prices of all lengths. It is fractional
    only where fewer than one sequence is left to a configuration.
    """
    rng = np.random.default_rng(seed)
    size = np.arange(capacity + 1)
    d = demand.astype(float)
    rest, total = d.copy(), float(d @ size)
    x: dict[tuple[int, ...], float] = {}
    slack, idle = SLACK, 0
    prices = size.astype(float)
    while (rest > 0).any():
        share = np.divide(rest, d, out=np.zeros_like(d), where=d > 0)
        prices = size * (1 + LONG_FIRST * size / capacity) * np.exp(RATE * (share - float(rest @ size) / total))
        priced = np.where(rest > 0, prices, 0.0)
        best, last = price_fill(priced, capacity, rng)
        upto = np.maximum.accumulate(best)
        least, moved = (1 - slack) * upto[-1], 0.0
        for length in np.flatnonzero(priced)[::-1].tolist():
            if rest[length] <= 0:
                continue
            room = capacity - length
            if best[room] < upto[room] * (1 - FULL):
                room = int(best[: room + 1].argmax())
            if not priced[length] + best[room] >= least:
                continue
            config = sorted([length, *unfold(last, room)], reverse=True)
            kinds, times = np.unique(config, return_counts=True)
            most = float((rest[kinds] / times).min())
            step = max(1.0, np.floor(most * SHARE)) if most >= 1 else most if slack >= 1 else 0.0
            if step > 0:
                x[tuple(config)] = x.get(tuple(config), 0.0) + step
                rest[kinds] = np.maximum(rest[kinds] - step * times, 0.0)
                rest[kinds[rest[kinds] < 1e-9]] = 0.0
                moved += step
        idle = idle + 1 if moved <= PROGRESS * float(rest @ size) / capacity else 0
        if idle >= PATIENCE:
            idle, slack = 0, slack * 2
    return x, prices


class Plan:
    """Runs of sequences of one configuration: per run its first sequence and number of sequences, and (length, times) from offset 0 on."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences, self.runs = capacity, 0, []

    def add(self, config: Iterable[int], copies: int) -> None:
        kinds, times = np.unique(list(config), return_counts=True)
        self.runs.append((self.sequences, copies, kinds[::-1], times[::-1]))
        self.sequences += copies

    def slots(self) -> dict[str, np.ndarray]:
        """Where the pieces of each length go, by their rank among the pieces of that length.

        Rows (length, first rank, first sequence, pieces per sequence, offset), sorted.
        """
        used = np.zeros(self.capacity + 1, dtype=np.int64)
        rows = []
        for sequence, copies, kinds, times in self.runs:
            offset = 0
            for k, t in zip(kinds.tolist(), times.tolist()):
                rows.append((k, used[k], sequence, t, offset))
                used[k] += copies * t
                offset += k * t
        rows.sort()
        return dict(zip(("length", "rank", "sequence", "times", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 5).T))


def make_plan(histogram: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Pack ``histogram[l]`` pieces of each length l into few sequences.

    The program's solution is rounded down, configuration by configuration;
    what then remains is packed best-fit decreasing, into the room of the
    sequences so far first. Where best fit alone needs fewer sequences (which
    takes few pieces of few lengths), its packing is the plan.
    """
    plan = Plan(capacity)
    if not histogram.any():
        return plan
    whole, rest = floors(solve_lp(histogram, capacity)[0], histogram)
    packed = (_best_fit(rest, whole, capacity), _best_fit(histogram.astype(np.int64), {}, capacity))
    for config, n in min(packed, key=lambda held: sum(held.values())).items():
        plan.add(config, n)
    return plan


def floors(x: dict[tuple[int, ...], float], demand: np.ndarray) -> tuple[dict[tuple[int, ...], int], np.ndarray]:
    """Sequences per configuration of a solution rounded down, and the demand that they leave."""
    whole, rest = {c: int(v) for c, v in x.items() if v >= 1}, demand.astype(np.int64)
    for config, n in whole.items():
        kinds, times = np.unique(config, return_counts=True)
        rest[kinds] -= n * times
    return whole, rest


def _best_fit(demand: np.ndarray, open_: dict[tuple[int, ...], int], capacity: int) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing over counts: equal sequences are moved together."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    for config, n in open_.items():
        rooms.setdefault(capacity - sum(config), {})[config] = n
    for length in np.flatnonzero(demand)[::-1].tolist():
        left = int(demand[length])
        while left:
            room = min((r for r, held in rooms.items() if r >= length and held), default=None)
            if room is None:
                each = capacity // length
                for n, k in ((left // each, each), (1, left % each)):
                    if n and k:
                        at = rooms.setdefault(capacity - k * length, {})
                        at[(length,) * k] = at.get((length,) * k, 0) + n
                break
            config, n = next(iter(rooms[room].items()))
            each = min(room // length, left)
            moved = min(n, left // each)
            rooms[room][config] -= moved
            if not rooms[room][config]:
                del rooms[room][config]
            new = tuple(sorted([*config, *[length] * each], reverse=True))
            at = rooms.setdefault(room - each * length, {})
            at[new] = at.get(new, 0) + moved
            left -= moved * each
        demand[length] = 0
    return {c: n for held in rooms.values() for c, n in held.items() if n}


# ------------------------------------------------------------------- operator


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` tokens; only the first may be short."""
    n = -(-total // capacity)
    first = total - (n - 1) * capacity
    return [(0, first), *((first + i * capacity, capacity) for i in range(n - 1))]


def token_pieces(docs: DataFrame, codec: Callable[[], Callable], capacity: int, id_col: str, text_col: str, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank) of every document's ids and ``end_id``.

    ``rank`` numbers the pieces of one length within the task ``part``: write
    the table before using it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = codec(), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            rows: list[tuple[int, ...]] = []
            texts = (t.as_py() or "" for t in b.column(1))
            for i, ids in enumerate(encode(texts)):
                ids = np.append(ids, end_id).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((i, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, int(seen[length])))
                    seen[length] += 1
            if rows:
                cols = np.array(rows, dtype=np.int64).T
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0])), *(pa.array(c).cast(t) for c, t in zip(cols[1:], kinds))], names=_PIECE)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long")


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]


def pack(docs: DataFrame, json_path: str, rank_path: str | None, pattern: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    A document is its ids by the tokenizer file ``json_path`` and then id 0;
    longer ones are cut into pieces of ``capacity`` tokens, the first piece
    may be shorter. Returns per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Pieces of one sequence follow one another from offset 0.

    Null and empty texts are one piece of one token; null ids and repeated rows
    are documents like others; other columns are ignored; an empty table gives
    no rows. Texts are encoded once and never shuffled.
    """
    pieces = materialize(token_pieces(docs, lambda: library_codec(json_path, rank_path, pattern), capacity, id_col, text_col), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.max("rank").alias("top"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.groupBy("length").agg(F.sum(F.col("top") + 1)).collect():
        histogram[length] = n
    slots = make_plan(histogram, capacity).slots()
    before = F.coalesce(F.sum(F.col("top") + 1).over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = pieces.join(counts.select("part", "length", before.alias("before")), ["part", "length"])
    numbered = numbered.select(*_PIECE[:5], (F.col("before") + F.col("rank")).alias("rank"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (slots["length"] << 44) + slots["rank"]
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            nth = rank - slots["rank"][at]
            sequence = slots["sequence"][at] + nth // slots["times"][at]
            offset = slots["offset"][at] + nth % slots["times"][at] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*_PIECE[:5], "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
