"""Byte-level BPE on whole texts: splitting with caches, and a numpy merge loop.

A text is first cut at single spaces between two non-space characters. A match
of the split pattern never crosses such a place (only its first character may
be a space), so each chunk is encoded by itself, and equal chunks once.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

_TWO_SPACES = re.compile(r"\s\s")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Characters of text that are encoded together; longer texts are cut at a safe space.
_TOGETHER = 1 << 20
#: Distinct chunks and ids that a worker remembers between batches of texts.
_CACHED_CHUNKS, _CACHED_IDS = 120_000, 1_000_000
#: Pieces over this many bytes leave the matrices for a heap: a row of a matrix costs the square of its length.
_MATRIX_BYTES = 256
_CELLS = 1 << 20
_NONE = np.int32(np.iinfo(np.int32).max)


def segments(text: str, size: int = _TOGETHER) -> Iterator[str]:
    """Cut a text into parts of about ``size`` characters at safe spaces; a part after the first starts with its space."""
    at = 0
    while len(text) - at > size:
        found = _SAFE_SPACE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class _Codes(dict):
    """Chunk -> code; a chunk not seen before gets the encoder's next code and waits to be encoded."""

    def __init__(self, encoder: ChunkEncoder, prefix: str):
        self.encoder, self.prefix = encoder, prefix

    def __missing__(self, chunk: str) -> int:
        code = self[chunk] = len(self.encoder.size) + len(self.encoder.new)
        self.encoder.new.append(self.prefix + chunk)
        return code


def take_runs(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after the other."""
    end = np.cumsum(size)
    return flat[np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)]


class ChunkEncoder:
    """Encode texts chunk by chunk; ``encode_new`` gives the ids of distinct chunks, one after the other, and their numbers."""

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode_new = encode_new
        self._forget()

    def _forget(self) -> None:
        self.new: list[str] = []
        self.head, self.tail = _Codes(self, ""), _Codes(self, " ")
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _codes(self, part: str) -> np.ndarray:
        """The chunks of a segment. All but the first stand for themselves with a space before them."""
        safe = _TWO_SPACES.search(part) or part[:1].isspace() or part[-1:].isspace()
        chunks = _SAFE_SPACE.split(part) if safe else part.split(" ")
        out = np.fromiter(map(self.tail.__getitem__, chunks[1:]), dtype=np.int64, count=len(chunks) - 1)
        return np.concatenate([[self.head[chunks[0]]], out])

    def _learn(self) -> None:
        if not self.new:
            return
        ids, size = self.encode_new(self.new)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, ids])
        self.new = []

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        return take_runs(self.flat, self.start[codes], self.size[codes])

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each whole text, in order, texts of about ``_TOGETHER`` characters at a time."""
        waiting: list[list[np.ndarray]] = []
        held = 0
        for text in texts:
            parts: list[np.ndarray] = []
            for part in segments(text):
                parts.append(self._codes(part) if part else np.zeros(0, np.int64))
                held += len(part)
            waiting.append(parts)
            if held >= _TOGETHER:
                yield from self._flush(waiting)
                waiting, held = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list[list[np.ndarray]]) -> Iterator[np.ndarray]:
        self._learn()
        for parts in waiting:
            yield self._gather(parts[0]) if len(parts) == 1 else np.concatenate([self._gather(p) for p in parts])
        if len(self.size) > _CACHED_CHUNKS or len(self.flat) > _CACHED_IDS:
            self._forget()


# --------------------------------------------------------------- rank files


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> id of their concatenation, by open addressing in numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, value = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        self.bits = max(4, (4 * len(value)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, _NONE, dtype=np.int32)
        keys, slot = (left << 32) | right, None
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while todo.size:
            free = self.keys[slot[todo]] == -1
            want = todo[free]
            _, firsts = np.unique(slot[want], return_index=True)
            put = want[firsts]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], value[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            taken = self.keys[slot[todo]] != keys[todo]
            slot[todo[taken]] = (slot[todo[taken]] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged pairs, or ``_NONE``; ids below 0 stand for no token."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(keys.shape, _NONE, dtype=np.int32)
        slot = self._slot(keys)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        while at.size:
            held = self.keys[slot[at]]
            hit = held == keys[at]
            out[at[hit]] = self.values[slot[at[hit]]]
            at = at[~hit & (held != -1)]
            slot[at] = (slot[at] + 1) & ((1 << self.bits) - 1)
        return out


class MatrixBpe:
    """Byte-pair merging of many pieces at once, by ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and the number of each.

        A piece that is a token is its rank; others are what merging leaves.
        """
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), dtype=np.int32, count=len(pieces))
        length = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        found = [(np.flatnonzero(whole >= 0), np.ones(int((whole >= 0).sum()), np.int64), whole[whole >= 0])]
        for i in np.flatnonzero((whole < 0) & (length > _MATRIX_BYTES)):
            ids = self._by_heap(pieces[i])
            found.append((np.array([i]), np.array([len(ids)]), ids))
        rows = np.flatnonzero((whole < 0) & (length > 0) & (length <= _MATRIX_BYTES))
        rows = rows[np.argsort(length[rows], kind="stable")]  # rows of a matrix have nearly one length
        at = 0
        while at < len(rows):
            shortest = length[rows[at]]
            end = min(at + max(1, _CELLS // int(shortest)), int(np.searchsorted(length[rows], 1.25 * shortest + 1, side="right")))
            found += [(rows[at:end][n], size, ids) for n, size, ids in self._merge([pieces[i] for i in rows[at:end]], length[rows[at:end]])]
            at = end
        which, size, flat = (np.concatenate(x) for x in zip(*found))
        sizes, starts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        sizes[which], starts[which] = size, np.cumsum(size) - size
        return take_runs(flat, starts, sizes), sizes

    def _merge(self, pieces: list[bytes], size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Every row merges its leftmost pair of minimum rank in each round; rows without a pair leave.

        Yields (rows, their numbers of ids, their ids) as they leave.
        """
        width = int(size.max())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < size[:, None], self.bytes[raw], np.int32(-1))
        rank = np.full(ids.shape, _NONE, dtype=np.int32)
        rank[:, :-1] = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        row = np.arange(len(ids))
        while row.size:
            at = rank.argmin(axis=1)
            low = rank[np.arange(len(row)), at]
            done = np.flatnonzero(low == _NONE)
            if done.size:
                real = ids[done] >= 0
                yield row[done], real.sum(axis=1), ids[done][real]
            keep = np.flatnonzero(low != _NONE)
            row, at, low = row[keep], at[keep], low[keep]
            if not row.size:
                break
            n, cols = np.arange(len(row)), np.arange(ids.shape[1] - 1)
            # close the gap that the right half leaves, and drop finished rows and the last column
            source = cols + (cols > at[:, None])
            ids, rank = ids[keep[:, None], source], rank[keep[:, None], source]
            ids[n, at] = low
            right = np.where(at + 1 < ids.shape[1], ids[n, np.minimum(at + 1, ids.shape[1] - 1)], np.int32(-1))
            rank[n, at] = self.pairs(low, right)
            back = np.flatnonzero(at > 0)
            rank[back, at[back] - 1] = self.pairs(ids[back, at[back] - 1], low[back])

    def _by_heap(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, in n log n steps."""
        ids = self.bytes[np.frombuffer(piece, dtype=np.uint8)]
        first = self.pairs(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first != _NONE)]
        heapq.heapify(heap)
        ids = ids.tolist()
        n = len(ids)
        back, ahead = list(range(-1, n - 1)), list(range(1, n + 1))
        held = [int(r) for r in first] + [int(_NONE)]

        def price(i: int) -> None:
            j = ahead[i]
            held[i] = int(_NONE) if j >= n else int(self._pair(ids[i], ids[j]))
            if held[i] != _NONE:
                heapq.heappush(heap, (held[i], i))

        while heap:
            rank, i = heapq.heappop(heap)
            if held[i] != rank:
                continue
            j = ahead[i]
            ids[i], ahead[i], held[j], ids[j] = rank, ahead[j], int(_NONE) - 1, -1
            if ahead[j] < n:
                back[ahead[j]] = i
            price(i)
            if back[i] >= 0:
                price(back[i])
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def _pair(self, left: int, right: int) -> int:
        key, slot = (left << 32) | right, int(self.pairs._slot(np.array([(left << 32) | right]))[0])
        while (k := int(self.pairs.keys[slot])) != -1:
            if k == key:
                return int(self.pairs.values[slot])
            slot = (slot + 1) & ((1 << self.pairs.bits) - 1)
        return int(_NONE)


@lru_cache(maxsize=4)
def rank_codec(path: str, pattern: str) -> tuple[ChunkEncoder, list[bytes]]:
    """One encoder per worker for a rank file, and the bytes of each id."""
    ranks = load_ranks(path)
    merger, split = MatrixBpe(ranks), regex.compile(pattern)

    def encode_new(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        matches = list(map(split.findall, chunks))
        codes: dict[str, int] = {}
        for ps in matches:
            for p in ps:
                codes.setdefault(p, len(codes))
        flat, size = merger.encode([p.encode() for p in codes])
        count = np.fromiter(map(len, matches), dtype=np.int64, count=len(matches))
        code = np.fromiter((codes[p] for ps in matches for p in ps), dtype=np.int64, count=int(count.sum()))
        before = np.concatenate([[0], np.cumsum(size[code])])
        end = np.cumsum(count)
        return take_runs(flat, (np.cumsum(size) - size)[code], size[code]), before[end] - before[end - count]

    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ChunkEncoder(encode_new), tokens


_PLAIN = re.compile(r"[\u0000-ԯ]*\Z")


@lru_cache(maxsize=4)
def library_codec(json_path: str, rank_path: str | None, pattern: str) -> Callable[[Iterable[str]], Iterator[np.ndarray]]:
    """Encode texts as the tokenizers library does with ``json_path``, added tokens included.

    ``rank_path`` may name the same vocabulary as ranks. Chunks of characters
    below U+0530, whose classes every Unicode version agrees on, then go to the
    faster library; other chunks, and texts that hold an added token, go to the
    tokenizer itself.
    """
    with open(json_path, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens") or ()]
    quick = None

    @lru_cache(maxsize=1)
    def tokenizer():  # large, and seldom needed beside the ranks
        from tokenizers import Tokenizer

        return Tokenizer.from_file(json_path)

    def slow(text: str) -> list[int]:
        return tokenizer().encode(text, add_special_tokens=False).ids

    if rank_path:
        import tiktoken

        quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(rank_path), special_tokens={}).encode_ordinary

    def encode_new(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [quick(c) if quick and (c.isascii() or _PLAIN.match(c)) else slow(c) for c in chunks]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(size.sum())), size

    encoder = ChunkEncoder(encode_new)

    def encode(texts: Iterable[str]) -> Iterator[np.ndarray]:
        special: dict[int, str] = {}

        def plain() -> Iterator[str]:
            for i, t in enumerate(texts):
                if any(a in t for a in added):
                    special[i] = t
                    t = ""
                yield t

        for i, found in enumerate(encoder.encode(plain())):
            yield np.array(slow(special.pop(i)), dtype=np.int32) if i in special else found

    return encode
