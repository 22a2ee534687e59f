"""Token counts per section, from one encoding of each whole document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.bpe import library_codec

RULES = ("first", "last", "most")


def split_lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every line in characters; a line keeps its line feed."""
    sizes = np.fromiter(map(len, text.split("\n")), dtype=np.int64) + 1
    ends = np.cumsum(sizes)
    ends[-1] -= 1
    starts = ends - sizes
    starts[-1] += 1
    return (starts[:-1], ends[:-1]) if starts[-1] == ends[-1] and len(starts) > 1 else (starts, ends)


def attribute(start: np.ndarray, end: np.ndarray, section_start: np.ndarray, section_end: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Join token spans [start, end) to sorted disjoint sections and give each token to one section.

    Returns (tokens per section, of these the ones that cross a border); the
    last element is for tokens that meet no section. ``rule`` says who gets a
    token that meets several: the section of its "first" or "last" character,
    or the one that holds "most" of its characters (the first of these).
    A token inside one character is at that character.
    """
    n = len(section_start)
    lo = np.searchsorted(section_end, start, side="right")  # first section that ends after the token starts
    hi = np.searchsorted(section_start, np.maximum(end, start + 1), side="left") - 1  # last one that starts before it ends
    met = lo <= hi
    owner = np.where(met, {"first": lo, "last": hi, "most": lo}[rule], n)
    if rule == "most":
        for t in np.flatnonzero(met & (lo < hi)):
            s = np.arange(lo[t], hi[t] + 1)
            owner[t] = s[np.argmax(np.minimum(section_end[s], end[t]) - np.maximum(section_start[s], start[t]))]
    crossing = met & ((lo < hi) | (start < section_start[np.minimum(lo, n - 1)]) | (end > section_end[np.minimum(hi, n - 1)])) if n else met
    return np.bincount(owner, minlength=n + 1), np.bincount(owner[crossing], minlength=n + 1)


@lru_cache(maxsize=4)
def _token_bytes(json_path: str) -> np.ndarray:
    """UTF-8 bytes of each id: a byte-level vocabulary writes one character per byte; added tokens are themselves."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(json_path)
    added = tok.get_added_tokens_decoder()
    vocab = tok.get_vocab(with_added_tokens=True)
    size = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
    for token, i in vocab.items():
        size[i] = len(token.encode()) if i in added else len(token)
    return size


def token_spans(text: str, ids: np.ndarray, id_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character span of every token; a token that starts inside a character starts at it."""
    ends = np.cumsum(id_bytes[ids])
    starts = ends - id_bytes[ids]
    if text.isascii():
        return starts, ends
    first = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(first)])  # characters that begin before each byte
    begun = chars[np.minimum(starts + 1, len(first))] - 1
    return begun, chars[ends]


def count_by_section(
    docs: DataFrame, json_path: str, rank_path: str | None, pattern: str, rule: str = "first", sections: Column | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokens per section of every document, each document encoded once as a whole.

    ``sections`` is an array of (start, end) in characters, sorted and disjoint;
    by default every line is a section. Returns doc_id, section (from 0),
    start, end, n_tokens and n_crossing (tokens given to the section that reach
    beyond it), and a row with section -1 and null ends for tokens that meet no
    section, if there are any. The counts of a document add up to its tokens.

    Null text is the empty text, whose one line has no tokens; null sections
    are none. Null ids and repeated rows are documents like others; other
    columns are ignored; an empty table gives no rows. There is no shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    by_line = sections is None
    cols = [F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    rows = docs.select(*cols, *([] if by_line else [sections["start"].alias("starts"), sections["end"].alias("ends")]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = library_codec(json_path, rank_path, pattern), _token_bytes(json_path)
        for b in batches:
            texts, out = b.column(1), [[np.zeros(0, np.int64)] for _ in range(6)]
            for i, ids in enumerate(encode(t.as_py() for t in texts)):
                text = texts[i].as_py()
                if by_line:
                    lo, hi = split_lines(text)
                else:
                    lo, hi = (np.array(b.column(k)[i].as_py() or [], dtype=np.int64) for k in (2, 3))
                counts, crossing = attribute(*token_spans(text, ids, size), lo, hi, rule)
                n = len(lo) + int(counts[-1] > 0)
                number = np.arange(n)
                number[len(lo) :] = -1
                for o, v in zip(out, (np.full(n, i), number, np.append(lo, -1)[:n], np.append(hi, -1)[:n], counts[:n], crossing[:n])):
                    o.append(v)
                if len(out[0]) > 2000:
                    yield batch(b, out)
                    out = [[np.zeros(0, np.int64)] for _ in range(6)]
            yield batch(b, out)

    def batch(b: pa.RecordBatch, out: list[list[np.ndarray]]) -> pa.RecordBatch:
        row, number, lo, hi, counts, crossing = (np.concatenate(o).astype(np.int64) for o in out)
        none = number < 0
        arrays = [b.column(0).take(pa.array(row)), pa.array(number).cast(pa.int32()), pa.array(lo, mask=none), pa.array(hi, mask=none), pa.array(counts), pa.array(crossing)]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, section int, start long, end long, n_tokens long, n_crossing long")
