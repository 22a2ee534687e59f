"""Byte-level BPE over a table: encode whole texts by a rank file, decode ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.bpe import rank_codec


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every whole text, without special tokens.

    Each match of ``pattern`` is encoded separately; a null text has no ids.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = rank_codec(rank_path, pattern)
        for b in batches:
            ids = list(encoder.encode(t.as_py() or "" for t in b.column(1)))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *ids])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_bytes(ids: np.ndarray, tokens: list[bytes]) -> bytes:
    """The bytes that the ids stand for."""
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def decode_ids(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and text of the rows of ``encode_texts``; bytes that are no UTF-8 become U+FFFD, null ids the empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tokens = rank_codec(rank_path, pattern)
        for b in batches:
            texts = [decode_bytes(np.array(x.as_py() or [], dtype=np.int64), tokens).decode("utf-8", "replace") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_digests(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids, and digest both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids are digested as little-endian unsigned 32-bit integers. Null and empty
    texts have no tokens and the digests of no bytes. Null ids and repeated
    rows are documents like others; other columns are ignored; an empty table
    gives no rows. There is no shuffle, and ids never leave the worker.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = rank_codec(rank_path, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in encoder.encode(t.as_py() or "" for t in b.column(1)):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(decode_bytes(ids, tokens)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
