"""SimHash near-duplicates, searched by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.graph import connected_components
from sparkloom.operators.joins import lookup
from sparkloom.staging import materialize

BITS = 64
SHINGLE_WORDS = 3
HASH_SEED = 42
#: Shingles of a document that are hashed at a time.
_CHUNK = 1 << 18
#: Largest bucket whose members are compared in one task; larger ones are split by further masks.
BUCKET_MEMBERS = 2048
#: A bucket with at most so many bits open has at most BUCKET_MEMBERS words.
FEW_BITS = 11


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes) -> int:
    """The unsigned 64-bit SimHash of one UTF-8 text; 0 if it has no words."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)
    n = len(words) - SHINGLE_WORDS + 1
    counts = np.zeros(8 * 256, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        end = min(n, at + _CHUNK) + SHINGLE_WORDS - 1
        runs = zip(*(words[at + i : end - SHINGLE_WORDS + 1 + i] for i in range(SHINGLE_WORDS)))
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(b" ".join(r), HASH_SEED) for r in runs], dtype="<u8")
        # count byte values per byte position, then turn counts of values into counts of bits
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + _BYTE_BASE).ravel(), minlength=8 * 256)
    ones = counts.reshape(8, 256) @ _BITS_OF_BYTE
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


_BYTE_BASE = np.arange(8, dtype=np.int64) * 256
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py() or b"") for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


# ------------------------------------------------------------------- covering


def covering_masks(radius: int, within: int = (1 << BITS) - 1) -> list[int]:
    """2**(radius+1) - 1 masks over the bits of ``within`` such that any two words at most ``radius`` bits apart there agree under one.

    The i-th bit gets a nonzero vector m(i) of radius+1 bits; the mask of a
    nonzero vector v keeps the bits with odd <m(i), v>. At most ``radius``
    differing bits span less than the whole space, so some v is orthogonal to
    them all: its mask hides every difference.
    """
    size = 1 << (radius + 1)
    bits = [i for i in range(within.bit_length()) if within >> i & 1]
    code = {bit: i % (size - 1) + 1 for i, bit in enumerate(bits)}
    return [sum(1 << bit for bit in bits if (code[bit] & v).bit_count() & 1) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def near_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all pairs within ``radius`` bits.

    ``fps`` is a written table of one distinct non-null long column, fp. Each
    fingerprint goes to one bucket per covering mask. Buckets of one are
    dropped, buckets of two need no second look at their members; larger ones
    are read in order, and each yields a spanning forest instead of its pairs.
    A bucket over BUCKET_MEMBERS is never held in one task: the bits that its
    members share stay fixed, and the rest are covered by masks once more.
    """
    spark, links = fps.sparkSession, None
    full, open_masks = (1 << BITS) - 1, [0]
    frontier = fps.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in covering_masks(radius)))).alias("mask"))
    while open_masks:
        spread = frontier.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        buckets = spread.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        buckets = materialize(buckets.where("n > 1"), "simhash-buckets")
        found = buckets.where((F.col("n") == 2) & (_apart(F.col("a"), F.col("b")) <= radius)).select("a", "b")
        large = buckets.where("n > 2").select("mask", "key", "n")
        open_masks = []
        if not large.isEmpty():
            members = materialize(lookup(spread, large, ["mask", "key"]), "simhash-members")
            # of words that agree in all but a few bits there are too few to be split further, and some masks would add no bit
            huge = (F.col("n") > BUCKET_MEMBERS) & (F.bit_count("mask") < BITS - max(FEW_BITS, 1 << radius))
            found = found.union(_forest(members.where(~huge), radius))
            frontier = materialize(members.where(huge).select("mask", "fp").distinct(), "simhash-huge")
            open_masks = [r.mask & full for r in frontier.select("mask").distinct().collect()]  # masks of levels above, 15 for each
            finer = [(_signed(m), _signed(m | n)) for m in open_masks for n in covering_masks(radius, full & ~m)]
            finer = spark.createDataFrame(finer, "mask long, finer long")
            # different masks may lead to one
            frontier = frontier.join(F.broadcast(finer), "mask").select("fp", F.col("finer").alias("mask")).distinct()
        links = found if links is None else links.union(found)
    return links.distinct()


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _forest(members: DataFrame, radius: int) -> DataFrame:
    """Spanning stars of the links inside each bucket of bounded size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 3), dtype=np.int64)
        for b in batches:
            rows = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            rows = np.concatenate([rest, rows])
            new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            last = new[-1] if new.size else 0  # the bucket that the next batch may go on with
            rest = rows[last:]
            yield links([x[:, 2] for x in np.split(rows[:last], new[:-1])] if last else [])
        yield links([rest[:, 2]] if len(rest) else [])

    def links(buckets: list[np.ndarray]) -> pa.RecordBatch:
        found = [(f[root[i]], f[i]) for f in buckets for root in [spanning_roots(f, radius)] for i in np.flatnonzero(root != np.arange(len(f)))]
        a, b = np.array(found, dtype=np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    ordered = members.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key")
    return ordered.mapInArrow(run, "a long, b long")


def spanning_roots(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each position the smallest position in its component under the distance."""
    x, root = fps.view(np.uint64), np.arange(len(fps))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    while True:
        low = np.where(near, root, len(root)).min(axis=1)
        low = low[low]
        if (low == root).all():
            return root
        root = low


# -------------------------------------------------------------------- operator


def simhash_components(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate components of all documents: doc_id, fingerprint, component_id.

    Words are runs of anything but the six ASCII spaces, after lower-casing
    A-Z; a fingerprint is the SimHash of the XXH64 values of all 3-word
    shingles. Documents link at ``radius`` or fewer differing bits, and
    component_id is the smallest id that is reachable.

    Null and empty texts, and texts of spaces only, have fingerprint zero and
    link like others. Null ids take part without being chosen: component_id is
    null only if no member has an id. Repeated rows are members each. Other
    columns are ignored; an empty table gives no rows. Copies meet as one
    fingerprint before any search, so their number does not matter.
    """
    found = _labelled(docs, radius, id_col, text_col)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _labelled(docs: DataFrame, radius: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, fp, component_id, and label: a fingerprint of the component, which no other one has."""
    fps = materialize(with_fingerprints(docs, id_col, text_col), "simhash-fps")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    labels = connected_components(near_links(classes.select("fp"), radius), "a", "b").withColumnRenamed("node", "fp")
    linked = materialize(labels.join(classes, "fp"), "simhash-linked")
    firsts = materialize(linked.groupBy("label").agg(F.min("first_id").alias("least")), "simhash-firsts")
    linked = lookup(linked.select("fp", "label"), firsts, "label")
    component = F.when(F.col("label").isNotNull(), F.col("least")).otherwise(F.col("first_id"))
    classes = classes.join(linked, "fp", "left").select("fp", component.alias("component_id"), F.coalesce("label", "fp").alias("label"))
    return lookup(fps, materialize(classes, "simhash-labelled"), "fp").select("doc_id", "fp", "component_id", "label")


def keep_one_of_each(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of the smallest id of each component, with all its columns.

    Rows are told apart by id and fingerprint: an id that repeats in another
    component is another row, and of rows that repeat both one stays. A row
    without an id stays only where its component has no id.
    """
    from sparkloom.llm.rows import drop_rows

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t or b"") for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64))

    found = materialize(_labelled(docs, radius, id_col, text_col).select("doc_id", F.col("fp").alias("digest"), "label"), "simhash-found")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    best = materialize(found.groupBy("label").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1"), "simhash-best")
    gone = lookup(found, best, "label", row_bytes=64).where(order != F.col("best"))
    repeated = found.groupBy("doc_id", "digest").count().where("count > 1")
    return drop_rows(docs, gone, repeated, id_col, fp(F.col(text_col).cast("binary")))
