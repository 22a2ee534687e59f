"""Source divergence audit: byte-level terms, counts per language and source, exact divergences.

Texts are cut into terms on concatenated UTF-8 buffers; equal slices are found
by hash and verified by their bytes. Counts are added up by Spark; buckets of
terms become sparse matrices (sources by terms) whose divergences are summed
per row. All shares and divergences are whole numbers, so the sums are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators.joins import lookup
from sparkloom.staging import materialize

#: A term is kept in a language where at least so many documents have it; so many terms a group are reported.
LEAST_DOCS, TERMS = 10, 10
#: Shares are counted in units of one to so many, each count raised by `PRIOR`.
UNIT, PRIOR = 1_000_000_000, 2
#: Bytes of text, and documents, whose terms are grouped at a time; counts that a bucket of terms should hold; sources compared with all others in a task.
PIECE, PIECE_DOCS, BUCKET_ROWS, BLOCK = 4 << 20, 1 << 16, 200_000, 256

_CODES = np.arange(256)
#: Whether a byte belongs to a term: letters A-Z and a-z, and all bytes of characters beyond ASCII.
IN_TERM = ((_CODES >= 0x41) & (_CODES <= 0x5A)) | ((_CODES >= 0x61) & (_CODES <= 0x7A)) | (_CODES >= 0x80)
LOWER = np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 32, _CODES).astype(np.uint8)

# ------------------------------------------------------------------- terms


def term_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms begin and end in a buffer of bytes."""
    inside = IN_TERM[text].astype(np.int8)
    edges = np.flatnonzero(np.diff(inside, prepend=0, append=0))
    return edges[::2], edges[1::2]


def group_slices(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """A number per slice, the same for equal bytes only, and the first slice of each number.

    Slices meet by hash; each is then compared byte by byte with the first of
    its hash, and those that differ are grouped by their bytes.
    """
    raw = text.tobytes()
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), dtype=np.uint64, count=len(starts))
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    if not len(first):
        return number, first
    length, model = ends - starts, starts[first][number]
    offset = np.concatenate([[0], np.cumsum(length)[:-1]])
    step = np.arange(int(length.sum())) - np.repeat(offset, length)
    other = np.minimum(np.repeat(model, length) + step, len(text) - 1)
    differ = np.add.reduceat(text[np.repeat(starts, length) + step] != text[other], offset) > 0
    differ |= length != length[first][number]
    more: dict[bytes, int] = {}
    for i in np.flatnonzero(differ).tolist():
        own = raw[starts[i] : ends[i]]
        if own not in more:
            more[own] = len(first)
            first = np.append(first, i)
        number[i] = more[own]
    return number, first


def piece_counts(texts: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of some texts, each of the group given for it."""
    text = LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    starts, ends = term_bounds(text)
    number, first = group_slices(text, starts, ends)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    doc = np.searchsorted(begins, starts, side="right") - 1
    key, n = np.unique((groups[doc] * max(1, len(first)) + number) * len(texts) + doc, return_counts=True)
    pair = key // len(texts)
    new = np.flatnonzero(np.diff(pair, prepend=-1))
    if not len(new):
        return new, [], new, new
    group, term = np.divmod(pair[new], len(first))
    raw, at = text.tobytes(), first[term]
    names = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
    return group, names, np.add.reduceat(n, new), np.diff(new, append=len(pair))


def long_text_counts(text: bytes) -> Counter:
    """Occurrences of the terms of one text, cut where no term is."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and IN_TERM[text[end]]:
            end += 1
        _, names, n, _ = piece_counts([text[at:end]], np.zeros(1, dtype=np.int64))
        found.update(dict(zip(names, n.tolist())))
        at = end
    return found


def _count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(langs, sources, names, n, docs):
        cols = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])

    for b in batches:
        known: dict[tuple[str, str], int] = {}
        groups = np.array([known.setdefault(k, len(known)) for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], dtype=np.int64)
        keys, at, texts = list(known), 0, b.column(2)
        while at < b.num_rows:
            piece, size = [], 0
            while at + len(piece) < b.num_rows and len(piece) < PIECE_DOCS and size <= PIECE:
                piece.append(texts[at + len(piece)].as_py())
                size += len(piece[-1])
            if len(piece[-1]) > PIECE:
                lang, source = keys[groups[at + len(piece) - 1]]
                c = long_text_counts(piece.pop())
                yield out([lang] * len(c), [source] * len(c), list(c), list(c.values()), [1] * len(c))
                long = 1
            else:
                long = 0
            if piece:
                g, names, n, docs = piece_counts(piece, groups[at : at + len(piece)])
                yield out([keys[i][0] for i in g.tolist()], [keys[i][1] for i in g.tolist()], names, n, docs)
            at += len(piece) + long


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term; nulls are empty strings."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)]
    rows = docs.select(cols[0].alias("lang"), cols[1].alias("source"), cols[2].cast("binary").alias("text"))
    found = rows.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ------------------------------------------------------------- divergences


def shares(count: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)), in steps of a thousand so that nothing overflows."""
    below = total + PRIOR * terms
    quotient, rest = np.zeros_like(count), count + PRIOR
    for _ in range(3):
        rest = rest * 1000
        quotient = quotient * 1000 + rest // below
        rest = rest % below
    return 1 + quotient


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q))."""
    d = p - q
    return d * d // (p + q)


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of a sparse matrix's values by row; rows may be empty. ``starts`` has one number more than rows."""
    out, full = np.zeros(len(starts) - 1, dtype=np.int64), np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = np.add.reduceat(values, starts[full])
    return out


def pair_sums(block: range, starts: np.ndarray, columns: np.ndarray, p: np.ndarray, absent: np.ndarray, width: int) -> np.ndarray:
    """Divergence of each row of ``block`` from each row, summed over all columns.

    ``p`` holds the shares of the entries, ``absent`` that of a row's missing
    ones. Where the other row has entries they are compared with this row
    spread out; its missing ones differ from the distinct shares of this row.
    """
    row = np.repeat(np.arange(len(absent)), np.diff(starts))
    out = np.zeros((len(block), len(absent)), dtype=np.int64)
    for at, i in enumerate(block):
        own = np.full(width, absent[i])
        own[columns[starts[i] : starts[i + 1]]] = p[starts[i] : starts[i + 1]]
        here = own[columns]
        out[at] = row_sums(divergence(here, p) - divergence(here, absent[row]), starts)
        value, times = np.unique(own, return_counts=True)
        for lo in range(0, len(absent), 1024):
            out[at, lo : lo + 1024] += divergence(value[:, None], absent[None, lo : lo + 1024]).T @ times
    return out


def audit_bucket(key: tuple, entries: pa.Table, groups: pa.Table, size: int) -> pa.Table:
    """Part of the pair sums, and the best terms, of one block of sources over one bucket of terms."""
    groups = groups.sort_by("source")
    sources = groups["source"].to_pylist()
    number = {s: i for i, s in enumerate(sources)}
    total, terms, lang_total = (groups[c].to_numpy() for c in ("total", "terms", "lang_total"))
    block = range(key[2].as_py() * size, min(len(sources), (key[2].as_py() + 1) * size))
    entries = entries.select(["source", "term", "n", "lang_n"]).sort_by([("term", "ascending")])
    row = np.array([number[s] for s in entries["source"].to_pylist()], dtype=np.int64)
    code = entries["term"].combine_chunks().dictionary_encode()
    names, columns = code.dictionary, code.indices.to_numpy().astype(np.int64)
    order = np.argsort(row, kind="stable")  # by rows, and terms in their order within a row
    row, columns = row[order], columns[order]
    starts = np.searchsorted(row, np.arange(len(sources) + 1))
    n, lang_n = (entries[c].to_numpy()[order] for c in ("n", "lang_n"))
    p = shares(n, total[row], terms[row])
    absent = shares(np.zeros_like(total), np.maximum(total, 1 - terms), terms)  # without terms there is no column to compare
    sums = pair_sums(block, starts, columns, p, absent, len(names))
    out: list[tuple[int, str, str | None, int]] = [(i, "pair", sources[j], int(sums[at, j])) for at, i in enumerate(block) for j in range(len(sources)) if i != j]
    q = shares(lang_n, lang_total[row], terms[row])
    f = divergence(p, q)
    for i in block:
        own = np.arange(starts[i], starts[i + 1])
        own = own[p[own] > q[own]]
        out += [(i, "term", names[columns[k]].as_py(), int(f[k])) for k in own[np.lexsort((columns[own], -f[own]))][:TERMS].tolist()]
    lang = [key[0].as_py()] * len(out)
    return pa.table({"lang": pa.array(lang, pa.string()), "source": pa.array([sources[o[0]] for o in out], pa.string()), "part": pa.array([o[1] for o in out], pa.string()), "item": pa.array([o[2] for o in out], pa.string()), "value": pa.array([o[3] for o in out], pa.int64())})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, bucket_rows: int = BUCKET_ROWS, block: int = BLOCK, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of each language are apart.

    Part ``pair`` has the divergence from every other source of the language,
    part ``term`` the `TERMS` terms that a source has most in excess of its
    language. Ranks follow falling values, then rising items.

    Nulls in lang, source and text are empty strings, a source and a language
    like others; repeated rows are documents of their own; groups without terms
    are compared by the shares of absent terms; in a language without kept
    terms all sources are 0 apart. Other columns are ignored; an empty table
    gives no rows. Very long texts are cut between terms. Tasks hold one bucket
    of terms with the sources of its language.
    """
    of_term = W.partitionBy("lang", "term")  # at most a row for each source of the language
    counts = term_counts(docs, lang_col, source_col, text_col)
    counts = counts.withColumn("lang_docs", F.sum("docs").over(of_term)).where(F.col("lang_docs") >= least_docs)
    kept = counts.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("lang_n"), (F.min("source").over(of_term) == F.col("source")).cast("long").alias("first"))
    kept = materialize(kept, "kept-terms")
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]
    every = docs.select(*names).distinct().select("*", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("first"), F.lit(0).alias("entry"))
    groups = every.unionByName(kept.select("lang", "source", "n", "first", F.lit(1).alias("entry")))
    groups = materialize(groups.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("first"), F.sum("entry").alias("entries")), "term-groups")
    langs = groups.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("total").alias("lang_total"), F.ceil(F.sum("entries") / bucket_rows).alias("buckets"), F.ceil(F.count("*") / block).alias("blocks"))
    langs = materialize(langs.withColumn("buckets", F.greatest(F.col("buckets"), F.lit(1))), "term-langs")

    def spread(to: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(to) - 1))

    keys = ["lang", "bucket", "block"]
    entries = lookup(kept, langs, "lang").select("lang", "source", "term", "n", "lang_n", F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket"), spread("blocks").alias("block"))
    with_lang = lookup(groups, langs, "lang").select("lang", "source", "total", "terms", "lang_total", "blocks", spread("buckets").alias("bucket")).select("*", spread("blocks").alias("block"))
    parts = entries.groupBy(*keys).cogroup(with_lang.groupBy(*keys)).applyInArrow(lambda k, e, g: audit_bucket(k, e, g, block), "lang string, source string, part string, item string, value long")
    sums = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return sums.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= TERMS))
