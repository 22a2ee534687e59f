"""Approximate nearest neighbours by balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.staging import materialize

#: Vectors that the centroids are fitted on, at most (those with the smallest hash of their id).
SAMPLE_ROWS = 16_384
#: Vectors per list aimed at, and lists at most (the centroids are sent to every worker).
LIST_ROWS, MAX_LISTS = 256, 1024
#: A list is cut into blocks of about so many vectors, and its queries likewise: what one task holds.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 2048


@dataclass
class CentroidGraph:
    """Unit centroids and, for each, its near ones: searched greedily from node 0."""

    centroids: np.ndarray
    near: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray, degree: int = 16) -> CentroidGraph:
        n = len(centroids)
        d = 1 - centroids @ centroids.T
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, : max(1, min(degree, n - 1))]
        # a ring through all nodes, so that every node can be reached
        return cls(centroids, np.column_stack([near, (np.arange(n) + 1) % n, (np.arange(n) - 1) % n]))

    def search(self, x: np.ndarray, ratio: float, least: int) -> np.ndarray:
        """Distances (rows of x, centroids), infinite where the search did not come.

        Each row expands its nearest open node until that is farther than
        ``ratio`` times its nearest centroid and ``least`` centroids are nearer.
        """
        n, k = len(x), len(self.centroids)
        dist = np.full((n, k), np.inf)
        open_ = np.full((n, k), np.inf)
        dist[:, 0] = open_[:, 0] = self._distance(x, np.zeros((n, 1), np.int64))[:, 0]
        active, least = np.arange(n), min(least, k)
        while active.size:
            node = open_[active].argmin(axis=1)
            at = open_[active, node]
            bound = np.maximum(ratio * dist[active].min(axis=1), np.partition(dist[active], least - 1, axis=1)[:, least - 1])
            go = np.isfinite(at) & (at <= bound)
            active, node = active[go], node[go]
            open_[active, node] = np.inf
            to = self.near[node]
            new = ~np.isfinite(dist[active[:, None], to])
            d = self._distance(x[active], to)
            r, c = np.nonzero(new)
            dist[active[r], to[r, c]] = open_[active[r], to[r, c]] = d[r, c]
        return dist

    def _distance(self, x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nkd->nk", x, self.centroids[nodes])))

    def lists_to_hold(self, x: np.ndarray, ratio: float = 1.1, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the nearest list, and for boundary vectors further ones within ``ratio``.

        A further list is left out if one taken already is nearer to it than
        the vector is: the lists of a vector lie on different sides.
        """
        dist = self.search(x, ratio, most)
        order = np.argsort(dist, axis=1, kind="stable")[:, :most]
        d = np.take_along_axis(dist, order, axis=1)
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nid,njd->nij", self.centroids[order], self.centroids[order])))
        take = d <= ratio * d[:, :1]
        for j in range(1, order.shape[1]):
            take[:, j] &= ~(take[:, :j] & (between[:, j, :j] < d[:, j : j + 1])).any(axis=1)
        row, col = np.nonzero(take)
        return row, order[row, col]

    def lists_to_read(self, x: np.ndarray, ratio: float, held: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the nearest lists that hold ``need`` vectors together, and all within ``ratio`` times the farthest of these.

        ``held`` has the number of vectors of each list.
        """
        dist = self.search(x, ratio, 8)
        order = np.argsort(dist, axis=1, kind="stable")
        d, n = np.take_along_axis(dist, order, axis=1), np.cumsum(held[order], axis=1)
        last = np.take_along_axis(d, np.minimum((n < need).sum(axis=1, keepdims=True), d.shape[1] - 1), axis=1)
        row, col = np.nonzero(np.isfinite(d) & (d <= ratio * last))
        return row, order[row, col]


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Spherical k-means; a cluster over its share becomes less attractive, so sizes stay near each other."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    k = max(1, min(k, len(distinct)))
    c = distinct[rng.choice(len(distinct), k, replace=False)]
    toll = np.zeros(k)
    for _ in range(rounds):
        own = (sample @ c.T - toll).argmax(axis=1)
        size = np.bincount(own, minlength=k)
        toll = np.clip(toll + 0.02 * (size * k / len(sample) - 1), 0, 0.3)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw / np.abs(raw).max(axis=1, keepdims=True)  # no overflow in the square
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, ratio: float = 1.3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``, the ``k`` nearest other rows found, by cosine.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id.
    Every vector is filed under the nearest centroid, and near a boundary under
    a second one; a query reads the lists whose centroid is at most ``ratio``
    times as far as the nearest (if that holds fewer than ``k`` others, as the
    list with which they are ``k``); one that finds fewer still reads all lists.
    Scores are exact, in double precision, on the vectors as given. Lists are cut into blocks of bounded size, so copies of
    one vector in any number are spread over tasks.

    Vectors that are null, zero, or hold null or non-finite components take no
    part, nor rows without an id, nor vectors of another length than the most
    frequent one. Rows that repeat an id are one row: it never finds itself.
    Other columns are ignored; an empty table gives no rows.
    """
    spark, id_kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    out = f"query_id {id_kind}, vec_id {id_kind}, score double"
    rows = _valid(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim, total = (sizes[0].d, sizes[0]["count"]) if sizes else (1, 0)
    rows = rows.where(F.size("v") == dim)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toArrow().column(0)
    x = np.array(sample.combine_chunks().flatten()).reshape(-1, dim) if total else np.ones((1, dim))
    graph = spark.sparkContext.broadcast(CentroidGraph.build(fit_centroids(_unit(x), int(np.clip(total // LIST_ROWS, 1, MAX_LISTS)))))

    def matrix(column) -> np.ndarray:
        return np.array(column.flatten(), dtype=np.float64).reshape(-1, dim)

    def file(read: bool, held_by: np.ndarray | None = None):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    unit = _unit(matrix(part.column(1)))
                    row, lst = graph.value.lists_to_read(unit, ratio, held_by, k + 1) if read else graph.value.lists_to_hold(unit)
                    taken = part.take(pa.array(row))
                    raw = matrix(taken.column(1)).astype("<f8")
                    yield pa.RecordBatch.from_arrays([taken.column(0), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(lst.astype(np.int32))], names=["vec_id", "raw", "list"])

        return run

    filed = f"vec_id {id_kind}, raw binary, list int"
    postings = materialize(rows.mapInArrow(file(False), filed), "postings")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    # a few numbers per list: how many vectors it holds, into how many blocks these and its queries are cut
    counts = {r.list: r["count"] for r in postings.groupBy("list").count().collect()}
    lists = np.array([counts.get(i, 0) for i in range(len(graph.value.centroids))])
    reads = materialize(asked.mapInArrow(file(True, lists), filed), "ann-reads")
    spread = F.xxhash64("vec_id")

    def best(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({"query_id": q["query_id"][:0], "vec_id": v["vec_id"][:0], "score": np.zeros(0)})
        a, b = (np.frombuffer(b"".join(f["raw"]), dtype="<f8").reshape(-1, dim) for f in (q, v))
        qi, vi, s = top_pairs(a, q["query_id"].to_numpy(), b, v["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[qi], "vec_id": v["vec_id"].to_numpy()[vi], "score": s})

    def ranked(reads: DataFrame) -> DataFrame:
        turns = {r.list: -(-r["count"] // BLOCK_QUERIES) for r in reads.groupBy("list").count().collect()}
        cuts = spark.createDataFrame([(i, -(-n // BLOCK_ROWS), turns.get(i, 0)) for i, n in counts.items()], "list int, blocks int, turns int")
        held = postings.join(F.broadcast(cuts.where("turns > 0")), "list").select(
            "list", F.pmod(spread, F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "vec_id", "raw"
        )
        want = reads.join(F.broadcast(cuts), "list").select(
            "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(spread, F.col("turns")).cast("int").alias("turn"), F.col("vec_id").alias("query_id"), "raw"
        )
        key = ["list", "block", "turn"]
        found = want.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(best, out)
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # one vector in several lists
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = materialize(ranked(reads), "ann-found")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = materialize(reads.join(full, "vec_id", "left_anti").select("vec_id", "raw").distinct(), "ann-short")
    if len(counts) < 2 or short.isEmpty():
        return found
    # too few in the lists read: these queries read all lists
    every_list = F.broadcast(spark.createDataFrame([(i,) for i in counts], "list int"))
    again = ranked(materialize(short.crossJoin(every_list).select("vec_id", "raw", "list"), "ann-reads"))
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again).select("query_id", "rank", "vec_id", "score")


def top_pairs(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, cosine) of the k best vectors of each query, equal ids left out.

    A matrix product chooses, with room for its rounding; the score of a pair
    is then computed for itself, so it does not depend on the block.
    """
    near = _unit(q) @ _unit(v).T
    near[q_ids[:, None] == v_ids[None, :]] = -np.inf
    most = k * int(np.unique(v_ids, return_counts=True)[1].max())  # rows of one id count once
    floor = np.partition(near, -most, axis=1)[:, -most] if v.shape[0] > most else np.full(len(q), -2.0)
    qi, vi = np.nonzero(near >= np.maximum(floor, -2.0)[:, None] - 1e-9)
    s = cosine(q[qi], v[vi])
    order = np.lexsort((v_ids[vi], -s, qi))
    qi, vi, s = qi[order], vi[order], s[order]
    if most > k:
        again = pd.DataFrame({"q": qi, "v": v_ids[vi]}).duplicated().to_numpy()
        qi, vi, s = qi[~again], vi[~again], s[~again]
    first = np.searchsorted(qi, qi, side="left")
    keep = np.arange(len(qi)) - first < k
    return qi[keep], vi[keep], s[keep]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision.

    Each side is first scaled by a power of two to a largest component near 1,
    which is exact, so no square leaves the range of doubles.
    """
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
