"""Exact vector search: a stated query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.staging import materialize, size_checked

#: Queries and vectors that one task compares, the least vectors of a block, and the scores it holds at once.
QUERY_BLOCK, VECTOR_BLOCK, LEAST_BLOCK, HELD = 8192, 16384, 2048, 1 << 22
#: Rows of one of the two blocks that a task compares when all rows search among all.
SELF_BLOCK = 32768
#: Matrix products give scores this near to those summed in order; where that may matter the latter decide.
SLACK = 1e-9


def dot(a: Column, b: Column) -> Column:
    """Dot product of two numeric arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; null if one of them is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def scores(vectors: DataFrame, queries: Column, blocks: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score): cosine of each row for which ``queries`` holds with every other row.

    Queries are dealt to ``blocks`` by a hash of their id, and each vector meets each block once.
    Rows without an id, and vectors that are null or zero, take no part.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).select(id_col, v.alias(vec_col), F.sqrt(dot(v, v)).alias("__n")).where("__n > 0")
    q = rows.where(queries).select(F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("block"), F.col(id_col).alias("query_id"), F.col(vec_col).alias("__q"), F.col("__n").alias("__m"))
    v = rows.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.col(id_col).alias("vec_id"), F.col(vec_col).alias("__v"), "__n")
    return q.join(v, "block").where("query_id <> vec_id").select("query_id", "vec_id", (dot(F.col("__q"), F.col("__v")) / (F.col("__m") * F.col("__n"))).alias("score"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query; ties go to the smaller id. Rows are limited before the shuffle."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def diverse_top_k(scored: DataFrame, vectors: DataFrame, k: int = 3, near: float = 0.97, pool: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Greedy selection down the ranking: a row at least ``near`` to a chosen one is passed over.

    The ``pool`` best rows of each query are tried first, kept as one sorted
    array; queries that find fewer than k among them choose in k rounds over
    their whole ranking.
    """
    vecs = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"))
    best = top_k(scored, pool).join(vecs, "vec_id")
    ranked = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", "v"))).alias("a"))
    none = F.slice(F.col("a"), 1, 0)
    take = lambda acc, x: F.when((F.size(acc) < k) & ~F.exists(acc, lambda y: cosine(y["v"], x["v"]) >= near), F.array_append(acc, x)).otherwise(acc)
    chosen = ranked.select("query_id", (F.size("a") >= pool).alias("more"), F.aggregate("a", none, take).alias("x"))
    chosen = materialize(chosen.select("query_id", ((F.size("x") < k) & F.col("more")).alias("open"), F.transform("x", lambda x: F.struct(x["vec_id"], x["score"])).alias("x")), "diverse-pool")
    done = chosen.where("NOT open").select("query_id", F.posexplode("x").alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), "x.vec_id", "x.score")
    rest = scored.select("query_id", "vec_id", "score").join(size_checked(chosen.where("open").select("query_id")), "query_id", "left_semi")
    if chosen.where("open").isEmpty():
        return done
    for rank in range(1, k + 1):
        first = rest.groupBy("query_id").agg(F.max_by(F.struct("vec_id", "score"), F.struct("score", -F.col("vec_id"))).alias("x")).select("query_id", F.lit(rank).alias("rank"), "x.*")
        first = materialize(first, "diverse-first")
        done = done.unionByName(first)
        if rank < k:
            against = first.join(vecs, "vec_id").select("query_id", F.col("v").alias("__c"))
            rest = rest.join(vecs, "vec_id").join(against, "query_id").where(~(cosine(F.col("__c"), F.col("v")) >= near)).select("query_id", "vec_id", "score")
            rest = materialize(rest, "diverse-rest")
    return done


# ------------------------------------------------------- search by matrix products


def rows_of(vectors: DataFrame, name: str = "vec_id", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(``name``, v): rows with an id and a vector that is neither null nor zero, and holds no null."""
    v = F.col(vec_col).cast("array<double>")
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (dot(v, v) > 0)).select(F.col(id_col).alias(name), v.alias("v"))


def _per_block(queries: DataFrame, vectors: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` on each block of queries and each block of vectors of the same length: one task a pair of blocks, of bounded size."""
    spark = queries.sparkSession
    n, m = queries.count(), vectors.count()
    across = max(1, -(-n // QUERY_BLOCK))
    down = max(1, -(-m // VECTOR_BLOCK), min(-(-m // LEAST_BLOCK), -(-4 * spark.sparkContext.defaultParallelism // across)))
    keys = ["qb", "vb", "dim"]
    block = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    q = queries.select("*", F.size("v").alias("dim"), block("query_id", across).alias("qb"), every(down).alias("vb"))
    v = vectors.select("*", F.size("v").alias("dim"), block("vec_id", down).alias("vb"), every(across).alias("qb"))
    dealt = lambda t: t.repartition(min(across * down, 4096), *keys).groupBy(*keys)
    empty = spark.createDataFrame([], schema).toArrow()

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left.combine_chunks(), right.combine_chunks()) if left.num_rows and right.num_rows else empty

    return dealt(q).cogroup(dealt(v)).applyInArrow(both, schema)


def _matrix(table: pa.Table, name: str = "v") -> np.ndarray:
    """A column of arrays (of arrays) of one length as a matrix, a row for each row."""
    flat = table[name].chunk(0)
    while pa.types.is_list(flat.type):
        flat = flat.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first to the last component as `dot` does: equal rows give equal sums."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


class _Side:
    """The rows of one block, their norms, and the rows at length one."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.norm = rows, np.sqrt(_summed(rows, rows))
        with np.errstate(all="ignore"):
            self.unit = rows / self.norm[:, None]

    def cosine(self, at: np.ndarray, other: _Side, to: np.ndarray) -> np.ndarray:
        """Of the rows ``at`` with the rows ``to`` of the other side, exactly as `scores` gives it."""
        out = np.empty(len(at))
        with np.errstate(all="ignore"):
            for k in range(0, len(at), 1 << 16):
                i, j = at[k : k + (1 << 16)], to[k : k + (1 << 16)]
                out[k : k + (1 << 16)] = _summed(self.rows[i], other.rows[j]) / (self.norm[i] * other.norm[j])
        return out


def _same(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with a[i] == b[j]."""
    order = np.argsort(a, kind="stable")
    first, last = (np.searchsorted(a[order], b, side) for side in ("left", "right"))
    n = last - first
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return order[np.repeat(first, n) + inside], np.repeat(np.arange(len(b)), n)


def _ids(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


#: Turns scores into what is ranked: (scores, query ids, the query's two numbers, vector ids), which broadcast, to the ranked values.
Adjust = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def nearest(queries: DataFrame, vectors: DataFrame, k: int, adjust: Adjust | None = None, near: float | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best rows of ``vectors`` (vec_id, v) for each of ``queries`` (query_id, v), its own id left out.

    Scores are cosines; ties go to the smaller id. Vectors are compared with
    those of the same length. ``adjust`` changes scores with two numbers of the
    query (columns center and spread). With ``near``, vectors of which the
    cosine with one of the query's ``chosen`` vectors reaches it are passed over.

    A task holds a block of queries, a block of vectors and a part of their
    scores; it gives k rows a query. Rows that may be among these by the matrix
    product are scored again in the order of `dot`, so results do not depend on
    the blocks.
    """
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        qi, vi = _ids(left, "query_id"), _ids(right, "vec_id")
        q, v = _Side(_matrix(left)), _Side(_matrix(right))
        two = [_ids(left, c) for c in ("center", "spread")] if adjust else []
        dim = v.rows.shape[1]
        chosen = _matrix(left, "chosen").reshape(len(qi), -1, dim) if near is not None and "chosen" in left.column_names else np.zeros((len(qi), 0, dim))
        chosen = [_Side(np.ascontiguousarray(chosen[:, r])) for r in range(chosen.shape[1])]
        at, to, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        least, step = np.full(len(qi), -np.inf), max(k, HELD // len(qi))
        for first in range(0, len(vi), step):
            part = slice(first, first + step)
            some = v.unit[part].T
            with np.errstate(all="ignore"):
                s = q.unit @ some
            if adjust:
                s = adjust(s, qi[:, None], *(x[:, None] for x in two), vi[None, part])
            s[np.isnan(s)] = np.inf
            s[_same(qi, vi[part])] = -np.inf
            for c in chosen:
                with np.errstate(all="ignore"):
                    d = c.unit @ some
                over = ~(d < near - SLACK)
                i, j = np.nonzero(over & (d < near + SLACK))
                over[i, j] = ~(c.cosine(i, v, j + first) < near)
                s[over] = -np.inf
            if s.shape[1] > k:
                least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
            with np.errstate(all="ignore"):
                slack = np.where(np.isinf(least), 0.0, SLACK * np.maximum(1.0, np.abs(least)))
            i, j = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
            j = j + first
            exact = q.cosine(i, v, j)
            if adjust:
                exact = adjust(exact, qi[i], *(x[i] for x in two), vi[j])
            at, to, score = np.concatenate([at, i]), np.concatenate([to, j]), np.concatenate([score, exact])
            order = np.lexsort((vi[to], -np.where(np.isnan(score), np.inf, score), at))
            at, to, score = at[order], to[order], score[order]
            start = np.searchsorted(at, at, "left")
            keep = np.arange(len(at)) - start < k
            at, to, score = at[keep], to[keep], score[keep]
            full = np.flatnonzero(np.arange(len(at)) - np.searchsorted(at, at, "left") == k - 1)
            least[at[full]] = np.where(np.isnan(score[full]), np.inf, score[full])
        return pa.table({"query_id": left["query_id"].take(pa.array(at)), "vec_id": right["vec_id"].take(pa.array(to)), "score": pa.array(score)})

    return top_k(_per_block(queries, vectors, run, kinds), k)


def moments(queries: DataFrame, vectors: DataFrame, value: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, least: int = 3) -> DataFrame:
    """(query_id, center, spread): mean and standard deviation of the scores of each query, or of ``value`` of its id and those of the vectors.

    They are 0 and 1 under ``least`` rows or without a spread (of more than
    1e-12): standardised by them a number stays as it is.
    """
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, n long, m double, m2 double, lo double, hi double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        qi, vi = _ids(left, "query_id"), _ids(right, "vec_id")
        q, v = (None, None) if value else (_Side(_matrix(left)).unit, _Side(_matrix(right)).unit)
        n, m, m2 = np.zeros(len(qi)), np.zeros(len(qi)), np.zeros(len(qi))
        lo, hi = np.full(len(qi), np.inf), np.full(len(qi), -np.inf)
        step = max(1, HELD // len(qi))
        for first in range(0, len(vi), step):
            part = slice(first, first + step)
            s = value(qi[:, None], vi[None, part]).astype(float) if value else q @ v[part].T
            own = _same(qi, vi[part])
            fewer = s.shape[1] - np.bincount(own[0], minlength=len(qi))
            s[own] = np.inf
            lo = np.minimum(lo, s.min(axis=1))
            s[own] = -np.inf
            hi = np.maximum(hi, s.max(axis=1))
            s[own] = 0.0
            mean = s.sum(axis=1) / np.maximum(fewer, 1)
            s -= mean[:, None]
            s[own] = 0.0
            far, total = mean - m, np.maximum(n + fewer, 1)
            m2 += np.einsum("ij,ij->i", s, s) + far * far * n * fewer / total
            m += far * fewer / total
            n += fewer
        return pa.table({"query_id": left["query_id"], "n": pa.array(n.astype(np.int64)), "m": pa.array(m), "m2": pa.array(m2), "lo": pa.array(lo), "hi": pa.array(hi)})

    found = _per_block(queries, vectors, run, kinds).where("n > 0").groupBy("query_id")
    sums = found.agg(F.sum("n").alias("n"), (F.sum(F.expr("n*m")) / F.sum("n")).alias("m"), F.sum("m2").alias("m2"), F.sum(F.expr("n*m*m")).alias("mm"), (F.max("hi") - F.min("lo")).alias("range"))
    spread = F.sqrt(F.greatest(F.col("m2") + F.col("mm") - F.expr("n*m*m"), F.lit(0.0)) / F.col("n"))
    ok = (F.col("n") >= least) & (F.col("range") > 1e-12) & (spread > 0)
    return sums.select("query_id", F.when(ok, F.col("m")).otherwise(0.0).alias("center"), F.when(ok, spread).otherwise(1.0).alias("spread"))


def diverse(queries: DataFrame, vectors: DataFrame, k: int, near: float) -> DataFrame:
    """(query_id, rank, vec_id, score): greedy selection down each whole ranking; a row at least ``near`` to a chosen one is passed over.

    The row of each rank is the best of those that no row chosen before is
    near to, so there are k rounds of `nearest`, of one row a query.
    """
    open_, done, vecs = materialize(queries, "diverse-open"), None, materialize(vectors, "diverse-vectors")
    for rank in range(1, k + 1):
        first = materialize(nearest(open_, vecs, 1, near=near).select("query_id", F.lit(rank).alias("rank"), "vec_id", "score"), "diverse-first")
        done = first if done is None else done.unionByName(first)
        if rank < k:
            taken = vecs.join(size_checked(first.select("query_id", "vec_id")), "vec_id").select("query_id", F.col("v").alias("__c"))
            more = F.array(F.col("__c")) if rank == 1 else F.array_append("chosen", F.col("__c"))
            open_ = materialize(open_.join(taken, "query_id").select("query_id", "v", more.alias("chosen")), "diverse-open")
    return done


def mutual_nearest(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, score): rows of ``a`` (query_id, v) and ``b`` (vec_id, v) that are each other's best, ids of both sides unlike; ties to the smaller id.

    Backwards only the rows of ``b`` search that are the best of some row of ``a``.
    """
    ahead = materialize(nearest(a, b, 1).select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), "score"), "mutual-ahead")
    found = b.join(size_checked(materialize(ahead.select(F.col("b").alias("vec_id")).distinct(), "mutual-found")), "vec_id", "left_semi")
    back = nearest(found.withColumnRenamed("vec_id", "query_id"), a.withColumnRenamed("query_id", "vec_id"), 1)
    return ahead.join(back.select(F.col("query_id").alias("b"), F.col("vec_id").alias("a")), ["a", "b"])


def _best(at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the best score of each value of ``at``; NaN is the largest, ties go to the smaller id."""
    order = np.lexsort((ids, -np.where(np.isnan(score), np.inf, score), at))
    return order[np.diff(at[order], prepend=-1) > 0]


def nearest_of_each(vectors: DataFrame) -> DataFrame:
    """(query_id, vec_id, score): for each row of ``vectors`` (vec_id, v) the row of another id with the largest cosine; ties to the smaller id.

    Rows are dealt to blocks by a hash of their id, and a task compares two
    blocks (or one with itself) in both directions, so each pair of rows is
    compared once, and a row is sent once for each block. As in `nearest`, the
    order of `dot` decides where matrix products are near each other.
    """
    spark, id_kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    m, blocks = vectors.count(), 1
    while blocks * SELF_BLOCK < m or (blocks * LEAST_BLOCK < m and blocks * (blocks + 1) < 8 * spark.sparkContext.defaultParallelism):
        blocks += 1
    kinds = f"query_id {id_kind}, vec_id {id_kind}, score double"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own = table["block"].to_numpy() == key[0].as_py()
        alone = key[0] == key[1]
        left = table.filter(pa.array(own)).combine_chunks()
        right = left if alone else table.filter(pa.array(~own)).combine_chunks()
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": left["vec_id"][:0], "vec_id": right["vec_id"][:0], "score": pa.array([], pa.float64())})
        li, ri = _ids(left, "vec_id"), _ids(right, "vec_id")
        a = _Side(_matrix(left))
        b = a if alone else _Side(_matrix(right))
        plain = np.isfinite(a.unit).all() and np.isfinite(b.unit).all()
        same = _same(li, ri) if alone else (np.zeros(0, int), np.zeros(0, int))  # equal ids are in one block
        at, to, score, back = np.zeros(0, int), np.zeros(0, int), np.zeros(0), []
        least, step = np.full(len(li), -np.inf), max(1, HELD // len(li))
        for first in range(0, len(ri), step):
            with np.errstate(all="ignore"):
                s = a.unit @ b.unit[first : first + step].T
            if not plain:
                s[np.isnan(s)] = np.inf
            part = slice(*np.searchsorted(same[1], (first, first + step)))
            s[same[0][part], same[1][part] - first] = -np.inf
            least = np.maximum(least, s.max(axis=1))
            hit = s >= np.where(np.isinf(least), least, least - SLACK)[:, None]
            if not alone:
                most = s.max(axis=0)
                hit |= s >= np.where(np.isinf(most), most, most - SLACK)
            i, j = np.nonzero(hit)
            real = s[i, j] > -np.inf
            i, j = i[real], j[real] + first
            exact = a.cosine(i, b, j)
            if not alone:
                k = _best(j, li[i], exact)
                back.append((j[k], i[k], exact[k]))
            at, to, score = np.concatenate([at, i]), np.concatenate([to, j]), np.concatenate([score, exact])
            k = _best(at, ri[to], score)
            at, to, score = at[k], to[k], score[k]
        found = [pa.table({"query_id": left["vec_id"].take(pa.array(at)), "vec_id": right["vec_id"].take(pa.array(to)), "score": pa.array(score)})]
        for j, i, exact in back:
            found.append(pa.table({"query_id": right["vec_id"].take(pa.array(j)), "vec_id": left["vec_id"].take(pa.array(i)), "score": pa.array(exact)}))
        return pa.concat_tables(found)

    block, other = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = vectors.select("vec_id", "v", F.size("v").alias("dim"), block.alias("block"), other.alias("other"))
    dealt = dealt.select("vec_id", "v", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "dim")
    keys = ["one", "two", "dim"]
    dealt = dealt.repartition(min(blocks * (blocks + 1) // 2, 4096), *keys)
    return top_k(dealt.groupBy(*keys).applyInArrow(run, kinds), 1).drop("rank")


def mutual_pairs(vectors: DataFrame) -> DataFrame:
    """(a, b, score): rows of ``vectors`` (vec_id, v) that are each other's best of all rows but their own, in both orders; ties to the smaller id."""
    best = materialize(nearest_of_each(vectors), "mutual-best")
    ahead, back = best.select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), "score"), best.select(F.col("query_id").alias("b"), F.col("vec_id").alias("a"))
    return ahead.join(back, ["a", "b"])
