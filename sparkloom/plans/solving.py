"""Registered queries over distributed ranks, transforms, pyramids, registration, solvers, resampling and accumulators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import align, bands, fits, grid, perspective, ranks, raster, resample, solve, spectrum
from sparkloom.plans.more import _rounded
from sparkloom.plans.registry import load, query
from sparkloom.staging import materialize

c = F.col
_QS = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)

# ------------------------------------------------------------------- ranks


def _lerp(table: str, key: str, value: str, weight: str) -> str:
    at = lambda q: f"arg_min(CASE WHEN lag_v IS NULL OR c - w >= {q} * t THEN v ELSE lag_v + (v - lag_v) * ({q} * t - (c - w)) / w END, (v, w)) FILTER (c >= {q} * t)"
    return f"""WITH r AS (SELECT {key} AS k, ({value})::DOUBLE AS v, ({weight})::DOUBLE AS w FROM {table}),
    s AS (SELECT *, sum(w) OVER o AS c, sum(w) OVER (PARTITION BY k) AS t, lag(v) OVER o AS lag_v FROM r WINDOW o AS (PARTITION BY k ORDER BY v, w ROWS UNBOUNDED PRECEDING))
    SELECT k, {", ".join(f"round({at(q)}, 6) AS q{round(100 * q):02d}" for q in _QS)} FROM s GROUP BY 1"""


@query("interpolated_quantiles", _lerp("lineitem", "l_returnflag", "l_extendedprice", "l_quantity"))
def _(spark, d):
    rows = load(spark, d, "lineitem").withColumnRenamed("l_returnflag", "k")
    return _rounded(ranks.interpolated_quantiles(rows, "k", "l_extendedprice", c("l_quantity"), list(_QS)), {f"q{round(100 * q):02d}": 6 for q in _QS})


@query("interpolated_quantiles_one_key", _lerp("orders", "'all'", "o_totalprice", "1 + o_custkey % 7"))
def _(spark, d):
    rows = load(spark, d, "orders").withColumn("k", F.lit("all"))
    return _rounded(ranks.interpolated_quantiles(rows, "k", "o_totalprice", 1 + c("o_custkey") % 7, list(_QS)), {f"q{round(100 * q):02d}": 6 for q in _QS})


@query("running_revenue", """SELECT o_orderkey, round(coalesce(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS before,
    round(sum(o_totalprice) OVER (), 2) AS total, lag(o_orderkey) OVER (ORDER BY o_orderdate, o_orderkey) AS last_before FROM orders""")  # fmt: skip
def _(spark, d):
    rows = load(spark, d, "orders").select(F.lit(1).alias("all"), "o_orderkey", "o_orderdate", "o_totalprice")
    r = ranks.running(rows, ["all"], ["o_orderdate", "o_orderkey"], {"price": "o_totalprice"}, last="o_orderkey")
    return r.select("o_orderkey", F.round("price_below", 2).alias("before"), F.round("price_all", 2).alias("total"), "last_before")


@query("cdf_between", """WITH h AS (SELECT least(greatest(floor(63 * l_extendedprice / 110000), 0), 63)::INT AS bin, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 GROUP BY 1),
    f AS (SELECT b.i::INT AS bin, sum(coalesce(w, 0)) OVER (ORDER BY b.i) / sum(w) OVER () AS cdf FROM range(64) b(i) LEFT JOIN h ON h.bin = b.i),
    p AS (SELECT p_partkey, least(greatest(p_retailprice * 40 / 110000, 0), 1) * 63 AS pos FROM part)
    SELECT p_partkey, round(a.cdf * (1 - (pos - floor(pos))) + coalesce(b.cdf, a.cdf) * (pos - floor(pos)), 8) AS share FROM p JOIN f a ON a.bin = floor(pos) LEFT JOIN f b ON b.bin = floor(pos) + 1""")  # fmt: skip
def _(spark, d):
    cdf = fits.weighted_cdf(load(spark, d, "lineitem"), c("l_extendedprice"), c("l_quantity"), 64, 110000.0)
    return _rounded(fits.cdf_at(cdf, load(spark, d, "part").select("p_partkey", "p_retailprice"), c("p_retailprice") * 40, 64, 110000.0).select("p_partkey", "share"), {"share": 8})

# ---------------------------------------------------------------- pyramids

_GRID = "g AS (SELECT l_partkey % {n} AS y, l_suppkey % {n} AS x, avg(l_quantity) / 51 AS value, avg(l_discount) * 10 AS other, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def _grid(spark, d, n):
    """A full n x n grid (cells that no row has are empty in none of the tables: part and supplier keys are dense)."""
    g = load(spark, d, "lineitem").groupBy((c("l_partkey") % n).alias("y"), (c("l_suppkey") % n).alias("x"))
    return g.agg((F.avg("l_quantity") / 51).alias("value"), (F.avg("l_discount") * 10).alias("other"), F.count("*").alias("n"))


def _soft(t: str, v: str, out: str) -> str:
    """CTEs for ``out``: table ``t`` (k, y, x, v) under a Gaussian of one cell, renormalised."""
    return f"""{out}_h AS (SELECT a.k, a.y, a.x, sum(exp(-power(a.x - b.x, 2) / 2) * b.{v}) / sum(exp(-power(a.x - b.x, 2) / 2)) AS v FROM {t} a JOIN {t} b ON a.k = b.k AND a.y = b.y AND abs(a.x - b.x) <= 3 GROUP BY 1, 2, 3),
    {out} AS (SELECT a.k, a.y, a.x, sum(exp(-power(a.y - b.y, 2) / 2) * b.v) / sum(exp(-power(a.y - b.y, 2) / 2)) AS v FROM {out}_h a JOIN {out}_h b ON a.k = b.k AND a.x = b.x AND abs(a.y - b.y) <= 3 GROUP BY 1, 2, 3)"""


def _reduced(t: str, n: int, out: str) -> str:
    return f"{_soft(t, 'v', out + '_s')}, {out} AS (SELECT k, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM {out}_s WHERE y // 2 < {n // 2} AND x // 2 < {n // 2} GROUP BY 1, 2, 3)"


def _read(fine: str, coarse: str, n: int, at: str, out: str, v: str = "v") -> str:
    """CTE: coarse (n x n) read bilinearly at the places of ``fine``."""
    p = lambda x: f"least(greatest({at.format(x=x)}, 0), {n - 1})"
    return f"""{out} AS (SELECT f.k, f.y, f.x, sum((1 - abs(c.y - {p('f.y')})) * (1 - abs(c.x - {p('f.x')})) * c.{v}) AS up FROM {fine} f JOIN {coarse} c
    ON c.k = f.k AND abs(c.y - {p('f.y')}) < 1 AND abs(c.x - {p('f.x')}) < 1 GROUP BY 1, 2, 3)"""


_HALF, _FILL = "(({x} - 0.5) * 0.5)", "(({x} + 0.5) / 2 - 0.5)"


@query("laplacian_bands", f"""WITH {_GRID.format(n=33)}, g0 AS (SELECT 1 AS k, y, x, value AS v FROM g), {_reduced('g0', 33, 'g1')}, {_reduced('g1', 16, 'g2')},
    {_read('g0', 'g1', 16, _HALF, 'u0')}, {_read('g1', 'g2', 8, _HALF, 'u1')}
    SELECT 0 AS level, y, x, round(v - up, 6) AS value FROM g0 JOIN u0 USING (k, y, x) UNION ALL SELECT 1, y, x, round(v - up, 6) FROM g1 JOIN u1 USING (k, y, x) UNION ALL SELECT 2, y, x, round(v, 6) FROM g2""")  # fmt: skip
def _(spark, d):
    levels = bands.laplacian(bands.gaussian(_grid(spark, d, 33), 33, 33, 3, []), [])
    out = [t.select(F.lit(i).alias("level"), "y", "x", F.round("value", 6).alias("value")) for i, (t, *_) in enumerate(levels)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("band_blend", f"""WITH {_GRID.format(n=24)}, w0 AS (SELECT 1 AS k, y, x, (x + y) % 3 + 0.0 AS w FROM g UNION ALL SELECT 2, y, x, CASE WHEN y % 5 = 0 THEN 0 ELSE x % 4 END FROM g),
    t AS (SELECT y, x, sum(w) AS s FROM w0 GROUP BY 1, 2), p0 AS (SELECT k, y, x, CASE WHEN s > 1e-12 THEN w / s ELSE (k = 1)::INT END AS v FROM w0 JOIN t USING (y, x)),
    g0 AS (SELECT 1 AS k, y, x, value AS v FROM g UNION ALL SELECT 2, y, x, other FROM g),
    {_reduced('p0', 24, 'p1')}, {_reduced('g0', 24, 'g1')}, {_reduced('p1', 12, 'p2')}, {_reduced('g1', 12, 'g2')}, {_read('g0', 'g1', 12, _HALF, 'u0')}, {_read('g1', 'g2', 6, _HALF, 'u1')},
    m2 AS (SELECT 1 AS k, y, x, sum(g2.v * p2.v) AS v FROM g2 JOIN p2 USING (k, y, x) GROUP BY 2, 3),
    m1 AS (SELECT 1 AS k, y, x, sum((g1.v - up) * p1.v) AS v FROM g1 JOIN u1 USING (k, y, x) JOIN p1 USING (k, y, x) GROUP BY 2, 3),
    m0 AS (SELECT 1 AS k, y, x, sum((g0.v - up) * p0.v) AS v FROM g0 JOIN u0 USING (k, y, x) JOIN p0 USING (k, y, x) GROUP BY 2, 3),
    {_read('m1', 'm2', 6, _HALF, 'e1')}, c1 AS (SELECT k, y, x, v + up AS v FROM m1 JOIN e1 USING (k, y, x)), {_read('m0', 'c1', 12, _HALF, 'e0')}
    SELECT y, x, round(v + up, 6) AS value FROM m0 JOIN e0 USING (k, y, x)""")  # fmt: skip
def _(spark, d):
    g = _grid(spark, d, 24)
    one = g.select(F.lit(1).alias("frame"), "y", "x", "value", ((c("x") + c("y")) % 3).alias("weight"))
    two = g.select(F.lit(2).alias("frame"), "y", "x", c("other").alias("value"), F.when(c("y") % 5 == 0, 0).otherwise(c("x") % 4).alias("weight"))
    return _rounded(bands.blend(one.unionByName(two), 24, 24, 3), {"value": 6})


def _pull_push(n: int) -> str:
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // 2))
    out = [f"WITH {_GRID.format(n=n)}", "f0 AS (SELECT 1 AS k, y, x, value AS v, CASE WHEN n % 3 = 0 THEN 0 WHEN n % 3 = 1 THEN 1 ELSE 0.25 END::DOUBLE AS w FROM g)"]
    out += [f"f{i} AS (SELECT k, y // 2 AS y, x // 2 AS x, sum(v * w) / nullif(sum(w), 0) AS v, least(sum(w), 1) AS w FROM f{i - 1} GROUP BY 1, 2, 3)" for i in range(1, len(sizes))]
    out.append(f"b{len(sizes) - 1} AS (FROM f{len(sizes) - 1})")
    for i in range(len(sizes) - 2, -1, -1):
        out.append(_read(f"f{i}", f"(SELECT * FROM b{i + 1} WHERE v IS NOT NULL)", sizes[i + 1], _FILL, f"u{i}"))
        out.append(f"b{i} AS (SELECT k, y, x, CASE WHEN w >= 1 THEN v ELSE coalesce(w * v, 0) + (1 - w) * up END AS v FROM f{i} LEFT JOIN u{i} USING (k, y, x))")
    return ", ".join(out) + " SELECT y, x, round(v, 6) AS value FROM b0"


@query("filled_grid", _pull_push(20))
def _(spark, d):
    known = F.when(c("n") % 3 == 0, 0.0).when(c("n") % 3 == 1, 1.0).otherwise(0.25)
    return _rounded(bands.fill(_grid(spark, d, 20).withColumn("known", known), 20, 20, ["value"]), {"value": 6})


def _moments(t: str, v: str) -> str:
    near = lambda axis, line, src, out: f"""{out} AS (SELECT a.k, a.y, a.x, {", ".join(f"sum(exp(-power(a.{axis} - b.{axis}, 2) / 4.5) * b.{n}) / sum(exp(-power(a.{axis} - b.{axis}, 2) / 4.5)) AS {n}" for n in ("a", "b", "aa", "bb", "ab"))}
    FROM {src} a JOIN {src} b ON a.k = b.k AND a.{line} = b.{line} AND abs(a.{axis} - b.{axis}) <= 5 GROUP BY 1, 2, 3)"""  # noqa: E731
    return f"{near('x', 'y', t, 'mh')}, {near('y', 'x', 'mh', v)}"


@query("structural_similarity", f"""WITH {_GRID.format(n=24)}, r AS (SELECT 1 AS k, y, x, value AS a, other AS b, value * value AS aa, other * other AS bb, value * other AS ab FROM g UNION ALL
    SELECT 2, y, x, value, value, value * value, value * value, value * value FROM g), {_moments('r', 'm')}
    SELECT k, round(avg(((2*a*b + 0.0001) * (2*(ab - a*b) + 0.0009)) / ((a*a + b*b + 0.0001) * ((aa - a*a) + (bb - b*b) + 0.0009))), 6) AS ssim FROM m GROUP BY 1""")  # fmt: skip
def _(spark, d):
    g = _grid(spark, d, 24)
    two = g.select(F.lit(1).alias("k"), "y", "x", c("value").alias("a"), c("other").alias("b")).unionByName(g.select(F.lit(2).alias("k"), "y", "x", c("value").alias("a"), c("value").alias("b")))
    return _rounded(bands.structural_similarity(two, ["k"], "a", "b"), {"ssim": 6})

# -------------------------------------------------- transforms, registration


@query("spectrum", """WITH s AS (SELECT o_orderpriority AS k, o_custkey % 64 AS i, sum(o_totalprice) / 1000000 AS v FROM orders GROUP BY 1, 2)
    SELECT k, f.f::BIGINT AS "at", round(sum(v * cos(2 * pi() * (f.f * i % 64) / 64)), 5) + 0 AS re, round(-sum(v * sin(2 * pi() * (f.f * i % 64) / 64)), 5) + 0 AS im FROM s, range(64) f(f) GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    s = load(spark, d, "orders").groupBy(c("o_orderpriority").alias("k"), (c("o_custkey") % 64).alias("at")).agg((F.sum("o_totalprice") / 1000000).alias("re"))
    out = spectrum.fourier(s.withColumn("im", F.lit(0.0)), 64, ["k"])
    return out.select("k", "at", (F.round("re", 5) + 0).alias("re"), (F.round("im", 5) + 0).alias("im"))


_CIRCLE = "(2 * pi() * ((u.y * g.y * 1) % 16) / 16 + 2 * pi() * ((u.x * g.x) % 16) / 16)"


@query("phase_shift", f"""WITH {_GRID.format(n=16)}, p AS (SELECT 1 AS k, g.y, g.x, s.value AS a, g.value AS b FROM g JOIN g s ON s.y = (g.y + 13) % 16 AND s.x = (g.x + 5) % 16
        UNION ALL SELECT 2, y, x, value, value + (other - 0.5) / 50 FROM g), u AS (SELECT y, x FROM g),
    f AS (SELECT g.k, u.y, u.x, sum(a * cos{_CIRCLE}) AS ar, -sum(a * sin{_CIRCLE}) AS ai, sum(b * cos{_CIRCLE}) AS br, -sum(b * sin{_CIRCLE}) AS bi FROM p g, u GROUP BY 1, 2, 3),
    r AS (SELECT k, y, x, (ar * br + ai * bi) / (sqrt(power(ar * br + ai * bi, 2) + power(ai * br - ar * bi, 2)) + 1e-9) AS re, (ai * br - ar * bi) / (sqrt(power(ar * br + ai * bi, 2) + power(ai * br - ar * bi, 2)) + 1e-9) AS im FROM f),
    i AS (SELECT g.k, u.y, u.x, sum(re * cos{_CIRCLE} - im * sin{_CIRCLE}) / 256 AS v FROM r g, u GROUP BY 1, 2, 3)
    SELECT k, round(v, 6) AS peak, CASE WHEN y < 8 THEN y ELSE y - 16 END AS dy, CASE WHEN x < 8 THEN x ELSE x - 16 END AS dx FROM i QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(v, 9) DESC, y, x) = 1""")  # fmt: skip
def _(spark, d):
    g = _grid(spark, d, 16)
    moved = g.select(((c("y") + 3) % 16).alias("y"), ((c("x") + 11) % 16).alias("x"), c("value").alias("a"))
    pairs = g.join(moved, ["y", "x"]).select(F.lit(1).alias("k"), "y", "x", "a", c("value").alias("b"))
    pairs = pairs.unionByName(g.select(F.lit(2).alias("k"), "y", "x", c("value").alias("a"), (c("value") + (c("other") - 0.5) / 50).alias("b")))
    return _rounded(spectrum.phase_correlation(pairs, 16, 16, ["k"], c("a"), c("b")), {"peak": 6})


def _frames(spark, d, n=32):
    """Two smooth rasters of two tables of the same grid: sums under a wide Gaussian."""
    g = _grid(spark, d, n)
    soft = raster.convolve(g.select("y", "x", "value"), raster.gauss_taps(3.0, 8))
    return soft.select(F.lit(1).alias("k"), "y", "x", "value")


_SOFT32 = f"""{_GRID.format(n=32)}, h AS (SELECT a.y, a.x, sum(exp(-power(a.x - b.x, 2) / 18) * b.value) / sum(exp(-power(a.x - b.x, 2) / 18)) AS v FROM g a JOIN g b ON a.y = b.y AND abs(a.x - b.x) <= 8 GROUP BY 1, 2),
    s AS (SELECT a.y, a.x, sum(exp(-power(a.y - b.y, 2) / 18) * b.v) / sum(exp(-power(a.y - b.y, 2) / 18)) AS v FROM h a JOIN h b ON a.x = b.x AND abs(a.y - b.y) <= 8 GROUP BY 1, 2)"""
_J = ["gx * (x - 15.5)", "gx * (y - 15.5)", "gx", "gy * (x - 15.5)", "gy * (y - 15.5)", "gy", "1"]


@query("affine_normals", f"""WITH {_SOFT32}, p AS (SELECT s.y, s.x, s.v AS i, (coalesce(r.v, s.v) - coalesce(l.v, s.v)) / 2 AS gx, (coalesce(b.v, s.v) - coalesce(u.v, s.v)) / 2 AS gy FROM s
        LEFT JOIN s l ON l.y = s.y AND l.x = s.x - 1 LEFT JOIN s r ON r.y = s.y AND r.x = s.x + 1 LEFT JOIN s u ON u.x = s.x AND u.y = s.y - 1 LEFT JOIN s b ON b.x = s.x AND b.y = s.y + 1),
    t AS (SELECT f.y, f.x, f.v AS t, f.x + 0.5 AS tx, f.y + 0.25 AS ty FROM s f WHERE f.x + 0.5 <= 31 AND f.y + 0.25 <= 31),
    m AS (SELECT t.y, t.x, any_value(t) AS t, sum(w * i) AS iv, sum(w * gx) AS gx, sum(w * gy) AS gy FROM (SELECT t.*, p.i, p.gx, p.gy, (1 - abs(p.x - tx)) * (1 - abs(p.y - ty)) AS w FROM t JOIN p ON abs(p.x - tx) < 1 AND abs(p.y - ty) < 1) t GROUP BY 1, 2),
    e AS (SELECT *, t - iv AS e, 0.01 * 0.01 / (0.01 * 0.01 + (t - iv) * (t - iv)) AS u FROM m)
    SELECT 1 AS k, count(*) AS n, round(sum(e * e * u), 7) AS cost, {", ".join(f"round(sum(u * u * ({p}) * ({q})), 5) + 0 AS m{i}_{j}" for i, p in enumerate(_J) for j, q in enumerate(_J) if j >= i)},
    {", ".join(f"round(sum(u * u * ({p}) * e), 6) + 0 AS r{i}" for i, p in enumerate(_J))} FROM e""")  # fmt: skip
def _(spark, d):
    s = materialize(_frames(spark, d), "frames")
    state = spark.createDataFrame([(1, 0.0, 0.0, 0.5, 0.0, 0.0, 0.25, 0.0, 0.01)], "k int, a double, b double, c double, d double, e double, f double, g double, scale double")
    out = align.normal_sums(s, align.patches(s, 32, 32, ["k"]), state, 32, 32, ["k"], True, True)
    places = {"cost": 7} | {n: 5 for n in out.columns if n[0] == "m"} | {n: 6 for n in out.columns if n[0] == "r"}
    return out.select("k", "n", *((F.round(n, p) + 0).alias(n) for n, p in places.items()))


@query("affine_alignment")
def _(spark, d):
    """The same raster twice, moved by a few cells: no SQL follows the steps; `tests/test_transforms.py` plants moves."""
    s = materialize(_frames(spark, d, 40).withColumn("y", c("y")), "frames")
    fixed = s.where("y BETWEEN 2 AND 37 AND x BETWEEN 1 AND 36").withColumns({"y": c("y") - 2, "x": c("x") - 1})
    moving = s.where("y BETWEEN 1 AND 36 AND x BETWEEN 3 AND 38").withColumns({"y": c("y") - 1, "x": c("x") - 3})
    return _rounded(align.align(fixed, moving, 36, 36, ["k"], levels=3), {n: 3 for n in align.NAMES} | {"cost": 6})

# ----------------------------------------------------------------- solvers


_SERIES = "s AS (SELECT p_size AS i, count(*)::DOUBLE AS n, sum(p_retailprice) / 1000 AS t FROM part GROUP BY 1), q AS (SELECT row_number() OVER (ORDER BY i) AS i, n, t FROM s), k AS (SELECT max(i) AS m FROM q)"


def _series(spark, d, stiffness=20.0):
    """The normal equations of a smooth series: fidelity to the means of parts by size, and a penalty on differences."""
    s = load(spark, d, "part").groupBy("p_size").agg(F.count("*").cast("double").alias("n"), (F.sum("p_retailprice") / 1000).alias("b"))
    q = materialize(ranks.running(s.withColumn("one", F.lit(1)), ["one"], ["p_size"], {"c": "one"}).select((c("c_below") + 1).alias("i"), "n", "b", c("c_all").alias("m")), "series")
    near = F.array(F.struct((c("i") - 1).alias("j")), F.struct((c("i") + 1).alias("j")))
    off = q.select("i", "m", F.explode(near).alias("e")).where("e.j BETWEEN 1 AND m").select("i", c("e.j").alias("j"), F.lit(-stiffness).alias("a"))
    ends = F.when((c("i") == 1).cast("int") + (c("i") == c("m")).cast("int") > 0, stiffness * (2 - (c("i") == 1).cast("int") - (c("i") == c("m")).cast("int"))).otherwise(2 * stiffness)
    matrix = off.unionByName(q.select("i", c("i").alias("j"), (c("n") + ends).alias("a")))
    return matrix, q.select("i", "b")


@query("smooth_series", f"""WITH RECURSIVE {_SERIES}, a AS (SELECT i, t AS b, n + 20.0 * ((i > 1)::INT + (i < m)::INT) AS d FROM q, k),
    f AS (SELECT i, d, b FROM a WHERE i = 1 UNION ALL SELECT a.i, a.d - 400.0 / f.d, a.b + 20.0 * f.b / f.d FROM f JOIN a ON a.i = f.i + 1),
    r AS (SELECT i, b / d AS x FROM f, k WHERE i = m UNION ALL SELECT f.i, (f.b + 20.0 * r.x) / f.d FROM r JOIN f ON f.i = r.i - 1) SELECT i, round(x, 6) AS x FROM r""")  # fmt: skip
def _(spark, d):
    matrix, rhs = _series(spark, d)
    return _rounded(solve.conjugate_gradients(matrix, rhs).select("i", "x"), {"x": 6})


@query("bounded_series")
def _(spark, d):
    """The same series between bounds; no SQL follows the active set, `tests/test_solvers.py` checks the conditions of the least."""
    matrix, rhs = _series(spark, d)
    return _rounded(solve.bounded_solve(matrix, rhs, F.lit(1.45), F.lit(1.5)), {"x": 6})


@query("projected_curves")
def _(spark, d):
    """Mean price of parts by size, as a rising curve of bounded slope for each brand; see `tests/test_solvers.py` for the conditions."""
    out = solve.project_curves(load(spark, d, "part"), "p_brand", "p_size", c("p_retailprice") / 100, F.lit(1.0), F.lit(9.0), F.lit(20.0), 0.0, 0.25)
    return _rounded(out, {"target": 6, "mass": 6, "value": 5})


# -------------------------------------------------- resampling, accumulators


@query("bootstrap_means", f"""WITH r AS (SELECT o_orderpriority AS k, o_totalprice AS v, r, o_orderkey FROM orders, range(40) t(r)),
    u1 AS (SELECT k, v, r, (o_orderkey % 2147483647 * 48271 + r * 69621 + 12345) % 2147483647 AS u FROM r), u2 AS (SELECT k, v, r, ((u * u + 16807) % 2147483647 * 48271 + r * 16807 + 7) % 2147483647 AS u FROM u1),
    u3 AS (SELECT k, v, r, ((u * u + 39373) % 2147483647 * 48271 + r * 39373 + 11) % 2147483647 AS u FROM u2), t AS (SELECT k, v, r, {" + ".join(f"(u >= {x})::INT" for x in resample.poisson_steps())} AS n FROM u3)
    SELECT k, r::INT AS replicate, sum(n)::BIGINT AS n, round(sum(n * v) / sum(n), 4) AS mean FROM t GROUP BY 1, 2 HAVING sum(n) > 0""")  # fmt: skip
def _(spark, d):
    rows = load(spark, d, "orders").withColumnRenamed("o_orderpriority", "k")
    return _rounded(resample.bootstrap(rows, "k", "o_orderkey", c("o_totalprice"), replicates=40), {"mean": 4})


_ERRORS = """e AS (SELECT metric_ AS metric, part, got, want FROM (SELECT l_returnflag || l_linestatus AS metric_, l_suppkey % 3 AS part, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS got, l_tax AS want FROM lineitem))"""


def _errors(spark, d):
    rows = load(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("metric"), (c("l_suppkey") % 3).alias("part"), F.when(c("l_linenumber") != 7, c("l_discount")).alias("got"), c("l_tax").alias("want"))
    return rows.withColumn("run", F.lit("all"))


@query("eval_report", f"""WITH {_ERRORS} SELECT 'all' AS run, metric, count(got) AS n, round(avg(abs(got - want)), 8) AS mae, round(avg(got - want), 8) AS bias, (count(*) - count(got))::BIGINT AS omit, count(got) < 20 AS low FROM e GROUP BY 2""")
def _(spark, d):
    states = resample.partial_errors(_errors(spark, d), ["run", "part"], "metric", c("got"), c("want"))
    return _rounded(resample.report(resample.merge(states, ["run"]), ["run"]), {"mae": 8, "bias": 8})


@query("eval_gaps", f"""WITH {_ERRORS}, m AS (SELECT metric, count(got) AS n, avg(abs(got - want)) / CASE WHEN metric LIKE 'N%' THEN 0.1 ELSE 0.08 END AS s FROM e GROUP BY 1 HAVING count(got) > 0)
    SELECT 'all' AS run, round(100 * avg(s), 6) AS gap, round(100 * sum(n * s) / sum(n), 6) AS weighted_gap FROM m""")  # fmt: skip
def _(spark, d):
    states = resample.partial_errors(_errors(spark, d), ["run", "part"], "metric", c("got"), c("want"))
    found = resample.gaps(resample.merge(states, ["run"]), ["run"], F.when(c("metric").startswith("N"), 0.1).otherwise(0.08))
    return _rounded(found, {"gap": 6, "weighted_gap": 6})


# -------------------------------------------------------------- morphology

_GAPS = f"{_GRID.format(n=40)}, m AS (SELECT y, x, round(value, 6) AS v FROM g WHERE (x * 7 + y * 3) % 5 <> 0)"


@query("spread_least", f"WITH {_GAPS} SELECT a.y, a.x, min(b.v) AS spread FROM m a JOIN m b ON abs(a.y - b.y) <= 4 AND abs(a.x - b.x) <= 4 GROUP BY 1, 2")
def _(spark, d):
    m = _grid(spark, d, 40).where((c("x") * 7 + c("y") * 3) % 5 != 0).withColumn("value", F.round("value", 6))
    return grid.spread(m, [], "value", 4, True)


@query("morph_mask", f"""WITH {_GAPS}, b AS (SELECT y, x, CASE WHEN v > 0.5 THEN 255 ELSE 0 END AS v FROM m)
    SELECT -2 AS r, a.y, a.x, min(b.v) AS spread FROM b a JOIN b ON abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY 2, 3
    UNION ALL SELECT 3, a.y, a.x, max(b.v) FROM b a JOIN b ON abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3 GROUP BY 2, 3""")  # fmt: skip
def _(spark, d):
    m = _grid(spark, d, 40).where((c("x") * 7 + c("y") * 3) % 5 != 0).withColumn("value", F.when(F.round("value", 6) > 0.5, 255).otherwise(0))
    return grid.morph(m, [], "value", -2).select(F.lit(-2).alias("r"), "y", "x", "spread").unionByName(grid.morph(m, [], "value", 3).select(F.lit(3).alias("r"), "y", "x", "spread"))


# ------------------------------------------------------------- perspective


@query("line_families", f"""WITH {_GRID.format(n=40)}, s AS (SELECT g.y, g.x, (r.value - l.value) * 0.5 * 39 AS a, (d.value - u.value) * 0.5 * 39 AS b, g.x / 39.0 - 0.5 AS p, g.y / 39.0 - 0.5 AS q FROM g
        JOIN g l ON l.y = g.y AND l.x = g.x - 1 JOIN g r ON r.y = g.y AND r.x = g.x + 1 JOIN g u ON u.x = g.x AND u.y = g.y - 1 JOIN g d ON d.x = g.x AND d.y = g.y + 1),
    f AS (SELECT *, -(a * p + b * q) AS c, sqrt(a * a + b * b) AS w, CASE WHEN abs(b) <= abs(a) * {perspective.CONE_TANGENT} THEN 'V' WHEN abs(a) <= abs(b) * {perspective.CONE_TANGENT} THEN 'H' END AS family FROM s WHERE sqrt(a * a + b * b) >= 0.05)
    SELECT family, count(*) AS n, round(sum(w * a * a), 4) AS aa, round(sum(w * a * b), 4) AS ab, round(sum(w * a * c), 4) AS ac, round(sum(w * b * b), 4) AS bb, round(sum(w * b * c), 4) AS bc, round(sum(w * c * c), 4) AS cc,
    round(sum(w * (b * b - a * a) / (w * w)), 6) AS c2, round(sum(w * -2 * a * b / (w * w)), 6) AS s2 FROM f WHERE family IS NOT NULL GROUP BY 1""")  # fmt: skip
def _(spark, d):
    votes = perspective.lines(_grid(spark, d, 40), 40, 40, [], stride=1)
    return _rounded(perspective.moments(votes, [], c("size")), {m: 4 for m in ("aa", "ab", "ac", "bb", "bc", "cc")} | {"c2": 6, "s2": 6})
