"""Registered queries over fits, rasters, pairing, colour, sources, and SQL beyond the reference's own operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import colour, curves, strings
from sparkloom.operators import fits, pairing, raster, search, stats
from sparkloom.plans.registry import load, query
from sparkloom.sources import formats
from sparkloom.staging import fresh_path
from sparkloom.streaming import release

c = F.col


def _rounded(df, digits: dict[str, int]):
    return df.select(*(F.round(x, digits[x]).alias(x) if x in digits else c(x) for x in df.columns))


# ------------------------------------------------------------------- fits


@query("weighted_slope_se", """WITH r AS (SELECT l_returnflag, l_quantity / 50 AS x, l_extendedprice / 110000 AS y, l_tax + 0.01 AS w FROM lineitem),
    s AS (SELECT l_returnflag, count(*) AS n, sum(w) AS sw, sum(w*w) AS sww, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my, sum(w*x*x)/sum(w) AS xx, sum(w*x*y)/sum(w) AS xy, sum(w*y*y)/sum(w) AS yy FROM r GROUP BY 1),
    v AS (SELECT l_returnflag, n, greatest(sw*sw/sww, 3) AS e, xx - mx*mx AS vxx, xy - mx*my AS vxy, yy - my*my AS vyy FROM s)
    SELECT l_returnflag, n, round(vxy/vxx, 6) AS slope, round(sqrt(greatest(vyy - vxy*vxy/vxx, 0) / (vxx * (e - 2)) + 2.0 / 255 / 255 / 12 / (12 * vxx)), 8) AS error FROM v""")  # fmt: skip
def _(spark, d):
    out = fits.slope_with_error(load(spark, d, "lineitem"), ["l_returnflag"], c("l_quantity") / 50, c("l_extendedprice") / 110000, c("l_tax") + 0.01)
    return _rounded(out, {"slope": 6, "error": 8})


@query("plane_fit", """WITH s AS (SELECT l_linestatus, count(*) AS s, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(x*y) AS sxy, sum(y*y) AS syy, sum(v) AS sv, sum(x*v) AS sxv, sum(y*v) AS syv
    FROM (SELECT l_linestatus, l_quantity / 50 AS x, l_discount * 10 AS y, l_extendedprice / 1000 AS v FROM lineitem) GROUP BY 1),
    m AS (SELECT l_linestatus, s, sx, sy, sv, sxx - sx*sx/s AS xx, sxy - sx*sy/s AS xy, syy - sy*sy/s AS yy, sxv - sx*sv/s AS xv, syv - sy*sv/s AS yv FROM s),
    b AS (SELECT *, (xv*yy - yv*xy) / (xx*yy - xy*xy) AS ux, (yv*xx - xv*xy) / (xx*yy - xy*xy) AS uy FROM m)
    SELECT l_linestatus, round((sv - ux*sx - uy*sy) / s, 5) AS a, round(ux, 5) AS slope_x, round(uy, 5) AS slope_y FROM b""")  # fmt: skip
def _(spark, d):
    out = fits.plane(load(spark, d, "lineitem"), ["l_linestatus"], c("l_quantity") / 50, c("l_discount") * 10, c("l_extendedprice") / 1000, F.lit(1.0))
    return _rounded(out, {"a": 5, "slope_x": 5, "slope_y": 5})


def _mid(table: str, p: str) -> str:
    return f"""SELECT k, v, (coalesce(sum(n) OVER (PARTITION BY k ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + n / 2.0) / (sum(n) OVER (PARTITION BY k))::DOUBLE AS q
        FROM (SELECT {p}_nationkey AS k, {p}_acctbal AS v, count(*) AS n FROM {table} GROUP BY 1, 2)"""


@query("quantile_map", f"""WITH s AS ({_mid('customer', 'c')}), t AS ({_mid('supplier', 's')}),
    b AS (SELECT s.k, s.v, s.q, l.q AS ql, l.v AS vl FROM s ASOF LEFT JOIN t l ON s.k = l.k AND s.q >= l.q),
    h AS (SELECT b.*, h.q AS qh, h.v AS vh FROM b ASOF LEFT JOIN t h ON b.k = h.k AND b.q <= h.q)
    SELECT k, v AS acctbal, round(CASE WHEN ql IS NULL THEN vh WHEN qh IS NULL OR ql = q THEN vl ELSE vl + (q - ql) / (qh - ql) * (vh - vl) END, 4) AS mapped FROM h""")  # fmt: skip
def _(spark, d):
    side = lambda t, p: load(spark, d, t).select(c(f"{p}_nationkey").alias("k"), c(f"{p}_acctbal").alias("acctbal"))
    return _rounded(fits.quantile_map(side("customer", "c"), side("supplier", "s"), "k", "acctbal", F.lit(1)), {"mapped": 4})


@query("weighted_cdf", """WITH h AS (SELECT least(greatest(floor(255 * l_extendedprice / 110000), 0), 255)::INT AS bin, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 GROUP BY 1)
    SELECT b.i::INT AS bin, round(sum(coalesce(w, 0)) OVER (ORDER BY b.i) / sum(w) OVER (), 8) AS cdf FROM range(256) b(i) LEFT JOIN h ON h.bin = b.i""")  # fmt: skip
def _(spark, d):
    return _rounded(fits.weighted_cdf(load(spark, d, "lineitem"), c("l_extendedprice"), c("l_quantity"), 256, 110000.0), {"cdf": 8})


@query("debevec_mean", """WITH r AS (SELECT l_partkey, l_quantity / 51 AS v, power(2.0, l_linenumber - 3) AS light FROM lineitem),
    w AS (SELECT *, greatest(1 - power(2 * v - 1, 12), 0) * light AS w FROM r)
    SELECT l_partkey, round(sum(w * v / light) / sum(CASE WHEN w > 0 THEN w END), 8) AS radiance, count(CASE WHEN w > 0 THEN 1 END) AS heard FROM w GROUP BY 1""")  # fmt: skip
def _(spark, d):
    out = fits.merge_exposures(load(spark, d, "lineitem"), ["l_partkey"], c("l_quantity") / 51, c("l_linenumber") - 3)
    return _rounded(out, {"radiance": 8})


@query("exposure_ratio", """WITH p AS (SELECT o_custkey, o_totalprice AS b, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a FROM orders),
    r AS (SELECT o_custkey, log2(b / a) AS ev FROM p WHERE a BETWEEN 1500 AND 950000 AND b BETWEEN 1500 AND 950000)
    SELECT o_custkey, round(ev, 6) AS ev, n FROM (SELECT o_custkey, ev, row_number() OVER (PARTITION BY o_custkey ORDER BY ev) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM r) WHERE r = n // 2 + 1""")  # fmt: skip
def _(spark, d):
    before = F.lag("o_totalprice").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    pairs = load(spark, d, "orders").select("o_custkey", c("o_totalprice").alias("b"), before.alias("a")).where("a BETWEEN 1500 AND 950000 AND b BETWEEN 1500 AND 950000")
    out = stats.upper_median(pairs.select("o_custkey", F.log2(c("b") / c("a")).alias("ev")), "o_custkey", "ev")
    return out.select("o_custkey", F.round("upper_median", 6).alias("ev"), "n")


def _sides(bin_: str) -> str:
    return f"""SELECT sum(CASE WHEN least(sa, sb) >= 0.015 THEN least(sa, sb) ELSE 0 END) FROM (SELECT a / sum(a) OVER () AS sa, b / sum(b) OVER () AS sb FROM
        (SELECT {bin_} AS bin, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) AS b FROM orders GROUP BY 1))"""


@query("identifiability", f"SELECT round(least(greatest(0.75 * least(({_sides('least(floor(o_totalprice / 600000 * 17), 16)')}), 1) + 0.25 * least(({_sides('o_orderpriority')}), 1), 0), 1), 8) AS identifiability")
def _(spark, d):
    o = load(spark, d, "orders")
    mass = lambda b, n: stats.two_sided_bins(o, b, c("o_orderstatus") == "F").agg(F.least(F.sum("weight"), F.lit(1.0)).alias(n))
    both = mass(F.least(F.floor(c("o_totalprice") / 600000 * 17), F.lit(16)), "luma").join(F.broadcast(mass(c("o_orderpriority"), "hue")))
    return both.select(F.round(F.least(F.greatest(F.expr("0.75D * luma + 0.25D * hue"), F.lit(0.0)), F.lit(1.0)), 8).alias("identifiability"))


@query("binned_median_shift", """WITH r AS (SELECT least(floor(o_totalprice / 600000 * 17), 16)::BIGINT AS bin, round(ln(o_totalprice / (1000 + o_custkey)), 6) AS v, count(*) AS w FROM orders GROUP BY 1, 2),
    k AS (SELECT bin, v, sum(w) OVER (PARTITION BY bin ORDER BY v) AS s, sum(w) OVER (PARTITION BY bin) AS t FROM r) SELECT bin, min(CASE WHEN s >= 0.5 * t THEN v END) AS q50 FROM k GROUP BY 1""")  # fmt: skip
def _(spark, d):
    rows = load(spark, d, "orders").select(F.least(F.floor(c("o_totalprice") / 600000 * 17), F.lit(16)).cast("long").alias("bin"), F.round(F.log(c("o_totalprice") / (1000 + c("o_custkey"))), 6).alias("v"), F.lit(1).alias("w"))
    return stats.weighted_quantiles(rows, "bin", "v", "w", [0.5])


@query("pair_correlation", """SELECT l_shipmode AS flag, round(r, 6) AS r FROM (SELECT l_returnflag AS l_shipmode, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1)""")
def _(spark, d):
    out = fits.correlation(load(spark, d, "lineitem"), ["l_returnflag"], c("l_quantity"), c("l_extendedprice") / 1000, F.lit(1))
    return out.select(c("l_returnflag").alias("flag"), F.round("r", 6).alias("r"))


@query("robust_curve")
def _(spark, d):
    return fits.robust_curve(load(spark, d, "lineitem"), c("l_quantity") / 51, c("l_extendedprice") / 110000, 1 - c("l_discount"))


@query("ridge_fit")
def _(spark, d):
    q = {"one": F.lit(1), "quantity": c("l_quantity"), "discount": c("l_discount"), "tax": c("l_tax")}
    return fits.least_squares(load(spark, d, "lineitem"), q, c("l_extendedprice") / 1000, F.lit(1), 1e-3)


# ----------------------------------------------------------------- rasters

_CELLS = "g AS (SELECT l_partkey % 40 AS y, l_suppkey % 40 AS x, sum(l_linenumber)::DOUBLE AS value, sum(l_quantity)::DOUBLE AS other FROM lineitem GROUP BY 1, 2)"


def _cells(spark, d):
    g = load(spark, d, "lineitem").groupBy((c("l_partkey") % 40).alias("y"), (c("l_suppkey") % 40).alias("x"))
    return g.agg(F.sum("l_linenumber").cast("double").alias("value"), F.sum("l_quantity").alias("other"))


@query("gauss_sharpen", f"""WITH {_CELLS}, h AS (SELECT a.y, a.x, sum(exp(-power(a.x - b.x, 2) / 2) * b.value) / sum(exp(-power(a.x - b.x, 2) / 2)) AS v FROM g a JOIN g b ON a.y = b.y AND abs(a.x - b.x) <= 3 GROUP BY 1, 2),
    s AS (SELECT a.y, a.x, sum(exp(-power(a.y - b.y, 2) / 2) * b.v) / sum(exp(-power(a.y - b.y, 2) / 2)) AS soft FROM h a JOIN h b ON a.x = b.x AND abs(a.y - b.y) <= 3 GROUP BY 1, 2)
    SELECT y, x, round(value + 0.6 * (value - soft), 5) AS sharp, round(soft, 5) AS soft, round(value - soft, 5) AS high FROM g JOIN s USING (y, x)""")  # fmt: skip
def _(spark, d):
    return _rounded(raster.sharpen(_cells(spark, d), 1.0, 3, 0.6), {"sharp": 5, "soft": 5, "high": 5})


@query("cell_detail", f"""WITH {_CELLS}, n AS (SELECT g.y, g.x, g.value AS v, coalesce(l.value, g.value) AS l, coalesce(r.value, g.value) AS r, coalesce(u.value, g.value) AS u, coalesce(b.value, g.value) AS b FROM g
    LEFT JOIN g l ON l.y = g.y AND l.x = g.x - 1 LEFT JOIN g r ON r.y = g.y AND r.x = g.x + 1 LEFT JOIN g u ON u.x = g.x AND u.y = g.y - 1 LEFT JOIN g b ON b.x = g.x AND b.y = g.y + 1)
    SELECT y, x, abs(l + r + u + b - 4 * v) AS laplacian, round(sqrt((r-l)*(r-l) + (b-u)*(b-u)), 6) AS gradient FROM n""")  # fmt: skip
def _(spark, d):
    return _rounded(raster.detail(_cells(spark, d)), {"gradient": 6})


_BOXED = "JOIN {t} b ON abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY 1, 2"


@query("guided_filter", f"""WITH {_CELLS}, m AS (SELECT a.y, a.x, avg(b.value) AS i, avg(b.other) AS p, avg(b.value * b.value) AS ii, avg(b.value * b.other) AS ip FROM g a {_BOXED.format(t='g')}),
    l AS (SELECT y, x, (ip - i * p) / (ii - i * i + 0.5) AS a, p - (ip - i * p) / (ii - i * i + 0.5) * i AS b FROM m),
    k AS (SELECT a.y, a.x, avg(b.a) AS a, avg(b.b) AS b FROM l a {_BOXED.format(t='l')}) SELECT y, x, round(k.a * value + k.b, 4) AS refined FROM g JOIN k USING (y, x)""")  # fmt: skip
def _(spark, d):
    return _rounded(raster.guided_filter(_cells(spark, d), 2, 0.5, guide="value", mask="other"), {"refined": 4})


@query("pyramid", f"WITH {_CELLS} SELECT k::INT AS level, y >> k::INT AS y, x >> k::INT AS x, round(avg(value), 6) AS value FROM g, range(4) r(k) GROUP BY 1, 2, 3")
def _(spark, d):
    return _rounded(raster.pyramid(_cells(spark, d), 3), {"value": 6})


@query("shift_correlations", f"""WITH {_CELLS} SELECT s.i - 3 AS dy, t.i - 3 AS dx, count(*) AS n, round(corr(a.value, b.other), 6) AS r FROM range(7) s(i), range(7) t(i), g a, g b
    WHERE b.y = a.y + s.i - 3 AND b.x = a.x + t.i - 3 GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    g = _cells(spark, d)
    out = raster.shift_correlations(g.select("y", "x", "value"), g.select("y", "x", c("other").alias("value")), 3)
    return _rounded(out.select(c("dy").cast("long").alias("dy"), c("dx").cast("long").alias("dx"), "n", "r"), {"r": 6})


@query("splat_table", """WITH p AS (SELECT l_quantity / 4 AS fy, l_discount * 60 AS fx, l_extendedprice / 1000 AS v, 1 + l_tax AS w FROM lineitem),
    s AS (SELECT floor(fy) + j.i AS y, floor(fx) + k.i AS x, v, w * (CASE WHEN j.i = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE WHEN k.i = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w
      FROM p, range(2) j(i), range(2) k(i))
    SELECT y::BIGINT AS y, x::BIGINT AS x, round(sum(w), 4) AS mass, round(sum(w * v) / sum(w), 4) AS mean FROM s WHERE w > 1e-9 GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    out = raster.splat(load(spark, d, "lineitem"), c("l_quantity") / 4, c("l_discount") * 60, c("l_extendedprice") / 1000, 1 + c("l_tax"))
    return _rounded(out.where("mass > 1e-6"), {"mass": 4, "mean": 4})


@query("bilinear_sample", f"""WITH {_CELLS}, p AS (SELECT p_partkey, (p_partkey % 390) / 10.0 AS fy, (p_size * 7 % 390) / 10.0 AS fx FROM part)
    SELECT p_partkey, round(sum((1 - abs(g.y - fy)) * (1 - abs(g.x - fx)) * value) / sum((1 - abs(g.y - fy)) * (1 - abs(g.x - fx))), 5) AS value
    FROM p JOIN g ON abs(g.y - fy) < 1 AND abs(g.x - fx) < 1 GROUP BY 1""")  # fmt: skip
def _(spark, d):
    out = raster.sample_bilinear(load(spark, d, "part"), _cells(spark, d), "p_partkey", (c("p_partkey") % 390) / 10, (c("p_size") * 7 % 390) / 10)
    return _rounded(out, {"value": 5})


@query("cell_regions")
def _(spark, d):
    mean = _cells(spark, d).agg(F.avg("value").alias("m"))
    return raster.regions(_cells(spark, d).join(F.broadcast(mean)), F.when(c("value") > c("m"), 1).otherwise(-1))


# ----------------------------------------------------------------- pairing

_BOXES = "SELECT p_partkey AS id, p_size * 8.0 AS x0, p_retailprice / 4.0 AS y0, p_size * 8.0 + 10 + p_partkey % 9 AS x1, p_retailprice / 4.0 + 12 + p_partkey % 7 AS y1 FROM part"


@query("box_overlaps", f"""WITH b AS ({_BOXES}), p AS (SELECT a.id AS a, b.id AS b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i,
    (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM b a JOIN b ON a.id < b.id AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0))
    SELECT a, b, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) >= 0.5""")  # fmt: skip
def _(spark, d):
    part = load(spark, d, "part").selectExpr("p_partkey AS id", "p_size * 8D AS x0", "p_retailprice / 4D AS y0", "p_size * 8D + 10 + p_partkey % 9 AS x1", "p_retailprice / 4D + 12 + p_partkey % 7 AS y1")
    return _rounded(pairing.overlapping_boxes(part, "id", 0.5, 24.0), {"iou": 6})


@query("box_suppression")
def _(spark, d):
    part = load(spark, d, "part").selectExpr("p_partkey AS id", "p_retailprice AS s", "p_size * 8D AS x0", "p_retailprice / 4D AS y0", "p_size * 8D + 10 + p_partkey % 9 AS x1", "p_retailprice / 4D + 12 + p_partkey % 7 AS y1")
    return pairing.suppress_boxes(part, "id", "s", 0.5, 24.0)


@query("one_to_one_sites")
def _(spark, d):
    site = lambda t, k, b: load(spark, d, t).select(c(k).alias("id"), (c(b) / 10).alias("x"), (c(k) % 97).cast("double").alias("y"))
    return pairing.nearest_first(site("supplier", "s_suppkey", "s_acctbal"), site("customer", "c_custkey", "c_acctbal"), "id", 12.0)


@query("retrieval_weighted", """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, q.label AS want, v.label AS got, 1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS dist, abs(q.vec_id - v.vec_id)::DOUBLE AS gap
      FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
    z AS (SELECT query_id, avg(gap) AS m, stddev_pop(gap) AS sd FROM s GROUP BY 1),
    r AS (SELECT query_id, want, got, row_number() OVER (PARTITION BY query_id ORDER BY dist + 0.1 * (gap - m) / sd, vec_id) AS rank FROM s JOIN z USING (query_id))
    SELECT query_id, round(abs(avg(got) - any_value(want)) / 9, 6) AS error FROM r WHERE rank <= 4 GROUP BY 1""")  # fmt: skip
def _(spark, d):
    v = load(spark, d, "embeddings")
    queries, rows = search.rows_of(v.where(c("vec_id") % 20 == 0), "query_id"), search.rows_of(v)
    best = pairing.retrieve_weighted(queries, rows, lambda q, r: abs(q - r), 0.1)
    labels = v.select("vec_id", "label")
    met = best.join(labels, "vec_id").join(labels.select(c("vec_id").alias("query_id"), c("label").alias("want")), "query_id")
    return met.groupBy("query_id").agg(F.round(F.abs(F.avg("label") - F.max("want")) / 9, 6).alias("error"))


# ----------------------------------------------------------- colour, strings


def _lab(r: str, g: str, b: str, n: str) -> str:
    lin = lambda v: f"(CASE WHEN {v} <= 0.04045 THEN {v} / 12.92 ELSE power(({v} + 0.055) / 1.055, 2.4) END)"
    f = lambda t: f"(CASE WHEN {t} > 216.0/24389 THEN cbrt({t}) ELSE (24389.0/27 * {t} + 16) / 116 END)"
    x, y, z = (f("((" + " + ".join(f"{m} * {lin(v)}" for m, v in zip(row, (r, g, b))) + f") / {w})") for row, w in zip(colour.TO_XYZ, colour.WHITE))
    return f"116 * {y} - 16 AS {n}l, 500 * ({x} - {y}) AS {n}a, 200 * ({y} - {z}) AS {n}b"


@query("mean_delta_e", f"""WITH p AS (SELECT l_returnflag, l_discount * 10 AS r, l_tax * 12 AS g, l_quantity / 50 AS b FROM lineitem),
    l AS (SELECT l_returnflag, {_lab('r', 'g', 'b', 'p')}, {_lab('(r * 0.9)', '(g * 0.8)', 'b', 'q')} FROM p)
    SELECT l_returnflag, round(avg(sqrt((pl-ql)*(pl-ql) + (pa-qa)*(pa-qa) + (pb-qb)*(pb-qb))), 6) AS delta_e FROM l GROUP BY 1""")  # fmt: skip
def _(spark, d):
    r, g, b = c("l_discount") * 10, c("l_tax") * 12, c("l_quantity") / 50
    e = colour.delta_e(colour.cie_lab(r, g, b), colour.cie_lab(r * 0.9, g * 0.8, b))
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(e), 6).alias("delta_e"))


_ENDS = (*curves.HUE_CENTRES, 360)


@query("hue_band_stats", "WITH o AS (SELECT fmod(o_totalprice, 360) AS h, o_totalprice / 600000 AS y FROM orders), s AS ("
    + " UNION ALL ".join(f"SELECT {(i + e) % 8} AS band, h, y, {'' if e else '1 - '}(h - {a}) / {b - a}.0 AS w FROM o WHERE h >= {a} AND h < {b}" for i, (a, b) in enumerate(zip(_ENDS, _ENDS[1:])) for e in (0, 1))
    + ") SELECT band::INT AS band, round(sum(w), 3) AS mass, round(degrees(atan2(sum(w * sin(radians(h))), sum(w * cos(radians(h))))), 4) AS hue, round(sum(w * y) / sum(w), 6) AS luma FROM s GROUP BY 1")
def _(spark, d):
    o = load(spark, d, "orders").select((c("o_totalprice") % 360).alias("h"), (c("o_totalprice") / 600000).alias("y"))
    s = o.select("h", "y", F.inline(colour.band_shares(c("h"))))
    turn = F.atan2(F.sum(c("share") * F.sin(F.radians("h"))), F.sum(c("share") * F.cos(F.radians("h"))))
    return s.groupBy("band").agg(F.round(F.sum("share"), 3).alias("mass"), F.round(F.degrees(turn), 4).alias("hue"), F.round(F.sum(c("share") * c("y")) / F.sum("share"), 6).alias("luma"))


@query("xml_escape", """SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS digest FROM pages""")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", F.sha2(strings.xml_escape(c("html")), 256).alias("digest"))


@query("percent_encode", "SELECT page_id, url_encode(url) AS encoded FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", strings.percent_encode(c("url")).alias("encoded"))


@query("settings_diff", """SELECT o_orderkey, concat_ws(', ', CASE WHEN o_orderstatus <> 'O' THEN 'status=' || o_orderstatus END, CASE WHEN o_orderpriority <> '5-LOW' THEN 'priority=' || o_orderpriority END) AS line FROM orders""")
def _(spark, d):
    off = lambda col, base, name: F.when(c(col) != base, F.concat(F.lit(name + "="), c(col)))
    return load(spark, d, "orders").select("o_orderkey", F.concat_ws(", ", off("o_orderstatus", "O", "status"), off("o_orderpriority", "5-LOW", "priority")).alias("line"))


# ------------------------------------------------------- streams and sources


@query("ordinal_release", """SELECT user_id, idx, event_id FROM (SELECT user_id, event_id, event_id // 15 AS idx, dense_rank() OVER (PARTITION BY user_id ORDER BY event_id // 15) - 1 AS r FROM events) WHERE r = idx""")
def _(spark, d):
    rows = load(spark, d, "events").select("user_id", F.expr("event_id div 15").alias("idx"), "event_id")
    return release.releasable(rows, "user_id", "idx")


@query("state_log_replay", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id % 3 <> 0) WHERE r = 1")
def _(spark, d):
    path, rows = fresh_path(spark, "log"), load(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    for part, version in ((1, "v2"), (2, "v2"), (0, "v1")):
        formats.append_log(rows.where(c("event_id") % 3 == part), path, version, "event_id")
    return formats.replay_log(spark, path, "user_id long, event_type string, value double", "user_id", "v2")


@query("format_round_trips", "SELECT kind, n_regionkey, n_nationkey, n_name FROM nation, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) k(kind)")
def _(spark, d):
    n, out = load(spark, d, "nation"), None
    for kind in ("csv", "json", "orc", "parquet"):
        path = fresh_path(spark, kind)
        formats.write_table(n, path, kind)
        t = formats.read_table(spark, path, n.schema, kind).select(F.lit(kind).alias("kind"), "n_regionkey", "n_nationkey", "n_name")
        out = t if out is None else out.unionByName(t)
    return out


# ------------------------------------------------------------------ plain SQL


@query("cube_orders", """SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS gid, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def _(spark, d):
    return load(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("pivot_flags", """SELECT l_linenumber, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1""")
def _(spark, d):
    out = load(spark, d, "lineitem").groupBy("l_linenumber").pivot("l_returnflag", ["A", "N", "R"]).count()
    return out.select("l_linenumber", *(F.coalesce(c(x), F.lit(0)).alias(x.lower()) for x in "ANR"))


@query("distribution_ranks", """SELECT c_custkey, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd, dense_rank() OVER w AS dr, first_value(c_custkey) OVER w AS first
    FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)""")  # fmt: skip
def _(spark, d):
    w = W.partitionBy("c_nationkey").orderBy("c_acctbal")
    return load(spark, d, "customer").select("c_custkey", F.round(F.percent_rank().over(w), 8).alias("pr"), F.round(F.cume_dist().over(w), 8).alias("cd"), F.dense_rank().over(w).alias("dr"), F.first("c_custkey").over(w).alias("first"))


@query("sliding_counts", """SELECT epoch_us(s) AS start_us, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts) - i * INTERVAL 1 HOUR FOR i IN range(3)]) AS s FROM events) GROUP BY 1""")
def _(spark, d):
    w = F.window(c("ts").cast("timestamp"), "3 hours", "1 hour")
    return load(spark, d, "events").groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), "n")


@query("monthly_orders", """SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, count(*) AS n, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total, max(date_diff('day', date_trunc('month', o_orderdate)::DATE, o_orderdate::DATE))::INT AS last
    FROM orders GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    day, first = F.to_date("o_orderdate"), F.trunc(F.to_date("o_orderdate"), "month")
    return load(spark, d, "orders").groupBy(F.year(day).alias("y"), F.month(day).alias("m")).agg(F.count("*").alias("n"), F.sum(c("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.max(F.date_diff(day, first)).alias("last"))


@query("range_join_bands", """SELECT o.o_orderkey, b.i AS band FROM orders o JOIN range(12) b(i) ON o.o_totalprice >= b.i * b.i * 4000 AND o.o_totalprice < (b.i + 1) * (b.i + 1) * 4000""")
def _(spark, d):
    bands = F.broadcast(spark.range(12).select(c("id").alias("band"), (c("id") * c("id") * 4000).alias("lo"), ((c("id") + 1) * (c("id") + 1) * 4000).alias("hi")))  # twelve rows
    return load(spark, d, "orders").join(bands, (c("o_totalprice") >= c("lo")) & (c("o_totalprice") < c("hi"))).select("o_orderkey", "band")


@query("distinct_customers", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS exact, true AS near FROM orders GROUP BY 1")
def _(spark, d):
    out = load(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("exact"), F.hll_sketch_estimate(F.hll_sketch_agg("o_custkey", 14)).alias("hll"))
    return out.select("o_orderpriority", "exact", (F.abs(c("hll") - c("exact")) <= 0.05 * c("exact")).alias("near"))
