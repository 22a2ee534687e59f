"""Registered queries over keyed records, outlines, knots, markup and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import colour, markup
from sparkloom.operators import knots, measures, outlines, records
from sparkloom.plans.registry import load, query

c = F.col


def _rounded(df, digits: dict[str, int]):
    return df.select(*(F.round(x, digits[x]).alias(x) if x in digits else c(x) for x in df.columns))


# ---------------------------------------------------------------- records


@query("nearest_within", """WITH p AS (SELECT s_nationkey AS k, s_acctbal AS x, min(s_suppkey) AS id FROM supplier GROUP BY 1, 2), b AS (SELECT c_custkey, c_nationkey AS k, c_acctbal AS x FROM customer),
    l AS (SELECT b.*, p.x AS lx, p.id AS lid FROM b ASOF LEFT JOIN p ON b.k = p.k AND b.x >= p.x), h AS (SELECT l.*, p.x AS hx, p.id AS hid FROM l ASOF LEFT JOIN p ON l.k = p.k AND l.x <= p.x),
    m AS (SELECT c_custkey, CASE WHEN hx IS NULL OR x - lx <= hx - x THEN lid ELSE hid END AS s_suppkey, CASE WHEN hx IS NULL OR x - lx <= hx - x THEN x - lx ELSE hx - x END AS distance FROM h)
    SELECT c_custkey, s_suppkey, round(distance, 4) AS distance FROM m WHERE distance <= 500""")  # fmt: skip
def _(spark, d):
    left = load(spark, d, "customer").select("c_custkey", c("c_nationkey").alias("k"), c("c_acctbal").alias("x"))
    right = load(spark, d, "supplier").select("s_suppkey", c("s_nationkey").alias("k"), c("s_acctbal").alias("x"))
    return _rounded(records.nearest_within(left, right, "k", "x", "c_custkey", "s_suppkey", 500.0), {"distance": 4})


@query("merged_updates", """SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'purchase') AS paid, arg_max(props, event_id) FILTER (event_type = 'click') AS clicked, arg_max(ts, event_id) FILTER (event_type = 'error') AS failed
    FROM events GROUP BY 1""")  # fmt: skip
def _(spark, d):
    of = lambda kind, x: F.when(c("event_type") == kind, c(x))
    log = load(spark, d, "events").select("user_id", "event_id", of("purchase", "value").alias("paid"), of("click", "props").alias("clicked"), of("error", "ts").alias("failed"))
    return records.merged_updates(log, "user_id", "event_id", ["paid", "clicked", "failed"])


@query("reconcile", """SELECT coalesce(s_suppkey, c_custkey) AS id, CASE WHEN s_suppkey IS NULL THEN 'added' WHEN c_custkey IS NULL THEN 'removed' WHEN s_nationkey = c_nationkey AND (c_acctbal IS NULL OR s_acctbal = c_acctbal) THEN 'same' ELSE 'changed' END AS state,
    coalesce(c_nationkey, s_nationkey) AS nation, coalesce(c_acctbal, s_acctbal) AS balance FROM supplier FULL JOIN (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer) ON s_suppkey = c_custkey""")  # fmt: skip
def _(spark, d):
    old = load(spark, d, "supplier").select(c("s_suppkey").alias("id"), c("s_nationkey").alias("nation"), c("s_acctbal").alias("balance"))
    new = load(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_nationkey").alias("nation"), F.when(c("c_acctbal") >= 0, c("c_acctbal")).alias("balance"))
    return records.reconcile(old, new, "id", ["nation", "balance"])


@query("without_discarded", """SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)""")
def _(spark, d):
    gone = [("o_orderkey", load(spark, d, "lineitem").where("l_returnflag = 'R'"), "l_orderkey"), ("o_custkey", load(spark, d, "customer").where("c_acctbal < 0"), "c_custkey")]
    return records.without_discarded(load(spark, d, "orders").select("o_orderkey", "o_custkey"), gone)


@query("budgeted_text", r"""WITH r AS (SELECT conv_id, turn, text, sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS block FROM r WHERE used <= 2000 GROUP BY 1""")
def _(spark, d):
    return records.budgeted_text(load(spark, d, "conversations"), "conv_id", "turn", "text", 2000)


@query("allocate_numbers", """WITH t AS (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem GROUP BY 1), m AS (SELECT o_custkey, max(greatest(top, o_shipped)) AS top FROM (SELECT o_custkey, top, length(o_orderpriority) AS o_shipped FROM orders JOIN t ON l_orderkey = o_orderkey) GROUP BY 1)
    SELECT o_custkey, o_orderkey, (coalesce(top, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS allocated FROM orders LEFT JOIN m USING (o_custkey)""")  # fmt: skip
def _(spark, d):
    orders = load(spark, d, "orders")
    lines = load(spark, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("number"))
    taken = orders.join(lines, "o_orderkey").select("o_custkey", "number", F.length("o_orderpriority").alias("mark"))
    return records.allocate_numbers(orders.select("o_custkey", "o_orderkey"), taken, "o_custkey", "o_orderkey", "number", "mark")


# --------------------------------------------------------------- outlines

_CORNERS = (("p_size / 2e0", "p_retailprice % 17"), ("29 - p_size / 3e0", "p_retailprice % 7 + 3"), ("p_retailprice % 23", "23 - p_size / 5e0"))


def _cells_of_triangles() -> str:
    sides = [(*_CORNERS[i], *_CORNERS[(i + 1) % 3]) for i in range(3)]
    hit = " + ".join(f"CASE WHEN (({b}) <= cy) <> (({e}) <= cy) AND ({a}) + (cy - ({b})) * (({f}) - ({a})) / (({e}) - ({b})) <= cx THEN 1 ELSE 0 END" for a, b, f, e in sides)
    return f"""SELECT p_partkey, count(*) AS cells, sum(x)::BIGINT AS sum_x, sum(y)::BIGINT AS sum_y FROM
        (SELECT p_partkey, x, y, {hit} AS crossed FROM part, (SELECT x, y, x + 0.5::DOUBLE AS cx, y + 0.5::DOUBLE AS cy FROM range(32) a(x), range(24) b(y)))
        WHERE crossed % 2 = 1 GROUP BY 1"""


@query("polygon_fill", _cells_of_triangles())
def _(spark, d):
    side = lambda i: F.struct(*(F.expr(e).cast("double").alias(n) for n, e in zip(("x0", "y0", "x1", "y1"), (*_CORNERS[i], *_CORNERS[(i + 1) % 3]))))
    edges = load(spark, d, "part").select("p_partkey", F.explode(F.array(side(0), side(1), side(2))).alias("e")).select("p_partkey", "e.*")
    n = c("x_to") - c("x_from") + 1
    spans = outlines.polygon_spans(edges, "p_partkey", 32, 24)
    return spans.groupBy("p_partkey").agg(F.sum(n).cast("long").alias("cells"), F.sum((n * (c("x_from") + c("x_to")) / 2).cast("long")).alias("sum_x"), F.sum(n * c("y")).cast("long").alias("sum_y"))


@query("quadtree", " UNION ALL ".join(f"""SELECT {k} AS depth, floor(l_quantity / 51 * {1 << k})::BIGINT AS tx, floor(l_extendedprice / 120000 * {1 << k})::BIGINT AS ty, count(*) AS n, round(avg(l_discount), 7) AS mean
    FROM lineitem WHERE l_quantity / 51 >= 0 AND l_quantity / 51 < 1 AND l_extendedprice / 120000 >= 0 AND l_extendedprice / 120000 < 1 GROUP BY 2, 3 HAVING count(*) >= 20""" for k in (1, 2, 3, 4)))  # fmt: skip
def _(spark, d):
    return _rounded(outlines.quadtree(load(spark, d, "lineitem"), c("l_quantity") / 51, c("l_extendedprice") / 120000, c("l_discount"), 4, 20), {"mean": 7})


@query("screen_coverage", "SELECT l_partkey, round(1 - product(1 - l_discount), 9) AS coverage FROM lineitem GROUP BY 1")
def _(spark, d):
    return _rounded(outlines.screen_coverage(load(spark, d, "lineitem"), ["l_partkey"], c("l_discount")), {"coverage": 9})


@query("lens_round_trip", "SELECT l_orderkey, l_linenumber, round(l_quantity / 50, 7) AS undistorted FROM lineitem")
def _(spark, d):
    r = outlines.distort(c("l_quantity") / 50, 0.08, -0.015)
    points = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r"))
    return _rounded(outlines.undistorted(points, "r", 0.08, -0.015).drop("r"), {"undistorted": 7})


# ------------------------------------------------------------------ knots

_KNOTS = """k AS (SELECT o_orderpriority AS key, (year(o_orderdate) * 12 + month(o_orderdate))::DOUBLE AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2)"""
_SLOPES = f"""{_KNOTS}, c AS (SELECT *, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS d, row_number() OVER w AS i, count(*) OVER (PARTITION BY key) AS n FROM k WINDOW w AS (PARTITION BY key ORDER BY x)),
    g AS (SELECT *, lag(h) OVER w AS hp, lag(d) OVER w AS dp, lead(h) OVER w AS hn, lead(d) OVER w AS dn, lag(h, 2) OVER w AS hq, lag(d, 2) OVER w AS dq FROM c WINDOW w AS (PARTITION BY key ORDER BY x)),
    f AS (SELECT *, CASE WHEN i = 1 THEN ((2*h + hn) * d - h * dn) / (h + hn) WHEN i = n THEN ((2*hp + hq) * dp - hp * dq) / (hp + hq) END AS three, CASE WHEN i = 1 THEN d ELSE dp END AS own, CASE WHEN i = 1 THEN dn ELSE dq END AS other FROM g),
    m AS (SELECT key, x, y, CASE WHEN n = 1 THEN 0 WHEN i > 1 AND i < n THEN CASE WHEN dp * d <= 0 THEN 0 ELSE 3 * (h + hp) / ((2*h + hp) / dp + (h + 2*hp) / d) END
        WHEN other IS NULL THEN own WHEN sign(three) <> sign(own) THEN 0 WHEN sign(own) <> sign(other) AND abs(three) > 3 * abs(own) THEN 3 * own ELSE three END AS slope FROM f)"""


def _monthly(spark, d):
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("double")
    return load(spark, d, "orders").groupBy(c("o_orderpriority").alias("key"), month.alias("x")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"))


@query("monotone_slopes", f"WITH {_SLOPES} SELECT key, x, y, round(slope, 3) AS slope FROM m")
def _(spark, d):
    return _rounded(knots.monotone_slopes(_monthly(spark, d), "key", "x", "y"), {"slope": 3})


@query("hermite_midpoints", f"""WITH {_SLOPES}, s AS (SELECT key, x, y, slope, lead(x) OVER w - x AS h, lead(y) OVER w AS y1, lead(slope) OVER w AS m1 FROM m WINDOW w AS (PARTITION BY key ORDER BY x))
    SELECT key, x + 0.5 AS x, round(CASE WHEN h IS NULL THEN y ELSE (1 + 1 / h) * (1 - 0.5 / h) * (1 - 0.5 / h) * y + 0.5 / h * (1 - 0.5 / h) * (1 - 0.5 / h) * h * slope + 0.25 / h / h * (3 - 1 / h) * y1 + 0.25 / h / h * (0.5 / h - 1) * h * m1 END, 3) AS value FROM s""")  # fmt: skip
def _(spark, d):
    monthly = _monthly(spark, d)
    sloped = knots.monotone_slopes(monthly, "key", "x", "y")
    return _rounded(knots.hermite_at(sloped, monthly.select("key", (c("x") + 0.5).alias("x")), "key", "x", "y"), {"value": 3})


@query("signed_runs", """WITH b AS (SELECT l_returnflag AS key, l_quantity::BIGINT AS bin, round(avg(l_discount) - 0.05, 9) AS residual, count(*) AS weight FROM lineitem GROUP BY 1, 2),
    s AS (SELECT *, sign(residual) AS s, sum(weight) OVER (PARTITION BY key) AS t FROM b WHERE residual <> 0), n AS (SELECT *, CASE WHEN lag(bin) OVER w = bin - 1 AND lag(s) OVER w = s THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY key ORDER BY bin)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY bin) AS g FROM n)
    SELECT key, min(bin) AS first, max(bin) AS last, round(sum(weight * residual) / sum(weight), 9) AS mean, round(sum(weight) / max(t), 9) AS share, round(abs(sum(weight * residual) / sum(weight)) * sum(weight) / max(t), 9) AS score FROM g GROUP BY key, g""")  # fmt: skip
def _(spark, d):
    bins = load(spark, d, "lineitem").groupBy(c("l_returnflag").alias("key"), c("l_quantity").cast("long").alias("bin")).agg(F.round(F.avg("l_discount") - 0.05, 9).alias("residual"), F.count("*").alias("weight"))
    return _rounded(knots.signed_runs(bins, "key", "bin", "residual", "weight"), {"mean": 9, "share": 9, "score": 9})


# ----------------------------------------------------------------- markup

_NAMES = ["nav", "ul", "li", "article", "div", "h1", "b"]
_TAG = f"</?(?:{'|'.join(_NAMES)})(?:[ \\t\\r\\n][^<>]*)?>"


@query("element_spans", f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '{_TAG}') AS l FROM pages), t AS (SELECT page_id, unnest(l) AS tag, unnest(range(len(l))) AS pos FROM l),
    n AS (SELECT page_id, pos, regexp_extract(tag, '[a-z0-9]+') AS name, CASE WHEN tag LIKE '</%' THEN -1 ELSE 1 END AS step FROM t),
    d AS (SELECT *, sum(step) OVER (PARTITION BY page_id, name ORDER BY pos) AS depth FROM n)
    SELECT page_id, name, pos AS opened, (SELECT min(e.pos) FROM d e WHERE e.page_id = d.page_id AND e.name = d.name AND e.pos > d.pos AND e.depth < d.depth) AS closed, depth::INT AS level FROM d WHERE step = 1""")  # fmt: skip
def _(spark, d):
    return markup.element_spans(load(spark, d, "pages"), "page_id", "html", _NAMES)


@query("framed_events", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS event, text AS data FROM conversations WHERE text IS NOT NULL")
def _(spark, d):
    wire = F.concat(F.array(F.concat(F.lit(": "), "role")), F.transform(F.split("text", "\n"), lambda t: F.concat(F.lit("data: "), t)), F.array(F.lit("")))
    lines = load(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.posexplode(wire).alias("n", "line"))
    return markup.framed_events(lines, "conv_id", ["turn", "n"], "line")


@query("curve_points", """SELECT p_partkey, (p_size <= 255)::INT + (2 * p_size <= 90)::INT AS n, CASE WHEN 2 * p_size <= 90 THEN p_size END AS last_x FROM part""")
def _(spark, d):
    text = F.format_string("<ol><li>%d, 7</li><li>%d,%d</li><li>no, 3</li></ol>", c("p_size"), c("p_size"), F.when(c("p_size") * 2 <= 90, c("p_size") * 2).otherwise(300))
    points = markup.curve_points(text)
    return load(spark, d, "part").select("p_partkey", F.size(points).alias("n"), F.when(F.size(points) > 1, F.element_at(points, -1)["x"]).alias("last_x"))


@query("fractions", "SELECT p_partkey, round(p_retailprice / nullif(p_size % 10, 0), 6) AS value FROM part")
def _(spark, d):
    text = F.concat(c("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("/"), (c("p_size") % 10).cast("string"))
    return load(spark, d, "part").select("p_partkey", F.round(markup.fraction(text), 6).alias("value"))


@query("strip_invisible", r"SELECT doc_id, regexp_replace(chr(8203) || text || chr(65279) || chr(8288), '\p{Cf}', '', 'g') AS clean FROM documents")
def _(spark, d):
    marked = F.concat(F.lit("​"), c("text"), F.lit("﻿⁠"))
    return load(spark, d, "documents").select("doc_id", markup.strip_invisible(marked).alias("clean"))


# --------------------------------------------------------------- measures

_BINS = """h AS (SELECT l_returnflag AS k, l_linestatus = 'F' AS s, least(greatest(floor((l_extendedprice - 0) / (120000.0::DOUBLE / 256)), 0), 255) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
    c AS (SELECT *, sum(n) OVER (PARTITION BY k, s ORDER BY bin) AS c, sum(n) OVER (PARTITION BY k, s) AS t FROM h),
    q AS (SELECT k, s, i AS step, arg_min(120000.0::DOUBLE / 256 * (bin + (i * t / 20 - (c - n)) / n), bin) AS quantile FROM c, range(21) r(i) WHERE c * 20 >= i * t GROUP BY 1, 2, 3)"""


@query("binned_quantiles", f"WITH {_BINS} SELECT k || s AS key, step::INT AS step, round(quantile, 4) AS quantile FROM q")
def _(spark, d):
    rows = load(spark, d, "lineitem").withColumn("key", F.concat("l_returnflag", (c("l_linestatus") == "F").cast("string")))
    return _rounded(measures.binned_quantiles(rows, "key", c("l_extendedprice"), 0.0, 120000.0, 256, 20), {"quantile": 4})


@query("quantile_gap", """WITH h AS (SELECT o_orderpriority AS k, o_orderstatus = 'F' AS s, least(greatest(floor(o_totalprice / (600000.0::DOUBLE / 1024)), 0), 1023) AS bin, count(*) AS n FROM orders GROUP BY 1, 2, 3),
    c AS (SELECT *, sum(n) OVER (PARTITION BY k, s ORDER BY bin) AS c, sum(n) OVER (PARTITION BY k, s) AS t FROM h),
    q AS (SELECT k, s, i AS step, arg_min(600000.0::DOUBLE / 1024 * (bin + (i * t / 20 - (c - n)) / n), bin) AS quantile FROM c, range(21) r(i) WHERE c * 20 >= i * t GROUP BY 1, 2, 3)
    SELECT a.k AS o_orderpriority, round(avg(abs(a.quantile - b.quantile)), 3) AS gap FROM q a JOIN q b ON a.k = b.k AND a.step = b.step AND a.s AND NOT b.s GROUP BY 1""")  # fmt: skip
def _(spark, d):
    return _rounded(measures.quantile_gap(load(spark, d, "orders"), "o_orderpriority", c("o_orderstatus") == "F", c("o_totalprice"), 0.0, 600000.0), {"gap": 3})


@query("mass_bands", """WITH s AS (SELECT l_returnflag, l_quantity, sum(l_linenumber) AS w FROM lineitem GROUP BY 1, 2),
    m AS (SELECT *, floor(5 * (sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - w / 2) / sum(w) OVER (PARTITION BY l_returnflag))::INT AS band FROM s)
    SELECT l_returnflag, band, min(l_quantity) AS low, max(l_quantity) AS high, sum(w)::BIGINT AS mass FROM m GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    return measures.mass_bands(load(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_linenumber", 5)


@query("largest_reversal", """WITH b AS (SELECT p_brand, p_size, avg(p_retailprice) AS v FROM part GROUP BY 1, 2), m AS (SELECT p_brand, max(v) OVER (PARTITION BY p_brand ORDER BY p_size) - v AS d FROM b)
    SELECT p_brand, round(max(d), 6) AS reversal FROM m GROUP BY 1""")  # fmt: skip
def _(spark, d):
    bins = load(spark, d, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("v"))
    return _rounded(measures.largest_reversal(bins, "p_brand", "p_size", "v"), {"reversal": 6})


@query("consensus", """WITH r AS (SELECT c_nationkey AS k, c_acctbal AS v, length(c_mktsegment) AS w FROM customer), c AS (SELECT k, v, sum(sum(w)) OVER (PARTITION BY k ORDER BY v) AS c, sum(sum(w)) OVER (PARTITION BY k) AS t FROM r GROUP BY k, v),
    m AS (SELECT k, min(v) AS q FROM c WHERE c >= 0.5 * t GROUP BY 1), o AS (SELECT k, any_value(q) AS q, sum(CASE WHEN sign(v) * sign(q) < 0 THEN w ELSE 0 END) / sum(w) AS opposed FROM r JOIN m USING (k) GROUP BY 1)
    SELECT k AS c_nationkey, CASE WHEN opposed >= 0.1 THEN 0 ELSE q END AS consensus, round(opposed, 9) AS opposed FROM o""")  # fmt: skip
def _(spark, d):
    rows = load(spark, d, "customer").withColumn("w", F.length("c_mktsegment"))
    return _rounded(measures.consensus(rows, "c_nationkey", "c_acctbal", "w", 0.1), {"opposed": 9})


@query("biweight_mean", """WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), d AS (SELECT e.event_type, value, med, abs(value - med) AS d FROM events e JOIN m USING (event_type)),
    s AS (SELECT event_type, median(d) AS mad FROM d GROUP BY 1), u AS (SELECT event_type, value, (value - med) / (4.685 * greatest(1.4826 * mad, 1e-9)) AS u FROM d JOIN s USING (event_type)),
    w AS (SELECT *, CASE WHEN abs(u) < 1 THEN power(1 - u*u, 2) ELSE 0 END AS w FROM u) SELECT event_type, round(sum(w * value) / sum(w), 7) AS mean, count(value) AS n FROM w GROUP BY 1""")  # fmt: skip
def _(spark, d):
    return _rounded(measures.biweight_mean(load(spark, d, "events"), "event_type", "value"), {"mean": 7})


@query("fused_frames", """WITH w AS (SELECT l_partkey, l_quantity / 51 AS v, CASE WHEN l_discount > 0.03 THEN exp(-power(l_quantity / 51 - 0.5, 2) / 0.08) ELSE 0 END AS w FROM lineitem)
    SELECT l_partkey, round(CASE WHEN sum(w) > 0 THEN sum(w * v) / sum(w) ELSE avg(v) END, 8) AS value FROM w GROUP BY 1""")  # fmt: skip
def _(spark, d):
    v = c("l_quantity") / 51
    return _rounded(measures.fused(load(spark, d, "lineitem"), ["l_partkey"], v, F.when(c("l_discount") > 0.03, colour.well_exposed(v)).otherwise(0.0)), {"value": 8})


@query("sharpest_frame", """SELECT l_partkey, l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_quantity DESC) AS r FROM (SELECT DISTINCT l_partkey, l_orderkey, l_quantity, l_extendedprice FROM lineitem)) WHERE r = 1""")
def _(spark, d):
    return measures.sharpest(load(spark, d, "lineitem"), ["l_partkey"], "l_orderkey", "l_quantity", c("l_extendedprice"))


@query("peak_noise_ratio", "SELECT l_returnflag, l_linestatus, round(10 * log10(1 / greatest(avg(power(l_tax - l_discount, 2)), 1e-12)), 7) AS psnr FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return _rounded(measures.peak_noise_ratio(load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], c("l_tax"), c("l_discount")), {"psnr": 7})


@query("hsl_round_trip", "SELECT l_orderkey, l_linenumber, round(l_discount, 9) AS r, round(l_tax, 9) AS g, round(l_quantity / 50, 9) AS b FROM lineitem")
def _(spark, d):
    hsl = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(x.alias(n) for n, x in zip("hsl", colour.to_hsl(c("l_discount"), c("l_tax"), c("l_quantity") / 50))))
    return hsl.select("l_orderkey", "l_linenumber", *(F.round(x, 9).alias(n) for n, x in zip("rgb", colour.from_hsl(c("h"), c("s"), c("l")))))


@query("more_colour", """WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * 9 AS r, l_tax * 12 AS g, l_quantity / 50 AS b FROM lineitem), y AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS y FROM p)
    SELECT l_orderkey, l_linenumber, round(least(greatest(y + (r - y) * 1.4, 0), 1), 8) AS r, round(least(greatest(y + (g - y) * 1.4, 0), 1), 8) AS g, round(least(greatest(y + (b - y) * 1.4, 0), 1), 8) AS b FROM y""")  # fmt: skip
def _(spark, d):
    moved = colour.more_colour(c("l_discount") * 9, c("l_tax") * 12, c("l_quantity") / 50, 0.4)
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(x, 8).alias(n) for n, x in zip("rgb", moved)))
