"""Registered queries over the star schema, events, vectors and pages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import curves, texts
from sparkloom.operators import grid, matching, search, stats
from sparkloom.plans.registry import load, query
from sparkloom.streaming import windows

c = F.col
_SEARCH = """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id,
    list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
    FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) """


def _sides(spark, d):
    """The queries and all rows."""
    v = load(spark, d, "embeddings")
    return search.rows_of(v.where(c("vec_id") % 20 == 0), "query_id"), search.rows_of(v)


@query("scene_search_topk", _SEARCH + "SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 3")
def _(spark, d):
    return search.nearest(*_sides(spark, d), 3).select("query_id", c("rank").cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


@query("scene_search_z", _SEARCH + """, z AS (SELECT query_id, avg(score) AS m, stddev_pop(score) AS sd, count(*) AS n FROM s GROUP BY 1)
    SELECT r.query_id, rank, vec_id, round(CASE WHEN n >= 3 AND sd > 0 THEN (score - m) / sd ELSE score END, 4) AS z
    FROM r JOIN z USING (query_id) WHERE rank <= 4""")  # fmt: skip
def _(spark, d):
    q, v = _sides(spark, d)
    z = F.round((c("score") - c("center")) / c("spread"), 4).alias("z")
    return search.nearest(q, v, 4).join(search.moments(q, v), "query_id").select("query_id", c("rank").cast("long").alias("rank"), "vec_id", z)


_FAR = "NOT EXISTS (SELECT 1 FROM {t} t JOIN embeddings a ON a.vec_id = t.vec_id JOIN embeddings b ON b.vec_id = s.vec_id WHERE t.query_id = s.query_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.2)"


@query("scene_search_diverse", _SEARCH + f""", one AS (SELECT query_id, 1 AS rank, vec_id, score FROM r WHERE rank = 1),
    two AS (SELECT query_id, 2 AS rank, vec_id, score FROM s WHERE {_FAR.format(t='one')} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) = 1), pair AS (FROM one UNION ALL FROM two),
    three AS (SELECT query_id, 3 AS rank, vec_id, score FROM s WHERE {_FAR.format(t='pair')} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) = 1)
    SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (FROM pair UNION ALL FROM three)""")  # fmt: skip
def _(spark, d):
    return search.diverse(*_sides(spark, d), k=3, near=0.2).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("mutual_nn", _SEARCH.replace(" WHERE q.vec_id % 20 = 0", "") + """, a AS (SELECT query_id, vec_id, score FROM r WHERE rank = 1),
    b AS (SELECT vec_id, query_id, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, query_id) AS k FROM s)
    SELECT a.query_id AS a, a.vec_id AS b, round(a.score, 6) AS score FROM a JOIN b ON a.query_id = b.query_id AND a.vec_id = b.vec_id AND b.k = 1""")  # fmt: skip
def _(spark, d):
    return search.mutual_pairs(search.rows_of(load(spark, d, "embeddings"))).select("a", "b", F.round("score", 6).alias("score"))


_HIST = """h AS (SELECT least(greatest(floor(255 * l_extendedprice / 110000), 0), 255)::INT AS bin FROM lineitem WHERE l_extendedprice IS NOT NULL)"""


@query("hist_256", f"WITH {_HIST} SELECT b.i::INT AS bin, count(h.bin) AS n FROM range(256) b(i) LEFT JOIN h ON h.bin = b.i GROUP BY 1")
def _(spark, d):
    return stats.histogram(load(spark, d, "lineitem"), c("l_extendedprice"), 256, 110000.0)


@query("clip_pct", """SELECT round(100.0 * sum(CASE WHEN l_quantity <= 1 THEN 1 ELSE 0 END) / count(l_quantity), 6) AS low_pct,
    round(100.0 * sum(CASE WHEN l_quantity >= 50 THEN 1 ELSE 0 END) / count(l_quantity), 6) AS high_pct, count(l_quantity) AS n FROM lineitem""")  # fmt: skip
def _(spark, d):
    out = stats.clip_shares(load(spark, d, "lineitem"), c("l_quantity"), 1, 50)
    return out.select(F.round("low_pct", 6).alias("low_pct"), F.round("high_pct", 6).alias("high_pct"), "n")


@query("cdf_p99", """WITH h AS (SELECT least(greatest(floor(1023 * o_totalprice / 600000), 0), 1023)::INT AS bin, count(*) AS n FROM orders GROUP BY 1),
    k AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS total FROM h) SELECT min(bin) AS bin FROM k WHERE cum >= 0.99 * total""")  # fmt: skip
def _(spark, d):
    return stats.binned_quantile(stats.histogram(load(spark, d, "orders"), c("o_totalprice"), 1024, 600000.0), 0.99)


_QS = (0.05, 0.25, 0.5, 0.75, 0.95)


@query("weighted_quantiles", "WITH s AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2), "
    "k AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS c, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM s) SELECT l_returnflag, "
    + ", ".join(f"min(CASE WHEN c >= {q} * t THEN v END) AS q{round(100 * q):02d}" for q in _QS) + " FROM k GROUP BY 1")
def _(spark, d):
    return stats.weighted_quantiles(load(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "l_quantity", list(_QS))


@query("weighted_line", """WITH s AS (SELECT l_returnflag, sum(w) sw, sum(w*x) sx, sum(w*y) sy, sum(w*x*x) sxx, sum(w*x*y) sxy, sum(w*y*y) syy, sum(w*w) sww
    FROM (SELECT l_returnflag, l_discount AS x, l_extendedprice / 1000 AS y, l_quantity AS w FROM lineitem) GROUP BY 1)
    SELECT l_returnflag, round((sxy - sx*sy/sw) / (sxx - sx*sx/sw), 4) AS slope, round((sy - (sxy - sx*sy/sw) / (sxx - sx*sx/sw) * sx) / sw, 4) AS intercept,
    round(power(sxy - sx*sy/sw, 2) / ((sxx - sx*sx/sw) * (syy - sy*sy/sw)), 8) AS r2, round(sw*sw/sww, 3) AS n_eff FROM s""")  # fmt: skip
def _(spark, d):
    rows = load(spark, d, "lineitem").select("l_returnflag", c("l_discount").alias("x"), (c("l_extendedprice") / 1000).alias("y"), c("l_quantity").alias("w"))
    out = stats.weighted_line(rows, ["l_returnflag"], "x", "y", "w")
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 8).alias("r2"), F.round("n_eff", 3).alias("n_eff"))


@query("mid_ranks", """WITH s AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2)
    SELECT p_brand, p_size, n, round((coalesce(sum(n) OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2.0)
    / sum(n) OVER (PARTITION BY p_brand), 8) AS mid FROM s""")  # fmt: skip
def _(spark, d):
    return stats.mid_ranks(load(spark, d, "part"), "p_brand", "p_size").withColumn("mid", F.round("mid", 8))


@query("upper_median", """SELECT o_orderstatus, o_totalprice AS upper_median, n FROM (SELECT o_orderstatus, o_totalprice,
    row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE r = n // 2 + 1""")  # fmt: skip
def _(spark, d):
    return stats.upper_median(load(spark, d, "orders"), "o_orderstatus", "o_totalprice")


_DEV = """m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1),
  d AS (SELECT e.*, med FROM events e JOIN m USING (event_type)), a AS (SELECT event_type, median(abs(value - med)) AS mad FROM d GROUP BY 1) """


@query("robust_mean_mad", f"WITH {_DEV}, w AS (SELECT event_type, value, exp(-power((value - med) / greatest(3 * mad, 1e-5), 2)) AS w FROM d JOIN a USING (event_type)) "
    "SELECT event_type, round(sum(w * value) / sum(w), 6) AS robust_mean, count(value) AS n FROM w GROUP BY 1")  # fmt: skip
def _(spark, d):
    return stats.robust_mean(load(spark, d, "events"), "event_type", "value").withColumn("robust_mean", F.round("robust_mean", 6))


@query("outlier_mad", f"WITH {_DEV} SELECT event_id, event_type, value FROM d JOIN a USING (event_type) WHERE abs(value - med) > 4 * 1.4826 * mad")
def _(spark, d):
    return stats.outliers(load(spark, d, "events"), "event_type", "value", 4.0).select("event_id", "event_type", "value")


@query("paired_errors", """SELECT lang, count(x) AS n, round(avg(abs(x)), 6) AS mae, round(avg(x), 6) AS bias, round(100 * avg(abs(x)) / 5000, 6) AS gap_pct,
    sum(CASE WHEN got IS NULL THEN 1 ELSE 0 END)::BIGINT AS omitted, count(x) < 20 AS low_n FROM (SELECT lang, n_chars - got AS x, got FROM
    (SELECT d.lang, d.n_chars, l.quality * 2000 AS got FROM documents d LEFT JOIN labels l USING (doc_id))) GROUP BY 1""".replace("n_chars - got", "got - n_chars"))  # fmt: skip
def _(spark, d):
    rows = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left")
    out = stats.paired_errors(rows, ["lang"], c("quality") * 2000, c("n_chars"), 5000.0)
    return out.select("lang", "n", *(F.round(x, 6).alias(x) for x in ("mae", "bias", "gap_pct")), "omitted", "low_n")


@query("two_sided_bins", """WITH b AS (SELECT floor(o_totalprice / 50000)::BIGINT AS bin, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS a,
    sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) AS b FROM orders GROUP BY 1), s AS (SELECT bin, a / sum(a) OVER () AS sa, b / sum(b) OVER () AS sb FROM b)
    SELECT bin, round(sa, 8) AS share_a, round(sb, 8) AS share_b, round(CASE WHEN least(sa, sb) >= 0.015 THEN least(sa, sb) ELSE 0.0 END, 8) AS weight FROM s""")  # fmt: skip
def _(spark, d):
    out = stats.two_sided_bins(load(spark, d, "orders"), F.floor(c("o_totalprice") / 50000).cast("long"), c("o_orderstatus") == "F")
    return out.select("bin", *(F.round(x, 8).alias(x) for x in ("share_a", "share_b", "weight")))


@query("preference_join", """WITH k AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages), t AS (
    SELECT s.s_suppkey, 1 AS tier, p.page_id FROM supplier s JOIN k p ON p.page_id = s.s_suppkey AND p.host LIKE '%.com'
    UNION ALL SELECT s.s_suppkey, 2, p.page_id FROM supplier s JOIN k p ON p.page_id % 25 = s.s_nationkey)
    SELECT s_suppkey, page_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY tier, page_id) AS r FROM t) WHERE r = 1""")  # fmt: skip
def _(spark, d):
    com = F.regexp_extract("url", "://([^/?#]*)", 1).endswith(".com")
    tiers = [(c("s_suppkey"), F.when(com, c("page_id"))), (c("s_nationkey").cast("long"), c("page_id") % 25)]
    return matching.preference_join(load(spark, d, "supplier"), load(spark, d, "pages"), "s_suppkey", "page_id", tiers)


@query("prefix_join_longest", """WITH p AS (SELECT DISTINCT substr(p_name, 1, 4 + p_partkey % 5) AS stem FROM part), n AS (SELECT DISTINCT p_name FROM part)
    SELECT p_name, stem FROM (SELECT p_name, stem, row_number() OVER (PARTITION BY p_name ORDER BY length(stem) DESC) AS r FROM n JOIN p
    ON starts_with(p_name, stem) AND NOT regexp_matches(substr(p_name, length(stem) + 1, 1), '[0-9]')) WHERE r = 1""")  # fmt: skip
def _(spark, d):
    names = load(spark, d, "part")
    stems = names.select(F.expr("substr(p_name, 1, cast(4 + p_partkey % 5 as int))").alias("stem"))
    return matching.longest_prefix(names, stems, "p_name", "stem")


@query("bracket_lerp", """WITH p AS (SELECT p_brand AS k, p_size AS x, max(p_retailprice) AS y FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2),
    q AS (SELECT DISTINCT p_brand AS k, p_size AS x FROM part),
    b AS (SELECT q.k, q.x, max(CASE WHEN p.x <= q.x THEN p.x END) AS lo, min(CASE WHEN p.x >= q.x THEN p.x END) AS hi FROM q LEFT JOIN p ON p.k = q.k GROUP BY 1, 2)
    SELECT b.k AS p_brand, b.x AS p_size, round(CASE WHEN lo IS NULL THEN h.y WHEN hi IS NULL OR lo = b.x THEN l.y
    ELSE l.y + (b.x - lo)::DOUBLE / (hi - lo) * (h.y - l.y) END, 4) AS value
    FROM b LEFT JOIN p l ON l.k = b.k AND l.x = lo LEFT JOIN p h ON h.k = b.k AND h.x = hi""")  # fmt: skip
def _(spark, d):
    part = load(spark, d, "part")
    return matching.bracket_lerp(part.where("p_partkey % 3 = 0"), part, "p_brand", "p_size", "p_retailprice").withColumn("value", F.round("value", 4))


@query("latest_row_wins", """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def _(spark, d):
    return matching.latest_rows(load(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])


@query("resume_plan", """WITH w AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0), d AS (SELECT o_orderkey,
    CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0)
    SELECT o_orderkey, CASE WHEN w.o_orderstatus IS NULL THEN 'orphaned' WHEN d.o_orderstatus IS NULL THEN 'pending'
    WHEN w.o_orderstatus = d.o_orderstatus THEN 'restored' ELSE 'stale' END AS state FROM w FULL JOIN d USING (o_orderkey)""")  # fmt: skip
def _(spark, d):
    o = load(spark, d, "orders")
    done = o.where("o_orderkey % 3 <> 0").withColumn("o_orderstatus", F.when(c("o_orderkey") % 5 == 0, "X").otherwise(c("o_orderstatus")))
    return matching.resume_plan(o.where("o_orderkey % 7 <> 0"), done, "o_orderkey", "o_orderstatus")


@query("slot_reuse", "SELECT doc_id, sha256(text) AS digest, min(doc_id) OVER (PARTITION BY text) AS slot FROM documents")
def _(spark, d):
    return matching.reuse_slots(load(spark, d, "documents"), "doc_id", c("text"))


@query("gaps_islands", """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice > 150000 AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)
    - row_number() OVER (PARTITION BY o_custkey, o_totalprice > 150000 ORDER BY o_orderkey) AS g FROM orders)
    SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS length FROM r WHERE f GROUP BY o_custkey, g""")  # fmt: skip
def _(spark, d):
    return matching.islands(load(spark, d, "orders"), "o_custkey", "o_orderkey", c("o_totalprice") > 150000)


@query("edit_state_union", """SELECT conv_id, turn, role, kind, n FROM (SELECT conv_id, turn, role, 'turn' AS kind, length(text)::BIGINT AS n FROM conversations
    UNION ALL SELECT conv_id, max(turn), NULL, 'state', count(*) FROM conversations GROUP BY conv_id)""")  # fmt: skip
def _(spark, d):
    t = load(spark, d, "conversations")
    turns = t.select("conv_id", "turn", "role", F.lit("turn").alias("kind"), F.char_length("text").cast("long").alias("n"))
    state = t.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.count("*").alias("n"))
    return turns.unionByName(state.select("conv_id", "turn", F.lit(None).cast("string").alias("role"), F.lit("state").alias("kind"), "n"))


@query("pending_customers", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _(spark, d):
    return load(spark, d, "customer").join(load(spark, d, "orders").where("o_totalprice > 400000"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("sanitize_text", f"""SELECT doc_id, nullif(rtrim(substr(trim(regexp_replace(text, '[{texts.SPACE}{texts.INVISIBLE}]+', ' ', 'g')), 1, 200)), '') AS text FROM documents""")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", texts.sanitize(c("text")).alias("text"))


@query("attr_extract", """SELECT page_id, len(a) AS n, array_to_string(a, ' ') AS hrefs FROM (SELECT page_id, regexp_extract_all(html, '\\bhref="([^"]*)"', 1) AS a FROM pages)""")
def _(spark, d):
    a = texts.attributes(c("html"), "href")
    return load(spark, d, "pages").select("page_id", a.alias("a")).select("page_id", F.size("a").cast("long").alias("n"), F.array_join("a", " ").alias("hrefs"))


@query("xml_unescape", """WITH t AS (SELECT page_id, regexp_extract_all(html, '&[^;]*;|[^&]+|&') AS parts FROM pages),
    p AS (SELECT page_id, unnest(parts) AS t, generate_subscripts(parts, 1) AS i FROM t),
    c AS (SELECT *, CASE WHEN regexp_full_match(t, '&#[xX][+]?[0-9A-Fa-f]+;') THEN try_cast('0x' || regexp_extract(t, '([0-9A-Fa-f]+);', 1) AS BIGINT) WHEN regexp_full_match(t, '&#[+]?[0-9]+;') THEN try_cast(regexp_extract(t, '[0-9]+') AS BIGINT) END AS n FROM p),
    d AS (SELECT page_id, i, CASE t WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '"' WHEN '&apos;' THEN chr(39) WHEN '&amp;' THEN '&' ELSE
        CASE WHEN n IN (9, 10, 13) OR n BETWEEN 32 AND 126 OR n BETWEEN 160 AND 55295 OR n BETWEEN 57344 AND 65533 OR n BETWEEN 65536 AND 1114111 THEN chr(n::INT) ELSE t END END AS t FROM c)
    SELECT page_id, sha256(coalesce(string_agg(t, '' ORDER BY i), '')) AS digest FROM pages LEFT JOIN d USING (page_id) GROUP BY 1""")  # fmt: skip
def _(spark, d):
    return load(spark, d, "pages").select("page_id", F.sha2(texts.xml_unescape(c("html")), 256).alias("digest"))


@query("circular_diff", """SELECT event_id, CASE WHEN x > 180 THEN x - 360 ELSE x END AS diff FROM (SELECT event_id,
    ((round(value, 2) - 15 * user_id) % 360 + 360) % 360 AS x FROM events)""".replace("AS diff", "AS diff").replace("SELECT event_id, CASE WHEN x > 180 THEN x - 360 ELSE x END", "SELECT event_id, round(CASE WHEN x > 180 THEN x - 360 ELSE x END, 4)"))  # fmt: skip
def _(spark, d):
    return load(spark, d, "events").select("event_id", F.round(curves.circular_diff(F.round("value", 2), 15 * c("user_id")), 4).alias("diff"))


@query("range_weight", """SELECT p_partkey, round(CASE WHEN p_size < 10 THEN greatest((p_size - 5) / 5.0, 0) WHEN p_size > 30 THEN greatest((45 - p_size) / 15.0, 0) ELSE 1.0 END, 8)::DOUBLE AS weight FROM part""")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", F.round(curves.trapezoid(c("p_size"), 5, 10, 30, 45), 8).alias("weight"))


@query("mask_fold", """SELECT l_orderkey, l_linenumber, round((1 - (1 - 10 * l_discount)) * (1 - 5 * l_tax) * (l_quantity / 50), 8) AS weight FROM lineitem""")
def _(spark, d):
    parts = [("add", 10 * c("l_discount")), ("subtract", 5 * c("l_tax")), ("intersect", c("l_quantity") / 50)]
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(curves.mask_fold(parts), 8).alias("weight"))


@query("hue_bands", """SELECT CASE WHEN h >= 300 THEN 7 WHEN h >= 270 THEN 6 WHEN h >= 240 THEN 5 WHEN h >= 180 THEN 4 WHEN h >= 120 THEN 3 WHEN h >= 60 THEN 2
    WHEN h >= 30 THEN 1 ELSE 0 END AS band, count(*) AS n FROM (SELECT o_totalprice % 360 AS h FROM orders) GROUP BY 1""")  # fmt: skip
def _(spark, d):
    return load(spark, d, "orders").groupBy(curves.hue_band(c("o_totalprice")).alias("band")).agg(F.count("*").alias("n"))


_YS = (0.0, 0.06, 0.2, 0.5, 0.7, 0.86, 0.95, 1.0)


@query("tone_lut", "SELECT l_orderkey, l_linenumber, round(CASE WHEN x <= 0 THEN 0.0 "
    + " ".join(f"WHEN x < {b} THEN {e} + ({f} - {e}) * (x - {a}) / ({b} - {a})" for a, b, e, f in zip(curves.TONE_KNOTS, curves.TONE_KNOTS[1:], _YS, _YS[1:]))
    + " ELSE 1.0 END::DOUBLE, 6) AS tone FROM (SELECT l_orderkey, l_linenumber, 10 * l_discount AS x FROM lineitem)")
def _(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(curves.piecewise(10 * c("l_discount"), curves.TONE_KNOTS, _YS), 6).alias("tone"))


def _cells(spark, d):
    return load(spark, d, "lineitem").groupBy((c("l_partkey") % 40).alias("y"), (c("l_suppkey") % 40).alias("x")).agg(F.sum("l_linenumber").alias("v"))


_CELLS = "WITH g AS (SELECT l_partkey % 40 AS y, l_suppkey % 40 AS x, sum(l_linenumber) AS v FROM lineitem GROUP BY 1, 2) "
_NEAR = "FROM g a JOIN g b ON abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY 1, 2"


@query("box_mean_grid", _CELLS + f", p AS (SELECT a.y, a.x, sum(b.v) AS s, count(*) AS n {_NEAR}) SELECT y, x, round(s / n, 6) AS mean FROM p")
def _(spark, d):
    return grid.box_mean(_cells(spark, d), "y", "x", "v", 2).withColumn("mean", F.round("mean", 6))


@query("block_mean", _CELLS + "SELECT floor(y / 8)::BIGINT AS by, floor(x / 8)::BIGINT AS bx, round(avg(v), 6) AS mean, count(v) AS n FROM g GROUP BY 1, 2")
def _(spark, d):
    return grid.block_means(_cells(spark, d), "y", "x", "v", 8).withColumn("mean", F.round("mean", 6))


@query("dilate_grid", "WITH g AS (SELECT n_nationkey AS y, s.i AS x, (n_nationkey * 7 + s.i * 11) % 23 AS v FROM nation, range(25) s(i)) "
    "SELECT a.y, a.x, max(b.v) AS dilated FROM g a JOIN g b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2")  # fmt: skip
def _(spark, d):
    g = load(spark, d, "nation").select(c("n_nationkey").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("x"))
    return grid.dilate(g.withColumn("v", (c("y") * 7 + c("x") * 11) % 23), "y", "x", "v", 1)


@query("windowed_counts", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    out = windows.windowed_counts(load(spark, d, "events"), "ts", "event_type", "value", "1 hour")
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")  # fmt: skip
def _(spark, d):
    return windows.sessions(load(spark, d, "events"), "ts", "user_id", "30 minutes").select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("json_props", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return load(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("rollup_revenue", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, grouping_id(l_returnflag, l_linestatus) AS level
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")  # fmt: skip
def _(spark, d):
    revenue = F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2)
    return load(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), revenue.alias("revenue"), F.grouping_id().alias("level"))


@query("rank_customers", """SELECT n_name, c_custkey, rank() OVER w AS rank, ntile(4) OVER w AS quarter, lag(c_custkey) OVER w AS before
    FROM customer JOIN nation ON c_nationkey = n_nationkey WINDOW w AS (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey)""")  # fmt: skip
def _(spark, d):
    w = W.partitionBy("n_name").orderBy(F.desc("c_acctbal"), "c_custkey")
    j = load(spark, d, "customer").join(load(spark, d, "nation"), c("c_nationkey") == c("n_nationkey"))
    return j.select("n_name", "c_custkey", F.rank().over(w).cast("long").alias("rank"), F.ntile(4).over(w).cast("long").alias("quarter"), F.lag("c_custkey").over(w).alias("before"))


@query("set_operations", """SELECT k, kind FROM (SELECT k, 'both' AS kind FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT k, 'customers only' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier))""")  # fmt: skip
def _(spark, d):
    a, b = load(spark, d, "customer").select(c("c_nationkey").alias("k")), load(spark, d, "supplier").select(c("s_nationkey").alias("k"))
    return a.intersect(b).withColumn("kind", F.lit("both")).union(a.subtract(b).withColumn("kind", F.lit("customers only")))


@query("revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")  # fmt: skip
def _(spark, d):
    lines = load(spark, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.sum(c("l_extendedprice") * (1 - c("l_discount"))).alias("r"))
    j = lines.join(load(spark, d, "orders").select("o_orderkey", c("o_custkey").alias("c_custkey")), "o_orderkey")
    j = j.join(load(spark, d, "customer").select("c_custkey", c("c_nationkey").alias("n_nationkey")), "c_custkey").join(load(spark, d, "nation"), "n_nationkey")
    return j.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("orders"))
