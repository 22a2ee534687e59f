"""Edge cases of the library's own operators."""

import math

from pyspark.sql import functions as F

from sparkloom.functions import curves, texts
from sparkloom.operators import matching, search, stats
from sparkloom.operators.graph import connected_components
from sparkloom.streaming import windows


def test_components_of_chains_loops_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(map(tuple, connected_components(df, "a", "b").collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200}
    assert connected_components(df.limit(0), "a", "b").collect() == []


def test_diverse_search_passes_over_copies(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [1.0, 0.01]), (3, [0.5, 1.0]), (4, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    s = search.scores(v, F.col("vec_id") == 0)
    assert [r.vec_id for r in search.top_k(s, 3).orderBy("rank").collect()] == [1, 2, 3]
    assert [r.vec_id for r in search.diverse_top_k(s, v, 3, 0.97).orderBy("rank").collect()] == [1, 3]


def test_diverse_search_looks_past_a_large_group_of_copies(spark):
    rows = [(0, [1.0, 0.0])] + [(i, [1.0, 0.01]) for i in range(1, 61)] + [(i, [0.5, 1.0]) for i in range(61, 121)] + [(200, [-1.0, 0.5])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    s = search.scores(v, F.col("vec_id") % 200 == 0)
    got = [tuple(r)[:3] for r in search.diverse_top_k(s, v, 3, 0.97).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 61), (0, 3, 200), (200, 1, 61), (200, 2, 1)]


def test_weights_of_zero_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 0.0), ("a", 3.0, 3.0), ("a", None, 9.0)], "k string, v double, w double")
    assert stats.weighted_quantiles(df, "k", "v", "w", [0.25, 0.5]).collect()[0][1:] == (1.0, 3.0)
    z = {r.v: r.z for r in stats.z_scores(df.where("v < 3"), "k", "v").collect()}
    assert z == {1.0: 1.0, 2.0: 2.0}  # fewer than three rows: the raw value


def test_brackets_beyond_the_ends(spark):
    p = spark.createDataFrame([("k", 1.0, 10.0), ("k", 3.0, 30.0)], "k string, x double, y double")
    q = spark.createDataFrame([("k", x, None) for x in (0.0, 1.0, 2.0, 4.0)] + [("other", 1.0, None)], "k string, x double, y double")
    got = {(r.k, r.x): r.value for r in matching.bracket_lerp(p, q, "k", "x", "y").collect()}
    assert got == {("k", 0.0): 10.0, ("k", 1.0): 10.0, ("k", 2.0): 20.0, ("k", 4.0): 30.0, ("other", 1.0): None}


def test_prefix_followed_by_a_digit_is_no_match(spark):
    names = spark.createDataFrame([("frame0264F",), ("frame02641",), ("frame0264",), (None,)], "n string")
    got = {r.n: r.p for r in matching.longest_prefix(names, spark.createDataFrame([("frame0264",)], "p string"), "n", "p").collect()}
    assert got == {"frame0264F": "frame0264", "frame0264": "frame0264"}


def test_scalar_laws(spark):
    x = F.col("x")
    df = spark.createDataFrame([(350.0,), (10.0,), (None,)], "x double")
    assert [r[0] for r in df.select(curves.circular_diff(x, F.lit(0.0))).collect()] == [-10.0, 10.0, None]
    assert [r[0] for r in df.select(curves.trapezoid(x, 0, 20, 300, 400)).collect()] == [0.5, 0.5, None]
    t = spark.createDataFrame([("&amp;lt; \x01 a",)], "t string").select(texts.xml_unescape(F.col("t")), texts.sanitize(F.col("t"), 7)).collect()[0]
    assert t[0] == "&lt; \x01 a" and t[1] == "&amp;lt"


def test_stream_and_batch_agree(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = windows.windowed_counts(stream, "ts", "event_type", "value", "1 day")
    run = out.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = windows.windowed_counts(events, "ts", "event_type", "value", "1 day").collect()
    key = lambda r: (r.start, r.event_type)
    got = sorted(spark.table("counts").collect(), key=key)
    assert [(key(r), r.n) for r in got] == [(key(r), r.n) for r in sorted(want, key=key)]
    assert all(math.isclose(a.total, b.total) for a, b in zip(got, sorted(want, key=key)))


def test_zero_vectors_zero_weights_and_empty_sides_do_not_fail(spark):
    from pyspark.sql import functions as F

    from sparkloom.operators import search, stats

    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (4, None), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.vec_id) for r in search.scores(v, F.lit(True)).collect()} == {(2, 3), (3, 2)}
    assert search.scores(v.limit(0), F.lit(True)).collect() == []
    w = spark.createDataFrame([("a", 1.0, 2.0, 0.0), ("a", 2.0, 3.0, 0.0), ("b", 1.0, 1.0, 1.0), ("b", 2.0, 3.0, 1.0), ("b", None, 3.0, 1.0)], "k string, x double, y double, w double")
    got = {r.k: (r.slope, r.intercept, r.n_eff) for r in stats.weighted_line(w.where("x IS NOT NULL"), ["k"], "x", "y", "w").collect()}
    assert got == {"a": (None, None, None), "b": (2.0, -1.0, 2.0)}
    side = stats.two_sided_bins(w, F.col("k"), F.lit(True))
    assert {(r.bin, r.share_a, r.share_b, r.weight) for r in side.collect()} == {("a", 0.4, 0.0, 0.0), ("b", 0.6, 0.0, 0.0)}
    assert stats.two_sided_bins(w.limit(0), F.col("k"), F.lit(True)).collect() == []
