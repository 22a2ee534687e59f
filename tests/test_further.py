"""Edge cases of keyed records, outlines, knots and markup."""

import random

from pyspark.sql import functions as F

from sparkloom.functions import colour, markup
from sparkloom.operators import knots, measures, outlines, records


def test_nearest_within_against_brute_force(spark):
    rng = random.Random(3)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(30)])) for i in range(80)]
    right = [(i, rng.choice(["a", "b", "c"]), rng.choice([None, *range(0, 60, 4)])) for i in range(40)]
    got = records.nearest_within(spark.createDataFrame(left, "l long, k string, x int"), spark.createDataFrame(right, "r long, k string, x int"), "k", "x", "l", "r", 3)
    want = {}
    for i, k, x in left:
        near = [(abs(x - y), y, j) for j, m, y in right if k is not None and m == k and None not in (x, y) and abs(x - y) <= 3]
        if near:
            want[i] = (min(near)[2], min(near)[0])
    assert {r.l: (r.r, r.distance) for r in got.collect()} == want and want


def test_updates_keep_what_they_do_not_name(spark):
    log = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, 5), ("a", 3, "y", None), (None, 4, "z", 1), ("b", None, "n", 1)], "k string, o int, s string, n int")
    assert {r.k: (r.s, r.n) for r in records.merged_updates(log, "k", "o", ["s", "n"]).collect()} == {"a": ("y", 5), "b": (None, None)}


def test_numbers_are_not_given_twice(spark):
    requests = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, o int")
    taken = spark.createDataFrame([("a", 3, 7), ("a", 4, None)], "k string, n int, m int")
    assert sorted((r.k, r.o, r.allocated) for r in records.allocate_numbers(requests, taken, "k", "o", "n", "m").collect()) == [("a", 1, 8), ("a", 2, 9), ("b", 1, 1)]


def test_budget_ends_at_the_first_text_that_does_not_fit(spark):
    rows = spark.createDataFrame([("a", 1, "éé"), ("a", 2, None), ("a", 3, "x" * 9), ("a", 4, "y"), ("b", 1, "z" * 50)], "k string, o int, t string")
    assert [tuple(r) for r in records.budgeted_text(rows, "k", "o", "t", 10).collect()] == [("a", 1, "éé")]


def test_polygon_with_a_hole_and_beyond_the_raster(spark):
    ring = lambda a, b: [(a, a, b, a), (b, a, b, b), (b, b, a, b), (a, b, a, a)]
    sides = [(1, *map(float, s)) for s in ring(-3, 6) + ring(2, 4)] + [(2, None, 0.0, 1.0, 1.0)]
    spans = outlines.polygon_spans(spark.createDataFrame(sides, "id int, x0 double, y0 double, x1 double, y1 double"), "id", 8, 8).collect()
    cells = {(x, r.y) for r in spans for x in range(r.x_from, r.x_to + 1)}
    assert cells == {(x, y) for x in range(6) for y in range(6) if not (2 <= x < 4 and 2 <= y < 4)}


def test_coverage_of_full_and_null_dabs(spark):
    dabs = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 1.0), (2, None), (3, None), (4, 7.0), (5, -1.0)], "c int, a double")
    assert {r.c: round(r.coverage, 9) for r in outlines.screen_coverage(dabs, ["c"], F.col("a")).collect()} == {1: 0.75, 2: 1.0, 3: 0.0, 4: 1.0, 5: 0.0}


def test_monotone_curve_stays_between_its_knots(spark):
    points = [("k", 0.0, 0.0), ("k", 1.0, 1.0), ("k", 1.0, 0.5), ("k", 3.0, 1.0), ("k", 4.0, 4.0), ("k", 6.0, 2.0), ("one", 2.0, 9.0), ("two", 0.0, 1.0), ("two", 2.0, 5.0), (None, 1.0, 1.0)]
    sloped = knots.monotone_slopes(spark.createDataFrame(points, "k string, x double, y double"), "k", "x", "y")
    by = {(r.k, r.x): r.slope for r in sloped.collect()}
    assert by["k", 1.0] == by["k", 3.0] == by["k", 4.0] == 0 and by["one", 2.0] == 0 and by["two", 0.0] == by["two", 2.0] == 2
    probes = spark.createDataFrame([("k", x / 8) for x in range(-8, 64)] + [("two", 0.5), ("one", 5.0), ("none", 1.0)], "k string, x double")
    at = {(r.k, r.x): r.value for r in knots.hermite_at(sloped, probes, "k", "x", "y").collect()}
    assert at["two", 0.5] == 2 and at["one", 5.0] == 9 and at["none", 1.0] is None and at["k", -1.0] == 0 and at["k", 7.0] == 2
    assert all(0 <= at["k", x / 8] <= at["k", (x + 1) / 8] <= 4 for x in range(0, 31)) and all(at["k", x / 8] >= at["k", (x + 1) / 8] for x in range(32, 48))


def test_nested_elements_close_at_their_own_depth(spark):
    docs = spark.createDataFrame([(1, "</b><b><b x='1'>t</b><i></b><b>"), (2, None), (3, "")], "id int, m string")
    # tags from 0: </b> <b> <b> </b> <i> </b> <b>
    got = sorted((r.name, r.opened, r.closed) for r in markup.element_spans(docs.where("id > 1"), "id", "m", ["b", "i"]).collect())
    assert got == []
    docs = spark.createDataFrame([(1, "<b><b x='1'>t</b><i></b><b>")], "id int, m string")
    got = sorted(((r.name, r.opened, r.closed) for r in markup.element_spans(docs, "id", "m", ["b", "i"]).collect()), key=str)
    assert got == [("b", 0, 4), ("b", 1, 2), ("b", 5, None), ("i", 3, None)]


def test_messages_end_at_done(spark):
    lines = [": hi", "data: a", "data:b", "event: x", "", "", "id: 1", "", "data:  c", "", "data: [DONE]", "", "data: late", ""]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(lines)] + [("t", 0, "data: open"), ("u", 0, None)], "k string, n int, t string")
    assert sorted(map(tuple, markup.framed_events(df, "k", ["n"], "t").collect())) == [("s", 0, "a\nb"), ("s", 1, " c"), ("t", 0, "open")]


def test_text_of_points_and_fractions(spark):
    df = spark.createDataFrame([("<li> 3 ,4</li><li>256, 0</li><li>x,1</li>", "3/4", "a​b"), (None, "1/0", None), ("", " 2.5 ", ""), ("<li>1</li>", "1/2/3", "é")], "p string, f string, s string")
    got = [([tuple(p) for p in r[0]] if r[0] is not None else None, r[1], r[2]) for r in df.select(markup.curve_points(F.col("p")), markup.fraction(F.col("f")), markup.strip_invisible(F.col("s"))).collect()]
    assert got == [([(3, 4)], 0.75, "ab"), (None, None, None), ([], 2.5, ""), ([], None, "é")]


def test_binned_quantiles_of_even_values_and_clamped_ends(spark):
    df = spark.createDataFrame([("a", float(i) + 0.5) for i in range(100)] + [("b", -5.0), ("b", 900.0), (None, 1.0), ("c", None)], "k string, v double")
    got = {(r.k, r.step): r.quantile for r in measures.binned_quantiles(df, "k", F.col("v"), 0.0, 100.0, 50, 4).collect()}
    assert {k: v for k, v in got.items() if k[0] == "a"} == {("a", i): 25.0 * i for i in range(5)}
    assert got["b", 0] == 0.0 and got["b", 2] == 2.0 and got["b", 4] == 100.0 and len(got) == 10


def test_gap_of_shifted_sides(spark):
    df = spark.createDataFrame([("a", s, float(i % 50) + 10 * s) for i in range(1000) for s in (0, 1)] + [("b", 1, 3.0)], "k string, s int, v double")
    (row,) = measures.quantile_gap(df, "k", F.col("s") == 1, F.col("v"), 0.0, 128.0, 128).collect()
    assert row.k == "a" and abs(row.gap - 10) < 1e-9


def test_consensus_gives_way_to_opposition(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("a", -1.0, 1.0), ("b", 2.0, 9.0), ("b", -2.0, 1.0), ("b", None, 5.0), ("b", 4.0, 0.0)], "k string, v double, w double")
    assert {r.k: (r.consensus, r.opposed) for r in measures.consensus(df, "k", "v", "w", 0.25).collect()} == {"a": (0.0, 0.25), "b": (2.0, 0.1)}


def test_biweight_leaves_far_values_out_and_equal_values_alone(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5, 1000)] + [("b", 7.0)] * 3 + [("c", None)], "k string, v double")
    got = {r.k: (r["mean"], r.n) for r in measures.biweight_mean(df, "k", "v").collect()}
    assert 2.5 < got["a"][0] < 3.5 and got["a"][1] == 6 and got["b"] == (7.0, 3) and "c" not in {k for k, v in got.items() if v[0] is not None}


def test_frames_without_weight_or_detail(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 0.0), (1, 2, 4.0, None), (2, 1, 2.0, 1.0), (2, 2, 6.0, 3.0), (3, 1, None, 1.0), (4, 2, 5.0, 1.0), (4, 1, 8.0, 1.0)], "c int, f int, v double, w double")
    assert {r.c: r.value for r in measures.fused(df, ["c"], F.col("v"), F.col("w")).collect()} == {1: 3.0, 2: 5.0, 4: 6.5}
    assert {r.c: (r.f, r.v) for r in measures.sharpest(df, ["c"], "f", "v", F.col("w")).collect()} == {1: (1, 2.0), 2: (2, 6.0), 4: (1, 8.0)}


def test_greys_and_pure_colours_in_hsl(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.5, 0.5, 0.5), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.2, 0.2, 0.9)], "r double, g double, b double")
    rows = df.select("*", *(x.alias(n) for n, x in zip("hsl", colour.to_hsl(F.col("r"), F.col("g"), F.col("b"))))).collect()
    assert [round(r.h) for r in rows] == [0, 0, 0, 0, 120, 240] and [r.s for r in rows][:5] == [0, 0, 0, 1, 1]
    grey = df.select(*colour.more_colour(F.col("r"), F.col("g"), F.col("b"), -1.0)).collect()
    assert all(abs(r[0] - r[1]) < 1e-12 and abs(r[1] - r[2]) < 1e-12 for r in grey)
