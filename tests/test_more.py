"""Brute-force checks and edge cases of fits, rasters, pairing, strings, sources and ordered release."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from sparkloom.functions import colour, strings
from sparkloom.operators import fits, pairing, raster
from sparkloom.sources import formats
from sparkloom.streaming import release


def test_pooling_is_the_nearest_rising_sequence():
    assert fits.pool_falls([1.0, 3.0, 2.0, 4.0], [1, 1, 3, 1]) == [1.0, 2.25, 2.25, 4.0]
    assert fits.pool_falls([3.0, 2.0, 1.0], [1, 1, 1]) == [2.0, 2.0, 2.0]
    assert fits.pool_falls([], []) == []


def test_robust_curve_passes_over_outliers(spark):
    rng = random.Random(1)
    rows = [(x := rng.random(), x * x + rng.gauss(0, 0.01), 1.0) for _ in range(4000)] + [(rng.random(), 9.0, 1.0) for _ in range(200)] + [(None, 1.0, 1.0), (0.5, None, 1.0)]
    got = fits.robust_curve(spark.createDataFrame(rows, "x double, y double, w double"), F.col("x"), F.col("y"), F.col("w"), 16, 3).collect()
    assert len(got) == 16
    assert all(abs(r.value - ((r.bin + 0.5) / 16) ** 2) < 0.02 for r in got)
    assert all(a.value <= b.value for a, b in zip(got, got[1:]))


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(300, 3)), rng.random(300)
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=300) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(t), float(g)) for r, t, g in zip(x, y, w)] + [(None, 1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, t double, g double")
    got = {r.feature: r.coefficient for r in fits.least_squares(df, {n: F.col(n) for n in "abc"}, F.col("t"), F.col("g")).collect()}
    s = np.sqrt(w)[:, None]
    want = np.linalg.lstsq(x * s, y * s[:, 0], rcond=None)[0]
    assert np.allclose([got[n] for n in "abc"], want)


def test_fits_without_support_are_null(spark):
    df = spark.createDataFrame([("k", 1.0, 2.0), ("k", 1.0, 3.0), ("k", None, 1.0)], "k string, x double, y double")
    r = fits.slope_with_error(df, ["k"], F.col("x"), F.col("y"), F.lit(1)).collect()[0]
    assert (r.n, r.slope, r.error) == (2, None, None)
    assert fits.plane(df, ["k"], F.col("x"), F.col("x"), F.col("y"), F.lit(1)).collect()[0][1:] == (None, None, None)
    assert fits.quantile_map(df, df.limit(0), "k", "x", F.lit(1)).collect()[0].mapped is None
    assert fits.merge_exposures(df, ["k"], F.lit(1.0), F.lit(0)).collect()[0][1:] == (None, 0)


def _grid(spark, a):
    return spark.createDataFrame([(y, x, float(v)) for (y, x), v in np.ndenumerate(a)], "y long, x long, value double")


def test_regions_against_flood_fill(spark):
    a = np.random.default_rng(3).integers(0, 2, (14, 17))
    got = {(r.y, r.x): r.region for r in raster.regions(_grid(spark, a), F.when(F.col("value") > 0, F.lit(1))).collect()}
    want = {}
    for y, x in zip(*np.nonzero(a)):
        if (y, x) in want:
            continue
        todo, part = [(y, x)], set()
        while todo:
            p = todo.pop()
            if p not in part and 0 <= p[0] < 14 and 0 <= p[1] < 17 and a[p]:
                part.add(p)
                todo += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
        want |= dict.fromkeys(part, min(int(q[0]) << 32 | int(q[1]) for q in part))
    assert got == {(int(y), int(x)): r for (y, x), r in want.items()}


def test_holes_are_left_out_and_copies_shift(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (0, 5, 7.0)], "y long, x long, value double")
    soft = {r.x: r.value for r in raster.convolve(cells, [1.0, 1.0, 1.0]).collect()}
    assert soft == {0: 2.0, 1: 2.0, 5: 7.0}
    a = np.random.default_rng(4).random((9, 9))
    best = raster.shift_correlations(_grid(spark, a), _grid(spark, np.roll(a, (1, -2), (0, 1))), 2).orderBy(F.desc("r")).first()
    assert (best.dy, best.dx) == (1, -2) and best.r > 0.9
    assert raster.sample_bilinear(spark.createDataFrame([(1, 0.0, 0.25)], "id int, y double, x double"), cells, "id", F.col("y"), F.col("x")).collect()[0].value == 1.5


def test_overlaps_and_suppression_against_brute_force(spark):
    rng = random.Random(5)
    boxes = [(i, x := rng.random() * 40 - 20, y := rng.random() * 40 - 20, x + 1 + rng.random() * 9, y + 1 + rng.random() * 9, rng.randrange(20)) for i in range(160)]
    df = spark.createDataFrame(boxes + [(900, None, 0.0, 1.0, 1.0, 3), (901, 1.0, 1.0, 1.0, 2.0, 3)], "id long, x0 double, y0 double, x1 double, y1 double, s long")

    def iou(p, q):
        i = max(0, min(p[3], q[3]) - max(p[1], q[1])) * max(0, min(p[4], q[4]) - max(p[2], q[2]))
        return i / ((p[3] - p[1]) * (p[4] - p[2]) + (q[3] - q[1]) * (q[4] - q[2]) - i)

    links = pairing.overlapping_boxes(df, "id", 0.2, 5.0)
    got = sorted((r.a, r.b, round(r.iou, 9)) for r in links.collect())
    want = sorted((p[0], q[0], round(iou(p, q), 9)) for p in boxes for q in boxes if p[0] < q[0] and iou(p, q) >= 0.2)
    assert got == want and len(want) > 20
    kept = []
    for p in sorted(boxes, key=lambda p: (-p[5], p[0])):
        if all(iou(p, q) < 0.2 for q in kept):
            kept.append(p)
    assert sorted(r.id for r in pairing.suppress(df, links, "id", "s").collect()) == sorted([p[0] for p in kept] + [900, 901])


def test_one_to_one_against_the_ordered_pass(spark):
    rng = random.Random(6)
    a, b = ([(i, rng.randrange(60) / 2, rng.randrange(60) / 2) for i in range(80)] for _ in range(2))
    dfs = [spark.createDataFrame(p, "id long, x double, y double") for p in (a, b)]
    near = pairing.points_within(*dfs, "id", 4.0)
    pairs = sorted((math.dist(p[1:], q[1:]), p[0], q[0]) for p in a for q in b if math.dist(p[1:], q[1:]) <= 4)
    assert near.count() == len(pairs)
    used_a, used_b, want = set(), set(), []
    for _, i, j in pairs:
        if i not in used_a and j not in used_b:
            used_a.add(i), used_b.add(j), want.append((i, j))
    assert sorted((r.a, r.b) for r in pairing.one_to_one(near).collect()) == sorted(want)
    assert pairing.one_to_one(near.limit(0)).collect() == []


def test_strings(spark):
    rows = [
        ("/a/./b/../../../c", "/c"), ("a/../../b", "../b"), ("", ""), ("/..", "/"), (None, None), ("../../x/..", "../.."),
    ]
    df = spark.createDataFrame(rows, "p string, want string")
    assert [r.got for r in df.select(strings.normal_path(F.col("p")).alias("got")).collect()] == [w for _, w in rows]
    one = lambda e, t: spark.createDataFrame([(t,)], "t string").select(e(F.col("t"))).collect()[0][0]
    assert one(strings.tidy_phrases, "soft, natural., Soft,, atmospheric , soft") == "soft, natural, atmospheric"
    assert one(strings.redact_paths, r"no /home/me/a.jpg or C:\x\b.raw (https://h/p)") == "no a.jpg or b.raw (https://h/p)"
    assert one(strings.percent_encode, "a b+~*é") == "a%20b%2B~%2A%C3%A9"
    assert one(strings.percent_decode, "a%20b+%C3%A9") == "a b+é" and one(strings.percent_decode, "%zz") is None
    assert one(lambda t: strings.fill_template(t, {"a": F.lit("{b}"), "b": F.lit(2), "c": F.lit(None)}), "x{a}{b}-{c}{d}") == "x{b}2-{c}{d}"


def test_colours(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (0.0, 0.0, 1.0)], "r double, g double, b double")
    rgb = [F.col(x) for x in "rgb"]
    (white, blue) = df.select(*colour.cie_lab(*rgb), colour.hue(*rgb)).collect()
    assert np.allclose(white, (100, 0, 0, 0), atol=1e-2) and np.allclose(blue, (32.30, 79.19, -107.86, 240), atol=2e-2)
    shares = spark.createDataFrame([(330.0,), (-330.0,)], "h double").select(colour.band_shares(F.col("h"))).collect()
    assert [[tuple(s) for s in r[0]] for r in shares] == [[(7, 0.5), (0, 0.5)], [(1, 1.0), (2, 0.0)]]


def test_formats_keep_nulls_and_empty_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"\nc", "x"), (2, "", "y"), (3, None, "x")], "i int, t string, p string")
    for kind in ("csv", "json", "orc", "parquet"):
        formats.write_table(df, str(tmp_path / kind), kind, by=["p"])
        got = formats.read_table(spark, str(tmp_path / kind), "i int, t string, p string", kind).orderBy("i").collect()
        assert [tuple(r) for r in got] == [(1, "a,\"b\"\nc", "x"), (2, "", "y"), (3, None, "x")], kind


def test_log_and_sidecars(spark, tmp_path):
    log, schema = str(tmp_path / "log"), "k string, v long, at long"
    formats.append_log(spark.createDataFrame([("a", 1, 1), ("b", 5, 2)], schema), log, "v2", "at")
    formats.append_log(spark.createDataFrame([("a", 2, 3), (None, 9, 4)], schema), log, "v2", "at")
    formats.append_log(spark.createDataFrame([("a", 7, 9)], schema), log, "v1", "at")
    (tmp_path / "log" / "broken.json").write_text('{"k": "a", "v": \n')
    assert {r.k: r.v for r in formats.replay_log(spark, log, "k string, v long", "k", "v2").collect()} == {"a": 2, "b": 5}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "p.xmp").write_text("<x crs:Tint=\"+5\"\n crs:Name = 'a &amp;lt; \"b\"'/>")
    got = [(r.name, r.value) for r in formats.read_sidecars(spark, str(tmp_path / "s")).collect()]
    assert got == [("crs:Tint", "+5"), ("crs:Name", 'a &lt; "b"')]


def test_stream_releases_in_order(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, i, f"{k}{i}") for k in "ab" for i in range(12) if (k, i) != ("b", 7)] + [("a", 3, "late copy"), (None, 0, "x")]
    rng.shuffle(rows)
    src = tmp_path / "in"
    for n in range(4):
        spark.createDataFrame(rows[n::4], "k string, i long, v string").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("k string, i long, v string").option("maxFilesPerTrigger", 1).parquet(str(src))
    run = release.release_in_order(stream, "k", "i", "v").writeStream.format("memory").queryName("released").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(180)
    got = {}
    for r in spark.table("released").collect():
        got.setdefault(r.k, []).append(r.i)
    assert got == {"a": list(range(12)), "b": list(range(7))}
    batch = spark.createDataFrame(rows, "k string, i long, v string").where("k IS NOT NULL")
    assert {(r.k, r.i) for r in release.releasable(batch, "k", "i").collect()} == {(k, i) for k, v in got.items() for i in v}
