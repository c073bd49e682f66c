"""Outlines, simplification, hulls, stencils, quantiles and selections on literal rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import outlines, quantiles, rasters, sampling, stencils


def cells(spark, *pictures):
    data = [(s, 1, r, c) for s, text in enumerate(pictures) for r, line in enumerate(text.split("/")) for c, x in enumerate(line) if x == "#"]
    return spark.createDataFrame(data, "scene int, region int, row_i int, col_i int")


def test_rings_of_a_hole_a_corner_and_a_bar(spark):
    got = outlines.rings(cells(spark, "####/#..#/####", "#./.#", "######"))
    area = {(r.scene, r.ring): (r.area, r.edges, r.corners) for r in outlines.ring_area(got).collect()}
    by_scene = {s: sorted(v for (k, _), v in area.items() if k == s) for s in range(3)}
    assert by_scene[0] == [(-2.0, 6, 4), (12.0, 14, 4)]  # ten cells: twelve around, two in the hole
    assert by_scene[1] == [(2.0, 8, 8)]  # cells that meet at a corner are one ring
    assert by_scene[2] == [(6.0, 14, 4)]
    assert {r.hole for r in got.filter("scene = 0 and last = 6").collect()} == {True}
    bar = [(r.x, r.y) for r in got.filter("scene = 2").orderBy("n").collect()]
    assert sorted(bar) == [(0.0, -1.0), (0.0, 0.0), (6.0, -1.0), (6.0, 0.0)] and bar.index((6.0, -1.0)) == (bar.index((0.0, -1.0)) + 1) % 4


def test_areas_of_random_outlines_are_their_cells(spark):
    rng = np.random.default_rng(3)
    grid = rng.random((14, 18)) < 0.6
    mask = spark.createDataFrame([("s", int(r), int(c)) for r, c in zip(*np.nonzero(grid))], "scene string, row_i int, col_i int")
    regions = rasters.connected_regions(mask).cache()
    area = {r.region: r.a for r in outlines.ring_area(outlines.rings(regions)).groupBy("region").agg(F.sum("area").alias("a")).collect()}
    assert area == {r.region: float(r["count"]) for r in regions.groupBy("region").count().collect()}
    one = outlines.ring_area(outlines.rings(regions)).groupBy("region").agg(F.count_if(F.col("area") > 0).alias("n")).collect()
    assert all(r.n == 1 for r in one)


def test_dropped_vertices_lie_within_the_tolerance(spark):
    rng = random.Random(1)
    rings = {k: [(np.cos(t) * (50 + rng.random() * 6), np.sin(t) * (50 + rng.random() * 6)) for t in np.linspace(0, 2 * np.pi, 80, endpoint=False)] for k in range(4)}
    v = spark.createDataFrame([(k, n + 1, float(x), float(y)) for k, p in rings.items() for n, (x, y) in enumerate(p)], "ring int, n int, x double, y double")
    for tolerance in (3.0,):
        got = {}
        for r in outlines.simplified(v, "ring", tolerance).orderBy("n").collect():
            got.setdefault(r.ring, []).append(r.n)
        for k, keep in got.items():
            assert keep[0] == 1 and len(keep) < 80
            for lo, hi in zip(keep, [*keep[1:], 81]):
                a, b = np.array(rings[k][lo - 1]), np.array(rings[k][(hi - 1) % 80])
                for n in range(lo + 1, hi):
                    p = np.array(rings[k][n - 1])
                    t = np.clip((p - a) @ (b - a) / max((b - a) @ (b - a), 1e-300), 0, 1)
                    assert np.hypot(*(p - a - t * (b - a))) <= tolerance + 1e-8
    assert outlines.simplified(v.limit(0), "ring", 1.0).count() == 0


def test_short_rings_need_no_rounds(spark, monkeypatch):
    """Rings inside tasks keep what the rounds keep, ties included, and rounds are for long rings only."""
    rng = np.random.default_rng(8)
    data = [(k, n + 1, float(x), float(y)) for k, size in enumerate([1, 2, 3, 40, 400, 90]) for n, (x, y) in enumerate(rng.integers(0, 12, (size, 2)))]
    v = spark.createDataFrame(data, "ring int, n int, x double, y double").repartition(3)
    rows = lambda: sorted(map(tuple, outlines.simplified(v, "ring", 4.0).collect()))
    rounds = outlines._in_rounds
    monkeypatch.setattr(outlines, "_in_rounds", None)
    short = rows()
    monkeypatch.setattr(outlines, "_in_rounds", rounds)
    monkeypatch.setattr(outlines, "SHORT_RING", 50)
    assert 6 < len(short) < len(data) and rows() == short
    monkeypatch.setattr(outlines, "SHORT_RING", 0)
    assert rows() == short


def test_back_off_and_notes(spark):
    shapes = {"square": [(0, 0), (5, 0.1), (10, 0), (10, 10), (0, 10)], "bow": [(0, 0), (20, 20), (20, 0), (0, 20)], "sliver": [(0, 0), (50, 1), (100, 0), (50, 0.5)]}
    v = spark.createDataFrame([(k, n + 1, float(x), float(y)) for k, p in shapes.items() for n, (x, y) in enumerate(p)], "ring string, n int, x double, y double")
    got = {}
    for r in outlines.outlined(v, "ring", 2.0).orderBy("n").collect():
        got.setdefault((r.ring, r.note), []).append((r.x, r.y))
    assert got == {("square", "simplified"): [(0, 0), (10, 0), (10, 10), (0, 10)], ("bow", "self-intersecting"): [(0, 0), (20, 20), (20, 0), (0, 20)], ("sliver", "simplified/4"): [(0, 0), (50, 1), (100, 0)]}


def test_hull_leaves_points_on_edges_out(spark):
    rng = np.random.default_rng(5)
    data = [("grid", float(x), float(y)) for x in range(6) for y in range(5)] + [("one", 1.0, 2.0)] * 3 + [("line", float(i), float(2 * i)) for i in range(5)] + [("up", 1.0, float(i)) for i in range(4)]
    data += [("cloud", *map(float, p)) for p in rng.integers(0, 1000, (400, 2))] + [("cloud", None, 1.0)]
    got = {}
    for r in rasters.hull(spark.createDataFrame(data, "grp string, x double, y double")).orderBy("n").collect():
        got.setdefault(r.grp, []).append((r.x, r.y))
    assert got["grid"] == [(0, 0), (5, 0), (5, 4), (0, 4)] and got["one"] == [(1, 2)] and got["line"] == [(0, 0), (4, 8)] and got["up"] == [(1, 0), (1, 3)]
    cloud = {p[1:] for p in data if p[0] == "cloud" and p[1] is not None}
    h = got["cloud"]
    for a, b, c in zip(h, h[1:] + h[:1], h[2:] + h[:2]):
        assert (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) > 0
        assert all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for p in cloud)


@pytest.mark.parametrize("held", [100_000, 12])
def test_quantiles_are_exact(spark, held):
    rng = np.random.default_rng(7)
    values = {"a": rng.lognormal(0, 4, 500).tolist(), "b": [1.0] * 60 + [2.0] * 3, None: [5.0, -3.0], "c": [float(2**k) for k in range(-40, 60)]}
    data = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("d", None), ("b", float("nan"))]
    df = spark.createDataFrame(data, "k string, v double")
    shares = [0.0, 0.005, 0.5, 0.9, 0.995, 1.0]
    got = {r.k: r.q for r in quantiles.quantiles(df, "v", shares, "k", held=held).collect()}
    assert got.pop("d") is None and set(got) == set(values)
    for k, q in got.items():
        assert q == pytest.approx(np.quantile(values[k], shares).tolist(), rel=1e-12)
    flat = [x for v in values.values() for x in v]
    assert quantiles.quantiles(df, "v", shares, held=held).first().q == pytest.approx(np.quantile(flat, shares).tolist(), rel=1e-12)


def raster(spark, values, invalid=()):
    return spark.createDataFrame([("s", r, c, float(v), (r, c) in invalid) for r, row in enumerate(values) for c, v in enumerate(row)], "scene string, row_i int, col_i int, value double, invalid boolean")


@pytest.mark.parametrize("size", [3, 5])
def test_medians_repeat_the_border(spark, size):
    v = np.random.default_rng(2).random((7, 9))
    pad = np.pad(v, size // 2, mode="edge")
    got = {(r.row_i, r.col_i): r.median for r in stencils.medians(raster(spark, v), size).collect()}
    assert got == {(r, c): np.median(pad[r : r + size, c : c + size]) for r in range(7) for c in range(9)}


@pytest.mark.parametrize("reach", [1, 3, 11])
def test_box_means_are_mirrored(spark, reach):
    v, bad = np.random.default_rng(4).random((5, 8)), {(0, 0), (2, 3), (4, 7)}
    ok = np.array([[(r, c) not in bad for c in range(8)] for r in range(5)], float)
    a, b = np.pad(v * ok, reach, mode="symmetric"), np.pad(ok, reach, mode="symmetric")
    w = 2 * reach + 1
    got = {(r.row_i, r.col_i): r.box_mean for r in stencils.box_means(raster(spark, v, bad), reach).collect()}
    assert got == {(r, c): pytest.approx(a[r : r + w, c : c + w].sum() / b[r : r + w, c : c + w].sum()) for r in range(5) for c in range(8)}


def test_gradients(spark):
    v = np.random.default_rng(6).random((6, 7))
    p = np.pad(v, 1, mode="reflect")
    x = sum(k * (p[i : i + 6, 2:] - p[i : i + 6, :-2]) for i, k in enumerate((1, 2, 1)))
    y = sum(k * (p[2:, i : i + 7] - p[:-2, i : i + 7]) for i, k in enumerate((1, 2, 1)))
    got = {(r.row_i, r.col_i): r.gradient for r in stencils.gradients(raster(spark, v), "value").collect()}
    assert got == {(r, c): pytest.approx(np.hypot(x, y)[r, c]) for r in range(6) for c in range(7)}


def test_blended_tiles_hold_every_cell(spark):
    v = np.arange(13 * 17, dtype=float).reshape(13, 17)
    out = stencils.blended(raster(spark, v), 6, 3, 1, lambda t: t.withColumn("score", F.col("tile_row") * 100.0 + F.col("tile_col"))).collect()
    starts = lambda n: sorted({min(s, n - 6) for s in range(0, n, 3)})
    inside = lambda at, s, n: (at >= s + 1 or s == 0) and (at < s + 5 or s + 6 >= n) and s <= at < s + 6
    want = {(r, c): [a * 100 + b for a in starts(13) for b in starts(17) if inside(r, a, 13) and inside(c, b, 17)] for r in range(13) for c in range(17)}
    assert {(r.row_i, r.col_i): (r.score, r.tiles) for r in out} == {k: (pytest.approx(np.mean(t)), len(t)) for k, t in want.items()}
    with pytest.raises(ValueError):
        stencils.overlapping(raster(spark, v), 6, 5, 1)


def test_tiles_of_a_cell_are_counted_from_it(spark):
    """Two cells of a scene of two thousand million rows: what a cell costs must not follow the extent."""
    far = 2_000_000_000
    cells = spark.createDataFrame([("s", 0, 0), ("s", far, 4)], "scene string, row_i int, col_i int")
    got = stencils.overlapping(cells, 8, 5, 1).collect()
    last, weight = far - 7, {(r.row_i, r.tile_row): (r.tile_col, r.weight) for r in got}
    assert weight == {(0, 0): (0, 1.0), (far, last): (0, 1.0), **{(far, s): (0, 0.0) for s in range(far // 5 * 5, far - 8, -5) if s < last}}


def test_features_do_not_follow_gain_and_offset(spark):
    v = np.random.default_rng(9).normal(-20, 1, (16, 16))
    v[5:10, 4:11] -= 7
    regions = spark.createDataFrame([("s", 1, r, c) for r in range(5, 10) for c in range(4, 11)], "scene string, region int, row_i int, col_i int")
    one, two = (rasters.region_features(raster(spark, x), regions, 2).first() for x in (v, 2.5 * v + 17))
    assert one.solidity == 1.0 and one.edge_sharpness > 1.2
    assert list(one) == [x if isinstance(x, str) else pytest.approx(x, rel=1e-9) for x in two]


def test_first_rows_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(0).alias("g"), (F.col("id") * 7919 % 5003).alias("v"))
    want = {}
    for r in df.collect():
        want.setdefault(r.g, []).append(r.v)
    assert {r.g: r.v for r in sampling.first_values(df, "v", 9, "g").collect()} == {g: sorted(v)[:9] for g, v in want.items()}
    top = sampling.top_with_remainder(df.withColumn("k", F.col("v")), "g", "v", "k", 2).collect()
    assert {(r.g, r.n): (r.v, r.remainder) for r in top} == {(g, i + 1): (sorted(v)[-1 - i], len(v) - 2) for g, v in want.items() for i in range(2)}
    even = sampling.evenly_spaced(df.distinct().groupBy("v").count(), "v", 13).collect()
    n = df.select("v").distinct().count()
    assert sorted(r.v for r in even) == [sorted({r.v for r in df.collect()})[i * n // 13] for i in range(13)]
