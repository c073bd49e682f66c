"""As-of joins, grids, scenes, rings and screening on small literal frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import asof, cases, geometry, grids, scenes, screening, shortlist


def test_bracket_clamps_and_breaks_ties_to_the_earlier(spark):
    axis = spark.createDataFrame([(0, 0), (1, 10), (2, 14), (3, 14), (4, 100)], "step int, at long")
    t = spark.createDataFrame([(-5,), (0,), (5,), (12,), (14,), (57,), (100,), (400,), (None,)], "t long")
    got = {r.t: (r.before, r.after, r.weight, r.gap, r.nearest) for r in asof.bracket(t, "t", axis, "step", "at", 7).collect()}
    assert got[-5] == (0, 1, 0.0, 5, 0) and got[5] == (0, 1, 0.5, 0, 0) and got[12] == (1, 2, 0.5, 0, 1)
    assert got[14] == (2, 4, 0.0, 0, 2) and got[57] == (2, 4, 0.5, 0, 2) and got[100] == (4, 4, 0.0, 0, 4) and got[400] == (4, 4, 0.0, 300, 4)
    assert got[None] == (None, None, None, None, None)
    one = spark.createDataFrame([(7, 50)], "step int, at long")
    assert {r.nearest for r in asof.bracket(t.filter("t is not null"), "t", one, "step", "at", 7).collect()} == {7}


def test_bracket_of_a_sparse_axis_needs_few_bins(spark):
    """Silences of years beside steps of seconds, against a plain search; and an axis without steps."""
    at = sorted({int(x) for x in np.random.default_rng(1).integers(0, 500, 60)} | {10**12, 10**12 + 3, 3 * 10**15, 3 * 10**15 + 10**9})
    axis = spark.createDataFrame([(i, x) for i, x in enumerate(at)], "step int, at long").repartition(5)
    times = [*range(-3, 505, 7), 10**9, 10**12 + 1, 10**15, 2 * 10**15, 3 * 10**15 + 5, 4 * 10**15]
    t = spark.createDataFrame([(x,) for x in times], "t long")
    got = {r.t: (r.before, r.after, r.nearest) for r in asof.bracket(t, "t", axis, "step", "at", 1).collect()}
    assert len(got) == len(times)
    for x in times:
        k = min(max(x, at[0]), at[-1])
        i = int(np.searchsorted(at, k, "right")) - 1
        j = min(i + 1, len(at) - 1)
        assert got[x] == (i, j, j if at[j] - k < k - at[i] else i)
    none = asof.bracket(t, "t", axis.limit(0), "step", "at", 1)
    assert none.count() == len(times) and none.filter("before is not null").count() == 0


def test_time_units(spark):
    df = spark.createDataFrame([("hours since 1970-01-01 00:00:00",), ("days since 1950-1-1",), ("fortnights since 2000-01-01",), ("hours",), (None,)], "u string")
    scale, epoch = grids.time_units(F.col("u"))
    assert [(r.s, r.e) for r in df.select(scale.alias("s"), epoch.alias("e")).collect()] == [(3600, 0), (86400, -631152000000000), (None, None), (None, None), (None, None)]


def test_axis_roles():
    assert grids.axis_roles([24, 1], 24, 1) == ["time", "depth"]
    assert grids.axis_roles([1, 24], 24, 1) == ["depth", "time"]
    assert grids.axis_roles([5], 24, 1) == ["time"]
    assert grids.axis_roles([24, 24], 24, 1) == ["time", "other"]


def test_decoding_masks_before_it_scales(spark):
    df = spark.createDataFrame([(-32768,), (5,), (200,), (None,)], "x int")
    assert [r.v for r in df.select(grids.decode(F.col("x"), fill=-32768, most=100, scale=0.5, offset=1.0).alias("v")).collect()] == [None, 3.5, None, None]


def test_invalid_pixels(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 2.0), (1.0, float("nan")), (float("inf"), 1.0), (None, 1.0)], "a double, b double")
    assert [r.x for r in df.select(scenes.invalid([F.col("a"), F.col("b")], F.lit(0.0)).alias("x")).collect()] == [False, True, True, True, True]
    # a header's value goes before the file's
    assert [r.x for r in df.select(scenes.invalid([F.col("a")], F.lit(0.0), F.lit(1.0)).alias("x")).collect()][:2] == [True, False]


def test_four_quarter_turns_are_none(spark):
    df = spark.createDataFrame([(r, c, r * 5 + c) for r in range(5) for c in range(5)], "row_i int, col_i int, v int")
    out = df
    for _ in range(4):
        out = scenes.turned(out, 5, "quarter")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    assert {tuple(r) for r in scenes.turned(scenes.turned(df, 5, "quarter"), 5, "three_quarters").collect()} == {tuple(r) for r in df.collect()}


def test_box_means_leave_invalid_pixels_out(spark):
    df = spark.createDataFrame([("s", r, c, float(r * 4 + c), (r, c) == (1, 1)) for r in range(4) for c in range(4)], "scene string, row_i int, col_i int, value double, invalid boolean")
    got = {(r.row_i, r.col_i): r.box_mean for r in scenes.box_means(df, 1).collect()}
    for (r, c), m in got.items():
        near = [i * 4 + j for i in (min(max(k, 0), 3) for k in range(r - 1, r + 2)) for j in (min(max(k, 0), 3) for k in range(c - 1, c + 2)) if (i, j) != (1, 1)]
        assert m == pytest.approx(np.mean(near))


def test_a_bow_tie_crosses_and_a_square_does_not(spark):
    rings = {"bow": [(0, 0), (2, 2), (2, 0), (0, 2)], "square": [(0, 0), (2, 0), (2, 2), (0, 2)], "triangle": [(0, 0), (1, 0), (0, 1)], "flat": [(1, 0), (1, 1), (1, 2), (1, 3)]}
    v = spark.createDataFrame([(k, n + 1, float(x), float(y)) for k, p in rings.items() for n, (x, y) in enumerate(p)], "ring string, n int, x double, y double")
    assert {r.ring: r.crosses for r in geometry.self_intersects(v, "ring").collect()} == {"bow": True, "square": False, "triangle": False, "flat": False}
    m = {r.ring: r for r in geometry.measures(v, "ring").collect()}
    assert (m["square"].area, m["square"].winding, m["square"].compactness) == (4.0, "ccw", pytest.approx(np.pi / 4))
    cw = {r.ring: r.winding for r in geometry.measures(geometry.oriented(v, "ring", ccw=False), "ring").collect()}
    assert cw["square"] == cw["triangle"] == "cw"


def test_transforms_have_inverses():
    t = [-92.0, 0.3, 0.1, 30.0, 0.05, -0.4]
    a, b, c, d, e, f = geometry.inverse(t)
    x, y = t[0] + t[1] * 7 + t[2] * 9, t[3] + t[4] * 7 + t[5] * 9
    assert (a + b * x + c * y, d + e * x + f * y) == (pytest.approx(7), pytest.approx(9))
    with pytest.raises(ValueError):
        geometry.inverse([0, 1, 1, 0, 1, 1])


def test_fit_equals_full_batch_descent(spark):
    rng = np.random.default_rng(2)
    n, names = 300, ["a", "b", "c"]
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 3, -1]
    y = (x @ [1.0, 0.2, 2.0] + rng.normal(size=n) > 0).astype(float)
    model, bias = screening.fit(spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, y int"), names)
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-6)
    s = np.where(y > 0.5, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    s /= s.sum()
    w, b = np.zeros(3), 0.0
    for _ in range(20_000):
        g = (1 / (1 + np.exp(-np.clip(z @ w + b, -60, 60))) - y) * s
        w -= 0.2 * (z.T @ g + w / n)
        b -= 0.2 * g.sum()
    assert np.allclose([model[k][0] for k in names], w, atol=1e-4) and abs(bias - b) < 1e-4
    with pytest.raises(ValueError):
        screening.fit(spark.createDataFrame([(1.0, 1)] * 9, "a double, y int"), ["a"])


def test_folds_keep_groups_whole_and_even(spark):
    df = spark.createDataFrame([(g, i) for g, n in enumerate([50, 30, 20, 20, 10, 10, 5, 5]) for i in range(n)], "g int, i int")
    got = screening.folds(df, "g", 3, 1)
    assert got.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n <> 1").count() == 0
    sizes = [r["count"] for r in got.groupBy("fold").count().collect()]
    assert len(sizes) == 3 and max(sizes) - min(sizes) <= 10


def test_verdicts_at_the_limits(spark):
    df = spark.createDataFrame([(0.35,), (0.5,), (0.65,), (None,)], "p double")
    assert [r.v for r in df.select(screening.verdict(F.col("p")).alias("v")).collect()] == ["rejected", "uncertain", "accepted", "uncertain"]


def test_allow_list_and_names(spark):
    df = spark.createDataFrame([("A@x.org",), ("b@gov.example",), ("c@other.org",)], "a string")
    ok = lambda entries: [r.ok for r in df.select(cases.allowed(F.col("a"), entries).alias("ok")).collect()]
    assert ok([]) == [True] * 3 and ok(["a@X.org"]) == [True, False, False] and ok(["@gov.example", "c@other.org"]) == [False, True, True]
    p = spark.createDataFrame([("x/y/Scene.01.TIF",), ("plain",)], "p string").select(cases.name_parts(F.col("p")).alias("n")).collect()
    assert [tuple(r.n) for r in p] == [("y", "Scene.01", ".tif"), (None, "plain", None)]


def test_two_ways_of_being_irrelevant_read_differently(spark):
    cols = "reports_relevant int, reports int, reports_in_window int, nearest_outside_km double, dist_km double, radii double"
    df = spark.createDataFrame([(2, 9, 5, None, 1.0, 0.5), (0, 9, 0, 7.126, None, None), (0, 9, 0, None, None, None), (0, 9, 4, None, 33.0, 9.96)], cols)
    got = [r.r for r in df.select(shortlist.reason(df).alias("r")).collect()]
    assert got[0].startswith("2 of 9") and "7.13 km" in got[1] and got[2] == "no report in the release window" and "33.00 km away (10.0 radii)" in got[3]
