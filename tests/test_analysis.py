"""Evaluation, sampling, raster and shortlist operators on small literal frames."""

import pytest
from pyspark.sql import functions as F

from wakeline.functions import geo, regions
from wakeline.operators import evaluation as E
from wakeline.operators import rasters as P
from wakeline.operators import sampling as A
from wakeline.operators import shortlist as S


def _auc(spark, scores, labels):
    return E.auc(spark.createDataFrame(list(zip(scores, labels)), "score double, y int")).first()


def test_auc_handles_ties_and_one_class(spark):
    assert _auc(spark, [0.9, 0.8, 0.2, 0.1], [1, 1, 0, 0]).auc == 1
    assert _auc(spark, [0.1, 0.2, 0.8, 0.9], [1, 1, 0, 0]).auc == 0
    assert _auc(spark, [0.5] * 4, [1, 0, 1, 0]).auc == 0.5
    assert _auc(spark, [0.3, 0.2, 0.4], [1, 0, 0]).auc == 0.5
    assert _auc(spark, [0.3, 0.2], [1, 1]).auc is None


def test_confusion_and_empty_denominators(spark):
    df = spark.createDataFrame([(0.9, 1), (0.1, 1), (0.9, 0), (0.1, 0), (None, 1)], "score double, y int")
    c = E.confusion(df, 0.5).first()
    assert (c.tp, c.fn, c.fp, c.tn) == (1, 1, 1, 1)
    none = spark.createDataFrame([(0, 0, 0, 3)], "tp long, fp long, fn long, tn long")
    assert E.derived(none).first().iou is None
    assert E.derived(none, 1.0).first().iou == 1.0


def test_best_threshold_prefers_the_lower_of_equals(spark):
    df = spark.createDataFrame([(0.2, 0.7), (0.4, 0.7), (0.6, None)], "threshold double, iou double")
    assert E.best_threshold(df).first().threshold == 0.2


@pytest.mark.parametrize("lat,lon,name", [(39.437, 25.559, "Aegean Sea"), (-0.544, 105.889, "South China Sea"), (24.32, -81.314, "Straits of Florida"), (55.242, 4.058, "North Sea"), (None, 1.0, "Unknown region"), (10.0, -150.0, "North Pacific Ocean")])
def test_regions(spark, lat, lon, name):
    assert spark.createDataFrame([(lat, lon)], "lat double, lon double").select(regions.region_label().alias("r")).first().r == name


def test_split_keeps_groups_together_and_is_stable(spark):
    df = spark.range(2000).withColumn("g", (F.col("id") % 100).cast("string"))
    s = A.grouped_split(df, "g")
    assert s.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    more = A.grouped_split(df.union(spark.range(5).select("id", F.lit("new").alias("g"))), "g").filter("g <> 'new'")
    assert s.exceptAll(more).count() == 0


def test_spill_age(spark):
    t = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 2.0), (1, 6.0, 1 / 111.195, 0.0, 2.0), (2, 12.0, 5 / 111.195, 0.0, 2.0), (3, 24.0, 12 / 111.195, 0.0, 3.0)], "step int, hours double, lon double, lat double, spread_km double")
    r = S.spill_age(t).first()
    assert (r.resolvable_h, r.horizon_h) == (12.0, 24.0)


def test_haversine_of_antipodes_is_finite(spark):
    km = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0)).alias("k")).first().k
    assert abs(km - 3.141592653589793 * 6371.0088) < 1e-6


def test_regions_of_a_mask(spark):
    cells = [(0, 0), (1, 1), (1, 2), (5, 5), (6, 4), (9, 0)]
    df = spark.createDataFrame([("s", r, c) for r, c in cells], "scene string, row_i int, col_i int")
    sizes = sorted(r["count"] for r in P.connected_regions(df).groupBy("region").count().collect())
    assert sizes == [1, 2, 3]


def test_hull_of_a_square(spark):
    df = spark.createDataFrame([(1, float(x), float(y)) for x in range(4) for y in range(4)], "grp long, x double, y double")
    assert {(r.x, r.y) for r in P.hull(df).collect()} == {(0, 0), (3, 0), (3, 3), (0, 3)}


def test_bilinear_ignores_missing_cells(spark):
    grid = spark.createDataFrame([(0, 0, 1.0), (1, 0, None), (0, 1, 3.0), (1, 1, None)], "gi int, gj int, value double")
    q = spark.createDataFrame([(1, 0.5, 0.5), (2, 9.0, 9.0)], "qid long, x double, y double")
    assert {r.qid: r.value for r in P.bilinear(q, grid, 0.0, 0.0, 1.0).collect()} == {1: 2.0, 2: 0.0}


def test_funnel_adds_up(spark):
    import __spark_entry__ as entry

    f = entry.queries()["traffic_funnel"](spark, "/root/testdata/sf0.001").first()
    assert f.seen == f.relevant + f.outside_window + f.too_far
