"""Registered queries of evaluation, sampling, joins, grids and rasters, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geo import within_box, within_window
from ..functions.hashing import stable_seed, stable_unit
from ..operators import cases as K
from ..operators import evaluation as E
from ..operators import rasters as P
from ..operators import sampling as A
from ..operators import tables as B
from .bridge import NAMES, bridge, load, with_views

T = [i / 20 for i in range(1, 20)]
QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def query(oracle: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(df, places, *columns):
    return df.withColumns({c: F.round(c, places) for c in columns})


_CONF = "count(*) FILTER (score >= {t} AND y = 1) AS tp, count(*) FILTER (score >= {t} AND y = 0) AS fp, count(*) FILTER (score < {t} AND y = 1) AS fn, count(*) FILTER (score < {t} AND y = 0) AS tn"
_IOU = "tp / nullif(tp + fp + fn, 0)::DOUBLE"
_SWEPT = f"""g AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in T)}]) AS threshold),
sw AS (SELECT threshold, {_CONF.format(t='threshold')} FROM g, scores GROUP BY threshold)"""


_HOLED = "SELECT grp, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE score END AS score, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE y END AS y FROM scores"


@query(f"SELECT grp, {_CONF.format(t='0.5::DOUBLE')}, count(*) FILTER (score IS NULL OR y IS NULL) AS invalid FROM ({_HOLED}) GROUP BY grp")
def confusion(spark, d):
    return E.confusion(load(spark, d, with_views(_HOLED, "spark")), 0.5, "grp")


_DERIVED = "tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1, " + _IOU + " AS iou"


@query(f"WITH c AS (SELECT grp, {_CONF.format(t='0.5::DOUBLE')} FROM scores GROUP BY grp) SELECT *, {_DERIVED} FROM c")
def derived_scores(spark, d):
    return E.derived(E.confusion(bridge(spark, d, "scores"), 0.5, "grp").drop("invalid"))


@query(f"WITH {_SWEPT} SELECT *, {_DERIVED} FROM sw")
def threshold_sweep(spark, d):
    return E.sweep(bridge(spark, d, "scores"), T)


@query(f"WITH {_SWEPT} SELECT threshold, {_IOU} AS iou FROM sw ORDER BY iou DESC, threshold LIMIT 1")
def best_threshold(spark, d):
    return E.best_threshold(E.sweep(bridge(spark, d, "scores"), T))


@query(f"""WITH c AS (SELECT grp, {_CONF.format(t='0.3::DOUBLE')} FROM scores GROUP BY grp), i AS (SELECT *, {_IOU} AS iou FROM c)
SELECT count(*) AS groups, round(avg(iou), 6) AS mean_iou, round(quantile_cont(iou, 0.1), 6) AS p10, round(median(iou), 6) AS median, round(quantile_cont(iou, 0.9), 6) AS p90, round(min(iou), 6) AS worst, round(sum(tp) / sum(tp + fp + fn)::DOUBLE, 6) AS pooled FROM i""")
def per_group_iou(spark, d):
    return _r(E.per_group_iou(bridge(spark, d, "scores"), 0.3), 6, "mean_iou", "p10", "median", "p90", "worst", "pooled")


_AUC = "round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0)::DOUBLE, 9)"
_RANKS = "rank() OVER (PARTITION BY {k} ORDER BY score) + (count(*) OVER (PARTITION BY {k}, score) - 1) / 2.0::DOUBLE AS rk"


@query(f"WITH r AS (SELECT *, {_RANKS.format(k='stratum')} FROM scores) SELECT stratum, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg, {_AUC} AS auc FROM r GROUP BY stratum")
def auc_rank(spark, d):
    return _r(E.auc(bridge(spark, d, "scores"), "stratum"), 9, "auc")


@query(f"WITH u AS (UNPIVOT features ON {', '.join(NAMES)} INTO NAME feature VALUE score), r AS (SELECT *, {_RANKS.format(k='feature')} FROM u), a AS (SELECT feature, {_AUC} AS auc FROM r GROUP BY feature) SELECT feature, round(greatest(auc, 1 - auc), 8) AS auc, auc >= 0.5 AS rising FROM a")
def single_feature_auc(spark, d):
    return _r(E.feature_auc(bridge(spark, d, "features"), NAMES), 8, "auc")


@query("WITH v AS (SELECT *, CASE WHEN score >= 0.65::DOUBLE THEN 'accepted' WHEN score <= 0.35::DOUBLE THEN 'rejected' ELSE 'uncertain' END AS v FROM scores) SELECT " + ", ".join(f"count(*) FILTER (v = '{x}' AND y = {y}) AS {x}_{y}" for x in ("accepted", "uncertain", "rejected") for y in (1, 0)) + ", count(*) FILTER (v <> 'rejected' AND y = 1) / nullif(count(*) FILTER (y = 1), 0)::DOUBLE AS kept_sensitivity, count(*) FILTER (v = 'rejected' AND y = 0) / nullif(count(*) FILTER (y = 0), 0)::DOUBLE AS rejection_specificity FROM v")
def outcomes_by_class(spark, d):
    return E.outcomes(bridge(spark, d, "scores"))


@query("SELECT grp, stratum, count(*) AS n, count(*) FILTER (y = 1) AS positives, count(DISTINCT doc_id) AS documents FROM scores GROUP BY GROUPING SETS ((), (grp), (stratum))")
def multi_grain_tally(spark, d):
    return E.tally(bridge(spark, d, "scores"), ["grp", "stratum"])


@query("SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL")
def value_frequency(spark, d):
    return E.frequencies(_t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT CASE WHEN score >= 0.9::DOUBLE THEN 4 WHEN score >= 0.5::DOUBLE THEN 3 WHEN score >= 0.25::DOUBLE THEN 2 WHEN score >= 0.05::DOUBLE THEN 1 ELSE 0 END AS bin, count(*) AS n FROM scores GROUP BY 1")
def overlap_histogram(spark, d):
    return E.histogram(bridge(spark, d, "scores"), "score", [0.05, 0.25, 0.5, 0.9])


_STD = f"u AS (UNPIVOT features ON {', '.join(NAMES)} INTO NAME feature VALUE x), m AS (SELECT feature, avg(x) AS mean, stddev_pop(x) AS std FROM u GROUP BY feature)"


@query(f"WITH {_STD} SELECT vec_id, round(1 / (1 + exp(-greatest(-60.0, least(60.0, sum(0.5::DOUBLE * (x - mean) / greatest(std, 1e-9)) + 0.25::DOUBLE)))), 6) AS likelihood FROM u JOIN m USING (feature) GROUP BY vec_id")
def screen_likelihood(spark, d):
    f = bridge(spark, d, "features")
    model = E.feature_moments(f, NAMES).withColumn("weight", F.lit(0.5))
    return _r(E.likelihood(f, model, NAMES, 0.25), 6, "likelihood")


@query(f"WITH {_STD} SELECT feature, round(mean, 8) AS mean, round(std, 8) AS std FROM m")
def feature_moments(spark, d):
    return _r(E.feature_moments(bridge(spark, d, "features"), NAMES), 8, "mean", "std")


_UNIT = "(('0x' || substr(sha256('{s}:' || {k}::STRING), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE"
_SPLIT = "CASE WHEN {u} < 0.15::DOUBLE THEN 'test' WHEN {u} < 0.3::DOUBLE THEN 'val' ELSE 'train' END"


@query(f"SELECT o_orderkey, {_UNIT.format(s=7, k='o_orderkey')} AS unit, ('0x' || substr(sha256('7:' || o_orderkey::STRING), 1, 8))::BIGINT AS seed FROM orders")
def stable_unit_and_seed(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", stable_unit(F.col("o_orderkey"), 7).alias("unit"), stable_seed(F.col("o_orderkey"), 7).alias("seed"))


@query(f"SELECT o_orderkey, o_custkey, {_SPLIT.format(u=_UNIT.format(s=20180803, k='o_custkey'))} AS split FROM orders")
def grouped_split(spark, d):
    return A.grouped_split(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


@query(f"SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_UNIT.format(s=3, k='o_orderkey')}, o_orderkey) <= 20")
def stratified_sample(spark, d):
    return A.stratified(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 20, 3)


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS depth FROM orders ORDER BY depth, o_custkey LIMIT 500")
def round_robin_select(spark, d):
    return A.round_robin(_t(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 500)


@query("WITH n AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier) SELECT s_suppkey FROM n WHERE n <= 16 OR i IN (SELECT (k * n) // 16 FROM range(16) r(k))")
def even_sample(spark, d):
    return A.evenly_spaced(_t(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 16)


@query(f"SELECT doc_id, y FROM scores ORDER BY y DESC, {_UNIT.format(s=5, k='doc_id')}, doc_id LIMIT 300")
def positives_first_subsample(spark, d):
    return A.positives_first(bridge(spark, d, "scores").select("doc_id", "y"), "doc_id", 300, 5)


@query("SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER w AS n, greatest(0, count(*) OVER (PARTITION BY c_nationkey) - 5) AS remainder, printf('item-%02d', row_number() OVER w) AS item FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) QUALIFY n <= 5")
def topk_with_remainder(spark, d):
    return A.top_with_remainder(_t(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", "c_acctbal", "c_custkey", 5)


_Q = ", ".join(f"round(quantile_cont(CASE WHEN NOT invalid THEN value END, {q}), 6) AS {n}" for q, n in ((0.005, "p005"), (0.01, "p01"), (0.5, "p50"), (0.99, "p99"), (0.995, "p995")))


@query(f"SELECT scene, count(*) AS n, count(value) FILTER (NOT invalid) AS valid, count(*) FILTER (value = 0) AS zeros, min(value) FILTER (NOT invalid) AS lo, max(value) FILTER (NOT invalid) AS hi, round(avg(value) FILTER (NOT invalid), 6) AS mean, round(stddev_pop(value) FILTER (NOT invalid), 6) AS std, {_Q} FROM raster GROUP BY scene")
def band_stats(spark, d):
    return _r(P.band_stats(bridge(spark, d, "raster"), "scene"), 6, "mean", "std", "p005", "p01", "p50", "p99", "p995")


@query("SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 4) AS std, round(quantile_cont(value, 0.005), 6) AS low, round(quantile_cont(value, 0.995), 6) AS high FROM raster WHERE NOT invalid")
def norm_stats(spark, d):
    return P.norm_stats(bridge(spark, d, "raster")).select("n", F.round("mean", 6).alias("mean"), F.round("std", 4).alias("std"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT p_partkey, round((least(greatest(value, 950.0::DOUBLE), 1500.0::DOUBLE) - 1200) / 150, 8) AS z FROM raster")
def standardise(spark, d):
    return bridge(spark, d, "raster").select("p_partkey", F.round(P.standardise(F.col("value"), 950.0, 1500.0, 1200.0, 150.0), 8).alias("z"))


for _how in ("mean", "max"):
    _ORACLES[f"{_how}_pool"] = f"SELECT floor(row_i / 4)::INT AS r, floor(col_i / 4)::INT AS c, round({'avg' if _how == 'mean' else 'max'}(value), 6) AS value FROM raster WHERE row_i < (SELECT (max(row_i) + 1) // 4 * 4 FROM raster) AND col_i < (SELECT (max(col_i) + 1) // 4 * 4 FROM raster) GROUP BY 1, 2"
    QUERIES[f"{_how}_pool"] = lambda spark, d, how=_how: _r(P.pool(bridge(spark, d, "raster"), 4, how), 6, "value")

_AREA = "pow(0.0001::DOUBLE * pi() / 180 * 6371008.8::DOUBLE, 2) * cos(radians(28.5::DOUBLE - (row_i + 0.5::DOUBLE) * 0.0001::DOUBLE))"


@query(f"SELECT row_i, round({_AREA}, 6) AS area_m2 FROM (SELECT DISTINCT row_i FROM raster)")
def pixel_area(spark, d):
    return bridge(spark, d, "raster").select("row_i").distinct().select("row_i", F.round(P.pixel_area_m2(F.col("row_i"), 28.5, 0.0001), 6).alias("area_m2"))


@query(f"SELECT round(sum({_AREA}) / 1e6, 6) AS area_km2 FROM raster WHERE oil AND NOT invalid")
def mask_area(spark, d):
    return _r(P.mask_area_km2(bridge(spark, d, "raster"), 28.5, 0.0001), 6, "area_km2")


@query("""WITH p AS (SELECT scene, col_i::DOUBLE AS x, row_i::DOUBLE AS y FROM raster WHERE oil),
m AS (SELECT scene, avg(x) AS mx, avg(y) AS my, 0.5::DOUBLE * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS th FROM p GROUP BY scene),
j AS (SELECT p.scene, th, (x - mx) * cos(th) + (y - my) * sin(th) AS u, (y - my) * cos(th) - (x - mx) * sin(th) AS w FROM p JOIN m USING (scene))
SELECT scene, round(degrees(any_value(th)), 5) AS orientation, round(max(u) - min(u), 5) AS length, round(max(w) - min(w), 5) AS width, count(*) AS n FROM j GROUP BY scene""")
def pca_shape(spark, d):
    p = bridge(spark, d, "raster").filter("oil").select("scene", F.col("col_i").cast("double").alias("x"), F.col("row_i").cast("double").alias("y"))
    return _r(P.shape(p, "scene"), 5, "orientation", "length", "width")


_OVER = """pt AS (SELECT DISTINCT (row_i // 5) * 10 + col_i // 5 AS patch, row_i, col_i FROM raster WHERE value < 1400),
sl AS (SELECT DISTINCT (row_i // 7) * 10 + col_i // 8 AS slick, row_i, col_i FROM raster WHERE oil)"""


@query(f"WITH {_OVER}, n AS (SELECT patch, slick, count(*) AS n FROM pt JOIN sl USING (row_i, col_i) GROUP BY ALL), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY patch ORDER BY n DESC, slick) = 1) SELECT z.patch, slick, coalesce(n, 0) / z.size::DOUBLE AS share FROM (SELECT patch, count(*) AS size FROM pt GROUP BY patch) z LEFT JOIN b USING (patch)")
def overlap_attribution(spark, d):
    r = bridge(spark, d, "raster")
    tile = lambda a, b: (F.floor(F.col("row_i") / a) * 10 + F.floor(F.col("col_i") / b)).cast("long")
    return P.attribute_overlap(r.filter("value < 1400").select(tile(5, 5).alias("patch"), "row_i", "col_i").distinct(), r.filter("oil").select(tile(7, 8).alias("slick"), "row_i", "col_i").distinct())


@query("""WITH g AS (SELECT row_i AS gj, col_i AS gi, CASE WHEN NOT invalid THEN value END AS value FROM raster),
q AS (SELECT event_id AS qid, (event_id * 37 % 4900) / 100.0::DOUBLE AS x, (event_id * 53 % 3900) / 100.0::DOUBLE AS y FROM events),
k AS (SELECT qid, x, y, floor(x) AS ix, floor(y) AS iy, a, b FROM q, (VALUES (0), (1)) s(a), (VALUES (0), (1)) t(b)),
w AS (SELECT qid, value, CASE WHEN a = 1 THEN x - ix ELSE 1 - (x - ix) END * CASE WHEN b = 1 THEN y - iy ELSE 1 - (y - iy) END AS w FROM k LEFT JOIN g ON gi = ix + a AND gj = iy + b AND value IS NOT NULL)
SELECT qid, round(coalesce(sum(w * value) / nullif(sum(w) FILTER (value IS NOT NULL), 0), 0), 5) AS value FROM w GROUP BY qid""")
def bilinear(spark, d):
    g = bridge(spark, d, "raster").select(F.col("row_i").alias("gj"), F.col("col_i").alias("gi"), F.when(~F.col("invalid"), F.col("value")).alias("value"))
    q = _t(spark, d, "events").select(F.col("event_id").alias("qid"), (F.col("event_id") * 37 % 4900 / F.lit(100.0)).alias("x"), (F.col("event_id") * 53 % 3900 / F.lit(100.0)).alias("y"))
    return _r(P.bilinear(q, g, 0.0, 0.0, 1.0), 5, "value")


@query("""WITH v AS (SELECT o_custkey AS ring, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, (o_orderkey % 97)::DOUBLE AS x, (o_orderkey * 31 % 89)::DOUBLE AS y FROM orders),
e AS (SELECT ring, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY ring ORDER BY n))
SELECT ring, sum(x * y2 - x2 * y) / 2 AS area, round(sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))), 6) AS perimeter FROM e GROUP BY ring""")
def shoelace(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    v = _t(spark, d, "orders").select(F.col("o_custkey").alias("ring"), F.row_number().over(w).alias("n"), (F.col("o_orderkey") % 97).cast("double").alias("x"), (F.col("o_orderkey") * 31 % 89).cast("double").alias("y"))
    return _r(P.shoelace(v, "ring"), 6, "perimeter")


for _how, _n in (("erode", 9), ("dilate", 1)):
    _ORACLES[_how] = f"WITH m AS (SELECT DISTINCT 'all' AS scene, row_i, col_i FROM raster WHERE value < 1500), s AS (SELECT scene, row_i + a AS row_i, col_i + b AS col_i FROM m, (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b)) SELECT scene, row_i, col_i FROM s GROUP BY ALL HAVING count(*) >= {_n}"
    QUERIES[_how] = lambda spark, d, how=_how: P.neighbours(bridge(spark, d, "raster").filter("value < 1500").select(F.lit("all").alias("scene"), "row_i", "col_i").distinct(), how)


@query("""WITH RECURSIVE m AS (SELECT scene, row_i, col_i, row_number() OVER (ORDER BY scene, row_i, col_i) AS id FROM (SELECT DISTINCT 'all' AS scene, row_i, col_i FROM raster WHERE oil UNION ALL SELECT DISTINCT scene, row_i, col_i FROM raster WHERE value < 1500)),
n AS (SELECT m.*, row_i + a AS r, col_i + b AS c FROM m, (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b)),
e AS MATERIALIZED (SELECT n.id AS a, m.id AS b FROM n JOIN m ON m.scene = n.scene AND m.row_i = n.r AND m.col_i = n.c),
c(id, root) USING KEY (id) AS (SELECT a, min(b) FROM e GROUP BY a UNION SELECT e.a, min(c.root) FROM c JOIN e ON e.b = c.id JOIN recurring.c AS o ON o.id = e.a WHERE c.root < o.root GROUP BY e.a)
SELECT scene, size, count(*) AS regions FROM (SELECT scene, root, count(*) AS size FROM c JOIN m USING (id) GROUP BY scene, root) GROUP BY scene, size""")
def connected_components(spark, d):
    r = bridge(spark, d, "raster")
    mask = r.filter("oil").select(F.lit("all").alias("scene"), "row_i", "col_i").unionByName(r.filter("value < 1500").select("scene", "row_i", "col_i"))
    return P.connected_regions(mask).groupBy("scene", "region").agg(F.count(F.lit(1)).alias("size")).groupBy("scene", "size").agg(F.count(F.lit(1)).alias("regions"))


# a point is a vertex iff all others fit between two directions less than half a turn apart; here by whole-number coordinates, so no rounding decides
@query("""WITH p AS (SELECT DISTINCT event_id % 40 AS grp, (event_id * 7919 % 1000) AS x, (event_id * 104729 % 997) AS y FROM events),
e AS (SELECT a.grp, a.x, a.y, b.x AS x2, b.y AS y2 FROM p a JOIN p b ON a.grp = b.grp AND (a.x, a.y) <> (b.x, b.y)),
s AS (SELECT e.grp, e.x, e.y, e.x2, e.y2, bool_and((e.x2 - e.x) * (c.y - e.y) - (e.y2 - e.y) * (c.x - e.x) >= 0) AS side,
        bool_or((e.x2 - e.x) * (c.y - e.y) - (e.y2 - e.y) * (c.x - e.x) = 0 AND (c.x - e.x) * (e.x2 - e.x) + (c.y - e.y) * (e.y2 - e.y) < 0) AS behind,
        bool_or((e.x2 - e.x) * (c.y - e.y) - (e.y2 - e.y) * (c.x - e.x) = 0 AND (c.x - e.x) * (c.x - e.x) + (c.y - e.y) * (c.y - e.y) > (e.x2 - e.x) * (e.x2 - e.x) + (e.y2 - e.y) * (e.y2 - e.y) AND (c.x - e.x) * (e.x2 - e.x) + (c.y - e.y) * (e.y2 - e.y) > 0) AS beyond
      FROM e JOIN p c ON c.grp = e.grp GROUP BY ALL)
SELECT DISTINCT grp, x::DOUBLE AS x, y::DOUBLE AS y FROM s WHERE side AND NOT behind AND NOT beyond""")
def convex_hull(spark, d):
    p = _t(spark, d, "events").select((F.col("event_id") % 40).alias("grp"), (F.col("event_id") * 7919 % 1000).cast("double").alias("x"), (F.col("event_id") * 104729 % 997).cast("double").alias("y"))
    return P.hull(p).select("grp", "x", "y")


def _docs(spark, d):
    return _t(spark, d, "documents"), _t(spark, d, "labels")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def pair_inner(spark, d):
    docs, labels = _docs(spark, d)
    return B.paired(docs.select("doc_id", "lang"), labels.select("doc_id", "quality"), "doc_id")


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def pair_anti_left(spark, d):
    docs, labels = _docs(spark, d)
    return B.unpaired(docs.select("doc_id"), labels, "doc_id")


@query("SELECT l.doc_id FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def pair_anti_right(spark, d):
    docs, labels = _docs(spark, d)
    return B.unpaired(labels.select("doc_id"), docs.filter("lang = 'en'"), "doc_id")


@query("SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)")
def present_semi(spark, d):
    docs, labels = _docs(spark, d)
    return B.present(docs.select("doc_id", "source"), labels, "doc_id")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def key_intersect(spark, d):
    return B.keys(*_docs(spark, d), "doc_id", "common")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def key_difference(spark, d):
    return B.keys(*_docs(spark, d), "doc_id", "missing")


@query("SELECT o.o_orderkey, c.c_custkey IS NOT NULL AS has_customer, coalesce(c.c_mktsegment, 'none') AS segment, l.l_orderkey IS NOT NULL AS has_items FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 40) l ON o.o_orderkey = l.l_orderkey")
def scene_left_joins(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c, i = _t(spark, d, "customer").filter("c_acctbal > 0"), _t(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    out = K.with_fallback(K.listing(K.listing(o, "c_custkey", customer=c), "o_orderkey", items=i), c, "c_custkey", ["c_mktsegment"], "segment", F.lit("none"))
    return out.select("o_orderkey", "has_customer", "segment", "has_items")


@query("SELECT pos, mmsi FROM reports WHERE lon BETWEEN -89.5E0 AND -89.0E0 AND lat BETWEEN 28.2E0 AND 28.8E0")
def bbox_filter(spark, d):
    return bridge(spark, d, "reports").filter(within_box(F.col("lon"), F.col("lat"), -89.5, 28.2, -89.0, 28.8)).select("pos", "mmsi")


@query("SELECT pos, mmsi, t_us >= 1705276800000000 AND t_us < 1705363200000000 AS both_ends, t_us >= 1705276800000000 AS from_start, t_us < 1705363200000000 AS to_end, true AS open FROM reports")
def window_half_open(spark, d):
    t, a, b = F.col("t_us"), 1705276800000000, 1705363200000000
    return bridge(spark, d, "reports").select("pos", "mmsi", within_window(t, a, b).alias("both_ends"), within_window(t, a).alias("from_start"), within_window(t, None, b).alias("to_end"), within_window(t).alias("open"))


@query("SELECT pid, greatest(0E0, least(max(step) * 6E0, 30E0) - greatest(min(step) * 6E0, 10E0)) / nullif(max(step) * 6E0 - min(step) * 6E0, 0) AS covered FROM particles GROUP BY pid")
def interval_overlap_fraction(spark, d):
    """How much of the hours over which a particle is followed lies between the 10th and the 30th."""
    p = bridge(spark, d, "particles").groupBy("pid").agg((F.min("step") * F.lit(6.0)).alias("a"), (F.max("step") * F.lit(6.0)).alias("b"))
    return p.select("pid", B.overlap_fraction(F.col("a"), F.col("b"), 10.0, 30.0).alias("covered"))


@query("SELECT p_partkey, row_i, (sum((p_partkey * 7 % 256)::BIGINT) OVER (PARTITION BY row_i ORDER BY col_i, p_partkey ROWS UNBOUNDED PRECEDING))::BIGINT % 256 AS decoded FROM raster")
def cumsum_predictor(spark, d):
    return B.undo_differences(bridge(spark, d, "raster").withColumn("delta", F.col("p_partkey") * 7 % 256), ["row_i"], ["col_i", "p_partkey"], "delta").select("p_partkey", "row_i", "decoded")


@query("SELECT mmsi, count(*) AS n, max(t_us) AS last_us FROM reports WHERE t_us <= 1705363200000000 GROUP BY mmsi")
def playback_until(spark, d):
    return B.until(bridge(spark, d, "reports"), 1705363200000000)


@query("SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, count(*) * 1E0 / sum(count(*)) OVER () AS share FROM scores GROUP BY 1")
def equal_width_histogram(spark, d):
    return B.equal_width(bridge(spark, d, "scores"), "score", 10)


@query("SELECT grp, round(avg(score), 9) AS mean_score FROM scores GROUP BY grp ORDER BY avg(score), grp LIMIT 6")
def scene_distribution(spark, d):
    return _r(B.worst(bridge(spark, d, "scores"), "grp", "score", 6), 9, "mean_score")


@query("SELECT lower(event_type) AS k, min(event_id) AS first_pos FROM events GROUP BY lower(event_type)")
def order_preserving_dedup(spark, d):
    return B.first_spellings(_t(spark, d, "events"), "event_type", "event_id")


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_quantity > 40 THEN 'large' END, CASE WHEN l_discount = 0 THEN 'full price' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL), '|') AS flags FROM lineitem")
def flags_array(spark, d):
    flags = F.array_compact(F.array(F.when(F.col("l_quantity") > 40, "large"), F.when(F.col("l_discount") == 0, "full price"), F.when(F.col("l_returnflag") == "R", "returned")))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(flags, "|").alias("flags"))


@query("SELECT mmsi, '{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || arg_max(round(lon * 10000)::BIGINT, (t_us, pos))::STRING || ',' || arg_max(round(lat * 10000)::BIGINT, (t_us, pos))::STRING || ']},\"properties\":{\"mmsi\":\"' || mmsi || '\",\"n\":' || count(*)::STRING || '}}' AS feature FROM reports GROUP BY mmsi")
def geojson_feature(spark, d):
    """Each vessel's last place and its reports, in ten-thousandths of a degree, which every engine writes alike."""
    whole = lambda c: F.round(F.col(c) * 10000).cast("long")
    last = F.max_by(F.array(whole("lon"), whole("lat")), F.struct("t_us", "pos"))
    n = bridge(spark, d, "reports").groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"), last.alias("place"))
    return n.select("mmsi", K.feature("Point", F.col("place"), mmsi=F.col("mmsi"), n=F.col("n")).alias("feature"))


ORACLE_SQL = {k: with_views(s, "duckdb") for k, s in _ORACLES.items()}
