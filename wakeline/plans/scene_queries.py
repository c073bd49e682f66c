"""Registered queries of scenes, screening and rings, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import geometry as H
from ..operators import rasters as P
from ..operators import sampling as A
from ..operators import scenes as S
from ..operators import screening as V
from .bridge import NAMES, bridge, with_views
from .registry import Registry

R = Registry()
query = R.query


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pixels(spark, d):
    """The pixel view with a value (vv) and the invalid mask of both channels (no-data 0)."""
    p = bridge(spark, d, "pixels")
    return p.withColumn("invalid", S.invalid([F.col("vv"), F.col("vh")], F.lit(0.0))).withColumn("value", F.col("vv"))


_PX = "px AS (SELECT *, vv = 0 OR vh = 0 AS invalid, vv AS value FROM pixels)"
_TILES = f"""{_PX}, xt AS (SELECT scene, (max(row_i) + 1) // 4 * 4 AS hh, (max(col_i) + 1) // 4 * 4 AS ww FROM px GROUP BY scene),
ti AS (SELECT scene, (row_i // 4 * 4)::INT AS row, (col_i // 4 * 4)::INT AS col, count(*) AS pixels, count(*) FILTER (oil AND NOT invalid) / count(*)::DOUBLE AS oil_share, count(*) FILTER (invalid) / count(*)::DOUBLE AS invalid_share, avg(value) AS mean
FROM px JOIN xt USING (scene) WHERE row_i < hh AND col_i < ww GROUP BY ALL)"""


@query(f"WITH {_PX} SELECT scene, row_i, col_i, invalid FROM px")
def invalid_mask(spark, d):
    return _pixels(spark, d).select("scene", "row_i", "col_i", "invalid")


@query(f"WITH {_TILES} SELECT scene, row, col, pixels, oil_share, invalid_share, round(mean, 10) AS mean FROM ti")
def scene_tiles(spark, d):
    return S.tiles(_pixels(spark, d), 4).withColumn("mean", F.round("mean", 10))


@query(f"""WITH {_TILES}, u AS (SELECT * FROM ti WHERE invalid_share < 0.3::DOUBLE),
po AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY oil_share DESC, row, col) AS n FROM u WHERE oil_share >= 0.2::DOUBLE QUALIFY n <= 4),
wa AS (SELECT scene, least(count(*), greatest(0, 8 - count(*))) AS want FROM po GROUP BY scene),
ne AS (SELECT u.*, want, row_number() OVER (PARTITION BY scene ORDER BY mean, row, col) AS n FROM u JOIN wa USING (scene) WHERE oil_share = 0 QUALIFY n <= 2 * want),
nh AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY (('0x' || substr(sha256('5:' || scene::STRING || '/' || row::STRING || '/' || col::STRING), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE, row, col) AS m FROM ne QUALIFY m <= want)
SELECT scene, row, col, 'oil' AS kind FROM po UNION ALL SELECT scene, row, col, 'clean' FROM nh""")
def tile_choice(spark, d):
    return S.choose(S.tiles(_pixels(spark, d), 4), 8, 1.0, 0.2, 0.3, 5).select("scene", "row", "col", "kind")


for _how, (_r, _c) in {"flip_rows": ("3 - row_i % 4", "col_i % 4"), "flip_cols": ("row_i % 4", "3 - col_i % 4"), "quarter": ("3 - col_i % 4", "row_i % 4"), "half": ("3 - row_i % 4", "3 - col_i % 4"), "three_quarters": ("col_i % 4", "3 - row_i % 4")}.items():
    R.oracles[f"turned_{_how}"] = f"SELECT scene, (row_i // 4)::INT AS tr, (col_i // 4)::INT AS tc, ({_r})::INT AS row_i, ({_c})::INT AS col_i, vv, oil FROM pixels"

    def _turned(spark, d, how=_how):
        p = bridge(spark, d, "pixels").withColumns({"tr": F.floor(F.col("row_i") / 4).cast("int"), "tc": F.floor(F.col("col_i") / 4).cast("int"), "row_i": F.col("row_i") % 4, "col_i": F.col("col_i") % 4})
        return S.turned(p, 4, how).select("scene", "tr", "tc", "row_i", "col_i", "vv", "oil")

    R.queries[f"turned_{_how}"] = _turned


_NAMES = "CASE o_orderkey % 5 WHEN 0 THEN ['Sigma0_VH', 'Sigma0_VV'] WHEN 1 THEN ['vv', 'angle', 'vh'] WHEN 2 THEN ['Sigma0_VV'] ELSE [] END"
_DECL = "CASE o_orderkey % 7 WHEN 0 THEN 'VV,VH' WHEN 1 THEN 'vh,vv' END"


@query(f"""WITH b AS (SELECT o_orderkey AS scene, o_orderkey % 5 AS k, {_DECL} AS decl, (o_orderkey % 4)::INT AS n FROM orders),
c AS (SELECT *, CASE WHEN k = 0 AND n >= 2 THEN [1, 0, 0] WHEN k = 1 AND n >= 3 THEN [0, 2, 0] WHEN decl = 'VV,VH' AND n >= 2 THEN [0, 1, 1] WHEN decl = 'vh,vv' AND n >= 2 THEN [1, 0, 1] WHEN decl IS NULL AND n >= 2 THEN [1, 0, 2] END AS f FROM b)
SELECT scene, f[1]::INT AS vv, f[2]::INT AS vh, CASE f[3] WHEN 0 THEN 'header' WHEN 1 THEN 'declared' WHEN 2 THEN 'assumed' END AS basis FROM c""")
def band_order(spark, d):
    k = F.col("o_orderkey") % 5
    names = F.when(k == 0, F.array(F.lit("Sigma0_VH"), F.lit("Sigma0_VV"))).when(k == 1, F.array(F.lit("vv"), F.lit("angle"), F.lit("vh"))).when(k == 2, F.array(F.lit("Sigma0_VV"))).otherwise(F.array().cast("array<string>"))
    decl = F.when(F.col("o_orderkey") % 7 == 0, "VV,VH").when(F.col("o_orderkey") % 7 == 1, "vh,vv")
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("scene"), S.bands(names, decl, (F.col("o_orderkey") % 4).cast("int")).alias("b")).select("scene", "b.vv", "b.vh", "b.basis")


@query("""WITH s AS (SELECT scene, row_i, count(value) FILTER (NOT invalid) AS valid, count(*) FILTER (value = 0) AS zeros, min(value) FILTER (NOT invalid) AS lo, max(value) FILTER (NOT invalid) AS hi, avg(value) FILTER (NOT invalid) AS mean FROM raster GROUP BY scene, row_i)
SELECT scene, count(*) AS parts, sum(valid)::BIGINT AS valid, sum(zeros)::BIGINT AS zeros, min(lo) AS lo, max(hi) AS hi, round(avg(mean), 6) AS mean FROM s GROUP BY scene""")
def combined_stats(spark, d):
    return S.combined(P.band_stats(bridge(spark, d, "raster"), "scene", "row_i"), "scene").withColumn("mean", F.round("mean", 6))


@query("SELECT scene, round(avg(value) FILTER (oil AND NOT invalid), 6) AS oil_mean, round(avg(value) FILTER (NOT oil AND NOT invalid), 6) AS sea_mean, round(avg(value) FILTER (oil AND NOT invalid) - avg(value) FILTER (NOT oil AND NOT invalid), 6) AS difference FROM raster GROUP BY scene")
def class_separation(spark, d):
    return S.separation(bridge(spark, d, "raster"), "scene").select("scene", *[F.round(c, 6).alias(c) for c in ("oil_mean", "sea_mean", "difference")])


@query("SELECT status, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north FROM scenes GROUP BY status")
def dataset_bounds(spark, d):
    return S.bounds(bridge(spark, d, "scenes"), "status")


@query("""WITH q AS (SELECT scene, quantile_cont(CASE WHEN NOT invalid THEN value END, 0.02) AS a, quantile_cont(CASE WHEN NOT invalid THEN value END, 0.98) AS b FROM raster GROUP BY scene)
SELECT p_partkey, CASE WHEN invalid OR b = a THEN 0 ELSE floor(255 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (value - a) / (b - a))) + 0.5::DOUBLE) END::INT AS grey FROM raster JOIN q USING (scene)""")
def percentile_stretch(spark, d):
    return S.stretched(bridge(spark, d, "raster")).select("p_partkey", "grey")


@query("SELECT o_orderkey, array_to_string(CASE WHEN e <= 64 THEN [0] ELSE list_sort(list_distinct(list_transform(range(0, e, 48), lambda s: least(s, e - 64)))) END, ',') AS starts FROM (SELECT o_orderkey, (o_orderkey % 700 + 1)::BIGINT AS e FROM orders)")
def tile_origins(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", F.array_join(S.tile_origins(F.col("o_orderkey") % 700 + 1, 64, 48), ",").alias("starts"))


def _hav(a, b, c, e):
    return f"2 * 6371.0088::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians(({e}) - ({b})) / 2), 2) + cos(radians({b})) * cos(radians({e})) * pow(sin(radians(({c}) - ({a})) / 2), 2))))"


@query(f"SELECT scene, round((({_hav('west', 'north', 'east', 'north')} + {_hav('west', 'south', 'east', 'south')}) * 500 / 256 + ({_hav('west', 'north', 'west', 'south')} + {_hav('east', 'north', 'east', 'south')}) * 500 / 128) / 2, 5) AS spacing_m FROM scenes")
def ground_spacing(spark, d):
    w, s, e, n = (F.col(c) for c in ("west", "south", "east", "north"))
    return bridge(spark, d, "scenes").select("scene", F.round(S.ground_spacing_m([(w, n), (e, n), (e, s), (w, s)], F.lit(256.0), F.lit(128.0)), 5).alias("spacing_m"))


_RULES = [("error", "no-time", "t_us IS NULL", "'no acquisition time'"), ("warning", "small", "east - west < 0.35", "'footprint of ' || CAST(parent AS STRING) || ' is narrow'"), ("warning", "status", "status = 'P'", "'status ' || status")]


def _problems(spark, d):
    return S.problems(bridge(spark, d, "scenes"), [(s, k, F.expr(c), F.expr(m)) for s, k, c, m in _RULES])


_PROBLEMS = " UNION ALL ".join(f"SELECT scene, '{s}' AS severity, '{k}' AS kind, {m} AS message FROM scenes WHERE {c.replace('0.35', '0.35::DOUBLE')}" for s, k, c, m in _RULES)


@query(_PROBLEMS)
def pair_problems(spark, d):
    return _problems(spark, d)


@query(f"WITH p AS ({_PROBLEMS}), r AS (SELECT *, row_number() OVER (PARTITION BY kind, severity ORDER BY scene) AS n FROM p) SELECT kind, severity, count(*) AS n, array_to_string(list(scene ORDER BY scene) FILTER (n <= 5), ',') AS first FROM r GROUP BY kind, severity")
def problem_list(spark, d):
    return S.listed(_problems(spark, d), 5).withColumn("first", F.array_join("first", ","))


def boxed(reach, despeckle=False):
    """Contrast against the mean of a mirrored square (bm{reach}), by joining each cell with those around it."""
    mirrored = f"CASE WHEN ((x.i + k) % (2 * x.w) + 2 * x.w) % (2 * x.w) < x.w THEN ((x.i + k) % (2 * x.w) + 2 * x.w) % (2 * x.w) ELSE 2 * x.w - 1 - ((x.i + k) % (2 * x.w) + 2 * x.w) % (2 * x.w) END"
    line = lambda own, n, src, line, other, vals: f"""ix{n}{reach} AS (SELECT *, row_number() OVER (PARTITION BY scene, {line} ORDER BY {other}) - 1 AS i, count(*) OVER (PARTITION BY scene, {line}) AS w FROM {src}),
ac{n}{reach} AS (SELECT x.scene, x.row_i, x.col_i, any_value(x.med) AS med, any_value(x.oil) AS oil, any_value(x.invalid) AS invalid, {vals} FROM ix{n}{reach} x, range({-reach}, {reach + 1}) r(k) JOIN ix{n}{reach} y ON y.scene = x.scene AND y.{line} = x.{line} AND y.i = {mirrored} GROUP BY 1, 2, 3)"""  # noqa: E731
    med = "list_sort(list_concat(coalesce(lag(h) OVER w, h), h, coalesce(lead(h) OVER w, h)))[5]" if despeckle else "value"
    return f"""hz{reach} AS (SELECT *, [coalesce(lag(value) OVER w, value), value, coalesce(lead(value) OVER w, value)] AS h FROM px WINDOW w AS (PARTITION BY scene, row_i ORDER BY col_i)),
md{reach} AS (SELECT scene, row_i, col_i, oil, invalid, {med} AS med FROM hz{reach} WINDOW w AS (PARTITION BY scene, col_i ORDER BY row_i)),
{line(1, 'a', f'md{reach}', 'row_i', 'col_i', 'coalesce(sum(y.med) FILTER (NOT y.invalid), 0) AS s, count(*) FILTER (NOT y.invalid) AS c')},
{line(2, 'b', f'aca{reach}', 'col_i', 'row_i', 'sum(y.s) AS s, sum(y.c) AS c')},
bm{reach} AS (SELECT *, round(s / nullif(c, 0) - med, 9) AS contrast FROM acb{reach})"""


_BOX = f"{_PX}, {boxed(2, True)}, dk AS (SELECT *, coalesce(NOT invalid AND s / nullif(c, 0) - med >= 60, false) AS dark FROM bm2)"


@query(f"WITH {_BOX} SELECT scene, row_i, col_i, contrast, dark FROM dk")
def baseline_dark(spark, d):
    return S.dark(_pixels(spark, d), 2, 60.0, 3).select("scene", "row_i", "col_i", F.round("contrast", 9).alias("contrast"), "dark")


_GRID = [20.0, 40.0, 60.0, 80.0]


@query(f"""WITH {_BOX}, g AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in _GRID)}]) AS threshold),
c AS (SELECT threshold, count(*) FILTER (contrast >= threshold AND oil) AS tp, count(*) FILTER (contrast >= threshold AND NOT oil) AS fp, count(*) FILTER (contrast < threshold AND oil) AS fn FROM g, dk WHERE NOT invalid AND contrast IS NOT NULL GROUP BY threshold)
SELECT threshold, round(tp / nullif(tp + fp + fn, 0)::DOUBLE, 8) AS iou FROM c ORDER BY iou DESC, threshold LIMIT 1""")
def baseline_best(spark, d):
    p = S.dark(_pixels(spark, d), 2, 0.0, 3).filter("not invalid").select(F.round("contrast", 9).alias("score"), F.col("oil").cast("int").alias("y"))
    return E.best_threshold(E.sweep(p, _GRID)).withColumn("iou", F.round("iou", 8))


# a fixed model over the seven features: weight, mean, deviation
MODEL = {n: ((-1.0) ** i * (0.4 + 0.1 * i), 0.01 * i, 0.1 + 0.01 * i) for i, n in enumerate(NAMES)}
_Z = {n: f"({w}::DOUBLE * ({n} - {m}::DOUBLE) / {s}::DOUBLE)" for n, (w, m, s) in MODEL.items()}
_SCREEN = f"""sp AS (SELECT f.*, 1 / (1 + exp(-greatest(-60.0::DOUBLE, least(60.0::DOUBLE, {' + '.join(_Z.values())} + 0.25::DOUBLE)))) AS p FROM features f),
sv AS (SELECT *, CASE WHEN p <= 0.35::DOUBLE THEN 'rejected' WHEN p >= 0.65::DOUBLE THEN 'accepted' ELSE 'uncertain' END AS verdict FROM sp)"""


def _screened(spark, d):
    return V.screened(bridge(spark, d, "features"), MODEL, 0.25)


@query(f"""WITH {_SCREEN}, ct AS (SELECT vec_id, verdict, p, unnest([{', '.join(f"struct_pack(i := {i}, f := '{n}', z := {z}, v := {n})" for i, (n, z) in enumerate(_Z.items()))}]) AS c FROM sv),
rk AS (SELECT vec_id, verdict, p, c, row_number() OVER (PARTITION BY vec_id ORDER BY abs(c.z) DESC, c.i) AS n FROM ct)
SELECT vec_id, any_value(verdict) AS verdict, round(any_value(p), 6) AS likelihood, string_agg(c.f || ' ' || printf('%.2f', round(c.v, 2) + 0.0::DOUBLE) || CASE WHEN c.z > 0 THEN ': for oil' ELSE ': against oil' END, '|' ORDER BY n) FILTER (n <= 3) AS reasons FROM rk GROUP BY vec_id""")
def screen_verdict(spark, d):
    return _screened(spark, d).select("vec_id", "verdict", F.round("likelihood", 6).alias("likelihood"), F.array_join("reasons", "|").alias("reasons"))


@query(f"""WITH {_SCREEN} SELECT grp, y, count(*) AS n, count(DISTINCT vec_id % 50) AS documents, count(*) FILTER (verdict = 'accepted') AS accepted, count(*) FILTER (verdict = 'uncertain') AS uncertain, count(*) FILTER (verdict = 'rejected') AS rejected,
count(DISTINCT CASE WHEN verdict <> 'rejected' THEN vec_id % 50 END) AS surviving, count(*) FILTER (verdict = 'rejected') / count(*)::DOUBLE AS rejected_share, count(DISTINCT CASE WHEN verdict <> 'rejected' THEN vec_id % 50 END) / count(DISTINCT vec_id % 50)::DOUBLE AS surviving_share FROM sv GROUP BY GROUPING SETS ((), (grp), (y))""")
def verdict_tallies(spark, d):
    return V.tallies(_screened(spark, d).withColumn("doc", F.col("vec_id") % 50), [[], ["grp"], ["y"]], "doc")


@query("""WITH RECURSIVE s AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, (('0x' || substr(sha256('4:' || c_nationkey::STRING), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE, c_nationkey) AS i FROM s),
f AS (SELECT 0::BIGINT AS i, NULL::INT AS g, NULL::INT AS fold, [0, 0, 0, 0]::BIGINT[] AS sizes
UNION ALL SELECT o.i, c_nationkey::INT, (list_position(sizes, list_min(sizes)) - 1)::INT, list_transform(sizes, lambda x, j: CASE WHEN j = list_position(sizes, list_min(sizes)) THEN x + o.n ELSE x END) FROM f JOIN o ON o.i = f.i + 1)
SELECT c_custkey, fold FROM customer JOIN f ON g = c_nationkey""")
def balanced_folds(spark, d):
    return V.folds(_t(spark, d, "customer"), "c_nationkey", 4, 4).select("c_custkey", "fold")


@query()
def screen_fit(spark, d):
    model, intercept = V.fit(bridge(spark, d, "features"), NAMES)
    return spark.createDataFrame([(n, *v) for n, v in model.items()] + [("intercept", intercept, 0.0, 1.0)], "feature string, weight double, mean double, std double")


_RING = "v AS (SELECT o_custkey AS ring, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS last, (o_orderkey % 97)::DOUBLE AS x, (o_orderkey * 31 % 89)::DOUBLE AS y FROM orders), e AS (SELECT ring, n, last, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY ring ORDER BY n))"


def _ring(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("ring"), F.row_number().over(w).alias("n"), (F.col("o_orderkey") % 97).cast("double").alias("x"), (F.col("o_orderkey") * 31 % 89).cast("double").alias("y"))


_LEFT = lambda o, q, r: f"(({q[0]} - {o[0]}) * ({r[1]} - {o[1]}) - ({q[1]} - {o[1]}) * ({r[0]} - {o[0]}) > 0)"
_A1, _A2, _B1, _B2 = ("a.x", "a.y"), ("a.x2", "a.y2"), ("b.x", "b.y"), ("b.x2", "b.y2")


@query(f"WITH {_RING} SELECT ring, coalesce(bool_or(hit), false) AS crosses FROM (SELECT a.ring, b.n > a.n + 1 AND NOT (a.n = 1 AND b.n = a.last) AND {_LEFT(_B1, _B2, _A1)} <> {_LEFT(_B1, _B2, _A2)} AND {_LEFT(_A1, _A2, _B1)} <> {_LEFT(_A1, _A2, _B2)} AS hit FROM e a JOIN e b ON a.ring = b.ring) GROUP BY ring")
def ring_crossings(spark, d):
    return H.self_intersects(_ring(spark, d), "ring")


@query(f"WITH {_RING}, m AS (SELECT ring, sum(x * y2 - x2 * y) / 2 AS area, sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))) AS perimeter FROM e GROUP BY ring) SELECT ring, area, round(perimeter, 6) AS perimeter, CASE WHEN area >= 0 THEN 'ccw' ELSE 'cw' END AS winding, round(4 * pi() * abs(area) / nullif(perimeter * perimeter, 0), 6) AS compactness FROM m")
def ring_measures(spark, d):
    return H.measures(_ring(spark, d), "ring").withColumns({c: F.round(c, 6) for c in ("perimeter", "compactness")})


@query(f"WITH {_RING}, m AS (SELECT ring, sum(x * y2 - x2 * y) AS a FROM e GROUP BY ring) SELECT ring, CASE WHEN a >= 0 THEN n ELSE last + 1 - n END::INT AS n, x, y FROM v JOIN m USING (ring)")
def ring_winding(spark, d):
    return H.oriented(_ring(spark, d), "ring").select("ring", "n", "x", "y")


_TRANSFORM = [-92.0, 0.25, 0.125, 30.0, 0.0625, -0.5]


@query("SELECT o_orderkey, c, r, -92 + 0.25::DOUBLE * c + 0.125::DOUBLE * r AS x, 30 + 0.0625::DOUBLE * c - 0.5::DOUBLE * r AS y, c AS c2, r AS r2 FROM (SELECT o_orderkey, (o_orderkey % 512)::DOUBLE AS c, (o_orderkey * 7 % 256)::DOUBLE AS r FROM orders)")
def affine_round_trip(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 512).cast("double").alias("c"), (F.col("o_orderkey") * 7 % 256).cast("double").alias("r"))
    x, y = H.affine(_TRANSFORM, F.col("c"), F.col("r"))
    o = o.withColumn("x", x).withColumn("y", y)
    c, r = H.affine(H.inverse(_TRANSFORM), F.col("x"), F.col("y"))
    return o.withColumn("c2", F.round(c, 6)).withColumn("r2", F.round(r, 6))


@query("SELECT pos, round((lon + 89.5::DOUBLE) * pi() / 180 * 6371008.8::DOUBLE * cos(radians(28.4::DOUBLE)), 4) AS east_m, round((lat - 28.4::DOUBLE) * pi() / 180 * 6371008.8::DOUBLE, 4) AS north_m FROM reports")
def local_offsets(spark, d):
    e, n = H.local_offset_m(F.col("lon"), F.col("lat"), F.lit(-89.5), F.lit(28.4))
    return bridge(spark, d, "reports").select("pos", F.round(e, 4).alias("east_m"), F.round(n, 4).alias("north_m"))


@query("SELECT mmsi, md5(string_agg(printf('%.4f %.4f', lon, lat), ',' ORDER BY t_us, pos)) AS line FROM reports GROUP BY mmsi")
def polyline(spark, d):
    line = H.polylines(bridge(spark, d, "reports"), "mmsi", ["t_us", "pos"])
    return line.select("mmsi", F.md5(F.array_join(F.transform("line", lambda p: F.format_string("%.4f %.4f", p[0], p[1])), ",")).alias("line"))


@query(f"""WITH {_RING.split(', e AS')[0]}, l AS (SELECT ring, n, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY ring ORDER BY n)),
g AS (SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS leg FROM l WHERE x2 IS NOT NULL),
b AS (SELECT *, coalesce(sum(leg) OVER (PARTITION BY ring ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(leg) OVER (PARTITION BY ring) AS whole FROM g),
a AS (SELECT ring, fraction, x, y, x2, y2, leg, before, fraction * whole AS att, n FROM b, (VALUES (0.0::DOUBLE), (0.3::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) f(fraction) WHERE before <= fraction * whole QUALIFY row_number() OVER (PARTITION BY ring, fraction ORDER BY n DESC) = 1)
SELECT ring, fraction, round(x + coalesce(least(1.0::DOUBLE, (att - before) / nullif(leg, 0)), 0) * (x2 - x), 5) AS x, round(y + coalesce(least(1.0::DOUBLE, (att - before) / nullif(leg, 0)), 0) * (y2 - y), 5) AS y FROM a""")
def path_by_fraction(spark, d):
    v = _ring(spark, d)
    asked = v.select("ring").distinct().withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in (0.0, 0.3, 0.75, 1.0)])))
    return H.along(v, "ring", asked).withColumns({c: F.round(c, 5) for c in "xy"})


@query("WITH n AS (SELECT scene, status, row_number() OVER (ORDER BY east - west DESC, scene) - 1 AS i, count(*) OVER () AS n FROM scenes) SELECT scene FROM n WHERE i IN (SELECT (k * n) // 12 FROM range(12) r(k))")
def best_to_worst(spark, d):
    s = bridge(spark, d, "scenes").withColumn("_k", F.struct((F.col("west") - F.col("east")).alias("a"), F.col("scene").alias("b")))
    return A.evenly_spaced(s, "_k", 12).select("scene")


ORACLE_SQL = {k: with_views(s, "duckdb") for k, s in R.oracles.items()}
QUERIES = R.queries
