"""Registered queries of particles, products, regions and splits, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import products
from ..operators import cases as K
from ..operators import drift as D
from ..operators import evaluation as E
from ..operators import rasters as P
from ..operators import reports as Q
from ..operators import sampling as A
from ..operators import scenes as S
from ..operators import shortlist as S_
from .bridge import bridge, with_views
from .registry import Registry
from .scene_queries import _PX, _hav, _pixels, boxed
from .vessel_queries import _PARSED

R = Registry()
query = R.query


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(df, places, *columns):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query(f"""WITH c AS (SELECT step, avg(lon) AS clon, avg(lat) AS clat FROM particles GROUP BY step), o AS (SELECT clon AS olon, clat AS olat FROM c ORDER BY step LIMIT 1),
p AS (SELECT p.*, clon, clat, {_hav('lon', 'lat', 'clon', 'clat')} AS away, {_hav('lon', 'lat', 'olon', 'olat')} AS moved FROM particles p JOIN c USING (step), o)
SELECT step, count(*) AS particles, round(any_value(clon), 6) AS clon, round(any_value(clat), 6) AS clat, round(quantile_cont(away, 0.5), 5) AS p50_km, round(quantile_cont(away, 0.9), 5) AS p90_km, round(max(away), 5) AS max_km, round(avg(moved), 5) AS moved_km, round(max(moved), 5) AS moved_max_km,
count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'beached') AS beached, count(*) FILTER (state = 'exited') AS exited FROM p GROUP BY step""")
def particle_cloud_stats(spark, d):
    return _r(_r(D.cloud(bridge(spark, d, "particles")), 6, "clon", "clat"), 5, "p50_km", "p90_km", "max_km", "moved_km", "moved_max_km")


_CLOUD = f"""c AS (SELECT step, avg(lon) AS clon, avg(lat) AS clat FROM particles GROUP BY step), aw AS (SELECT p.step, clon, clat, {_hav('lon', 'lat', 'clon', 'clat')} AS away FROM particles p JOIN c USING (step)),
cl AS (SELECT step, any_value(clon) AS clon, any_value(clat) AS clat, quantile_cont(away, 0.9) AS p90 FROM aw GROUP BY step)"""


@query(f"""WITH {_CLOUD}, e AS (SELECT min(clon) AS w, max(clon) AS e, min(clat) AS s, max(clat) AS n, max(p90) + 25 AS r FROM cl), k AS (SELECT *, r / 111.32::DOUBLE AS la, r / greatest(111.32::DOUBLE * cos(radians((s + n) / 2)), 1) AS lo FROM e)
SELECT round(w - lo, 6) AS west, round(s - la, 6) AS south, round(e + lo, 6) AS east, round(n + la, 6) AS north FROM k""")
def box_from_envelope(spark, d):
    """A box around the circles that hold nine tenths of the particles of each step."""
    e = D.cloud(bridge(spark, d, "particles")).select(F.col("clon").alias("lon"), F.col("clat").alias("lat"), F.col("p90_km").alias("radius_km"))
    return _r(D.envelope_box(e), 6, "west", "south", "east", "north")


@query(f"""WITH {_CLOUD}, t AS (SELECT cl.step, cl.step * 6.0::DOUBLE AS hours, {_hav('o.clon', 'o.clat', 'cl.clon', 'cl.clat')} / (cl.p90 / 8) AS ratio FROM cl, (SELECT clon, clat FROM cl ORDER BY step LIMIT 1) o)
SELECT min_by(hours, step) FILTER (ratio >= 1) AS resolvable_h, round(max(ratio), 5) AS max_ratio, max(hours) AS horizon_h FROM t""")
def spill_age(spark, d):
    t = D.cloud(bridge(spark, d, "particles")).select("step", (F.col("step") * F.lit(6.0)).alias("hours"), F.col("clon").alias("lon"), F.col("clat").alias("lat"), (F.col("p90_km") / 8).alias("spread_km"))
    return S_.spill_age(t).withColumn("max_ratio", F.round("max_ratio", 5))


MODES = [{"kx": 2e-4, "ky": 1e-4, "amplitude": 0.3, "period_h": 12.0, "px": 0.5, "py": 1.0, "pt": 0.25}, {"kx": 5e-5, "ky": 3e-4, "amplitude": 0.1, "period_h": 30.0, "px": 0.0, "py": 2.0, "pt": 1.5}]


def _mode(m, i):
    k = (m["kx"] ** 2 + m["ky"] ** 2) ** 0.5
    c = f"{m['amplitude'] / k!r}::DOUBLE * cos(2 * pi() / {m['period_h'] * 3600!r}::DOUBLE * t + {m['pt']!r}::DOUBLE)"
    a, b = f"({m['kx']!r}::DOUBLE * x + {m['px']!r}::DOUBLE)", f"({m['ky']!r}::DOUBLE * y + {m['py']!r}::DOUBLE)"
    return f"{c} * {m['ky']!r}::DOUBLE * sin({a}) * cos({b})" if i == 0 else f"-({c}) * {m['kx']!r}::DOUBLE * cos({a}) * sin({b})"


@query(f"SELECT event_id, round({' + '.join(_mode(m, 0) for m in MODES)} + 0.05::DOUBLE, 8) AS u, round({' + '.join(_mode(m, 1) for m in MODES)} - 0.02::DOUBLE, 8) AS v FROM (SELECT event_id, (event_id % 97) * 1000.0::DOUBLE AS x, (event_id % 89) * 1000.0::DOUBLE AS y, (event_id % 48) * 1800.0::DOUBLE AS t FROM events)")
def eddy_currents(spark, d):
    e = F.col("event_id")
    u, v = D.eddies(MODES, e % 97 * F.lit(1000.0), e % 89 * F.lit(1000.0), e % 48 * F.lit(1800.0), (0.05, -0.02))
    return _t(spark, d, "events").select("event_id", F.round(u, 8).alias("u"), F.round(v, 8).alias("v"))


_NAME = "'subset_' || (o_orderkey % 5)::STRING || '_of_S1' || CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END || '_IW_GRD' || CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE 'H' END || '_1S' || CASE o_orderkey % 3 WHEN 0 THEN 'DV' WHEN 1 THEN 'SH' ELSE 'DH' END || '_20180803T17' || lpad((o_orderkey % 60)::STRING, 2, '0') || '51_20180803T175608_' || lpad((o_custkey % 1000000)::STRING, 6, '0') || '_0281B1_DB30_Cal'"


@query(f"""WITH n AS (SELECT o_orderkey, {_NAME} AS name, o_orderkey % 11 > 0 AS ok FROM orders)
SELECT o_orderkey, CASE WHEN ok THEN name[13:15] END AS mission, CASE WHEN ok THEN 'IW' END AS mode, CASE WHEN ok THEN epoch_us(strptime(regexp_extract(name, '_(\\d{{8}}T\\d{{6}})_', 1), '%Y%m%dT%H%M%S')) END AS start_us, CASE WHEN ok THEN regexp_extract(name, '175608_(\\d{{6}})', 1)::INT END AS orbit,
CASE WHEN ok THEN CASE o_orderkey % 3 WHEN 0 THEN 'VV,VH' WHEN 1 THEN 'HH' ELSE 'HH,HV' END END AS bands, CASE WHEN ok THEN regexp_extract(name, 'of_(.*)_Cal', 1) END AS group_key, (o_orderkey % 5)::INT AS subset FROM n""")
def product_id_regex(spark, d):
    name = F.expr(_NAME.replace("::STRING", "").replace("(o_orderkey % 5)", "CAST(o_orderkey % 5 AS STRING)").replace("(o_orderkey % 60)", "CAST(o_orderkey % 60 AS STRING)").replace("(o_custkey % 1000000)", "CAST(o_custkey % 1000000 AS STRING)"))
    n, of = products.subset(name)
    p = _t(spark, d, "orders").select("o_orderkey", products.product_id(of).alias("p"), n.alias("subset"))
    return p.select("o_orderkey", "p.mission", "p.mode", F.col("p.start").alias("start_us"), "p.orbit", F.array_join("p.bands", ",").alias("bands"), "p.group_key", "subset")


_XML = "'<Doc><DATASET_NAME>subset_' || {k} || '_of_plain</DATASET_NAME><NCOLS> ' || {k} || ' </NCOLS><NROWS>x</NROWS><BAND_NAME>VH</BAND_NAME><B a=\"1\"/><BAND_NAME id=\"2\"> VV </BAND_NAME><NO_DATA_VALUE>0.5</NO_DATA_VALUE><NO_DATA_VALUE_USED>' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || '</NO_DATA_VALUE_USED><CUT'"


@query("SELECT o_orderkey, 'subset_' || o_orderkey::STRING || '_of_plain' AS name, o_orderkey::INT AS cols, NULL::INT AS rows, 'VH,VV' AS bands, CASE WHEN o_orderkey % 2 = 0 THEN 0.5::DOUBLE END AS nodata, o_orderkey::INT AS subset, NULL::VARCHAR AS group_key FROM orders")
def header_fields(spark, d):
    h = _t(spark, d, "orders").select("o_orderkey", products.header(F.expr(_XML.format(k="CAST(o_orderkey AS STRING)"))).alias("h"))
    return h.select("o_orderkey", "h.*").withColumn("bands", F.array_join("bands", ","))


_OFF = lambda r: "(VALUES " + ", ".join(f"({a}, {b})" for a, b in P.disc(r)) + ") k(a, b)"
_SPREAD = lambda m, r: f"SELECT scene, (row_i + a)::INT AS row_i, (col_i + b)::INT AS col_i, count(*) AS n FROM {m}, {_OFF(r)} GROUP BY 1, 2, 3"
_MASK = "mk AS (SELECT scene, row_i, col_i FROM pixels WHERE vv < 120)"

for _how, _first, _then in (("open", "WHERE n = 5", ""), ("close", "", "WHERE n = 5")):
    R.oracles[f"mask_{_how}"] = f"WITH {_MASK}, s1 AS ({_SPREAD('mk', 1)}), m1 AS (SELECT scene, row_i, col_i FROM s1 {_first}), s2 AS ({_SPREAD('m1', 1)}) SELECT scene, row_i, col_i FROM s2 {_then}"
    R.queries[f"mask_{_how}"] = lambda spark, d, how=_how: P.morph(bridge(spark, d, "pixels").filter("vv < 120").select("scene", "row_i", "col_i"), how, P.disc(1))


_G = "(VALUES " + ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in [(k, __import__("math").exp(-k * k / 2.0)) for k in range(-3, 4)]) + ")"
_REGIONS = f"""RECURSIVE {_PX}, g0 AS (SELECT scene, row_i, col_i, value AS s, 1.0::DOUBLE AS w FROM px WHERE NOT invalid),
g1 AS (SELECT scene, row_i + k AS row_i, col_i, sum(s * g) AS s, sum(w * g) AS w FROM g0, {_G} t(k, g) GROUP BY 1, 2, 3),
g2 AS (SELECT scene, row_i, col_i + k AS col_i, sum(s * g) AS s, sum(w * g) AS w FROM g1, {_G} t(k, g) GROUP BY 1, 2, 3),
sm AS (SELECT px.*, g2.s / g2.w AS smooth FROM px JOIN g2 USING (scene, row_i, col_i) WHERE NOT invalid),
lm AS (SELECT scene, avg(smooth) - 0.5::DOUBLE * stddev_pop(smooth) AS lim FROM sm GROUP BY scene),
dk AS (SELECT scene, row_i, col_i, row_number() OVER (ORDER BY scene, row_i, col_i) AS id FROM sm JOIN lm USING (scene) WHERE smooth <= lim),
nb AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM (SELECT dk.*, row_i + p AS r, col_i + q AS c FROM dk, (VALUES (-1), (0), (1)) u(p), (VALUES (-1), (0), (1)) w(q)) x JOIN dk y ON y.scene = x.scene AND y.row_i = x.r AND y.col_i = x.c),
cc(id, root) USING KEY (id) AS (SELECT a, min(b) FROM nb GROUP BY a UNION SELECT nb.a, min(cc.root) FROM cc JOIN nb ON nb.b = cc.id JOIN recurring.cc AS o ON o.id = nb.a WHERE cc.root < o.root GROUP BY nb.a),
sz AS (SELECT scene, root, count(*) AS area, min(row_i * 100000 + col_i) AS first FROM cc JOIN dk USING (id) GROUP BY scene, root HAVING count(*) >= 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY area DESC, first)::INT AS region FROM sz QUALIFY region <= 4)"""


def _regions(spark, d):
    return P.dark_regions(_pixels(spark, d), 1.0, 0.5, 0, 0, 3, 4)


@query(f"WITH {_REGIONS} SELECT scene, region, area FROM rk")
def dark_regions(spark, d):
    return _regions(spark, d).groupBy("scene", "region").agg(F.count(F.lit(1)).alias("area"))


@query(f"""WITH {_REGIONS}, ce AS (SELECT dk.scene, rk.region, row_i, col_i FROM cc JOIN dk USING (id) JOIN rk ON rk.scene = dk.scene AND rk.root = cc.root),
ri AS (SELECT DISTINCT ce.scene, region, (row_i + a) AS row_i, (col_i + b) AS col_i FROM ce, {_OFF(2)}),
ar AS (SELECT ri.scene, ri.region, avg(value) AS m, stddev_pop(value) AS s FROM ri JOIN px ON px.scene = ri.scene AND px.row_i = ri.row_i AND px.col_i = ri.col_i AND NOT px.invalid WHERE NOT EXISTS (SELECT 1 FROM ce WHERE ce.scene = ri.scene AND ce.row_i = ri.row_i AND ce.col_i = ri.col_i) GROUP BY 1, 2),
ow AS (SELECT ce.scene, region, count(*) AS area, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.1) AS p10 FROM ce JOIN px USING (scene, row_i, col_i) GROUP BY 1, 2),
ed AS (SELECT ce.scene, ce.region, count(*) AS edge FROM ce, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) k(a, b) WHERE NOT EXISTS (SELECT 1 FROM ce c2 WHERE c2.scene = ce.scene AND c2.region = ce.region AND c2.row_i = ce.row_i + a AND c2.col_i = ce.col_i + b) GROUP BY 1, 2),
su AS (SELECT scene, row_i, col_i, g2.s / g2.w AS z FROM px LEFT JOIN g2 USING (scene, row_i, col_i)),
sx AS (SELECT *, coalesce(lead(z) OVER w, lag(z) OVER w, z) - coalesce(lag(z) OVER w, lead(z) OVER w, z) AS d, coalesce(lag(z) OVER w, lead(z) OVER w, z) + 2 * z + coalesce(lead(z) OVER w, lag(z) OVER w, z) AS t FROM su WINDOW w AS (PARTITION BY scene, row_i ORDER BY col_i)),
sy AS (SELECT scene, row_i, col_i, sqrt(pow(coalesce(lag(d) OVER w, lead(d) OVER w, d) + 2 * d + coalesce(lead(d) OVER w, lag(d) OVER w, d), 2) + pow(coalesce(lead(t) OVER w, lag(t) OVER w, t) - coalesce(lag(t) OVER w, lead(t) OVER w, t), 2)) AS g FROM sx WINDOW w AS (PARTITION BY scene, col_i ORDER BY row_i)),
cr AS (SELECT DISTINCT ce.scene, region, row_i + a AS row_i, col_i + b AS col_i FROM ce, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) k(a, b)),
er AS (SELECT ce.* FROM ce, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) k(a, b) JOIN ce c2 ON c2.scene = ce.scene AND c2.region = ce.region AND c2.row_i = ce.row_i + a AND c2.col_i = ce.col_i + b GROUP BY ALL HAVING count(*) = 5),
eg AS (SELECT cr.scene, cr.region, avg(g) AS edge_g FROM cr ANTI JOIN er USING (scene, region, row_i, col_i) JOIN sy USING (scene, row_i, col_i) GROUP BY 1, 2),
bg AS (SELECT ri.scene, ri.region, avg(g) AS sea_g FROM ri JOIN px USING (scene, row_i, col_i) JOIN sy USING (scene, row_i, col_i) WHERE NOT px.invalid AND NOT EXISTS (SELECT 1 FROM ce WHERE ce.scene = ri.scene AND ce.row_i = ri.row_i AND ce.col_i = ri.col_i) GROUP BY 1, 2),
hp AS MATERIALIZED (SELECT DISTINCT scene, region, x, y FROM (SELECT scene, region, row_i, min(col_i) AS c0, max(col_i) + 1 AS c1 FROM ce GROUP BY 1, 2, 3), LATERAL (VALUES (c0, row_i), (c1, row_i), (c0, row_i + 1), (c1, row_i + 1)) v(x, y)),
hs AS (SELECT a.scene, a.region, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bz, bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) >= 0) AS side,
  bool_or((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) < 0) AS split FROM hp a JOIN hp b ON a.scene = b.scene AND a.region = b.region AND (a.x, a.y) <> (b.x, b.y) JOIN hp c ON c.scene = a.scene AND c.region = a.region GROUP BY ALL),
ha AS (SELECT scene, region, sum(ax * bz - bx * ay) / 2.0::DOUBLE AS hull FROM hs WHERE side AND NOT split GROUP BY 1, 2)
SELECT scene, region, area, round((mean - m) / nullif(s, 0), 5) AS darkness_z, round((p10 - m) / nullif(s, 0), 5) AS darkness_p10_z, round(std / nullif(s, 0), 5) AS texture_ratio, round(4 * pi() * area / (edge * edge), 6) AS compactness,
  round(CASE WHEN sea_g > 1e-6::DOUBLE THEN edge_g / sea_g ELSE 0 END, 5) AS edge_sharpness, round(area / hull, 6) AS solidity FROM ow LEFT JOIN ar USING (scene, region) JOIN ed USING (scene, region) JOIN eg USING (scene, region) LEFT JOIN bg USING (scene, region) JOIN ha USING (scene, region)""")
def region_features(spark, d):
    f = P.region_features(_pixels(spark, d), _regions(spark, d), 2)
    return f.select("scene", "region", "area", *[F.round(c, 5).alias(c) for c in ("darkness_z", "darkness_p10_z", "texture_ratio", "edge_sharpness")], *[F.round(c, 6).alias(c) for c in ("compactness", "solidity")])


@query("SELECT DISTINCT k, r AS row_i, c AS col_i FROM (SELECT o_custkey AS k, o_orderkey % 9 AS x0, o_orderkey % 7 AS y0, o_orderkey % 4 AS w, o_orderkey % 3 AS h FROM orders), range(20) a(r), range(20) b(c) WHERE r >= y0 AND r < y0 + h AND c >= x0 AND c < x0 + w")
def boxes_to_mask(spark, d):
    o, x0, y0 = F.col("o_orderkey"), F.col("o_orderkey") % 9, F.col("o_orderkey") % 7
    b = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), *[c.cast("double").alias(n) for n, c in (("x0", x0), ("y0", y0), ("x1", x0 + o % 4), ("y1", y0 + o % 3))])
    return P.box_cells(b, "k").select("k", F.col("row_i").cast("long").alias("row_i"), F.col("col_i").cast("long").alias("col_i"))


@query(f"WITH {_REGIONS}, l AS (SELECT scene, max(area) AS largest FROM rk GROUP BY scene) SELECT s.scene, coalesce(largest, 0) AS largest, coalesce(largest, 0) >= 6 AS alarm FROM (SELECT DISTINCT scene FROM pixels) s LEFT JOIN l USING (scene)")
def alarm_rule(spark, d):
    return P.alarms(_regions(spark, d), bridge(spark, d, "pixels"), 6)


_U = "(('0x' || substr(sha256('{s}:' || c_mktsegment), 1, 16))::UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE"


@query(f"""WITH g AS (SELECT c_mktsegment, count(*) AS n, CASE WHEN {_U.format(s=11)} < 0.02::DOUBLE THEN 'test' WHEN {_U.format(s=11)} < 0.04::DOUBLE THEN 'val' ELSE 'train' END AS split FROM customer GROUP BY c_mktsegment),
k AS (SELECT *, count(*) FILTER (split = 'train') OVER () AS tr, count(*) FILTER (split = 'val') OVER () AS va, count(*) FILTER (split = 'test') OVER () AS te, row_number() OVER (PARTITION BY split ORDER BY n, c_mktsegment DESC) AS l FROM g)
SELECT c_custkey, CASE WHEN split = 'train' AND l <= least((va = 0)::INT + (te = 0)::INT, tr - 1) THEN CASE WHEN l = 1 AND va = 0 THEN 'val' ELSE 'test' END ELSE split END AS split FROM customer JOIN k USING (c_mktsegment)""")
def split_never_empty(spark, d):
    return A.whole_split(_t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", 11, 0.02, 0.02).select("c_custkey", "split")


_DOC = "'<Dimap_Document><Raster_Dimensions><NCOLS>' || {k} || '</NCOLS><NROWS>7</NROWS></Raster_Dimensions><Image_Interpretation><Spectral_Band_Info><BAND_INDEX>1</BAND_INDEX><BAND_NAME>VV</BAND_NAME></Spectral_Band_Info><Spectral_Band_Info><BAND_INDEX>0</BAND_INDEX><BAND_NAME>VH</BAND_NAME><PHYSICAL_UNIT>dB</PHYSICAL_UNIT></Spectral_Band_Info></Image_Interpretation></Dimap_Document>'"


@query("SELECT o_orderkey, o_orderkey::INT AS cols, 7 AS rows, '0 VH dB|1 VV -' AS bands FROM orders")
def header_document(spark, d):
    h = _t(spark, d, "orders").select("o_orderkey", products.document(F.expr(_DOC.format(k="CAST(o_orderkey AS STRING)"))).alias("h"))
    return h.select("o_orderkey", "h.cols", "h.rows", F.array_join(F.transform("h.bands", lambda b: F.concat_ws(" ", b["i"].cast("string"), b["name"], F.coalesce(b["unit"], F.lit("-")))), "|").alias("bands"))


@query(f"WITH {_PARSED}, v AS (SELECT mmsi, count(*) AS n FROM parsed WHERE disposition = 'usable' GROUP BY mmsi) SELECT count(*) AS seen, count(*) FILTER (n >= 3) AS kept, count(*) FILTER (n < 3) AS dropped, coalesce(sum(n) FILTER (n >= 3), 0)::BIGINT AS reports FROM v")
def vessel_funnel(spark, d):
    return Q.vessel_funnel(Q.parse(bridge(spark, d, "raw")), 3)


@query("WITH l AS (SELECT DISTINCT gi, gj FROM field WHERE u IS NULL) SELECT mmsi, count(*) AS reports, count(l.gi) AS on_land FROM reports LEFT JOIN l ON gi = round_even((lon + 92) / 0.5::DOUBLE, 0)::INT AND gj = round_even((lat - 27) / 0.5::DOUBLE, 0)::INT GROUP BY mmsi")
def land_reports(spark, d):
    return Q.on_land(bridge(spark, d, "reports"), bridge(spark, d, "field").filter("u is null"), -92.0, 27.0, 0.5)


_SEARCH = [20.0, 40.0, 60.0]


@query(f"""WITH {_PX}, {boxed(1)}, {boxed(2)}, al AS (SELECT 1 AS reach, * FROM bm1 UNION ALL SELECT 2, * FROM bm2), g AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in _SEARCH)}]) AS threshold),
c AS (SELECT reach, threshold, count(*) FILTER (contrast >= threshold AND oil) AS tp, count(*) FILTER (contrast >= threshold AND NOT oil) AS fp, count(*) FILTER (contrast < threshold AND oil) AS fn FROM g, al WHERE NOT invalid AND contrast IS NOT NULL GROUP BY reach, threshold)
SELECT reach, threshold, round(tp / nullif(tp + fp + fn, 0)::DOUBLE, 8) AS iou FROM c""")
def baseline_search(spark, d):
    """Every reach with every contrast, each reach from one pass over its contrasts."""
    out = None
    for reach in (1, 2):
        p = S.dark(_pixels(spark, d), reach, 0.0).filter("not invalid").select(F.round("contrast", 9).alias("score"), F.col("oil").cast("int").alias("y"))
        one = E.sweep(p, _SEARCH).select(F.lit(reach).alias("reach"), "threshold", F.round("iou", 8).alias("iou"))
        out = one if out is None else out.unionByName(one)
    return out


_F = lambda c, n: f"printf('%.{n}f', round({c}, {n}))"


@query(f"""WITH c AS (SELECT step, avg(lon) AS clon, avg(lat) AS clat FROM particles GROUP BY step), p AS (SELECT p.*, clon, clat, {_hav('lon', 'lat', 'clon', 'clat')} AS away FROM particles p JOIN c USING (step)),
s AS (SELECT step, count(*) AS n, any_value(clon) AS clon, any_value(clat) AS clat, quantile_cont(away, 0.9) AS p90, count(*) FILTER (state = 'active') AS active FROM p GROUP BY step)
SELECT step, 'backward,' || step::STRING || ',' || {_F('clon', 4)} || ',' || {_F('clat', 4)} || ',' || {_F('p90', 3)} || ',' || n::STRING || ',' || active::STRING || ',"synthetic, see limits"' AS line FROM s""")
def drift_csv(spark, d):
    c = D.cloud(bridge(spark, d, "particles"))
    f = lambda x, n: F.format_string(f"%.{n}f", F.round(x, n))
    return c.select("step", K.line(F.lit("backward"), F.col("step"), f("clon", 4), f("clat", 4), f("p90_km", 3), F.col("particles"), F.col("active"), F.lit("synthetic, see limits")).alias("line"))


@query(f"WITH {_REGIONS}, c AS (SELECT dk.scene, rk.region, count(*) AS area, avg(row_i) AS r, avg(col_i) AS q FROM cc JOIN dk USING (id) JOIN rk ON rk.scene = dk.scene AND rk.root = cc.root GROUP BY 1, 2) SELECT scene, region, 'slick-' || lpad(region::STRING, 2, '0') || ',' || area::STRING || ',' || {_F('r', 3)} || ',' || {_F('q', 3)} || ',' AS line FROM c")
def slicks_csv(spark, d):
    r = _regions(spark, d).groupBy("scene", "region").agg(F.count(F.lit(1)).alias("area"), F.avg("row_i").alias("r"), F.avg("col_i").alias("q"))
    f = lambda x: F.format_string("%.3f", F.round(x, 3))
    return r.select("scene", "region", K.line(F.format_string("slick-%02d", "region"), F.col("area"), f("r"), f("q"), F.lit(None).cast("string")).alias("line"))


ORACLE_SQL = {k: with_views(s, "duckdb") for k, s in R.oracles.items()}
QUERIES = R.queries
