"""Registered queries of gridded products and as-of joins, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof
from ..operators import grids as G
from .bridge import bridge, with_views
from .registry import Registry

R = Registry()
query = R.query
_T = "CASE WHEN pos % 53 = 0 THEN NULL ELSE t_us END"
_AT = f"""q AS (SELECT pos, {_T} AS t FROM reports),
ax AS (SELECT step, at_us, coalesce(lead(step) OVER (ORDER BY at_us), step) AS nx, lead(at_us) OVER (ORDER BY at_us) AS nx_us FROM axis),
c AS (SELECT pos, t, CASE WHEN t IS NOT NULL THEN least(greatest(t, (SELECT min(at_us) FROM axis)), (SELECT max(at_us) FROM axis)) END AS k FROM q),
b AS (SELECT c.*, ax.* FROM c ASOF LEFT JOIN ax ON c.k >= ax.at_us)"""


def _bracketed(spark, d):
    r = bridge(spark, d, "reports").select("pos", F.when(F.col("pos") % 53 != 0, F.col("t_us")).alias("t"))
    return asof.bracket(r, "t", bridge(spark, d, "axis"), "step", "at_us", 3.6e10)


@query(f"WITH {_AT} SELECT pos, CASE WHEN nx_us - k < k - at_us THEN nx ELSE step END AS nearest, CASE WHEN nx_us - k < k - at_us THEN abs(t - nx_us) ELSE abs(t - at_us) END AS nearest_gap FROM b")
def asof_nearest(spark, d):
    return _bracketed(spark, d).select("pos", "nearest", "nearest_gap")


@query(f"WITH {_AT} SELECT pos, step AS before, nx AS after, round(CASE WHEN step IS NULL THEN NULL ELSE coalesce((k - at_us) / (nx_us - at_us)::DOUBLE, 0) END, 8) AS weight, abs(t - k) AS gap FROM b")
def asof_bracket(spark, d):
    return _bracketed(spark, d).select("pos", "before", "after", F.round("weight", 8).alias("weight"), "gap")


@query("SELECT step, gj, gi, u, v FROM field WHERE lat BETWEEN 28 - 0.25::DOUBLE AND 30 + 0.25::DOUBLE AND lon BETWEEN -91 - 0.25::DOUBLE AND -89 + 0.25::DOUBLE")
def grid_window(spark, d):
    return G.window(bridge(spark, d, "field"), -91.0, 28.0, -89.0, 30.0, 0.25).select("step", "gj", "gi", "u", "v")


@query("""SELECT step, count(*) AS cells, count(u) AS valid, min(u) AS u_min, max(u) AS u_max, min(v) AS v_min, max(v) AS v_max, round(min(sqrt(u * u + v * v)), 6) AS speed_min, round(max(sqrt(u * u + v * v)), 6) AS speed_max,
round(avg(sqrt(u * u + v * v)), 6) AS speed_mean, round(degrees(atan2(-avg(u), -avg(v))) - 360 * floor(degrees(atan2(-avg(u), -avg(v))) / 360), 4) AS from_deg FROM field GROUP BY step""")
def field_statistics(spark, d):
    return G.statistics(bridge(spark, d, "field"), "step").withColumns({c: F.round(c, 6) for c in ("speed_min", "speed_max", "speed_mean")}).withColumn("from_deg", F.round("from_deg", 4))


@query("WITH n AS (SELECT step, count(u) AS finite FROM field GROUP BY step) SELECT step, finite FROM n ORDER BY finite DESC, step LIMIT 1")
def fullest_slice(spark, d):
    return G.fullest_slice(bridge(spark, d, "field"), "step")


@query("""SELECT event_id AS qid, u AS value FROM events LEFT JOIN (SELECT gi, gj, u FROM field WHERE step = 1) ON gi = round_even((event_id % 500) / 100.0::DOUBLE / 0.5::DOUBLE, 0)::INT AND gj = round_even((event_id * 7 % 400) / 100.0::DOUBLE / 0.5::DOUBLE, 0)::INT""")
def grid_nearest(spark, d):
    q = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("qid"), (F.col("event_id") % 500 / F.lit(100.0)).alias("x"), (F.col("event_id") * 7 % 400 / F.lit(100.0)).alias("y"))
    return G.nearest_cell(q, bridge(spark, d, "field").filter("step = 1").select("gi", "gj", F.col("u").alias("value")), 0.0, 0.0, 0.5)


_COVER = """g AS (SELECT min(gi) AS i0, max(gi) AS i1, min(gj) AS j0, max(gj) AS j1 FROM field),
n AS (SELECT scene, step, abs(t_us - at_us) / 3.6e9::DOUBLE AS h FROM scenes, axis WHERE t_us IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scene ORDER BY abs(t_us - at_us), step) = 1),
w AS (SELECT s.*, n.step, n.h, coalesce(west >= -92 + i0 * 0.5::DOUBLE AND east <= -92 + i1 * 0.5::DOUBLE AND south >= 27 + j0 * 0.5::DOUBLE AND north <= 27 + j1 * 0.5::DOUBLE, false) AS inside FROM scenes s LEFT JOIN n USING (scene), g),
k AS (SELECT w.scene, count(*) AS water_cells FROM w JOIN field f ON f.step = coalesce(w.step, 1) AND f.u IS NOT NULL AND f.gi BETWEEN ceil((west - 0.5::DOUBLE + 92) / 0.5::DOUBLE) AND floor((east + 0.5::DOUBLE + 92) / 0.5::DOUBLE) AND f.gj BETWEEN ceil((south - 0.5::DOUBLE - 27) / 0.5::DOUBLE) AND floor((north + 0.5::DOUBLE - 27) / 0.5::DOUBLE) GROUP BY w.scene),
v AS (SELECT w.*, coalesce(water_cells, 0) AS water_cells, inside AND coalesce(water_cells, 0) > 0 AS spatial, coalesce(h <= 24, false) AS temporal FROM w LEFT JOIN k USING (scene))"""


def _covered(spark, d):
    return G.coverage(bridge(spark, d, "scenes"), bridge(spark, d, "field"), bridge(spark, d, "axis"), 0.5, -92.0, 27.0, width_us=3.6e10)


@query(f"""WITH {_COVER} SELECT scene, spatial, temporal, spatial AND temporal AS usable, step, round(h, 2) AS gap_h, water_cells,
array_to_string(list_filter([CASE WHEN NOT inside THEN 'footprint outside the grid' WHEN water_cells = 0 THEN 'no cells with a value over the footprint' END, CASE WHEN t_us IS NULL THEN 'time unknown' WHEN NOT temporal THEN printf('nearest step %.1f days away', round(h / 24, 1)) END], lambda x: x IS NOT NULL), '|') AS reasons FROM v""")
def coverage_test(spark, d):
    return _covered(spark, d).withColumn("reasons", F.array_join("reasons", "|"))


@query(f"""WITH {_COVER}, c AS (SELECT count(*) AS scenes, count(*) FILTER (spatial AND temporal) AS usable, count(*) FILTER (spatial AND NOT temporal) AS space_only FROM v)
SELECT *, CASE WHEN scenes = 0 THEN 'nothing to test' WHEN usable = scenes THEN 'covers every scene in space and time' WHEN usable > 0 THEN printf('covers %d of %d scenes in space and time', usable, scenes)
WHEN space_only > 0 THEN printf('covers %d of %d scenes in space, none in time', space_only, scenes) ELSE 'covers no scene' END AS verdict FROM c""")
def coverage_verdict(spark, d):
    return G.coverage_verdict(_covered(spark, d))


@query("WITH l AS (SELECT DISTINCT gj, gi, lat, lon FROM field WHERE u IS NULL AND lat BETWEEN 27.5::DOUBLE AND 30.5::DOUBLE AND lon BETWEEN -91.5::DOUBLE AND -88::DOUBLE) SELECT *, (SELECT count(*) FROM l) > 20 AS truncated FROM l ORDER BY lat, lon LIMIT 20")
def land_cells(spark, d):
    return G.flagged_cells(bridge(spark, d, "field"), (-91.5, 27.5, -88.0, 30.5), 20)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN p NOT IN (7, 11) AND p BETWEEN 3 AND 90 THEN p * 0.25::DOUBLE + 1.5::DOUBLE END AS value FROM (SELECT l_orderkey, l_linenumber, l_partkey % 100 AS p FROM lineitem)")
def cf_decode(spark, d):
    raw = F.col("l_partkey") % 100
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", G.decode(raw, 7, 11, 3, 90, 0.25, 1.5).alias("value"))


_UNITS = "CASE o_orderkey % 6 WHEN 0 THEN 'hours since 1970-01-01 00:00:00' WHEN 1 THEN 'Days since 1950-1-1' WHEN 2 THEN ' seconds since 2000-01-01T06:30' WHEN 3 THEN 'weeks since 2000-01-01' WHEN 4 THEN 'minutes since ' || (1980 + o_orderkey % 40)::STRING || '-02-03 04:05:06.5' END"


@query(f"""SELECT o_orderkey, CASE WHEN m THEN CASE lower(regexp_extract(u, '^\\s*(\\w+)', 1)) WHEN 'hours' THEN 3600 WHEN 'days' THEN 86400 WHEN 'seconds' THEN 1 WHEN 'minutes' THEN 60 END END::BIGINT AS seconds,
CASE WHEN m AND k NOT LIKE 'weeks%' THEN epoch_us(make_timestamp(x(k, 'since (\\d+)-'), x(k, 'since \\d+-(\\d+)-'), x(k, 'since \\d+-\\d+-(\\d+)'), x(k, '[ t](\\d+):'), x(k, '[ t]\\d+:(\\d+)'), x(k, '[ t]\\d+:\\d+:(\\d+)')::DOUBLE)) END AS epoch_us
FROM (SELECT o_orderkey, {_UNITS} AS u, lower(trim({_UNITS})) AS k, coalesce({_UNITS} <> '', false) AS m FROM orders)""".replace("x(k, ", "y(k, "))
def time_units(spark, d):
    scale, epoch = G.time_units(F.expr(_UNITS.replace("::STRING", "").replace("(1980 + o_orderkey % 40)", "CAST(1980 + o_orderkey % 40 AS STRING)")))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", scale.alias("seconds"), epoch.alias("epoch_us"))


@query("SELECT o_orderkey, CASE WHEN w >= 0 THEN x - 360 * floor(x / 360) ELSE (x + 180) - 360 * floor((x + 180) / 360) - 180 END AS lon FROM (SELECT o_orderkey, (o_orderkey * 37 % 7200) / 10.0::DOUBLE - 360 AS x, (o_orderkey % 3) - 1.0::DOUBLE AS w FROM orders)")
def longitude_shift(spark, d):
    x, w = F.col("o_orderkey") * 37 % 7200 / F.lit(10.0) - 360, F.col("o_orderkey") % 3 - F.lit(1.0)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", G.to_convention(x, w).alias("lon"))


QUERIES, ORACLE_SQL = R.queries, {k: with_views(s, "duckdb") for k, s in R.oracles.items()}
for _k, _s in list(ORACLE_SQL.items()):  # y(text, pattern): the first group as a number, 0 without a match
    while (_i := ORACLE_SQL[_k].find("y(k, '")) >= 0:
        _s = ORACLE_SQL[_k]
        _j = _s.index("')", _i)
        ORACLE_SQL[_k] = _s[:_i] + f"coalesce(TRY_CAST(regexp_extract(k, '{_s[_i + 6 : _j]}', 1) AS INT), 0)" + _s[_j + 2 :]
