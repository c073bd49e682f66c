"""Registered queries over vessel reports, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, regions
from ..functions.geo import bearing_deg, haversine_km
from ..operators import reports as R
from ..operators import shortlist as S
from .bridge import START_US, STEP_US, STEPS, bridge, with_views

BOX, WINDOW = (-120.0, 0.0, 60.0, 50.0), (1_704_412_800_000_000, 1_705_622_400_000_000)


def _joined(spark, d):
    return S.envelope_join(bridge(spark, d, "reports"), bridge(spark, d, "envelope"), START_US, STEP_US, STEPS)


def _static(spark, d):
    return bridge(spark, d, "reports").groupBy("mmsi").agg(F.pmod(F.max(F.col("mmsi").cast("long")), F.lit(110)).cast("int").alias("type_code"))


def _scored(spark, d):
    axis = S.drift_axis(-89.6, 28.3, -89.6 + 0.01 * STEPS, 28.3 + 0.004 * STEPS)
    return S.score(_joined(spark, d), _static(spark, d), axis)


def ais_parse(spark, d):
    return R.parse(bridge(spark, d, "raw")).drop("transceiver")


def ais_funnel(spark, d):
    return R.funnel(R.parse(bridge(spark, d, "raw")), BOX, WINDOW)


def ais_static_first_nonnull(spark, d):
    return R.vessels(R.parse(bridge(spark, d, "raw")), ["name", "imo", "call_sign", "type_code", "length_m"])


def _cleaning_input(spark, d):
    r = bridge(spark, d, "reports")
    return r.withColumn("t_us", F.when(F.col("pos") % 23 == 0, F.col("t_us") - F.col("t_us") % 86_400_000_000).otherwise(F.col("t_us"))).withColumn("lon", F.when(F.col("pos") % 29 == 0, F.lit(999.0)).otherwise(F.col("lon")))


def ais_clean_fold(spark, d):
    return R.clean(_cleaning_input(spark, d)).select("mmsi", "pos", F.coalesce("rejected", F.lit("accepted")).alias("fate"))


def ais_gaps(spark, d):
    return R.gaps(bridge(spark, d, "reports")).select("mmsi", "from_us", "to_us", F.round("minutes", 4).alias("minutes"), F.round("usual_s", 4).alias("usual_s"))


def ais_completeness(spark, d):
    out = R.completeness(bridge(spark, d, "reports"), ["sog"])
    return out.withColumn("report_share", F.round("report_share", 6)).withColumn("field_share", F.round("field_share", 6))


def ais_summary(spark, d):
    return R.summary(bridge(spark, d, "reports")).withColumn("median_sog", F.round("median_sog", 6))


def course_lag_lead(spark, d):
    return R.courses(bridge(spark, d, "reports")).select("mmsi", "pos", F.round("course", 5).alias("course"))


def vessel_group_map(spark, d):
    c = (F.col("event_id") % 130 - 5).cast("int")
    return spark.read.parquet(f"{d}/events.parquet").select(c.alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).select("code", codes.vessel_group(F.col("code")).alias("grp"), codes.relevance(codes.vessel_group(F.col("code")), F.col("code")).alias("relevance"), "n")


def nav_status_map(spark, d):
    c = (F.col("event_id") % 20).cast("int")
    return spark.read.parquet(f"{d}/events.parquet").select(c.alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).select("code", codes.nav_status(F.col("code")).alias("status"), "n")


def region_label(spark, d):
    pos = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", ((F.col("o_orderkey") * 7919) % 3700 / F.lit(10.0) - 185).alias("lon"), ((F.col("o_orderkey") * 104729) % 1820 / F.lit(10.0) - 91).alias("lat"))
    return pos.select("o_orderkey", regions.region_label().alias("label"))


def haversine(spark, d):
    r = bridge(spark, d, "reports")
    return r.select("pos", F.round(haversine_km(F.col("lon"), F.col("lat"), F.lit(-89.5), F.lit(28.4)), 6).alias("km"))


def bearing(spark, d):
    r = bridge(spark, d, "reports")
    return r.select("pos", F.round(bearing_deg(F.lit(-89.5), F.lit(28.4), F.col("lon"), F.col("lat")), 5).alias("deg"))


def envelope_join(spark, d):
    return _joined(spark, d).select("mmsi", "pos", "seg", F.round("dist", 5).alias("dist"), F.round("env_r", 5).alias("env_r"), "in_window")


def closest_approach(spark, d):
    a = S.approach(R.courses(_joined(spark, d)))
    return a.select("mmsi", "reports", "reports_in_window", "reports_relevant", "crossings", F.round("hours", 5).alias("hours"), F.round("dist_km", 4).alias("dist_km"), F.round("radii", 4).alias("radii"), "at_us", F.round("nearest_outside_km", 4).alias("nearest_outside_km"))


def min_sog_range_1h(spark, d):
    j = _joined(spark, d)
    return S.slowest_near(j, S.approach(R.courses(j))).select("mmsi", "lowest")


def _component(name):
    return lambda spark, d: _scored(spark, d).select("mmsi", f"s_{name}")


def vessel_ranking(spark, d):
    return S.rank(_scored(spark, d)).select("rank", "mmsi", "total", "relevant", "band", F.round("dist_km", 3).alias("dist_km"), "s_distance", "s_time", "s_trajectory", "s_behaviour", "s_type", "s_quality")


def traffic_funnel(spark, d):
    return S.traffic_funnel(_scored(spark, d))


def confidence_band(spark, d):
    return _scored(spark, d).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def candidates_export(spark, d):
    """The ranking as delimited text, nulls empty."""
    r = vessel_ranking(spark, d)
    return r.select("rank", F.concat_ws(",", F.col("rank").cast("string"), "mmsi", F.when(F.col("relevant"), "yes").otherwise("no"), "band").alias("line"))


_NUM = r"'^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def _n(c):
    return f"CASE WHEN regexp_matches(trim({c}), {_NUM}) THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def _t(c, none=None):
    gone = f" OR upper(trim({c})) IN ({', '.join(repr(x) for x in none)})" if none else ""
    return f"CASE WHEN trim({c}) = ''{gone} THEN NULL ELSE trim({c}) END"


def _case(column, table, other="NULL"):
    return "CASE " + " ".join(f"WHEN {column} BETWEEN {lo} AND {hi} THEN '{k}'" for k, v in table.items() for lo, hi in v) + f" ELSE {other} END"


_GROUP = lambda c: _case(c, codes.GROUPS)
_NAV = lambda c: f"CASE WHEN {c} IS NULL THEN NULL " + " ".join(f"WHEN {c} = {i} THEN '{n}'" for i, n in enumerate(codes.NAV_STATUS)) + f" ELSE 'unrecognised status ' || {c}::STRING END"
_REL = lambda c: "CASE WHEN " + f"{c} IS NULL THEN 0.3 " + " ".join(f"WHEN {_GROUP(c)} = '{k}' THEN {v}" for k, v in codes.RELEVANCE.items()) + " ELSE 0.3 END::DOUBLE"
_PARSED = f"""
parsed0 AS (SELECT pos,
  CASE WHEN regexp_matches(trim(MMSI), '^[0-9]{{9}}$') THEN trim(MMSI) END AS mmsi,
  epoch_us(TRY_CAST(trim(BaseDateTime) AS TIMESTAMP)) AS t_us, round({_n('LON')}, 6) AS lon, round({_n('LAT')}, 6) AS lat,
  CASE WHEN {_n('SOG')} <> 102.3::DOUBLE AND {_n('SOG')} >= 0 THEN round({_n('SOG')}, 1) END AS sog,
  CASE WHEN {_n('COG')} <> 360 AND {_n('COG')} >= 0 AND {_n('COG')} < 360 THEN {_n('COG')} END AS cog,
  CASE WHEN {_n('Heading')} <> 511 AND {_n('Heading')} >= 0 AND {_n('Heading')} < 360 THEN {_n('Heading')} END AS heading,
  trunc({_n('Status')})::INT AS status_code, {_t('VesselName', R.NO_NAME)} AS name,
  CASE WHEN regexp_matches(trim(IMO), '^([Ii][Mm][Oo])?\\s*[1-9][0-9]{{6}}$') THEN 'IMO' || right(trim(IMO), 7) END AS imo,
  {_t('CallSign', R.NO_CALL_SIGN)} AS call_sign, nullif(trunc({_n('VesselType')})::INT, 0) AS type_code, nullif(trunc({_n('Cargo')})::INT, 0) AS cargo_code,
  CASE WHEN {_n('Length')} > 0 THEN {_n('Length')} END AS length_m, CASE WHEN {_n('Width')} > 0 THEN {_n('Width')} END AS width_m, CASE WHEN {_n('Draft')} > 0 THEN {_n('Draft')} END AS draft_m
  FROM raw),
parsed AS (SELECT *, CASE WHEN mmsi IS NULL OR t_us IS NULL OR coalesce(lon NOT BETWEEN -180 AND 180, true) OR coalesce(lat NOT BETWEEN -90 AND 90, true) THEN 'unusable' ELSE 'usable' END AS disposition,
  {_NAV('status_code')} AS nav_status, {_GROUP('type_code')} AS vessel_group FROM parsed0)
"""
_HAV = lambda a, b, c, d: f"2 * 6371.0088::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2))))"
_MOD = lambda x: f"(({x}) - 360 * floor(({x}) / 360))"
_BEAR = lambda a, b, c, d: _MOD(f"degrees(atan2(sin(radians({c} - {a})) * cos(radians({d})), cos(radians({b})) * sin(radians({d})) - sin(radians({b})) * cos(radians({d})) * cos(radians({c} - {a}))))")
_JOINED = f"""
f0 AS (SELECT *, greatest(0.0::DOUBLE, least(48.0::DOUBLE, (t_us - {START_US}) / {STEP_US}::DOUBLE)) AS f FROM reports),
j0 AS (SELECT f0.*, e.*, lon0 + (f - seg) * dlon AS env_lon, lat0 + (f - seg) * dlat AS env_lat, r0 + (f - seg) * dr AS env_r
       FROM f0 JOIN envelope e ON e.seg = least(floor(f), 47)::INT),
j AS (SELECT mmsi, pos, t_us, lon, lat, sog, seg, env_r, {_HAV('lon', 'lat', 'env_lon', 'env_lat')} AS dist,
             t_us BETWEEN {START_US} AND {START_US + STEP_US * STEPS} AS in_window,
             coalesce(lag(lon) OVER w, lon) AS a1, coalesce(lag(lat) OVER w, lat) AS a2, coalesce(lead(lon) OVER w, lon) AS b1, coalesce(lead(lat) OVER w, lat) AS b2
      FROM j0 WINDOW w AS (PARTITION BY mmsi ORDER BY t_us, pos)),
jc AS (SELECT *, {_BEAR('a1', 'a2', 'b1', 'b2')} AS course FROM j),
best AS (SELECT * FROM jc WHERE in_window QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY dist, t_us, pos) = 1),
ap AS (SELECT jc.mmsi, count(*) AS reports, count(*) FILTER (in_window) AS reports_in_window, count(*) FILTER (in_window AND jc.dist <= 3 * jc.env_r) AS reports_relevant,
              count(*) FILTER (in_window AND jc.dist <= jc.env_r) AS crossings,
              (max(jc.t_us) FILTER (in_window AND jc.dist <= 3 * jc.env_r) - min(jc.t_us) FILTER (in_window AND jc.dist <= 3 * jc.env_r)) / 3.6e9::DOUBLE AS hours,
              min(jc.dist) FILTER (NOT in_window) AS nearest_outside_km, median(jc.sog) AS median_sog FROM jc GROUP BY jc.mmsi),
a AS (SELECT ap.*, best.t_us AS at_us, best.dist AS dist_km, best.dist / best.env_r AS radii, best.course, best.sog AS at_sog,
             coalesce(greatest(0.0, least(1.0, (3 - best.dist / best.env_r) / 2)), 0.0) AS proximity FROM ap LEFT JOIN best USING (mmsi)),
low AS (SELECT jc.mmsi, min(jc.sog) AS lowest FROM jc JOIN a ON a.mmsi = jc.mmsi AND abs(jc.t_us - a.at_us) <= 3600000000 GROUP BY jc.mmsi)
"""
_COMPLETE = """
st AS (SELECT *, (t_us - lag(t_us) OVER (PARTITION BY mmsi ORDER BY t_us, pos)) / 1e6::DOUBLE AS dt FROM reports),
cp0 AS (SELECT mmsi, count(*) AS accepted, coalesce(median(dt) FILTER (dt > 0), 0.0) AS usual_s, (max(t_us) - min(t_us)) / 1e6::DOUBLE AS span_s, max(dt) AS longest, count(*) FILTER (sog IS NULL) AS missing FROM st GROUP BY mmsi),
cp AS (SELECT *, CASE WHEN usual_s > 0 AND span_s > 0 THEN floor(span_s / usual_s) + 1 ELSE accepted END::BIGINT AS expected FROM cp0)
"""
_AXIS = _BEAR("-89.6::DOUBLE", "28.3::DOUBLE", "-89.12::DOUBLE", "28.492::DOUBLE")
_SCORED = _JOINED + "," + _COMPLETE + f""",
tc AS (SELECT DISTINCT mmsi, (mmsi::BIGINT % 110)::INT AS type_code FROM reports),
sc0 AS (SELECT a.*, low.lowest, tc.type_code, least(1.0, cp.accepted / cp.expected::DOUBLE) AS report_share, 1.0 - cp.missing / cp.accepted::DOUBLE AS field_share, coalesce(low.lowest, at_sog, median_sog) AS lo
        FROM a LEFT JOIN low USING (mmsi) JOIN tc USING (mmsi) JOIN cp USING (mmsi)),
sc1 AS (SELECT *,
  round(CASE WHEN radii IS NULL THEN 0.0 WHEN radii <= 1 THEN 30.0 WHEN radii >= 3 THEN 0.0 ELSE 30 * (3 - radii) / 2 END::DOUBLE, 1) AS s_distance,
  round(CASE WHEN reports_relevant = 0 THEN 0.0 ELSE 25 * (0.5::DOUBLE + 0.5::DOUBLE * least(1.0, hours / 6)) END::DOUBLE, 1) AS s_time,
  round(CASE WHEN radii IS NULL THEN 0.0 ELSE CASE WHEN crossings > 0 THEN 1.0 ELSE proximity END * (20 * 2 / 3::DOUBLE)
    + coalesce(1 - abs(cos(radians(abs({_MOD(f'course - ({_AXIS}) + 180')} - 180)))), 0.0) * proximity * (20 / 3::DOUBLE) END::DOUBLE, 1) AS s_trajectory,
  round((CASE WHEN at_us IS NULL OR median_sog IS NULL THEN 0.0 WHEN lo <= 1 THEN 1.0 WHEN lo <= 3 THEN 0.7 WHEN median_sog > 0 AND lo < 0.6::DOUBLE * median_sog THEN 0.4 ELSE 0.0 END * 10)::DOUBLE, 1) AS s_behaviour,
  round({_REL('type_code')} * 10, 1) AS s_type,
  round(greatest(0.0, least(5.0, 5 * (0.6::DOUBLE * report_share + 0.4::DOUBLE * field_share))), 1) AS s_quality FROM sc0),
sc AS (SELECT *, round(0.0::DOUBLE + s_distance + s_time + s_trajectory + s_behaviour + s_type + s_quality, 1) AS total, reports_relevant > 0 AS relevant FROM sc1),
scored AS (SELECT *, CASE WHEN total / 100 >= 0.75 THEN 'strong' WHEN total / 100 >= 0.5 THEN 'partial' WHEN total / 100 >= 0.25 THEN 'weak' ELSE 'none' END AS band FROM sc),
ranked AS (SELECT *, row_number() OVER (ORDER BY relevant DESC, total DESC, coalesce(dist_km, 1e9), mmsi)::INT AS rank FROM scored)
"""
_CLEAN = f"""
RECURSIVE c0 AS (SELECT mmsi, pos, CASE WHEN pos % 23 = 0 THEN t_us - t_us % 86400000000 ELSE t_us END AS t_us, CASE WHEN pos % 29 = 0 THEN 999.0::DOUBLE ELSE lon END AS lon, lat FROM reports),
c1 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t_us, pos) AS rn FROM c0),
walk(mmsi, rn, pos, fate, t, x, y) AS (
  SELECT mmsi, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE FROM (SELECT DISTINCT mmsi FROM c1)
  UNION ALL
  SELECT mmsi, rn, pos, fate, CASE WHEN fate = 'accepted' THEN t_us ELSE t END, CASE WHEN fate = 'accepted' THEN lon ELSE x END, CASE WHEN fate = 'accepted' THEN lat ELSE y END FROM (
    SELECT n.*, w.t, w.x, w.y, CASE WHEN n.lon NOT BETWEEN -180 AND 180 OR n.lat NOT BETWEEN -90 AND 90 THEN 'bad_position' WHEN w.t = n.t_us THEN 'duplicate_timestamp'
      WHEN n.t_us > w.t AND {_HAV('w.x', 'w.y', 'n.lon', 'n.lat')} / 1.852 / ((n.t_us - w.t) / 3.6e9::DOUBLE) > 45 THEN 'impossible_speed' ELSE 'accepted' END AS fate
    FROM walk w JOIN c1 n ON n.mmsi = w.mmsi AND n.rn = w.rn + 1))
SELECT mmsi, pos, fate FROM walk WHERE rn > 0
"""
_ORACLES = {
    "ais_parse": f"WITH {_PARSED} SELECT * FROM parsed",
    "ais_funnel": f"WITH {_PARSED}, f AS (SELECT CASE WHEN disposition = 'unusable' THEN 'u' WHEN NOT (lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]}) THEN 'b' WHEN NOT (t_us >= {WINDOW[0]} AND t_us < {WINDOW[1]}) THEN 'w' ELSE 'k' END AS fate FROM parsed) SELECT count(*) AS rows_examined, count(*) FILTER (fate = 'u') AS unusable, count(*) FILTER (fate = 'b') AS outside_bounds, count(*) FILTER (fate = 'w') AS outside_window, count(*) FILTER (fate = 'k') AS kept FROM f",
    "ais_static_first_nonnull": f"WITH {_PARSED} SELECT mmsi, count(*) AS reports, " + ", ".join(f"min_by({c}, pos) FILTER ({c} IS NOT NULL) AS {c}" for c in ["name", "imo", "call_sign", "type_code", "length_m"]) + " FROM parsed WHERE disposition = 'usable' GROUP BY mmsi HAVING count(*) >= 2",
    "ais_clean_fold": f"WITH {_CLEAN}",
    "ais_gaps": f"WITH {_COMPLETE} SELECT mmsi, before AS from_us, t_us AS to_us, round(dt / 60, 4) AS minutes, round(usual_s, 4) AS usual_s FROM (SELECT st.*, t_us - (dt * 1e6)::BIGINT AS before, usual_s FROM st JOIN (SELECT mmsi, median(dt) AS usual_s FROM st WHERE dt > 0 GROUP BY mmsi) USING (mmsi)) WHERE dt > 1.5 * usual_s",
    "ais_completeness": f"WITH {_COMPLETE} SELECT mmsi, accepted, round(usual_s, 1) AS usual_s, expected, round(CASE WHEN usual_s > 0 AND longest > 1.5 * usual_s THEN longest / 60 ELSE 0.0 END, 1) AS largest_gap_min, missing, round(least(1.0, accepted / expected::DOUBLE), 6) AS report_share, round(1.0 - missing / accepted::DOUBLE, 6) AS field_share FROM cp",
    "ais_summary": "SELECT mmsi, count(*) AS n, min(sog) AS min_sog, max(sog) AS max_sog, round(median(sog), 6) AS median_sog, min(t_us) AS first_us, max(t_us) AS last_us FROM reports GROUP BY mmsi",
    "course_lag_lead": f"WITH {_JOINED} SELECT mmsi, pos, round(course, 5) AS course FROM jc",
    "vessel_group_map": f"WITH c AS (SELECT (event_id % 130 - 5)::INT AS code, count(*) AS n FROM events GROUP BY 1) SELECT code, {_GROUP('code')} AS grp, {_REL('code')} AS relevance, n FROM c",
    "nav_status_map": f"WITH c AS (SELECT (event_id % 20)::INT AS code, count(*) AS n FROM events GROUP BY 1) SELECT code, {_NAV('code')} AS status, n FROM c",
    "region_label": f"WITH p AS (SELECT o_orderkey, ((o_orderkey * 7919) % 3700) / 10.0::DOUBLE - 185 AS lon, ((o_orderkey * 104729) % 1820) / 10.0::DOUBLE - 91 AS lat FROM orders) SELECT o_orderkey, {regions.cases()} AS label FROM p",
    "haversine": f"SELECT pos, round({_HAV('lon', 'lat', '-89.5::DOUBLE', '28.4::DOUBLE')}, 6) AS km FROM reports",
    "bearing": f"SELECT pos, round({_BEAR('-89.5::DOUBLE', '28.4::DOUBLE', 'lon', 'lat')}, 5) AS deg FROM reports",
    "envelope_join": f"WITH {_JOINED} SELECT mmsi, pos, seg, round(dist, 5) AS dist, round(env_r, 5) AS env_r, in_window FROM j",
    "closest_approach": f"WITH {_JOINED} SELECT mmsi, reports, reports_in_window, reports_relevant, crossings, round(hours, 5) AS hours, round(dist_km, 4) AS dist_km, round(radii, 4) AS radii, at_us, round(nearest_outside_km, 4) AS nearest_outside_km FROM a",
    "min_sog_range_1h": f"WITH {_JOINED} SELECT mmsi, lowest FROM low",
    **{f"score_{k}": f"WITH {_SCORED} SELECT mmsi, s_{k} FROM scored" for k in S.WEIGHTS},
    "vessel_ranking": f"WITH {_SCORED} SELECT rank, mmsi, total, relevant, band, round(dist_km, 3) AS dist_km, s_distance, s_time, s_trajectory, s_behaviour, s_type, s_quality FROM ranked",
    "traffic_funnel": f"WITH {_SCORED} SELECT count(*) AS seen, count(*) FILTER (relevant) AS relevant, count(*) FILTER (reports_in_window = 0) AS outside_window, count(*) FILTER (NOT relevant AND reports_in_window > 0) AS too_far FROM scored",
    "confidence_band": f"WITH {_SCORED} SELECT band, count(*) AS n FROM scored GROUP BY band",
    "candidates_export": f"WITH {_SCORED} SELECT rank, rank::STRING || ',' || mmsi || ',' || CASE WHEN relevant THEN 'yes' ELSE 'no' END || ',' || band AS line FROM ranked",
}
ORACLE_SQL = {k: with_views(s, "duckdb") for k, s in _ORACLES.items()}
QUERIES = {k: globals()[k] for k in _ORACLES if not k.startswith("score_")} | {f"score_{k}": _component(k) for k in S.WEIGHTS}
