"""Registered queries of case documents, listings and exports, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes
from ..operators import cases as K
from ..operators import geometry as H
from ..operators import reports as R_
from ..operators import shortlist as S
from .bridge import START_US, STEP_US, STEPS, bridge, with_views
from .registry import Registry
from .vessel_queries import _CLEAN, _GROUP, _PARSED, _SCORED, _scored

R = Registry()
query = R.query


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _o(spark, d):
    return _t(spark, d, "orders")


@query("""SELECT o_orderkey, array_to_string(list_filter(['scene-' || o_orderkey::STRING, CASE WHEN o_orderkey % 2 = 0 THEN 'model' ELSE 'baseline' END, (o_custkey % 5 * 100)::STRING, '7', CASE WHEN o_orderkey % 3 = 0 THEN 'h' || CASE WHEN o_orderkey % 2 = 0 THEN '24' ELSE '12.5' END END,
CASE WHEN o_orderkey % 4 = 0 THEN 'sfile.v' || (o_custkey % 9)::STRING END, CASE WHEN o_orderkey % 5 = 0 THEN 't2018-08-03' END, CASE WHEN o_orderkey % 7 = 0 THEN 'bvv,vh' END], lambda x: x IS NOT NULL), ':') AS key FROM orders""")
def case_key(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    key = K.case_key(
        F.concat(F.lit("scene-"), k.cast("string")), F.when(k % 2 == 0, "model").otherwise("baseline"), c % 5 * 100, F.lit(7), F.when(k % 3 == 0, F.when(k % 2 == 0, 24.0).otherwise(12.5)),
        {"s": F.when(k % 4 == 0, F.concat(F.lit("/data/in/file.v"), (c % 9).cast("string"), F.lit(".tif")))}, F.when(k % 5 == 0, "2018-08-03"), F.when(k % 7 == 0, "vv,vh"),
    )
    return _o(spark, d).select("o_orderkey", key.alias("key"))


@query("SELECT doc_id, source || '-' || substr(sha256(text), 1, 16) AS id FROM documents")
def content_ids(spark, d):
    return _t(spark, d, "documents").select("doc_id", K.content_id(F.col("text").cast("binary"), F.col("source")).alias("id"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark, d):
    return _t(spark, d, "part").select("p_partkey", K.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


_PATH = "CASE o_orderkey % 4 WHEN 0 THEN 'set/S1_' || {k} || '.TIF' WHEN 1 THEN 'S1_' || {k} WHEN 2 THEN '/a/b.c/.hidden' ELSE 'x/patch.v2.' || {k} || '.jpg' END"


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'set' WHEN 2 THEN 'b.c' WHEN 3 THEN 'x' END AS folder, CASE o_orderkey % 4 WHEN 0 THEN 'S1_' || k WHEN 1 THEN 'S1_' || k WHEN 2 THEN '.hidden' ELSE 'patch.v2.' || k END AS stem, CASE o_orderkey % 4 WHEN 0 THEN '.tif' WHEN 3 THEN '.jpg' END AS suffix FROM (SELECT o_orderkey, o_orderkey::STRING AS k FROM orders)")
def name_parts(spark, d):
    return _o(spark, d).select("o_orderkey", K.name_parts(F.expr(_PATH.format(k="CAST(o_orderkey AS STRING)"))).alias("p")).select("o_orderkey", "p.*")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'unknown' ELSE printf('%.3f ', round(abs(lat), 3)) || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || ', ' || printf('%.3f ', round(abs(lon), 3)) || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END END AS place FROM (SELECT o_orderkey, (o_orderkey * 31 % 18000) / 100.0::DOUBLE - 90 AS lat, (o_orderkey * 7 % 36000) / 100.0::DOUBLE - 180 AS lon FROM orders)")
def coordinate_text(spark, d):
    k = F.col("o_orderkey")
    return _o(spark, d).select("o_orderkey", K.coordinates(F.when(k % 13 != 0, k * 31 % 18000 / F.lit(100.0) - 90), k * 7 % 36000 / F.lit(100.0) - 180).alias("place"))


@query("SELECT k, array_to_string(CASE WHEN n <= 8 THEN l ELSE list_concat(list_concat(l[1:4], ['... ' || (n - 8)::STRING || ' more ...']), l[n - 3:n]) END, ',') AS items FROM (SELECT o_custkey AS k, list(o_orderkey::STRING ORDER BY o_orderkey) AS l, count(*) AS n FROM orders GROUP BY o_custkey)")
def abridged_list(spark, d):
    l = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    return _o(spark, d).groupBy(F.col("o_custkey").alias("k")).agg(l.alias("l")).select("k", F.array_join(K.abridged(F.col("l")), ",").alias("items"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '-1') AS k, 'none' AS missing FROM events")
def nested_default(spark, d):
    return _t(spark, d, "events").select("event_id", K.nested(F.col("props"), "$.k", "-1").alias("k"), K.nested(F.col("props"), "$.a.b", "none").alias("missing"))


@query("SELECT c_custkey, lower(c_name) IN ('customer#000000007') OR lower(c_mktsegment) LIKE '%ing' AS ok FROM customer")
def allow_list(spark, d):
    # the segment stands for a domain here: an entry of a domain allows every address that ends so
    c = _t(spark, d, "customer")
    return c.select("c_custkey", (K.allowed(F.col("c_name"), ["Customer#000000007"]) | K.allowed(F.regexp_replace(F.lower("c_mktsegment"), "ing$", "@ing"), ["@ING"])).alias("ok"))


@query("""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source END AS group_key, CASE WHEN doc_id % 3 = 1 THEN lang END AS groupKey FROM documents WHERE doc_id % 5 > 0)
SELECT l.doc_id, coalesce(m.group_key, m.groupKey, 'header-' || l.doc_id::STRING) AS grp FROM labels l LEFT JOIN m USING (doc_id)""")
def fallback_key(spark, d):
    i = F.col("doc_id")
    m = _t(spark, d, "documents").filter(i % 5 > 0).select("doc_id", F.when(i % 3 == 0, F.col("source")).alias("group_key"), F.when(i % 3 == 1, F.col("lang")).alias("groupKey2"))
    return K.with_fallback(_t(spark, d, "labels").select("doc_id"), m, "doc_id", ["group_key", "groupKey2"], "grp", F.concat(F.lit("header-"), i.cast("string")))


@query("SELECT s.scene, s.scene IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS has_previews, s.scene IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS has_stored FROM scenes s")
def case_listing(spark, d):
    return K.listing(bridge(spark, d, "scenes").select("scene"), "scene", previews=_t(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("scene")), stored=_o(spark, d).filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("scene")))


_IOU = "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey * 37 % 1000) / 1000.0::DOUBLE END"


def _listed(spark, d):
    k = F.col("o_orderkey")
    s = _o(spark, d).select(k.alias("scene"), F.when(k % 6 != 0, k * 37 % 1000 / F.lit(1000.0)).alias("iou"), (k % 5 == 0).alias("test"))
    return K.listing(s, "scene", stored=_o(spark, d).filter("o_orderstatus = 'F'").select(k.alias("scene")))


@query(f"SELECT o_orderkey AS scene, iou, stored AS has_stored, row_number() OVER (ORDER BY coalesce(iou, 0) DESC, o_orderkey)::INT AS place FROM (SELECT o_orderkey, {_IOU} AS iou, o_orderstatus = 'F' AS stored FROM orders WHERE o_orderkey % 5 = 0)")
def scene_listing(spark, d):
    from pyspark.sql import Window

    w = Window.orderBy(F.coalesce("iou", F.lit(0.0)).desc(), "scene")  # one row a scene of the test split
    return _listed(spark, d).filter("test").withColumn("place", F.row_number().over(w)).select("scene", "iou", "has_stored", "place")


@query(f"SELECT o_orderkey AS scene FROM orders ORDER BY (o_orderkey % 5 = 0 AND o_orderstatus = 'F') DESC, (o_orderstatus = 'F') DESC, coalesce({_IOU}, -1) DESC, o_orderkey LIMIT 1")
def demo_pick(spark, d):
    return K.picked(_listed(spark, d), "scene", F.col("test") & F.col("has_stored"), F.col("has_stored"), F.col("iou"))


_REGIONS = "SELECT l_orderkey AS cas, l_linenumber AS region, l_quantity AS area, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE CASE WHEN l_linestatus = 'O' THEN 'uncertain' END END AS verdict FROM lineitem"


def _regions(spark, d):
    v = F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_linestatus") == "O", "uncertain")
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("cas"), F.col("l_linenumber").alias("region"), F.col("l_quantity").alias("area"), v.alias("verdict"))


@query(f"WITH g AS ({_REGIONS}) SELECT cas, region, verdict, row_number() OVER (PARTITION BY cas ORDER BY CASE verdict WHEN 'rejected' THEN 0 WHEN 'uncertain' THEN 1 WHEN 'accepted' THEN 3 ELSE 2 END, area DESC, region)::INT AS place FROM g QUALIFY place <= 3")
def verdict_order(spark, d):
    return K.by_verdict(_regions(spark, d), "cas", 3).select("cas", "region", "verdict", "place")


@query(f"WITH g AS ({_REGIONS}) SELECT cas, count(*) AS regions, count(*) FILTER (verdict = 'accepted') AS accepted, count(*) FILTER (verdict = 'uncertain') AS uncertain, count(*) FILTER (verdict = 'rejected') AS rejected, count(*) FILTER (verdict IS NULL) AS unscreened FROM g GROUP BY cas")
def component_tally(spark, d):
    return K.component_tally(_regions(spark, d), "cas")


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS vals FROM lineitem GROUP BY l_orderkey")
def distinct_per_group(spark, d):
    return K.distinct_values(_t(spark, d, "lineitem"), "l_orderkey", "l_returnflag").select("l_orderkey", F.array_join("values", ",").alias("vals"))


@query("""WITH a AS (SELECT o_orderpriority AS k, avg(o_totalprice) AS patch FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1), b AS (SELECT o_orderpriority AS k, avg(o_totalprice) AS scene FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' GROUP BY 1)
SELECT k, round(patch, 4) AS patch, round(scene, 4) AS scene, CASE WHEN patch IS NULL THEN 'no patch' WHEN scene IS NULL THEN 'no scene' ELSE 'both' END AS basis, round(scene - patch, 4) AS difference FROM a FULL JOIN b USING (k)""")
def metric_documents(spark, d):
    o = _o(spark, d).select(F.col("o_orderpriority").alias("k"), "o_totalprice", "o_orderstatus")
    m = lambda df: df.groupBy("k").agg(F.avg("o_totalprice").alias("value"))
    out = K.side_by_side(m(o.filter("k <> '5-LOW'")), m(o.filter("o_orderstatus = 'F' and k <> '1-URGENT'")), "k", ("patch", "scene"))
    return out.withColumns({c: F.round(c, 4) for c in ("patch", "scene", "difference")})


@query("SELECT o_orderkey, slot, coalesce(f, 'supplied') AS file, CASE WHEN f IS NULL THEN 'dataset' ELSE 'operator' END AS origin FROM (SELECT o_orderkey, unnest(['scene', 'wind', 'ais']) AS slot, unnest([CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END, NULL]) AS f FROM orders)")
def provenance_rows(spark, d):
    k = F.col("o_orderkey")
    c = _o(spark, d).select("o_orderkey", F.when(k % 2 == 0, F.col("o_orderpriority")).alias("scene"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("wind"), F.lit(None).cast("string").alias("ais"))
    return K.provenance(c, "o_orderkey", ["scene", "wind", "ais"], "supplied")


@query("SELECT o_orderkey, 'ranks, does not accuse|' || CASE WHEN o_orderstatus = 'F' THEN 'winds from a product' ELSE 'winds are synthetic' END AS limits FROM orders")
def limits_list(spark, d):
    l = K.limits([(None, "ranks, does not accuse", ""), (F.col("o_orderstatus") == "F", "winds are synthetic", "winds from a product")])
    return _o(spark, d).select("o_orderkey", F.array_join(l, "|").alias("limits"))


@query("SELECT user_id, stage, seconds FROM (SELECT user_id, event_type AS stage, (lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts)) / 1e6::DOUBLE AS seconds FROM events) WHERE seconds IS NOT NULL")
def stage_timings(spark, d):
    e = _t(spark, d, "events").select("user_id", F.col("event_type").alias("stage"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), F.col("event_id").alias("pos"))
    return K.stage_times(e, "user_id")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice * 2 END AS value FROM orders")
def map_lookup(spark, d):
    k = F.col("o_orderkey")
    m = _o(spark, d).select("o_orderkey", F.create_map(F.lit("0.3"), F.col("o_totalprice"), F.lit("0.5"), F.col("o_totalprice") * 2).alias("m"), F.when(k % 3 == 0, "0.3").when(k % 3 == 1, "0.5").otherwise("0.7").alias("want"))
    return K.map_entry(m, "o_orderkey", "m", F.col("want"))


@query("SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS text_bytes FROM conversations GROUP BY conv_id")
def lean_projection(spark, d):
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_join(F.collect_list("text"), "").alias("text"))
    return K.lean(c.select("conv_id", "turns", F.struct("text").alias("body"), "text"), ["body"]).select("conv_id", "turns", F.length("text").cast("long").alias("text_bytes"))


# exports of the shortlist
_CELL = lambda c: f"CASE WHEN regexp_matches(coalesce(({c})::STRING, ''), '[,\"\\n]') THEN '\"' || replace(({c})::STRING, '\"', '\"\"') || '\"' ELSE coalesce(({c})::STRING, '') END"
_REASON = """CASE WHEN reports_relevant > 0 THEN reports_relevant::STRING || ' of ' || reports::STRING || ' reports in the release window and within 3 radii'
WHEN reports_in_window = 0 AND nearest_outside_km IS NOT NULL THEN 'no report in the release window; nearest outside it ' || printf('%.2f km', round(nearest_outside_km, 2)) WHEN reports_in_window = 0 THEN 'no report in the release window'
ELSE reports_in_window::STRING || ' reports in the release window, the closest ' || printf('%.2f km', round(dist_km, 2)) || printf(' away (%.1f radii)', round(radii, 1)) END"""
_NAME = "CASE WHEN mmsi::BIGINT % 3 = 0 THEN 'SEA \"' || mmsi || '\", ' || 'II' ELSE 'MV ' || mmsi END"
_PTS = lambda c: f"printf('%.1f', {c})"
_COLUMNS = [
    ("rank", "rank"), ("name", _NAME), ("mmsi", "mmsi"), ("vessel_type", _GROUP("type_code")), ("total_score", _PTS("total")), ("score_max", "100"),
    *[(n, _PTS(f"s_{k}")) for n, k in (("distance", "distance"), ("time", "time"), ("trajectory", "trajectory"), ("behaviour", "behaviour"), ("type", "type"), ("data_quality", "quality"))],
    ("closest_approach_km", "CASE WHEN dist_km IS NOT NULL THEN printf('%.3f', round(dist_km, 3)) END"), ("closest_approach_utc", "strftime(make_timestamp(at_us), '%Y-%m-%dT%H:%M:%SZ')"), ("reports_in_window", "reports_in_window"), ("reports_near_envelope", "reports_relevant"),
    ("relevant_traffic", "CASE WHEN relevant THEN 'yes' ELSE 'no' END"), ("relevance_reason", _REASON), ("status", "band"), ("ais_mode", "'test'"),
]


def _ranked(spark, d):
    r = S.rank(_scored(spark, d))
    return r.withColumn("name", F.when(F.col("mmsi").cast("long") % 3 == 0, F.concat(F.lit('SEA "'), "mmsi", F.lit('", II'))).otherwise(F.concat(F.lit("MV "), "mmsi"))).withColumn("reason", S.reason(r))


def _row(r):
    p = lambda c: F.format_string("%.1f", F.col(c))
    utc = F.date_format(F.timestamp_micros("at_us"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    km = F.when(F.col("dist_km").isNotNull(), F.format_string("%.3f", F.round("dist_km", 3)))
    return K.line(F.col("rank"), F.col("name"), F.col("mmsi"), codes.vessel_group(F.col("type_code")), p("total"), F.lit(100), *[p(f"s_{k}") for k in S.WEIGHTS], km, utc, F.col("reports_in_window"), F.col("reports_relevant"), F.when(F.col("relevant"), "yes").otherwise("no"), F.col("reason"), F.col("band"), F.lit("test"))


@query(f"WITH {_SCORED} SELECT rank, {' || chr(44) || '.join(_CELL(c) for _, c in _COLUMNS)} AS line FROM ranked")
def candidates_csv(spark, d):
    """All 20 columns of the shortlist as quoted lines."""
    r = _ranked(spark, d)
    return r.select("rank", _row(r).alias("line"))


@query(f"WITH {_SCORED} SELECT mmsi, relevant, {_REASON} AS reason FROM ranked")
def relevance_reasons(spark, d):
    return _ranked(spark, d).select("mmsi", "relevant", "reason")


@query(f"""WITH {_SCORED}, x AS (SELECT *, coalesce(lowest, at_sog, median_sog) AS low FROM ranked)
SELECT mmsi, concat_ws('|', 'distance ' || printf('%.1f/30 ', s_distance) || CASE WHEN radii IS NULL THEN 'no report in the window' ELSE printf('%.2f km', round(dist_km, 2)) || printf(', %.1f radii', round(radii, 1)) END,
'time ' || printf('%.1f/25 ', s_time) || CASE WHEN reports_relevant = 0 THEN 'never near in the window' ELSE printf('near for %.1f h', round(hours, 1)) END,
'trajectory ' || printf('%.1f/20 ', s_trajectory) || CASE WHEN crossings > 0 THEN crossings::STRING || ' reports inside the envelope' ELSE 'no report inside the envelope' END,
'behaviour ' || printf('%.1f/10 ', s_behaviour) || CASE WHEN low IS NULL THEN 'speed unknown' ELSE printf('slowest %.1f kn near the approach', round(low, 1)) END,
'type ' || printf('%.1f/10 ', s_type) || coalesce({_GROUP('type_code')}, 'type not known'),
'quality ' || printf('%.1f/5 ', s_quality) || printf('%d %% of expected reports', round(100 * report_share)::INT)) AS lines FROM x""")
def explanations(spark, d):
    r = _ranked(spark, d)
    return r.select("mmsi", F.array_join(S.explanation(r), "|").alias("lines"))


@query("""SELECT mmsi, md5('{"type":"Feature","geometry":{"type":"LineString","coordinates":[' || string_agg('[' || (round(lon * 10000)::BIGINT)::STRING || ',' || (round(lat * 10000)::BIGINT)::STRING || ']', ',' ORDER BY t_us, pos) || ']},"properties":{"mmsi":"' || mmsi || '","reports":' || count(*)::STRING || ',"note":null}}') AS feature FROM reports GROUP BY mmsi""")
def track_features(spark, d):
    """Tracks as GeoJSON line strings, here in ten-thousandths of a degree, which every engine writes alike."""
    whole = lambda c: F.round(F.col(c) * 10000).cast("long").alias(c)
    line = H.polylines(bridge(spark, d, "reports").select("mmsi", "t_us", "pos", whole("lon"), whole("lat")), "mmsi", ["t_us", "pos"])
    return line.select("mmsi", F.md5(K.feature("LineString", F.col("line"), mmsi=F.col("mmsi"), reports=F.size("line"), note=F.lit(None).cast("string"))).alias("feature"))


@query("""SELECT scene, '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[' || w || ',' || s || '],[' || e || ',' || s || '],[' || e || ',' || n || '],[' || w || ',' || n || '],[' || w || ',' || s || ']]]},"properties":{"status":"' || status || '"}}' AS feature
FROM (SELECT scene, status, round(west * 100)::BIGINT::STRING AS w, round(east * 100)::BIGINT::STRING AS e, round(south * 100)::BIGINT::STRING AS s, round(north * 100)::BIGINT::STRING AS n FROM scenes)""")
def footprint_features(spark, d):
    x = {c: F.round(F.col(c) * 100).cast("long") for c in ("west", "east", "south", "north")}
    p = lambda a, b: F.array(x[a], x[b])
    ring = F.array(F.array(p("west", "south"), p("east", "south"), p("east", "north"), p("west", "north"), p("west", "south")))
    return bridge(spark, d, "scenes").select("scene", K.feature("Polygon", ring, status=F.col("status")).alias("feature"))


_END = START_US + STEP_US * STEPS


@query(f"""WITH {_PARSED}, w0 AS (SELECT *, count(*) OVER (PARTITION BY mmsi) AS read FROM parsed WHERE disposition = 'usable' AND t_us >= {START_US - 20 * 86_400_000_000} AND t_us < {_END + 20 * 86_400_000_000} AND lon BETWEEN -150 AND 150 AND lat BETWEEN -10 AND 80),
{_CLEAN.split('SELECT mmsi, pos, fate FROM walk')[0].replace('RECURSIVE c0 AS (SELECT mmsi, pos, CASE WHEN pos % 23 = 0 THEN t_us - t_us % 86400000000 ELSE t_us END AS t_us, CASE WHEN pos % 29 = 0 THEN 999.0::DOUBLE ELSE lon END AS lon, lat FROM reports)', 'c0 AS (SELECT mmsi, pos, t_us, lon, lat FROM w0 WHERE read >= 2)')},
k AS (SELECT w0.*, count(*) OVER (PARTITION BY w0.mmsi) AS n FROM w0 JOIN walk ON walk.pos = w0.pos AND walk.rn > 0 AND walk.fate = 'accepted')
SELECT mmsi, count(*) AS kept, any_value(read) AS read, min(t_us) AS first_us, max(t_us) AS last_us, round(min(sog), 2) AS min_sog, round(median(sog), 2) AS median_sog, round(max(sog), 2) AS max_sog FROM k WHERE n >= 2 GROUP BY mmsi""".replace("WITH \n", "WITH RECURSIVE \n", 1))
def feed_loader(spark, d):
    """Parse, padded window, box, cleaning and both minimum counts."""
    parsed = R_.parse(bridge(spark, d, "raw")).select("mmsi", "pos", "t_us", "lon", "lat", "sog", "disposition")
    fed = S.feed(parsed, START_US, _END, (-150.0, -10.0, 150.0, 80.0), 20 * 86_400_000_000)
    return S.feed_counts(fed)


@query(f"WITH {_SCORED} SELECT sc0.mmsi, round(greatest(0.0, least(5.0, 5 * (0.6::DOUBLE * report_share + 0.4::DOUBLE * field_share) * greatest(0.5::DOUBLE, 1 - 0.05::DOUBLE * (sc0.mmsi::BIGINT % 14)))), 1) AS s_quality FROM sc0")
def quality_after_rejects(spark, d):
    from .vessel_queries import _joined, _static

    st = _static(spark, d)
    rejected = st.select("mmsi", (F.col("mmsi").cast("long") % 14).alias("rejected"))
    return S.score(_joined(spark, d), st, S.drift_axis(-89.6, 28.3, -89.12, 28.492), rejected).select("mmsi", "s_quality")


ORACLE_SQL = {k: with_views(s, "duckdb") for k, s in R.oracles.items()}
QUERIES = R.queries
