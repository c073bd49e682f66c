"""Deterministic views of the test tables in the shapes that the operators take.

The SQL texts avoid whatever differs between engines, so queries and oracles see the
same rows: integers become text, doubles never do, and every literal is a DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

START_US, STEP_US, STEPS = 1_705_276_800_000_000, 1_800_000_000, 48  # 2024-01-15, half hours
REPORTS = """
SELECT CAST(999000000 + user_id AS STRING) AS mmsi, event_id AS pos, {us}(ts) AS t_us,
       -90 + (user_id % 40) * 0.05E0 + ((event_id * 7919) % 1000) / 2000E0 AS lon,
       28 + (user_id % 25) * 0.04E0 + ((event_id * 104729) % 1000) / 2500E0 AS lat,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE value / 20E0 END AS sog
FROM {events}
"""
RAW = """
SELECT event_id AS pos,
  CASE WHEN event_id % 41 = 0 THEN '12345' WHEN event_id % 43 = 0 THEN '' ELSE CAST(999000000 + user_id AS STRING) END AS MMSI,
  CASE WHEN event_id % 47 = 0 THEN 'not a time' ELSE '2024-01-' || lpad(CAST(1 + event_id % 28 AS STRING), 2, '0') || 'T' || lpad(CAST(event_id % 24 AS STRING), 2, '0') || ':' || lpad(CAST((event_id * 7) % 60 AS STRING), 2, '0') || ':00' END AS BaseDateTime,
  CAST(event_id % 120 - 15 AS STRING) || '.' || CAST(event_id % 10 AS STRING) AS LAT,
  CAST((event_id * 13) % 380 - 190 AS STRING) || '.5' AS LON,
  CASE WHEN event_id % 11 = 0 THEN '102.3' WHEN event_id % 13 = 0 THEN '-1.0' WHEN event_id % 19 = 0 THEN 'abc' ELSE CAST(event_id % 30 AS STRING) || '.' || CAST(event_id % 10 AS STRING) END AS SOG,
  CASE WHEN event_id % 5 = 0 THEN '360.0' ELSE CAST(event_id % 400 AS STRING) || '.0' END AS COG,
  CASE WHEN event_id % 3 = 0 THEN '511.0' ELSE CAST(event_id % 360 AS STRING) || '.0' END AS Heading,
  CASE WHEN event_id % 7 = 0 THEN 'na' WHEN event_id % 8 = 0 THEN '' ELSE ' SHIP ' || CAST(user_id AS STRING) || ' ' END AS VesselName,
  CASE WHEN event_id % 6 = 0 THEN 'IMO0000000' WHEN event_id % 9 = 0 THEN '' ELSE 'imo ' || CAST(9000000 + user_id AS STRING) END AS IMO,
  CASE WHEN event_id % 10 = 0 THEN 'NO COMM' ELSE 'W' || CAST(user_id AS STRING) END AS CallSign,
  CASE WHEN event_id % 12 = 0 THEN '' ELSE CAST(event_id % 110 AS STRING) END AS VesselType,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(event_id % 18 AS STRING) END AS Status,
  CAST(event_id % 50 AS STRING) AS Length, CAST(event_id % 9 AS STRING) AS Width,
  CAST(event_id % 6 AS STRING) || '.5' AS Draft, CAST(event_id % 100 AS STRING) AS Cargo,
  CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS TransceiverClass
FROM {events}
"""
ENVELOPE = "SELECT CAST(i AS INT) AS seg, -89.6E0 + 0.01E0 * i AS lon0, 28.3E0 + 0.004E0 * i AS lat0, 11.3E0 - 0.23E0 * i AS r0, 0.01E0 AS dlon, 0.004E0 AS dlat, -0.23E0 AS dr FROM {range}"
RASTER = "SELECT p_brand AS scene, p_partkey, CAST(floor(p_partkey / 50E0) AS INT) AS row_i, CAST(p_partkey % 50 AS INT) AS col_i, p_retailprice AS value, p_size <= 15 AS oil, p_size = 50 AS invalid FROM {part}"
SCORES = "SELECT d.doc_id, d.source AS grp, d.lang AS stratum, CAST(l.quality AS INT) AS y, CAST(l.toxic AS INT) AS y2, (d.doc_id * 7919 % 1000) / 1000E0 AS score FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"
FEATURES = "SELECT vec_id, CAST(label % 2 AS INT) AS y, label AS grp, {at} FROM {embeddings} WHERE label IS NOT NULL"
NAMES = ["darkness", "darkness_p10", "texture", "edge", "compactness", "solidity", "elongation"]
AT = {"spark": ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS {n}" for i, n in enumerate(NAMES)), "duckdb": ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(NAMES))}
FIELD = """
SELECT CAST(l_linenumber AS INT) AS step, CAST(l_suppkey % 9 AS INT) AS gj, CAST(l_partkey % 11 AS INT) AS gi, 27 + (l_suppkey % 9) * 0.5E0 AS lat, -92 + (l_partkey % 11) * 0.5E0 AS lon,
  CASE WHEN ((l_suppkey % 9) * (l_partkey % 11) + l_linenumber) % 13 = 7 THEN NULL ELSE max(l_discount) * 10E0 - 0.5E0 END AS u,
  CASE WHEN ((l_suppkey % 9) * (l_partkey % 11) + l_linenumber) % 13 = 7 THEN NULL ELSE 0.4E0 - max(l_tax) * 5E0 END AS v
FROM {lineitem} GROUP BY l_linenumber, l_suppkey % 9, l_partkey % 11
"""
AXIS = "SELECT DISTINCT CAST(l_linenumber AS INT) AS step, 1705276800000000 + CAST(l_linenumber AS BIGINT) * l_linenumber * 10800000000 AS at_us FROM {lineitem}"
SCENES = """
SELECT o_orderkey AS scene, o_custkey AS parent, o_orderstatus AS status, -92.5E0 + (o_orderkey % 61) * 0.1E0 AS west, -92.5E0 + (o_orderkey % 61) * 0.1E0 + (o_orderkey % 7) * 0.1E0 + 0.2E0 AS east,
  26.5E0 + (o_orderkey % 47) * 0.1E0 AS south, 26.5E0 + (o_orderkey % 47) * 0.1E0 + (o_orderkey % 5) * 0.1E0 + 0.1E0 AS north,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 1705276800000000 + (o_orderkey % 400) * 3600000000 END AS t_us
FROM {orders}
"""
PIXELS = """
SELECT o_orderkey % 40 AS scene, CAST(o_orderkey // 40 // 24 AS INT) AS row_i, CAST(o_orderkey // 40 % 24 AS INT) AS col_i, o_totalprice / 1000E0 AS vv, CASE WHEN o_custkey % 31 = 0 THEN 0E0 ELSE o_custkey % 97 * 1E0 END AS vh,
  o_orderkey * 7919 % 100 < 20 AS oil
FROM {orders}
"""
PARTICLES = "SELECT CAST(l_linenumber AS INT) AS step, l_orderkey AS pid, -90 + (l_partkey % 1000) / 5000E0 + l_linenumber * 0.01E0 AS lon, 28 + (l_suppkey % 100) / 500E0 AS lat, CASE l_returnflag WHEN 'A' THEN 'active' WHEN 'N' THEN 'beached' ELSE 'exited' END AS state FROM {lineitem}"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(dialect: str) -> dict[str, str]:
    """The bridge views as SQL over the test tables."""
    us = "epoch_us" if dialect == "duckdb" else "unix_micros_of"
    names = {t: t for t in TABLES}
    reports = REPORTS.format(us=us, **names).replace("unix_micros_of(ts)", "unix_micros(CAST(ts AS TIMESTAMP))")
    span = "range(48) r(i)" if dialect == "duckdb" else "(SELECT id AS i FROM range(48))"
    return {
        "reports": reports, "raw": RAW.format(**names), "envelope": ENVELOPE.format(range=span), "raster": RASTER.format(**names),
        "scores": SCORES.format(**names), "features": FEATURES.format(at=AT[dialect], **names),
        "field": FIELD.format(**names), "axis": AXIS.format(**names), "particles": PARTICLES.format(**names), "scenes": SCENES.format(**names), "pixels": PIXELS.format(**names).replace("//", "div" if dialect == "spark" else "//"),
    }


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run dialect-neutral SQL over the test tables of a folder and the bridge views, without touching the catalog."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in _words(sql)}
    return _run(spark, sql, frames)


def bridge(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, sf_dir, views("spark")[name])


def _words(sql: str) -> set[str]:
    return set("".join(c if c.isalnum() or c == "_" else " " for c in sql).split())


def _run(spark: SparkSession, sql: str, frames: dict) -> DataFrame:
    import re

    for t in frames:
        sql = re.sub(rf"(?<![\w.]){t}(?![\w.(])", "{" + t + "}", sql) if t in sql else sql
    return spark.sql(sql, **frames)


def with_views(sql: str, dialect: str) -> str:
    """Put the bridge views that a query names before it, as common table expressions."""
    used = [n for n in views(dialect) if n in _words(sql)]
    ctes = [f"{n} AS ({views(dialect)[n]})" for n in used]
    body = sql.strip()
    if not ctes:
        return body
    if body[:4].upper() == "WITH":
        recursive = body[4:].lstrip()[:9].upper() == "RECURSIVE"
        rest = body[4:].lstrip()[9 if recursive else 0 :]
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(ctes) + ", " + rest
    return "WITH " + ", ".join(ctes) + " " + body
