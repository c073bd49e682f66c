"""Parsing, cleaning and profiling of vessel reports on literal rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wakeline.functions import codes
from wakeline.operators import reports as R
from wakeline.operators import shortlist
from wakeline.sources import ais_csv

ROWS = [
    "367777550,2022-06-01T00:00:02,28.10198,-96.93931,0.0,360.0,511.0,HARRY LEE,,WDJ4420,52,0,0,0,0.0,52,A",
    "367544180,2022-06-01T00:00:07,46.16795,-123.91430,0.0,342.5,511.0,JEANNE ARAIN,,WDG5186,30,15,18,,,30,A",
]


@pytest.fixture
def extract(tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("\n".join([",".join(R.RAW_COLUMNS), *ROWS]) + "\n")
    return str(p)


def test_parse_turns_sentinels_into_nulls(spark, extract):
    a, b = R.parse(ais_csv.read(spark, extract)).orderBy("t_us").collect()
    assert (a.mmsi, a.sog, a.cog, a.heading, a.length_m, a.imo, a.type_code, a.vessel_group) == ("367777550", 0.0, None, None, None, None, 52, "Tug Tow")
    assert (b.cog, b.length_m, b.width_m, b.nav_status, b.vessel_group, b.disposition) == (342.5, 18.0, None, "undefined", "Fishing", "usable")


def test_written_reports_read_back_equal(spark, extract, tmp_path):
    first = R.parse(ais_csv.read(spark, extract))
    ais_csv.write(first, str(tmp_path / "out"))
    again = R.parse(ais_csv.read(spark, str(tmp_path / "out")))
    keep = ["mmsi", "t_us", "lon", "lat", "sog", "cog", "heading", "name", "call_sign", "type_code"]
    assert sorted(first.select(keep).collect()) == sorted(again.select(keep).collect())


def test_header_is_checked(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text("MMSI,LAT\n1,2\n")
    with pytest.raises(ValueError, match="missing"):
        ais_csv.read(spark, str(p))
    with pytest.raises(ValueError, match="order"):
        R.check_header(R.RAW_COLUMNS[::-1])


def _fates(spark, rows):
    df = spark.createDataFrame([("v", i, t, x, y) for i, (t, x, y) in enumerate(rows)], "mmsi string, pos long, t_us long, lon double, lat double")
    return [r.rejected for r in R.clean(df).orderBy("pos").collect()]


def test_cleaning_compares_with_the_last_accepted_report(spark):
    h = 3_600_000_000
    assert _fates(spark, [(0, 0.0, 0.0), (0, 0.1, 0.0)]) == [None, "duplicate_timestamp"]
    assert _fates(spark, [(0, 0.0, 0.0), (h // 6, 9.4, 0.0), (h // 3, 0.01, 0.0)]) == [None, "impossible_speed", None]
    assert _fates(spark, [(0, 0.0, 0.0), (h, 999.0, 0.0), (2 * h, None, 1.0)]) == [None, "bad_position", "bad_position"]


def test_groups_are_not_contiguous(spark):
    got = spark.range(0, 130).select("id", codes.vessel_group(F.col("id")).alias("g"))
    g = {r.id: r.g for r in got.collect()}
    assert (g[0], g[30], g[31], g[33], g[35], g[36], g[52], g[69], g[89], g[99], g[100]) == ("Not Available", "Fishing", "Tug Tow", "Other", "Military", "Pleasure Craft/Sailing", "Tug Tow", "Passenger", "Tanker", "Other", None)


def test_gaps_and_completeness_use_the_vessels_own_cadence(spark):
    m = 60_000_000
    df = spark.createDataFrame([("v", i, t * m, None if i == 1 else 5.0) for i, t in enumerate([0, 10, 20, 60, 70])], "mmsi string, pos long, t_us long, sog double")
    assert [(r.from_us, r.to_us, r.minutes) for r in R.gaps(df).collect()] == [(20 * m, 60 * m, 40.0)]
    c = R.completeness(df, ["sog"]).first()
    assert (c.accepted, c.expected, c.largest_gap_min, c.missing, c.report_share, c.field_share) == (5, 8, 40.0, 1, 0.625, 0.8)


def test_cleaning_equals_a_plain_walk(spark):
    """Days, silences, jumps, shared identities, the date line and null identities against one loop over each track."""
    rng, h, rows = random.Random(3), 3_600_000_000, []
    for v in ["calm", "jumpy", "shared", "line", None]:
        t, x, y = 0, 179.0 if v == "line" else 10.0, 60.0 if v == "calm" else 5.0
        for i in range(300):
            t += 400 * h if rng.random() < 0.01 else rng.choice([0, h // 6, h // 2, 2 * h])
            x, y = (x + 0.3 + 180) % 360 - 180 if v == "line" else x + rng.uniform(-0.1, 0.1), y + rng.uniform(-0.05, 0.05)
            off = (i % 2 * 60 if v == "shared" else 0) + (rng.uniform(-40, 40) if v == "jumpy" and rng.random() < 0.1 else 0)
            rows.append((v, len(rows), t, (x + off + 180) % 360 - 180, y))
    want, last = [], {}
    for v, _, t, x, y in rows:
        at = last.get(v)
        if at and at[0] == t:
            want.append("duplicate_timestamp")
        elif at and R.implied_knots(*map(math.radians, (*at[1:], x, y)), (t - at[0]) / h) > R.MAX_SPEED_KN:
            want.append("impossible_speed")
        else:
            want.append(None)
            last[v] = (t, x, y)
    df = spark.createDataFrame(rows, "mmsi string, pos long, t_us long, lon double, lat double")
    assert [r.rejected for r in R.clean(df).orderBy("pos").collect()] == want and len(set(want)) == 3


def test_cleaning_folds_only_what_is_near_an_odd_report(spark):
    h = 3_600_000_000
    rows = [("v", i, i * h, 99.0 if i == 200 else i * 0.1, 0.0) for i in range(500)]
    df = spark.createDataFrame(rows, "mmsi string, pos long, t_us long, lon double, lat double").withColumn("_chunk", F.floor(F.col("t_us") / R.CHUNK_US))
    found = R._with_starts(df.withColumns(R._reach(R.MAX_SPEED_KN)))
    tied = {r.pos for r in found.filter("not (_fresh and _next_fresh)").collect()}
    # 191: the last of the day before, since that day does not end known to be clear
    assert {199, 200, 201} <= tied <= {191, *range(199, 400)}
    assert R.clean(df.limit(0).drop("_chunk")).count() == 0


def test_points_of_a_tie_go_up(spark):
    """5 * 0.67 is 3.35, which doubles put just below the tie."""
    at = [3.3499999999999996, 3.35, 3.3499999, 4.25, 7.0, -1.0, 0.05]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(at)], "i int, x double").select("i", shortlist._points(F.col("x"), 5).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == [3.4, 3.4, 3.3, 4.3, 5.0, 0.0, 0.1]


def test_cleaning_reads_its_reports_once(spark):
    """What makes the reports is not run again for each part of them."""
    h, seen = 3_600_000_000, spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = [("v", i, i * h, 99.0 if i in (70, 130) else i * 0.1, 0.0) for i in range(200)] + [("v", 200, None, 1.0, 1.0), ("w", 201, 0, 999.0, 0.0)]
    schema = "mmsi string, pos long, t_us long, lon double, lat double"
    got = R.clean(spark.createDataFrame(rows, schema).mapInPandas(counted, schema)).collect()
    assert {r.pos: r.rejected for r in got if r.rejected} == {70: "impossible_speed", 130: "impossible_speed", 200: "unparsable_time", 201: "bad_position"}
    assert len(got) == len(rows) == seen.value
