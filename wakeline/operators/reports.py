"""Vessel position reports: parsing, funnels, identity, track cleaning and profiles.

Raw extracts have 17 text columns; every rule is a column expression, so a national
daily extract is parsed inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce
from math import asin, cos, sin, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes
from ..functions.geo import EARTH_RADIUS_KM, bearing_deg, haversine_km
from ..session import table

RAW_COLUMNS = ["MMSI", "BaseDateTime", "LAT", "LON", "SOG", "COG", "Heading", "VesselName", "IMO", "CallSign", "VesselType", "Status", "Length", "Width", "Draft", "Cargo", "TransceiverClass"]
# Texts that stand for nothing.
NO_CALL_SIGN = ["NA", "N/A", "NONE", "NO COMM", "NOCOMM", "UNKNOWN", "-", "--", "0", "NIL"]
NO_NAME = ["NA", "N/A", "NONE", "UNKNOWN", "NO NAME", "NONAME", "VESSEL", "-", "--", "0"]
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NUMBERS = ["LON", "LAT", "SOG", "COG", "Heading", "Status", "VesselType", "Cargo", "Length", "Width", "Draft"]
MAX_SPEED_KN, KM_PER_NM, GAP_FACTOR = 45.0, 1.852, 1.5


def text(c: str, placeholders: list | None = None) -> Column:
    t = F.trim(F.col(c))
    empty = t == ""
    return F.when(~(empty | F.upper(t).isin(placeholders)) if placeholders else ~empty, t)


def number(c: str) -> Column:
    """A double, or null for anything that is not written as a number."""
    t = F.trim(F.col(c))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def code(x: Column) -> Column:
    """Integer code, truncated toward zero; 0 means unset, and what no integer holds is null."""
    return F.nullif(x.try_cast("int"), F.lit(0))


def bearing(x: Column, unset: float) -> Column:
    return F.when((x != unset) & (x >= 0) & (x < 360), x)


def check_header(names: list[str]) -> None:
    """Raise if the header is not the 17 columns in order, saying how it differs."""
    if list(names) == RAW_COLUMNS:
        return
    missing, extra = [c for c in RAW_COLUMNS if c not in names], [c for c in names if c not in RAW_COLUMNS]
    raise ValueError(f"unexpected header: missing {missing}, unknown {extra}" + ("" if missing or extra else ", columns in another order"))


def parse(raw: DataFrame) -> DataFrame:
    """Typed reports with a disposition column; ``pos`` is the row's place in the file.

    disposition: ``unusable`` if identity, time or position is missing or out of
    range, else ``usable``.  Codes and sentinels that mean "unset" become null.
    """
    raw = raw.withColumns({f"_{c}": number(c) for c in NUMBERS}).withColumns({"_mmsi": F.trim("MMSI")})
    imo = F.regexp_extract(F.trim("IMO"), r"^(?:[Ii][Mm][Oo])?\s*([1-9][0-9]{6})$", 1)
    sog = F.col("_SOG")
    out = raw.select(
        "pos",
        F.when(F.col("_mmsi").rlike("^[0-9]{9}$"), F.col("_mmsi")).alias("mmsi"),
        F.unix_micros(F.try_to_timestamp(F.trim("BaseDateTime"))).alias("t_us"),
        F.round("_LON", 6).alias("lon"), F.round("_LAT", 6).alias("lat"),
        F.when((sog != 102.3) & (sog >= 0), F.round(sog, 1)).alias("sog"),
        bearing(F.col("_COG"), 360.0).alias("cog"), bearing(F.col("_Heading"), 511.0).alias("heading"),
        F.col("_Status").try_cast("int").alias("status_code"), text("VesselName", NO_NAME).alias("name"),
        F.when(imo != "", F.concat(F.lit("IMO"), imo)).alias("imo"), text("CallSign", NO_CALL_SIGN).alias("call_sign"),
        code(F.col("_VesselType")).alias("type_code"), code(F.col("_Cargo")).alias("cargo_code"), positive(F.col("_Length")).alias("length_m"), positive(F.col("_Width")).alias("width_m"), positive(F.col("_Draft")).alias("draft_m"),
        text("TransceiverClass").alias("transceiver"),
    )
    bad = F.col("mmsi").isNull() | F.col("t_us").isNull() | F.coalesce(~F.col("lon").between(-180, 180), F.lit(True)) | F.coalesce(~F.col("lat").between(-90, 90), F.lit(True))
    out = out.withColumn("disposition", F.when(bad, "unusable").otherwise("usable"))
    return out.withColumn("nav_status", codes.nav_status(F.col("status_code"))).withColumn("vessel_group", codes.vessel_group(F.col("type_code")))


def funnel(parsed: DataFrame, box: tuple, window: tuple) -> DataFrame:
    """One row: rows examined, unusable, outside the box, outside the half-open window, kept (each row counts once, in that order)."""
    west, south, east, north = box
    inside = F.col("lon").between(west, east) & F.col("lat").between(south, north)
    timely = (F.col("t_us") >= window[0]) & (F.col("t_us") < window[1])
    fate = F.when(F.col("disposition") == "unusable", "unusable").when(~inside, "outside_bounds").when(~timely, "outside_window").otherwise("kept")
    count = lambda x: F.count_if(F.col("fate") == x).alias(x)
    return parsed.withColumn("fate", fate).agg(F.count(F.lit(1)).alias("rows_examined"), count("unusable"), count("outside_bounds"), count("outside_window"), count("kept"))


def vessels(parsed: DataFrame, fields: list[str], min_reports: int = 2) -> DataFrame:
    """Per vessel the first value that is not null of each field, in file order, and its reports."""
    usable = parsed.filter(F.col("disposition") == "usable")
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in fields]
    return usable.groupBy("mmsi").agg(F.count(F.lit(1)).alias("reports"), *first).filter(F.col("reports") >= min_reports)


#: A vessel's track is handled in chunks of this length, each in a task of its own.
CHUNK_US = 86_400_000_000
#: Directions in which reach is bounded.
DIRECTIONS = 8
#: More than rounding can make of a distance.
_SLACK_KM = 1e-3


def clean(reports: DataFrame, max_speed_kn: float = MAX_SPEED_KN) -> DataFrame:
    """Reports (mmsi, pos, t_us, lon, lat, ...) with the reason of their rejection, null if accepted.

    In time order each report is tested against the last one accepted: a position
    out of range, then the same instant, then an implied speed above the limit.  What
    is decided by a report alone (no time, a bad position) is decided first.  A report
    that every earlier one can reach is accepted whichever of them was the last: a
    fresh start.  It is found by running maxima inside the days of a vessel, which
    meet as one row each, so no track is one task.  Only reports that are no fresh
    start, and those just before them, are folded in order, as streams of sorted rows
    that end where a day begins afresh.  An identity that distant vessels share has no
    fresh start while they send: that is one stream, in bounded memory.

    The reports, and then those with their starts, are written as tables, as each is
    read several times: the plan of the reports runs once.  Their columns all go
    through every step, so select what is needed before.
    """
    bad = ~F.coalesce(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90), F.lit(False))
    own = F.when(F.col("t_us").isNull(), "unparsable_time").when(bad, "bad_position")
    named = table(reports.withColumn("rejected", own))
    rows = named.filter("rejected is null").withColumn("_chunk", F.floor(F.col("t_us") / CHUNK_US)).withColumns(_reach(max_speed_kn))
    rows = table(_with_starts(rows).select(*reports.columns, "rejected", "_fresh", "_next_fresh", "_run"))
    lone = F.col("_fresh") & F.col("_next_fresh")
    schema = T.StructType([*reports.schema.fields, T.StructField("rejected", T.StringType())])
    kept = rows.filter(lone).select(*schema.names)
    tied = rows.filter(~lone).select(*reports.columns, "_run")
    tied = tied.repartition("mmsi", "_run").sortWithinPartitions("mmsi", "_run", "t_us", "pos")
    return named.filter("rejected is not null").select(*schema.names).unionByName(kept).unionByName(tied.mapInPandas(_fold(max_speed_kn), schema))


def _reach(max_speed_kn: float) -> dict[str, Column]:
    """_g0, _g1, ...: distance at the limit since a fixed time, less the place's shadow on a direction.

    A great circle is no longer than the straight line between two places on a map with
    equal degrees, and that no longer than its greatest shadow over cos(pi / DIRECTIONS).
    So what is greater in every _g than an earlier report is in its reach.
    """
    run = F.col("t_us") / F.lit(3.6e9) * F.lit(max_speed_kn * KM_PER_NM)
    km = EARTH_RADIUS_KM / np.cos(np.pi / DIRECTIONS)
    x, y = F.radians("lon") * km, F.radians("lat") * km
    turn_ = 2 * np.pi / DIRECTIONS
    return {f"_g{i}": run - (x * float(np.cos(i * turn_)) + y * float(np.sin(i * turn_))) for i in range(DIRECTIONS)}


def _with_starts(rows: DataFrame) -> DataFrame:
    """rows with _fresh (in reach of all earlier reports), _next_fresh (the next report is known to be so, or there is none) and _run.

    A run is days of a vessel of which only the first is known to begin with a fresh
    start; that is read from the least and greatest reach of each day.
    """
    names = [f"_g{i}" for i in range(DIRECTIONS)]
    chunk, inside = ["mmsi", "_chunk"], Window.partitionBy("mmsi", "_chunk").orderBy("t_us", "pos")
    days = Window.partitionBy("mmsi").orderBy("_chunk")
    before = lambda c, w: F.max(c).over(w.rowsBetween(Window.unboundedPreceding, -1))
    beyond = lambda value, bound: F.coalesce(F.col(value) > bound + _SLACK_KM, F.lit(True))
    every = lambda conditions: reduce(lambda a, b: a & b, conditions)
    day = rows.groupBy(*chunk).agg(*[f(g).alias(g + n) for g in names for n, f in (("_least", F.min), ("", F.max))])
    day = day.select(*chunk, *[f"{g}_least" for g in names], *[before(g, days).alias(f"{g}_before") for g in names])
    day = day.withColumn("_cut", every(beyond(f"{g}_least", F.col(f"{g}_before")) for g in names)).drop(*[f"{g}_least" for g in names])
    day = day.withColumns({"_run": F.sum(F.col("_cut").cast("long")).over(days), "_cut_after": F.lead("_cut").over(days)}).drop("_cut")
    day = day.withColumnsRenamed({"mmsi": "_vessel", "_chunk": "_day"})
    rows = rows.join(day, F.col("mmsi").eqNullSafe(F.col("_vessel")) & (F.col("_chunk") == F.col("_day")))
    rows = rows.withColumn("_fresh", every(beyond(g, F.greatest(before(g, inside), F.col(f"{g}_before"))) for g in names))
    return rows.withColumn("_next_fresh", F.coalesce(F.lead("_fresh").over(inside), "_cut_after", F.lit(True)))


#: Half the circumference: after a silence in which the limit covers it no report is too fast.
HALF_WAY_KM = 20_100.0


def _fold(max_speed_kn: float):
    """Sorted reports of runs, each tested against the last one accepted of its run; only that one is carried from batch to batch."""

    def run(batches):
        here = last = None
        for pdf in batches:
            keys = list(zip(pdf.mmsi, pdf._run))
            ts, xs, ys, why = pdf.t_us.tolist(), np.radians(pdf.lon.to_numpy()).tolist(), np.radians(pdf.lat.to_numpy()).tolist(), []
            for key, t, x, y in zip(keys, ts, xs, ys):
                reason = None
                if key == here and t == last[0]:
                    reason = "duplicate_timestamp"
                elif key == here and implied_knots(last[1], last[2], x, y, (t - last[0]) / 3.6e9) > max_speed_kn:
                    reason = "impossible_speed"
                else:
                    here, last = key, (t, x, y)
                why.append(reason)
            yield pdf.drop(columns="_run").assign(rejected=why)

    return run


def implied_knots(x1, y1, x2, y2, hours):
    """Speed between two places in radians."""
    a = sin((y2 - y1) / 2) ** 2 + cos(y1) * cos(y2) * sin((x2 - x1) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * asin(min(1.0, sqrt(a))) / KM_PER_NM / hours


def gaps(reports: DataFrame, factor: float = GAP_FACTOR) -> DataFrame:
    """Silences longer than ``factor`` times the vessel's own median positive interval."""
    w = Window.partitionBy("mmsi").orderBy("t_us", "pos")
    steps = reports.withColumn("before", F.lag("t_us").over(w)).withColumn("dt", (F.col("t_us") - F.col("before")) / 1e6)
    usual = steps.filter("dt > 0").groupBy("mmsi").agg(F.percentile("dt", F.lit(0.5)).alias("usual_s"))
    return steps.join(usual, "mmsi").filter(F.col("dt") > factor * F.col("usual_s")).select("mmsi", F.col("before").alias("from_us"), F.col("t_us").alias("to_us"), (F.col("dt") / 60).alias("minutes"), "usual_s")


def completeness(reports: DataFrame, fields: list[str], factor: float = GAP_FACTOR) -> DataFrame:
    """Per vessel: accepted, usual interval, expected reports, largest gap, shares of reports and of fields present."""
    w = Window.partitionBy("mmsi").orderBy("t_us", "pos")
    steps = reports.withColumn("dt", (F.col("t_us") - F.lag("t_us").over(w)) / 1e6)
    usual = F.coalesce(F.percentile(F.when(F.col("dt") > 0, F.col("dt")), F.lit(0.5)), F.lit(0.0))
    missing = sum((F.count_if(F.col(c).isNull()) for c in fields), F.lit(0))
    one = steps.groupBy("mmsi").agg(F.count(F.lit(1)).alias("accepted"), usual.alias("usual_s"), ((F.max("t_us") - F.min("t_us")) / 1e6).alias("span_s"), F.max("dt").alias("longest"), missing.alias("missing"))
    ideal = F.when((F.col("usual_s") > 0) & (F.col("span_s") > 0), F.floor(F.col("span_s") / F.nullif("usual_s", F.lit(0.0))) + 1).otherwise(F.col("accepted"))
    one = one.withColumn("expected", ideal.cast("long"))
    gap = F.when((F.col("usual_s") > 0) & (F.col("longest") > factor * F.col("usual_s")), F.col("longest") / 60).otherwise(0.0)
    return one.select(
        "mmsi", "accepted", F.round("usual_s", 1).alias("usual_s"), "expected", F.round(gap, 1).alias("largest_gap_min"), "missing",
        F.least(F.lit(1.0), F.col("accepted") / F.col("expected")).alias("report_share"), (1.0 - F.col("missing") / (len(fields) * F.col("accepted"))).alias("field_share"),
    )


def summary(reports: DataFrame) -> DataFrame:
    return reports.groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"), F.min("sog").alias("min_sog"), F.max("sog").alias("max_sog"), F.median("sog").alias("median_sog"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


def courses(reports: DataFrame) -> DataFrame:
    """Course at each report from its neighbours; at the ends from the report itself."""
    w = Window.partitionBy("mmsi").orderBy("t_us", "pos")
    near = lambda f, c: F.coalesce(f(c).over(w), F.col(c))
    return reports.select("*", bearing_deg(near(F.lag, "lon"), near(F.lag, "lat"), near(F.lead, "lon"), near(F.lead, "lat")).alias("course"))


def vessel_funnel(parsed: DataFrame, min_reports: int = 2) -> DataFrame:
    """One row: vessels seen, kept (with enough usable reports) and dropped, and the reports of those kept."""
    n = parsed.filter("disposition = 'usable'").groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"))
    kept = F.col("n") >= min_reports
    return n.agg(F.count(F.lit(1)).alias("seen"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("reports"))


def on_land(reports: DataFrame, land: DataFrame, x0: float, y0: float, step: float) -> DataFrame:
    """mmsi, reports, on_land: how many of a vessel's reports lie nearest to a land cell (gi, gj) of a grid."""
    at = reports.select("mmsi", F.rint((F.col("lon") - x0) / step).cast("int").alias("gi"), F.rint((F.col("lat") - y0) / step).cast("int").alias("gj"))
    hit = land.select("gi", "gj").distinct().withColumn("land", F.lit(True))
    return at.join(hit, ["gi", "gj"], "left").groupBy("mmsi").agg(F.count(F.lit(1)).alias("reports"), F.count_if(F.coalesce("land", F.lit(False))).alias("on_land"))
