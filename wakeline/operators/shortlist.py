"""Which vessels could have been near the oil: envelope join, score and ranking.

The envelope has steps of equal length, so the step of a report is computed from its
time and the join is a hash join on the step's number, never a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.geo import angle_between, bearing_deg, haversine_km, within_box, within_window
from .reports import clean, completeness, courses

INSIDE, IRRELEVANT = 1.0, 3.0
STOPPED_KN, SLOW_KN = 1.0, 3.0
WEIGHTS = {"distance": 30, "time": 25, "trajectory": 20, "behaviour": 10, "type": 10, "quality": 5}
#: Steps of an envelope that are broadcast; one has a few dozen.
MOST_STEPS = 100_000


def envelope_join(reports: DataFrame, envelope: DataFrame, start_us: int, step_us: int, steps: int) -> DataFrame:
    """Each report with the envelope's centre and radius at its own time (clamped at the ends), its distance, and whether its time lies in the closed window.

    ``envelope``: seg, lon0, lat0, r0 and their change per step dlon, dlat, dr.
    """
    if steps > MOST_STEPS:
        raise ValueError("an envelope of so many steps is not a small table")
    f = F.greatest(F.lit(0.0), F.least(F.lit(float(steps)), (F.col("t_us") - F.lit(start_us)) / F.lit(float(step_us))))
    seg = F.least(F.floor(f), F.lit(steps - 1)).cast("int")
    r = reports.withColumn("_f", f).withColumn("seg", seg).join(F.broadcast(envelope), "seg")
    x = F.col("_f") - F.col("seg")
    r = r.withColumn("env_lon", F.col("lon0") + x * F.col("dlon")).withColumn("env_lat", F.col("lat0") + x * F.col("dlat")).withColumn("env_r", F.col("r0") + x * F.col("dr"))
    r = r.withColumn("dist", haversine_km(F.col("lon"), F.col("lat"), F.col("env_lon"), F.col("env_lat")))
    return r.withColumn("in_window", F.col("t_us").between(start_us, start_us + step_us * steps)).drop("_f", "lon0", "lat0", "r0", "dlon", "dlat", "dr")


def approach(joined: DataFrame) -> DataFrame:
    """Per vessel the closest report inside the window (the first of equals), and counts."""
    near = F.col("in_window") & (F.col("dist") <= IRRELEVANT * F.col("env_r"))
    best = F.min_by(F.struct("t_us", "dist", "env_r", "sog", "course"), F.when(F.col("in_window"), F.struct("dist", "t_us", "pos")))
    when_near = F.when(near, F.col("t_us"))
    out = joined.groupBy("mmsi").agg(
        F.count(F.lit(1)).alias("reports"), F.count_if("in_window").alias("reports_in_window"), F.count_if(near).alias("reports_relevant"),
        F.count_if(F.col("in_window") & (F.col("dist") <= F.col("env_r"))).alias("crossings"), ((F.max(when_near) - F.min(when_near)) / 3.6e9).alias("hours"),
        F.min(F.when(~F.col("in_window"), F.col("dist"))).alias("nearest_outside_km"), F.median("sog").alias("median_sog"), best.alias("b"),
    )
    radii = F.col("b.dist") / F.col("b.env_r")
    proximity = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (IRRELEVANT - radii) / (IRRELEVANT - INSIDE))), F.lit(0.0))
    return out.select("*", F.col("b.t_us").alias("at_us"), F.col("b.dist").alias("dist_km"), radii.alias("radii"), F.col("b.course").alias("course"), F.col("b.sog").alias("at_sog"), proximity.alias("proximity")).drop("b")


def slowest_near(joined: DataFrame, near: DataFrame, seconds: int = 3600) -> DataFrame:
    """Least speed of any report within an hour (closed) of the closest approach."""
    x = joined.join(near.select("mmsi", "at_us"), "mmsi").filter(F.abs(F.col("t_us") - F.col("at_us")) <= seconds * 1_000_000)
    return x.groupBy("mmsi").agg(F.min("sog").alias("lowest"))


def _points(x: Column, most: int) -> Column:
    """Points from 0 to most, to a tenth; a half of one goes up, also where doubles put the product just below it."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(float(most)), x)) * 10) / 10


def score(joined: DataFrame, static: DataFrame, axis_deg: float, rejected: DataFrame | None = None) -> DataFrame:
    """Six components (distance, time, trajectory, behaviour, type, quality), their total and band, per vessel.

    ``static``: mmsi, type_code.  ``rejected``: mmsi, rejected (reports dropped in cleaning).
    """
    joined = joined.repartition("mmsi")  # one exchange for all that follows, which goes by vessel
    a = approach(courses(joined))
    a = a.join(slowest_near(joined, a), "mmsi", "left").join(static.select("mmsi", "type_code"), "mmsi", "left")
    a = a.join(completeness(joined, ["sog"]).select("mmsi", "report_share", "field_share"), "mmsi")
    a = a.join(rejected.select("mmsi", "rejected"), "mmsi", "left") if rejected is not None else a.withColumn("rejected", F.lit(0))
    w, p, radii = WEIGHTS, F.col("proximity"), F.col("radii")
    distance = F.when(radii.isNull(), 0.0).when(radii <= INSIDE, float(w["distance"])).when(radii >= IRRELEVANT, 0.0).otherwise(w["distance"] * (IRRELEVANT - radii) / (IRRELEVANT - INSIDE))
    time = F.when(F.col("reports_relevant") == 0, 0.0).otherwise(w["time"] * (0.5 + 0.5 * F.least(F.lit(1.0), F.col("hours") / 6)))
    meets = F.when(F.col("crossings") > 0, 1.0).otherwise(p) * (w["trajectory"] * 2 / 3)
    across = F.coalesce(1 - F.abs(F.cos(F.radians(angle_between(F.col("course"), F.lit(axis_deg))))), F.lit(0.0)) * p * (w["trajectory"] / 3)
    trajectory = F.when(radii.isNull(), 0.0).otherwise(meets + across)
    low = F.coalesce("lowest", "at_sog", "median_sog")
    behaviour = F.when(F.col("at_us").isNull() | F.col("median_sog").isNull(), 0.0).when(low <= STOPPED_KN, 1.0).when(low <= SLOW_KN, 0.7).when((F.col("median_sog") > 0) & (low < 0.6 * F.col("median_sog")), 0.4).otherwise(0.0) * w["behaviour"]
    kind = codes.relevance(codes.vessel_group(F.col("type_code")), F.col("type_code")) * w["type"]
    lost = F.coalesce("rejected", F.lit(0))
    data = w["quality"] * (0.6 * F.col("report_share") + 0.4 * F.col("field_share")) * F.greatest(F.lit(0.5), 1 - 0.05 * lost)
    parts = {"distance": distance, "time": time, "trajectory": trajectory, "behaviour": behaviour, "type": kind, "quality": data}
    out = a.select("*", *[_points(x, w[k]).alias(f"s_{k}") for k, x in parts.items()])
    total = F.round(sum((F.col(f"s_{k}") for k in parts), F.lit(0.0)), 1)
    return out.withColumn("total", total).withColumn("relevant", F.col("reports_relevant") > 0).withColumn("band", band(total))


def band(total: Column, most: float = 100.0) -> Column:
    share = total / most
    return F.when(share >= 0.75, "strong").when(share >= 0.5, "partial").when(share >= 0.25, "weak").otherwise("none")


def rank(scored: DataFrame) -> DataFrame:
    """Relevant vessels first, by score, then by distance, then by identity.  One row a vessel goes through the window."""
    order = Window.orderBy(F.col("relevant").desc(), F.col("total").desc(), F.coalesce("dist_km", F.lit(1e9)), "mmsi")
    return scored.withColumn("rank", F.row_number().over(order))


def traffic_funnel(scored: DataFrame) -> DataFrame:
    """seen = relevant + outside_window + too_far."""
    return scored.agg(F.count(F.lit(1)).alias("seen"), F.count_if("relevant").alias("relevant"), F.count_if(F.col("reports_in_window") == 0).alias("outside_window"), F.count_if(~F.col("relevant") & (F.col("reports_in_window") > 0)).alias("too_far"))


def drift_axis(lon0: float, lat0: float, lon1: float, lat1: float) -> Column:
    return bearing_deg(F.lit(lon0), F.lit(lat0), F.lit(lon1), F.lit(lat1))


def spill_age(timeline: DataFrame) -> DataFrame:
    """One row: the earliest lookback whose displacement from the first step reaches its own radius, the greatest ratio, and the horizon.

    timeline: step, hours, lon, lat, spread_km (of one case, a few dozen rows).
    """
    origin = timeline.agg(F.min_by(F.struct("lon", "lat"), "step").alias("o"))
    t = timeline.crossJoin(F.broadcast(origin)).filter("spread_km > 0")
    t = t.withColumn("ratio", haversine_km(F.col("o.lon"), F.col("o.lat"), F.col("lon"), F.col("lat")) / F.col("spread_km"))
    return t.agg(F.min_by(F.abs("hours"), F.when(F.col("ratio") >= 1, F.col("step"))).alias("resolvable_h"), F.max("ratio").alias("max_ratio"), F.max(F.abs("hours")).alias("horizon_h"))


def reason(scored: DataFrame) -> Column:
    """Why a vessel is relevant, or which of the two ways it is not: no report in the window, or none near enough."""
    km = lambda c: F.format_string("%.2f km", F.round(c, 2))
    n = lambda c: F.col(c).cast("string")
    return (
        F.when(F.col("reports_relevant") > 0, F.concat(n("reports_relevant"), F.lit(" of "), n("reports"), F.lit(" reports in the release window and within 3 radii")))
        .when((F.col("reports_in_window") == 0) & F.col("nearest_outside_km").isNotNull(), F.concat(F.lit("no report in the release window; nearest outside it "), km("nearest_outside_km")))
        .when(F.col("reports_in_window") == 0, "no report in the release window")
        .otherwise(F.concat(n("reports_in_window"), F.lit(" reports in the release window, the closest "), km("dist_km"), F.format_string(" away (%.1f radii)", F.round("radii", 1))))
    )


def explanation(scored: DataFrame) -> Column:
    """array<string>: a sentence for each component, in order, with the points earned."""
    earned = lambda k: F.format_string("%.1f/%d ", F.col(f"s_{k}"), F.lit(WEIGHTS[k]))
    one = lambda fmt, c, places: F.format_string(fmt, F.round(c, places))
    low = F.coalesce("lowest", "at_sog", "median_sog")
    return F.array(
        F.concat(F.lit("distance "), earned("distance"), F.when(F.col("radii").isNull(), "no report in the window").otherwise(F.concat(one("%.2f km", "dist_km", 2), one(", %.1f radii", "radii", 1)))),
        F.concat(F.lit("time "), earned("time"), F.when(F.col("reports_relevant") == 0, "never near in the window").otherwise(one("near for %.1f h", "hours", 1))),
        F.concat(F.lit("trajectory "), earned("trajectory"), F.when(F.col("crossings") > 0, F.concat(F.col("crossings").cast("string"), F.lit(" reports inside the envelope"))).otherwise("no report inside the envelope")),
        F.concat(F.lit("behaviour "), earned("behaviour"), F.when(low.isNull(), "speed unknown").otherwise(one("slowest %.1f kn near the approach", low, 1))),
        F.concat(F.lit("type "), earned("type"), F.coalesce(codes.vessel_group(F.col("type_code")), F.lit("type not known"))),
        F.concat(F.lit("quality "), earned("quality"), F.format_string("%d %% of expected reports", F.round(100 * F.col("report_share")).cast("int"))),
    )


def feed(parsed: DataFrame, start_us: int, end_us: int, box: tuple | None = None, pad_us: int = 7_200_000_000, min_reports: int = 2) -> DataFrame:
    """The accepted reports of a padded release window for vessels that have enough of them, before and after cleaning.

    parsed: what reports.parse gives.  The window is half-open and padded at both ends;
    the counts of both filters are in feed_counts.
    """
    r = parsed.filter((F.col("disposition") == "usable") & within_window(F.col("t_us"), start_us - pad_us, end_us + pad_us))
    r = r.filter(within_box(F.col("lon"), F.col("lat"), *box)) if box else r
    n = F.count(F.lit(1)).over(Window.partitionBy("mmsi"))
    cleaned = clean(r.withColumn("raw_reports", n).filter(F.col("raw_reports") >= min_reports)).filter("rejected is null").drop("rejected")
    return cleaned.withColumn("reports", n).filter(F.col("reports") >= min_reports)


def feed_counts(fed: DataFrame) -> DataFrame:
    """Per vessel: reports kept, reports read, first and last time, least, median and greatest speed."""
    return fed.groupBy("mmsi").agg(F.count(F.lit(1)).alias("kept"), F.first("raw_reports").alias("read"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.round(F.min("sog"), 2).alias("min_sog"), F.round(F.median("sog"), 2).alias("median_sog"), F.round(F.max("sog"), 2).alias("max_sog"))
