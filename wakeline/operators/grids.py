"""Gridded products as long tables (step, gj, gi, u, v): decoding, windows, coverage, lookups and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import turn
from .asof import bracket

# Seconds of the units that a time axis may be counted in.
UNIT_SECONDS = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600, "day": 86400, "days": 86400}
SINCE = r"^\s*(\w+)\s+since\s+(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.\d+)?)?)?"


def decode(raw: Column, fill=None, missing=None, least=None, most=None, scale: float = 1.0, offset: float = 0.0) -> Column:
    """Packed samples: fill and missing values, and what lies outside the valid range, are null before scale and offset apply."""
    ok = raw.isNotNull() & ~F.isnan(raw.cast("double"))
    for unset in (fill, missing):
        ok = ok if unset is None else ok & (raw != F.lit(unset))
    ok = ok if least is None else ok & (raw >= F.lit(least))
    ok = ok if most is None else ok & (raw <= F.lit(most))
    return F.when(ok, raw * F.lit(float(scale)) + F.lit(float(offset)))


def time_units(units: Column) -> tuple[Column, Column]:
    """Seconds of a unit and the epoch in microseconds of ``<unit> since <epoch>``; null if it is not of that form or the unit is unknown."""
    part = lambda i: F.regexp_extract(units, SINCE, i)
    known = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])
    scale = F.try_element_at(known, F.lower(part(1))).cast("long")
    n = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(0))
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *[n(i) for i in range(2, 8)])
    return scale, F.when(scale.isNotNull(), F.unix_micros(F.try_to_timestamp(text)))


def to_convention(lon: Column, west: Column) -> Column:
    """A longitude in the convention of a grid that begins at ``west``: 0 to 360 if that is not negative, else -180 to 180."""
    return F.when(west >= 0, turn(lon)).otherwise(turn(lon + 180.0) - 180.0)


def axis_roles(sizes: list[int], times: int, depths: int) -> list[str]:
    """Roles of a variable's leading axes by their lengths: each known length names one axis, the first that is left is time."""
    roles: list[str] = []
    for n in sizes:
        free = [r for r, known in (("time", times), ("depth", depths)) if known == n and r not in roles]
        roles.append(free[0] if free else "time" if "time" not in roles else "other")
    return roles


def fullest_slice(field: DataFrame, key: str) -> DataFrame:
    """One row: the slice with most cells that have a value (the first of equals)."""
    n = field.groupBy(key).agg(F.count("u").alias("finite"))
    return n.agg(F.max_by(key, F.struct(F.col("finite"), -F.col(key))).alias(key), F.max("finite").alias("finite"))


def window(field: DataFrame, west: float, south: float, east: float, north: float, pad: float = 0.0) -> DataFrame:
    """Cells inside a padded box (closed)."""
    return field.filter(F.col("lon").between(west - pad, east + pad) & F.col("lat").between(south - pad, north + pad))


def statistics(field: DataFrame, *keys: str) -> DataFrame:
    """Cells, cells with a value, least and greatest u, v and speed, mean speed, and the direction that the mean flow comes from."""
    speed = F.hypot("u", "v")
    return field.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"), F.count("u").alias("valid"), F.min("u").alias("u_min"), F.max("u").alias("u_max"), F.min("v").alias("v_min"), F.max("v").alias("v_max"),
        F.min(speed).alias("speed_min"), F.max(speed).alias("speed_max"), F.avg(speed).alias("speed_mean"), turn(F.degrees(F.atan2(-F.avg("u"), -F.avg("v")))).alias("from_deg"),
    )


def nearest_cell(queries: DataFrame, grid: DataFrame, x0: float, y0: float, step: float) -> DataFrame:
    """qid, value of the nearest cell; halves go to the even index."""
    q = queries.select("qid", F.rint((F.col("x") - x0) / step).cast("int").alias("gi"), F.rint((F.col("y") - y0) / step).cast("int").alias("gj"))
    return q.join(grid, ["gi", "gj"], "left").select("qid", "value")


def coverage(scenes: DataFrame, field: DataFrame, axis: DataFrame, step_deg: float, x0: float, y0: float, tolerance_h: float = 24.0, pad: float = 0.5, width_us: float = 3.6e9) -> DataFrame:
    """Whether a product may be used for each scene (scene, west, south, east, north, t_us), and why not.

    In space: the footprint lies inside the grid and the padded window has a cell with
    a value at the step nearest to the scene (the first step without a time).  In
    time: the nearest step is within the tolerance.  Windows are spread to their
    cells and meet the grid by an equi-join.
    """
    grid = field.agg(F.min("gi").alias("i0"), F.max("gi").alias("i1"), F.min("gj").alias("j0"), F.max("gj").alias("j1"), F.min("step").alias("s0"))
    s = bracket(scenes, "t_us", axis, "step", "at_us", width_us).crossJoin(F.broadcast(grid))
    at = lambda c, o, up: (F.floor if up else F.ceil)((c - o) / step_deg).cast("int")
    s = s.withColumn("inside", (F.col("west") >= x0 + F.col("i0") * step_deg) & (F.col("east") <= x0 + F.col("i1") * step_deg) & (F.col("south") >= y0 + F.col("j0") * step_deg) & (F.col("north") <= y0 + F.col("j1") * step_deg))
    lo_i, hi_i = F.greatest(F.col("i0"), at(F.col("west") - pad, x0, False)), F.least(F.col("i1"), at(F.col("east") + pad, x0, True))
    lo_j, hi_j = F.greatest(F.col("j0"), at(F.col("south") - pad, y0, False)), F.least(F.col("j1"), at(F.col("north") + pad, y0, True))
    span = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi))
    cells = s.select("scene", F.coalesce("nearest", "s0").alias("step"), F.explode(span(lo_i, hi_i)).alias("gi"), span(lo_j, hi_j).alias("js")).select("scene", "step", "gi", F.explode("js").alias("gj"))
    water = cells.join(field.filter("u is not null").select("step", "gi", "gj"), ["step", "gi", "gj"]).groupBy("scene").agg(F.count(F.lit(1)).alias("water_cells"))
    s = s.join(water, "scene", "left").withColumn("water_cells", F.coalesce("water_cells", F.lit(0)))
    hours = F.col("nearest_gap") / 3.6e9
    s = s.withColumn("spatial", F.col("inside") & (F.col("water_cells") > 0)).withColumn("temporal", F.coalesce(hours <= tolerance_h, F.lit(False)))
    why = F.array_compact(F.array(
        F.when(~F.col("inside"), "footprint outside the grid").when(F.col("water_cells") == 0, "no cells with a value over the footprint"),
        F.when(F.col("t_us").isNull(), "time unknown").when(F.col("nearest").isNull(), "no time axis").when(~F.col("temporal"), F.format_string("nearest step %.1f days away", F.round(hours / 24, 1))),
    ))
    return s.select("scene", "spatial", "temporal", (F.col("spatial") & F.col("temporal")).alias("usable"), F.col("nearest").alias("step"), F.round(hours, 2).alias("gap_h"), "water_cells", why.alias("reasons"))


def coverage_verdict(covered: DataFrame) -> DataFrame:
    """One row: how many scenes, usable, and in space only, and the verdict in words."""
    n = covered.agg(F.count(F.lit(1)).alias("scenes"), F.count_if("usable").alias("usable"), F.count_if(F.col("spatial") & ~F.col("usable")).alias("space_only"))
    words = (
        F.when(F.col("scenes") == 0, "nothing to test").when(F.col("usable") == F.col("scenes"), "covers every scene in space and time")
        .when(F.col("usable") > 0, F.format_string("covers %d of %d scenes in space and time", "usable", "scenes"))
        .when(F.col("space_only") > 0, F.format_string("covers %d of %d scenes in space, none in time", "space_only", "scenes")).otherwise("covers no scene")
    )
    return n.withColumn("verdict", words)


def flagged_cells(field: DataFrame, box: tuple, most: int = 4000) -> DataFrame:
    """Cells without a value (land) inside a box in the order of (lat, lon), at most so many (a report), each with whether more were left out."""
    land = window(field, *box).filter("u is null").select("gj", "gi", "lat", "lon").distinct()
    return land.orderBy("lat", "lon").limit(most).crossJoin(F.broadcast(land.agg((F.count(F.lit(1)) > most).alias("truncated"))))


def cadence(axis: DataFrame, at: str, *keys: str) -> DataFrame:
    """keys, steps, cadence: the number of different times of each axis and the median of the gaps between them; null with fewer than two."""
    times = axis.filter(F.col(at).isNotNull()).select(*keys, at).distinct()
    gaps = times.withColumn("gap", F.col(at) - F.lag(at).over(Window.partitionBy(*keys).orderBy(at)))
    return gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("steps"), F.percentile("gap", F.lit(0.5)).alias("cadence"))


def first_usable(chain: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """key, value, source: for each key the value of the first source of a chain that has one that is not null."""
    named = [df.filter(F.col(value).isNotNull()).select(key, F.col(value).alias("value"), F.lit(i).alias("place"), F.lit(name).alias("source")) for i, (name, df) in enumerate(chain)]
    best = F.min_by(F.struct("value", "source"), "place")
    return reduce(DataFrame.unionByName, named).groupBy(key).agg(best.alias("b")).select(key, F.col("b.value").alias(value), F.col("b.source").alias("source"))


def horizon_coverage(product: DataFrame, asked: DataFrame) -> DataFrame:
    """key, covered, reasons: the share of each asked interval (key, from_us, to_us) that a product's times (start_us, end_us; one row) span, and why it is not whole."""
    j = asked.crossJoin(F.broadcast(product.agg(F.min("start_us").alias("p0"), F.max("end_us").alias("p1"))))
    want, have = F.col("to_us") - F.col("from_us"), F.greatest(F.lit(0), F.least("to_us", "p1") - F.greatest("from_us", "p0"))
    share = F.when(want > 0, F.coalesce(have / want, F.lit(0.0)))
    why = F.array_compact(F.array(F.when(F.col("p0").isNull(), "no times").when(F.col("from_us") < F.col("p0"), "begins before the product"), F.when(F.col("to_us") > F.col("p1"), "ends after the product")))
    return j.select("key", share.alias("covered"), why.alias("reasons"))
