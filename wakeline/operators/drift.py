"""Drifting particles as a long table (step, pid, lon, lat, state), their statistics, and the fields that move them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km

KM_PER_DEG = 111.32


def cloud(particles: DataFrame) -> DataFrame:
    """Per step: centroid, distances from it (median, 90th percentile, greatest), distance from where the first step's centroid was, and particles by state.

    Two passes over the particles; centroids are one row a step and are broadcast up to
    the limit that Spark sets itself.
    """
    centre = particles.groupBy("step").agg(F.avg("lon").alias("clon"), F.avg("lat").alias("clat"))
    origin = centre.agg(F.min_by(F.struct("clon", "clat"), "step").alias("o"))
    p = particles.join(centre, "step").crossJoin(F.broadcast(origin))
    p = p.withColumn("away", haversine_km(F.col("lon"), F.col("lat"), F.col("clon"), F.col("clat"))).withColumn("moved", haversine_km(F.col("lon"), F.col("lat"), F.col("o.clon"), F.col("o.clat")))
    q = F.percentile("away", F.array(F.lit(0.5), F.lit(0.9)))
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    out = p.groupBy("step").agg(F.count(F.lit(1)).alias("particles"), F.first("clon").alias("clon"), F.first("clat").alias("clat"), q.alias("q"), F.max("away").alias("max_km"), F.avg("moved").alias("moved_km"), F.max("moved").alias("moved_max_km"), n("active"), n("beached"), n("exited"))
    return out.select("step", "particles", "clon", "clat", F.col("q")[0].alias("p50_km"), F.col("q")[1].alias("p90_km"), "max_km", "moved_km", "moved_max_km", "active", "beached", "exited")


def envelope_box(track: DataFrame, pad_km: float = 25.0) -> DataFrame:
    """One row: west, south, east, north of a box around all circles (lon, lat, radius_km) of a track and a margin; degrees of longitude shrink with the latitude."""
    e = track.agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"), F.max("radius_km").alias("r"))
    reach = F.col("r") + pad_km
    lat, lon = reach / KM_PER_DEG, reach / F.greatest(KM_PER_DEG * F.cos(F.radians((F.col("s") + F.col("n")) / 2)), F.lit(1.0))
    return e.select((F.col("w") - lon).alias("west"), (F.col("s") - lat).alias("south"), (F.col("e") + lon).alias("east"), (F.col("n") + lat).alias("north"))


def eddies(modes: list[dict], x: Column, y: Column, seconds: Column, background: tuple = (0.0, 0.0), scale: float = 1.0) -> tuple[Column, Column]:
    """Currents (u, v) as the curl of a stream function, so their divergence is nothing.

    A mode: kx, ky (per metre), amplitude (m/s), period_h and the phases px, py, pt; x
    and y in metres.
    """
    u, v = F.lit(0.0), F.lit(0.0)
    for m in modes:
        k = math.hypot(m["kx"], m["ky"])
        if k > 0:
            c = F.cos(2 * math.pi / (m["period_h"] * 3600) * seconds + m["pt"]) * (m["amplitude"] / k)
            a, b = m["kx"] * x + m["px"], m["ky"] * y + m["py"]
            u, v = u + c * m["ky"] * F.sin(a) * F.cos(b), v - c * m["kx"] * F.cos(a) * F.sin(b)
    return u * scale + background[0], v * scale + background[1]
