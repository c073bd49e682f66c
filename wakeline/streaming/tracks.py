"""Reports as a stream: duplicates within the watermark go, and each vessel keeps its last accepted report as state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.reports import HALF_WAY_KM, KM_PER_NM, MAX_SPEED_KN, implied_knots
from ..session import ship

SHIFT_US = 5_000_000_000_000_000
#: How long a vessel's last report matters: half the circumference at the speed limit.
KEEP_MS = int(HALF_WAY_KM / KM_PER_NM / MAX_SPEED_KN * 3.6e6)
_OUT = "mmsi string, pos long, t_us long, lon double, lat double, rejected string"
_STATE = "t_us long, lon double, lat double"


def _step(key, batches, state: GroupState):
    if state.hasTimedOut:
        state.remove()
        return
    last = state.get if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["t_us", "pos"])
    why = []
    for t, x, y in zip(rows.t_us, rows.lon, rows.lat):
        r = None
        if not (-180 <= x <= 180 and -90 <= y <= 90):
            r = "bad_position"
        elif last and t == last[0]:
            r = "duplicate_timestamp"
        elif last and t < last[0]:
            r = "out_of_order"
        elif last and implied_knots(*np.radians([last[1], last[2], x, y]), (t - last[0]) / 3.6e9) > MAX_SPEED_KN:
            r = "impossible_speed"
        if r is None:
            last = (int(t), float(x), float(y))
        why.append(r)
    if last:
        state.update(last)
        state.setTimeoutTimestamp(max(int((last[0] + SHIFT_US) // 1000), state.getCurrentWatermarkMs()) + KEEP_MS)
    yield rows.assign(rejected=why)[["mmsi", "pos", "t_us", "lon", "lat", "rejected"]]


def clean_stream(reports: DataFrame, late: str = "2 hours") -> DataFrame:
    """The batch cleaning rules over a stream of (mmsi, pos, t_us, lon, lat); rows of one trigger are taken in time order.

    State is one report a vessel, kept until the watermark is KEEP_MS past it: after
    such a silence no place on Earth is too far away.  Rows later than the watermark
    are dropped by the duplicate filter's own state.  A row of a later trigger that is
    earlier in time than the last accepted report cannot be placed any more: it is
    rejected as out_of_order and leaves the state as it is.
    """
    ship(reports.sparkSession)
    # a watermark begins at 1970 and drops what is not after it: shifted, so that reports of any year pass
    timed = reports.withColumn("at", F.timestamp_micros(F.col("t_us") + SHIFT_US)).withWatermark("at", late).dropDuplicatesWithinWatermark(["mmsi", "pos"])
    return timed.select("mmsi", "pos", "t_us", "lon", "lat", "at").groupBy("mmsi").applyInPandasWithState(_step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def window_counts(reports: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Reports and vessels (approximate) in tumbling windows of event time."""
    timed = reports.withColumn("at", F.timestamp_micros("t_us")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width)).agg(F.count(F.lit(1)).alias("reports"), F.approx_count_distinct("mmsi").alias("vessels"))
