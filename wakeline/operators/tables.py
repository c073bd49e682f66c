"""Relational steps that several reports share: pairing, keys, intervals, running sums, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Rows of both that share a key."""
    return one.join(two, key)


def unpaired(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Rows of one whose key the other lacks; a null key is never paired."""
    return one.join(two.select(key), key, "left_anti")


def present(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed, each once however often it is listed."""
    return rows.join(listed.select(key), key, "left_semi")


def keys(one: DataFrame, two: DataFrame, key: str, how: str) -> DataFrame:
    """Distinct keys of both (``common``) or of one without the other (``missing``)."""
    a, b = one.select(key), two.select(key)
    return a.intersect(b) if how == "common" else a.subtract(b)


def overlap_fraction(start: Column, end: Column, lo: float, hi: float) -> Column:
    """The share of an interval that lies in [lo, hi]; null for one without length."""
    return F.try_divide(F.greatest(F.lit(0.0), F.least(end, F.lit(hi)) - F.greatest(start, F.lit(lo))), end - start)


def undo_differences(cells: DataFrame, row: list[str], order: list[str], delta: str, bits: int = 8) -> DataFrame:
    """Adds decoded: samples stored as differences along a row, summed with the wrap-around of their type."""
    w = Window.partitionBy(*row).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("decoded", F.pmod(F.sum(F.col(delta).cast("long")).over(w), F.lit(1 << bits)))


def until(reports: DataFrame, t_us: int) -> DataFrame:
    """What playback shows at a time: reports up to it (closed) by vessel, and the last of them."""
    return reports.filter(F.col("t_us") <= t_us).groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"), F.max("t_us").alias("last_us"))


def equal_width(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, n, share over equal bins of [0, 1]; 1 falls into the last."""
    b = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    n = rows.filter(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def worst(rows: DataFrame, group: str, column: str, k: int) -> DataFrame:
    """The k groups of the least mean (a report); ties by name."""
    return rows.groupBy(group).agg(F.avg(column).alias(f"mean_{column}")).orderBy(f"mean_{column}", group).limit(k)


def first_spellings(rows: DataFrame, text: str, pos: str) -> DataFrame:
    """k (lower case), first_pos: each text once, whatever its case, with its first place."""
    return rows.groupBy(F.lower(text).alias("k")).agg(F.min(pos).alias("first_pos"))
