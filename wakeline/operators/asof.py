"""As-of joins on any ordered axis, by bins: equi-joins that shuffle nothing but the rows themselves, or nothing at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import table

#: Steps of an axis that are broadcast; a longer one is joined by a shuffle on the bins.
BROADCAST_STEPS = 100_000


def segments(axis: DataFrame, step: str, at: str) -> DataFrame:
    """_before, _after, _lo, _hi: each step of an axis (one row a step) with the next one; the last is its own next.

    Of steps at one instant the first is kept, as an index search would.  Steps are
    sorted in ranges; a range's last step meets the first of the next range that has
    any through one row a range.
    """
    one = axis.filter(F.col(at).isNotNull()).groupBy(F.col(at).alias("_lo")).agg(F.min(step).alias("_before"))
    one = table(one.repartitionByRange("_lo").withColumn("_range", F.spark_partition_id()))
    first = F.min(F.struct("_lo", "_before"))
    heads = one.groupBy("_range").agg(first.alias("_head")).select("_range", F.lead("_head").over(Window.orderBy("_range")).alias("_head"))
    w = Window.partitionBy("_range").orderBy("_lo")
    seg = one.join(F.broadcast(heads), "_range")  # one row a partition
    after = lambda c: F.coalesce(F.lead(c).over(w), F.col(f"_head.{c}"))
    return seg.select("_before", F.coalesce(after("_before"), F.col("_before")).alias("_after"), "_lo", after("_lo").alias("_hi"))


def bracket(rows: DataFrame, t: str, axis: DataFrame, step: str, at: str, width: float) -> DataFrame:
    """rows with before, after (steps of the axis around t), weight of after, gap (distance to the axis outside its ends, else 0) and nearest with its nearest_gap.

    Times outside the axis are clamped to its ends; a null time has no steps.  Of two
    steps equally near the earlier is the nearest.  ``width``: a usual step.  An interval
    of up to ``width`` * 2 ** n lies in bins of that size, two or three of them however
    long it is, and a time looks into the bins of each n that the axis has (one, if it
    is regular), so the join is an equi-join on n and bin.
    """
    seg = segments(axis, step, at)
    length = F.col("_hi") - F.col("_lo")
    seg = seg.withColumn("_n", F.when(length > width, F.ceil(F.log2(length / width))).otherwise(0).cast("int"))
    # one row: the ends, the number of steps and at most some sixty sizes of bins
    known = seg.agg(F.min("_lo").alias("first"), F.max("_lo").alias("last"), F.count(F.lit(1)).alias("n"), F.collect_set("_n").alias("sizes")).first()
    bin_ = lambda x: F.floor(x / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_n"))))
    bins = seg.withColumn("_b", F.explode(F.sequence(bin_(F.col("_lo")), bin_(F.coalesce("_hi", "_lo"))))).withColumnRenamed("_n", "_m")
    r = rows.withColumn("_t", F.when(F.col(t).isNotNull(), F.greatest(F.lit(known.first), F.least(F.lit(known.last), F.col(t)))) if known.n else F.lit(None).cast("double"))
    sizes = F.array(*[F.lit(n) for n in known.sizes or [0]])
    r = r.withColumn("_n", F.explode(F.when(F.col("_t").isNotNull(), sizes).otherwise(F.array(F.lit(0))))).withColumn("_bin", bin_(F.col("_t")))
    on = (F.col("_n") == F.col("_m")) & (F.col("_bin") == F.col("_b")) & (F.col("_t") >= F.col("_lo")) & (F.col("_hi").isNull() | (F.col("_t") < F.col("_hi")))
    j = r.join(F.broadcast(bins) if known.n <= BROADCAST_STEPS else bins, on, "left").filter("_lo is not null or _t is null")
    weight = F.when(F.col("_hi").isNull(), 0.0).otherwise((F.col("_t") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    later = F.col("_hi").isNotNull() & (F.col("_hi") - F.col("_t") < F.col("_t") - F.col("_lo"))
    j = j.select(
        *[F.col(c) for c in rows.columns], F.col("_before").alias("before"), F.col("_after").alias("after"), F.when(F.col("_lo").isNotNull(), weight).alias("weight"),
        F.abs(F.col(t) - F.col("_t")).alias("gap"), F.when(later, F.col("_after")).otherwise(F.col("_before")).alias("nearest"),
        F.abs(F.col(t) - F.when(later, F.col("_hi")).otherwise(F.col("_lo"))).alias("nearest_gap"),
    )
    return j
