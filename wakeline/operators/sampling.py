"""Seeded splits, samples and selections that do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_unit
from ..session import table


def grouped_split(rows: DataFrame, group: str, seed: int = 20180803, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """Each row's split; all rows of a group share it, and new groups move no others."""
    u = stable_unit(F.col(group), seed)
    return rows.withColumn("split", F.when(u < test, "test").when(u < test + val, "val").otherwise("train"))


def stratified(rows: DataFrame, stratum: str, key: str, k: int, seed: int) -> DataFrame:
    """At most k rows of each stratum, those of the least hash."""
    w = Window.partitionBy(stratum).orderBy(stable_unit(F.col(key), seed), key)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def round_robin(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """n rows, breadth before depth: the first of each group, then the second, and so on."""
    w = Window.partitionBy(group).orderBy(key)
    return rows.withColumn("depth", F.row_number().over(w)).orderBy("depth", group).limit(n)


def evenly_spaced(rows: DataFrame, key: str, k: int) -> DataFrame:
    """k rows at places floor(i n / k) in key order.

    Rows are dealt into ranges of the key and numbered within a range; only the ranges'
    sizes meet on the driver, so no task sorts all keys.
    """
    sorted_ = table(rows.withColumn("_k", F.col(key)).repartitionByRange("_k").withColumn("_range", F.spark_partition_id()))
    sizes = sorted(sorted_.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a range
    n, before, starts = sum(r.n for r in sizes), 0, []
    if n <= k:
        return sorted_.drop("_k", "_range")
    for r in sizes:
        starts.append((r["_range"], before, [i * n // k - before for i in range(k) if before <= i * n // k < before + r.n]))
        before += r.n
    wanted = rows.sparkSession.createDataFrame(starts, "_range int, _before long, _places array<long>").filter("size(_places) > 0")
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_k")) - 1
    out = sorted_.join(F.broadcast(wanted), "_range").withColumn("_n", place.cast("long"))
    return out.filter(F.array_contains("_places", F.col("_n"))).select(*rows.columns)


def positives_first(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """All positives before any negative, each in hash order, n rows in all."""
    return rows.orderBy(F.col("y").desc(), stable_unit(F.col(key), seed), key).limit(n)


#: Parts in which the first rows of a group are taken before they meet.
PARTS = 64


def first_rows(rows: DataFrame, order: list[Column], k: int, *groups: str) -> DataFrame:
    """The first k rows of each group with their place ``n``: of each of some parts first, then of what those leave, so a hot group is shared by many tasks."""
    part = rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
    for keys in ([*groups, "_part"], list(groups)):
        part = part.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("n") <= k)
    return part.drop("_part")


def first_values(rows: DataFrame, value: str, k: int, *groups: str) -> DataFrame:
    """groups, value: an array of the k least values of each group, in order."""
    return first_rows(rows, [F.col(value)], k, *groups).groupBy(*groups).agg(F.array_sort(F.collect_list(value)).alias(value))


def top_with_remainder(rows: DataFrame, group: str, by: str, key: str, k: int) -> DataFrame:
    """Per group the k greatest, re-numbered, with how many there were beyond."""
    top = first_rows(rows, [F.col(by).desc(), F.col(key)], k, group)
    size = rows.groupBy(group).agg(F.greatest(F.lit(0), F.count(F.lit(1)) - k).alias("remainder"))
    return top.join(size, group).withColumn("item", F.format_string("item-%02d", F.col("n")))


def whole_split(rows: DataFrame, group: str, seed: int = 20180803, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """Like grouped_split, but neither val nor test stays empty while train has more than one group: it gets the last of train's groups, the smallest by rows, of equals the last by name.

    Only names of groups with their sizes meet in one window.
    """
    g = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    g = grouped_split(g, group, seed, val, test)
    every = Window.partitionBy()
    have = {s: F.count_if(F.col("split") == s).over(every) for s in ("train", "val", "test")}
    last = F.row_number().over(Window.partitionBy("split").orderBy("n", F.desc(group)))
    g = g.withColumns({f"_{s}": c for s, c in have.items()}).withColumn("_last", last)
    need = (F.col("_val") == 0).cast("int") + (F.col("_test") == 0).cast("int")
    give = (F.col("split") == "train") & (F.col("_last") <= F.least(need, F.col("_train") - 1))
    to = F.when((F.col("_last") == 1) & (F.col("_val") == 0), "val").otherwise("test")
    g = g.select(group, F.when(give, to).otherwise(F.col("split")).alias("split"))
    return rows.join(g, group, "left")
