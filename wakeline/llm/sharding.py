"""Sharding by proportional stratified interleaving.

Rows of each source are ranked in a seeded shuffle; all rows are then sorted by
fractional rank (rank - 1/2) / rows of the source, and the sorted sequence is cut
into shards of equal counts, so each shard holds every source in the proportion of
the whole.  Both ranks come from a distributed sort: a row's rank is its place in its
sorted partition plus the rows of the partitions before it, so no task orders a whole
source, a source of one row each costs nothing, and rows that are equal in all that
orders them are told apart by a number of their own and spread over partitions as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut
from .mixing import hash60

#: Sources up to which their sizes are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def _ranked(rows: DataFrame, order: list) -> DataFrame:
    """Add ``rank`` (from 0): the place of a row in the order given, which leaves no ties."""
    done = cut(rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    done = done.withColumn("_part", F.shiftright("_place", 33))
    counts = done.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row a partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.col("_place") - F.shiftleft("_part", 33)
    return done.join(F.broadcast(before), "_part").withColumn("rank", inside + F.col("_before")).drop("_place", "_part", "_before")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, carry: tuple = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source (and the ``carry`` columns), one row for each row of docs.

    law ``rows``: shard counts differ by at most one; slots run from 0 without gaps.
    size: UTF-8 bytes of the text plus 8; a null text has no bytes and the checksum
    of the empty string.  A null source is a source of its own.  Ties in the shuffle
    hash (repeated rows, null ids) are broken by id, then checksum and size, so reruns
    agree up to rows that are equal in all of these.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.col(source_col).alias("source"), hash60(seed, F.col(id_col), F.col(text_col)).alias("h"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
    )
    # equal rows stay apart by a number of their own, which is fixed by the checkpoint
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    ties = ["h", F.col("doc_id").asc_nulls_last(), "text_crc32", "size", "row"]
    total = rows.count()
    # 1. the rank of each row in the shuffle of its source
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("in_source"))
    by_source = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)  # one row a source
    firsts = cut(sizes.withColumn("rows_before", F.coalesce(F.sum("in_source").over(by_source), F.lit(0))).withColumnRenamed("source", "_s"))
    small = firsts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    ranked = _ranked(rows, [F.col("source").asc_nulls_last(), *ties])
    ranked = ranked.join(F.broadcast(firsts) if small else firsts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # 2. the place of each row by fractional rank
    frac = (F.col("rank") - F.col("rows_before") + F.lit(0.5)) / F.col("in_source")
    placed = _ranked(ranked.withColumn("frac", frac).drop("rank", "rows_before", "in_source"), ["frac", F.col("source").asc_nulls_last(), *ties])
    pos = F.col("rank")
    placed = placed.withColumn("shard", F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)"))
    first = F.ceil(F.col("shard") * F.lit(total) / F.lit(shards)).cast("long")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (pos - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "source", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, **names) -> None:
    """Write all columns of docs as Parquet, a folder for each shard, rows in slot order."""
    out = shard(docs, shards, carry=tuple(docs.columns), **names)
    keep = [f"_c{i}" for i in range(len(docs.columns))]
    out = out.toDF("_id", "_size", "_crc", "_law", "_shard", "_slot", "_grown", "_source", *keep)
    final = out.select(F.col("_shard").alias("shard"), "_slot", *[F.col(k).alias(f"doc_{c}") for k, c in zip(keep, docs.columns)])
    final.repartition(shards, "shard").sortWithinPartitions("shard", "_slot").drop("_slot").write.partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_sharding": op3_sharding}
ORACLE_SQL: dict[str, str] = {}  # no crc32 in SQL; tests hold it against a brute-force version
