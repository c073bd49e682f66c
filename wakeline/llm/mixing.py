"""Mixing sources to target weights by hash-threshold histograms.

Every row has a uniform 60-bit hash.  Sizes are summed by source and leading hash
bits; the bucket in which a source's budget ends is found by running sums over at
most 4096 buckets, and only the rows of that bucket are summed again by the next
bits, until one hash value is left.  A row is taken iff its hash lies below the
threshold of its source: no sort of rows, and a larger budget takes a superset.
Sums combine on the map side, so a source with a third of all rows costs no more
than another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_REGEX, cut

BITS, LEVELS = 12, 5
#: Thresholds are broadcast up to this many sources; beyond that they are joined by a shuffle.
BROADCAST_SOURCES = 100_000
WEIGHTS = (5, 2, 1)


def word_count(text):
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def hash60(seed: int, id_col, text_col):
    """A uniform number of 60 bits from the row's id; rows without id take it from the text."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text_col, F.lit(""))))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float, most: float, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, target: one row for each source.

    Weights follow the sources in code-point order, null last.  What a source's cap
    (``most`` times its size) leaves over goes to the others by weight until none is
    above its cap: with sources in the order of cap / weight, the first k are capped
    and the rest share the remainder by weight.  Works on one row a source.
    """
    # grouped sums only: the number of sources, not of rows, goes through the windows
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("rn", F.row_number().over(order))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "rn")
    every = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest_w", F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("rest_w"))
        # the first source that does not reach its cap sets the level for all after it
        .withColumn("free", F.col("level") * F.col("w") < F.col("cap"))
    )
    level = F.min_by("level", F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("rn")))).over(every)
    s = s.withColumn("final", level)
    return s.select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("w"))).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """source, passes, below: a row of the source is taken passes times, once more if its hash < below."""
    base = goals.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    base = base.withColumn("need", F.col("target") - F.col("passes") * F.col("source_size"))
    state = cut(base.select("source", "passes", "need", F.lit(0).cast("long").alias("lo")))
    for level in range(LEVELS):
        width = 1 << (60 - BITS * (level + 1))
        span = width << BITS
        rows = sizes.filter("size > 0")
        if level:
            rows = _with(rows, state.select("source", "lo"), "inner").filter((F.col("h") >= F.col("lo")) & (F.col("h") < F.col("lo") + span))
        sums = rows.groupBy("source", F.floor(F.col("h") / F.lit(width)).cast("long").alias("b")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
        run = Window.partitionBy("source").orderBy("b")
        # at most 4096 rows a source here, whatever the number of documents
        sums = sums.withColumn("upto", F.sum("s").over(run)).join(state.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src")))
        edge = sums.filter((F.col("upto") - F.col("s") <= F.col("need")) & (F.col("upto") > F.col("need")))
        found = edge.groupBy("source").agg(F.min(F.struct("b", (F.col("upto") - F.col("s")).alias("under"), "s", "n")).alias("e"))
        state = (
            state.join(found.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src")), "left")
            .select(
                "source", "passes",
                F.when(F.col("e").isNull(), F.col("need")).otherwise(F.col("need") - F.col("e.under")).alias("need"),
                # no edge: the budget covers all that is left, so the threshold is the end of the span
                F.when(F.col("e").isNull(), F.col("lo") + F.lit(0)).otherwise(F.col("e.b") * F.lit(width)).alias("lo"),
                F.col("e.s").alias("s"), F.col("e.n").alias("n"),
            )
        )
        state = cut(state)
        if level == LEVELS - 1 or not state.filter("n > 1").limit(1).count():
            break  # one hash value is left on each edge, or one row
        state = state.select("source", "passes", "need", "lo")
    # the row on the edge is taken if that comes nearer to the target
    width = 1 << (60 - BITS * (level + 1))
    return state.select("source", "passes", F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, F.col("lo")).otherwise(F.col("lo") + F.when(F.col("need") * 2 >= F.col("s"), F.lit(width)).otherwise(F.lit(0))).alias("below"))


def _with(rows: DataFrame, by_source: DataFrame, how: str) -> DataFrame:
    """Join a table of one row a source: broadcast if that table is small, else by a shuffle that AQE can split."""
    right = by_source.withColumnRenamed("source", "_source")
    if right.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    return rows.join(right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: int = 7, size=word_count, carry: tuple = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, h, and the ``carry`` columns as _c0, _c1, ...: what the mix takes of each row of docs.

    ``taken`` is 0, size or 2 * size (``most`` bounds the repeats).  A null text has
    size 0, a null source is a source of its own (last in order); rows that share an
    id (or, without id, a text) share a hash and are taken or left together; an empty
    table gives an empty result.  A single row's size is the granularity: a source
    ends within half a row of its target.
    """
    known = [F.col(id_col).alias("doc_id"), size(F.col(text_col)).alias("size"), F.col(source_col).alias("source"), hash60(seed, F.col(id_col), F.col(text_col)).alias("h")]
    rows = cut(docs.select(*known))
    goals = cut(targets(rows, share, most, weights))
    limits = thresholds(rows, goals).join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    kept = [f"_c{i}" for i in range(len(carry))]
    # whole rows are not checkpointed: they are read again
    out = _with(docs.select(*known, *[F.col(c).alias(k) for c, k in zip(carry, kept)]) if carry else rows, cut(limits), "left")
    taken = F.col("size") * (F.col("passes") + (F.col("h") < F.col("below")).cast("long"))
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"), "source", "h", *kept)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source", "h")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, source,
         ('0x' || substr(md5('7:' || doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS rn
  FROM d GROUP BY source),
b AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE AS budget FROM s),
f AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM b),
l AS (SELECT min_by(level, row(cap / w, rn)) AS level FROM f WHERE level * w < cap),
t AS (
  SELECT source, source_size, CASE WHEN l.level IS NULL THEN cap ELSE least(cap, l.level * w) END AS target
  FROM f, l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
c AS (
  SELECT d.*, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS need,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS upto,
         sum(size) OVER (PARTITION BY d.source, h)::DOUBLE AS own
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * (passes + CASE WHEN upto <= need OR (upto - own <= need AND 2 * (need - (upto - own)) >= own AND need > 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
QUERIES = {"op5_mixing": op5_mixing}
ORACLE_SQL = {"op5_mixing": ORACLE}
