"""From raw documents to training shards: five stages, each an operator of wakeline.llm.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as
Parquet and read again as the next stage's docs.  All stages but the last return the
columns of documents.  Stages decide by row: null and repeated ids, null and empty
texts, very long texts and empty tables are handled as the operators say, and no row
falls with another because they share an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.llm.common import free, table
from wakeline.llm.decontamination import decontaminate
from wakeline.llm.minhash import near_duplicates
from wakeline.llm.mixing import mix
from wakeline.llm.quality import quality
from wakeline.llm.sharding import shard

SHARDS = 24
#: The mix draws by hashes of this seed.
SEED = 7
#: Rows to drop up to this many are broadcast as ids; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _with_key(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with a key ``_row`` of each row, and whether that is doc_id; else rows are numbered by doc_id and text, nulls last."""
    if isinstance(docs.schema["doc_id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        if not docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count():
            return docs.withColumn("_row", F.col("doc_id").cast("long")), True
    order = F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last()
    return table(docs.orderBy(*order).withColumn("_row", F.monotonically_increasing_id())), False


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """rows without those whose key an operator, run with the key as id, returned in dropped."""
    dropped = table(dropped.select(F.col("doc_id").alias("_row")))
    if dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return rows.join(dropped, "_row", "left_anti").drop("_row")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject; a label counts for every row of its id."""
    rows, is_id = _with_key(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    labels = labels.withColumnRenamed("doc_id", "_row") if is_id else labels.join(rows.select("doc_id", "_row"), "doc_id").select("_row", "quality")
    return _without(rows, quality(rows, labels, id_col="_row").filter("rejected"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    rows, _ = _with_key(docs)
    return _without(rows, near_duplicates(rows, k=5, id_col="_row").filter("not kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows, _ = _with_key(docs)
    return _without(rows, decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row").filter("contaminated"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, as often as it takes them (once or twice); rows of one id, or without one of one text, together."""
    kept = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)]
    mixed = mix(docs, seed=SEED, carry=tuple(docs.columns))
    # rows without words weigh nothing in the mix and stay once
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("int")
    copies = F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), times)
    return mixed.withColumn("_copy", F.explode(copies)).select(*kept)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and source of every row."""
    return shard(docs, SHARDS)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

ORACLE_SQL = None  # the first two stages cannot be stated in SQL; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, table(stage(spark, docs, sf_dir))
        free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
