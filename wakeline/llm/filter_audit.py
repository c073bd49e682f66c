"""What five filters remove in every order, from counts of failure masks.

Exact copies are found by partition refinement.  Documents are split by their length
in code points, then by the hash of one block after another (each eight times as long
as all before it), and after each split documents that stand alone are dropped, so
later blocks concern ever fewer.  At the end the full texts that are left are compared,
and in each class all but the smallest id are marked.  The hashes of all blocks are
taken in one scan; a second scan reads the texts of what is left.

Then each document is a mask of the filters that it fails, and all 120 orders follow
from the 32 counts of a part: a step removes what fails its filter and none before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _IS_WORD, chunks, cut, free, prepare, row_sums, sorted_distinct, table, utf8, word_codes, word_spans

#: Code points of the first block; each block ends at eight times the end of the one before.
BLOCK, GROWTH = 256, 8
_ENDS = [0] + [BLOCK * GROWTH**i for i in range(9)]  # no text reaches beyond
#: Classes up to this many are broadcast; more are joined by a shuffle.
BROADCAST_CLASSES = 500_000
LETTERS = "ABCDE"
FULL = 1 << len(LETTERS)


_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_ODD = np.array([chr(b) in "#$%&*|" for b in range(256)])
_POINT = np.array([b & 0xC0 != 0x80 for b in range(256)])


def failures(text: pa.Array) -> np.ndarray:
    """Bits 0 to 3 of each text: under 200 words; under half of the words different; over 2 % A-Z; any of ``#$%&*|``."""
    data, offs = utf8(text)
    starts, ends, limits = word_spans(data, offs)
    code, words = word_codes(data[_IS_WORD[data]], starts, ends)
    n, size = np.diff(limits), max(len(words), 1)
    different = np.bincount(sorted_distinct(np.repeat(np.arange(len(text)), n) * size + code) // size, minlength=len(text))
    upper, points, odd = (row_sums(kind[data].astype(np.int64), offs) for kind in (_UPPER, _POINT, _ODD))
    return (n < 200) + 2 * (100 * different < 50 * n) + 4 * (100 * upper > 2 * points) + 8 * (odd > 0)


def _failing(batches):
    """Batches whose column text gives way to fails."""
    for batch in batches:
        for part in chunks(batch, "text"):
            fails = pa.array(failures(part.column("text")), pa.int32())
            yield part.drop_columns("text").append_column("fails", fails)


def _blocks(text: Column, digest: Callable[..., Column]) -> Column:
    """The hashes of the blocks of a text."""
    n = F.length(text)
    return F.array_compact(F.array(*[F.when(n > lo, digest(F.substr(text, F.lit(lo + 1), F.lit(min(hi, 2**31 - 1) - lo)))) for lo, hi in zip(_ENDS, _ENDS[1:])]))


def _class(text: Column, digest: Callable[..., Column]) -> Column:
    """The class of a text after its length and all blocks."""
    return F.aggregate(_blocks(text, digest), F.length(text).cast("long"), lambda key, block: digest(key, block))


def _few(keys: DataFrame) -> DataFrame:
    """A cut list of classes, broadcast up to a checked number."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES else keys


def refined(rows: DataFrame, digest: Callable[..., Column] = F.xxhash64) -> list[DataFrame]:
    """rows (n, blocks: the hashes of all blocks, and others) that share their length and all blocks with another, as tables, with their class ``key``."""
    done, left, at = [], rows.withColumn("key", F.col("n")), 0
    while True:
        shared = _few(left.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"))
        alike = table(left.join(shared, "key", "left_semi"))
        free(left)
        whole = F.size("blocks") <= at
        done.append(alike.filter(whole))
        if not alike.filter(~whole).limit(1).count():
            return done
        left = alike.filter(~whole).withColumn("key", digest("key", F.get("blocks", F.lit(at))))
        at += 1


def copies(docs: DataFrame, facts: DataFrame, digest: Callable[..., Column]) -> DataFrame:
    """The rows of facts (id, text's n and blocks, and others) whose text is that of a smaller id; docs has id and text."""
    alike = reduce(DataFrame.unionByName, refined(facts, digest))
    classes = _few(alike.select("key").distinct())
    texts = docs.select("id", "text", _class(F.col("text"), digest).alias("key")).join(classes, "key", "left_semi")
    same = texts.groupBy("key", "text").agg(F.min("id").alias("first"))
    by_class = cut(same.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first")))
    later = lambda df: df.filter(F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first"))))
    sure = by_class.filter("texts = 1").select("key", "first")
    if sure.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES:
        sure = F.broadcast(sure)
    out = later(alike.join(sure, "key"))
    mixed = by_class.filter("texts > 1").select("key")
    if mixed.limit(1).count():  # one hash for different texts: told apart by the texts themselves
        some = docs.withColumn("key", _class(F.col("text"), digest)).join(mixed, "key", "left_semi")
        first = some.groupBy("key", "text").agg(F.min("id").alias("first"))
        out = out.select("id", "part", "fails").unionByName(_with_fails(later(some.join(first, ["key", "text"])).select("id", "part", "text")))
    return out.select("id", "part", "fails")


def _with_fails(docs: DataFrame) -> DataFrame:
    kept = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(_failing, T.StructType([*kept, T.StructField("fails", T.IntegerType())]))


def _sums(masks: DataFrame) -> DataFrame:
    return masks.groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", digest: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """part, mask (bits of LETTERS), n, good, toxic of all documents."""
    text, source = F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))
    docs = docs.select(F.col(id_col).alias("id"), text.alias("text"), source.alias("part"))
    facts = docs.select("id", "part", "text", F.length("text").cast("long").alias("n"), _blocks(F.col("text"), digest).alias("blocks"))
    facts = table(_with_fails(facts))
    again = cut(copies(docs, facts, digest))
    one = lambda c: F.max((F.col(c) == 1).cast("int"))
    labels = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    told = lambda df: _sums(df.select("id", "part", "fails").join(labels, "id", "left").select("part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
    copied = told(again)
    flip = copied.select("part", F.col("fails"), *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    out = told(facts).union(flip).union(copied.select("part", F.col("fails") + 16, "n", "good", "toxic"))
    return cut(out.groupBy("part", F.col("fails").alias("mask")).agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]))


def by_order(counts: DataFrame) -> DataFrame:
    """The steps of all orders of the filters, for each part of mask_counts."""
    one = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("m"))  # 32 entries at most
    every = F.sequence(F.lit(0), F.lit(FULL - 1))
    each = lambda c: F.transform(every, lambda k: F.coalesce(F.try_element_at("m", k)[c], F.lit(0).cast("long"))).alias(c)
    one = cut(one.select("part", *[each(c) for c in ("n", "good", "toxic")]))
    # what is left after the filters of a set, in any order
    left = lambda c: F.transform(every, lambda s: F.aggregate(F.filter(every, lambda k: k.bitwiseAND(s) == 0), F.lit(0).cast("long"), lambda a, k: a + F.get(F.col(c), k)))
    one = one.select("part", F.col("n"), *[left(c).alias(f"left_{c}") for c in ("n", "good", "toxic")])
    size = len(LETTERS)
    share = lambda i: sum(factorial(s.bit_count()) * factorial(size - 1 - s.bit_count()) * (F.col("left_n")[s] - F.col("left_n")[s | 1 << i]) for s in range(FULL) if not s >> i & 1)
    one = cut(one.withColumn("shares", F.array(*[share(i) for i in range(size)])))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    steps = one.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.array(*[F.lit(i + 1) for i in range(size)])))
    bit = lambda at: F.pow(F.lit(2), F.ascii(F.substr("filter_order", at, F.lit(1))) - 65).cast("int")
    before = F.aggregate(F.filter(F.array(*[F.lit(i + 1) for i in range(size)]), lambda i: i < F.col("step")), F.lit(0), lambda a, i: a + bit(i))
    steps = steps.withColumn("bit", bit(F.col("step"))).withColumn("before", before).withColumn("after", F.col("before") + F.col("bit"))
    gone = lambda c: F.get(F.col(f"left_{c}"), "before") - F.get(F.col(f"left_{c}"), "after")
    fails = F.get("left_n", F.lit(0)) - F.get("left_n", F.col("bit"))
    return steps.select(
        "part", "filter_order", "step", F.get("left_n", F.col("after")).alias("kept"), gone("n").alias("removed"), (fails - gone("n")).alias("redundant"), F.get("n", F.col("bit")).alias("unique_fails"),
        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.get("shares", F.ascii(F.substr("filter_order", "step", F.lit(1))) - 65).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", digest: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each source.

    A null text is empty and fails only the first filter, and the last if another empty
    text has a smaller id; a null source is part ''.  Rows of one id count each; equal
    texts of one id are no copies of each other, and a null id is larger than all.  Of
    an id labelled more than once any 1 counts.  Other columns are not read, long texts
    are compared whole, and an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    return by_order(mask_counts(docs, labels, id_col, digest))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
             coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false)] AS b FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, b, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x(i) AS (FROM range(1, 6)),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, x.i AS step, o[x.i] AS f, o[1:x.i - 1] AS past FROM o, x),
r AS (SELECT part, o, step, f,
  sum(n) FILTER (NOT b[f] AND len(list_filter(past, lambda k: b[k])) = 0) AS kept,
  sum(n) FILTER (b[f] AND len(list_filter(past, lambda k: b[k])) = 0) AS removed,
  sum(n) FILTER (b[f] AND len(list_filter(past, lambda k: b[k])) > 0) AS redundant,
  sum(n) FILTER (b[f] AND len(list_filter(b, lambda k: k)) = 1) AS unique_fails,
  sum(good) FILTER (b[f] AND len(list_filter(past, lambda k: b[k])) = 0) AS good_lost,
  sum(toxic) FILTER (b[f] AND len(list_filter(past, lambda k: b[k])) = 0) AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda k: chr((64 + k)::INT)), '') AS filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""
QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLE_SQL = {"op12_filter_audit": ORACLE}
