"""How the sources of a language differ in their terms, from dense matrices over blocks of terms.

Counts of (language, source, term) are made in one scan.  The kept terms of a language
are dealt into blocks, and its sources, where they are many, into tiles.  One task takes
one block for one pair of tiles: a dense int64 matrix of sources by terms, filled with
the exact smoothed shares.  Numpy broadcasting compares all pairs of its sources over
slices of the terms and gives one partial sum a pair; partial sums of all blocks are
added.  The same task keeps a heap of the strongest terms of each source, and heaps of
all blocks are merged.  Neither a matrix nor a heap grows with the text.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _LOWER, chunks, cut, free, prepare, sorted_distinct, table, utf8, word_codes, word_spans

LEAST_DOCS, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
#: Terms of a block on average, and sources of a tile.
BLOCK_TERMS, TILE = 512, 128
#: Languages up to this many are broadcast; more are joined by a shuffle.
BROADCAST_LANGS = 100_000
#: Blocks whose heaps meet first.
MERGE_BLOCKS = 64
#: Bytes of terms: ASCII letters and all bytes of other characters.
LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("occ", pa.int64()), ("docs", pa.int64())])


def _term_counts(batches):
    """Occurrences and documents of each group's terms in a chunk; an empty term stands for the group itself."""
    for batch in batches:
        for part in chunks(batch, "text"):
            data, offs = utf8(part.column("text"))
            starts, ends, limits = word_spans(data, offs, LETTER)
            code, terms = word_codes(_LOWER[data[LETTER[data]]], starts, ends)
            size = max(len(terms), 1)
            lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
            wide = max(len(source.dictionary), 1)
            group = lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy()
            doc = np.repeat(np.arange(part.num_rows, dtype=np.int64), np.diff(limits))
            key, occ = np.unique(group[doc] * size + code, return_counts=True)
            in_doc = sorted_distinct(doc * size + code)
            _, docs = np.unique(group[in_doc // size] * size + in_doc % size, return_counts=True)
            own, rows = np.unique(group, return_counts=True)
            g = np.concatenate([key // size, own])
            term = pa.concat_arrays([terms.take(pa.array(key % size)).cast(pa.string()), pa.array([""] * len(own), pa.string())])
            named = [lang.dictionary.take(pa.array(g // wide)).cast(pa.string()), source.dictionary.take(pa.array(g % wide)).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*named, term, pa.array(np.concatenate([occ, 0 * own])), pa.array(np.concatenate([docs, rows]))], schema=_COUNTS)


def shares(counts: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly: three digits at a time, so no product leaves 64 bits."""
    whole, rest, out = total + PRIOR * terms, counts + PRIOR, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def distances(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of all rows of one and two, by broadcasting over slices."""
    out = np.zeros((len(one), len(two)), np.int64)
    for a in range(0, len(one), 16):
        for t in range(0, one.shape[1], 256):
            out[a : a + 16] += np.abs(one[a : a + 16, None, t : t + 256] - two[None, :, t : t + 256]).sum(2)
    return out


def _strongest(items: list[bytes], values: np.ndarray, top: int) -> list[tuple[int, bytes]]:
    """The first ``top`` of (-value, item), from a heap; values below the last of them are left out before."""
    least = np.partition(values, len(values) - top)[len(values) - top] if len(values) > top else 0
    return heapq.nsmallest(top, [(-int(values[i]), items[i]) for i in np.flatnonzero(values >= least)])


_CELL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("block", pa.int64()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _cell(top: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """One block of terms for the sources of one tile, or of two."""
        lang, block, i, j = (k.as_py() for k in key)
        names, tile = right.column("source").to_pylist(), right.column("tile").to_numpy()
        row = {s: r for r, s in enumerate(names)}
        terms = left.column("term").combine_chunks().dictionary_encode()
        if isinstance(terms, pa.ChunkedArray):
            terms = terms.combine_chunks()
        items = [t.encode() for t in terms.dictionary.to_pylist()]
        occ, code = np.zeros((len(names), len(items)), np.int64), terms.indices.to_numpy()
        occ[np.array([row[s] for s in left.column("source").to_pylist()], int), code] = left.column("occ").to_numpy()
        total, kept, of_lang = (right.column(c).to_numpy().astype(np.int64)[:, None] for c in ("total", "kept", "lang_total"))
        p = shares(occ, total, kept) if len(items) else occ
        a, b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        d = distances(p[a], p[b])
        # terms of the block that none of these sources has
        if unseen := int(right.column("in_block")[0].as_py()) - len(items):
            zero = shares(np.zeros_like(total), total, kept)
            d += unseen * np.abs(zero[a] - zero[b].T)
        x, y = np.nonzero(np.triu(np.ones(d.shape, bool), 1)) if i == j else np.nonzero(np.ones(d.shape, bool))
        out = [(names[a[r]], "pair", names[b[c]], int(d[r, c])) for r, c in zip(x, y)]
        if i == j and len(items):
            both = np.zeros(len(items), np.int64)
            both[code] = left.column("lang_occ").to_numpy()
            more = p - shares(both[None, :], of_lang[:1], kept[:1])
            for r, s in enumerate(names):
                at = np.flatnonzero((occ[r] > 0) & (more[r] > 0))
                out += [(s, "term", item.decode(), -v) for v, item in _strongest([items[k] for k in at], more[r, at], top)]
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.Table.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(cols[0], pa.string()), pa.array([block] * len(out), pa.int64()), *[pa.array(c, t) for c, t in zip(cols[1:], (pa.string(), pa.string(), pa.int64()))]], schema=_CELL)

    return run


def _merge(top: int):
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("block", pa.int64()), ("item", pa.string()), ("value", pa.int64()), ("rank", pa.int32())])

    def run(t: pa.Table) -> pa.Table:
        """The heaps of one group brought together."""
        best = heapq.nsmallest(top, zip((-v for v in t.column("value").to_pylist()), (s.encode() for s in t.column("item").to_pylist())))
        n = len(best)
        same = lambda c: pa.array([t.column(c)[0].as_py()] * n, schema.field(c).type)
        return pa.Table.from_arrays([same("lang"), same("source"), same("block"), pa.array([s.decode() for _, s in best], pa.string()), pa.array([-v for v, _ in best], pa.int64()), pa.array(range(1, n + 1), pa.int32())], schema=schema)

    return run


def _by_lang(df: DataFrame, langs: DataFrame) -> DataFrame:
    return df.join(F.broadcast(langs) if langs.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS else langs, "lang")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block_terms: int = BLOCK_TERMS, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: the distance of a source to each other source of its language; part
    ``term``: the terms that a source uses more than its language, the first ``top`` of
    them.  Ranks are by value, then by the item's bytes.  Null text, language and source
    are empty ones, and empty strings are a language or a source like any other.  Rows
    count one by one, whatever their ids; other columns are not read, long texts are
    counted whole, and an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    text = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = table(text.mapInArrow(_term_counts, "lang string, source string, term string, occ long, docs long").groupBy("lang", "source", "term").agg(F.sum("occ").alias("occ"), F.sum("docs").alias("docs")))
    kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("occ").alias("lang_occ")).filter(F.col("docs") >= least_docs).drop("docs")
    used = table(counts.select("lang", "source", "term", "occ").join(kept, ["lang", "term"]))
    # one row a source, numbered within its language
    groups = counts.filter("term = ''").select("lang", "source").join(used.groupBy("lang", "source").agg(F.sum("occ").alias("total")), ["lang", "source"], "left")
    groups = groups.withColumn("total", F.coalesce("total", F.lit(0))).withColumn("tile", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / F.lit(tile)).cast("long"))
    groups = cut(groups)
    terms = used.select("lang", "term").distinct()
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), (F.max("tile") + 1).alias("tiles")).join(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    langs = cut(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / F.lit(block_terms)))))
    pairs = lambda df: df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
    of_block = F.pmod(F.xxhash64("term"), "blocks").alias("block")
    tiles = groups.select("lang", "source", "tile")
    left = used.join(tiles if groups.limit(BROADCAST_LANGS + 1).count() > BROADCAST_LANGS else F.broadcast(tiles), ["lang", "source"])
    left = pairs(_by_lang(left, langs.select("lang", "tiles", "blocks"))).select("lang", of_block, "i", "j", "source", "term", "occ", "lang_occ")
    sizes = _by_lang(terms, langs.select("lang", "blocks")).groupBy("lang", of_block).agg(F.count(F.lit(1)).alias("in_block"))
    right = pairs(_by_lang(groups, langs)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(sizes, ["lang", "block"], "left")
    right = right.select("lang", "block", "i", "j", "source", "tile", "total", "kept", "lang_total", F.coalesce("in_block", F.lit(0)).alias("in_block"))
    cell = ["lang", "block", "i", "j"]
    found = table(left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(top), "lang string, source string, block long, part string, item string, value long"))
    half = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = half.union(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    heaps = found.filter("part = 'term'").withColumn("block", F.floor(F.col("block") / MERGE_BLOCKS))
    for last in (False, True):  # heaps of some blocks, then of all
        heaps = (heaps.withColumn("block", F.lit(0).cast("long")) if last else heaps).groupBy("lang", "source", "block").applyInArrow(_merge(top), "lang string, source string, block long, item string, value long, rank int")
    free(counts)
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank")).unionByName(heaps.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
u AS (SELECT n, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
o AS MATERIALIZED (SELECT lang, source, term, count(*) AS occ, count(DISTINCT n) AS docs FROM u GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(occ) AS occ FROM o GROUP BY ALL HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(occ) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT o.lang, o.source, sum(o.occ) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(o.occ, 0) AS occ, 1 + (1000000000::HUGEINT * (coalesce(o.occ, 0) + 5)) // (coalesce(s.n, 0) + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.occ + 5)) // (v.n + 5 * v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
w AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(w.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE occ > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= 50
"""
QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLE_SQL = {"op13_source_divergence": ORACLE}
