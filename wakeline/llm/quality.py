"""Quality by an interpolated modified Kneser-Ney model of word n-grams (pairs and single words).

The model is trained on trusted text and scores every document by its perplexity;
a document is rejected if that lies above a quantile of its language, taken over
trusted documents that the counts do not hold.

Counts: map tasks sum the word pairs of their own texts before anything is shuffled;
shards of pairs (by hash) add them up, and the lower order comes from the distinct
pairs (continuation counts, and for each first word how its followers are counted),
again by shards.  Scores: texts are gathered, compressed, in blocks of some megabytes; a
block asks each shard for its distinct pairs and words, the shards answer, and the
answers meet the texts in their block.  Asked keys travel sorted, as differences in
byte planes, which takes about three bytes each.  Large tables are scored in a few parts,
one after another, so that only a part's texts, questions and answers are on disk.  No count
passes through the driver (it sees sums of counts of counts), nothing that grows is
broadcast, and the number of shards grows with the text.

Words are hashed to 40 bits; in a shard, pairs are told apart by 40 bits, so with a
million pairs in a shard one question in a million gets another pair's count.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, brief_shuffles, chunks, cut, free, keyed, mix, row_sums, table, utf8, word_hashes

#: Text bytes that a task counts, or asks about, at once; of a shard; and that are hashed at once.
BLOCK_BYTES, SHARD_BYTES, HASHED_BYTES = 8 << 20, 32 << 20, 1 << 20
#: Parts in which texts are scored, and blocks that a part has at least.
PARTS, PART_BLOCKS = 3, 8
#: Trusted ids up to this many are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Of trusted documents, the share whose perplexities set the limits, not the counts.
HELD_OUT = 0.25
#: The quantile of a language's held-out documents, and how many documents the quantile of all languages counts for beside them.
QUANTILE, PRIOR = 0.995, 30
#: The log perplexity of a text of n words scatters by about SHORT / sqrt(n): limits are set, and held, with that allowance.
SHORT = 2.0
START, STOP = np.uint64(1), np.uint64(2)
_LOW40 = np.uint64((1 << 40) - 1)


def squeeze(values: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bytes as compressed byte planes."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def expand(blob: bytes, width: int) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = pa.Codec("zstd", 1).decompress(blob[8:], n * width, asbytes=True) if n else b""
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _gaps(keys: np.ndarray) -> bytes:
    """Sorted 40-bit keys."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)), 5)


def _keys(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob, 5), dtype=np.uint64)


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """40-bit word hashes of each row and a STOP after the last one, and row limits.  Case counts."""
    h, limits = word_hashes(col, False)
    h = (h >> np.uint64(24)) | np.uint64(4)  # never START or STOP
    return np.insert(h, limits[1:], STOP), limits + np.arange(len(limits))


def before(w: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The word before each word, START at the head of a row."""
    out = np.empty_like(w)
    out[1:] = w[:-1]
    out[limits[:-1]] = START
    return out


def place(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and 40-bit key of hashes."""
    return ((h >> np.uint64(40)) % np.uint64(shards)).astype(np.int64), h & _LOW40


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(h) + w)


def _by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _blocks(batches):
    """Lists of text columns of about BLOCK_BYTES."""
    held, size = [], 0
    for batch in batches:
        for part in chunks(batch, "text", HASHED_BYTES):
            n = part.column("text").nbytes
            if held and size + n > BLOCK_BYTES:
                yield held
                held, size = [], 0
            held.append(part.column("text"))
            size += n
    if held:
        yield held


_COUNTED = pa.schema([("shard", pa.int32()), ("h", pa.binary()), ("w", pa.binary()), ("c", pa.binary())])


def _sum_pairs(h, w, c):
    order = np.lexsort((w, h))
    h, w, c = h[order], w[order], c[order]
    heads = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])) if len(h) else np.zeros(0, int)
    return h[heads], w[heads], (np.add.reduceat(c, heads) if len(h) else c)


def _count(shards: int):
    """Distinct pairs of each block with their counts, packed by shard."""

    def run(batches):
        for block in _blocks(batches):
            parts = [_sum_pairs(before(*x), x[0], np.ones(len(x[0]), np.int64)) for x in map(words, block)]
            h, w, c = _sum_pairs(*(np.concatenate(x) for x in zip(*parts)))
            order, ends = _by_shard(place(pair_hash(h, w), shards)[0], shards)
            out = [[], [], [], []]
            for s in np.flatnonzero(np.diff(ends)):
                at = order[ends[s] : ends[s + 1]]
                for o, x in zip(out, (int(s), squeeze(h[at], 5), squeeze(w[at], 5), squeeze(c[at], 8))):
                    o.append(x)
            yield batch_of(_COUNTED, *out)

    return run


# kind 0: the shard's counts; 1: what a shard of pairs knows of some words; 2: how many numbers are 1, 2, 3, 4, and how many there are
_MODEL = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("data", pa.list_(pa.binary())), ("n", pa.list_(pa.int64()))])
_MODEL_SQL = "kind int, shard int, keys binary, data array<binary>, n array<long>"


def _spectrum(c: np.ndarray) -> list:
    return [*np.bincount(np.minimum(c, 5).astype(np.int64), minlength=6)[1:5].tolist(), len(c)]


def _merge(shards: int):
    """A shard of pairs: counts by key, and of each word its followers' counts and the words before it."""

    def run(key, t):
        h, w, c = (np.concatenate([expand(b, k) for b in t.column(n).to_pylist()]) for n, k in (("h", 5), ("w", 5), ("c", 8)))
        h, w, c = _sum_pairs(h, w, c)
        keys = place(pair_hash(h, w), shards)[1]
        order = np.argsort(keys)
        rows = [(0, key[0].as_py(), _gaps(keys[order]), [squeeze(c[order], 8)], []), (2, 0, None, [], _spectrum(c))]
        word, at = np.unique(np.concatenate([h, w]), return_inverse=True)
        first, last = at[: len(h)], at[len(h) :]
        sums = [np.bincount(last, minlength=len(word)), np.bincount(first, c, len(word)), *(np.bincount(first, x, len(word)) for x in (c == 1, c == 2, c > 2))]
        order, ends = _by_shard(place(mix(word), shards)[0], shards)
        for s in np.flatnonzero(np.diff(ends)):
            x = order[ends[s] : ends[s + 1]]
            rows.append((1, int(s), squeeze(word[x], 5), [squeeze(v[x].astype(np.uint64), 8) for v in sums], []))
        return pa.Table.from_batches([batch_of(_MODEL, *map(list, zip(*rows)))])

    return run


def _words(shards: int):
    """A shard of words: of each, the distinct words before it, and of its followers their sum and how many are counted once, twice, more."""

    def run(key, t):
        word = np.concatenate([expand(b, 5) for b in t.column("keys").to_pylist()])
        sums = [np.concatenate(x) for x in zip(*[[expand(b, 8) for b in blobs] for blobs in t.column("data").to_pylist()])]
        word, at = np.unique(word, return_inverse=True)
        sums = [np.bincount(at, x, len(word)).astype(np.uint64) for x in sums]
        keys = place(mix(word), shards)[1]
        order = np.argsort(keys)
        rows = [(0, key[0].as_py(), _gaps(keys[order]), [squeeze(x[order], 8) for x in sums], []), (2, 0, None, [], _spectrum(sums[0][sums[0] > 0]))]
        return pa.Table.from_batches([batch_of(_MODEL, *map(list, zip(*rows)))])

    return run


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """What is taken off a count of 0, 1, 2 and more (modified Kneser-Ney)."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))])


class Model:
    """Shards of pairs and of words as tables in the checkpoint folder, and the numbers that all of them share."""

    def __init__(self, trusted: DataFrame, shards: int):
        self.shards = shards
        counted = trusted.select("text").mapInArrow(_count(shards), "shard int, h binary, w binary, c binary")
        with brief_shuffles(trusted.sparkSession):
            self.pairs = table(counted.groupBy("shard").applyInArrow(_merge(shards), _MODEL_SQL))
            self.words = table(self.pairs.filter("kind = 1").groupBy("shard").applyInArrow(_words(shards), _MODEL_SQL))
        two, one = (self._sums(t) for t in (self.pairs, self.words))
        self.d2, self.d1 = discounts(*two[:4]), discounts(*one[:4])
        # of single words: the distinct pairs in all, the mass left to words never seen, and their number
        self.total, self.kinds = max(two[4], 1), one[4] + 1
        self.left = (self.d1[1] * one[0] + self.d1[2] * one[1] + self.d1[3] * (one[4] - one[0] - one[1])) / self.total if one[4] else 1.0

    @staticmethod
    def _sums(t: DataFrame) -> list:
        r = t.filter("kind = 2").agg(*[F.sum(F.col("n")[i]) for i in range(5)]).first()
        return [int(x or 0) for x in r]

    def numbers(self) -> tuple:
        return self.d2, self.d1, self.total, self.kinds, self.left

    def free(self) -> None:
        free(self.pairs, self.words)


def log_probabilities(numbers: tuple, c, seen_before, total, n1, n2, n3, before_total) -> np.ndarray:
    """Natural logarithms for pairs: their counts, the words before the second one, and what is known of the first one's followers."""
    d2, d1, every, kinds, left = numbers
    one = (seen_before - d1[np.minimum(seen_before, 3).astype(np.int64)]) / every + left / kinds
    kept = (d2[1] * n1 + d2[2] * n2 + d2[3] * n3) / np.maximum(before_total, 1)
    two = (c - d2[np.minimum(c, 3).astype(np.int64)]) / np.maximum(before_total, 1) + kept * one
    return np.log(np.where(before_total > 0, two, one))


_PACKED = pa.schema([("block", pa.int32()), ("rid", pa.binary()), ("size", pa.binary()), ("text", pa.binary())])
_PACKED_SQL = "block int, rid binary, size binary, text binary"


def _pack(blocks: int):
    """Compressed texts of a task's rows, one row for each block."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", BLOCK_BYTES):
                rid, texts = part.column("rid").to_numpy(zero_copy_only=False).astype(np.int64), part.column("text")
                order, ends = _by_shard((mix(rid.view(np.uint64)) % np.uint64(blocks)).astype(np.int64), blocks)
                out = [[], [], [], []]
                for b in np.flatnonzero(np.diff(ends)):
                    at = order[ends[b] : ends[b + 1]]
                    data, offs = utf8(texts.take(pa.array(at)))
                    for o, x in zip(out, (int(b), rid[at].tobytes(), np.diff(offs).tobytes(), pa.Codec("zstd", 1).compress(data.tobytes(), asbytes=True))):
                        o.append(x)
                yield batch_of(_PACKED, *out)

    return run


def _block(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row keys, words and limits of a block, in the order of the keys."""
    rids, parts = [], []
    for rid, size, text in zip(t.column("rid").to_pylist(), t.column("size").to_pylist(), t.column("text").to_pylist()):
        size = np.frombuffer(size, np.int64)
        offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        data = pa.Codec("zstd", 1).decompress(text, int(offs[-1]), asbytes=True) if offs[-1] else b""
        col = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data)])
        rids.append(np.frombuffer(rid, np.int64))
        parts += [words(p.column("text")) for p in chunks(pa.RecordBatch.from_arrays([col], ["text"]), "text", HASHED_BYTES)]
    rid, shift = np.concatenate(rids), np.cumsum([0, *(len(w) for w, _ in parts)])
    w = np.concatenate([w for w, _ in parts])
    limits = np.concatenate([[0], *(x[1:] + s for (_, x), s in zip(parts, shift))]).astype(np.int64)
    order = np.argsort(rid, kind="stable")
    n = np.diff(limits)[order]
    ends = np.concatenate([[0], np.cumsum(n)])
    take = np.arange(ends[-1]) + np.repeat(limits[:-1][order] - ends[:-1], n)
    return rid[order], w[take], ends


def _questions(w: np.ndarray, limits: np.ndarray, shards: int):
    """Distinct words and pairs of a block, in the order of shard and key: their places, limits by shard, and where each pair's words stand."""
    h = before(w, limits)
    word, at = np.unique(np.append(w, START), return_inverse=True)
    last = at[:-1]
    first = np.empty_like(last)
    first[1:] = last[:-1]
    first[limits[:-1]] = at[-1]
    pair, head, which = np.unique(pair_hash(h, w), return_index=True, return_inverse=True)
    out = []
    for x in (mix(word), pair):
        shard, key = place(x, shards)
        order = np.lexsort((key, shard))
        out.append((order, key[order], np.searchsorted(shard[order], np.arange(shards + 1))))
    return out, first[head], last[head], which


_ASKED = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("words", pa.binary()), ("pairs", pa.binary())])
_ANSWER = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("words", pa.list_(pa.binary())), ("pairs", pa.binary())])


def _ask(shards: int):
    def run(key, t):
        (_, wk, we), (_, pk, pe) = _questions(*_block(t)[1:], shards)[0]
        some = np.flatnonzero((np.diff(we) > 0) | (np.diff(pe) > 0)).tolist()
        keys = [(_gaps(wk[we[s] : we[s + 1]]), _gaps(pk[pe[s] : pe[s + 1]])) for s in some]
        return pa.Table.from_batches([batch_of(_ASKED, some, [key[0].as_py()] * len(some), [k for k, _ in keys], [k for _, k in keys])])

    return run


def _look_up(known: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), np.uint64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], np.uint64(0))


def _reply(key, asked: pa.Table, model: pa.Table) -> pa.Table:
    tables = {}
    for of, keys, data in zip(model.column("of").to_pylist(), model.column("keys").to_pylist(), model.column("data").to_pylist()):
        tables[of] = _keys(keys), [expand(b, 8) for b in data]
    none = np.zeros(0, np.uint64)
    word, sums = tables.get("words", (none, [none] * 5))
    pair, (count,) = tables.get("pairs", (none, [none]))
    out = []
    for batch in asked.to_batches():
        for r in batch.to_pylist():
            wk, pk = _keys(r["words"]), _keys(r["pairs"])
            replies = [squeeze(_look_up(word, s, wk), 8) for s in sums]
            out.append(batch_of(_ANSWER, [r["shard"]], [r["block"]], [replies], [squeeze(_look_up(pair, count, pk), 8)]))
    return pa.Table.from_batches(out, _ANSWER)


_SCORED = pa.schema([("rid", pa.int64()), ("n", pa.int64()), ("perplexity", pa.float64())])


def _score(shards: int, numbers: tuple):
    def run(key, texts, answers):
        rid, w, limits = _block(texts)
        ((wo, _, _), (po, _, _)), first, last, which = _questions(w, limits, shards)
        order = np.argsort(answers.column("shard").to_numpy())
        replies, counts = ([answers.column(c)[int(i)].as_py() for i in order] for c in ("words", "pairs"))
        known = np.empty((5, len(wo)))
        for j in range(5):
            known[j, wo] = np.concatenate([expand(r[j], 8) for r in replies])
        count = np.empty(len(po))
        count[po] = np.concatenate([expand(c, 8) for c in counts])
        total, n1, n2, n3 = known[1:, first]
        lp = log_probabilities(numbers, count, known[0, last], total, n1, n2, n3, total)
        n = np.diff(limits)
        return pa.Table.from_batches([batch_of(_SCORED, rid, n, np.exp(-row_sums(lp[which], limits) / n))])

    return run


def perplexities(rows: DataFrame, model: Model) -> DataFrame:
    """rid, n, perplexity of rows (rid, text not null); n counts words and the stop.  The result is read from tables of its own."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(PARTS, max(1, size // (BLOCK_BYTES * PART_BLOCKS)))
    blocks = max(1, -(-size // (BLOCK_BYTES * parts)))
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("rid")), F.lit(parts))
    with brief_shuffles(rows.sparkSession):
        return reduce(DataFrame.union, [table(_scored(rows.filter(part == i), model, blocks)) for i in range(parts)])


def _scored(rows: DataFrame, model: Model, blocks: int) -> DataFrame:
    packed = rows.select("rid", "text").mapInArrow(_pack(blocks), _PACKED_SQL)
    asked = packed.groupBy("block").applyInArrow(_ask(model.shards), "shard int, block int, words binary, pairs binary")
    shards = model.pairs.filter("kind = 0").withColumn("of", F.lit("pairs")).unionByName(model.words.filter("kind = 0").withColumn("of", F.lit("words")))
    reply = asked.groupBy("shard").cogroup(shards.select("shard", "of", "keys", "data").groupBy("shard")).applyInArrow(_reply, "shard int, block int, words array<binary>, pairs binary")
    return packed.groupBy("block").cogroup(reply.groupBy("block")).applyInArrow(_score(model.shards, model.numbers()), "rid long, n long, perplexity double")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", quantile: float = QUANTILE) -> DataFrame:
    """doc_id, perplexity, limit, rejected (and rid): one row for each row of docs.

    Trusted text: the documents whose label is 1.  A quarter of them, by id hash, are
    held out of the counts and set the limits.  With steady = log(perplexity) -
    SHORT / sqrt(words), a language's limit is the quantile of steady over its
    held-out documents, averaged with that of all of them (which counts for PRIOR
    documents); the null language is one of its own, and one without held-out
    documents has the limit of all.  A document is rejected if its steady lies above.
    Without trusted text nothing is rejected.  A null or empty text has no words and
    scores its stop alone; texts of any length are scored whole.  Null or repeated
    ids are rows of their own, trusted as their label says; ties share their limit.
    An empty table gives an empty result.
    """
    rows = keyed(docs, id_col, text=text_col, lang=lang_col).withColumn("text", F.coalesce("text", F.lit("")))
    good = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("id")).distinct()
    if good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    trusted = rows.join(good, "id", "left_semi").withColumn("held", F.pmod(F.xxhash64(F.lit("held out"), F.col("rid")), F.lit(1000)) < int(1000 * HELD_OUT))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = Model(trusted.filter("not held"), max(1, -(-size // SHARD_BYTES)))
    scored = perplexities(rows.select("rid", "text"), model)
    model.free()
    steady = F.log("perplexity") - SHORT / F.sqrt("n")
    known = trusted.filter("held").select("rid", "lang").join(scored, "rid").withColumn("steady", steady)
    q = F.percentile_approx("steady", F.lit(quantile), F.lit(10_000))
    overall = known.agg(q).first()[0]
    every = F.lit(None if overall is None else float(overall)).cast("double")
    limits = known.groupBy("lang").agg(q.alias("q"), F.count(F.lit(1)).alias("m"))
    limits = cut(limits.select(F.col("lang").alias("_lang"), ((F.col("q") * F.col("m") + every * PRIOR) / (F.col("m") + PRIOR)).alias("own")))
    meta = rows.select("rid", "id", "lang").join(scored, "rid")
    out = meta.join(F.broadcast(limits) if limits.limit(100_001).count() <= 100_000 else limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    limit = F.exp(F.coalesce("own", every) + SHORT / F.sqrt("n"))
    return out.select(F.col("id").alias("doc_id"), "perplexity", limit.alias("limit"), F.coalesce(F.col("perplexity") > limit, F.lit(False)).alias("rejected"), "rid")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(docs, labels).drop("rid")


QUERIES = {"op8_quality": op8_quality}
ORACLE_SQL: dict[str, str] = {}
