"""Benchmark decontamination by SimHash windows and multi-index Hamming search.

A benchmark item of L words is compared with every window of L words of every
document (the whole document if that is shorter).  Windows and items have SimHash
fingerprints of 64 bits over their 5-word shingles, weighted by how often each
occurs.  Fingerprints are cut into seven blocks; two that differ in at most 20 bits
differ in at most 2 bits of some block, so looking up every block value within 2
bits finds all items within the radius.  Those candidates are verified by the exact
weighted similarity (sum of least over sum of greatest shingle counts).

A window that has no shingle of an item has similarity 0 to it, so fingerprints are
made only for windows around shingles of the benchmark; the windows cover whole
texts.  The benchmark is broadcast in blocks of items of a fixed size; documents are
searched where they were read, without a shuffle.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import batch_of, chunks, cut, keyed, mix, prepare, shingles, table, word_hashes

K, SIMILARITY, RADIUS = 5, 0.8, 20
BLOCKS = (10, 9, 9, 9, 9, 9, 9)
#: Items in one broadcast; a larger benchmark takes more passes.
ITEMS = 20_000


def fingerprint_planes(h: np.ndarray) -> np.ndarray:
    """For each shingle 64 votes of +1 or -1, by the bits of a hash of it."""
    bits = np.unpackbits(mix(h ^ np.uint64(0xA0761D6478BD642F)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def fingerprints(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def _near_masks(bits: int, reach: int) -> np.ndarray:
    """All values of so many bits with at most ``reach`` bits set."""
    v = np.arange(1 << bits)
    return v[np.bitwise_count(v) <= reach]


class ItemIndex:
    """Fingerprints of a block of items, by length in words and by the value of each block of bits."""

    def __init__(self, ids: list, texts: list):
        h, limits = word_hashes(pa.array([t or "" for t in texts], pa.string()))
        words = np.diff(limits)
        s, ends = shingles(h, limits, K)
        use = np.flatnonzero(words > 0)
        self.ids = [ids[i] for i in use]
        self.words = words[use]
        # an item below K words is one shingle of its own length, which a window is or is not
        self.short: dict[int, tuple[np.ndarray, dict]] = {}
        for n in range(1, K):
            of = np.flatnonzero(self.words == n)
            if len(of):
                whole, last = shingles(h, limits, n)
                named: dict[int, list] = {}
                for i in of.tolist():
                    named.setdefault(int(whole[last[use[i]]]), []).append(i)
                self.short[n] = np.array(sorted(named), np.uint64), named
        self.counts = [Counter(s[ends[i] : ends[i + 1]].tolist()) for i in use]
        self.size = np.array([sum(c.values()) for c in self.counts], np.int64)
        self.prints = np.array([fingerprints(fingerprint_planes(s[ends[i] : ends[i + 1]]).sum(0, keepdims=True))[0] for i in use], np.uint64)
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *[s[ends[i] : ends[i + 1]] for i in np.flatnonzero(words >= K)]]))
        # for each shingle, the item lengths (words) for which its windows matter
        lengths: dict[int, set] = {}
        for i, c in enumerate(self.counts):
            for g in c if self.words[i] >= K else ():
                lengths.setdefault(g, set()).add(int(self.words[i]))
        self.lengths = [sorted(lengths.get(g, ())) for g in self.known.tolist()]
        # for each length a table for each block of bits: a window meets items of its own length only
        self.tables = {}
        for n in np.unique(self.words[self.words >= K]):
            of, tables, shift = np.flatnonzero(self.words == n), [], 0
            for bits in BLOCKS:
                value = (self.prints[of] >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
                order = np.argsort(value, kind="stable")
                tables.append((shift, bits, of[order], value[order]))
                shift += bits
            self.tables[int(n)] = tables

    def search(self, prints: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of the length in words whose fingerprints differ in at most RADIUS bits."""
        found = [np.zeros(0, np.int64)]
        for shift, bits, order, values in self.tables.get(int(words), ()):
            value = (prints >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
            near = value[:, None] ^ _near_masks(bits, RADIUS // len(BLOCKS))[None, :]
            first = np.searchsorted(values, near)
            count = np.searchsorted(values, near, "right") - first
            total = count.sum(1)
            at = np.repeat(first.ravel(), count.ravel()) + np.arange(total.sum()) - np.repeat(np.cumsum(count.ravel()) - count.ravel(), count.ravel())
            w, i = np.repeat(np.arange(len(prints)), total), order[at]
            ok = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
            found.append(w[ok] * len(self.ids) + i[ok])
        pair = np.unique(np.concatenate(found))
        return pair // max(len(self.ids), 1), pair % max(len(self.ids), 1)


def weighted_similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[g]) for g, n in a.items() if g in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 0.0


def _windows(index: ItemIndex, s: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths (in words) of the windows of one document that could match: those that hold a shingle of an item of that length."""
    at = np.searchsorted(index.known, s)
    at[at == len(index.known)] = 0
    hit = np.flatnonzero(index.known[at] == s) if len(index.known) else np.zeros(0, np.int64)
    by_length: dict[int, list] = {}
    for p in hit.tolist():
        for n in index.lengths[at[p]]:
            by_length.setdefault(n, []).append(p)
    starts, sizes = [], []
    for n, places in by_length.items():
        inside = max(min(n, words) - K + 1, 1)  # shingles of a window
        # a window similar enough holds most of an item's shingles: it needs as many hits at least
        p = np.array(places)
        need = int(np.ceil(SIMILARITY * max(n - K + 1, 1) - 1e-9)) if n >= K else 1
        last = max(words - n, 0)
        marks = np.zeros(last + 2, np.int64)
        np.add.at(marks, np.clip(p - inside + 1, 0, last), 1)
        np.add.at(marks, np.minimum(p, last) + 1, -1)
        w = np.flatnonzero(np.cumsum(marks)[: last + 1] >= need)
        starts.append(w)
        sizes.append(np.full(len(w), n))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(sizes)


def matches(index: ItemIndex, h: np.ndarray, s: np.ndarray) -> dict[int, tuple[float, int]]:
    """item index -> (best similarity, start word) over the windows of one document."""
    words = len(h)
    if words < K:  # one shingle of fewer words, which no item of K words has
        return {}
    starts, sizes = _windows(index, s, words)
    best: dict[int, tuple[float, int]] = {}
    for lo in range(0, len(starts), 2048):
        w0, n0, close = starts[lo : lo + 2048], sizes[lo : lo + 2048], []
        a, b = w0, np.minimum(w0 + np.maximum(n0 - K + 1, 1), len(s))
        left, right = a.min(), b.max()
        if right - left <= 1 << 16:  # votes of a stretch at once
            run = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(fingerprint_planes(s[left:right]), 0, dtype=np.int32)])
            votes = run[b - left] - run[a - left]
        else:  # far apart: each window by itself
            votes = np.stack([fingerprint_planes(s[x:y]).sum(0) for x, y in zip(a, b)])
        prints = fingerprints(votes)
        for n in np.unique(n0):
            of = np.flatnonzero(n0 == n)
            for w, i in zip(*index.search(prints[of], n)):
                close.append((int(of[w]), int(i)))
        for w, i in close:
            j = weighted_similarity(Counter(s[a[w] : b[w]].tolist()), index.counts[i])
            if j >= SIMILARITY - 1e-12 and j > best.get(i, (0.0, 0))[0]:
                best[i] = (j, int(a[w]))
    return best


def short_matches(index: ItemIndex, h: np.ndarray, limits: np.ndarray) -> dict[int, dict[int, tuple[float, int]]]:
    """row -> item index -> (1.0, first start word) for the items below K words, whose windows are looked up at every place."""
    out: dict[int, dict] = {}
    for n, (keys, named) in index.short.items():
        s, ends = shingles(h, limits, n)
        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
        place = np.flatnonzero(keys[at] == s)
        row = np.searchsorted(ends, place, "right") - 1
        for r, p in zip(row.tolist(), place.tolist()):
            if limits[r + 1] - limits[r] >= n:
                for i in named[int(s[p])]:
                    out.setdefault(r, {}).setdefault(i, (1.0, p - int(ends[r])))
    return out


def contaminated(rows: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """rid, item, similarity, start_word: the best window of each document for each item it holds.

    A benchmark of more than ITEMS items is searched in passes, each with its own block
    of items on the driver and its hits written as a table before the next is fetched.
    """
    spark = rows.sparkSession
    prepare(spark)
    kind = benchmark.schema[item_col].dataType
    schema = f"rid long, item {kind.simpleString()}, similarity double, start_word long"
    found_schema = pa.schema([("rid", pa.int64()), ("item", to_arrow_type(kind)), ("similarity", pa.float64()), ("start_word", pa.int64())])

    def search(items):
        def run(batches):
            index = items.value
            for batch in batches:
                for part in chunks(batch, "text", 1 << 20):
                    h, limits = word_hashes(part.column("text"))
                    s, ends = shingles(h, limits, K)
                    # documents without any shingle of the benchmark end here
                    at = np.minimum(np.searchsorted(index.known, s), max(len(index.known) - 1, 0))
                    hit = index.known[at] == s if len(index.known) else np.zeros(len(s), bool)
                    few = short_matches(index, h, limits)
                    some = np.union1d(np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(hit)])[ends])), np.array(list(few), np.int64))
                    out = [[], [], [], []]
                    for r in some:
                        for i, (j, start) in (matches(index, h[limits[r] : limits[r + 1]], s[ends[r] : ends[r + 1]]) | few.get(int(r), {})).items():
                            for o, x in zip(out, (part.column("rid")[int(r)].as_py(), index.ids[i], j, start)):
                                o.append(x)
                    yield batch_of(found_schema, *out)

        return run

    def hits(block):
        index = spark.sparkContext.broadcast(ItemIndex([r.i for r in block], [r.t for r in block]))
        return rows.select("rid", "text").mapInArrow(search(index), schema)

    out, block = None, []
    for row in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        if len(block) == ITEMS:
            one = table(hits(block))
            out, block = one if out is None else out.unionByName(one), []
        block.append(row)
    last = hits(block)
    return last if out is None else out.unionByName(last)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, contaminated, n_items, items, similarity: one row for each row of docs.

    items: the ids of the benchmark items that some window of the document matches, in
    order; similarity: the greatest (null if none; of equally similar windows the first
    counts).  Words are lower-cased (A-Z); an item of fewer than five words is one
    shingle of its own length and matches every document that has these words in a
    row.  Null or empty items and texts match nothing; texts of any length are searched
    whole, and columns other than the three named are not read.  Null or repeated document ids are
    rows of their own, ids of documents and items may be of any type, and equal items
    with different ids are all listed.  Empty tables: no rows, or nothing contaminated.
    """
    rows = keyed(docs, id_col, text=text_col)
    hits = cut(contaminated(rows, benchmark, item_col)).groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max("similarity").alias("similarity"))
    out = rows.select("rid", "id").join(hits, "rid", "left")
    none = F.coalesce("items", F.array().cast(f"array<{benchmark.schema[item_col].dataType.simpleString()}>"))
    return out.select(F.col("id").alias("doc_id"), F.col("items").isNotNull().alias("contaminated"), F.size(none).cast("long").alias("n_items"), none.alias("items"), "similarity", "rid")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("rid")


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLE_SQL: dict[str, str] = {}
