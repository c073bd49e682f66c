"""Removal of repeated 100-byte strings with sharded suffix arrays.

1. Anchors.  In every window of 100 bytes the 32-byte string of least hash (the
   rightmost of equals) is its anchor: equal windows have equal anchors at equal
   places, so only windows around equal anchors can be equal.  The windows of one
   anchor make a segment.  Equal segments are collapsed to the earliest, first inside
   each map task and then by shards of anchors; a later one is removed as a whole.
   Anchors that stand in very many different segments (found on a sample that grows
   with the input and only affects the balance) are keyed by window instead, so none
   makes a large group.  Segments and windows are told apart by 96 bits of hashes here.
2. Suffix arrays.  Segments whose anchor stands in several different segments are cut
   from the texts and gathered in shards of a few MB; each shard's suffix array is
   built by induced sorting, and permuted common prefixes tell which windows are
   equal.  All but the earliest window of a class are removed.
3. The removed stretches of each document are united.

Texts meet their stretches in blocks of a few MB.  Records travel as columns packed
by shard or block, which compress well.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, chunks, cut, keyed, mix, prefix_sums, span_hash, utf8
from .suffix_sort import permuted_common_prefixes, suffix_array

LENGTH, GRAM = 100, 32
#: Text bytes of a shard of anchors, of a block of texts, and of a suffix array.
SHARD_BYTES, BLOCK_BYTES, SORT_BYTES = 8 << 20, 8 << 20, 2 << 20
#: Text that is sampled for frequent anchors (bytes, or a share of all if that is more), and different segments there that make one frequent.
SAMPLE_BYTES, SAMPLE_SHARE, FREQUENT = 32 << 20, 4096, 256
_ROWS = pa.schema([("kind", pa.int32()), ("key", pa.int32()), ("size", pa.int64()), ("data", pa.binary())])
_SQL = "kind int, key int, size long, data binary"
MARK, SEGMENT = 0, 1
_MARK = (np.int64, np.int64, np.int32)  # row, start, bytes
_ANCHOR = (np.uint32, np.uint64, np.int64, np.int64, np.uint8, np.uint8)  # anchor, segment, row, start, windows, anchor's place
_TEXT = (np.int64, np.int64, np.uint8)  # row, start, windows


def pack(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack(blobs: list, kinds: tuple) -> list[np.ndarray]:
    """Columns of packed blobs, one after another."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    parts = []
    for b in blobs:
        n = len(b) // width
        ends = list(accumulate(np.dtype(k).itemsize * n for k in kinds))
        parts.append([np.frombuffer(b, k, n, e - np.dtype(k).itemsize * n) for k, e in zip(kinds, ends)])
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def grouped(kind: int, key: np.ndarray, kinds: tuple, columns: list, size: np.ndarray | None = None):
    """Packed rows, one for each key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    out = [[], [], [], []]
    columns = [np.asarray(c)[order].astype(k) for c, k in zip(columns, kinds)]
    size = np.zeros(len(key), np.int64) if size is None else size[order]
    for a, b in zip(heads, np.append(heads[1:], len(key))):
        for o, x in zip(out, (kind, int(key[a]), int(size[a:b].sum()), pack(*(c[a:b] for c in columns)))):
            o.append(x)
    return batch_of(_ROWS, *out)


def segments(data: np.ndarray, offs: np.ndarray):
    """(anchor hash, segment hash, row, start in row, windows, place of the anchor, prefix sums) of all windows."""
    n = len(data)
    size = np.diff(offs)
    count = np.maximum(size - LENGTH + 1, 0)
    sums = prefix_sums(data)
    none = np.zeros(0, np.int64)
    if not count.sum():
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none, sums
    g = span_hash(sums, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    bits = np.uint64(max(22, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (g & ~low) | (low - np.arange(len(g), dtype=np.uint64))  # of equal hashes the rightmost
    width, reach = LENGTH - GRAM + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    ends = np.cumsum(count)
    start = np.arange(ends[-1]) + np.repeat(offs[:-1] - (ends - count), count)
    anchor = (low - (least[start] & low)).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    a, windows, place = start[heads], np.diff(np.append(heads, len(start))), anchor[heads]
    row = np.searchsorted(ends, heads, "right")
    seg = mix(span_hash(sums, a, a + windows + LENGTH - 1) + ((place - a) << 8 | windows).astype(np.uint64))
    return g[place], seg, row, a - offs[row], windows, place - a, sums


def _by_window(frequent: np.ndarray, h, seg, row, a, windows, place, sums, offs):
    """Cut segments of frequent anchors into single windows keyed by their own hash."""
    if not len(frequent) or not len(h):
        return h, seg, row, a, windows, place
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    hot = frequent[at] == h
    if not hot.any():
        return h, seg, row, a, windows, place
    n = windows[hot]
    r, s = np.repeat(row[hot], n), np.repeat(a[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    w = span_hash(sums, offs[r] + s, offs[r] + s + LENGTH)
    one = np.ones(len(r), np.int64)
    join = lambda x, y: np.concatenate([x[~hot], y])
    return join(h, mix(w + np.uint64(1))), join(seg, w), join(row, r), join(a, s), join(windows, one), join(place, 0 * one)


def _first_of_each(h, seg, rid, a):
    """Order by (anchor, segment, row, start) and a flag for the earliest of each segment."""
    order = np.lexsort((a, rid, seg, h))
    first = np.ones(len(order), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (seg[order][1:] != seg[order][:-1])
    return order, first


def _anchors(shards: int, blocks: int, frequent):
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offs = utf8(part.column("text"))
                h, seg, row, a, windows, place = _by_window(frequent.value, *segments(data, offs), offs)
                rid = part.column("rid").to_numpy(zero_copy_only=False)[row]
                order, first = _first_of_each(h, seg, rid, a)
                late, one = order[~first], order[first]
                # the shard holds marks as well: they only pass through
                yield grouped(MARK, np.mod(rid[late], blocks) % shards, _MARK, [rid[late], a[late], windows[late] + LENGTH - 1])
                h, seg, rid, a, windows, place = (x[one] for x in (h, seg, rid, a, windows, place))
                yield grouped(SEGMENT, (h % np.uint64(shards)).astype(np.int64), _ANCHOR, [h >> np.uint64(32), seg, rid, a, windows, place])

    return run


def _collapse(blocks: int):
    """A shard of anchors: marks of later equal segments, and segments that a suffix array must compare."""

    def run(key, t):
        kind, blob = t.column("kind").to_numpy(), t.column("data").to_pylist()
        marks = unpack([b for b, k in zip(blob, kind) if k == MARK], _MARK)
        h, seg, rid, a, windows, place = unpack([b for b, k in zip(blob, kind) if k == SEGMENT], _ANCHOR)
        order, first = _first_of_each(h, seg, rid, a)
        late, one = order[~first], order[first]
        marks = [np.concatenate([m, x]) for m, x in zip(marks, (rid[late], a[late], windows[late].astype(np.int64) + LENGTH - 1))]
        heads = np.flatnonzero(np.concatenate([[True], h[one][1:] != h[one][:-1]])) if len(one) else np.zeros(0, int)
        several = np.repeat(np.diff(np.append(heads, len(one))) > 1, np.diff(np.append(heads, len(one))))
        one = one[several]
        size = windows[one].astype(np.int64) + LENGTH - 1
        return pa.Table.from_batches([
            grouped(MARK, np.mod(marks[0], blocks), _MARK, marks),
            grouped(SEGMENT, np.mod(rid[one], blocks), (np.uint32, *_TEXT), [h[one], rid[one], a[one], windows[one]], size),
        ], _ROWS)

    return run


def _cut_out(sorts: int):
    """A block of texts and the segments asked of it: their bytes, by suffix array."""

    def run(key, docs, asked):
        h, rid, a, windows = unpack(asked.column("data").to_pylist(), (np.uint32, *_TEXT))
        out = []
        target = (mix(h.astype(np.uint64)) % np.uint64(sorts)).astype(np.int64)
        for batch in docs.to_batches():
            ids = batch.column("rid").to_numpy(zero_copy_only=False)
            by = np.argsort(ids, kind="stable")
            data, offs = utf8(batch.column("text"))
            at = np.minimum(np.searchsorted(ids[by], rid), len(ids) - 1)
            here = np.flatnonzero(ids[by][at] == rid) if len(ids) else np.zeros(0, np.int64)
            here = here[np.argsort(target[here], kind="stable")]
            begin = offs[by[at[here]]] + a[here]
            size = windows[here].astype(np.int64) + LENGTH - 1
            take = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
            text, ends = data[take], np.concatenate([[0], np.cumsum(size)])
            heads = np.flatnonzero(np.concatenate([[True], target[here][1:] != target[here][:-1]])) if len(here) else []
            for x, y in zip(heads, np.append(heads[1:], len(here))):
                body = pack(rid[here][x:y], a[here][x:y], windows[here][x:y])
                out.append(batch_of(_ROWS, [int(y - x)], [int(target[here][x])], [int(ends[y] - ends[x])], [body + text[ends[x] : ends[y]].tobytes()]))
        return pa.Table.from_batches(out, _ROWS)

    return run


def _sort(blocks: int):
    """A suffix array over a shard's segments: marks of all windows but the earliest of each class."""

    def run(key, t):
        width = sum(np.dtype(k).itemsize for k in _TEXT)
        rows, texts = [], []
        for n, blob in zip(t.column("kind").to_pylist(), t.column("data").to_pylist()):
            rows.append(blob[: n * width])
            texts.append(blob[n * width :])
        rid, a, windows = unpack(rows, _TEXT)
        text = np.frombuffer(b"".join(texts), np.uint8)
        size = windows.astype(np.int64) + LENGTH - 1
        begin = np.cumsum(size) - size
        n = windows.astype(np.int64)
        segment = np.repeat(np.arange(len(n)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = begin[segment] + inside  # of all windows, in text order
        doc, place = rid[segment], a[segment] + inside
        which = np.full(len(text), -1)
        which[start] = np.arange(len(start))
        order = which[suffix_array(text)]
        order = order[order >= 0]  # windows in suffix order
        before = np.empty(len(order), np.int64)
        before[order[1:]], before[order[0]] = order[:-1], order[0]
        common = permuted_common_prefixes(text, start, start[before], LENGTH)
        common[order[0]] = 0
        age = np.empty(len(order), np.int64)
        age[np.lexsort((place, doc))] = np.arange(len(order))
        heads = np.flatnonzero(common[order] < LENGTH)
        oldest = np.minimum.reduceat(age[order], heads)
        removed = np.empty(len(order), bool)
        removed[order] = age[order] != np.repeat(oldest, np.diff(np.append(heads, len(order))))
        # neighbouring windows of a segment make one mark
        new = removed & ~np.concatenate([[False], removed[:-1] & (segment[1:] == segment[:-1])])
        last = removed & ~np.concatenate([removed[1:] & (segment[1:] == segment[:-1]), [False]])
        x, y = np.flatnonzero(new), np.flatnonzero(last)
        return pa.Table.from_batches([grouped(MARK, np.mod(doc[x], blocks), _MARK, [doc[x], place[x], y - x + LENGTH])], _ROWS)

    return run


_RESULT = pa.schema([("rid", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _unite(keep_text: bool):
    def run(key, docs, marks):
        rid, start, size = unpack(marks.column("data").to_pylist(), _MARK)
        out = []
        for batch in docs.to_batches():
            ids = batch.column("rid").to_numpy(zero_copy_only=False)
            by = np.argsort(ids, kind="stable")
            data, offs = utf8(batch.column("text"))
            at = np.minimum(np.searchsorted(ids[by], rid), max(len(ids) - 1, 0))
            here = ids[by][at] == rid if len(ids) else np.zeros(0, bool)
            begin = offs[by[at[here]]] + start[here]
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + size[here], -1)
            gone = np.cumsum(edge[:-1]) > 0
            first = gone & ~np.concatenate([[False], gone[:-1]])
            first[offs[:-1][np.diff(offs) > 0]] |= gone[offs[:-1][np.diff(offs) > 0]]
            total, runs = (np.concatenate([[0], np.cumsum(x)])[offs] for x in (gone, first))
            kept = [data[b:e][~gone[b:e]].tobytes() for b, e in zip(offs, offs[1:])]
            out.append(batch_of(_RESULT, ids, np.diff(offs), np.diff(total), np.diff(runs), [hashlib.sha256(k).hexdigest() for k in kept], pa.array(kept if keep_text else [None] * len(kept), pa.binary())))
        return pa.Table.from_batches(out, _RESULT)

    return run


def _frequent_anchors(rows: DataFrame, total: int) -> np.ndarray:
    """Anchors in very many different segments, in order.

    An anchor with a million different segments (about 150 MB) has 256 in a sample of one
    in 4096, whatever the size of the input; there can be no more such anchors than one
    for each 32 MB or so of text, so 100 TB have some millions of them, 8 bytes each.
    """
    schema = pa.schema([("h", pa.int64()), ("seg", pa.int64())])

    def look(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                h, seg, *_ = segments(*utf8(part.column("text")))
                both = np.unique(np.stack([h.view(np.int64), seg.view(np.int64)], 1), axis=0) if len(h) else np.zeros((0, 2), np.int64)
                yield batch_of(schema, both[:, 0].copy(), both[:, 1].copy())

    share = min(max(1, total // SAMPLE_BYTES), SAMPLE_SHARE)
    sample = rows.filter(F.pmod(F.xxhash64("rid"), F.lit(share)) == 0)
    found = sample.mapInArrow(look, "h long, seg long").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
    return np.sort(np.array([r.h for r in found.select("h").collect()], np.int64).view(np.uint64))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (UTF-8 bytes that stay): one row for each row of docs.

    A byte is removed if a 100-byte string that covers it also starts earlier, in a
    document of smaller id or earlier in the same one; overlaps count, and strings are
    judged on the input.  A null text is empty; texts below 100 bytes lose nothing.
    Null or repeated ids are documents of their own, ordered as common.keyed says.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text=text_col).select("rid", "id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, blocks = max(1, -(-total // SHARD_BYTES)), max(1, -(-total // BLOCK_BYTES))
    frequent = spark.sparkContext.broadcast(_frequent_anchors(rows, total))
    text = rows.select("rid", "text")
    anchors = text.mapInArrow(_anchors(shards, blocks, frequent), _SQL)
    found = cut(anchors.groupBy("key").applyInArrow(_collapse(blocks), _SQL))
    todo = found.filter(F.col("kind") == SEGMENT).agg(F.sum("size")).first()[0] or 0
    sorts = max(1, -(-todo // SORT_BYTES))
    placed = text.withColumn("block", F.pmod("rid", F.lit(blocks)).cast("int")).repartition(int(blocks), "block")
    asked = found.filter(F.col("kind") == SEGMENT).withColumnRenamed("key", "block")
    pieces = placed.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_cut_out(sorts), _SQL)
    marks = pieces.groupBy("key").applyInArrow(_sort(blocks), _SQL).union(found.filter(F.col("kind") == MARK)).withColumnRenamed("key", "block")
    out = placed.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_unite(keep_text), "rid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.join(rows.select("rid", "id"), "rid")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else []))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
