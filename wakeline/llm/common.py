"""Helpers the operators share: row keys, checkpoints, and Arrow text kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import brief_shuffles, cut, free, prepare, table  # noqa: F401

#: Text bytes that a kernel holds at once; a longer single document is held alone.
CHUNK_BYTES = 2 << 20
#: The words of every operator here: maximal runs without these bytes.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_REGEX = "[^\\x20\\x09-\\x0D]+"


def keyed(df: DataFrame, id_col: str, **columns: str) -> DataFrame:
    """Columns ``rid`` (unique, not null), ``id`` and the ones asked for, under their new names.

    ``rid`` is the id itself where ids are integers, unique and not null; else it
    numbers the rows in the order of (id, the other columns), nulls last, and is
    checkpointed so that later stages see the same numbers.
    """
    prepare(df.sparkSession)
    out = df.select(F.col(id_col).alias("id"), *[F.col(c).alias(k) for k, c in columns.items()])
    whole = isinstance(out.schema["id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    if whole:
        odd = out.groupBy("id").count().filter("count > 1 or id is null").limit(1).count()
        if not odd:
            return out.withColumn("rid", F.col("id").cast("long"))
    order = [F.col("id").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in columns]]
    return cut(out.orderBy(*order).withColumn("rid", F.monotonically_increasing_id()))


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES):
    """Slices of a batch that hold ``most`` bytes of a text column each, or one row."""
    ends = np.cumsum(lengths(batch.column(column)))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def offsets_of(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    raw = col.buffers()[1]
    if raw is None or not len(col):
        return np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(raw, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def lengths(col: pa.Array) -> np.ndarray:
    return np.diff(offsets_of(col))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, one after another, and the row limits (rows + 1)."""
    offs = offsets_of(col)
    raw = col.buffers()[2] if len(col) else None
    if raw is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACE)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20_011)
_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _BACK)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Sums of the codes of the first i bytes, each times a power of its place."""
    codes = _CODE[_LOWER] if lower else _CODE
    out = np.zeros(len(data) + 1, np.uint64)
    p, _ = powers(len(data))
    np.cumsum(codes[data] * p[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    _, back = powers(len(sums))
    return mix((sums[stop] - sums[start]) * back[start])


#: Bytes of terms: ASCII letters and digits and all bytes of other characters.
IS_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def word_spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row limits (in words, rows + 1) of the words of each row."""
    word = inside[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    prev = np.empty(len(data), bool)
    if len(data):
        prev[0] = False
        prev[1:] = word[:-1]
    starts = np.flatnonzero(word & (~prev | first[:-1]))
    after = np.zeros(len(data), bool)
    if len(data):
        after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_codes(spelled: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, equal for equal words only, and the words by number; spelled is the bytes of the words alone."""
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(spelled)).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def word_hashes(col: pa.Array, lower: bool = True, inside: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of each row, and the row limits in words."""
    data, offs = utf8(col)
    starts, ends, limits = word_spans(data, offs, inside)
    return span_hash(prefix_sums(data, lower), starts, ends), limits


_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(words: np.ndarray, limits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of k words of each row, and the row limits in shingles.

    A row of fewer words gives the whole row as one shingle; a row without words none.
    """
    n = np.diff(limits)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out = np.zeros(len(words), np.uint64)
    full = max(len(words) - k + 1, 0)
    for j in range(k):
        out[:full] = out[:full] * _STEP + words[j : j + full]
    short = np.flatnonzero((n > 0) & (n < k))
    for r in short:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for w in words[limits[r] : limits[r + 1]]:
                h = h * _STEP + w
        out[limits[r]] = h + np.uint64(n[r])
    ends = np.concatenate([[0], np.cumsum(count)])
    take = np.arange(ends[-1]) + np.repeat(limits[:-1] - ends[:-1], count)
    return mix(out[take]), ends


def distinct_rows(values: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of each row sorted and distinct, and the new limits."""
    row = np.repeat(np.arange(len(limits) - 1), np.diff(limits))
    order = np.lexsort((values, row))
    v = values[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (row[1:] != row[:-1])  # row is sorted, so order keeps it
    return v[new], np.searchsorted(row[new], np.arange(len(limits)))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def row_sums(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Sum of the values of each row, 0 for an empty one."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[limits[1:]] - total[limits[:-1]]
