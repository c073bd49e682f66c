"""Token counts by rank-synchronous array merging.

Pre-tokens of many texts are held as one ragged numpy array of symbols.  In each
round every sequence finds its lowest-ranked adjacent pair and applies all its
occurrences at once, left to right; when no sequence has a known pair, the
surviving symbols are counted.  A pre-token of more than a few hundred bytes goes
through the same rounds by itself, each of which visits only the places of its rank.  One pass over the documents and no shuffle: each
Arrow batch is counted where it was read.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from .common import batch_of, chunks, prepare

#: Pre-tokens of the byte-level vocabularies (a fixed value of the format).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Counted pre-tokens that a task remembers, and the longest of them.
REMEMBERED, LONGEST = 400_000, 48
#: Bytes of a pre-token above which it is merged by itself.
LONG = 256
_NONE = np.int64(1) << 40


class MergeTable:
    """Ranks of a byte-level vocabulary, as sorted arrays (a few MB, fixed by the vocabulary)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.byte_ids = np.array([vocab[c] for c in _byte_letters()], np.int64)
        self._pairs = None
        self.specials = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)

    def pairs(self) -> dict:
        """Ranks by pair, made when the first long word comes."""
        if self._pairs is None:
            self._pairs = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        return self._pairs

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else 256 and up in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def merged_counts(table: MergeTable, words: list[bytes]) -> np.ndarray:
    """Symbols that survive in each word once no pair of the table is left."""
    size = np.array([len(w) for w in words], np.int64)
    count = size.copy()
    for i in np.flatnonzero(size > LONG):
        count[i] = _merged_alone(table, words[i])
    size = np.where(size > LONG, 0, size)
    symbols = table.byte_ids[np.frombuffer(b"".join(w for w in words if len(w) <= LONG), np.uint8)]
    seq = np.repeat(np.arange(len(words)), size)
    while len(symbols) > 1:
        inside = seq[1:] == seq[:-1]
        rank = np.full(len(symbols), _NONE)  # of the pair that starts here
        rank[:-1][inside] = table.rank(symbols[:-1][inside], symbols[1:][inside])
        heads = np.flatnonzero(np.concatenate([[True], ~inside]))
        low = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(symbols))))
        live = low < _NONE
        if not live.any():
            break
        hit = (rank == low) & live
        # in a run of overlapping hits every second one counts, from the left
        at = np.flatnonzero(hit)
        run = np.concatenate([[True], np.diff(at) != 1])
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[place % 2 == 0]
        symbols[at] = table.made[rank[at]]
        keep = live
        keep[at + 1] = False
        symbols, seq = symbols[keep], seq[keep]
        alive = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]])) if len(seq) else np.zeros(0, np.int64)
        count[seq[alive]] = np.diff(np.append(alive, len(seq)))
    return count


def _merged_alone(table: MergeTable, word: bytes) -> int:
    """The same for one long word: a round visits only the places of its rank, not all symbols, so the work follows the merges."""
    symbols = table.byte_ids[np.frombuffer(word, np.uint8)]
    first = table.rank(symbols[:-1], symbols[1:])
    places: dict[int, list] = {}
    order = np.argsort(first, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
        if len(at) and first[at[0]] < _NONE:
            places[int(first[at[0]])] = at.tolist()
    ranks, made, pair = list(places), table.made, table.pairs()
    heapify(ranks)
    s, n = symbols.tolist(), len(symbols)
    after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
    left = n
    while ranks:
        r = heappop(ranks)
        for p in sorted(places.pop(r)):
            q = after[p]
            if s[p] < 0 or q >= n or pair.get(s[p] << 32 | s[q]) != r:
                continue  # an earlier merge took one of the two
            s[p], s[q] = int(made[r]), -1
            left -= 1
            after[p] = after[q]
            if after[q] < n:
                prior[after[q]] = p
            for x in (prior[p], p):
                if x >= 0 and after[x] < n:
                    new = pair.get(s[x] << 32 | s[after[x]])
                    if new is not None:
                        if new not in places:
                            places[new] = []
                            heappush(ranks, new)
                        places[new].append(x)
    return left


class _Counter:
    def __init__(self, table: MergeTable):
        self.table, self.known = table, {}
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, table.specials))) if table.specials else None

    def count(self, texts: list[str]) -> list[int]:
        extra, parts = [], []
        for t in texts:
            cut = self.special.split(t) if self.special else [t]
            extra.append(len(cut) - 1)
            found = self.pattern.findall(cut[0])
            for more in cut[1:]:
                found += self.pattern.findall(more)
            parts.append(found)
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = [w for w in set(chain.from_iterable(parts)) if w not in known]
        spare = {}
        if new:
            n = merged_counts(self.table, [w.encode() for w in new]).tolist()
            for w, c in zip(new, n):
                (known if len(w) <= LONGEST else spare)[w] = c
        if spare:
            return [e + sum(known[w] if w in known else spare[w] for w in p) for e, p in zip(extra, parts)]
        return [e + sum(map(known.__getitem__, p)) for e, p in zip(extra, parts)]


_COUNTS = [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]


def token_counts(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit), one row for each row of docs.

    ``tokenizer_file``: a byte-level BPE vocabulary in JSON, read on the driver and
    broadcast (its size is that of the vocabulary, whatever the data).  Special
    strings inside a text count one token each; none is added at the ends.
    A null text counts as empty: 0 bytes and 0 tokens.  Null and repeated ids, ties
    and extra columns pass through unharmed since rows never meet; an empty table
    gives an empty result; a very long text is counted whole.
    """
    spark = docs.sparkSession
    prepare(spark)
    table = spark.sparkContext.broadcast(MergeTable(tokenizer_file))
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), *_COUNTS])

    def count(batches):
        counter = _Counter(table.value)
        for batch in batches:
            for part in chunks(batch, "text", 1 << 20):
                col = part.column("text")
                texts = ["" if t is None else t for t in col.to_pylist()]
                n = counter.count(texts)
                size = np.array([len(t.encode()) for t in texts], np.int64)
                yield batch_of(schema, part.column("doc_id"), size, np.array(n, np.int64), np.array(n, np.int64) > limit)

    rows = docs.selectExpr(f"`{id_col}` doc_id", f"`{text_col}` text")
    return rows.mapInArrow(count, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLE_SQL: dict[str, str] = {}
