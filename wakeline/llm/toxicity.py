"""Toxicity by a factorization machine over hashed terms.

Terms (runs of letters, digits and non-ASCII bytes, A-Z in lower case) are hashed to
32 bits; a document's features are its distinct terms.  The machine
``bias + sum w_i + sum_{i<j} <v_i, v_j>`` learns weights and pairwise interactions
by full-batch Adam on a bounded sample of labelled rows.  Its terms are those whose own
document counts differ between the labels, and those of pairs whose joint counts do
though the terms' own counts do not explain it, so that two terms that say nothing
alone can be learned together.  The fitted model has at most ``TERMS + PAIRED`` rows and is
broadcast; every text is scored whole, where it was read, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import IS_TERM, batch_of, chunks, distinct_rows, prepare, word_hashes

#: Labelled rows that the fit reads at most, those of the smallest id hash.
SAMPLE = 20_000
#: Terms of the model at most, least documents with a term, and least distance of its counts from chance.
TERMS, LEAST_DOCS, LEAST_Z = 1 << 16, 3, 4.5
#: Terms (those in most documents of the sample) whose pairs are tried, and how much farther from chance than its terms a pair must be.
PAIRED, PAIR_Z = 2048, 6.0
FACTORS, STEPS, RATE, DECAY = 4, 300, 0.05, 1e-4


def term_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h, limits = word_hashes(col, True, IS_TERM)
    return distinct_rows(h >> np.uint64(32), limits)


def _features(batches):
    schema = pa.schema([("_h", pa.string()), ("toxic", pa.int32()), ("terms", pa.binary())])
    for batch in batches:
        for part in chunks(batch, "text"):
            v, limits = term_sets(part.column("text"))
            v = v.astype(np.uint32)
            yield batch_of(schema, part.column("_h"), part.column("toxic"), pa.array([v[a:b].tobytes() for a, b in zip(limits, limits[1:])], pa.binary()))


class Machine:
    """Terms in order, their weights and factors, and the bias."""

    def __init__(self, terms, w, v, bias):
        self.terms, self.w, self.v, self.bias = terms, w, v, bias

    def score(self, values: np.ndarray, limits: np.ndarray) -> np.ndarray:
        rows = len(limits) - 1
        z = np.full(rows, self.bias)
        if len(self.terms) and len(values):
            at = np.minimum(np.searchsorted(self.terms, values), len(self.terms) - 1)
            known = self.terms[at] == values
            row = np.repeat(np.arange(rows), np.diff(limits))[known]
            z += _raw(self.w, self.v, at[known], row, rows)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _raw(w, v, at, row, rows):
    """sum w + (|sum v|^2 - sum |v|^2) / 2 for each row."""
    z = np.zeros(rows)
    z += np.bincount(row, w[at], rows)  # without terms its counts are whole numbers, to which no fraction can be added
    for f in range(v.shape[1]):
        x = v[at, f]
        s = np.bincount(row, x, rows)
        z += 0.5 * (s * s - np.bincount(row, x * x, rows))
    return z


def _paired(y: np.ndarray, row: np.ndarray, at: np.ndarray, df: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Terms of pairs whose joint count in toxic rows lies farther from chance than both terms' own counts together."""
    n, p = len(y), float((y > 0).mean())
    often = np.flatnonzero((df >= LEAST_DOCS) & (df < n))
    often = np.sort(often[np.argsort(-df[often], kind="stable")[:PAIRED]])
    place = np.full(len(df), -1)
    place[often] = np.arange(len(often))
    row, at = row[place[at] >= 0], place[at[place[at] >= 0]]
    both, toxic = (np.zeros((len(often), len(often)), np.float32) for _ in range(2))
    for lo in range(0, n, 2048):
        x, y_ = np.searchsorted(row, [lo, lo + 2048])
        held = np.zeros((min(2048, n - lo), len(often)), np.float32)
        held[row[x:y_] - lo, at[x:y_]] = 1
        both += held.T @ held
        some = held[y[lo : lo + 2048] > 0]
        toxic += some.T @ some
    own = np.abs(z[often])
    joint = np.abs(toxic - both * p) / np.sqrt(np.maximum(both, 1) * p * (1 - p))
    found = (both >= LEAST_DOCS) & (joint >= PAIR_Z + own[:, None] + own[None, :])
    np.fill_diagonal(found, False)
    return often[found.any(1)]


def fit(y: np.ndarray, values: np.ndarray, limits: np.ndarray, seed: int = 3, factors: int = FACTORS) -> Machine:
    """A machine for labels y and rows of distinct terms; without factors it is additive."""
    n, pos = len(y), float((y > 0).sum())
    empty = Machine(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, FACTORS)), float(np.log((pos + 0.5) / (n - pos + 0.5))))
    if not 0 < pos < n:
        return empty
    row = np.repeat(np.arange(n), np.diff(limits))
    terms, at, df = np.unique(values, return_inverse=True, return_counts=True)
    hits = np.bincount(at, (y > 0)[row], len(terms))
    p = pos / n
    z = (hits - df * p) / np.sqrt(df * p * (1 - p))
    alone = np.flatnonzero((df >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z))
    good = np.union1d(alone[np.argsort(-np.abs(z[alone]), kind="stable")[:TERMS]], _paired(y, row, at, df, z))
    if not len(good):
        return empty
    place = np.full(len(terms), -1)
    place[good] = np.arange(len(good))
    at = place[at]
    row, at = row[at >= 0], at[at >= 0]
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(good)), rng.normal(0, 0.01, (len(good), factors)), empty.bias
    m = [np.zeros_like(w), np.zeros_like(v), 0.0]
    s = [np.zeros_like(w), np.zeros_like(v), 0.0]
    weight = np.where(y > 0, 0.5 / p, 0.5 / (1 - p))  # both labels count alike
    t = (y > 0).astype(float)
    for step in range(1, STEPS + 1):
        g = weight * (1 / (1 + np.exp(-np.clip(bias + _raw(w, v, at, row, n), -60, 60))) - t) / n
        grads = [np.bincount(at, g[row], len(w)) + DECAY * w / len(w), np.empty_like(v), g.sum()]
        for f in range(factors):
            x = v[at, f]
            others = np.bincount(row, x, n)[row] - x
            grads[1][:, f] = np.bincount(at, g[row] * others, len(w))
        grads[1] += DECAY * v
        new = []
        for k, (x, d) in enumerate(zip((w, v, bias), grads)):
            m[k] = 0.9 * m[k] + 0.1 * d
            s[k] = 0.999 * s[k] + 0.001 * d * d
            new.append(x - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-9))
        w, v, bias = new
    return Machine(terms[good].astype(np.uint64), w, v, float(bias))


_MODEL = pa.schema([("term", pa.int64()), ("w", pa.float64()), ("v", pa.list_(pa.float64()))])


def _fit_task(batches):
    """Rows of the model; the bias has the term -1."""
    y, terms = [], []
    for b in batches:
        y += b.column("toxic").to_pylist()
        terms += b.column("terms").to_pylist()
    if not y:
        return
    values = np.frombuffer(b"".join(terms), np.uint32).astype(np.uint64)
    limits = np.concatenate([[0], np.cumsum([len(t) // 4 for t in terms])])
    m = fit(np.array(y), values, limits)
    yield batch_of(_MODEL, np.append(m.terms.astype(np.int64), -1), np.append(m.w, m.bias), pa.array([*m.v.tolist(), [0.0] * FACTORS], _MODEL.field("v").type))


def train(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """A machine from at most ``sample`` labelled rows (those of the smallest id hash, repeated ids included) for which ``usable`` (a predicate on the id) holds."""
    prepare(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).filter("_id is not null and toxic is not null").filter(usable(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("toxic").alias("toxic")).withColumn("_h", F.md5(F.col("_id").cast("string"))).orderBy("_h", "_id").limit(sample)
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    rows = text.join(F.broadcast(known), "_id").select("_h", "toxic", "text").mapInArrow(_features, "_h string, toxic int, terms binary")
    # repeated ids must not multiply the sample; in one order, sums of a refit agree
    found = rows.orderBy("_h", "terms").limit(sample).mapInArrow(_fit_task, "term long, w double, v array<double>").orderBy("term").collect()  # at most TERMS + PAIRED + 1 rows
    if not found:
        return Machine(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, FACTORS)), 0.0)
    return Machine(np.array([r.term for r in found[1:]], np.uint64), np.array([r.w for r in found[1:]]), np.array([r.v for r in found[1:]]).reshape(-1, FACTORS), found[0].w)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= least), one row for each row of docs.

    A null or empty text has no terms and gets the score of the bias alone; texts of
    any length are scored whole.  Rows never meet, so null, repeated or textual ids and
    extra columns do no harm, and equal texts score alike.  Of repeated ids in the
    labels the greater label counts.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(machine)
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                s = model.value.score(*term_sets(part.column("text")))
                yield batch_of(schema, part.column("doc_id"), s, (s >= least).astype(np.int32))

    return docs.selectExpr(f"`{id_col}` doc_id", f"`{text_col}` text").mapInArrow(run, f"doc_id {kind.simpleString()}, score double, predicted int")


def held_out(id_col):
    """The third of the rows that no fit sees."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = train(docs, labels, lambda i: ~held_out(i))
    return score(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}
