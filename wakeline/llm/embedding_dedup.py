"""Near-duplicate embeddings by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted and cut into cells;
eight cells make one bucket key, and 40 tables of such keys are used.  Unit vectors
with cosine 0.98 lie 0.2 apart, so with cells of width 1 they share a cell with
probability 0.84 and miss each other in all tables with probability 1.2e-5; vectors
at right angles share a bucket of any table with probability 1e-3.  Pairs that share
a bucket are confirmed by their cosine in double precision.

Equal vectors with equal labels are one class with a count, so a group of copies of
any size makes no pairs within itself; its links are added by arithmetic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, cut, keyed, mix
from ..operators.graph import components

TABLES, CELLS, WIDTH = 40, 8, 1.0


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(col.to_pylist()), np.float64)
    return flat.reshape(-1, dim) if len(flat) else np.zeros((0, dim))


def _clean(batches):
    """Vectors as doubles in one binary each; those that link with nothing are null."""
    schema = pa.schema([("rid", pa.int64()), ("label", pa.string()), ("vec", pa.binary()), ("dim", pa.int32())])
    for batch in batches:
        out, dims = [], []
        for v in batch.column("vec").to_pylist():
            x = None
            if v and None not in v:
                x = np.array(v, np.float64)
                x = x if np.isfinite(x).all() and np.any(x) else None
            out.append(None if x is None else (x + 0.0).tobytes())
            dims.append(0 if x is None else len(x))
        yield batch_of(schema, batch.column("rid"), batch.column("label"), pa.array(out, pa.binary()), np.array(dims, np.int32))


def _buckets(seed: int, tables: int, cells: int, width: float):
    schema = pa.schema([("rid", pa.int64()), ("tab", pa.int32()), ("key", pa.int64())])

    def run(batches):
        made = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                if dim not in made:
                    rng = np.random.default_rng([seed, int(dim)])
                    made[dim] = rng.standard_normal((dim, tables * cells)), rng.uniform(0, width, tables * cells)
                a, b = made[dim]
                x = _matrix(part.column("vec"), dim)
                x = x / np.abs(x).max(1, keepdims=True)  # against overflow of the squares
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                cell = np.floor((x @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, cells)
                key = np.full((len(x), tables), int(dim), np.uint64)
                for j in range(cells):
                    key = mix(key * np.uint64(31) + cell[:, :, j])
                rid = np.repeat(part.column("rid").to_numpy(zero_copy_only=False), tables)
                yield batch_of(schema, rid, np.tile(np.arange(tables, dtype=np.int32), len(x)), key.astype(np.int64).ravel())

    return run


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision; any finite scale."""
    x = x / np.abs(x).max(1, keepdims=True)
    y = y / np.abs(y).max(1, keepdims=True)
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def _linked(least: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ma", pa.int64()), ("mb", pa.int64())])

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                for start in range(0, part.num_rows, 20_000):
                    p = part.slice(start, 20_000)
                    ok = pa.array(cosine(_matrix(p.column("va"), dim), _matrix(p.column("vb"), dim)) >= least)
                    yield pa.RecordBatch.from_arrays([p.column(c).filter(ok).cast(pa.int64()) for c in ("a", "b", "ma", "mb")], schema=schema)

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 11, tables: int = TABLES, cells: int = CELLS, width: float = WIDTH) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors.

    Vectors are linked when their labels are equal and not null, their dimensions
    agree and their cosine is at least ``least``.  A vector that is null, empty, zero
    or has a null or non-finite component links with nothing; n_links counts other
    rows, copies included.  component_id is the smallest id reachable, itself
    included; rows of equal or null ids are rows of their own.
    """
    rows = keyed(vectors, id_col, vec=vector_col, label=label_col)
    v = cut(rows.select("rid", F.col("label").cast("string").alias("label"), F.col("vec").cast("array<double>").alias("vec")).mapInArrow(_clean, "rid long, label string, vec binary, dim int"))
    usable = v.filter("vec is not null and label is not null")
    classes = cut(usable.groupBy("label", "vec").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("dim").alias("dim")))
    keys = classes.select(F.col("rep").alias("rid"), "vec", "dim").mapInArrow(_buckets(seed, tables, cells, width), "rid long, tab int, key long")
    keys = cut(keys.join(classes.select(F.col("rep").alias("rid"), "label"), "rid"))
    full = keys.groupBy("label", "tab", "key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("label", "tab", "key")
    members = cut(keys.join(full, ["label", "tab", "key"]))
    pairs = members.withColumnRenamed("rid", "a").join(members.withColumnRenamed("rid", "b"), ["label", "tab", "key"]).filter("a < b").select("a", "b").distinct()
    one = classes.select(F.col("rep").alias("a"), F.col("m").alias("ma"), F.col("vec").alias("va"), "dim")
    two = classes.select(F.col("rep").alias("b"), F.col("m").alias("mb"), F.col("vec").alias("vb"), F.col("dim").alias("dim2"))
    links = cut(pairs.join(one, "a").join(two, "b").filter("dim = dim2").mapInArrow(_linked(least), "a long, b long, ma long, mb long"))
    reached = links.select(F.col("a").alias("rep"), F.col("mb").alias("m")).union(links.select(F.col("b"), F.col("ma"))).groupBy("rep").agg(F.sum("m").alias("others"))
    labels = cut(components(links.select("a", "b"))).withColumnRenamed("node", "rep")
    found = classes.join(reached, "rep", "left").join(labels, "rep", "left")
    found = found.select("label", "vec", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    out = v.join(found, ["label", "vec"], "left").select("rid", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "rid").alias("root"))
    ids = rows.select("rid", "id")
    out = out.join(ids, "rid").join(ids.select(F.col("rid").alias("root"), F.col("id").alias("component_id")), "root")
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("rid") == F.col("root")).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT a AS vec_id, count(*)::BIGINT AS n_links FROM pairs GROUP BY a),
reach AS MATERIALIZED (
  WITH RECURSIVE r(a, b) USING KEY (a) AS (
    SELECT a, least(a, min(b)) FROM pairs GROUP BY a
    UNION
    SELECT p.a, min(r.b) FROM r JOIN pairs p ON p.b = r.a JOIN recurring.r AS old ON old.a = p.a
    WHERE r.b < old.b GROUP BY p.a)
  SELECT a, b FROM r)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(r.b, e.vec_id)::BIGINT AS component_id,
       coalesce(r.b, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.vec_id = e.vec_id LEFT JOIN reach r ON r.a = e.vec_id
"""
QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}
ORACLE_SQL = {"op6_embedding_dedup": ORACLE}
