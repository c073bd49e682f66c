"""URL filters by a sorted digest array.

The rules become one file: the 64-bit xxhash keys of their strings in ascending order,
where each full string stands, and the hosts' own keys with the path lengths that occur
under each.  Executors fetch the file once and map it into memory, so a worker holds
only the pages that it probes.  A url asks for its host and each parent domain, and for
the path lengths of those that are there: one vectorised binary search a batch for the
hosts and one for the rules.  A hit counts only if the stored string is the url's own,
so equal digests of different strings never decide.

Rules of more than ``most_bytes`` are joined instead, by host and then by host and path.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_file
from .common import prepare

#: Bytes of an index that executors fetch; rules beyond are joined.
MOST_BYTES = 2 << 30
#: The seed of Spark's xxhash64, which makes the keys of the rules.
SEED = 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z in lower case) and path of a url; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _clean(rules: DataFrame) -> DataFrame:
    """host, path, block of each different rule; a null path is empty, a rule without host fits nothing, and block goes before allow."""
    host = F.translate("host", UPPER, LOWER)
    some = rules.filter("host <> ''").select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), (F.col("verdict") == "block").alias("block"))
    return some.groupBy("host", "path").agg(F.coalesce(F.max("block"), F.lit(False)).alias("block"))


def pack(digest: np.ndarray, hosts: list[bytes], paths: list[bytes], block: np.ndarray) -> bytes:
    """The index of rules whose digests are ascending."""
    lens = {}
    for h, p in zip(hosts, paths):
        lens.setdefault(h, set()).add(len(p))
    keys = np.array([xxhash.xxh64_intdigest(h, SEED) for h in lens], np.uint64).view(np.int64)
    order, each = np.argsort(keys, kind="stable"), [np.array(sorted(v), np.int64) for v in lens.values()]
    each = [each[i] for i in order]
    size = lambda parts: np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
    texts = [h + p for h, p in zip(hosts, paths)]
    arrays = [digest, size(texts), np.array([len(h) for h in hosts], np.int64), block.astype(np.int64), keys[order], size(each), np.concatenate([np.zeros(0, np.int64), *each])]
    head = np.array([len(digest), len(keys), sum(len(e) for e in each)], np.int64)
    return head.tobytes() + b"".join(np.ascontiguousarray(a, np.int64).tobytes() for a in arrays) + b"".join(texts)


class Index:
    """A packed index, mapped into memory."""

    def __init__(self, path: str):
        n, m, k = np.fromfile(path, np.int64, 3)
        at, parts = 24, []
        for count in (n, n + 1, n, n, m, m + 1, k):
            parts.append(np.memmap(path, np.int64, "r", at, (int(count),)) if count else np.zeros(0, np.int64))
            at += 8 * int(count)
        self.digest, self.start, self.host_len, self.block, self.hosts, self.host_start, self.lens = parts
        self.blob = np.memmap(path, np.uint8, "r", at) if os.path.getsize(path) > at else np.zeros(0, np.uint8)

    def _is(self, rule: int, host: bytes, path: bytes) -> bool:
        lo, hi = self.start[rule], self.start[rule + 1]
        return hi - lo == len(host) + len(path) and self.host_len[rule] == len(host) and self.blob[lo:hi].tobytes() == host + path

    def longest(self, hosts: list[bytes], host_of: np.ndarray, paths: list[bytes]) -> np.ndarray:
        """For each url (its host as a number in hosts, and its path) the longest rule that fits, or -1."""
        owner, domain = [], []
        for i, h in enumerate(hosts):
            while h:
                owner.append(i)
                domain.append(h)
                h = h.partition(b".")[2]
        found = self._at(self.hosts, domain)
        known: dict[int, list] = {}
        for j in np.flatnonzero(found >= 0):
            known.setdefault(owner[j], []).append((domain[j], self.lens[self.host_start[found[j]] : self.host_start[found[j] + 1]]))
        url, host, path = [], [], []
        for r in np.flatnonzero(np.isin(host_of, list(known))):
            for h, lens in known[host_of[r]]:
                for k in lens[lens <= len(paths[r])]:
                    url.append(r)
                    host.append(h)
                    path.append(paths[r][:k])
        best, size = np.full(len(paths), -1), np.full(len(paths), -1)
        at = self._at(self.digest, [h + p for h, p in zip(host, path)])
        for j in np.flatnonzero(at >= 0):
            rule, key = at[j], self.digest[at[j]]
            while rule < len(self.digest) and self.digest[rule] == key:  # equal digests stand side by side
                if self._is(rule, host[j], path[j]) and len(host[j]) + len(path[j]) > size[url[j]]:
                    best[url[j]], size[url[j]] = rule, len(host[j]) + len(path[j])
                rule += 1
        return best

    @staticmethod
    def _at(keys: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """The first place of each text's digest in ascending keys, or -1."""
        asked = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], np.uint64).view(np.int64)
        at = np.searchsorted(keys, asked)
        inside = at < len(keys)
        inside[inside] = keys[at[inside]] == asked[inside]
        return np.where(inside, at, -1)


_open: dict[str, Index] = {}


def _probe(name: str):
    def run(batches):
        path = SparkFiles.get(name)
        if path not in _open:
            _open[path] = Index(path)
        index = _open[path]
        for batch in batches:
            hosts = batch.column("host").dictionary_encode()
            texts = [h.encode() for h in hosts.dictionary.to_pylist()]
            best = index.longest(texts, hosts.indices.to_numpy(), [p.encode() for p in batch.column("path").to_pylist()])
            rule = [None if b < 0 else index.blob[index.start[b] : index.start[b + 1]].tobytes().decode() for b in best]
            verdict = ["block" if b >= 0 and index.block[b] else "allow" for b in best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return run


def _by_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    packed = rules.withColumn("d", F.xxhash64(F.concat("host", "path"))).orderBy("d", "host").toArrow()  # of a checked size
    digest, block = packed.column("d").to_numpy(), packed.column("block").to_numpy()
    text = lambda c: [t.encode() for t in packed.column(c).to_pylist()]
    name = shared_file(urls.sparkSession, pack(digest, text("host"), text("path"), block))
    schema = T.StructType([*urls.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return urls.mapInArrow(_probe(name), schema)


def _by_joins(urls: DataFrame, rules: DataFrame) -> DataFrame:
    lens = rules.select("host", F.length("path").alias("k")).groupBy("host").agg(F.collect_set("k").alias("lens"))
    labels = F.split("host", r"\.")
    domain = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    asked = urls.select("host", "path").distinct().select("host", "path", domain.alias("domain"))
    asked = asked.join(lens.withColumnRenamed("host", "domain"), "domain").select("host", "path", "domain", F.explode("lens").alias("k")).filter("k <= length(path)")
    found = asked.withColumn("start", F.substr("path", F.lit(1), "k")).join(rules.toDF("domain", "start", "block"), ["domain", "start"])
    best = found.groupBy("host", "path").agg(F.max(F.struct(F.length("domain") + F.col("k"), F.concat("domain", "start").alias("rule"), "block")).alias("b"))
    out = urls.join(best, ["host", "path"], "left")
    return out.select(*urls.columns, F.col("b.rule").alias("rule"), F.when(F.col("b.block"), "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict: one row for each row of pages.

    A rule (host, path, verdict) fits its host and all subdomains where the url's path
    starts with the rule's; the longest one decides, and without one a url is allowed.
    A null url, or one without ``://``, has no host and no path and is allowed.  Rows of
    null or repeated ids, and repeated urls, are judged row by row; other columns are
    not read.  Of a rule given twice block counts.  Empty pages give no rows, and no
    rules allow all.  Long urls cost time by their labels and by the path lengths of
    the rules of their domains.
    """
    prepare(pages.sparkSession)
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rules = _clean(rules)
    size = rules.agg(F.sum(F.octet_length("host") * 2 + F.octet_length("path") + 64)).first()[0] or 0
    return _by_index(urls, rules) if size <= most_bytes else _by_joins(urls, rules)


# The rules of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


ORACLE = r"""
WITH r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
s AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s)
SELECT page_id, u.host, u.path, r.host || r.path AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(r.host || r.path) DESC NULLS LAST) = 1
"""
QUERIES = {"op11_url_filter": op11_url_filter}
ORACLE_SQL = {"op11_url_filter": ORACLE}
