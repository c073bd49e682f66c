"""URL filters, filter audit and source divergence against brute force."""

from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus import frame, rows
from wakeline.llm import filter_audit, source_divergence, url_filter

URL = "page_id long, url string, host string, rid string"


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def judged(url, rules):
    host, path = split_url(url)
    fits = [(len((h + p).encode()), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")


@pytest.mark.parametrize("most", [url_filter.MOST_BYTES, 0])
def test_url_filter(spark, most):
    rng = random.Random(3)
    hosts = ["a.example.net", "example.net", "xexample.net", "Net", "net", "b.ORG", "org", "example.com", "www.example.com", "münchen.de", "", "net:80", "a..net", ".net", "net."]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/de/a?b", "/fr/#x", "?q=/en/", "#/de/", "/fr/" + "y" * 5000, "/dé/ü", "//x", "/de/://z"]
    urls = [f"{s}://{h}{p}" for s in ("http", "https", "") for h in hosts for p in paths]
    urls += [None, "", "example.net/en/", "http:/example.net/", "mailto:a@net", "://", "http://net\n/x"] + urls[:40]
    data = [(None if i % 50 == 0 else i % 400, u, "clash", "clash") for i, u in enumerate(urls)]
    rules = url_filter.RULES + [("münchen.de", "/dé/", "block"), ("net", None, "allow"), ("net", "/", "allow"), ("", "/", "block"), (None, "/", "block"), ("Example.com", "/de/a", "allow")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filter.judge(spark.createDataFrame(data, URL).repartition(3), table, most_bytes=most).collect()
    plain = [("münchen.de", "/dé/", "block"), ("net", "", "allow"), ("example.com", "/de/a", "allow"), *url_filter.RULES]
    assert sorted(map(repr, got)) == sorted(repr(r) for r in spark.createDataFrame([(i, *judged(u, plain)) for i, u, *_ in data], "page_id long, host string, path string, rule string, verdict string").collect())
    assert not url_filter.judge(spark.createDataFrame([], URL), table, most_bytes=most).count()
    none = url_filter.judge(spark.createDataFrame(data, URL), table.limit(0), most_bytes=most)
    assert none.filter("verdict = 'allow' and rule is null").count() == len(data)


def test_equal_digests_do_not_decide(tmp_path):
    """Two rules under one digest: the stored strings tell them apart, and a url of neither gets none."""
    path = tmp_path / "x"
    digest = np.array([url_filter.xxhash.xxh64_intdigest(b"net/a", url_filter.SEED)] * 3, np.uint64).view(np.int64)
    path.write_bytes(url_filter.pack(digest, [b"org", b"net", b"net"], [b"/b", b"/b", b"/a"], np.array([True, True, False])))
    index = url_filter.Index(str(path))
    assert index.longest([b"net", b"org"], np.array([0, 0, 1]), [b"/a/x", b"/b", b"/b"]).tolist() == [2, -1, -1]


def audited(docs, labels):
    words = re.compile("[^\x20\x09-\x0d]+")
    first, facts = {}, []
    for i, text, _, _, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, _, source, _ in docs:
        t = text or ""
        w = words.findall(t)
        low = first.get(t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), low is not None and (i is None or low < i)]
        facts.append((source or "", "".join(k for k, f in zip("ABCDE", fails) if f), *[max([x[k] == 1 for x in labels if x[0] == i and i is not None], default=False) for k in (1, 2)]))
    out, total = [], {}
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, k in enumerate(order):
                gone = [f for f in left if k in f[1]]
                left = [f for f in left if k not in f[1]]
                out.append([part, "".join(order), step + 1, len(left), len(gone), sum(k in f[1] for f in own) - len(gone), sum(f[1] == k for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)])
                total[part, k] = total.get((part, k), 0) + len(gone)
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.mark.parametrize("digest", [F.xxhash64, lambda *c: F.pmod(F.xxhash64(*c), F.lit(3))])
def test_filter_audit(spark, digest):
    """With real hashes, and with hashes of three values, where only the texts tell documents apart."""
    rng = random.Random(5)
    base = ["x" * 256 + "a", "x" * 256 + "b", "x" * 256, "y " * 5000 + "end", "y " * 5000 + "enD", "", None, "AB # c", "ab\x0bcd\x0cef\rg", "é" * 300, "e" * 300]
    docs = rows(2, 60) + [(rng.choice([7, 8, 9, None, 20_000 + i]), rng.choice(base), "en", rng.choice(["web", None, "", "Ü"]), "1") for i in range(120)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i, *_ in docs for _ in range(rng.randint(0, 2))]
    got = filter_audit.audit(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), digest=digest)
    assert sorted(map(tuple, got.collect())) == audited(docs, labels)


def test_refinement_drops_what_stands_alone(spark):
    data = [(1, 5, [1]), (2, 5, [1]), (3, 5, [2]), (4, 6, [1]), (5, 300, [1, 2]), (6, 300, [1, 2]), (7, 300, [1, 3]), (8, 0, []), (9, 0, [])]
    parts = filter_audit.refined(spark.createDataFrame(data, "id long, n long, blocks array<long>"))
    assert sorted(r["id"] for p in parts for r in p.collect()) == [1, 2, 5, 6, 8, 9]


def test_filter_audit_of_nothing(spark):
    empty = filter_audit.audit(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert not empty.count() and empty.columns[:3] == ["part", "filter_order", "step"]


def diverging(docs, least, top):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    groups, in_docs, occ = set(), {}, {}
    for _, text, lang, source, _ in docs:
        g = (lang or "", source or "")
        groups.add(g)
        found = term.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        for t in set(found):
            in_docs[g[0], t] = in_docs.get((g[0], t), 0) + 1
        for t in found:
            occ[g, t] = occ.get((g, t), 0) + 1
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted(s for k, s in groups if k == lang)
        kept = [t for (k, t), n in in_docs.items() if k == lang and n >= least]
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * len(kept))  # noqa: E731, B023
        count = {s: {t: occ.get(((lang, s), t), 0) for t in kept} for s in sources}
        p = {s: {t: share(c, sum(v.values())) for t, c in v.items()} for s, v in count.items()}
        whole = {t: sum(count[s][t] for s in sources) for t in kept}
        q = {t: share(c, sum(whole.values())) for t, c in whole.items()}
        for s in sources:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            own = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, n + 1) for part, r in (("pair", pair), ("term", own)) for n, (v, i) in enumerate(r)]
    return sorted(out)


@pytest.mark.parametrize(("block", "tile", "top"), [(512, 128, 50), (7, 2, 3)])
def test_source_divergence(spark, block, tile, top):
    docs = rows(4, 150) + [(None, "Ünï über-tief\x00x", None, f"s{i % 7}", "1") for i in range(40)] + [(1, "", "zz", f"s{i}", "1") for i in range(3)] + [(2, "aa aa bb", "one", "x", "1")] * 12
    got = source_divergence.divergence(frame(spark, docs), 9, top, block, tile)
    assert sorted(map(tuple, got.collect())) == diverging(docs, 9, top)


def test_source_divergence_of_nothing(spark):
    assert not source_divergence.divergence(frame(spark, [])).count()


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    total = rng.integers(0, 2**52, 500)
    count, kept = (total * rng.random(500)).astype(np.int64), rng.integers(1, 2**20, 500)
    got = source_divergence.shares(count, total, kept)
    assert got.tolist() == [1 + 10**9 * (int(c) + 5) // (int(n) + 5 * int(v)) for c, n, v in zip(count, total, kept)]
    assert source_divergence.shares(np.array([7]), np.array([7]), np.array([1])).tolist() == [10**9 + 1]
