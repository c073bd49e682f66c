"""Tokens, quality, toxicity and decontamination against libraries, brute force and held-out rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from corpus import edited, frame, prose, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wakeline.llm.decontamination import decontaminate
from wakeline.llm.quality import PRIOR, QUANTILE, SHORT, Model, perplexities, quality
from wakeline.llm.token_counts import token_counts
from wakeline.llm.toxicity import score, train


def test_token_counts_match_the_library(spark):
    data = rows() + [(30_000, "a<|endoftext|>b <|endoftext|><|endoftext|>", None, None, None), (30_001, "I'll  don't\t\n\n x  　 ١٢٣ 日本語 🙂" * 9, None, None, None), (None, "ids may be null", None, None, None), (None, "aaaaaaaa" * 500, None, None, None)]
    rng = random.Random(3)
    data += [(40_000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH"[: 4 + 10 * i]) for _ in range(20_000)) + "a" * i, None, None, None) for i in range(4)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted((r[0] or -1, len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 1024) for r in data)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(frame(spark, data), path).collect())
    assert got == want
    assert token_counts(frame(spark, []), path).count() == 0
    assert token_counts(frame(spark, data[:2]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), path).first().doc_id == "d1"


def brute_perplexity(trusted, texts):
    """Interpolated modified Kneser-Ney over pairs of words, with dictionaries."""
    pairs = lambda t: list(zip(["<s>", *(w := re.findall(r"[^\x20\x09-\x0D]+", t))], [*w, "</s>"]))
    two = Counter(p for t in trusted for p in pairs(t))
    one = Counter(w for _, w in two)

    def off(c):
        n1, n2, n3, n4 = (float(sum(v == i for v in c.values())) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        return [0.0, *(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))]

    d2, d1, every, after = off(two), off(one), sum(one.values()), defaultdict(list)
    for (h, _), v in two.items():
        after[h].append(v)
    left = sum(d1[min(v, 3)] for v in one.values()) / every

    def p(h, w):
        q = (one[w] - d1[min(one[w], 3)]) / every + left / (len(one) + 1)
        if seen := after.get(h):
            c = two[h, w]
            q = (c - d2[min(c, 3)]) / sum(seen) + sum(d2[min(v, 3)] for v in seen) / sum(seen) * q
        return q

    return [math.exp(-sum(math.log(p(*x)) for x in pairs(t)) / len(pairs(t))) for t in texts]


@pytest.mark.parametrize("shards", [1, 3])
def test_perplexities_match_brute_force(spark, shards, monkeypatch):
    monkeypatch.setattr("wakeline.llm.quality.BLOCK_BYTES", 30_000)  # in the driver: several blocks
    data = [r for r in rows(n=60) if len(r[1] or "") < 60_000]
    texts = [(i, r[1] or "") for i, r in enumerate(data)]
    df = spark.createDataFrame(texts, "rid long, text string").repartition(3, "rid")
    got = {r.rid: (r.n, r.perplexity) for r in perplexities(df, Model(df.filter("rid % 2 = 0"), shards)).collect()}
    want = brute_perplexity([t for i, t in texts if i % 2 == 0], [t for _, t in texts])
    assert len(got) == len(texts)
    assert all(n == len(re.findall(r"[^\x20\x09-\x0D]+", texts[i][1])) + 1 and math.isclose(p, want[i], rel_tol=1e-9) for i, (n, p) in got.items())


def test_quality_frees_the_disk_of_each_part(spark, monkeypatch):
    """Texts are scored in parts, no shuffle of an earlier step stays on disk, and the session is as before."""
    from wakeline.llm import quality as Q

    rng, key = random.Random(21), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    data = [(i, prose(rng, rng.randint(0, 120)), None, None, None) for i in range(400)] + [(900, None, None, None, None), (901, "", None, None, None)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(400)], "doc_id long, quality int")
    run = lambda: {r.doc_id: (r.perplexity, r.limit, r.rejected) for r in quality(frame(spark, data), labels).collect()}
    whole, asked, write = run(), [], Q.table

    def counted(df):
        out = write(df)
        asked.append((spark.conf.get(key), out.count() if "perplexity" in out.columns else None))
        return out

    monkeypatch.setattr(Q, "table", counted)
    monkeypatch.setattr(Q, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(Q, "PART_BLOCKS", 2, raising=False)
    before = spark.conf.get(key)
    got = run()
    assert spark.conf.get(key) == before and {x for x, _ in asked} == {"true"}
    counts = [n for _, n in asked if n is not None]
    assert sum(counts) == len(data) and max(counts) < 0.5 * len(data), counts
    assert got.keys() == whole.keys() and all(g[2] == w[2] and g[:2] == pytest.approx(w[:2], rel=1e-9) for g, w in ((got[i], whole[i]) for i in got))


def test_quality_limits_by_language(spark):
    """Limits, and what they reject, recomputed from the perplexities: one language has few trusted rows, one none."""
    rng = random.Random(8)
    lang = lambda i: "xx" if i >= 580 else "fr" if i % 30 == 0 else None if i % 7 == 0 else "en"
    data = [(i, prose(rng, rng.randint(0, 70)) if i % 9 else "".join(chr(rng.randint(33, 126)) + " " * (j % 4 == 0) for j in range(200)), lang(i), "web", None) for i in range(600)]
    data += [(3, data[3][1], "en", "web", None), (None, None, None, None, None), (None, prose(rng, 30), "fr", None, None)]
    labels = spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(580)], "doc_id long, quality int")
    got = quality(frame(spark, data), labels)
    ids = {r[0]: r[1] for r in got.join(frame(spark, data).select("doc_id").distinct(), "doc_id").select("doc_id", "rid").collect()}
    assert len(ids) >= 600 and got.count() == len(data)
    held = {r.rid for r in spark.createDataFrame([(r.rid,) for r in got.collect()], "rid long").filter("pmod(xxhash64('held out', rid), 1000) < 250").collect()}
    out = got.collect()
    n = {r.rid: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1 for r, t in _texts_of(out, data)}
    of = {r.rid: l for r, l in _langs_of(out, data)}
    steady = {r.rid: math.log(r.perplexity) - SHORT / math.sqrt(n[r.rid]) for r in out}
    known = [r for r in out if r.rid in held and r.doc_id is not None and r.doc_id < 580 and r.doc_id % 9]
    quantile = lambda v: sorted(v)[max(math.ceil(QUANTILE * len(v)) - 1, 0)]
    every = quantile([steady[r.rid] for r in known])
    for r in out:
        own = [steady[x.rid] for x in known if of[x.rid] == of[r.rid]]
        limit = (quantile(own) * len(own) + every * PRIOR) / (len(own) + PRIOR) if own else every
        assert math.isclose(math.log(r.limit), limit + SHORT / math.sqrt(n[r.rid]), rel_tol=1e-9)
        assert r.rejected == (r.perplexity > r.limit)


def _paired(out, data, column):
    """Rows of the result with the input row they come from: both in the order of (id, text, lang), nulls last."""
    key = lambda r: tuple((x is None, x or 0 if i == 0 else x or "") for i, x in enumerate((r[0], r[1], r[2])))
    return [(r, d[column]) for r, d in zip(sorted(out, key=lambda r: r.rid), sorted(data, key=key))]


def _texts_of(out, data):
    return _paired(out, data, 1)


def _langs_of(out, data):
    return _paired(out, data, 2)


def test_quality_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(5)
    data = [(i, prose(rng, 60) if i % 10 else "".join(chr(rng.randint(33, 126)) for _ in range(300)), "en", "web", None) for i in range(600)] + [(None, None, None, None, None)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(0, 600, 1)], "doc_id long, quality int")
    got = quality(frame(spark, data), labels).collect()
    assert len(got) == len(data)
    # a very long text is scored whole; trusted ones of its kind set a limit that it meets
    more = [(9000 + i, prose(rng, 20_000), "en", None, None) for i in range(12)]
    known = labels.union(spark.createDataFrame([(9000 + i, 1) for i in range(11)], "doc_id long, quality int"))
    long_ = quality(frame(spark, data + more), known).filter("doc_id >= 9000").collect()
    assert len(long_) == 12 and not any(r.rejected for r in long_)
    junk = [r.rejected for r in got if r.doc_id is not None and r.doc_id % 10 == 0]
    clean = [r.rejected for r in got if r.doc_id is not None and r.doc_id % 10]
    assert all(junk) and sum(clean) <= 0.02 * len(clean)
    # without trusted text nothing is rejected
    none = quality(frame(spark, data[:20]), labels.filter("doc_id < 0")).collect()
    assert len(none) == 20 and not any(r.rejected for r in none)
    assert quality(frame(spark, []), labels).count() == 0


def _machine(rows, rule, n=3000, factors=None):
    """Held-out accuracy of a machine fitted on the first two thirds, with the pair marked toxic by rule."""
    from wakeline.llm import toxicity

    texts = pa.array([t for t, _, _ in rows], pa.string())
    values, limits = toxicity.term_sets(texts)
    y = np.array([int(rule(a, b)) for _, a, b in rows])
    cut = 2 * n // 3
    m = toxicity.fit(y[:cut], values[: limits[cut]], limits[: cut + 1], **({} if factors is None else {"factors": factors}))
    return float(((m.score(values, limits) >= 0.5) == y)[cut:].mean())


def test_toxicity_learns_what_no_single_term_tells():
    """One of two terms, but not both: each alone is as frequent in either label, so an additive refit learns nothing."""
    rng = random.Random(6)
    rows_ = []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = prose(rng, 20).split() + ["insult"] * a + ["mention"] * b
        rng.shuffle(w)
        rows_.append((" ".join(w), a, b))
    assert _machine(rows_, lambda a, b: a != b) > 0.95
    assert _machine(rows_, lambda a, b: a != b, factors=0) < 0.6
    assert _machine(rows_, lambda a, b: a and b) > 0.95


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    data, labels = [], []
    for i in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = prose(rng, 20).split() + ["insult"] * insult + ["mention"] * group
        rng.shuffle(words)
        data.append((i, " ".join(words), "en", "web", None))
        labels.append((i, int(insult and group)))
    data += [(5000, None, None, None, None), (None, data[0][1], None, None, None), (0, data[0][1], None, None, None), (5001, "insult mention " * 50_000, None, None, None)]
    machine = train(frame(spark, data), spark.createDataFrame(labels, "doc_id long, toxic int"), lambda i: i < 2000)
    out = score(frame(spark, data), machine).collect()
    got = {r.doc_id: r for r in out}
    test = [(got[i].predicted, y) for i, y in labels if i >= 2000]
    assert sum(p == y for p, y in test) / len(test) > 0.97
    assert 0 <= got[5000].score <= 1 and got[None].score == got[0].score and got[5001].predicted == 1 and len(out) == len(data)
    # repeated ids do not multiply the sample, and a second fit agrees
    few = [train(frame(spark, data * 3), spark.createDataFrame(labels, "doc_id long, toxic int"), lambda i: i < 2000, sample=500) for _ in range(2)]
    assert np.array_equal(few[0].terms, few[1].terms) and np.array_equal(few[0].w, few[1].w)
    nothing = train(frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int"), lambda i: i < 2000)
    assert {r.score for r in score(frame(spark, data[:5]), nothing).collect()} == {0.5}


def test_toxicity_against_pairs_one_by_one():
    """A refit and scores whose interactions are summed pair by pair, without the square of the sum."""
    from wakeline.llm import toxicity

    rng = random.Random(8)
    words, y = [], []
    for _ in range(240):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = prose(rng, 8).split() + ["Insult"] * a + ["mention"] * b + ["vile"] * (a and b)
        rng.shuffle(w)
        words.append(w)
        y.append(int(a and b))
    number = {w: int(toxicity.term_sets(pa.array([w]))[0][0]) for w in {w for ws in words for w in ws}}
    m = toxicity.fit(np.array(y), *toxicity.term_sets(pa.array([" ".join(w) for w in words])))
    terms = [int(t) for t in m.terms]
    assert len(terms) >= 3
    held = np.array([[float(t in {number[w] for w in ws}) for t in terms] for ws in words])
    pairs = [(i, j) for i in range(len(terms)) for j in range(i + 1, len(terms))]

    def raw(w, v, bias):
        return bias + held @ w + sum(held[:, i] * held[:, j] * float(v[i] @ v[j]) for i, j in pairs)

    y = np.array(y, float)
    p, n = y.mean(), len(y)
    w, v, bias = np.zeros(len(terms)), np.random.default_rng(3).normal(0, 0.01, m.v.shape), math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    first, second = [0, 0, 0], [0, 0, 0]
    for step in range(1, toxicity.STEPS + 1):
        g = np.where(y > 0, 0.5 / p, 0.5 / (1 - p)) * (1 / (1 + np.exp(-raw(w, v, bias))) - y) / n
        dv = toxicity.DECAY * v
        for i, j in pairs:
            both = float(g @ (held[:, i] * held[:, j]))
            dv[i] += both * v[j]
            dv[j] += both * v[i]
        grads = [held.T @ g + toxicity.DECAY * w / len(w), dv, g.sum()]
        first = [0.9 * x + 0.1 * d for x, d in zip(first, grads)]
        second = [0.999 * x + 0.001 * d * d for x, d in zip(second, grads)]
        w, v, bias = (x - toxicity.RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-9) for x, a, b in zip((w, v, bias), first, second))
    assert np.allclose(m.w, w, atol=1e-4) and np.allclose(m.v @ m.v.T, v @ v.T, atol=1e-4) and abs(m.bias - bias) < 1e-4
    got = m.score(*toxicity.term_sets(pa.array([" ".join(w) for w in words])))
    assert np.allclose(got, 1 / (1 + np.exp(-raw(m.w, m.v, m.bias))), atol=1e-9)
    assert ((got >= 0.5) == (y > 0)).mean() > 0.95


def test_toxicity_of_texts_without_known_terms(spark):
    """Texts that hold terms, but none of the machine's, and are scored with no other text beside them."""
    from wakeline.llm import toxicity

    m = toxicity.fit(np.array([1] * 30 + [0] * 30), *toxicity.term_sets(pa.array(["insult vile"] * 30 + ["mention kind"] * 30)))
    assert len(m.terms) == 4 and len(m.score(*toxicity.term_sets(pa.array([], pa.string())))) == 0
    data = [(i, t, "en", "web", None) for i, t in enumerate(["zzz", "insult vile zzz", None, "qqq zzz", "mention kind", ""])]
    alone = [float(m.score(*toxicity.term_sets(pa.array([d[1]], pa.string())))[0]) for d in data]
    assert {alone[i] for i in (0, 2, 3, 5)} == {alone[0]} and abs(alone[0] - 1 / (1 + math.exp(-m.bias))) < 1e-12
    assert alone[1] > 0.7 and alone[4] < 0.3
    got = {r.doc_id: r.score for r in score(frame(spark, data).coalesce(1), m).collect()}
    for i, d in enumerate(data):  # a table of one row is one batch
        assert score(frame(spark, [d]), m).first().score == got[i] == alone[i]


def weighted(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return words, Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute_contaminated(docs, items):
    out = {}
    for i, text, *_ in docs:
        words, hit = weighted(text)[0], []
        for k, item in items:
            need, b = weighted(item)
            if 0 < len(need) < 5:  # its own words in a row, at any place
                if any(words[s : s + len(need)] == need for s in range(len(words))):
                    hit.append(k)
                continue
            if len(words) < 5:
                continue
            for s in range(max(len(words) - len(need), 0) + 1) if need and words else []:
                _, a = weighted(" ".join(words[s : s + len(need)]))
                both = sum((a & b).values())
                if both / (sum(a.values()) + sum(b.values()) - both) >= 0.8 - 1e-12:
                    hit.append(k)
                    break
        out[i] = sorted(hit)
    return out


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, rng.choice([1, 3, 5, 20, 45]))) for i in range(12)] + [(20, None), (21, " ")]
    docs = [r for r in rows(n=60) if len(r[1] or "") < 3000]
    for j in range(36):
        item = items[j % 12][1]
        docs.append((40_000 + j, " ".join([prose(rng, j), edited(rng, item, (0.0, 0.02, 0.08)[j // 12]), prose(rng, 9)]), "en", "web", None))
    docs.append((41_000, items[0][1].upper(), "en", "web", None))
    got = {r.doc_id: r["items"] for r in decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_contaminated(docs, items)
    assert got == want and sum(map(bool, want.values())) >= 10
    assert decontaminate(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    clean = decontaminate(frame(spark, docs[:5]), spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(clean) == 5 and not any(r.contaminated for r in clean)




def test_short_items_are_found_at_every_place(spark):
    items = spark.createDataFrame([(1, "capital of old france"), (2, "old france"), (3, "x"), (4, "a b c d e")], "item_id long, text string")
    texts = ["capital of old france", "x capital of Old France y z w v u", "of old", "xx yy", "a b c d", "z a b c d e z", "", None]
    got = {r.doc_id: r["items"] for r in decontaminate(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), items).collect()}
    assert got == {0: [1, 2], 1: [1, 2, 3], 2: [], 3: [], 4: [], 5: [4], 6: [], 7: []}


@pytest.mark.parametrize("size", [9, 18, 45, 100])
def test_the_radius_holds_what_is_similar_enough(size):
    """Windows just at the similarity of 0.8: nearly all fingerprints lie within the radius."""
    from wakeline.llm.decontamination import RADIUS, fingerprint_planes, fingerprints

    rng = np.random.default_rng(size)
    apart = int(size * (1 - 0.8) / (1 + 0.8))  # shingles of each that the other lacks
    missed = 0
    for _ in range(500):
        s = rng.integers(1, 2**63, size + apart, dtype=np.uint64)
        a, b = (fingerprints(fingerprint_planes(x).sum(0, keepdims=True))[0] for x in (s[:size], s[apart:]))
        missed += int(np.bitwise_count(a ^ b)) > RADIUS
    assert missed <= 5


def test_decontamination_in_passes_and_with_ids_of_text(spark, monkeypatch):
    monkeypatch.setattr("wakeline.llm.decontamination.ITEMS", 3)
    rng = random.Random(21)
    items = [(f"item{i}", prose(rng, 12)) for i in range(8)]
    docs = [(None if i % 4 == 0 else 5, prose(rng, 9) + " " + items[i % 8][1] + " " + prose(rng, 4 * i), None, None, None) for i in range(16)]
    got = decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id string, text string")).collect()
    assert len(got) == 16 and sorted(r["items"][0] for r in got) == sorted(f"item{i % 8}" for i in range(16)) and all(r.n_items == 1 for r in got)
