"""Near-duplicates, repeated strings, lines and embeddings against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from corpus import WORDS, components, edited, frame, prose, rows
from pyspark.sql import functions as F

from wakeline.llm.embedding_dedup import near_vectors
from wakeline.llm.line_dedup import drop_lines
from wakeline.llm.minhash import near_duplicates
from wakeline.llm.suffix_dedup import remove_repeats
from wakeline.llm.suffix_sort import suffix_array


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(data, k):
    sets = {r[0]: shingle_set(r[1], k) for r in data}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c, c == i) for i, c in components(ids, links).items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_brute_force(spark, k):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark), k=k).collect()}
    assert got == brute_components(rows(), k)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = prose(rng, 80)
    data = [(i, edited(rng, base, rng.choice([0.01, 0.04, 0.07])), None, None, None) for i in range(250)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, data), k=2).collect()}
    assert got == brute_components(data, 2)


@pytest.mark.parametrize("leader", [7, 50])
def test_members_of_a_leader_meet(spark, leader):
    """Sets far from their bucket's hub and near one leader: the leader stays their hub, however ids fall."""
    from wakeline.llm import minhash as M

    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    core, joint, part = words[:1000], words[1000:1040], rng.sample(words[:1000], 870)
    texts = {leader: core, 100: words[2000:]}
    for n, rid in enumerate((11, 12, 13)):
        texts[rid] = part + joint + words[1100 + 90 * n : 1190 + 90 * n]
    for n, rid in enumerate(range(21, 26)):
        texts[rid] = rng.sample(core, 870) + words[1400 + 130 * n : 1530 + 130 * n]
    rows_ = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "rid long, text string")
    reps = rows_.mapInArrow(M._sketches(1), "rid long, n long, s1 long, s2 long, regs binary").select("rid", "n", "regs")
    members = spark.createDataFrame([(1, i, 100) for i in texts], "bucket long, rid long, hub long")
    tested = spark.createDataFrame([], "a long, b long, n long, diff binary, linked boolean")
    more = M._left_over(members, tested, spark.createDataFrame([], "node long, root long"), reps, 80, 100)
    second = M._compare(more, reps, rows_, 1, 80, 100)
    found = second.filter("linked").select("a", "b").union(M._among(second, 80, 100)).collect()
    root = components(list(texts), [tuple(r) for r in found])
    assert root[11] == root[12] == root[13] and sum(v == root[11] for v in root.values()) == 3


def test_crowded_buckets_with_shuffled_ids(spark):
    """Groups of near copies around few texts: no link between different texts is lost, whatever the ids."""
    rng = random.Random(31)
    bases = [prose(rng, 40) for _ in range(5)]
    texts = [edited(rng, rng.choice(bases), rng.choice([0.02, 0.05, 0.08, 0.11])) for _ in range(400)]
    data = [(i, t, None, None, None) for i, t in zip(rng.sample(range(10_000), 400), texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, data), k=2).collect()}
    assert got == brute_components(data, 2)


def test_many_short_texts_of_frequent_shingles(spark):
    """Crowded buckets whose hub tells nothing about most members."""
    rng = random.Random(11)
    base = [[rng.choice(WORDS[:6]) for _ in range(rng.randint(8, 13))] for _ in range(800)]
    texts = base + [b + [rng.choice(WORDS[:6])] for b in base[::8]]
    rng.shuffle(texts)
    data = [(i, " ".join(t), None, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, data), k=2).collect()}
    assert got == brute_components(data, 2)


def test_buckets_of_several_far_clusters(spark):
    """Clusters over one shared passage: the hub of a bucket is far from most members, and links join members that are all apart from it."""
    rng = random.Random(17)
    shared = prose(rng, 40)
    data = []
    for c in range(60):
        own = prose(rng, 25)
        for _ in range(8):
            data.append((len(data), edited(rng, f"{shared} {own}", rng.choice([0.0, 0.02, 0.04, 0.06])), None, None, None))
    for k in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, data), k=k).collect()}
        assert got == brute_components(data, k)


def test_candidates_of_near_copies_grow_with_their_number(spark):
    """Pairs that are compared for a group of near copies: four times the copies make about four times the pairs."""
    from wakeline.llm import minhash

    rng = random.Random(5)
    base = prose(rng, 60)
    counts = {}
    for n in (150, 600):
        data = [(i, edited(rng, base, rng.choice([0.02, 0.05, 0.1])), None, None, None) for i in range(n)]
        asked, compare = [], minhash._compare

        def counted(pairs, *rest):
            asked.append(pairs.count())
            return compare(pairs, *rest)

        minhash._compare = counted
        try:
            got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, data), k=5).collect()}
        finally:
            minhash._compare = compare
        assert got == brute_components(data, 5)
        counts[n] = asked
    assert sum(counts[600]) <= 6 * sum(counts[150])


def test_near_copies_meet_few_hubs(spark, monkeypatch):
    """The buckets of a group agree on their hubs: a member does not meet one for each of its buckets."""
    from wakeline.llm import minhash

    rng = random.Random(8)
    base = prose(rng, 150)
    data = [(i, edited(rng, base, rng.choice([0.01, 0.03, 0.05])), None, None, None) for i in range(300)]
    asked, compare = [], minhash._compare
    monkeypatch.setattr(minhash, "_compare", lambda pairs, *rest: asked.append(pairs.count()) or compare(pairs, *rest))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, data), k=2).collect()}
    assert got == brute_components(data, 2)
    assert sum(asked) <= 1.5 * len(data), asked


def test_near_copies_whose_first_ids_are_far_out(spark, monkeypatch):
    """The copies that differ most have the ids whose hashes come first: the group still meets a copy in its middle, and few meet by registers."""
    from wakeline.llm import minhash

    rng = random.Random(12)
    base = prose(rng, 120)
    copies = [edited(rng, base, 0.2 * (1 - i / 300) ** 2) for i in range(300)]
    ids = [r.id for r in spark.range(300).orderBy(F.xxhash64("id")).collect()]
    data = [(i, t, None, None, None) for i, t in zip(ids, copies)]
    met, calls = [], minhash._calls

    def counted(units, kernel, rows):
        out = calls(units, kernel, rows)
        if "_by_registers" in kernel.__qualname__:
            met.append((units.count(), out.count()))
        return out

    monkeypatch.setattr(minhash, "_calls", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, data), k=2).collect()}
    assert got == brute_components(data, 2)
    assert sum(out for _, out in met) <= len(data), met


def test_pairs_that_meet_by_registers():
    """Each pair once, in its first band, and not if both were compared with the hub."""
    import pyarrow as pa

    from wakeline.llm import minhash as M

    rng = random.Random(13)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(w if rng.random() > 0.01 else f"x{rng.random()}" for w in base) for _ in range(90)]
    v, limits = M.set_hashes(pa.array(texts), 2)
    regs = M.registers(v, limits)
    same = M.equal_registers(regs)
    assert (same == [[((x == y) & (x > 0)).sum() for y in regs] for x in regs])[~np.eye(90, dtype=bool)].all()
    keys = M.band_keys(regs)
    run, n = M._by_registers(0.8), np.diff(limits)

    def pairs(band, far):
        at = np.flatnonzero(keys[:, band] == Counter(keys[:, band]).most_common(1)[0][0])
        columns = {"rid": at, "unit": 0 * at, "root": at, "side": 0 * at, "n": n[at], "far": far[at], "band": np.full(len(at), band, np.int32), "regs": pa.array([regs[i].tobytes() for i in at], pa.binary())}
        return at, set(zip(*run(None, pa.table(columns)).to_pydict().values()))

    for band in (0, 3):
        at, found = pairs(band, np.ones(90, bool))
        new = {(x, y) for x in at for y in at if x < y and (keys[x, :band] != keys[y, :band]).all()}
        near = lambda x, found=found: {x} | {b for a, b in found if a == x} | {a for a, b in found if b == x}
        assert len(at) > 20 and new and all(near(x) & near(y) for x, y in new)
        assert all((min(p), max(p)) in new for p in found)
        assert not pairs(band, np.zeros(90, bool))[1]


def test_rows_without_a_key_of_their_own(spark):
    data = [(1, "a b c", None, None, None), (1, "a b c", None, None, None), (None, "a b c", None, None, None), (None, None, None, None, None)]
    got = near_duplicates(frame(spark, data), k=2).collect()
    assert len(got) == 4 and sum(r.kept for r in got) == 2
    assert near_duplicates(frame(spark, []), k=2).count() == 0


def test_very_long_near_copies_without_ids(spark):
    rng = random.Random(30)
    words = prose(rng, 80_000).split(" ")
    near = list(words)
    for i in range(0, 80_000, 200):
        near[i] = "changed"
    data = [(None, " ".join(words), None, None, None), (None, " ".join(near), None, None, None), (3, " ".join(words[:40_000]), None, None, None), (3, None, None, None, None)]
    got = near_duplicates(frame(spark, data), k=5).collect()
    assert len(got) == 4 and sum(r.kept for r in got) == 3


def brute_repeats(data, length=100):
    seen, out = set(), {}
    for i, text in sorted(((r[0], r[1]) for r in data)):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_repeated_strings_match_brute_force(spark):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(frame(spark)).collect()}
    assert got == brute_repeats(rows())
    assert remove_repeats(frame(spark, [])).count() == 0


def test_texts_without_own_ids_and_one_repeated_byte(spark):
    data = [(None, "ab" * 120, None, None, None), (None, "ab" * 120, None, None, None)]
    got = sorted((r.n_removed, r.n_spans) for r in remove_repeats(frame(spark, data)).collect())
    assert got == [(238, 1), (240, 1)]


@pytest.mark.parametrize("letters", [1, 2, 4, 250])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for n in (0, 1, 2, 3, 10, 200, 3000):
        t = rng.integers(0, letters, n).astype(np.uint8)
        b = t.tobytes()
        assert suffix_array(t).tolist() == sorted(range(n), key=lambda i: b[i:])


def test_suffix_array_of_text_recurses():
    """Enough text for thousands of names at several levels."""
    rng = random.Random(2)
    t = np.frombuffer(" ".join(prose(rng, 400) if i % 3 else "the same passage again " * 20 for i in range(24)).encode(), np.uint8)
    b = t.tobytes()
    assert suffix_array(t).tolist() == sorted(range(len(b)), key=lambda i: b[i : i + 9000])


def brute_lines(data, least=10):
    mask = lambda x: re.sub("[^ 0-9]*[0-9][^ ]*", "<*>", x.strip(" "))
    docs = {r[0]: (r[1] or "").split("\n") for r in data}
    leaves, count = {}, {}
    for i, lines in docs.items():
        for m in {mask(x) for x in lines} - {""}:
            t = m.split(" ")
            leaves.setdefault((len(t), *t[:3]), []).append((i, m))
            count[m] = count.get(m, 0) + 1
    drop = {m for m, n in count.items() if n >= least}
    for pairs in leaves.values():
        lines = {m: m.split(" ") for _, m in pairs}
        if len(lines) < 2 or len(pairs) < least:
            continue
        weight = Counter(m for _, m in pairs)
        width = len(next(iter(lines.values())))
        kept = {m: [sum(weight[o] for o in lines if lines[o][k] == t[k]) >= least for k in range(width)] for m, t in lines.items()}
        for _ in range(4):  # as the lines are, and three levels above
            level = {m: tuple(x if keep else None for x, keep in zip(t, kept[m])) for m, t in lines.items()}
            for m, t in level.items():
                if sum(x is not None for x in t) >= 0.7 * width and len({i for i, o in pairs if level[o] == t}) >= least:
                    drop.add(m)
            near = {(m, k, d): next(((j, t[j]) for j in range(k + d, -1 if d < 0 else width, d) if kept[m][j]), None) for m, t in lines.items() for k in range(width) for d in (-1, 1)}
            share = lambda m, k, d: [sum(weight[o] for o, t in lines.items() if near[o, k, d] == near[m, k, d] and (not same or t[k] == lines[m][k])) for same in (True, False)]  # noqa: E731, B023
            new = {m: [keep and all(2 * a >= b for a, b in (share(m, k, -1), share(m, k, 1))) for k, keep in enumerate(row)] for m, row in kept.items()}
            kept = new
    return {i: [x for x in lines if mask(x) not in drop] for i, lines in docs.items()}


def test_lines_match_brute_force(spark):
    data = rows() + [(20_000 + i, f"user {i} logged in from {i * 7} at noon\nsame words here {'x' if i % 5 else 'y'} every time", "en", "web", None) for i in range(14)]
    got = {r.doc_id: (r.kept or "").split("\n") if r.n_dropped < r.n_lines else [] for r in drop_lines(frame(spark, data)).collect()}
    want = brute_lines(data)
    assert got == want
    assert sum(len(v) for v in want.values()) < sum(len((r[1] or "").split("\n")) for r in data)
    assert drop_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("times", [1, 10])
def test_fields_of_frequent_values_are_variable(spark, times):
    """Two fields of 30 values each, alone and beside a template with a place name of three words: more data drops no less."""
    names = [f"{a}ville {b}land {a}{b}ia" for a, b in zip(WORDS[:30], WORDS[30:60])]
    one = [f"the night job of {a} and {b} has now been closed" for a in WORDS[:30] for b in WORDS[40:70]]
    two = [f"the night job has {a} moved from {b} on to the east" for a in WORDS[:30] for b in names[:12]]
    odd = ["the night job " + " ".join(random.Random(i).sample(WORDS, 8)) for i in range(40)]
    data = [(i * 10 + j, line, None, None, None) for i, line in enumerate(one + two + odd) for j in range(times)]
    got = drop_lines(frame(spark, data)).select("doc_id", "n_dropped").collect()
    assert sum(r.n_dropped for r in got if r.doc_id < 9000) == 900 * times
    assert sum(r.n_dropped for r in got if 9000 <= r.doc_id < 12_600) == 360 * times
    if times == 1:
        assert sum(r.n_dropped for r in got if r.doc_id >= 12_600) == 0


def test_templates_that_share_a_leaf(spark):
    """Three recurring templates of one leaf, the largest of which has most of its lines, beside lines that do not recur; ids null or repeated."""
    rng = random.Random(12)
    line = lambda kind, who: ["2024-01-01 10:00 INFO user %s has opened the outer door", "2024-01-02 11:00 INFO job %s is done with all its work", "2024-01-03 12:00 INFO disk %s was found to be nearly full"][kind] % who
    data = []
    for i in range(90):
        kind = 0 if i < 60 else 1 if i < 75 else 2
        who, other = (rng.choice(WORDS) + rng.choice(WORDS) for _ in range(2))
        odd = "9 8 INFO " + " ".join(rng.sample(WORDS, 7))
        data.append((i if i % 10 else None, f"{line(kind, who)}\n{odd}\n\n{line(kind, other)}", "en", "web", None))
    data += [(5, None, None, None, None), (5, "", None, None, None), (700, "\n".join(f"line {j} {rng.choice(WORDS)}x" + rng.choice(WORDS) for j in range(20_000)), None, None, None)]
    got = drop_lines(frame(spark, data)).collect()
    assert len(got) == len(data)
    dropped = [r for r in got if r.kept and "INFO" in r.kept and r.n_lines == 4]
    assert len(dropped) == 90 and all(r.n_dropped == 2 and r.kept.startswith("9 8 INFO") for r in dropped)
    assert [r.n_dropped for r in got if r.n_lines == 20_000] == [0]


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((6, 32))
    vecs = [(base[i % 6] + rng.standard_normal(32) * rng.choice([0.0, 0.05, 0.12, 0.2])).astype(np.float32).tolist() for i in range(150)]
    data = [(i * 2, v, i % 3 if i % 17 else None, "x") for i, v in enumerate(vecs)]
    data += [(900, None, 1, "x"), (901, [0.0] * 32, 1, "x"), (902, [math.nan] + [1.0] * 31, 1, "x"), (903, [None] + [1.0] * 31, 1, "x"), (904, [], 1, "x"), (905, [1e30] * 32, 1, "x"), (906, [1e-30] * 32, 1, "x")]
    good = {i: (np.array(v, float), lab) for i, v, lab, _ in data if v and None not in v and np.isfinite(v).all() and any(v) and lab is not None}
    cos = lambda a, b: a / np.linalg.norm(a) @ (b / np.linalg.norm(b))
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and cos(good[a][0], good[b][0]) >= 0.98]
    root = components([r[0] for r in data], links)
    n = {r[0]: sum(r[0] in p for p in links) for r in data}
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, rid string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    assert got == {i: (n[i], root[i], root[i] == i) for i in root}
    assert near_vectors(df.filter(F.lit(False))).count() == 0
    # repeated and null ids are rows of their own; equal vectors link
    odd = spark.createDataFrame([(None, vecs[0], 1, "x"), (5, vecs[0], 1, "x"), (5, vecs[0], 1, "x"), (5, vecs[0], None, "x"), (None, None, None, None)], df.schema)
    out = near_vectors(odd).collect()
    assert sorted(r.n_links for r in out) == [0, 0, 2, 2, 2] and sum(r.kept for r in out) == 3
