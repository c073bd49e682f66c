"""Mixing, sharding and the pipeline."""

import random
import re
import zlib
from collections import Counter

import pytest
from corpus import frame, prose, rows

from wakeline.llm.mixing import mix
from wakeline.llm.sharding import shard


def test_mix_meets_targets(spark):
    data = rows(n=400)
    got = mix(frame(spark, data)).collect()
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in data}
    assert {r.doc_id: r.size for r in got} == size
    sizes = Counter()
    for r in data:
        sizes[r[3]] += size[r[0]]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= full
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    biggest = {s: max(size[r[0]] for r in data if r[3] == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in order)
    assert sorted((r.doc_id, r.taken) for r in mix(frame(spark, data).repartition(7)).collect()) == sorted((r.doc_id, r.taken) for r in got)
    assert mix(frame(spark, [])).count() == 0


def test_mix_takes_rows_of_one_hash_together(spark):
    """Rows that share an id, or without one a text, stand or fall together, also on the edge of a budget."""
    data = [(7, "a b c", None, s, None) for s in ("x", "x", "x", "y")] + [(None, "d e", None, s, None) for s in ("x", "y", "y", None)] + [(i, "w " * i, None, "y", None) for i in range(1, 30)]
    got = mix(frame(spark, data)).collect()
    assert len(got) == len(data)
    times = {}
    for r in got:
        times.setdefault((r.source, r.h), set()).add(r.taken // r.size)
    assert all(len(t) == 1 for t in times.values())
    again = mix(frame(spark, data).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_shards_are_even_in_rows_and_sources(spark):
    data = rows(n=500) + [(7, "same", "en", "web", None)] * 30 + [(None, None, None, None, None)] * 3
    got = shard(frame(spark, data), 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in data)
    count = Counter(r.shard for r in got)
    assert set(count) == set(range(8)) and max(count.values()) - min(count.values()) <= 1
    for s, n in count.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    for source, n in Counter(r.source for r in got).items():
        held = Counter(r.shard for r in got if r.source == source)
        assert all(abs(held[s] - n / 8) <= 2 for s in range(8))
    again = shard(frame(spark, data).repartition(5), 8).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert shard(frame(spark, []), 8).count() == 0


def brute_shards(data, shards, seed=7):
    """The law stated in Python: shuffle by hash inside a source, sort by fractional rank, cut."""
    import hashlib

    def h(i, text):
        key = str(i) if i is not None else "t" + hashlib.md5((text or "").encode()).hexdigest()
        return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:15], 16)

    last = lambda x: (x is None, x if x is not None else 0)
    rows_ = [(r[3] if r[3] is not None else None, h(r[0], r[1]), last(r[0]), zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 8, r[0]) for r in data]
    by_source = {}
    for r in sorted(rows_, key=lambda r: r[1:5]):
        by_source.setdefault(r[0], []).append(r)
    order = sorted(((k + 0.5) / len(v), (s is None, s or ""), *r[1:]) for s, v in by_source.items() for k, r in enumerate(v))
    out, slots = [], Counter()
    for i, r in enumerate(order):
        s = i * shards // len(order)
        out.append((r[6], r[5], r[4], s, slots[s]))
        slots[s] += 1
    return out


@pytest.mark.parametrize("kind", ["mixed", "a source for each row", "one source of equal rows"])
def test_shards_match_brute_force(spark, kind):
    data = rows(n=300)
    if kind == "a source for each row":
        data = [(r[0], r[1], r[2], f"host{i}", None) for i, r in enumerate(data)]
    if kind == "one source of equal rows":
        data = data[:40] + [(None, "the same text", None, "web", None)] * 400
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in shard(frame(spark, data), 24).collect()]
    assert Counter(got) == Counter(brute_shards(data, 24))


def test_pipeline_stages_match_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from test_duplicates import brute_components
    from test_models import brute_contaminated

    docs = frame(spark).drop("rid")
    near = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert near.columns == docs.columns
    kept = [r[0] for r in near.collect()]
    assert sorted(kept) == sorted(i for i, (_, _, first) in brute_components(rows(), 5).items() if first)
    mixed = corpus_pipeline.mixing_stage(spark, docs, "")
    taken = {r.doc_id: r.taken // r.size for r in mix(docs).collect() if r.size}
    assert Counter(r[0] for r in mixed.collect()) == Counter({r[0]: taken.get(r[0], 1) for r in rows() if taken.get(r[0], 1)})
    assert brute_contaminated([(1, "a b c d e", None)], [(3, "a b c d e")]) == {1: [3]}


def test_pipeline_runs_whole(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = frame(spark).drop("rid")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench = rows()[0]
    spark.createDataFrame([(1, bench[1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(r[0], 1, 0) for r in rows()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert bench[0] not in got and set(got) <= {r[0] for r in rows()} and got


def test_pipeline_stages_decide_by_row(spark, tmp_path):
    """Rows without an id or with a repeated one are documents of their own in the first three stages."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    texts = [prose(rng, 60) for _ in range(300)]
    junk = "".join(chr(rng.randint(33, 126)) for _ in range(300))
    spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, texts[3])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = lambda data: frame(spark, [(i, t, "en", s, None) for i, t, s in data]).drop("rid")
    left = lambda stage, data: Counter((r.doc_id, r.text) for r in stage(spark, docs(data), str(tmp_path)).collect())
    known = [(i, t, "web") for i, t in enumerate(texts)]
    odd = [(None, junk, "web"), (None, prose(rng, 60), "web"), (1000, junk[::-1], "web"), (1000, prose(rng, 60), "web")]
    got = left(corpus_pipeline.quality_stage, known + odd)
    assert got[odd[1][:2]] == 1 and got[odd[3][:2]] == 1 and not got[odd[0][:2]] and not got[odd[2][:2]]
    data = [(1, texts[1], "web"), (1, texts[1], "web"), (None, texts[2], "web"), (None, texts[2], "web"), (None, texts[3], "web"), (1, texts[4], "web")]
    want = Counter({(1, texts[1]): 1, (None, texts[2]): 1, (None, texts[3]): 1, (1, texts[4]): 1})
    assert left(corpus_pipeline.near_duplicate_stage, data) == want
    assert left(corpus_pipeline.decontamination_stage, data) == Counter((i, t) for i, t, _ in data if t != texts[3])
    # the last two: rows of one text without an id are taken together, all rows get a place
    data = [(None, "a b c", "x"), (None, "a b c", "x"), (4, "d e", "x"), (4, "d e", None), (None, None, None), (6, " ", "y")] + [(i, f"w{i} " * 5, "y") for i in range(10, 40)]
    got = left(corpus_pipeline.mixing_stage, data)
    assert got[(None, "a b c")] % 2 == 0 and got[(None, None)] == 1 and got[(6, " ")] == 1 and set(got) <= {d[:2] for d in data}
    placed = corpus_pipeline.sharding_stage(spark, docs(data), str(tmp_path)).collect()
    assert len(placed) == len(data) and len({(r.shard, r.slot) for r in placed}) == len(data)
    for stage in (s for _, s in corpus_pipeline.STAGES):
        assert stage(spark, docs([]), str(tmp_path)).count() == 0
