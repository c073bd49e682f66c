"""Small documents with copies, near copies, repeated passages, junk and benchmark passages."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("rid", T.StringType())])
WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "se", "ta", "vo", "né") for b in ("ban", "der", "fil", "gor", "hut", "jes", "kom", "lin", "mor", "pas")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


def rows(seed: int = 1, n: int = 120) -> list[tuple]:
    """(doc_id, text, lang, source, rid); rid is an extra column whose name clashes with an inner one."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    out, base = [], [prose(rng, rng.randint(8, 120)) for _ in range(12)]
    for i in range(n):
        kind = i % 6
        text = prose(rng, rng.randint(5, 90))
        if kind == 1:
            text = rng.choice(base)
        if kind == 2:
            text = edited(rng, rng.choice(base), rng.choice([0.01, 0.03, 0.06, 0.1]))
        if kind == 3:
            text = f"{text}\n{passage}\nline {i} of the log\n{text[:150]}"
        out.append((i * 3 + 1, text, rng.choice(["en", "de", None]), rng.choice(["web", "web", "web", "books", "Code", None]), str(i % 4)))
    extra = [None, "", " \n ", "one", "One two", "one  two", "é" * 150, "a" * 400, prose(rng, 6000), passage.upper()]
    return out + [(10_000 + i, t, "en", "web", None) for i, t in enumerate(extra)]


def frame(spark, data: list[tuple] | None = None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def components(ids: list, links: list[tuple]) -> dict:
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
