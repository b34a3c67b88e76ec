"""Small documents with every edge case, and brute-force versions of the operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id string, id int, n int, key int, score string, _id int, cdf int, _text int, chunk int, a int"


def rows_of(texts, ids=None, sources=None):
    ids = ids if ids is not None else list(range(len(texts)))
    sources = sources or ["a"] * len(texts)
    return [(i, t, "en", s, len(t or ""), "x", 1, 2, 3, "y", 4, 5, 6, 7, 8) for i, t, s in zip(ids, texts, sources, strict=True)]


def frame(spark, texts, ids=None, sources=None):
    """Documents with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame(rows_of(texts, ids, sources), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def vocabulary(n=400, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(n)]


def sentences(r, words, n):
    return " ".join(" ".join(r.choice(words) for _ in range(r.randint(6, 12))).capitalize() + "." for _ in range(n))


def altered(r, text, words, changes):
    parts = text.split(" ")
    for _ in range(changes):
        parts[r.randrange(len(parts))] = r.choice(words)
    return " ".join(parts)


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
