"""Token alignment, embedding near-duplicates and hard negatives against brute-force versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.llm import alignment, hard_negatives, queries, vector_dedup
from lattix.llm.alignment import Aligner, align
from lattix.llm.hard_negatives import mine_hard_negatives
from lattix.llm.vector_dedup import near_duplicate_vectors
from tests.llm.helpers import components, empty, frame, sentences, vocabulary

PATHS = f"{queries.TOKENIZERS}/byte_bpe_50k.json", f"{queries.TOKENIZERS}/piece_bpe_32k.model"


# --- token alignment -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tools():
    return {links: Aligner(*PATHS, links) for links in ("ends", "overlaps", "groups")}


def whole_text(tool, text, links="ends"):
    """Groups and links of a text that is tokenized as a whole, token by token."""
    if not text:
        return None
    a, b = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)
    parts_a, parts_b = [tool.bytes_a[i] for i in a], [tool.bytes_b[i] for i in b]
    if b"".join(parts_a) != b"".join(parts_b) or b"".join(parts_a) != b" " + text.encode():
        return None
    ends_a, ends_b = (list(accumulate(map(len, p))) for p in (parts_a, parts_b))
    shared, groups, pairs, i, j = sorted(set(ends_a) & set(ends_b)), [], Counter(), 0, 0
    for end in shared:
        ga, gb = range(i, ends_a.index(end, i) + 1), range(j, ends_b.index(end, j) + 1)
        groups.append(",".join(str(a[k]) for k in ga) + "|" + ",".join(str(b[k]) for k in gb))
        for x in ga:
            for y in gb:
                meet = {
                    "ends": ends_a[x] == ends_b[y],
                    "groups": True,
                    "overlaps": max(ends_a[x] - len(parts_a[x]), ends_b[y] - len(parts_b[y])) < min(ends_a[x], ends_b[y]),
                }
                pairs[a[x], b[y]] += meet[links]
        i, j = i + len(ga), j + len(gb)
    return len(a), len(b), len(groups), groups, +pairs


ODD = [*"ab  \n\t.,'é中́​ \x85　\x1c\x00😀ا1", "<|endoftext|>", "<s>", "  ", "'s", " don't", "﻿", "᠎", "▁"]


@pytest.mark.parametrize("links", ["ends", "overlaps", "groups"])
@pytest.mark.parametrize("letters", [ODD, ODD[:-1]])
def test_words_align_as_whole_texts_do(tools, links, letters, monkeypatch):
    monkeypatch.setattr(alignment, "PIECE", 64)  # texts in several pieces, and batches of few texts
    r = random.Random(len(links) + len(letters))
    texts = [None, "", " ", "  x", "▁", *("".join(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(150))]
    tool = tools[links]
    tool.max_words = 300  # words beyond are aligned anew
    for text, (counts, sha, ids, times) in zip(texts, tool.documents(texts), strict=True):
        want = whole_text(tool, text, links)
        if want is None:
            assert (counts, sha, len(ids)) == ([0, 0, 0, 0], "", 0)
        else:
            n_a, n_b, n_groups, groups, pairs = want
            assert counts == [n_a, n_b, n_groups, pairs.total()]
            assert sha == hashlib.sha256(";".join(groups).encode()).hexdigest()
            assert {(k >> 32, k & 0xFFFFFFFF): n for k, n in zip(ids.tolist(), times.tolist(), strict=True)} == pairs


def test_owners_of_elementary_intervals():
    own_a, own_b, shared = alignment.elementary(np.array([2, 5, 6]), np.array([3, 5, 6]))
    assert (own_a.tolist(), own_b.tolist(), shared.tolist()) == ([0, 1, 1, 2], [0, 0, 1, 2], [False, False, True, True])
    x, y = alignment.link_pairs(own_a, own_b, shared, "groups")
    assert list(zip(x.tolist(), y.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)]


def alignment_rows(tool, texts, ids, links="ends"):
    got = [whole_text(tool, t, links) for t in texts]
    counts = Counter()
    for g in got:
        counts.update(g[4] if g else {})
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    rows = []
    for i, g in zip(ids, got, strict=True):
        if g is None:
            rows.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        best = sum(n for p, n in g[4].items() if counts[p] == most[p[1]])
        total = sum(n * counts[p] for p, n in g[4].items())
        rows.append((i, g[0], g[1], g[2], g[4].total(), best, total, hashlib.sha256(";".join(g[3]).encode()).hexdigest()))
    return sorted(rows, key=str)


@pytest.mark.parametrize("max_broadcast", [10**6, 0])
@pytest.mark.parametrize("links", ["ends", "groups"])
def test_alignment_equals_brute_force(spark, tools, links, max_broadcast):
    r, words = random.Random(3), vocabulary()
    texts = [sentences(r, words, r.randint(1, 6)) for _ in range(25)]
    texts += [texts[0], texts[0], None, "", " ", "x", "naïve café 東京\n<|endoftext|> </s>", "a ▁ b", "word" * 5000, " ".join(words) * 30]
    ids = [*range(len(texts) - 2), None, 3]  # a null id and a repeated one
    got = align(frame(spark, texts, ids), *PATHS, links=links, max_broadcast=max_broadcast)
    assert sorted(map(tuple, got.collect()), key=str) == alignment_rows(tools[links], texts, ids, links)


def test_alignment_query_equals_brute_force(spark, sf_dir, tools):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = alignment_rows(tools["ends"], [d.text for d in docs], [d.doc_id for d in docs])
    assert sorted(map(tuple, queries.op11_token_alignment(spark, sf_dir).collect()), key=str) == want


def test_alignment_of_an_empty_table(spark):
    assert align(empty(spark), *PATHS).collect() == []


# --- embedding near-duplicates ---------------------------------------------------------------------------------------


VECTORS = "vec_id bigint, embedding array<{}>, label int, id string, rep int, mark int, n int, block int, dim int, digest int, q int"


def vector_frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5, 6, 7) for r in rows], VECTORS.format(kind))


def usable(v, label):
    return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_near(rows, threshold):
    links = []
    for k, (a, v, label) in enumerate(rows):
        for b, w, other in rows[:k]:
            if a is not None and b is not None and label == other and usable(v, label) and usable(w, other) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links.append((a, b))
    n, c = Counter(x for pair in links for x in pair), components([r[0] for r in rows], links)
    return sorted((a, n[a], c[a], c[a] == a and a is not None) for a, _, _ in rows if a is not None)


def near_rows(r, n, dim, as_float=True):
    """Random vectors, chains of near copies about the threshold, exact copies, and all that links with nothing."""
    g = np.random.default_rng(r)
    rows, cast = [], (lambda v: v.astype(np.float32)) if as_float else (lambda v: v)
    while len(rows) < n:
        base = g.normal(size=dim)
        label = int(g.choice([0, 0, 0, 1, 2]))
        for _ in range(int(g.integers(1, 9))):
            rows.append((len(rows), cast(base).tolist(), label))
            base = base + g.normal(size=dim) * g.choice([0, 0.2, 0.35, 0.4, 0.45])
    v = rows[0][1]
    odd = [None, [], [0.0] * dim, [float("nan"), *v[1:]], [float("inf"), *v[1:]], [None, *v[1:]], v[:-1], [-x for x in v], [x * 2 for x in v]]
    return rows + [(len(rows) + k, w, 0) for k, w in enumerate(odd)] + [(len(rows) + 20, v, None), (len(rows) + 21, v, 7), (len(rows) + 22, v, rows[0][2])]


@pytest.mark.parametrize("kind, dim, tile", [("float", 16, 8), ("double", 5, 1024), ("float", 64, 50)])
def test_near_vectors_equal_brute_force(spark, kind, dim, tile):
    rows = near_rows(dim, 150, dim, kind == "float")
    got = near_duplicate_vectors(vector_frame(spark, rows, kind), 0.93, tile=tile)
    assert sorted(map(tuple, got.collect())) == brute_near(rows, 0.93)


def test_bounds_hold_for_extreme_vectors():
    """Pairs that the bounds decide are decided as in double precision, also for spiky, tiny and huge vectors."""
    g = np.random.default_rng(4)
    x = g.normal(size=(300, 24)) * 10.0 ** g.integers(-150, 150, size=(300, 1))
    x[::3] *= g.choice([1, 0, 1e-3, 50], size=(100, 24))
    x[1::3] = x[0] + x[1::3] / np.abs(x[1::3]).max(axis=1)[:, None] * np.abs(x[0]).max() * 0.3
    x = x[np.abs(x).max(axis=1) > 0]
    side = vector_dedup.quantised(vector_dedup.unit_rows(x))
    true = np.array([vector_dedup.cosines(np.repeat(v[None], len(x), 0), x) for v in x])
    for threshold in (0.2, 0.7, 0.93, 0.999):
        certain, unsure = vector_dedup.decide(side, side, threshold)
        assert (true[certain] >= threshold).all() and (true[~certain & ~unsure] < threshold).all()
        assert unsure.mean() < 0.1


def test_large_groups_of_near_and_exact_copies(spark):
    """Most rows of one label are near copies over many tiles: as many rows a tile as it has vectors."""
    g = np.random.default_rng(8)
    base = g.normal(size=32)
    near = [(base + g.normal(size=32) * 0.2).astype(np.float32).tolist() for _ in range(150)]
    rows = [(k, near[k % 150] if k < 400 else g.normal(size=32).astype(np.float32).tolist(), 1 if k < 450 else 2) for k in range(480)]
    assert sorted(map(tuple, near_duplicate_vectors(vector_frame(spark, rows), 0.93, tile=32).collect())) == brute_near(rows, 0.93)


def test_near_vectors_null_and_repeated_ids(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.0]
    rows = [(None, v, 0), (5, v, 0), (5, w, 0), (7, [3.1, -1.0, 0.0], 0), (2, v, 0)]
    got = near_duplicate_vectors(vector_frame(spark, rows, "double"), 0.93).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 0, None, False), (5, 1, 2, False), (5, 1, 5, True), (7, 1, 5, False), (2, 1, 2, True)], key=str)


def test_near_vectors_of_an_empty_table(spark):
    assert near_duplicate_vectors(vector_frame(spark, [])).collect() == []


# --- hard negatives --------------------------------------------------------------------------------------------------


def brute_negatives(rows, every, positives, negatives, low, high):
    best = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * x) for x in v]
            best[i] = min(best.get(i, (label, None, q)), (label, None, q), key=lambda x: (x[0], np.array(x[2], np.int32).tobytes()))
    out = []
    for i, (label, _, q) in best.items():
        if i % every:
            continue
        score = {j: sum(a * b for a, b in zip(q, p, strict=False)) for j, (_, _, p) in best.items() if j != i}
        ranked = sorted(score, key=lambda j: (-score[j], j))
        for pos in [j for j in ranked if best[j][0] == label][:positives]:
            near = [j for j in ranked if best[j][0] != label and low * score[pos] <= 100 * score[j] <= high * score[pos]]
            out += [(i, pos, k, j, score[pos], score[j]) for k, j in enumerate(near[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [dict(), dict(rows_a_block=16, anchors_a_block=4, dims=3), dict(rows_a_block=50, anchors_a_block=2, dims=8)])
def test_hard_negatives_equal_brute_force(spark, blocks):
    g = np.random.default_rng(1)
    centres = g.normal(size=(4, 8))
    rows = []
    for k in range(200):
        label = int(g.choice([0, 0, 0, 1, 2, 3]))
        v = np.round(centres[label] * 0.4 + centres.sum(axis=0) * 0.3 + g.normal(size=8) * 0.3, 1)  # rounded: many ties
        rows.append((k, v.astype(np.float32).tolist(), label))
    v = rows[0][1]
    odd = [None, [], [float("nan"), *v[1:]], [float("-inf"), *v[1:]], [None, *v[1:]], v[:-3], [0.0] * 8, [-x for x in v]]
    rows += [(200 + 10 * k, w, 0) for k, w in enumerate(odd)] + [(300, v, None), (None, v, 0), (40, rows[40][1], rows[40][2]), (41, v, 3), (310, v, 9)]
    got = mine_hard_negatives(vector_frame(spark, rows), every=10, **blocks)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == brute_negatives(rows, 10, 5, 10, 30, 90)


def test_partial_scores_are_exact_integers():
    g = np.random.default_rng(2)
    for most in (10, 10**6, 2**28):
        a, b = g.integers(-most, most, (5, 32)), g.integers(-most, most, (7, 32))
        want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
        assert hard_negatives.partial_scores(a, b).tolist() == want
    with pytest.raises(OverflowError):
        hard_negatives.partial_scores(np.full((1, 32), 2**30), np.full((1, 32), 2**30))


def test_hard_negatives_without_rows_anchors_or_positives(spark):
    assert mine_hard_negatives(vector_frame(spark, [])).collect() == []
    assert mine_hard_negatives(vector_frame(spark, [(1, [1.0], 0), (2, [1.0], 0)])).collect() == []
    assert mine_hard_negatives(vector_frame(spark, [(0, [1.0], 0), (2, [1.0], 1)])).collect() == []


def test_hard_negatives_take_a_label_expression(spark):
    rows = [(0, [1.0, 0.5], 0), (1, [1.0, 0.5], 1), (2, [0.5, 0.25], 2)]
    got = mine_hard_negatives(vector_frame(spark, rows), label=F.when(F.col("vec_id") == 1, 0).otherwise(F.col("label")))
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 2, 256 * 256 + 128 * 128, 256 * 128 + 128 * 64)]
