import hashlib
import random
import re

import numpy as np
import pytest

from lattix.llm import components as cc
from lattix.llm import exact_dedup, line_dedup, near_dedup, substring_dedup
from tests.llm.helpers import altered, components, empty, frame, sentences, vocabulary

WHITE = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_groups_against_brute_force(spark):
    texts = ["Same", "same", "SAME", "Émile", "émile", None, "", "long " * 30_000, "LONG " * 30_000, "same "]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(frame(spark, texts, ids)).collect()}
    norm = {i: (t or "").translate(FOLD) for i, t in zip(ids, texts, strict=True)}
    for i in ids:
        group = [j for j in ids if norm[j] == norm[i]]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(group), len(group), i == max(group))
        assert got[i]["text_sha256"] == hashlib.sha256(norm[i].encode()).hexdigest()


def test_exact_null_ids_repeated_rows_and_empty_table(spark):
    got = exact_dedup.exact_dedup(frame(spark, ["a", "a", "b", "b", "c"], [None, 5, 7, 7, None])).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in got) == [
        (-1, -1, 1, True), (-1, 5, 2, False), (5, 5, 2, True), (7, 7, 2, True), (7, 7, 2, True)
    ]
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def brute_chunks(text, window=3, divisor=4):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        if sum(h[i - k] * 31**k for k in range(window) if i >= k) % divisor == 0 or i == len(lines) - 1:
            if i > start:
                out.append((start, i, "\n".join(lines[start : i + 1])))
            start = i + 1
    return out


def test_line_chunks_against_brute_force(spark):
    r, words = random.Random(3), vocabulary()
    shared = [sentences(r, words, 1) for _ in range(12)]
    texts = ["\n".join([sentences(r, words, 1) for _ in range(k % 4)] + shared[k % 5 :] + [sentences(r, words, 1)]) for k in range(12)]
    texts += [texts[0], None, "", "one line", "\n".join(["x"] * 3_000)]
    got = sorted(tuple(x) for x in line_dedup.repeated_line_chunks(frame(spark, texts)).collect())
    places = {}
    for i, t in enumerate(texts):
        for a, b, c in brute_chunks(t) if t is not None else []:
            places.setdefault(c, []).append((i, a, b))
    want = sorted((i, a, b, *min(p)[:2]) for p in places.values() for i, a, b in p if (i, a, b) != min(p))
    assert got == want and len(want) > 10


def test_line_removal_keeps_clean_documents(spark):
    texts = ["a\nb\nc\nd\ne\nf", "a\nb\nc\nd\ne\nf", "p\nq\nr", None, ""]
    out = line_dedup.drop_repeated_lines(frame(spark, texts))
    assert out.columns == frame(spark, texts).columns
    got = {x["doc_id"]: x["text"] for x in out.collect()}
    assert got[0] == texts[0] and got[2] == texts[2] and got[3] is None and got[4] == ""
    gone = [x for x in brute_chunks(texts[1])]
    left = [x for k, x in enumerate(texts[1].split("\n")) if not any(a <= k <= b for a, b, _ in gone)]
    assert got.get(1, "") == "\n".join(left)
    assert line_dedup.drop_repeated_lines(empty(spark)).count() == 0


def test_line_removal_takes_short_blocks_of_many_words(spark):
    r, words = random.Random(21), vocabulary(4000)
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    blocks = ["\n".join(line(-(-51 // n)) for _ in range(n)) for n in (2, 3, 4, 5) for _ in range(10)]
    texts = [f"{line(12)}\n{b}\n{line(12)}" for b in blocks for _ in range(2)]
    short = f"{line(20)}\n{line(20)}"
    lone = line(60)
    texts += [f"{line(9)}\n{lone}\n{line(9)}" for _ in range(2)]
    got = {x["doc_id"]: x["text"] for x in line_dedup.drop_repeated_lines(frame(spark, texts)).collect()}
    for k, b in enumerate(blocks):
        assert got[2 * k] == texts[2 * k] and got[2 * k + 1] == texts[2 * k + 1].replace(b + "\n", "")
    assert [got[len(texts) - n] for n in (2, 1)] == texts[-2:]
    assert line_dedup.repeated_blocks(frame(spark, [f"a b\n{short}", f"c d\n{short}"])).count() == 0
    assert line_dedup.repeated_blocks(frame(spark, ["\n".join(["x y"] * 90), texts[0], texts[0], None, ""], [1, 2, 2, 3, None])).count() == 0
    assert line_dedup.repeated_blocks(empty(spark)).count() == 0


def test_line_null_ids_and_repeated_rows_lose_nothing(spark):
    text = "a\nb\nc\nd\ne\nf"
    assert line_dedup.repeated_line_chunks(frame(spark, [text, text, text], [None, 4, 4])).count() == 0
    assert line_dedup.drop_repeated_lines(frame(spark, [text, text, text], [None, 4, 4])).count() == 3


def test_lines_go_only_from_the_text_they_repeat_in(spark):
    """A row that repeats an id with another text keeps its lines."""
    text = "a\nb\nc\nd\ne\nf"
    other = "\n".join(f"other {k}" for k in range(12))
    got = line_dedup.drop_repeated_lines(frame(spark, [text, text, other], [1, 2, 2])).collect()
    assert [x["text"] for x in got if x["doc_id"] == 2 and (x["text"] or "").startswith("other")] == [other]
    assert [x["text"] for x in got if x["doc_id"] == 1] == [text]


def brute_passages(texts, min_words):
    pattern = re.compile(r"[^\n.!?]+[.!?]*[^\S\n]*|[.!?]+[^\S\n]*")
    units = {}
    for i, t in enumerate(texts):
        for k, m in enumerate(pattern.finditer(t or "")):
            norm = re.sub(r"[\W_]+", " ", m.group().lower()).strip()
            units[i, k] = (norm, m.start(), m.end())
    first = {}
    for place, (norm, _, _) in sorted(units.items()):
        if norm:
            first.setdefault(norm, place)
    repeats = [p for p, u in sorted(units.items()) if u[0] and first[u[0]] != p]
    runs = []
    for i, k in repeats:
        if runs and runs[-1][-1] == (i, k - 1):
            runs[-1].append((i, k))
        else:
            runs.append([(i, k)])
    out = []
    for run in runs:
        n = sum(len(units[p][0].split()) for p in run)
        if n >= min_words:
            out.append((run[0][0], units[run[0]][1], units[run[-1]][2], len(run), n, min(first[units[p][0]][0] for p in run)))
    return sorted(out)


def test_passages_against_brute_force(spark):
    r, words = random.Random(8), vocabulary()
    passage = sentences(r, words, 7)
    texts = [sentences(r, words, r.randint(1, 8)) for _ in range(20)]
    for k in (3, 9, 15):
        texts[k] = texts[k] + " " + passage + "\n" + sentences(r, words, 2)
    texts += [texts[0] + "\n" + texts[0], None, "", "Été " * 20_000]
    got = sorted(tuple(x) for x in substring_dedup.repeated_passages(frame(spark, texts)).collect())
    assert got == brute_passages(texts, 30)
    assert {x[0] for x in got} >= {9, 15} and 3 not in {x[0] for x in got}
    cleaned = {x["doc_id"]: x["text"] for x in substring_dedup.drop_repeated_passages(frame(spark, texts)).collect()}
    assert len(cleaned) == len(texts) and passage in cleaned[3] and passage not in cleaned[9] and cleaned[1] == texts[1]


def test_passages_that_begin_and_end_inside_sentences(spark):
    r, words = random.Random(12), vocabulary(4000)
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    shorts = [re.sub(r"((?:\w+ ){7}\w+) ", r"\1. ", text(51)) for _ in range(20)]  # a sentence end after each eighth word
    longs = [text(51) for _ in range(20)]  # no whole sentence
    texts, passages = [], shorts + longs
    for p in passages:
        texts += [f"{text(9)} {p} {text(9)}. {text(40)}." for _ in range(2)]
    got = {}
    for x in substring_dedup.repeated_passages(frame(spark, texts)).collect():
        got.setdefault(x["doc_id"], []).append(x)
    for k, p in enumerate(passages):
        (run,) = got.pop(2 * k + 1)
        at = texts[2 * k + 1].index(p)
        assert at <= run["start_char"] < run["end_char"] <= at + len(p) and run["first_doc_id"] == 2 * k
        assert run["n_words"] == len(re.findall(r"\w+", texts[2 * k + 1][run["start_char"] : run["end_char"]])) >= 30
    assert not got


@pytest.mark.parametrize(("unit", "cut"), [("line", r"\n"), ("paragraph", r"\n[^\S\n]*\n\s*")])
def test_every_repeated_line_or_paragraph_goes(spark, unit, cut):
    """Units alone: each is removed but for its earliest occurrence, by id and then by place."""
    r = random.Random(11)
    units = [" ".join(r.choice("red green blue Grey".split()) for _ in range(r.randint(1, 3))) for _ in range(30)] + ["---", "Red, green!"]
    gaps = ["\n", "\n", "\n\n", "\n \n"]
    texts = ["".join(r.choice(units) + r.choice(gaps) for _ in range(r.randint(0, 12))) for _ in range(40)]
    runs = {}
    for x in substring_dedup.repeated_passages(frame(spark, texts), unit=unit, min_words=1, span_words=None).collect():
        runs.setdefault(x["doc_id"], []).append((x["start_char"], x["end_char"]))
    seen = set()
    for k, text in enumerate(texts):
        at = 0
        for m in [*re.finditer(cut, text), None]:
            start, end = at, m.start() if m else len(text.rstrip())
            at = m.end() if m else end
            words = tuple(w for w in re.split(r"[\W_]+", text[start:end].lower()) if w)
            if words:
                inside = any(a <= start and end <= b for a, b in runs.get(k, []))
                apart = all(b <= start or end <= a for a, b in runs.get(k, []))
                assert inside if words in seen else apart, (k, start, end)
                seen.add(words)
    assert len(runs) > 20


def test_spans_are_the_same_in_pieces(monkeypatch):
    r, words = random.Random(13), vocabulary()
    text = " ".join(r.choice(words) + r.choice(["", ",", "É", " -- "]) for _ in range(3000))
    whole = substring_dedup._words(text)
    monkeypatch.setattr(substring_dedup, "_PIECE", 100)
    assert all((a == b).all() for a, b in zip(whole, substring_dedup._words(text), strict=True))
    assert [text[a:b] for a, b in zip(*whole[:2], strict=True)] == re.findall(r"[^\W_]+", text)


def test_passages_in_rows_that_repeat_an_id(spark):
    text = " ".join(" ".join(f"word{k}x{n}" for k in range(9)) + "." for n in range(6))
    (got,) = substring_dedup.repeated_passages(frame(spark, [text, text, text], [1, 2, 2])).collect()
    assert tuple(got) == (2, 0, len(text), 6, 54, 1)


def test_passages_go_only_from_the_text_they_repeat_in(spark):
    text = " ".join(" ".join(f"word{k}x{n}" for k in range(9)) + "." for n in range(6))
    other = " ".join(f"other{k}" for k in range(70))
    got = substring_dedup.drop_repeated_passages(frame(spark, [text, text, other, None], [1, 2, 2, None])).collect()
    assert sorted((x["doc_id"] or 0, x["text"] or "") for x in got) == [(0, ""), (1, text), (2, ""), (2, other)]


def test_units_without_words_do_not_break_a_run(spark):
    half = [" ".join(f"{c}{k}" for k in range(20)) + "." for c in "ab"]
    text = f"{half[0]}\n---\n{half[1]}"
    (got,) = substring_dedup.repeated_passages(frame(spark, [text, text])).collect()
    assert tuple(got) == (1, 0, len(text), 2, 40, 0)


def test_passages_of_nothing(spark):
    assert substring_dedup.repeated_passages(empty(spark)).count() == 0
    text = " ".join(f"word{k}" for k in range(60)) + "."
    assert substring_dedup.repeated_passages(frame(spark, [text, text], [None, None])).count() == 0
    assert substring_dedup.repeated_passages(frame(spark, [text, text], [1, 2])).count() == 1


def sets_of(texts, n):
    out = {}
    for i, t in enumerate(texts):
        w = WHITE.findall((t or "").translate(FOLD))
        out[i] = set(zip(*[w[k:] for k in range(n)], strict=False)) if len(w) >= n else ({tuple(w)} if w else set())
    return out


def brute_near(texts, n):
    s = sets_of(texts, n)
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    return {i: (len(s[i]), c) for i, c in components(s, links).items()}


def near_texts():
    r, words = random.Random(1), vocabulary()
    texts = [sentences(r, words, r.randint(1, 20)) for _ in range(40)]
    base = sentences(r, words, 12)
    texts += [altered(r, base, words, k % 7) for k in range(40)]  # a group of near copies, chains included
    texts += [texts[0].upper(), texts[1] + " more", None, "", "   ", "word", "WORD", "two words", "two  Words", "a b c d e f", "a b c d e g"]
    return texts


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_against_brute_force(spark, n):
    texts = near_texts()
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.near_duplicates(frame(spark, texts), shingle=n).collect()}
    assert got == brute_near(texts, n)


def test_rest_after_hubs_is_compared_in_blocks(spark, monkeypatch):
    """Bucket members that the hub doesn't link are compared with each other, over several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "REGISTER_BLOCK", 3)
    r, words = random.Random(2), vocabulary()
    base = sentences(r, words, 14)
    texts = [altered(r, base, words, 14) for _ in range(4)]
    texts += [altered(r, t, words, 2) for t in texts for _ in range(6)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.near_duplicates(frame(spark, texts), shingle=2).collect()}
    assert got == brute_near(texts, 2)


def test_near_repeated_ids_do_not_depend_on_order(spark):
    """Rows (1, A), (1, C), (2, near C): id 1 has the links of both its texts, whatever the order of rows."""
    r, words = random.Random(5), vocabulary()
    a, c, e = (sentences(r, words, 8) for _ in range(3))
    rows = [(1, a), (1, c), (2, c + " more"), (3, a.upper()), (4, e), (4, None), (7, c), (7, e)]
    want = {1: 1, 2: 1, 3: 1, 4: 1, 7: 1}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = near_dedup.near_duplicates(frame(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
        assert {x["doc_id"]: x["component_id"] for x in got} == want and len(got) == len(rows)
        assert all(x["kept"] == (x["doc_id"] == 1) for x in got)


def test_near_null_ids_repeated_rows_empty_table(spark):
    text = "one two three four five six seven"
    got = near_dedup.near_duplicates(frame(spark, [text, text, text, text], [None, 3, 3, 9])).collect()
    assert sorted((x["doc_id"] or -1, x["component_id"] or -1, x["kept"]) for x in got) == [(-1, -1, True), (3, 3, True), (3, 3, True), (9, 3, False)]
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    kept = near_dedup.drop_near_duplicates(frame(spark, [text, text, None], [1, 2, 3]))
    assert sorted(x["doc_id"] for x in kept.collect()) == [1, 3] and kept.columns == frame(spark, [text]).columns


def test_registers_estimate_similarity():
    r = np.random.default_rng(0)
    for n, shared in ((20, 16), (400, 340), (5000, 4000)):
        both = r.integers(0, 2**64, shared, dtype=np.uint64)
        errors = []
        for _ in range(30):
            a, b = (np.unique(np.concatenate([both, r.integers(0, 2**64, n - shared, dtype=np.uint64)])) for _ in range(2))
            agree = (near_dedup.compress(near_dedup.bucket_minima(a)) == near_dedup.compress(near_dedup.bucket_minima(b))).sum()
            errors.append(float(near_dedup.estimate(np.array([agree]), np.array([len(a)]), np.array([len(b)]))[0]) - shared / (2 * n - shared))
        assert abs(np.mean(errors)) < 0.06


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a bigint, b bigint")
    for most in (cc.MAX_LOCAL_LINKS, 3):  # in one task, and by rounds
        got = {x["id"]: x["component"] for x in cc.connected_components(chain, most).collect()}
        assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_components_against_brute_force(spark, most):
    r = random.Random(7)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)]
    got = {x["id"]: x["component"] for x in cc.connected_components(spark.createDataFrame(links, "a bigint, b bigint").repartition(5), most).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    want = components(range(400), links)
    assert got == {i: want[i] for i in linked}
