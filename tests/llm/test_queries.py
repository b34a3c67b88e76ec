import hashlib
import math
import random

import pytest

import corpus_pipeline
from lattix.llm import queries
from lattix.llm.decontaminate import find_overlaps
from lattix.llm.near_dedup import near_duplicates
from tests.llm.helpers import altered, components, frame, sentences, vocabulary
from tests.llm.test_dedup import brute_chunks, sets_of
from tests.llm.test_other_operators import brute_overlaps
from tests.oracle import connect, same_rows

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    same_rows(queries.queries()[name](spark, sf_dir), connect(sf_dir), SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_without_sql_has_its_columns(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert "doc_id" in df.columns
    if name.startswith(("op1_", "op2_")):
        n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
        limit = 0.3 if name.startswith("op1_") else 0.7
        assert len(rows) == n and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit) for r in rows)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == list(range(1, 14))


def test_stages_by_their_own_input(spark, sf_dir):
    """Each stage keeps the columns and takes only what its operator reports of its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, sf_dir).cache()
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(after) <= set(before) and out.columns[: len(columns)] == columns
        if name == "near_dedup":
            want = {r["doc_id"] for r in near_duplicates(docs).filter("kept").collect()}
            assert set(after) == want
        if name == "decontamination":
            gone = {r["doc_id"] for r in find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - gone and gone
        if name == "toxicity":
            assert 0 < len(before) - len(after) < 0.3 * len(before)
        docs = out
    assert out.columns[-2:] == ["copy", "shuffle_key"]


def write_tables(spark, folder, docs, labels, items):
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")


def brute_pipeline(rows, items):
    """(id, text, copy) of each row, from (id, text, source), stage by stage in plain Python; a text with "vile" is toxic."""
    rows = [x for x in rows if "vile" not in (x[1] or "")]
    rows = brute_lines(rows)
    near = brute_near_ids(rows)
    rows = [x for x in rows if x[0] is None or near[x[0]] == x[0]]
    bad = {i for i, _ in brute_overlaps([t for _, t, _ in rows], items)}
    rows = [x for k, x in enumerate(rows) if k not in bad]
    chars = {}
    for _, t, s in rows:
        chars[s] = chars.get(s, 0) + len(t or "")
    weights = {s: c**0.5 for s, c in chars.items()}
    out = []
    for i, t, s in rows:
        rate = 1.0 if chars[s] == 0 else (weights[s] / sum(weights.values())) / (chars[s] / sum(chars.values()))
        u = int(hashlib.md5(f"17:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            n += 1
            p *= rate / n
            c += p
        out += [(i, t, k) for k in range(n)]
    return out


def brute_lines(rows):
    """Without the repeated chunks of lines and the repeated blocks of 51 words or more."""
    places, pairs = {}, {}
    for i, t, _ in rows:
        if i is not None and t is not None:
            for a, b, c in brute_chunks(t):
                places.setdefault(c, set()).add((i, a))
            ls = t.split("\n")
            for k in range(len(ls) - 1):
                pairs.setdefault((ls[k], ls[k + 1]), set()).add(i)
    out = []
    for i, t, s in rows:
        if i is None or t is None:
            out.append((i, t, s))
            continue
        ls, gone = t.split("\n"), set()
        for a, b, c in brute_chunks(t):
            if len(places[c]) > 1 and (i, a) != min(places[c]):
                gone |= set(range(a, b + 1))
        k = 0
        while k < len(ls) - 1:
            end = k
            while end < len(ls) - 1 and min(pairs[ls[end], ls[end + 1]]) < i:
                end += 1
            if end > k and sum(len(x.split()) for x in ls[k : end + 1]) >= 51:
                gone |= set(range(k, end + 1))
            k = max(end, k + 1)
        left = "\n".join(x for k, x in enumerate(ls) if k not in gone)
        if not gone or left.strip():
            out.append((i, left, s))
    return out


def brute_near_ids(rows):
    """Smallest reachable id of each id by its texts' five-word shingles."""
    sets = [(i, sets_of([t], 5)[0]) for i, t, _ in rows if i is not None]
    links = [(a, b) for a, x in sets for b, y in sets if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    return components({i for i, _ in sets}, links)


def test_pipeline_against_brute_force(spark, tmp_path):
    r, words = random.Random(0), vocabulary(3000)
    texts = [sentences(r, words, 8) for _ in range(120)]
    for k in range(40):
        texts[k] += " You vile thing. " + sentences(r, words, 2)
    block = "\n".join(sentences(r, words, 2) for _ in range(5))
    for k in (50, 51, 52):
        texts[k] = sentences(r, words, 3) + "\n" + block + "\n" + sentences(r, words, 3)
    items = [" ".join(r.choice(words) for _ in range(25)) for _ in range(3)] + ["Yes."]
    texts[60] += " " + items[0].upper()
    texts[61] += " " + altered(r, items[1], words, 2) + " Yes."
    texts[62] += " Yes."
    texts[70] = altered(r, texts[69], words, 1)
    texts[71] = texts[69].upper()
    texts += [None, "", "x " * 30_000, texts[80], texts[81], texts[82] + " " + items[2], "  \n "]
    ids = list(range(120)) + [None, 120, 121, None, 81, None, 122]
    sources = [["web", "web", "web", "wiki"][k % 4] for k in range(len(texts))]
    folder = str(tmp_path)
    write_tables(spark, folder, frame(spark, texts, ids, sources), [(k, 1, int(k < 40)) for k in range(120)], list(enumerate(items)))
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == [*frame(spark, []).columns, "copy", "shuffle_key"]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2])
    rows = sorted(((x["doc_id"], x["text"], x["copy"]) for x in got.collect()), key=key)
    want = sorted(brute_pipeline(list(zip(ids, texts, sources, strict=True)), items), key=key)
    assert rows == want and len({x[0] for x in want}) > 40


def test_pipeline_edges(spark, tmp_path):
    r, words = random.Random(0), vocabulary()
    texts = [sentences(r, words, 5) for _ in range(6)] + [None, "", "x " * 30_000]
    folder = str(tmp_path)
    write_tables(spark, folder, frame(spark, texts, [0, 1, 2, 3, 4, None, 6, 7, 7]), [(1, 1, 0)], [(1, texts[2])])
    ids = {x["doc_id"] for x in corpus_pipeline.run(spark, folder).collect()}
    assert 2 not in ids
    frame(spark, [], []).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_pipeline_reads_documents_once(spark, tmp_path):
    """run() writes each stage's rows, so the next stage's passes do not repeat the stages before it."""
    r, words = random.Random(0), vocabulary()
    folder = str(tmp_path)
    write_tables(spark, folder, frame(spark, [sentences(r, words, 5) for _ in range(30)]), [(1, 1, 0)], [(1, "a b c d e f")])
    seen = spark.sparkContext.accumulator(0)

    def first(session, docs, sf_dir):
        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return docs.mapInArrow(count, docs.schema)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(corpus_pipeline, "STAGES", [("first", first), *corpus_pipeline.STAGES[1:]])
        corpus_pipeline.run(spark, folder).collect()
    assert seen.value == 30
