"""Scans, halos, sweeps, list ranking, tiles, sparse rows and blocked stencils against plain Python, over many small ranges and batches."""

import random
from itertools import groupby

import duckdb
import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from lattix.functions import learning
from lattix.operators import balance, grid, iterate, kv, matrix, queues, reduce, scans, sparse, tiles


@pytest.fixture
def small(spark):
    """Many ranges, and batches of a few rows."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7", "spark.sql.execution.arrow.maxRecordsPerBatch": "11"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- scans -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("cells", [1, 3, 200])
@pytest.mark.parametrize("inclusive", [False, True])
def test_scan_of_a_monoid_that_does_not_commute(small, cells, inclusive):
    """Affine functions x -> m x + c modulo a prime, composed in order: one hot cell, or many small ones, null cells too."""
    r, prime = random.Random(cells), 10007
    data = [(r.choice([None, *range(cells)]) if r.random() < 0.4 else 0, k, r.randrange(prime), r.randrange(prime)) for k in range(400)]
    r.shuffle(data)

    def compose(a, b):
        return {"m": a["m"] * b["m"] % 10007, "c": (a["c"] * b["m"] + b["c"]) % 10007}

    ranged = scans.in_ranges(small.createDataFrame(data, "cell int, k int, p bigint, q bigint"), ["cell", "k"])
    got = scans.scan(ranged, ["cell"], {"m": F.col("p"), "c": F.col("q")}, compose, {"m": 1, "c": 0}, inclusive)
    want = []
    for cell, group in groupby(sorted(data, key=lambda x: (-1 if x[0] is None else x[0], x[1])), key=lambda x: x[0]):
        m, c = 1, 0
        for _, k, p, q in group:
            after = m * p % prime, (c * p + q) % prime
            want.append((cell, k, *(after if inclusive else (m, c))))
            m, c = after
    assert rows(got.select("cell", "k", "m", "c")) == sorted(want, key=str)
    assert ranged.rdd.getNumPartitions() == 7


def test_scan_of_nothing_and_of_nulls(small):
    empty = scans.in_ranges(small.createDataFrame([], "k int, v bigint"), ["k"])
    assert scans.scan(empty, [], {"s": F.col("v")}, scans.each(np.add), {"s": 0}).collect() == []
    some = scans.in_ranges(small.createDataFrame([(1, 5), (2, None), (3, 7)], "k int, v bigint"), ["k"])
    assert rows(scans.scan(some, [], {"s": F.col("v")}, scans.each(np.add), {"s": 0}, inclusive=True).select("k", "s")) == [(1, 5), (2, 5), (3, 12)]


def test_fetch_before_in_one_cell(small):
    r = random.Random(2)
    data = [(k, r.randrange(1 << 40), r.random()) for k in range(300)]
    got = kv.fetch_before(small.createDataFrame(data, "k int, v bigint, x double"), [], ["k"], o=("or", F.col("v")), e=("xor", F.col("v")), a=("and", F.col("v")), lo=("min", F.col("x")), hi=("max", F.col("x")))
    want, o, x, a, lo, hi = [], 0, 0, -1, float("inf"), float("-inf")
    for k, v, f in data:
        want.append((k, o, x, a, lo, hi) if k else (k, None, None, None, None, None))
        o, x, a, lo, hi = o | v, x ^ v, a & v, min(lo, f), max(hi, f)
    assert rows(got.select("k", "o", "e", "a", "lo", "hi")) == sorted(want, key=str)


@pytest.mark.parametrize(("cells", "values", "start"), [(1, 3, 0), (4, 40, 2), (60, 2, 1)])
def test_compare_and_swap_over_ranges(small, cells, values, start):
    """Cells of any size, null cells, null operands, equal places in the order and whole rows repeated: ranges and groups agree with a loop."""
    r = random.Random(cells)
    some = lambda: None if r.random() < 0.02 else r.randrange(values)
    data = [(r.choice([None, *range(cells)]) if r.random() < 0.4 else 0, r.randrange(250), some(), some()) for _ in range(400)]
    data += data[:20]
    first = lambda x: (x is None, x or 0)  # noqa: E731  nulls last
    held, want = {}, []
    for cell, at, old, new in sorted(data, key=lambda x: (first(x[0]), x[1], first(x[2]), first(x[3]))):
        value = held.get(cell, start)
        want.append((cell, at, value, old is not None and old == value))
        held[cell] = new if want[-1][3] else value
    df = small.createDataFrame(data, "cell int, t int, old bigint, new bigint")
    assert rows(kv.compare_and_swap(df, "cell", "t", "old", "new", start, group_rows=0)) == sorted(want, key=str)
    assert rows(kv.compare_and_swap(df, "cell", "t", "old", "new", start)) == sorted(want, key=str)
    assert kv.compare_and_swap(df.limit(0), "cell", "t", "old", "new", group_rows=-1).collect() == []


def test_long_chain_of_swaps_in_one_cell(small):
    """Every attempt succeeds, so the marked path holds all of them."""
    df = small.range(3000).select(F.lit(0).alias("cell"), "id", (F.col("id") % 7).alias("old"), ((F.col("id") + 1) % 7).alias("new"))
    got = kv.compare_and_swap(df, "cell", "id", "old", "new", group_rows=0)
    assert got.filter("swapped AND seen = id % 7").count() == 3000


@pytest.mark.parametrize("by", [[], ["cell"]])
def test_reduction_that_does_not_commute(small, by):
    r = random.Random(5)
    data = [(r.choice([None, 1, 2]) if r.random() < 0.3 else 0, k, r.choice([None, *range(10007)])) for k in range(500)]
    r.shuffle(data)
    compose = lambda a, b: {"m": a["m"] * b["m"] % 10007, "c": (a["c"] * b["m"] + b["c"]) % 10007}
    df = small.createDataFrame(data, "cell int, k int, v bigint")
    step = {"m": F.lit(31).cast("bigint"), "c": F.col("v")}
    got = reduce.reduce_monoid(df, by, ["k"], step, compose, {"m": 1, "c": 0})
    want = {}
    for cell, _, v in sorted(data, key=lambda x: x[1]):
        m, c = want.get(cell if by else "all", (1, 0))
        want[cell if by else "all"] = m * 31 % 10007, (c * 31 + (v or 0)) % 10007
    assert rows(got) == sorted([(k, *v) if by else v for k, v in want.items()], key=str)
    assert rows(reduce.reduce_monoid(df.limit(0), by, ["k"], step, compose, {"m": 1, "c": 0})) == ([] if by else [(1, 0)])


# --- queues ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("capacity", [1, 4, 1000])
def test_bounded_queue_with_mixed_operations(small, capacity):
    r = random.Random(capacity)
    ops = [(r.choice([0, 0, 0, 0, 1, None]), k, r.choice([True, True, False, None])) for k in range(500)]
    got = queues.replay_bounded(small.createDataFrame(ops, "host int, t bigint, push boolean"), "host", ["t"], F.col("push"), "t", capacity)
    held, want = {}, []
    for host, t, push in ops:
        q = held.setdefault(host, [])
        size = len(q)
        if push:
            want.append((host, t, push, size, size < capacity, None))
            if size < capacity:
                q.append(t)
        else:
            want.append((host, t, push, size, size > 0, q.pop(0) if q else None))
    assert rows(got.select("host", "t", "push", "size_before", "accepted", "popped")) == sorted(want, key=str)


def test_list_ranking_of_nested_and_repeated_inserts(small):
    """Thousands of inserts: chains nested deeper than 60, and many after one node."""
    r = random.Random(9)
    inserts, line = [(0, None, 0)], [0]
    for k in range(1, 2000):
        after = r.choice([k - 1, k - 1, k - 1, 0, 7 if k > 7 else 0, r.randrange(k), None])
        inserts.append((k, after, k))
        line.insert(0 if after is None else line.index(after) + 1, k)
    r.shuffle(inserts)
    got = queues.list_order(small.createDataFrame(inserts, "node bigint, after bigint, k int"), "node", "after", "k")
    assert [n for n, _ in sorted(got.collect(), key=lambda x: x[1])] == line
    assert sorted(x[1] for x in got.collect()) == list(range(2000))


def test_list_ranking_of_few(small):
    kinds = "node bigint, after bigint, k int"
    assert queues.list_order(small.createDataFrame([], kinds), "node", "after", "k").collect() == []
    assert rows(queues.list_order(small.createDataFrame([(5, None, 0), (6, 99, 1)], kinds), "node", "after", "k")) == [(5, 0)]


def test_a_task_index_beyond_24_bits_is_an_error(spark):
    ids = lambda index: spark.range(1).select(queues.encode_task(F.lit(1), F.lit(index)).alias("t"))
    assert ids((1 << 24) - 1).first()[0] == (1 << 25) - 1
    with pytest.raises(Exception, match="beyond 24 bits"):
        ids(1 << 24).collect()


# --- sweeps ----------------------------------------------------------------------------------------------------------


def greedy(loads):
    mean = sum(x for _, x in loads) // len(loads)
    give, take = [[r, x - mean] for r, x in loads if x > mean], [[r, mean - x] for r, x in loads if x < mean]
    moves = []
    while give and take:
        n = min(give[0][1], take[0][1])
        moves.append((give[0][0], take[0][0], n))
        for side in (give, take):
            side[0][1] -= n
            if not side[0][1]:
                side.pop(0)
    return moves


def test_aggressive_moves_of_many_ranks_without_nested_loops(small):
    r = random.Random(3)
    loads = [(k, r.choice([0, 1, 5, 10, r.randrange(100)])) for k in range(400)]
    got = balance.migrate_aggressive(small.createDataFrame(loads, "rank bigint, load bigint"))
    assert rows(got) == sorted(greedy(loads), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_overlap_join_equals_all_pairs(small, ranges):
    r = random.Random(ranges)
    make = lambda n: [(k, lo := r.choice([r.randrange(200), 50]), lo + r.choice([0, 1, 3, 20, 300])) for k in range(n)]
    a, b = [*make(90), (900, None, 5)], [*make(70), (901, 5, None)]
    frame = lambda x: small.createDataFrame(x, "id bigint, lo bigint, hi bigint")
    want = [(i, j) for i, x, y in a for j, u, v in b if None not in (x, y, u, v) and x < y and u < v and x < v and u < y]
    assert rows(balance.overlap_join(frame(a), frame(b), ranges)) == sorted(want, key=str)
    assert balance.overlap_join(frame([]), frame(b)).collect() == []


# --- halos -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("length", [1, 4, 40])
def test_lags_of_one_series_over_many_ranges(small, length):
    """Also of more rows than a range has, so that a halo comes from several ranges."""
    r = random.Random(length)
    v = [r.random() for _ in range(150)]
    got = learning.series_lags(small.createDataFrame(list(enumerate(v)), "t int, v double"), ["t"], "v", length)
    assert sorted(map(tuple, got.collect())) == [(t, *v[t - length : t], v[t]) for t in range(length, 150)]
    few = small.createDataFrame([(1, 2.0)], "t int, v double")
    assert learning.series_lags(few, ["t"], "v", length).collect() == []
    assert learning.series_lags(few.limit(0), ["t"], "v", length).collect() == []


def test_overlapping_paths(small):
    r = random.Random(6)
    z = [r.gauss(0, 0.15) for _ in range(120)]
    args = dict(strike=100, barrier=95, start=100, sigma=0.2, mu=0.1, rate=0.05, dt=0.02, years=1.0)
    got = iterate.rolling_barrier_payoffs(small.createDataFrame(list(enumerate(z)), "t int, z double"), ["t"], "z", 30, **args)
    paths = small.createDataFrame([(t, z[t - 29 : t + 1]) for t in range(29, 120)], "t int, z array<double>")
    want = paths.select("t", iterate.barrier_payoff(F.col("z"), **args).alias("payoff"))
    assert [t for t, _ in sorted(got.collect())] == list(range(29, 120))
    assert [p for _, p in sorted(got.collect())] == pytest.approx([p for _, p in sorted(want.collect())], rel=1e-12)


# --- products --------------------------------------------------------------------------------------------------------


def cells(spark, m, kind="bigint"):
    return spark.createDataFrame([(i, j, m[i, j].item()) for i in range(m.shape[0]) for j in range(m.shape[1]) if m[i, j]], f"i bigint, j bigint, v {kind}")


@pytest.mark.parametrize("layers", [1, 2, 4])
@pytest.mark.parametrize("tile", [4, 16])
def test_tiled_products(small, layers, tile):
    g = np.random.default_rng(layers)
    a, b = g.integers(-9, 9, (10, 21)), g.integers(-9, 9, (21, 7))
    a[:, 8:12] = 0  # a missing tile
    got = tiles.gemm(cells(small, a), cells(small, b), ((10, 21), (21, 7)), layers, tile)
    assert sorted(map(tuple, got.collect())) == [(i, j, int((a @ b)[i, j])) for i in range(10) for j in range(7)]
    x, y = g.normal(size=(10, 21)), g.normal(size=(21, 7))
    close = tiles.gemm(cells(small, x, "double"), cells(small, y, "double"), ((10, 21), (21, 7)), layers, tile)
    assert [v for _, _, v in sorted(map(tuple, close.collect()))] == pytest.approx((x @ y).ravel().tolist())
    with pytest.raises(ValueError, match="inner dimensions"):
        tiles.gemm(close, close, ((10, 21), (20, 7)))


def test_tiled_products_of_large_integers(small):
    big = np.full((2, 3), 1 << 29)
    assert {v for _, _, v in tiles.gemm(cells(small, big), cells(small, big.T), ((2, 3), (3, 2))).collect()} == {3 << 58}
    with pytest.raises(PythonException, match="64 bits"):
        tiles.gemm(cells(small, big * 4), cells(small, big.T * 4), ((2, 3), (3, 2))).collect()


@pytest.mark.parametrize("name", ["plus_times", "min_plus", "max_times", "max_min"])
@pytest.mark.parametrize("width, hot", [(4, 3), (4096, 100_000)])
def test_sparse_rows_over_semirings(small, name, width, hot):
    """A hot inner index, a heavy row and accumulators both short and long; sorted inside each partition."""
    g = np.random.default_rng(width)
    a, b = (g.integers(-9, 9, s) * (g.random(s) < 0.3) for s in ((40, 12), (12, 30)))
    a[:, 5], b[5], a[7] = 3, 2, 1
    times, add = sparse.SEMIRINGS[name]
    want = {}
    for i, k in zip(*np.nonzero(a), strict=True):
        for j in np.flatnonzero(b[k]):
            v = int(times(a[i, k], b[k, j]))
            want[i, j] = int(add(want[i, j], v)) if (i, j) in want else v
    got = sparse.gemm_rows(cells(small, a), cells(small, b), name, width, hot)
    assert {(i, j): v for i, j, v in got.collect()} == want
    for part in got.rdd.glom().collect():
        assert [(r.i, r.j) for r in part] == sorted((r.i, r.j) for r in part)


@pytest.mark.parametrize("stripe", [20, 4_000_000])
@pytest.mark.parametrize("name", ["plus_times", "min_plus", "max_min"])
def test_sparse_products_by_blocks(small, name, stripe):
    """Blocks of rows in parts and whole, negative indices, repeated cells, over NumPy's and columns' semirings."""
    g = np.random.default_rng(stripe)
    a, b = ([(int(i), int(j), int(v)) for i, j, v in zip(g.integers(-20, 20, 300), g.integers(-20, 20, 300), g.integers(-9, 9, 300), strict=True)] for _ in range(2))
    times, add = sparse.SEMIRINGS[name]
    want = {}
    for i, k, x in a:
        for m, j, y in b:
            if k == m:
                v = int(times(x, y))
                want[i, j] = int(add(want[i, j], v)) if (i, j) in want else v
    left, right = (small.createDataFrame(m, "i bigint, j bigint, v bigint") for m in (a, b))
    got = sparse.gemm_rows(left, right, name, 8, 5, stripe)
    columns = {"max_min": (F.least, F.max)}.get(name, name)
    assert {(i, j): v for i, j, v in got.collect()} == want
    assert {(i, j): v for i, j, v in sparse.gemm_blocks(left, right, columns, 8, 8, 5, stripe).collect()} == want
    for part in got.rdd.glom().collect():
        assert [(r.i, r.j) for r in part] == sorted((r.i, r.j) for r in part)


def test_sparse_products_exchange_lists(small):
    """2.4 million products of one dense block: a pair of lists an inner index is exchanged, and no product."""
    a = small.range(200 * 60).selectExpr("id % 200 AS i", "id div 200 AS j", "id % 7 AS v")
    b = a.selectExpr("j AS i", "i AS j", "v")
    pairs, parted = sparse.block_pairs(a, b, 1024, 1024, sparse.HOT, sparse.STRIPE)
    assert (pairs.count(), parted) == (60, False)
    for c in (sparse.gemm_rows(a, b), sparse.gemm_blocks(a, b)):
        assert c.count() == 40_000
        plan = c._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(i" not in plan and "hashpartitioning(bi" in plan


def test_sparse_products_of_cells_that_lie_by_inner_index(small, sf_dir):
    """Lines are exchanged by their row and pairs by their block: nothing between.  Wrongly stated, it costs exchanges only."""
    from lattix.plans import catalog

    plan = catalog.queries()["sparse_gemm_min_plus"](small, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("hashpartitioning(bi") == 1
    a = small.range(200 * 60).selectExpr("id % 200 AS i", "id div 200 AS j", "id % 7 AS v").repartition(5)
    b = a.selectExpr("j AS i", "i AS j", "v")
    assert rows(sparse.gemm_rows(a, b, lying=True)) == rows(sparse.gemm_rows(a, b))


@pytest.mark.parametrize("bound", [300_000, 0])
def test_sparse_products_deal_hot_cells_once(small, monkeypatch, bound):
    """Each side's cells are exchanged once, by inner index and salt, and the pairs once; with too many hot indices to broadcast, by shuffles."""
    monkeypatch.setattr(sparse, "BROADCAST", bound)
    a = small.range(200 * 60).selectExpr("id % 200 AS i", "id div 200 AS j", "id % 7 AS v").filter("j < 3 OR i < 5").repartition(5)
    b = a.selectExpr("j AS i", "i AS j", "v")
    got = sparse.gemm_rows(a, b, width=16, hot=20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "salt" in plan and (not bound or plan.count("Exchange hashpartitioning") == 3)
    assert rows(got) == rows(sparse.gemm_rows(a, b))


@pytest.mark.parametrize("name, pack, table", [("plus_times", 25, 7), ("or_and", 25, 7), ("min_plus", 25, 100), ("plus_times", 4_000_000, 1 << 22)])
def test_sparse_products_by_packs(spark, monkeypatch, name, pack, table):
    """Rows and columns whole and larger than a pack, one with more products than a table, negative indices, repeated cells, wide and narrow values."""
    g = np.random.default_rng(pack)
    a, b = ([(int(i), int(j), int(v)) for i, j, v in zip(g.integers(-20, 20, 300), g.integers(-20, 20, 300), g.integers(-9, 9, 300), strict=True)] for _ in range(2))
    a += [(7, k, 1 << 40) for k in range(-20, 20)]
    b += [(k, -3, 2) for k in range(-20, 20)] + [(0, j << 40, 1) for j in range(5)]
    times, add = sparse.SEMIRINGS[name]
    want = {}
    for i, k, x in a:
        for m, j, y in b:
            if k == m:
                v = int(times(x, y))
                want[i, j] = int(add(want[i, j], v)) if (i, j) in want else v
    left, right = (spark.createDataFrame(m, "i bigint, j bigint, v bigint") for m in (a, b))
    assert sorted(map(tuple, sparse.gemm_packs(left, right, name, pack=pack).collect())) == [(i, j, v) for (i, j), v in sorted(want.items())]
    if table < 1 << 22:  # a table of few products: workers import the module anew, so packs are multiplied here
        monkeypatch.setattr(sparse, "STEP", table)
        p, q = (dict(zip(sparse._PACKED, sparse._pack(*(np.array(c) for c in zip(*m, strict=True))), strict=True)) for m in (a, b))
        got = {}
        outer, columns = sparse._rising(p["at"]), sparse._rising(q["other"])
        for row, place, v, parts in sparse._pack_products(p, q, np.int64, times):
            assert set(parts) <= {row[0], row[-1]} and (np.diff(row) >= 0).all() and (len(v) <= table or row[0] == row[-1])
            for r, c, z in zip(row, place, v, strict=True):
                at = int(outer[r]), int(columns[c])
                got[at] = int(add(got[at], z)) if at in got else int(z)
        assert got == want


def test_sparse_products_by_packs_of_booleans_doubles_and_nothing(spark):
    a = spark.range(60).selectExpr("id % 6 AS i", "id div 6 AS j", "id % 7 = 0 AS v")
    b = a.selectExpr("j AS i", "i AS j", "v")
    got = sparse.gemm_packs(a, b, "or_and")
    assert dict(got.dtypes)["v"] == "boolean"
    assert rows(got) == rows(sparse.gemm_blocks(a, b, "or_and").select("i", "j", "v"))
    x, y = (m.selectExpr("i", "j", "CAST(v AS double) / 3 AS v") for m in (a, b))
    assert rows(sparse.gemm_packs(x, y, "max_times")) == rows(sparse.gemm_rows(x, y, "max_times"))
    assert sparse.gemm_packs(a.filter("i < 0"), b, "or_and").collect() == []
    assert sparse.gemm_packs(a.filter("j < 2"), b.filter("i > 5"), "or_and").collect() == []
    with pytest.raises(PythonException, match="must not be null"):
        sparse.gemm_packs(a.selectExpr("i", "j", "nullif(v, true) AS v"), b, "or_and").collect()


@pytest.mark.parametrize("name", ["hot_index", "min_plus", "or_and", "plus_times", "user_semiring"])
def test_sparse_products_exchange_no_pairs(spark, tmp_path, name):
    """Cells spread over all blocks, where nearly every pair of lists is one product: what is exchanged are packs, not pairs or products."""
    from lattix.plans import catalog
    from tests.oracle import same_rows

    lines = spark.range(1200).selectExpr("id % 60 AS l_partkey", "pmod(xxhash64(id), 2000) * 1024 AS l_suppkey", "CAST(1 + id % 50 AS double) AS l_quantity")
    lines.coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    got = catalog.queries()[f"sparse_gemm_{name}"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet'")
    same_rows(got, con, catalog.oracle_sql()[f"sparse_gemm_{name}"])
    written = []

    def walk(p):
        if "ShuffleExchange" in p.getClass().getName():
            written.append(p.metrics().apply("shuffleRecordsWritten").value())
        elif p.getClass().getSimpleName().endswith("QueryStageExec"):
            walk(p.plan())
        for k in range(p.children().size()):
            walk(p.children().apply(k))

    plan = got._jdf.queryExecution().executedPlan()
    walk(plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan)
    assert 0 < sum(written) < 3 * 1200, written  # the pairs of lists are some 24,000


def test_accumulators_of_dense_and_sparse_groups(monkeypatch):
    g = np.random.default_rng(1)
    group = np.sort(g.integers(0, 5, 400))
    group[group == 3] = 2
    j, v = g.integers(100, 130, 400), g.integers(1, 9, 400)
    for add, fold in ((np.add, sum), (np.minimum, min), (np.maximum, max)):
        for spread, table in ((1, 40), (1, 1 << 22), (1000, 1 << 22)):  # dense in one or several tables, and sparse
            monkeypatch.setattr(sparse, "TABLE", table)
            x, y, z = sparse.accumulate(group, j * spread, v, add)
            want = sorted({(int(a), int(b)) for a, b in zip(group, j, strict=True)})
            assert list(zip(x.tolist(), y.tolist(), strict=True)) == [(a, b * spread) for a, b in want]
            assert z.tolist() == [fold(v[(group == a) & (j == b)].tolist()) for a, b in want]


def test_split_products_and_appended_columns(spark):
    g = np.random.default_rng(3)
    a, b = g.integers(1, 5, (6, 4)), g.integers(1, 5, (4, 3))
    assert rows(matrix.split_gemm(cells(spark, a), cells(spark, b), 3)) == sorted(((i, j, int((a @ b)[i, j])) for i in range(6) for j in range(3)), key=str)
    both = matrix.append_columns(cells(spark, b), cells(spark, b + 1), 3)
    assert rows(both) == rows(cells(spark, np.hstack([b, b + 1])))


# --- stencils --------------------------------------------------------------------------------------------------------


def generations(alive, n, sizes, periodic):
    for _ in range(n):
        near = {}
        for i, j in alive:
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    u, v = i + a, j + b
                    u, v = (u % sizes[0] if periodic[0] else u), (v % sizes[1] if periodic[1] else v)
                    if (a or b) and 0 <= u < sizes[0] and 0 <= v < sizes[1]:
                        near[u, v] = near.get((u, v), 0) + 1
        alive = {c for c, k in near.items() if k == 3 or k == 2 and c in alive}
    return alive


@pytest.mark.parametrize("periodic", [(False, False), (False, True), (True, True)])
@pytest.mark.parametrize("block, halo", [(4, 3), (5, 7), (100, 2)])
def test_blocked_stencil(small, periodic, block, halo):
    """Halos wider than a block, blocks that end with the board, and halos that wrap around more than once."""
    r = random.Random(block)
    sizes = (13, 6)
    alive = {(r.randrange(13), r.randrange(6)) for _ in range(35)}
    frame = small.createDataFrame([*alive, (-1, 2), (13, 0), *list(alive)[:2]], "i int, j int")
    for n in (0, 1, 7):
        got = grid.life_blocks(frame, ("i", "j"), sizes, periodic, n, halo, block)
        assert sorted(map(tuple, got.collect())) == sorted(generations(alive, n, sizes, periodic))


def test_blocked_stencil_of_planes_and_of_nothing(small):
    r = random.Random(1)
    planes = {x: {(r.randrange(9), r.randrange(7)) for _ in range(25)} for x in range(3)}
    frame = small.createDataFrame([(x, y, z) for x, p in planes.items() for y, z in p], "x int, y int, z int")
    got = grid.life3d(frame, 7, 9, 5, every=2, block=4)
    want = [(x, *c) for x, p in planes.items() for c in generations(p, 5, (9, 7), (False, True))]
    assert sorted(map(tuple, got.select("x", "y", "z").collect())) == sorted(want)
    assert grid.life2d(small.createDataFrame([], "row int, col int"), 8, 8, 6).collect() == []
