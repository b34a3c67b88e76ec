"""Known answers and plain Python versions of operators, sources, calls and streams."""

import glob
import random
import threading
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.functions import blocking, learning, registry, scalar
from lattix.operators import arrays, iterate, kv, matrix, ordered, queues, tasks
from lattix.plans import catalog
from lattix.plans import learning as learning_plans
from lattix.plans.lineage import CachedCopy, table
from lattix.sources import generators, matrices, text
from lattix.streaming import state
from tests.oracle import connect, same_rows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("most", [1000, 0])
@pytest.mark.parametrize("kind", ["bigint", "string", "timestamp"])
def test_positions_of_a_hot_group(spark, kind, most):
    """One group holds most rows; null groups and tied orders count too; by a window, and by ranges."""
    r = random.Random(3)
    data = [(None if k % 17 == 0 else (0 if k % 3 else k % 5), r.randrange(50), k) for k in range(600)]
    df = spark.createDataFrame(data, "g bigint, o bigint, k bigint")
    order = {"bigint": F.col("o"), "string": F.lpad(F.col("o").cast("string"), 3, "0"), "timestamp": F.timestamp_seconds(F.col("o"))}[kind]
    got = ordered.positions(df.withColumn("o", order), ["g"], ["o", "k"], "pos", "n", group_rows=most)
    want = []
    for g in {x[0] for x in data}:
        own = sorted((x for x in data if x[0] == g), key=lambda x: (x[1], x[2]))
        want += [(x[2], p, len(own)) for p, x in enumerate(own)]
    assert rows(got.select("k", "pos", "n")) == sorted(want)
    if kind == "bigint":
        sums = ordered.sums_before(df, ["g"], ["o", "k"], F.col("k"), "before", group_rows=most)
        want = []
        for g in {x[0] for x in data}:
            total = 0
            for x in sorted((x for x in data if x[0] == g), key=lambda x: (x[1], x[2])):
                want.append((x[2], total))
                total += x[2]
        assert rows(sums.select("k", "before")) == sorted(want)
    assert ordered.positions(df.limit(0), ["g"], ["o"]).count() == 0


def test_global_positions(spark):
    df = spark.range(500).select("id", F.xxhash64("id").alias("h"))
    want = {x["id"]: p for p, x in enumerate(sorted(df.collect(), key=lambda x: x["h"]))}
    assert {x["id"]: x["pos"] for x in arrays.global_positions(df.repartition(7), F.col("h")).collect()} == want


def test_preview_and_inversions(spark):
    assert [r[0] for r in arrays.preview(spark.range(100).select((-F.col("id")).alias("x")), ["x"], 3).collect()] == [-99, -98, -97]
    unsorted = spark.createDataFrame([(0, 3), (0, 1), (0, 2)], "h bigint, v bigint").coalesce(1)
    assert rows(arrays.inversions(unsorted, "h", "v")) == [(0, 3, 1)]


def test_bounded_inserts_fail_by_probing(spark):
    """Multiples of the capacity probe squares only, so they fail while slots are free; a known key keeps its slot."""
    keys = [0, 4, 8, 12, 4, 1]
    df = spark.createDataFrame(list(enumerate(keys)), "o bigint, k bigint").withColumn("h", F.lit(0))
    got = {x["o"]: (x["slot"], x["accepted"]) for x in kv.insert_bounded(df, "h", "o", "k", 4).collect()}
    assert got == {0: (0, True), 1: (1, True), 2: (None, False), 3: (None, False), 4: (1, True), 5: (2, True)}


def test_compare_and_swap_chain(spark):
    df = spark.createDataFrame([(0, 1, 0, 5), (0, 2, 0, 6), (0, 3, 5, 7)], "c bigint, o bigint, old bigint, new bigint")
    assert [(x["seen"], x["swapped"]) for x in sorted(kv.compare_and_swap(df, "c", "o", "old", "new").collect(), key=lambda x: x["o"])] == [(0, True), (5, False), (5, True)]


def test_lookup_of_a_missing_entry_is_an_error(spark):
    entries = spark.createDataFrame([(1, "a")], "t bigint, e string")
    assert rows(kv.lookup_entries(spark.createDataFrame([(1,)], "t bigint"), entries, "t")) == [(1, "a")]
    with pytest.raises(Exception, match="no entry for 2"):
        kv.lookup_entries(spark.createDataFrame([(2,)], "t bigint"), entries, "t").collect()


def test_shapes_are_checked(spark):
    m = generators.modulo_matrix(spark, 2, 3, 5)
    with pytest.raises(ValueError):
        matrix.binary(m, m, lambda a, b: a, shapes=((2, 3), (3, 2)))
    with pytest.raises(ValueError):
        matrix.gemm(m, m, shapes=((2, 3), (2, 3)))
    assert matrix.complementary_shape((2, 3), (2, 9)) == (3, 9) and matrix.product_shape((2, 3), (3, 9)) == (2, 9)
    assert blocking.tile_shape(10, 10, 4, (4, 20)) == (4, 10)
    assert matrix.empty(spark).count() == 0


def test_dag_of_a_cycle_is_an_error(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "a bigint, b bigint")
    assert rows(iterate.dag_levels(edges)) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    with pytest.raises(ValueError):
        iterate.dag_levels(spark.createDataFrame([(1, 2), (2, 1)], "a bigint, b bigint"))


def test_queue_snapshot_refused_and_schedule(spark):
    q = spark.createDataFrame([(0, 1, 5, False), (0, 2, 6, False), (1, 1, 7, True)], "h bigint, o bigint, v bigint, gone boolean")
    got = {x["h"]: (x["items"], x["refused"]) for x in queues.snapshot(q, "h", "o", "v", F.col("gone")).collect()}
    assert got == {0: ([5, 6], False), 1: (None, True)}


def test_task_ids_go_on(spark):
    none = spark.createDataFrame([], "task bigint")
    first = tasks.create(none, spark.createDataFrame([(0, 1), (0, 2), (3, 1)], "rank bigint, o bigint"), "rank", ["o"])
    more = tasks.create(first, spark.createDataFrame([(0, 9), (5, 9)], "rank bigint, o bigint"), "rank", ["o"])
    assert rows(tasks.last_ids(first)) == [(0, 1), (3, 3 << 24)]
    assert rows(more.select("task")) == [(2,), (5 << 24,)]


def test_djb2_wraps_at_64_bits(spark):
    texts = ["", "a", "é", "a long enough text to wrap around more than once"]

    def djb2(t):
        h = 5381
        for b in t.encode():
            h = (h * 33 + b) % 2**64
        return str(h)

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(scalar.djb2(F.col("t"))).collect()] == [djb2(t) for t in texts]
    assert scalar.formula([2.0, 3.0], 1.0).startswith("y = 3.000 x^")


# sources


def test_number_csv_drops_the_header_by_its_place(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,2\n1,2\n\n"x",3.5b,\n')
    (tmp_path / "b.csv").write_text("h\n7\n")
    got = sorted(x["cells"] for x in text.read_number_csv(spark, str(tmp_path)).collect())
    assert got == [[0.0, 3.5, 0.0], [1.0, 2.0], [7.0]]


def test_named_csv_and_statistics(spark, tmp_path):
    (tmp_path / "log.csv").write_text(",".join(str(k) for k in range(50)) + "\n")
    assert text.read_named_csv(spark, str(tmp_path / "log.csv"), text.log_schema()).first()["target"] == 49.0
    text.write_statistics(spark.createDataFrame([(0, 3, 1.5)], "rank bigint, n bigint, mean double"), str(tmp_path / "stats"))
    assert spark.read.option("header", True).csv(str(tmp_path / "stats")).first().asDict() == {"rank": "0", "n": "3", "mean": "1.5"}
    text.write_lines(spark.range(2), str(tmp_path / "lines"), "id")
    assert rows(spark.read.text(str(tmp_path / "lines"))) == [("0",), ("1",)]


def test_matrices_of_several_files(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix\n% c\n3 3 2\n1 1 5\n3 2 6\n")
    (tmp_path / "b.mtx").write_text("%%MatrixMarket matrix\n2 2 1\n2 2\n")
    assert rows(matrices.read_mtx(spark, str(tmp_path))) == [(0, 0, 5.0), (1, 1, 1.0), (2, 1, 6.0)]
    assert matrices.mtx_shape(spark, str(tmp_path)) == (3, 3, 3)
    assert matrices.check_row_sorted(spark, str(tmp_path))
    (tmp_path / "c.mtx").write_text("3 3 2\n3 1 5\n1 2 6\n")
    assert not matrices.check_row_sorted(spark, str(tmp_path / "c.mtx"))
    with pytest.raises(ValueError):
        matrices.read_mtx(spark, str(tmp_path / "c.mtx"), require_sorted=True)
    assert rows(matrices.read_mtx(spark, str(tmp_path / "c.mtx"), one_based=False)) == [(1, 2, 6.0), (3, 1, 5.0)]


def test_matrix_sinks_are_read_back(spark, tmp_path):
    m = generators.modulo_matrix(spark, 300, 7, 11)
    matrices.write_mtx(m.repartition(5), str(tmp_path / "m"), 300, 7)
    assert rows(matrices.read_mtx(spark, str(tmp_path / "m"), require_sorted=True)) == rows(m)
    assert matrices.mtx_shape(spark, str(tmp_path / "m")) == (300, 7, 2100)
    matrices.write_binary_csr(m, str(tmp_path / "b"), (300, 7), band=64)
    assert rows(matrices.read_binary_csr(spark, str(tmp_path / "b"))) == rows(m)
    (tmp_path / "one.binary").write_bytes(matrices.csr_bytes((3, 2), [(0, 1, 2.0), (2, 0, 3.0)]))
    assert rows(matrices.read_binary_csr(spark, str(tmp_path / "one.binary"))) == [(0, 1, 2.0), (2, 0, 3.0)]
    assert matrices.binary_shape(spark, str(tmp_path / "one.binary")) == (3, 2, 2)


def test_tiles_are_pruned(spark, tmp_path):
    m = generators.modulo_matrix(spark, 40, 40, 11)
    matrices.write_tiles(m, str(tmp_path / "t"), 10, 10)
    tiles = matrices.read_tiles(spark, str(tmp_path / "t"))
    part = matrix.tiled_sub_matrix(tiles, 10, 10, 12, 25, 3, 9)
    assert rows(part) == rows(matrix.sub_matrix(m, 12, 25, 3, 9))
    assert part.inputFiles() and "PartitionFilters: [isnotnull(bi" in part._jdf.queryExecution().toString()
    read = {x["_metadata"]["file_path"] for x in matrix.tile(tiles.select("*", "_metadata"), 1, 2).collect()}
    assert read and all("bi=1/bj=2" in f for f in read)


def test_many_tiles_share_files(spark, tmp_path):
    """1,600 tiles lie in order in a few files, of which a tile is in one or two; negative and null indices too."""
    m = generators.modulo_matrix(spark, 40, 40, 11).union(spark.sql("SELECT * FROM VALUES (-3L, -2L, 5.0D), (NULL, 1L, 6.0D)"))
    matrices.write_tiles(m, str(tmp_path / "t"), 1, 1)
    files = list((tmp_path / "t").rglob("*.parquet"))
    tiles = matrices.read_tiles(spark, str(tmp_path / "t"))
    assert len(files) < 50 and tiles.columns == ["i", "j", "v", "bi", "bj"] and not list((tmp_path / "t").glob("bi=*"))
    assert sorted(map(str, tiles.select("i", "j", "v").collect())) == sorted(map(str, m.collect()))
    assert rows(matrix.tiled_sub_matrix(tiles, 1, 1, 12, 25, 3, 9)) == rows(matrix.sub_matrix(m, 12, 25, 3, 9))
    assert rows(matrix.element(tiles, 1, 1, -3, -2).select("v")) == [(5.0,)]
    part = matrix.tile(tiles, 7, 2)
    assert part.count() == m.filter("i = 7 AND j = 2").count() and "PushedFilters: [IsNotNull(bi), IsNotNull(bj), EqualTo(bi,7), EqualTo(bj,2)]" in part._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["element_get", "tile_get", "tile_row_get", "tile_slice_pruned", "mtx_roundtrip_tiled"])
def test_queries_over_many_tiles(spark, sf_dir, monkeypatch, name):
    """In files that tiles share, and without a folder a tile."""
    monkeypatch.setattr(matrices, "FOLDERS", 1)
    written = []
    read = matrices.read_tiles
    monkeypatch.setattr(matrices, "read_tiles", lambda s, path: (written.extend(glob.glob(f"{path}/bi=*")), read(s, path))[1])
    same_rows(catalog.queries()[name](spark, sf_dir), connect(sf_dir), catalog.oracle_sql()[name])
    assert not written



def test_series_do_not_depend_on_partitions(spark):
    a = rows(generators.sine_series(spark, 50, noise=1.0, seed=4))
    assert a == rows(generators.sine_series(spark, 50, noise=1.0, seed=4).repartition(3)) and a != rows(generators.sine_series(spark, 50, noise=1.0, seed=5))


# learning


@pytest.fixture(scope="module")
def odd_events(tmp_path_factory):
    """Events about half seconds before midnight, before 1970, and without a time."""
    folder = tmp_path_factory.mktemp("odd")
    r = random.Random(4)
    times = [f"2024-01-{d:02} {t}" for d in range(1, 16) for t in ["00:00:00.4", "12:00:00", "23:59:59.499999", "23:59:59.5", "23:59:59.7"] for _ in range(r.randint(1, 4))]
    times += ["1969-12-31 23:59:58.5", "1969-12-31 12:00:00", "1969-12-30 23:59:59.5", "1969-12-29 06:00:00", None, None, None]
    rows = ", ".join(f"({k}, {'NULL' if t is None else repr(t)}::TIMESTAMP, '{r.choice('ab')}')" for k, t in enumerate(times))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) AS e(event_id, ts, event_type)) TO '{folder}/events.parquet'")
    return str(folder)


def test_days_of_lag_features_near_midnight(spark, odd_events):
    same_rows(learning_plans.lag_features(spark, odd_events), connect(odd_events), catalog.oracle_sql()["lag_features"])


def test_regression_on_days_near_midnight(spark, odd_events):
    same_rows(learning_plans.ols_lag(spark, odd_events), connect(odd_events), catalog.oracle_sql()["ols_lag"])


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_regression_in_any_session_zone(spark, odd_events, zone):
    """Events' times have no zone, so the session's one must not move them to other days."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        same_rows(learning_plans.ols_lag(spark, odd_events), connect(odd_events), catalog.oracle_sql()["ols_lag"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_lagged_least_squares_against_numpy(spark, sf_dir):
    """The query's predictions are those of the normal equations over all its rows."""
    daily = learning.lag_features(learning_plans._daily(spark, sf_dir), "day", "n", 3, by=["event_type"]).collect()
    x = np.array([[1.0, r["a0"], r["a1"], r["a2"]] for r in daily])
    y = np.array([float(r["target"]) for r in daily])
    fitted = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    want = {(r["event_type"], r["day"]): p for r, p in zip(daily, fitted, strict=True)}
    got = {(r["event_type"], r["day"]): r["prediction"] for r in learning_plans.ols_lag(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_layers_against_backpropagation(spark):
    """Descent from sums of products equals descent over the rows, layer by layer."""
    r = np.random.default_rng(1)
    x, hidden = r.normal(size=(40, 3)), (5, 4)
    y = x @ [1.0, -2.0, 0.5] + 0.3
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double")
    weights, biases, losses = learning.linear_mlp(df, ["a", "b", "c"], "y", hidden, epochs=30, rate=0.05, seed=7)
    rng = np.random.default_rng(7)
    sizes = [3, *hidden, 1]
    ws = [rng.uniform(-(m**-0.5), m**-0.5, (m, n)) for m, n in zip(sizes, sizes[1:], strict=False)]
    bs = [rng.uniform(-(m**-0.5), m**-0.5, n) for m, n in zip(sizes, sizes[1:], strict=False)]
    for epoch in range(30):
        layers = [x]
        for w, b in zip(ws, bs, strict=True):
            layers.append(layers[-1] @ w + b)
        error = layers[-1][:, 0] - y
        assert abs(losses[epoch] - (error**2).mean()) < 1e-9
        back = (2 * error / len(y))[:, None]
        for k in reversed(range(len(ws))):
            gw, gb, back = layers[k].T @ back, back.sum(0), back @ ws[k].T
            ws[k], bs[k] = ws[k] - 0.05 * gw, bs[k] - 0.05 * gb
    assert all(np.allclose(a, b) for a, b in zip(weights + biases, ws + bs, strict=True))
    c, constant = learning.mlp_formula(weights, biases)
    assert np.allclose(x @ c + constant, layers[-1][:, 0], atol=0.2) and losses[-1] < losses[0]


def test_smooth_l1_descends_below_the_tolerance(spark):
    df = spark.range(100).select((F.col("id") / 50 - 1).alias("x")).withColumn("y", 2 * F.col("x") + 0.5)
    steps = learning.smooth_l1_descent(df, F.col("x"), F.col("y"), rate=0.9, tolerance=1e-3, most=60)
    assert steps[-1][2] < 1e-3 <= steps[-2][2] and abs(steps[-1][0] - 2) < 0.2


def test_mlp_query_covers_all_rows(spark, sf_dir):
    got = learning_plans.mlp_linear(spark, sf_dir)
    assert got.count() == table(spark, sf_dir, "lineitem").count()
    assert got.agg(F.corr("y", "prediction")).first()[0] > 0.5


# calls


def test_calls_without_answer_and_lazy_calls(spark):
    seen = spark.sparkContext.accumulator(0)

    def add(part):
        for row in part:
            seen.add(row["id"])

    registry.notify(spark.range(5), add)
    assert seen.value == 10
    calls = registry.Registry("lazy")
    ran = spark.sparkContext.accumulator(0)

    def twice(x):
        import pyarrow.compute as pc

        ran.add(1)
        return pc.multiply(x, 2)

    calls.remote("twice", ["bigint"], "bigint", twice)
    later = spark.range(3).select(calls.call("twice", F.col("id")).alias("x"))
    assert ran.value == 0 and rows(later) == [(0,), (2,), (4,)] and ran.value > 0
    calls.publish(spark)
    assert spark.sql("SELECT lazy_twice(4L)").first()[0] == 8


def test_a_timed_call_is_cancelled(spark):
    def slow(batches):
        for b in batches:
            time.sleep(20)
            yield b

    began = time.time()
    with pytest.raises(TimeoutError):
        registry.timed(spark, 1.0, spark.range(1).mapInArrow(slow, "id bigint").collect)
    assert time.time() - began < 15
    assert registry.timed(spark, 60.0, spark.range(7).count) == 7


def test_a_provider_runs_in_its_pool(spark):
    calls = registry.Registry("own", pool="own-pool")
    pool = lambda: spark.sparkContext.getLocalProperty("spark.scheduler.pool")
    assert calls.run(spark, pool) == "own-pool" and pool() != "own-pool"


def test_cached_copy_keeps_its_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    copy = CachedCopy(lambda: spark.read.parquet(path))
    spark.range(2).write.mode("append").parquet(path)
    assert copy.value.count() == 3 and copy.refresh().count() == 5 and copy.value.count() == 5


# streams


def test_user_state_over_batches(spark, tmp_path):
    for part in ([(1, 5), (2, 7)], [(1, 9)], [(1, 2), (2, 1)]):
        spark.createDataFrame(part, "k bigint, v bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = state.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    assert rows(state.user_state(stream, "k", "v", max, 0)) == [(1, 9, 3), (2, 7, 2)]


def test_ordered_state_with_timers(spark, tmp_path):
    """Batches that overlap in time, out of order inside and among each other, with expiry on the way; what comes behind the watermark is dropped."""
    r = random.Random(3)
    updates = [(r.randrange(3), 10 * k, k) for k in range(60)]  # seconds
    batches = [[], [], [], []]
    for u in updates:
        batches[min(3, max(0, u[2] // 15 + r.choice([0, 0, 1])))].append(u)
    batches.append([(0, 5, 1000), (9, 2000, 1001)])  # the first is far behind the watermark
    for b in batches:
        r.shuffle(b)
        rows_ = spark.createDataFrame(b, "k bigint, s bigint, v bigint").select("k", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("t"), "v")
        rows_.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = state.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    got = state.ordered_state(stream, "k", "t", "v", "v", lambda held, v: (held * 31 + v) % 1000003, 7, "200 seconds")
    want = {}
    for k, _, v in [*updates, (9, 2000, 1001)]:
        held, n = want.get(k, (7, 0))
        want[k] = (held * 31 + v) % 1000003, n + 1
    assert rows(got) == sorted((k, *s) for k, s in want.items())


def test_windowed_counts_with_a_watermark(spark, tmp_path):
    times = [("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:01:10", "a"), ("2024-01-01 02:00:00", "b")]
    spark.createDataFrame(times, "t string, k string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = state.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    seen, lock = [], threading.Lock()

    def keep(batch, number):
        with lock:
            seen.extend((x["k"], x["n"]) for x in batch.collect())

    state.drain(state.windowed_counts(stream, "t", "1 minute", "1 minute", ["k"]), keep)
    assert sorted(seen) == [("a", 1), ("a", 2), ("b", 1)]
