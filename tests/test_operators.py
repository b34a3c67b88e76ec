"""Known answers of operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.functions import blocking, codec, learning, scalar
from lattix.functions.registry import Registry, with_callback
from lattix.operators import arrays, balance, grid, iterate, kv, matrix, queues, reduce
from lattix.sources import generators, matrices, text
from lattix.streaming import state


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def loads(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "rank bigint, load bigint")


def test_default_migration(spark):
    assert rows(balance.migrate_default(loads(spark, [0, 0, 10, 20]))) == [(2, 1, 5), (3, 0, 10)]
    assert rows(balance.migrate_default(loads(spark, [5, 5, 5, 6]))) == []
    assert rows(balance.migrate_default(loads(spark, [0, 0]))) == []


def greedy(values):
    mean = sum(values) // len(values)
    give = {r: v - mean for r, v in enumerate(values) if v > mean}
    out = []
    for to, v in enumerate(values):
        need = mean - v
        for r in sorted(give):
            if need <= 0:
                break
            n = min(need, give[r])
            if n > 0:
                out.append((r, to, n))
                give[r] -= n
                need -= n
    return sorted(out)


@pytest.mark.parametrize("values", [[0, 4, 8], [1, 9, 3, 30, 2, 2], [7], [5, 5]])
def test_aggressive_migration_is_greedy(spark, values):
    assert rows(balance.migrate_aggressive(loads(spark, values))) == greedy(values)


def test_replication_on_the_ring(spark):
    assert rows(balance.replicate_ring(loads(spark, [100, 0, 0]))) == [(0, 1, 5), (0, 2, 5)]
    assert rows(balance.replicate_ring(loads(spark, [100, 40]))) == [(0, 1, 5), (1, 0, 2)]


def test_ring_shift(spark):
    ranks = spark.range(5).select(F.col("id").alias("r"), (F.col("id") * 10).alias("v"))
    assert rows(balance.ring_shift(ranks, "r", "v", 5, 2).select("r", "received")) == [(r, (r - 2) % 5 * 10) for r in range(5)]


def test_steal_takes_a_third(spark):
    q = spark.range(10).select(F.lit(0).alias("host"), "id")
    assert queues.steal(q, "host", ["id"]).count() == 4


def test_bounded_push_and_pops(spark):
    q = spark.range(5).select(F.lit(0).alias("host"), "id")
    assert queues.push_bounded(q, "host", ["id"], 3).filter("accepted").count() == 3
    assert queues.pop_first(q, "host", ["id"], 9).count() == 5
    assert queues.pop_batch(q, "host", ["id"], 9).count() == 0


def test_schedule_order(spark):
    tasks = spark.createDataFrame([(0, "local", 1), (0, "stolen", 9), (0, "replicated_local", 2), (0, "replicated_local", 3)], "host int, kind string, seq int")
    got = queues.schedule(tasks, "host", "kind", "seq").orderBy("rank").select("kind", "seq").collect()
    assert [tuple(r) for r in got] == [("stolen", 9), ("local", 1), ("replicated_local", 3), ("replicated_local", 2)]


def test_saxpy_and_arrays(spark):
    df = spark.createDataFrame([(1.0, 2.0, [2.0, 4.0, 6.0], [3.0, 3.0])], "x double, y double, a array<double>, b array<double>")
    got = df.select(scalar.saxpy(2.0, F.col("x"), F.col("y")), scalar.min_max_row(F.col("a")), scalar.min_max_row(F.col("b")), scalar.add_arrays(F.col("a"), F.col("a"))).first()
    assert list(got) == [4.0, [0.0, 0.5, 1.0], [0.0, 0.0], [4.0, 8.0, 12.0]]


def test_lenient_numbers_and_trailing_comma(spark):
    df = spark.createDataFrame([("1,2,",)], "line string")
    assert df.select(scalar.csv_cells(F.col("line"))).first()[0] == ["1", "2", ""]
    cells = spark.createDataFrame([("3.5abc",), ("x",), ("",), (None,), (" -2e1 ",)], "c string")
    assert [r[0] for r in cells.select(scalar.lenient_float(F.col("c"))).collect()] == [3.5, 0.0, 0.0, 0.0, -20.0]


def test_calculator_division_by_zero(spark):
    got = spark.range(1).select(scalar.calculator("div", F.lit(1.0), F.lit(0.0)).alias("r")).select("r.*").first()
    assert tuple(got) == (None, 1, "Division by zero")


def test_blocking():
    assert blocking.factor(12) == (4, 3)
    assert blocking.factor(7) == (7, 1)
    assert blocking.block_sizes(10, 4) == [3, 3, 3, 1]
    assert blocking.tile_shape(100, 50, 4, "row") == (25, 50)


def test_bloom_shape_and_false_negatives(spark):
    k, buckets = kv.bloom_shape(1000, 0.01)
    assert k == 7
    members = spark.range(1000)
    bloom = kv.bloom_build(members, "id", k, buckets)
    assert kv.bloom_probe(members, bloom, "id", k, buckets).count() == 1000
    assert kv.bloom_probe(spark.range(1000, 3000), bloom, "id", k, buckets).count() < 60


@pytest.mark.parametrize("p", [0.1, 0.01, 0.001])
def test_bloom_keeps_the_asked_rate(spark, p):
    k, buckets = kv.bloom_shape(5000, p)
    bloom = kv.bloom_build(spark.range(5000), "id", k, buckets)
    wrong = kv.bloom_probe(spark.range(5000, 105_000), bloom, "id", k, buckets).count()
    assert wrong < 2 * p * 100_000


def test_bloom_semi_join_beyond_the_filters_bound(spark, monkeypatch):
    few = kv.bloom_semi_join(spark.range(100), spark.range(50, 70), "id", 20)
    monkeypatch.setattr(kv, "MAX_BROADCAST_WORDS", 0)
    assert rows(few) == rows(kv.bloom_semi_join(spark.range(100), spark.range(50, 70), "id", 20)) == [(k,) for k in range(50, 70)]


def test_upsert_keeps_the_last_write(spark):
    writes = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, seq int, v string")
    assert rows(kv.upsert_last(writes, "k", ["seq"]).select("k", "v")) == [(1, "b"), (2, None)]


def test_gemm_equals_numpy(spark):
    a, b = generators.modulo_matrix(spark, 4, 5, 7), generators.modulo_matrix(spark, 5, 3, 5)
    x = np.array([[(i * 5 + j) % 7 for j in range(5)] for i in range(4)], float)
    y = np.array([[(i * 3 + j) % 5 for j in range(3)] for i in range(5)], float)
    want = sorted((i, j, v) for (i, j), v in np.ndenumerate(x @ y))
    assert rows(matrix.gemm(a, b)) == want
    assert rows(matrix.split_gemm(a, b, 3)) == want
    with pytest.raises(ValueError):
        matrix.product_shape((4, 5), (4, 3))


def test_matrix_equality_and_assignment(spark):
    m = generators.modulo_matrix(spark, 3, 3, 4)
    assert matrix.equal(m, matrix.transpose(matrix.transpose(m)))
    changed = matrix.assign(m, spark.createDataFrame([(0, 0, 9.0)], "i bigint, j bigint, v double"))
    assert not matrix.equal(m, changed) and changed.count() == 9


def test_row_pointers_with_empty_rows(spark):
    m = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (3, 0, 1.0)], "i bigint, j bigint, v double")
    got = matrix.row_pointers(m, spark.range(5).withColumnRenamed("id", "i"))
    assert rows(got.select("i", "row_start")) == [(0, 0), (1, 2), (2, 2), (3, 2), (4, 3)]


def test_blinker_has_period_two(spark):
    blinker = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "row bigint, col bigint")
    once = grid.life2d_step(blinker, 3, 3)
    assert rows(once) == [(0, 1), (1, 1), (2, 1)]
    assert rows(grid.life2d(blinker, 3, 3, 2, every=1)) == rows(blinker)
    assert rows(grid.board_text(blinker, 3, 3)) == [(0, "000"), (1, "111"), (2, "000")]


def test_life3d_keeps_planes_apart_and_wraps_z(spark):
    cells = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (0, 1, 3), (1, 1, 0)], "x bigint, y bigint, z bigint")
    assert rows(grid.life3d_step(cells, 4, 3)) == [(0, 0, 0), (0, 1, 0), (0, 2, 0)]


def kmeans_model(points, k, passes):
    c = points[:k].copy()
    for _ in range(passes):
        label = ((points[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([points[label == j].sum(0) / max(1, (label == j).sum()) for j in range(k)])
    return c


def test_kmeans_equals_sequential_model(spark):
    points = generators.random_points(spark, 60, 50, seed=3)
    xy = np.array([(r["x"], r["y"]) for r in points.orderBy("id").collect()])
    got = iterate.kmeans(points, "id", 3, 4).orderBy("k").collect()
    assert np.allclose([(r["cx"], r["cy"]) for r in got], kmeans_model(xy, 3, 4))


def test_lag_features(spark):
    series = spark.createDataFrame([(t, float(t * t)) for t in range(5)], "t int, v double")
    got = learning.lag_features(series, "t", "v", 2).orderBy("t").select("a0", "a1", "target").collect()
    assert [tuple(r) for r in got] == [(0.0, 1.0, 4.0), (1.0, 4.0, 9.0), (4.0, 9.0, 16.0)]


def test_descent_reaches_the_line(spark):
    df = spark.range(20).select((F.col("id") / 10).alias("x"), (F.col("id") / 10 * 3 + 1).alias("y"))
    w, b, loss = learning.mse_descent(df, F.col("x"), F.col("y"), 2000, 0.1)[-1]
    assert abs(w - 3) < 1e-3 and abs(b - 1) < 1e-3 and loss < 1e-5


def test_annotation_first_write_wins(spark):
    df = spark.createDataFrame([(1, "a", 1, 10), (1, "a", 2, 20)], "o int, k string, seq int, n bigint").withColumn("v", codec.annotation("i64", F.col("n")))
    got = codec.annotations(df, "o", "k", "seq", "v")
    value, found = codec.get_annotation(F.col("annotations"), "a", "i64")
    missing = codec.get_annotation(F.col("annotations"), "zz", "i64")
    assert tuple(got.select(value, found, missing[0], missing[1]).first()) == (10, True, None, False)


def test_registry_checks_arguments(spark):
    calls = Registry()
    calls.native("add", ["int", "int"], lambda a, b: a + b)
    assert spark.range(1).select(calls.call("add", F.lit(33), F.lit(66))).first()[0] == 99
    with pytest.raises(TypeError):
        calls.call("add", F.lit(1))
    assert spark.range(1).select(scalar.prefix(F.lit("Matthieu"), 6)).first()[0] == "Matthi"


def test_matrix_files(spark, tmp_path):
    m = spark.createDataFrame([(0, 2, 1.5), (1, 0, 2.0), (2, 1, 3.0)], "i bigint, j bigint, v double")
    matrices.write_mtx(m, str(tmp_path / "a.mtx"), 3, 3)
    assert matrices.mtx_shape(spark, str(tmp_path / "a.mtx")) == (3, 3, 3)
    back = matrices.read_mtx(spark, str(tmp_path / "a.mtx"))
    assert rows(back) == rows(m) and matrices.check_row_sorted(spark, str(tmp_path / "a.mtx"))
    spark.dataSource.register(matrices.MtxDataSource)
    assert rows(spark.read.format("mtx").load(str(tmp_path / "a.mtx"))) == rows(m)
    (tmp_path / "b.binary").write_bytes(matrices.csr_bytes((3, 3), [(0, 2, 1.5), (1, 0, 2.0), (2, 1, 3.0)]))
    assert rows(matrices.read_binary_csr(spark, str(tmp_path / "b.binary"))) == rows(m)
    assert matrices.binary_shape(spark, str(tmp_path / "b.binary")) == (3, 3, 3)
    assert matrices.detect_format("x.y.mtx") == "mtx"
    with pytest.raises(ValueError):
        matrices.detect_format("x.csv")


def test_csv_sources(spark, tmp_path):
    (tmp_path / "log.csv").write_text("1,2,3\n4,5,6\n")
    schema = text.log_schema(1)
    assert rows(text.read_named_csv(spark, str(tmp_path / "log.csv"), schema)) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    (tmp_path / "h.csv").write_text("a,b\n1,x,\n")
    assert text.read_number_csv(spark, str(tmp_path / "h.csv")).first()[0] == [1.0, 0.0, 0.0]


def test_generators(spark):
    assert [r["x"] for r in generators.linspace(spark, 0, 11, 4).orderBy("i").collect()] == [0.0, 2.75, 5.5, 8.25]
    assert generators.random_text(spark, 2, 9).filter(F.length("text") == 9).count() == 2
    assert generators.random_matrix(spark, 3, 3).filter("v >= 0 and v < 1").count() == 9


def test_statistics_of_nothing(spark):
    got = reduce.statistics(spark.createDataFrame([], "v double"), F.col("v")).first()
    assert (got["n"], got["mean_value"]) == (0, 0.0)


def test_stream_window_counts(spark, tmp_path):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:05' AS ts, 'a' AS k UNION ALL SELECT timestamp_ntz'2024-01-01 00:01:05', 'a'")
    df.write.parquet(str(tmp_path / "in"))
    stream = state.windowed_counts(state.file_stream(spark, str(tmp_path / "in"), df.schema), "ts", "10 minutes", "1 minute", ["k"])
    seen = []
    state.drain(stream, lambda batch, n: seen.extend(r["n"] for r in batch.collect()), "update", str(tmp_path / "work"))
    assert seen == [1, 1]


def test_array_places_are_checked(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "idx bigint, val double")
    assert rows(arrays.put(a, spark.createDataFrame([(1, 9.0)], "idx bigint, val double"), 3)) == [(0, 1.0), (1, 9.0), (2, 3.0)]
    with pytest.raises(Exception, match="out of bounds"):
        arrays.get(a, spark.createDataFrame([(3,)], "idx bigint"), 3).collect()
    with pytest.raises(IndexError):
        arrays.get_range(a, 0, 4, 3)
    assert arrays.row_slices(spark.range(10), "id", 10, 4).count() == 10
    assert arrays.row_slices(spark.range(10), "id", 10, 4, truncate=True).count() == 8


def test_policies_and_callbacks(spark):
    assert rows(balance.decide(loads(spark, [0, 0, 10, 20]))) == [(2, 1, 5), (3, 0, 10)]
    assert rows(balance.decide(loads(spark, [0, 0]), lambda x: x.select("rank"))) == [(0,), (1,)]
    df, seen = with_callback(spark.range(7), "done", F.count(F.lit(1)).alias("n"))
    df.collect()
    assert seen.get == {"n": 7}
