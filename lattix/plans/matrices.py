"""Queries over dense and sparse matrices."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from lattix.functions import blocking, scalar
from lattix.operators import arrays, matrix, sparse, tiles
from lattix.plans.lineage import CachedCopy, table
from lattix.plans.registry import query
from lattix.sources import csr, matrices
from lattix.streaming.state import work_folder

# embeddings as integers (value * 1000, truncated), so that sums are exact in any order
_DENSE = "SELECT vec_id AS i, unnest(range(len(embedding)))::INT AS j, trunc(unnest(embedding)::DOUBLE * 1000)::BIGINT AS v FROM embeddings"
_SPARSE = "SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem GROUP BY 1, 2"


def _dense(spark, sf):
    m = matrix.from_rows(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return matrix.apply(m, lambda v: (v.cast("double") * 1000).cast("bigint"))


def _sparse(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").cast("bigint").alias("v"))
    return lines.groupBy("i", "j").agg(F.sum("v").alias("v"))


def _sparse_columns(spark, sf, row=None):
    """The same, lying by columns: lines are exchanged by their column, and the cells summed where they then are.  ``row``: other rows for the lines."""
    row = F.col("l_partkey") if row is None else row
    lines = table(spark, sf, "lineitem").select(row.alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").cast("bigint").alias("v"))
    return lines.repartition(sparse.sides(spark), "j").groupBy("i", "j").agg(F.sum("v").alias("v"))


@query(f"SELECT i, j, v * 2 + 1 AS v FROM ({_DENSE})")
def dense_apply(spark, sf):
    return matrix.apply(_dense(spark, sf), lambda v: v * 2 + 1)


@query(f"SELECT i, j, v + i * 100 + j AS v FROM ({_DENSE})")
def dense_apply_by_index(spark, sf):
    return matrix.apply_by_index(_dense(spark, sf), lambda i, j, v: v + i * 100 + j)


@query(f"SELECT i, j, 3 AS v FROM ({_DENSE})")
def dense_fill(spark, sf):
    return matrix.fill(_dense(spark, sf), 3)


@query(f"SELECT i, len(v) AS cells, v[1] AS first_cell, v[len(v)] AS last_cell, list_sum(v)::BIGINT AS total FROM (SELECT i, list(v ORDER BY j) AS v FROM ({_DENSE}) GROUP BY i)")
def dense_rows(spark, sf):
    width = table(spark, sf, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    got = matrix.to_rows(_dense(spark, sf), width)
    total = F.aggregate("row", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return got.select("i", F.size("row").cast("bigint").alias("cells"), F.get("row", F.lit(0)).alias("first_cell"), F.element_at("row", -1).alias("last_cell"), total.alias("total"))


@query(
    f"""SELECT i, j, a.v + b.v AS plus, a.v * b.v AS times, CASE WHEN b.v <> 0 THEN round(a.v / b.v, 6) END AS quotient,
               CASE WHEN b.v <> 0 THEN 'finite' WHEN a.v > 0 THEN 'inf' WHEN a.v < 0 THEN '-inf' ELSE 'nan' END AS kind
        FROM ({_DENSE}) a JOIN (SELECT i, j, v % 7 AS v FROM ({_DENSE})) b USING (i, j)"""
)
def dense_arithmetic(spark, sf):
    """Sum, Hadamard product and quotient (by zero as IEEE doubles do) of two matrices of one shape."""
    a = _dense(spark, sf)
    b = matrix.apply(a, lambda v: v % 7)
    shape = (table(spark, sf, "embeddings").count(), 0)
    cells = matrix.binary(a, b, lambda x, y: F.struct((x + y).alias("plus"), (x * y).alias("times"), matrix.ieee_divide(x, y).alias("q")), shapes=(shape, shape))
    q = F.col("v.q")
    finite = ~F.isnan(q) & (F.abs(q) != float("inf"))
    kind = F.when(finite, "finite").when(F.isnan(q), "nan").when(q > 0, "inf").otherwise("-inf")
    return cells.select("i", "j", "v.plus", "v.times", F.when(finite, F.round(q, 6)).alias("quotient"), kind.alias("kind"))


@query(f"SELECT a.i, a.j, a.v - b.v AS v FROM ({_DENSE}) a JOIN (SELECT i + 1 AS i, j, v FROM ({_DENSE})) b USING (i, j)")
def dense_binary_op(spark, sf):
    a = _dense(spark, sf)
    return matrix.binary(a, matrix.shifted(a, 1, 0), lambda x, y: x - y)


@query(f"SELECT j AS i, i AS j, v FROM ({_DENSE})")
def dense_transpose(spark, sf):
    return matrix.transpose(_dense(spark, sf))


@query(f"SELECT i - 10 AS i, j - 5 AS j, v FROM ({_DENSE}) WHERE i >= 10 AND i < 40 AND j >= 5 AND j < 500")
def dense_slice(spark, sf):
    return matrix.sub_matrix(_dense(spark, sf), 10, 40, 5, 500)


# products of a table's transpose with itself: all rows are multiplied, and the result is as large as a row squared
_GRAM = f"SELECT a.j AS i, b.j, sum(a.v * b.v)::BIGINT AS v FROM ({_DENSE}) a JOIN ({_DENSE}) b USING (i) GROUP BY a.j, b.j"


@query(_GRAM)
def dense_gemm(spark, sf):
    a = _dense(spark, sf)
    n = table(spark, sf, "embeddings").count()
    width = table(spark, sf, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    return tiles.gemm(matrix.transpose(a), a, ((width, n), (n, width)), layers=2)


@query(_GRAM)
def dense_gemm_cells(spark, sf):
    """The same by a join of cells."""
    a = _dense(spark, sf)
    return matrix.gemm(matrix.transpose(a), a)


@query(f"SELECT a.i, b.i AS j, sum(a.v * b.v)::BIGINT AS v FROM ({_DENSE}) a JOIN ({_DENSE}) b USING (j) WHERE b.i < 64 GROUP BY a.i, b.i")
def dense_gemm_grid(spark, sf):
    """All vectors against a batch of 64, on a grid of tiles."""
    a = _dense(spark, sf)
    n = table(spark, sf, "embeddings").count()
    width = table(spark, sf, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    return tiles.gemm(a, matrix.transpose(a.filter("i < 64")), ((n, width), (width, 64)), tile=32)


@query(f"SELECT i, j, v FROM ({_DENSE}) UNION ALL SELECT i, (j + 64)::INT, v * 2 FROM ({_DENSE})")
def append_columns(spark, sf):
    a = _dense(spark, sf)
    return matrix.append_columns(a, matrix.apply(a, lambda v: v * 2), 64)


@query(_GRAM)
def dense_split_gemm(spark, sf):
    a = _dense(spark, sf)
    return matrix.split_gemm(matrix.transpose(a), a, 4)


@query(f"SELECT i, j, CASE WHEN j = 0 THEN 7 ELSE v END AS v FROM ({_DENSE})")
def matrix_assign(spark, sf):
    m = _dense(spark, sf)
    return matrix.assign(m, m.filter("j = 0").select("i", "j", F.lit(7).cast("bigint").alias("v")))


def _tiled(spark, sf):
    """The sparse matrix in a folder a tile."""
    folder = work_folder(spark)
    matrices.write_tiles(_sparse(spark, sf), f"{folder}/tiles", 100, 25)
    return matrices.read_tiles(spark, f"{folder}/tiles").select("i", "j", "v", F.col("bi").cast("bigint").alias("bi"), F.col("bj").cast("bigint").alias("bj"))


@query(f"SELECT i, j, v FROM ({_SPARSE}) WHERE i // 100 = 1 AND j // 25 = 2")
def tile_get(spark, sf):
    return matrix.tile(_tiled(spark, sf), 1, 2).select("i", "j", "v")


@query(f"SELECT i, j, v FROM ({_SPARSE}) WHERE i = 142")
def tile_row_get(spark, sf):
    return matrix.tile_row(_tiled(spark, sf), 100, 142).select("i", "j", "v")


@query(f"SELECT i, j, v FROM ({_SPARSE}) WHERE i = (SELECT min(i) FROM ({_SPARSE})) AND j = (SELECT min(j) FROM ({_SPARSE}) WHERE i = (SELECT min(i) FROM ({_SPARSE})))")
def element_get(spark, sf):
    tiles = _tiled(spark, sf)
    first = tiles.agg(F.min(F.struct("i", "j")).alias("p")).first()["p"]
    return matrix.element(tiles, 100, 25, first["i"], first["j"]).select("i", "j", "v")


@query(f"SELECT i, j, v FROM ({_SPARSE}) WHERE NOT (i // 100 = 1 AND j // 25 = 2) UNION ALL SELECT i, j, v * 10 FROM ({_SPARSE}) WHERE i // 100 = 1 AND j // 25 = 2 AND i % 2 = 0")
def sparse_assign_tile(spark, sf):
    tiles = matrix.with_tiles(_sparse(spark, sf), 100, 25)
    new = matrix.tile(tiles, 1, 2).filter("i % 2 = 0").withColumn("v", F.col("v") * 10)
    return matrix.assign_tile(tiles, new, 1, 2).select("i", "j", "v")


@query(f"SELECT j, i, v FROM ({_SPARSE})")
def column_major(spark, sf):
    return matrix.column_major(_sparse(spark, sf))


@query("SELECT p_partkey, p_size < 25 AND 15 < p_size + 5 AS meets FROM part")
def interval_overlap(spark, sf):
    part = table(spark, sf, "part")
    return part.select("p_partkey", matrix.overlaps(F.col("p_size"), F.col("p_size") + 5, F.lit(15), F.lit(25)).alias("meets"))


def _sparse_gram(times: str, where: str = "true") -> str:
    return f"SELECT a.j AS i, b.j, {times} AS v FROM ({_SPARSE}) a JOIN ({_SPARSE}) b ON a.i = b.i WHERE {where} GROUP BY a.j, b.j"


@query(_sparse_gram("sum(a.v * b.v)::BIGINT"))
def sparse_gemm_plus_times(spark, sf):
    a = _sparse_columns(spark, sf)
    return sparse.gemm_packs(matrix.transpose(a), a, lying=True)


@query(_sparse_gram("min(a.v + b.v)"))
def sparse_gemm_min_plus(spark, sf):
    a = _sparse_columns(spark, sf)
    return sparse.gemm_packs(matrix.transpose(a), a, "min_plus", lying=True)


@query(
    f"""WITH s AS (SELECT CASE WHEN i % 3 = 0 THEN 0 ELSE i END AS i, j, sum(v)::BIGINT AS v FROM ({_SPARSE}) GROUP BY 1, 2), h AS (SELECT i, j, v FROM ({_SPARSE}))
        SELECT a.j AS i, b.j, max(a.v * b.v) AS v FROM s a JOIN s b ON a.i = b.i GROUP BY a.j, b.j"""
)
def sparse_gemm_hot_index(spark, sf):
    """A third of the rows share one inner index, whose cells lie in all stripes of columns."""
    hot = _sparse_columns(spark, sf, F.when(F.col("l_partkey") % 3 == 0, 0).otherwise(F.col("l_partkey")))  # sums of cells are sums of their lines
    return sparse.gemm_packs(matrix.transpose(hot), hot, "max_times", lying=True)


@query(_sparse_gram("true", "a.v > 40 AND b.v > 40"))
def sparse_gemm_or_and(spark, sf):
    a = matrix.apply(_sparse_columns(spark, sf), lambda v: v > 40).filter("v")  # false cells make no true one
    return sparse.gemm_packs(matrix.transpose(a), a, "or_and", lying=True)


@query(_sparse_gram("max(least(a.v, b.v))"))
def sparse_gemm_user_semiring(spark, sf):
    """The widest path of two steps: a semiring that the user gives as (multiply, add)."""
    a = _sparse_columns(spark, sf)
    return sparse.gemm_packs(matrix.transpose(a), a, (np.minimum, np.maximum), lying=True)


@query(f"SELECT i, j, sum(v)::BIGINT AS v FROM (SELECT i, j, v FROM ({_SPARSE}) UNION ALL SELECT i + 1, j, v FROM ({_SPARSE})) GROUP BY i, j")
def sparse_add(spark, sf):
    a = _sparse(spark, sf)
    return matrix.add(a, matrix.shifted(a, 1, 0))


@query(f"SELECT count(*) AS nnz, sum(v)::BIGINT AS sum_values, sum(j)::BIGINT AS sum_indices FROM ({_SPARSE})")
def sparse_stats(spark, sf):
    return matrix.stats(_sparse(spark, sf))


@query(
    f"""WITH n AS (SELECT i, count(*) AS c FROM ({_SPARSE}) GROUP BY i), k AS (SELECT p_partkey FROM part UNION ALL SELECT p_partkey + 1000000000 FROM part),
        r AS (SELECT p_partkey AS i, coalesce(c, 0) AS cells FROM k LEFT JOIN n ON i = p_partkey)
        SELECT i, cells, coalesce(sum(cells) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_start FROM r"""
)
def sparse_rowptr(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("i"))
    empty_rows = rows.select((F.col("i") + 1_000_000_000).alias("i"))
    return matrix.row_pointers(_sparse(spark, sf), rows.union(empty_rows))


@query(f"SELECT i, j, v FROM ({_SPARSE})")
def sparse_coo_sorted(spark, sf):
    return matrix.sorted_coo(_sparse(spark, sf))


@query("SELECT count(*) FILTER (WHERE n > 0 AND (i >= 1500 OR j >= 90)) AS out_of_range, sum(n - 1)::BIGINT AS repeated FROM (SELECT l_partkey AS i, l_suppkey AS j, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def sparse_verify(spark, sf):
    """Faults of an ill-formed matrix: cells beyond 1,500 rows and 90 columns, and cells given more than once."""
    cells = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"))
    return matrix.is_valid_csr(cells, 1500, 90)


@query(f"SELECT i // 100 AS bi, j // 25 AS bj, count(*) AS nnz FROM ({_SPARSE}) GROUP BY 1, 2")
def matrix_blocking(spark, sf):
    return matrix.with_tiles(_sparse(spark, sf), 100, 25).groupBy("bi", "bj").agg(F.count("*").alias("nnz"))


@query("SELECT n_nationkey, (n_nationkey % 2) * 3 + n_regionkey % 3 AS owner, (n_nationkey // 4)::BIGINT AS node, (n_nationkey // 9)::BIGINT AS host, n_nationkey % 9 AS slot FROM nation")
def tile_owners(spark, sf):
    host, slot = blocking.array_owner(F.col("n_nationkey"), 25, 3)
    owner = blocking.tile_owner(F.col("n_nationkey"), F.col("n_regionkey"), 2, 3)
    return table(spark, sf, "nation").select("n_nationkey", owner.alias("owner"), blocking.block_node(F.col("n_nationkey"), 32, 8).alias("node"), host.alias("host"), slot.alias("slot"))


@query(f"SELECT i - 150 AS i, j - 30 AS j, v FROM ({_SPARSE}) WHERE i >= 150 AND i < 420 AND j >= 30 AND j < 90")
def tile_slice_pruned(spark, sf):
    return matrix.tiled_sub_matrix(_tiled(spark, sf), 100, 25, 150, 420, 30, 90)


@query("SELECT l_orderkey, l_linenumber, 2 * l_quantity + l_extendedprice AS y FROM lineitem")
def saxpy(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scalar.saxpy(2.0, F.col("l_quantity"), F.col("l_extendedprice")).alias("y"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * 3.14::DOUBLE AS scaled, trunc(l_extendedprice)::BIGINT * 4 AS times, trunc(l_extendedprice)::BIGINT + 6 AS plus FROM lineitem")
def scale(spark, sf):
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", scalar.scale(F.col("l_quantity"), 3.14).alias("scaled"), scalar.truncated_scale(price, 4).alias("times"), scalar.truncated_shift(price, 6).alias("plus")
    )


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN d <> 0 THEN l_quantity / d END AS value, (d = 0)::INT AS error_code, CASE WHEN d = 0 THEN 'Division by zero' END AS error
       FROM (SELECT *, (l_linenumber - 3)::DOUBLE AS d FROM lineitem)"""
)
def calculator(spark, sf):
    got = scalar.calculator("div", F.col("l_quantity"), (F.col("l_linenumber") - 3).cast("double"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", got.alias("r")).select("l_orderkey", "l_linenumber", "r.*")


@query("SELECT p_partkey AS idx, CASE WHEN p_size < 5 THEN 0::DOUBLE ELSE p_retailprice END AS val FROM part WHERE p_partkey BETWEEN 20 AND 79")
def array_put_get(spark, sf):
    part = table(spark, sf, "part")
    n = part.agg(F.max("p_partkey") + 1).first()[0]
    changed = arrays.put(part.select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("val")), part.filter("p_size < 5").select(F.col("p_partkey").alias("idx"), F.lit(0.0).alias("val")), n)
    return arrays.get_range(changed, 20, 80, n)


@query("SELECT l_orderkey, l_linenumber, l_partkey AS idx, p_retailprice AS val FROM lineitem JOIN part ON l_partkey = p_partkey")
def array_get(spark, sf):
    """Elements of a distributed array, each by its index."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("val"))
    n = part.agg(F.max("idx") + 1).first()[0]
    wanted = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("idx"), "l_orderkey", "l_linenumber")
    return arrays.get(part, wanted, n)


@query("SELECT l_suppkey % 8 AS host, count(*) AS n, 0::BIGINT AS inversions FROM lineitem GROUP BY 1")
def sorted_per_host(spark, sf):
    lines = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 8).alias("host"), "l_orderkey")
    return arrays.inversions(arrays.sort_per_host(lines, "host", ["l_orderkey"]), "host", "l_orderkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def one_work_item(spark, sf):
    return arrays.at_work_item(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", 7)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def preview(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("down"))
    return arrays.preview(orders, ["down", "o_orderkey"], 10).drop("down")


@query("SELECT count(*) AS held, count(*) + 25 AS refreshed FROM nation")
def cached_copy(spark, sf):
    """A copy keeps its rows when the source grows, until it is refreshed."""
    folder = f"{work_folder(spark)}/source"
    nation = table(spark, sf, "nation").select("n_nationkey")
    nation.write.parquet(folder)
    copy = CachedCopy(lambda: spark.read.parquet(folder))
    nation.write.mode("append").parquet(folder)
    held = copy.value.agg(F.count("*").alias("held"))
    return held.crossJoin(copy.refresh().agg(F.count("*").alias("refreshed")))


@query(f"SELECT i, j, v::DOUBLE AS v FROM ({_SPARSE})")
def binary_csr_roundtrip(spark, sf):
    """Written as binary bands of rows, and read back."""
    folder = f"{work_folder(spark)}/csr"
    a = _sparse(spark, sf)
    size = a.agg(F.max("i") + 1, F.max("j") + 1).first()
    matrices.write_binary_csr(a, folder, (size[0], size[1]), band=512)
    return matrices.read_binary_csr(spark, folder)


@query(f"SELECT i, j, v::DOUBLE AS v FROM ({_SPARSE})")
def csr_file_roundtrip(spark, sf):
    """Written as one file by several tasks, and read by several."""
    folder = csr.mounted(work_folder(spark))
    os.makedirs(folder)
    a = _sparse(spark, sf)
    size = a.agg(F.max("i") + 1, F.max("j") + 1).first()
    csr.write_csr(a, f"{folder}/matrix.csr", (size[0], size[1]))
    return csr.read_csr(spark, f"{folder}/matrix.csr", task_cells=10_000)


@query(f"SELECT i, j, v::DOUBLE AS v, i // 100 AS bi, j // 25 AS bj FROM ({_SPARSE})")
def mtx_roundtrip_tiled(spark, sf):
    """Written as MatrixMarket text by several tasks, then loaded by tile."""
    folder = work_folder(spark)
    a = _sparse(spark, sf)
    size = a.agg(F.max("i") + 1, F.max("j") + 1).first()
    matrices.write_mtx(a, f"{folder}/mtx", size[0], size[1])
    got = matrices.load_tiled(spark, f"{folder}/mtx", f"{folder}/tiles", 100, 25)
    return got.select("i", "j", "v", F.col("bi").cast("bigint").alias("bi"), F.col("bj").cast("bigint").alias("bj"))


@query(f"SELECT i // (n // 7) AS rank, count(*) AS cells FROM ({_DENSE}), (SELECT count(*) AS n FROM embeddings) WHERE i < n // 7 * 7 GROUP BY 1")
def row_slices(spark, sf):
    """Rows in seven equal slices; those that do not fill one are left out."""
    n = table(spark, sf, "embeddings").count()
    return arrays.row_slices(_dense(spark, sf), "i", n, 7, truncate=True).groupBy("rank").agg(F.count("*").alias("cells"))


@query(f"SELECT bi, bj, CASE WHEN bi = 0 THEN 7 ELSE (bi % 2) * 2 + bj % 2 END AS host, nnz FROM (SELECT i // 100 AS bi, j // 25 AS bj, count(*) AS nnz FROM ({_SPARSE}) GROUP BY 1, 2)")
def tile_rehome(spark, sf):
    tiles = matrix.with_tiles(_sparse(spark, sf), 100, 25).groupBy("bi", "bj").agg(F.count("*").alias("nnz"))
    placed = tiles.withColumn("host", blocking.tile_owner(F.col("bi"), F.col("bj"), 2, 2))
    return arrays.rehome(placed, tiles.filter("bi = 0").select("bi", "bj", F.lit(7).cast("bigint").alias("new_host")), ["bi", "bj"])


@query("SELECT label, sum(len(embedding))::BIGINT AS n, (SELECT trunc(e2.embedding[1]::DOUBLE * 1000)::BIGINT FROM embeddings e2 WHERE e2.label = e.label ORDER BY vec_id LIMIT 1) AS first_value FROM embeddings e GROUP BY label")
def gather_rows(spark, sf):
    got = arrays.gather_rows(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return got.select("label", F.size("flat").cast("bigint").alias("n"), (F.get("flat", F.lit(0)).cast("double") * 1000).cast("bigint").alias("first_value"))


@query("SELECT vec_id, (row_number() OVER (ORDER BY embedding[1], embedding[3], embedding[2], embedding[4], vec_id) - 1)::INT AS pos FROM embeddings")
def order_interleaved(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("a"), F.slice("embedding", 3, 2).alias("b"))
    return arrays.global_positions(rows, F.struct(arrays.interleaved("a", "b"), "vec_id")).select("vec_id", "pos")
