"""Queries that iterate: stencils, clustering, path simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattix.operators import grid, iterate
from lattix.plans.lineage import table
from lattix.plans.registry import query

_CELLS = "SELECT l_partkey % 64 AS row, l_suppkey % 64 AS col FROM lineitem GROUP BY 1, 2 HAVING count(*) % 2 = 1"


def _board(spark, sf):
    cells = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 64).alias("row"), (F.col("l_suppkey") % 64).alias("col")).agg(F.count("*").alias("n"))
    return cells.filter("n % 2 = 1").select("row", "col")


def _step_sql(source: str) -> str:
    return f"""SELECT row, col FROM (
        SELECT row, col, sum(near) AS near, max(self) AS self FROM (
          SELECT row + a AS row, col + b AS col, 1 AS near, 0 AS self FROM {source}, (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b) WHERE a <> 0 OR b <> 0
          UNION ALL SELECT row, col, 0, 1 FROM {source})
        WHERE row BETWEEN 0 AND 63 AND col BETWEEN 0 AND 63 GROUP BY row, col)
        WHERE near = 3 OR (near = 2 AND self = 1)"""


@query(f"WITH g0 AS ({_CELLS}) {_step_sql('g0')}")
def life2d_step(spark, sf):
    return grid.life2d_step(_board(spark, sf), 64, 64)


@query("WITH g0 AS (" + _CELLS + ")" + "".join(f", g{k} AS ({_step_sql(f'g{k - 1}')})" for k in range(1, 11)) + " SELECT row, col FROM g10")
def life2d_10(spark, sf):
    return grid.life2d(_board(spark, sf), 64, 64, 10, block=16)


def _plane_step_sql(source: str) -> str:
    return f"""SELECT x, y, z FROM (
         SELECT x, y, z, sum(near) AS near, max(self) AS self FROM (
           SELECT x, y + a AS y, (z + b + 16) % 16 AS z, 1 AS near, 0 AS self FROM {source}, (VALUES (-1), (0), (1)) p(a), (VALUES (-1), (0), (1)) q(b) WHERE a <> 0 OR b <> 0
           UNION ALL SELECT x, y, z, 0, 1 FROM {source})
         WHERE y BETWEEN 0 AND 31 GROUP BY x, y, z)
       WHERE near = 3 OR (near = 2 AND self = 1)"""


_PLANES = "SELECT l_linenumber % 4 AS x, l_partkey % 32 AS y, l_suppkey % 16 AS z FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1"


@query(f"WITH g0 AS ({_PLANES})" + "".join(f", g{k} AS ({_plane_step_sql(f'g{k - 1}')})" for k in range(1, 8)) + " SELECT x, y, z FROM g7")
def life3d_7(spark, sf):
    """Seven generations of planes whose z is periodic, in two exchanges."""
    axes = {"x": F.col("l_linenumber") % 4, "y": F.col("l_partkey") % 32, "z": F.col("l_suppkey") % 16}
    cells = table(spark, sf, "lineitem").groupBy(*[c.alias(n) for n, c in axes.items()]).agg(F.count("*").alias("n")).filter("n % 2 = 1")
    return grid.life3d(cells, 16, 32, 7, every=4, block=12)


@query(
    """WITH g AS (SELECT l_linenumber % 4 AS x, l_partkey % 32 AS y, l_suppkey % 16 AS z FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)
       SELECT x, y, z FROM (
         SELECT x, y, z, sum(near) AS near, max(self) AS self FROM (
           SELECT x, y + a AS y, (z + b + 16) % 16 AS z, 1 AS near, 0 AS self FROM g, (VALUES (-1), (0), (1)) p(a), (VALUES (-1), (0), (1)) q(b) WHERE a <> 0 OR b <> 0
           UNION ALL SELECT x, y, z, 0, 1 FROM g)
         WHERE y BETWEEN 0 AND 31 GROUP BY x, y, z)
       WHERE near = 3 OR (near = 2 AND self = 1)"""
)
def life3d_yz(spark, sf):
    axes = {"x": F.col("l_linenumber") % 4, "y": F.col("l_partkey") % 32, "z": F.col("l_suppkey") % 16}
    cells = table(spark, sf, "lineitem").groupBy(*[c.alias(n) for n, c in axes.items()]).agg(F.count("*").alias("n")).filter("n % 2 = 1")
    return grid.life3d_step(cells.select("x", "y", "z"), 16, 32)


@query(f"SELECT row // 16 AS block, count(*) AS alive FROM ({_CELLS}) GROUP BY 1")
def life_block_counts(spark, sf):
    return grid.alive_per_block(_board(spark, sf), "row", 16)


@query(
    f"WITH g AS ({_CELLS}), r AS (SELECT r.range AS row, c.range AS c FROM range(64) r, range(64) c) SELECT r.row, string_agg(CASE WHEN g.col IS NULL THEN '0' ELSE '1' END, '' ORDER BY c) AS line FROM r LEFT JOIN g ON g.row = r.row AND g.col = c GROUP BY r.row"
)
def life2d_board(spark, sf):
    return grid.board_text(_board(spark, sf), 64, 64)


def _points(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"))


def _kmeans_sql(passes: int) -> str:
    start = "(SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS k, x AS cx, y AS cy FROM (SELECT * FROM p ORDER BY c_custkey LIMIT 4))"
    steps = [f"c0 AS {start}"]
    for n in range(1, passes + 1):
        steps.append(
            f"""a{n} AS (SELECT x, y, k FROM (SELECT c_custkey, x, y, k, row_number() OVER (PARTITION BY c_custkey ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), k) AS r
                 FROM p, c{n - 1}) WHERE r = 1),
                c{n} AS (SELECT c.k, coalesce(sum(x), 0) / greatest(count(x), 1) AS cx, coalesce(sum(y), 0) / greatest(count(x), 1) AS cy
                 FROM c{n - 1} c LEFT JOIN a{n} a ON a.k = c.k GROUP BY c.k)"""
        )
    return f"WITH p AS (SELECT c_custkey, round(c_acctbal * 100) AS x, c_nationkey::DOUBLE AS y FROM customer), {', '.join(steps)} SELECT k::INT AS k, round(cx, 3) AS cx, round(cy, 3) AS cy FROM c{passes}"


def _rounded(c):
    return c.select("k", F.round("cx", 3).alias("cx"), F.round("cy", 3).alias("cy"))


@query(_kmeans_sql(3))
def kmeans_m(spark, sf):
    return _rounded(iterate.kmeans(_points(spark, sf), "c_custkey", 4, 3))


@query(_kmeans_sql(4))
def kmeans_m_plus_1(spark, sf):
    return _rounded(iterate.kmeans(_points(spark, sf), "c_custkey", 4, 3 + 1))


@query(
    """WITH RECURSIVE p(vec_id, n, s, z) AS (
         SELECT vec_id, 0, 100.0::DOUBLE, embedding FROM embeddings
         UNION ALL SELECT vec_id, n + 1, CASE WHEN s > 95 THEN s + 0.1::DOUBLE * s * 0.015625::DOUBLE + 0.2::DOUBLE * s * (z[n + 1]::DOUBLE * 0.125::DOUBLE) ELSE s END, z FROM p WHERE n < len(z))
       SELECT vec_id, round(CASE WHEN s > 95 THEN greatest(s - 100, 0) ELSE 0 END * exp(-0.05::DOUBLE), 6) AS payoff FROM p WHERE n = len(z)"""
)
def barrier_option(spark, sf):
    z = F.transform("embedding", lambda x: x.cast("double") * 0.125)
    payoff = iterate.barrier_payoff(z, strike=100, barrier=95, start=100, sigma=0.2, mu=0.1, rate=0.05, dt=0.015625, years=1.0)
    return table(spark, sf, "embeddings").select("vec_id", F.round(payoff, 6).alias("payoff"))


@query(
    """WITH RECURSIVE p(vec_id, n, s, z) AS (
         SELECT vec_id, 0, 100.0::DOUBLE, embedding FROM embeddings
         UNION ALL SELECT vec_id, n + 1, CASE WHEN s > 95 THEN s + 0.1::DOUBLE * s * 0.015625::DOUBLE + 0.2::DOUBLE * s * (z[n + 1]::DOUBLE * 0.125::DOUBLE) ELSE s END, z FROM p WHERE n < len(z))
       SELECT count(*) AS paths, round(avg(CASE WHEN s > 95 THEN greatest(s - 100, 0) ELSE 0 END * exp(-0.05::DOUBLE)), 6) AS price FROM p WHERE n = len(z)"""
)
def barrier_option_price(spark, sf):
    """The option's price: the mean payoff over all paths."""
    z = F.transform("embedding", lambda x: x.cast("double") * 0.125)
    payoff = iterate.barrier_payoff(z, strike=100, barrier=95, start=100, sigma=0.2, mu=0.1, rate=0.05, dt=0.015625, years=1.0)
    return table(spark, sf, "embeddings").agg(F.count("*").alias("paths"), F.round(F.avg(payoff), 6).alias("price"))


@query(
    """WITH RECURSIVE z AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS k, ((round(value * 100)::BIGINT % 201) - 100)::DOUBLE / 800 AS z FROM events),
       p(k, n, s) AS (SELECT k, 0, 100.0::DOUBLE FROM z WHERE k <= (SELECT max(k) FROM z) - 11
         UNION ALL SELECT p.k, n + 1, CASE WHEN s > 95 THEN s + 0.1::DOUBLE * s * 0.015625::DOUBLE + 0.2::DOUBLE * s * z.z ELSE s END FROM p JOIN z ON z.k = p.k + n WHERE n < 12)
       SELECT e.ts, e.event_id, round(CASE WHEN s > 95 THEN greatest(s - 100, 0) ELSE 0 END * exp(-0.05::DOUBLE), 6) AS payoff
       FROM p JOIN z ON z.k = p.k + 11 JOIN events e USING (event_id) WHERE n = 12"""
)
def barrier_overlapping_paths(spark, sf):
    """A price path of twelve normals ends at each event, so that neighbouring paths share eleven of them."""
    z = ((F.round(F.col("value") * 100).cast("bigint") % 201) - 100).cast("double") / 800
    events = table(spark, sf, "events").select("ts", "event_id", z.alias("z"))
    got = iterate.rolling_barrier_payoffs(events, ["ts", "event_id"], "z", 12, strike=100, barrier=95, start=100, sigma=0.2, mu=0.1, rate=0.05, dt=0.015625, years=1.0)
    return got.withColumn("payoff", F.round("payoff", 6))


@query("SELECT l_returnflag, round(sum(round(l_quantity)::BIGINT) * 3.14::DOUBLE, 2) AS total FROM lineitem GROUP BY 1")
def loop_sum(spark, sf):
    """A loop's scaled sum, over a table's rows."""
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.round("l_quantity").cast("bigint")) * 3.14, 2).alias("total"))


@query("SELECT n_nationkey, factorial(least(n_nationkey, 20))::BIGINT AS f FROM nation")
def factorials(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.factorial(F.least("n_nationkey", F.lit(20))).alias("f"))
