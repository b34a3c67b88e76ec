"""Queries over load balancing decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattix.operators import arrays, balance
from lattix.plans.lineage import table
from lattix.plans.registry import query

_LOADS = "SELECT l_suppkey % 8 AS rank, count(*) AS load FROM lineitem WHERE l_quantity < 10 + (l_suppkey % 8) * 4 GROUP BY 1"


def _loads(spark, sf):
    """Tasks of eight ranks, made uneven by a predicate."""
    lines = table(spark, sf, "lineitem").filter("l_quantity < 10 + (l_suppkey % 8) * 4")
    return lines.groupBy((F.col("l_suppkey") % 8).alias("rank")).agg(F.count("*").alias("load"))


@query(
    """SELECT l_suppkey AS rank, count(*) FILTER (WHERE l_returnflag = 'N') + count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F')
              + count(*) FILTER (WHERE l_returnflag = 'R') AS load FROM lineitem GROUP BY 1"""
)
def load_default(spark, sf):
    flag = F.col("l_returnflag")
    return balance.default_load(table(spark, sf, "lineitem"), "l_suppkey", flag == "N", (flag == "A") & (F.col("l_linestatus") == "F"), flag == "R")


@query(
    f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY load, rank) - 1 AS pos, count(*) OVER () AS n, min(load) OVER () AS lo, max(load) OVER () AS hi FROM ({_LOADS}))
        SELECT s.rank AS from_rank, o.rank AS to_rank, greatest(1, floor((s.load - o.load) * 0.5))::BIGINT AS n_tasks
        FROM s JOIN s o ON o.pos = s.n - s.pos - 1
        WHERE s.load - s.lo >= 2 AND (s.hi - s.lo) / s.hi >= 0.05 AND s.pos >= s.n // 2 AND s.load - o.load >= 2 AND (s.load - o.load) / s.load >= 0.05"""
)
def migrate_default(spark, sf):
    return balance.migrate_default(_loads(spark, sf))


@query(
    f"""WITH m AS (SELECT rank, load, floor(sum(load) OVER () / count(*) OVER ()) AS mean FROM ({_LOADS})),
        g AS (SELECT rank AS from_rank, load - mean AS a, sum(load - mean) OVER (ORDER BY rank) AS hi FROM m WHERE load > mean),
        t AS (SELECT rank AS to_rank, mean - load AS a, sum(mean - load) OVER (ORDER BY rank) AS hi FROM m WHERE load < mean)
        SELECT from_rank, to_rank, (least(g.hi, t.hi) - greatest(g.hi - g.a, t.hi - t.a))::BIGINT AS n_tasks
        FROM g JOIN t ON g.hi - g.a < t.hi AND t.hi - t.a < g.hi"""
)
def migrate_aggressive(spark, sf):
    return balance.migrate_aggressive(_loads(spark, sf))


@query(
    """SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_orderkey % 2 = 0 AND b.o_orderkey % 2 = 1
       AND a.o_orderkey * 10 < b.o_orderkey * 10 + 5 + (b.o_totalprice::BIGINT) % 60 AND b.o_orderkey * 10 < a.o_orderkey * 10 + 5 + (a.o_totalprice::BIGINT) % 90"""
)
def interval_sweep(spark, sf):
    """Tasks of two kinds that run at the same time: both kinds' intervals overlap among themselves too."""
    start = F.col("o_orderkey") * 10
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), start.alias("lo"), F.round("o_totalprice").cast("bigint").alias("p"))
    even = orders.filter("id % 2 = 0").select("id", "lo", (F.col("lo") + 5 + F.col("p") % 90).alias("hi"))
    odd = orders.filter("id % 2 = 1").select("id", "lo", (F.col("lo") + 5 + F.col("p") % 60).alias("hi"))
    return balance.overlap_join(even, odd)


@query(
    f"""WITH l AS (SELECT rank, floor(load * 0.1 / 2)::BIGINT AS n_tasks, count(*) OVER () AS n FROM ({_LOADS}))
        SELECT DISTINCT rank AS from_rank, (rank + d + n) % n AS to_rank, n_tasks FROM l, (VALUES (-1), (1)) v(d) WHERE n > 1 AND n_tasks > 0"""
)
def replicate_ring(spark, sf):
    return balance.replicate_ring(_loads(spark, sf))


@query("SELECT a.n_nationkey, a.n_name, b.n_name AS received FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey - 2 + 25) % 25")
def ring_shift(spark, sf):
    return balance.ring_shift(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", "n_name", 25, 2)


@query("SELECT s_nationkey, s_suppkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS index FROM (SELECT DISTINCT s_nationkey, s_suppkey FROM supplier)")
def team_index(spark, sf):
    return balance.team_index(table(spark, sf, "supplier"), "s_nationkey", "s_suppkey")


@query("SELECT n_nationkey, (n_nationkey // 7)::BIGINT AS part FROM nation")
def split_world(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", balance.split_world(F.col("n_nationkey"), 25, 4).alias("part"))


@query(
    """SELECT l_suppkey, l_orderkey, l_linenumber FROM (
         SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY l_suppkey) AS q FROM lineitem)
       WHERE q >= 2 AND k <= 1"""
)
def migration_guard(spark, sf):
    from pyspark.sql import Window

    lines = table(spark, sf, "lineitem").withColumn("q", F.count("*").over(Window.partitionBy("l_suppkey")))
    return balance.cap_moves(lines, "l_suppkey", ["l_orderkey", "l_linenumber"], F.col("q")).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def cancel_replicated(spark, sf):
    gone = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return balance.cancel(table(spark, sf, "orders").select("o_orderkey"), gone, "o_orderkey")


@query("SELECT o_orderkey, o_custkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 3)::INT AS plan FROM orders")
def replication_round_robin(spark, sf):
    return balance.round_robin(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", ["o_orderkey"], 3)


@query(f"SELECT rank, (row_number() OVER (ORDER BY md5('3:' || rank), rank) - 1)::INT AS visit FROM ({_LOADS})")
def victim_order(spark, sf):
    return arrays.shuffled(_loads(spark, sf), "rank", seed=3).select("rank", "visit")


@query(
    """SELECT l_suppkey, l_orderkey, l_linenumber, to_rank FROM (
         SELECT *, (l_orderkey + 1) % 8 AS to_rank, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS k FROM (
           SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS q FROM lineitem) WHERE q >= 2 AND l_suppkey % 3 <> 0 AND l_orderkey % 5 = 0)
       WHERE k <= 2"""
)
def migration_guard_chosen(spark, sf):
    """At most two tasks a rank, from ranks whose loads were exchanged, of the tasks that the user chose."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    sizes = lines.groupBy("l_suppkey").agg(F.count("*").alias("q"))
    chosen = lines.filter("l_orderkey % 5 = 0").select("l_orderkey", ((F.col("l_orderkey") + 1) % 8).alias("to_rank")).distinct()
    got = balance.cap_moves(
        lines.join(sizes, "l_suppkey"), "l_suppkey", ["l_orderkey", "l_linenumber"], F.col("q"), cap=2,
        exchanged=F.col("l_suppkey") % 3 != 0, chosen=chosen, task="l_orderkey",
    )
    return got.select("l_suppkey", "l_orderkey", "l_linenumber", "to_rank")


@query(
    f"""SELECT (SELECT min(rank) FROM l WHERE load = (SELECT min(load) FROM l)) AS least_rank, (SELECT min(rank) FROM l WHERE load = (SELECT max(load) FROM l)) AS most_rank
        FROM (SELECT 1) one, (SELECT 1) two""".replace("FROM l ", f"FROM ({_LOADS}) l ").replace("FROM l)", f"FROM ({_LOADS}) l)")
)
def extreme_ranks(spark, sf):
    loads = _loads(spark, sf)
    return loads.agg(F.min_by("rank", F.struct("load", "rank")).alias("least_rank"), F.min_by("rank", F.struct((-F.col("load")).alias("l"), "rank")).alias("most_rank"))
