"""Queries over queues, redistribution, stealing and task ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattix.operators import iterate, queues, tasks
from lattix.plans.lineage import table
from lattix.plans.registry import query

_EVENTS = "SELECT event_id, ts, (user_id % 8) AS host, round(value * 100)::BIGINT AS cents FROM events"
_FIFO = f"SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY host) AS size FROM ({_EVENTS})"
ORDER = ["ts", "event_id"]


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", (F.col("user_id") % 8).alias("host"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))


@query("SELECT l_partkey % 8 AS host, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS total FROM lineitem GROUP BY 1")
def distribute_many_to_many(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", F.col("l_quantity").cast("bigint").alias("q"))
    return queues.distribute(rows, F.pmod("l_partkey", F.lit(8)), 8).groupBy("host").agg(F.count("*").alias("n"), F.sum("q").alias("total"))


@query(f"SELECT event_id, host, pos::INT AS pos FROM ({_FIFO})")
def queue_fifo(spark, sf):
    return queues.fifo(_events(spark, sf), "host", ORDER).select("event_id", "host", "pos")


@query(f"SELECT host, count(*) FILTER (WHERE pos < 50) AS accepted, count(*) FILTER (WHERE pos >= 50) AS refused FROM ({_FIFO}) GROUP BY host")
def queue_bounded_push(spark, sf):
    got = queues.push_bounded(_events(spark, sf), "host", ORDER, 50)
    return got.groupBy("host").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))


@query(f"SELECT event_id, host, cents FROM ({_FIFO}) WHERE pos < 5")
def queue_pop_n(spark, sf):
    return queues.pop_first(_events(spark, sf), "host", ORDER, 5).select("event_id", "host", "cents")


@query(f"SELECT event_id, host FROM ({_FIFO}) WHERE pos < 1200 AND size >= 1200")
def queue_pop_batch(spark, sf):
    return queues.pop_batch(_events(spark, sf), "host", ORDER, 1200).select("event_id", "host")


@query("SELECT user_id % 8 AS host, count(*) FILTER (WHERE event_type <> 'click') - count(*) FILTER (WHERE event_type = 'click') AS size FROM events GROUP BY 1")
def queue_size(spark, sf):
    events = table(spark, sf, "events").withColumn("host", F.col("user_id") % 8)
    return queues.size_after(events, "host", F.col("event_type") != "click", F.col("event_type") == "click")


@query(f"SELECT host, list_sum(list(cents ORDER BY event_id)[1:10])::BIGINT AS first_ten, count(*)::INT AS items FROM ({_EVENTS}) GROUP BY host")
def queue_snapshot(spark, sf):
    got = queues.snapshot(_events(spark, sf), "host", "event_id", "cents")
    return got.select("host", F.aggregate(F.slice("items", 1, 10), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("first_ten"), F.size("items").alias("items"))


@query(
    f"""SELECT host, CASE WHEN NOT bool_or(event_id % 4000 = 0) THEN list_sum(list(cents ORDER BY event_id)[1:10])::BIGINT END AS first_ten, bool_or(event_id % 4000 = 0) AS refused
        FROM ({_EVENTS}) GROUP BY host"""
)
def queue_snapshot_heads(spark, sf):
    """A queue whose head has moved, as rows were popped, can't be taken as an array."""
    got = queues.snapshot(_events(spark, sf), "host", "event_id", "cents", popped=F.col("event_id") % 4000 == 0)
    return got.select("host", F.aggregate(F.slice("items", 1, 10), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("first_ten"), "refused")


@query(f"SELECT event_id, host, CASE WHEN pos < 1250 THEN pos::INT END AS slot, size <= 1250 AS fits FROM ({_FIFO})")
def queue_resize(spark, sf):
    return queues.resize(_events(spark, sf), "host", ORDER, 1250).select("event_id", "host", "slot", "fits")


@query(f"SELECT event_id, host, (pos // 200)::INT AS round FROM ({_FIFO})")
def queue_push_in_rounds(spark, sf):
    return queues.push_in_rounds(_events(spark, sf), "host", ORDER, 200).select("event_id", "host", "round")


@query(
    """SELECT event_id // 100 AS phase, count(*) FILTER (WHERE event_type <> 'click') AS pushes, count(*) FILTER (WHERE event_type = 'click') AS pops,
              count(*) FILTER (WHERE event_type <> 'click') = 0 OR count(*) FILTER (WHERE event_type = 'click') = 0 AS valid FROM events GROUP BY 1"""
)
def queue_phases(spark, sf):
    events = table(spark, sf, "events").withColumn("phase", F.floor(F.col("event_id") / 100))
    return queues.phases(events, "phase", F.col("event_type") != "click", F.col("event_type") == "click")


@query(f"SELECT host, count(*) AS valid FROM ({_FIFO}) WHERE (pos // 100) % 2 = 1 GROUP BY host")
def queue_checksum_wraps(spark, sf):
    """Of a ring of 100 slots that is read on an odd turn, values of even turns are not valid."""
    placed = queues.fifo(_events(spark, sf), "host", ORDER).withColumn("turn", F.floor(F.col("pos") / 100))
    written = queues.checksummed(placed, ["event_id", "cents"], F.col("turn"))
    return queues.valid(written, ["event_id", "cents"], F.lit(1)).groupBy("host").agg(F.count("*").alias("valid"))


@query(
    f"""SELECT event_id, host, (row_number() OVER (PARTITION BY host ORDER BY ts, event_id) - 1)::INT AS pos
        FROM (SELECT event_id, ts, CASE WHEN host = 3 THEN 0 ELSE host END AS host FROM ({_EVENTS}))"""
)
def queue_migrate(spark, sf):
    return queues.fifo(queues.migrate(_events(spark, sf), "host", 3, 0), "host", ORDER).select("event_id", "host", "pos")


@query(f"SELECT host, count(*) AS valid FROM ({_EVENTS}) WHERE event_id % 10 <> 0 GROUP BY host")
def queue_checksum(spark, sf):
    pushed = queues.checksummed(_events(spark, sf), ["event_id", "cents"])
    broken = pushed.withColumn("cents", F.when(F.col("event_id") % 10 == 0, F.col("cents") + 1).otherwise(F.col("cents")))
    return queues.valid(broken, ["event_id", "cents"]).groupBy("host").agg(F.count("*").alias("valid"))


# each part is inserted after another one: mostly after its predecessor (nested deeply), every fifth after one of a few (many children)
_INSERTS = """SELECT p_partkey AS node, CASE WHEN p_partkey = (SELECT min(p_partkey) FROM part) THEN NULL
                WHEN p_partkey % 5 = 1 THEN greatest(p_partkey - p_partkey % 500, (SELECT min(p_partkey) FROM part)) ELSE p_partkey - 1 END AS after FROM part"""


@query(
    f"""WITH RECURSIVE i AS ({_INSERTS}), t(node, path) AS (
          SELECT node, [-node] FROM i WHERE after IS NULL
          UNION ALL SELECT i.node, list_append(path, -i.node) FROM t JOIN i ON i.after = t.node AND i.node <> t.node)
        SELECT node, row_number() OVER (ORDER BY path) - 1 AS pos FROM t"""
)
def queue_insert_after(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    least = part.agg(F.min("node")).first()[0]
    key = F.col("node")
    after = F.when(key == least, F.lit(None)).when(key % 5 == 1, F.greatest(key - key % 500, F.lit(least))).otherwise(key - 1)
    return queues.list_order(part.withColumn("after", after.cast("bigint")), "node", "after", "node")


def _replay_sql(host: str) -> str:
    return f"""WITH RECURSIVE o AS (SELECT {host} AS host, event_id, event_type NOT IN ('click', 'error') AS push, row_number() OVER (PARTITION BY {host} ORDER BY ts, event_id) AS k FROM events),
       r(host, k, event_id, push, size_before, accepted, size) AS (
         SELECT host, k, event_id, push, 0::BIGINT, push, push::BIGINT FROM o WHERE k = 1
         UNION ALL SELECT o.host, o.k, o.event_id, o.push, r.size, CASE WHEN o.push THEN r.size < 20 ELSE r.size > 0 END,
                          CASE WHEN o.push THEN least(r.size + 1, 20) ELSE greatest(r.size - 1, 0) END FROM r JOIN o ON o.host = r.host AND o.k = r.k + 1),
       n AS (SELECT *, count(*) FILTER (WHERE accepted AND push) OVER (PARTITION BY host ORDER BY k) AS pushes, count(*) FILTER (WHERE accepted AND NOT push) OVER (PARTITION BY host ORDER BY k) AS pops FROM r)
       SELECT n.event_id, n.host, n.size_before, n.accepted, g.event_id AS popped
       FROM n LEFT JOIN n g ON g.push AND g.accepted AND NOT n.push AND n.accepted AND g.host = n.host AND g.pushes = n.pops"""


def _replayed(spark, sf, host):
    ops = table(spark, sf, "events").select("event_id", "ts", host.alias("host"), "event_type")
    got = queues.replay_bounded(ops, "host", ["ts", "event_id"], ~F.col("event_type").isin("click", "error"), "event_id", 20)
    return got.select("event_id", "host", "size_before", "accepted", "popped")


@query(_replay_sql("user_id % 8"))
def queue_push_pop(spark, sf):
    """Pushes and pops in one order, of queues that are full or empty at times: three of five operations push."""
    return _replayed(spark, sf, F.col("user_id") % 8)


@query(_replay_sql("(user_id % 97 = 0)::BIGINT"))
def queue_push_pop_hot(spark, sf):
    """Nearly all operations are of one host."""
    return _replayed(spark, sf, (F.col("user_id") % 97 == 0).cast("bigint"))


@query(
    """WITH n AS (SELECT count(*) AS c FROM supplier)
       SELECT s_suppkey, (s_suppkey + 1) % 4 = 0 AS is_server, (s_suppkey // 4)::BIGINT AS my_server, (c // 4)::BIGINT AS n_servers,
              ((s_suppkey // 4 + 1) % (c // 4))::BIGINT AS remote_server FROM supplier, n"""
)
def queue_topology(spark, sf):
    supplier = table(spark, sf, "supplier").select("s_suppkey")
    counted = supplier.crossJoin(F.broadcast(supplier.agg(F.count("*").alias("c"))))
    return queues.topology(counted, "s_suppkey", 4, F.col("c")).drop("c")


@query("SELECT o_orderkey, ((o_custkey % 8) << 24) | (o_orderkey % 16777216) AS task, o_custkey % 8 AS owner, o_orderkey % 16777216 AS idx FROM orders")
def task_id_codec(spark, sf):
    orders = table(spark, sf, "orders").withColumn("task", queues.encode_task(F.pmod("o_custkey", F.lit(8)), F.col("o_orderkey") % (1 << 24)))
    return orders.select("o_orderkey", "task", queues.task_owner(F.col("task")).alias("owner"), queues.task_index(F.col("task")).alias("idx"))


@query(
    """SELECT t.o_orderkey AS asked, o.o_orderkey AS fetched FROM
         (SELECT o_orderkey, o_custkey % 8 AS owner, o_orderkey % 16777216 AS idx FROM orders WHERE o_orderstatus = 'P') t
         JOIN orders o ON o.o_custkey % 8 = t.owner AND o.o_orderkey % 16777216 = t.idx"""
)
def task_fetch(spark, sf):
    orders = table(spark, sf, "orders").withColumn("task", queues.encode_task(F.pmod("o_custkey", F.lit(8)), F.col("o_orderkey") % (1 << 24)))
    asked = orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("asked"), queues.task_owner(F.col("task")).alias("owner"), queues.task_index(F.col("task")).alias("idx"))
    stored = orders.select(F.col("o_orderkey").alias("fetched"), queues.task_owner(F.col("task")).alias("owner"), queues.task_index(F.col("task")).alias("idx"))
    return asked.join(stored, ["owner", "idx"]).select("asked", "fetched")


@query(f"SELECT event_id, host FROM ({_FIFO}) WHERE pos < ceil(size * 0.5 / 1.5)")
def steal_half(spark, sf):
    return queues.steal(_events(spark, sf), "host", ORDER).select("event_id", "host")


@query(
    """SELECT o_orderkey, host, (row_number() OVER (PARTITION BY host ORDER BY priority, CASE WHEN priority = 2 THEN -o_orderkey ELSE o_orderkey END) - 1)::INT AS rank
       FROM (SELECT o_orderkey, o_custkey % 8 AS host, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2
                    WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END AS priority FROM orders)"""
)
def priority_schedule(spark, sf):
    names = list(queues.PRIORITIES)
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", names[0]).when(p == "2-HIGH", names[1]).when(p == "3-MEDIUM", names[2]).when(p == "4-NOT SPECIFIED", names[3]).otherwise(names[4])
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 8).alias("host"), kind.alias("kind"))
    return queues.schedule(orders, "host", "kind", "o_orderkey").select("o_orderkey", "host", "rank")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE user_id % 4 = 0) AS b0, count(*) FILTER (WHERE user_id % 4 = 1) AS b1, count(*) FILTER (WHERE user_id % 4 = 2) AS b2, count(*) FILTER (WHERE user_id % 4 = 3) AS b3 FROM events GROUP BY 1")
def who_ran_what(spark, sf):
    events = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat(F.lit("b"), F.col("user_id") % 4).alias("block"))
    return events.groupBy("day").pivot("block", ["b0", "b1", "b2", "b3"]).agg(F.count(F.lit(1))).na.fill(0)


_EDGES = "SELECT DISTINCT p_size AS a, (p_size + 1 + p_partkey % 7)::INT AS b FROM part"


@query(
    f"""WITH RECURSIVE e AS ({_EDGES}), l(node, level) AS (
          SELECT a, 0 FROM e UNION SELECT b, 0 FROM e UNION SELECT e.b, level + 1 FROM l JOIN e ON node = a)
        SELECT node, max(level) AS level FROM l GROUP BY node"""
)
def dag_levels(spark, sf):
    edges = table(spark, sf, "part").select(F.col("p_size").alias("a"), (F.col("p_size") + 1 + F.col("p_partkey") % 7).cast("int").alias("b"))
    return iterate.dag_levels(edges)


@query(
    """WITH old AS (SELECT o_custkey % 8 AS rank, (row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) - 1) AS k FROM orders WHERE o_orderstatus = 'O'),
       lasts AS (SELECT rank, max(k) + 1 AS next FROM old GROUP BY rank)
       SELECT o_orderkey, ((o_custkey % 8) << 24) | (coalesce(next, 0) + row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) - 1) AS task, o_totalprice > 100000 AS finished
       FROM orders LEFT JOIN lasts ON rank = o_custkey % 8 WHERE o_orderstatus <> 'O'"""
)
def task_lifecycle(spark, sf):
    """Tasks are added after those of their rank that exist, and asked whether they are finished."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", (F.col("o_custkey") % 8).alias("rank"))
    none = spark.createDataFrame([], "task bigint")
    old = tasks.create(none, orders.filter("o_orderstatus = 'O'"), "rank", ["o_orderkey"])
    new = tasks.create(old, orders.filter("o_orderstatus <> 'O'"), "rank", ["o_orderkey"])
    return tasks.finished(new, new.filter("o_totalprice > 100000")).select("o_orderkey", "task", "finished")


@query(
    """WITH t AS (SELECT o_custkey % 8 AS rank, ((o_custkey % 8) << 24) | (row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) - 1) AS task FROM orders)
       SELECT rank, max(task) AS last_id FROM t GROUP BY rank"""
)
def task_last_ids(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 8).alias("rank"))
    return tasks.last_ids(tasks.create(spark.createDataFrame([], "task bigint"), orders, "rank", ["o_orderkey"]))
