"""Queries over keyed state, membership and reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattix.operators import kv, reduce
from lattix.plans.lineage import table
from lattix.plans.registry import query

def _cents():
    return F.round(F.col("value") * 100).cast("bigint")


@query(
    """SELECT event_id, ts, user_id, event_type, value, props FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
       WHERE rn = 1"""
)
def kv_upsert_last(spark, sf):
    return kv.upsert_last(table(spark, sf, "events"), "user_id", ["ts", "event_id"])


@query("SELECT user_id, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY user_id")
def kv_modify_sum(spark, sf):
    return kv.modify(table(spark, sf, "events"), "user_id", n=F.count("*"), cents=F.sum(_cents()))


@query(
    """WITH o AS (SELECT user_id, round(value * 100)::BIGINT AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
                       count(*) OVER (PARTITION BY user_id) AS n FROM events),
       RECURSIVE_F AS (SELECT user_id, list(c ORDER BY k) AS cs FROM o GROUP BY user_id)
       SELECT user_id, list_reduce(list_prepend(0::BIGINT, cs), lambda a, b: (a * 31 + b) % 1000003)::BIGINT AS folded FROM RECURSIVE_F"""
)
def kv_modify_ordered(spark, sf):
    events = table(spark, sf, "events").withColumn("c", _cents())
    return kv.modify_ordered(events, "user_id", "event_id", "c", F.lit(0).cast("bigint"), lambda a, b: (a * 31 + b) % 1000003, "folded")


@query("SELECT o_orderkey, o_custkey, c_name, c_nationkey, c_custkey IS NOT NULL AS found FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def kv_find(spark, sf):
    store = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    return kv.find(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), store, "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def kv_present(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return kv.present(table(spark, sf, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)")
def kv_absent(spark, sf):
    orders = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return kv.absent(table(spark, sf, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


@query(
    """SELECT s_nationkey AS k, 'supplier' AS v FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey < 10)
       UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 10)"""
)
def kv_find_or_insert(spark, sf):
    store = table(spark, sf, "supplier").filter("s_nationkey < 10").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("v")).distinct()
    return kv.find_or_insert(store, table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), "k")


@query(
    """SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM lineitem"""
)
def kv_fetch_add(spark, sf):
    lines = table(spark, sf, "lineitem")
    got = kv.fetch_add(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], F.col("l_quantity").cast("bigint"))
    return got.select("l_orderkey", "l_linenumber", "before")


@query("SELECT l_suppkey, bit_or(l_orderkey) AS bits_or, bit_and(l_orderkey) AS bits_and, bit_xor(l_orderkey) AS bits_xor FROM lineitem GROUP BY l_suppkey")
def bit_fetch_ops(spark, sf):
    return kv.fetch_bits(table(spark, sf, "lineitem"), ["l_suppkey"], F.col("l_orderkey"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def bloom_semijoin(spark, sf):
    parts = table(spark, sf, "part").filter("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return kv.bloom_semi_join(lines, parts, "l_partkey", parts.count())


@query("SELECT p_size < 10 AS member, count(*) AS keys, 0::BIGINT AS refused_members, true AS accepts_few_others FROM part GROUP BY 1")
def bloom_membership(spark, sf):
    """Members are never refused; of the others, fewer than three times the asked share are accepted."""
    parts = table(spark, sf, "part").select("p_partkey", (F.col("p_size") < 10).alias("member"))
    members = parts.filter("member")
    k, buckets = kv.bloom_shape(members.count(), 0.01)
    maybe = kv.bloom_probe(parts, kv.bloom_build(members, "p_partkey", k, buckets), "p_partkey", k, buckets).select("p_partkey", F.lit(1).alias("hit"))
    seen = parts.join(maybe, "p_partkey", "left").groupBy("member").agg(F.count("*").alias("keys"), F.count("hit").alias("hits"))
    refused = F.when(F.col("member"), F.col("keys") - F.col("hits")).otherwise(F.lit(0).cast("bigint"))
    few = F.col("member") | (F.col("hits") < 0.03 * F.col("keys") + 2)
    return seen.select("member", "keys", refused.alias("refused_members"), few.alias("accepts_few_others"))


@query("SELECT count(*) - count(DISTINCT l_partkey) AS repeats, count(*) - count(DISTINCT l_partkey) AS flagged_repeats, true AS few_first_flagged FROM lineitem")
def bloom_insert_flags(spark, sf):
    """An insert of a key that is there is always flagged; of first inserts, fewer than three times the asked share are."""
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    keys = lines.select("l_partkey").distinct().count()
    got = kv.bloom_insert_flags(lines, "l_partkey", ["l_orderkey", "l_linenumber"], *kv.bloom_shape(keys, 0.01))
    by_key = got.groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if("maybe_present").alias("flagged"))
    flagged_first = F.sum(F.when(F.col("flagged") == F.col("n"), 1).otherwise(0))
    return by_key.agg(
        F.sum(F.col("n") - 1).alias("repeats"), F.sum(F.least("flagged", F.col("n") - 1)).alias("flagged_repeats"), (flagged_first < 0.03 * F.count("*") + 2).alias("few_first_flagged")
    )


@query(
    """SELECT l_orderkey, l_linenumber, bit_or(l_partkey) OVER w AS or_before, xor_before, bit_and(l_partkey) OVER w AS and_before, min(l_tax) OVER w AS min_before
       FROM (SELECT *, bit_xor(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_tax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS xor_before FROM lineitem)
       WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_tax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def fetch_ops_before(spark, sf):
    part = F.col("l_partkey")
    got = kv.fetch_before(
        table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_tax"],
        or_before=("or", part), xor_before=("xor", part), and_before=("and", part), min_before=("min", F.col("l_tax")),
    )
    return got.select("l_orderkey", "l_linenumber", "or_before", "xor_before", "and_before", "min_before")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, bit_or(l_partkey) OVER w AS or_before, bit_xor(l_partkey) OVER w AS xor_before, bit_and(l_partkey + 1048576) OVER w AS and_before,
              min(l_extendedprice) OVER w AS min_before, sum(l_quantity::BIGINT) OVER w AS sum_before
       FROM lineitem WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def fetch_ops_one_cell(spark, sf):
    """All rows of the table meet in one cell."""
    part = F.col("l_partkey")
    got = kv.fetch_before(
        table(spark, sf, "lineitem"), [], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"],
        or_before=("or", part), xor_before=("xor", part), and_before=("and", part + 1048576), min_before=("min", F.col("l_extendedprice")), sum_before=("add", F.col("l_quantity")),
    )
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "or_before", "xor_before", "and_before", "min_before", "sum_before")


@query(
    """WITH RECURSIVE t AS (SELECT user_id % 16 AS cell, event_id, event_id % 3 AS old, (event_id + user_id) % 3 AS new,
                                   row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS k FROM events),
       r(cell, k, event_id, seen, swapped, value) AS (
         SELECT cell, k, event_id, 0::BIGINT, old = 0, CASE WHEN old = 0 THEN new ELSE 0 END FROM t WHERE k = 1
         UNION ALL SELECT t.cell, t.k, t.event_id, r.value, t.old = r.value, CASE WHEN t.old = r.value THEN t.new ELSE r.value END FROM r JOIN t ON t.cell = r.cell AND t.k = r.k + 1)
       SELECT cell, event_id, seen, swapped FROM r"""
)
def compare_and_swap(spark, sf):
    events = table(spark, sf, "events").select((F.col("user_id") % 16).alias("cell"), "event_id", (F.col("event_id") % 3).alias("old"), ((F.col("event_id") + F.col("user_id")) % 3).alias("new"))
    return kv.compare_and_swap(events, "cell", "event_id", "old", "new")


@query(
    """WITH RECURSIVE t AS (SELECT event_id, event_id % 64 AS old, (event_id * 7 + user_id) % 64 AS new FROM events),
       s AS (SELECT a.event_id, a.new, b.event_id AS following FROM t a ASOF LEFT JOIN t b ON a.new = b.old AND a.event_id < b.event_id),
       r(event_id, new, following) AS (
         SELECT event_id, new, following FROM s WHERE event_id = (SELECT min(event_id) FROM t WHERE old = 0)
         UNION ALL SELECT s.event_id, s.new, s.following FROM r JOIN s ON s.event_id = r.following)
       SELECT t.event_id, coalesce(p.new, 0)::BIGINT AS seen, q.event_id IS NOT NULL AS swapped
       FROM t ASOF LEFT JOIN r p ON t.event_id > p.event_id LEFT JOIN r q ON q.event_id = t.event_id"""
)
def compare_and_swap_one_cell(spark, sf):
    """All events try one cell, so its attempts are spread over ranges."""
    events = table(spark, sf, "events").select(F.lit(0).alias("cell"), "event_id", (F.col("event_id") % 64).alias("old"), ((F.col("event_id") * 7 + F.col("user_id")) % 64).alias("new"))
    return kv.compare_and_swap(events, "cell", "event_id", "old", "new", group_rows=0).drop("cell")


@query(
    """WITH RECURSIVE c AS (SELECT c_nationkey AS host, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
       r(host, k, c_custkey, slot, slots) AS (
         SELECT host, 0::BIGINT, NULL::BIGINT, NULL::INT, list_transform(range(48), lambda x: NULL::BIGINT) FROM (SELECT DISTINCT host FROM c)
         UNION ALL
         SELECT host, k, c_custkey, slot, CASE WHEN slot IS NULL THEN slots ELSE list_concat(slots[1:slot], [c_custkey], slots[slot + 2:]) END FROM (
           SELECT c.host, c.k, c.c_custkey, r.slots,
                  list_filter(list_transform(range(48), lambda p: ((c.c_custkey + p * p) % 48)::INT), lambda s: r.slots[s + 1] IS NULL OR r.slots[s + 1] = c.c_custkey)[1] AS slot
           FROM r JOIN c ON c.host = r.host AND c.k = r.k + 1))
       SELECT host, c_custkey, slot, slot IS NOT NULL AS accepted FROM r WHERE k > 0"""
)
def kv_bounded_insert(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_nationkey").alias("host"), "c_custkey", F.col("c_custkey").alias("key"))
    return kv.insert_bounded(customer, "host", "c_custkey", "key", 48).drop("key")


@query("SELECT o_orderkey, o_custkey % 8 AS host, ((o_orderkey % 1000) // 125) = o_custkey % 8 AS accepted FROM orders")
def kv_insert_local(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 8).alias("host"))
    return kv.insert_local(orders, "host", F.col("o_orderkey") % 1000, 1000, 8)


@query("SELECT o_custkey % 8 AS host, count(*) AS entries, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def kv_iterate(spark, sf):
    return kv.iterate(table(spark, sf, "orders"), "o_orderkey", F.col("o_custkey") % 8)


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def kv_reference(spark, sf):
    store = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return kv.reference(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), store, "o_custkey").select("o_orderkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, p_name AS host_entry FROM lineitem JOIN part ON l_partkey = p_partkey")
def data_entry_lookup(spark, sf):
    entries = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("host_entry"))
    return kv.lookup_entries(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), entries, "l_partkey").drop("l_partkey")


@query(
    """SELECT event_type, count(*) AS n, min(cents) AS min_value, max(cents) AS max_value, sum(cents)::BIGINT AS sum_value, round(avg(cents), 4) AS mean_value
       FROM (SELECT event_type, round(value * 100)::BIGINT AS cents FROM events) GROUP BY event_type"""
)
def reduce_minmaxavg(spark, sf):
    got = reduce.statistics(table(spark, sf, "events").withColumn("cents", _cents()), F.col("cents"), ["event_type"])
    return got.withColumn("mean_value", F.round("mean_value", 4))


@query(
    """SELECT event_type, count(*) AS samples, round(sum(round(value * 100)::BIGINT) / (1e6 * sum(user_id)), 9) AS mb_per_s
       FROM events WHERE user_id <> 0 GROUP BY event_type"""
)
def rates(spark, sf):
    got = reduce.rates(table(spark, sf, "events"), _cents(), F.col("user_id"), ["event_type"])
    return got.withColumn("mb_per_s", F.round("mb_per_s", 9))


@query("SELECT l_suppkey, count(*) AS tasks, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM lineitem GROUP BY l_suppkey")
def worker_histogram(spark, sf):
    return reduce.histogram(table(spark, sf, "lineitem"), "l_suppkey").withColumn("share", F.round("share", 9))


@query(
    """SELECT l_suppkey % 8 AS worker, round(avg(date_diff('day', o_orderdate, l_shipdate)), 6) AS avg_delay, round(avg(l_linenumber), 6) AS avg_length
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""
)
def task_delays(spark, sf):
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01"))
    tasks = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("worker", F.col("l_suppkey") % 8)
    got = reduce.delays(tasks, day("o_orderdate"), day("l_shipdate"), day("l_shipdate") + F.col("l_linenumber"), ["worker"])
    return got.select("worker", F.round("avg_delay", 6).alias("avg_delay"), F.round("avg_length", 6).alias("avg_length"))


@query(
    """SELECT sum((o_orderstatus = 'O')::BIGINT)::BIGINT AS outstanding, sum((o_orderstatus = 'P')::BIGINT)::BIGINT AS busy,
              sum((o_orderstatus = 'O')::BIGINT) = 0 AND sum((o_orderstatus = 'P')::BIGINT) = 0 AS finished FROM orders"""
)
def termination_check(spark, sf):
    orders = table(spark, sf, "orders")
    return reduce.terminated(orders, (F.col("o_orderstatus") == "O").cast("bigint"), (F.col("o_orderstatus") == "P").cast("bigint"))


@query("SELECT list_reduce(list_prepend(7::BIGINT, list(n_regionkey::BIGINT ORDER BY n_nationkey)), lambda a, b: (a * 10 + b) % 999983)::BIGINT AS folded FROM nation")
def reduce_noncommutative(spark, sf):
    nation = table(spark, sf, "nation").withColumn("v", F.col("n_regionkey").cast("bigint"))
    return reduce.reduce_ordered(nation, "n_nationkey", "v", F.lit(7).cast("bigint"), lambda a, b: (a * 10 + b) % 999983, "folded")


@query(
    """SELECT list_reduce(list_prepend(7::BIGINT, list(l_partkey::BIGINT ORDER BY l_orderkey, l_linenumber, l_partkey)), lambda a, b: (a * 31 + b) % 1000003)::BIGINT AS folded FROM lineitem"""
)
def reduce_noncommutative_ranges(spark, sf):
    """All lines, folded in order: the steps x -> (31 x + v) mod p compose to steps of the same form, so ranges are folded by themselves."""
    step = {"times": F.lit(31).cast("bigint"), "plus": F.col("l_partkey").cast("bigint")}
    whole = reduce.reduce_monoid(table(spark, sf, "lineitem"), [], ["l_orderkey", "l_linenumber", "l_partkey"], step, _affine, {"times": 1, "plus": 0})
    return whole.select(((F.col("times") * 7 + F.col("plus")) % 1000003).alias("folded"))


def _affine(a, b):
    return {"times": a["times"] * b["times"] % 1000003, "plus": (a["plus"] * b["times"] + b["plus"]) % 1000003}


@query("SELECT n_nationkey, n_regionkey, (SELECT sum(n_regionkey)::BIGINT FROM nation) AS total FROM nation")
def all_reduce(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return reduce.all_reduce(nation, F.sum("n_regionkey"), "total")


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS pos, n_nationkey, n_regionkey AS v FROM nation")
def all_gather(spark, sf):
    got = reduce.all_gather(table(spark, sf, "nation").withColumn("v", F.col("n_regionkey")), "n_nationkey", ["v"])
    return got.select(F.posexplode("gathered").alias("pos", "g")).select("pos", "g.n_nationkey", "g.v")


@query("SELECT n_nationkey, (SELECT bool_and(n_regionkey < 5) FROM nation) AS all_known, (SELECT bool_and(n_regionkey < 3) FROM nation) AS all_low FROM nation")
def all_reduce_and(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    known = reduce.all_reduce(nation, F.bool_and(F.col("n_regionkey") < 5), "all_known")
    return reduce.all_reduce(known, F.bool_and(F.col("n_regionkey") < 3), "all_low").drop("n_regionkey")


@query("SELECT l_suppkey % 8 AS worker, count(*) AS tasks, round(count(*) / sum(l_quantity), 9) AS tasks_per_s FROM lineitem GROUP BY 1")
def task_rates(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("worker", F.col("l_suppkey") % 8)
    return reduce.task_rates(lines, F.col("l_quantity"), ["worker"]).withColumn("tasks_per_s", F.round("tasks_per_s", 9))


@query(
    """SELECT l_returnflag, round(100 * sum(l_discount) / sum(l_discount + l_tax + 1), 6) AS steal, round(100 * sum(l_tax) / sum(l_discount + l_tax + 1), 6) AS response,
              round(100 * count(*) / sum(l_discount + l_tax + 1), 6) AS multiply FROM lineitem GROUP BY 1"""
)
def time_shares(spark, sf):
    steal, response, multiply = F.col("l_discount"), F.col("l_tax"), F.lit(1)
    got = reduce.shares(table(spark, sf, "lineitem"), steal + response + multiply, ["l_returnflag"], steal=steal, response=response, multiply=multiply)
    return got.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("steal", "response", "multiply")])


@query("SELECT l_linestatus, round(sum(l_extendedprice) / sum(l_extendedprice * (1 - l_discount)), 8) AS speed_up FROM lineitem GROUP BY 1")
def speed_up(spark, sf):
    price = F.col("l_extendedprice")
    return reduce.speed_up(table(spark, sf, "lineitem"), price, price * (1 - F.col("l_discount")), ["l_linestatus"]).withColumn("speed_up", F.round("speed_up", 8))


@query("SELECT max(abs(l_quantity - 25)) AS max_error FROM lineitem")
def max_abs_error(spark, sf):
    return reduce.max_abs_error(table(spark, sf, "lineitem"), F.col("l_quantity"), F.lit(25))
