"""Queries that run a stream to the end of its input."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattix.plans.lineage import table
from lattix.plans.registry import query
from lattix.streaming import state


BATCHES = 4
#: Rows of one file of the stream.
FILE_ROWS = 1_000_000


def _stream(spark, sf, name, key, columns):
    """The table as a stream of four batches, dealt by a key and written one after the other to a folder that all executors share.

    A batch is as many files as its rows need, written in parallel and read together.
    """
    rows = table(spark, sf, name)
    folder = state.work_folder(spark)
    part = F.pmod(key, F.lit(BATCHES))
    most = rows.groupBy(part).count().agg(F.max("count")).first()[0] or 0
    files = max(1, -(-most // FILE_ROWS))
    for k in range(BATCHES):
        rows.filter(part == k).select(*columns).repartition(files).write.mode("append").parquet(f"{folder}/in")
    return state.file_stream(spark, f"{folder}/in", rows.select(*columns).schema, files)


def _cents():
    return F.round(F.col("value") * 100).cast("bigint").alias("cents")


@query("SELECT user_id, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events GROUP BY user_id")
def stream_state_modify(spark, sf):
    return state.final_state(_stream(spark, sf, "events", F.col("event_id"), ["user_id", _cents()]), "user_id", "cents")


@query("SELECT user_id, bit_xor(event_id) AS state, count(*) AS updates FROM events GROUP BY user_id")
def stream_user_state(spark, sf):
    """State by a user's own function: here a running XOR, which no built-in stream aggregate keeps."""
    return state.user_state(_stream(spark, sf, "events", F.col("event_id"), ["user_id", "event_id"]), "user_id", "event_id", lambda held, v: held ^ v, 0)


@query(
    """SELECT user_id, list_reduce(list_prepend(7::BIGINT, list(event_id ORDER BY ts, event_id)), lambda a, b: (a * 31 + b) % 1000003)::BIGINT AS state, count(*) AS updates
       FROM events GROUP BY user_id"""
)
def stream_ordered_state(spark, sf):
    """A fold that doesn't commute, over updates that arrive out of order."""
    stream = _stream(spark, sf, "events", F.col("event_id"), ["user_id", "event_id", "ts"])
    return state.ordered_state(stream, "user_id", "ts", "event_id", "event_id", lambda held, v: (held * 31 + v) % 1000003, 7, "3650 days")


@query("SELECT event_id, user_id % 8 AS server, event_id * 2 AS answer FROM events")
def stream_requests(spark, sf):
    """A request loop without state: each request is answered by itself."""
    requests = _stream(spark, sf, "events", F.col("event_id"), ["event_id", "user_id"])
    return state.answered(requests, lambda r: r.select("event_id", (F.col("user_id") % 8).alias("server"), (F.col("event_id") * 2).alias("answer")))


@query("SELECT (event_id % 4)::INT AS batch, count(*) AS taken FROM events GROUP BY 1")
def stream_consume(spark, sf):
    """A queue consumed until it is empty, batch by batch."""
    return state.consumed(_stream(spark, sf, "events", F.col("event_id"), ["event_id"]))


_STREAM_LOADS = """SELECT b.range::INT AS batch, l_suppkey % 8 AS rank, sum((l_quantity < 10 + (l_suppkey % 8) * 4)::BIGINT)::BIGINT AS load
                   FROM lineitem, range(4) b WHERE l_orderkey % 4 <= b.range GROUP BY 1, 2"""


@query(
    f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY load, rank) - 1 AS pos, count(*) OVER w AS n, min(load) OVER w AS lo, max(load) OVER w AS hi
                   FROM ({_STREAM_LOADS}) WINDOW w AS (PARTITION BY batch))
        SELECT s.batch, s.rank AS from_rank, o.rank AS to_rank, greatest(1, floor((s.load - o.load) * 0.5))::BIGINT AS n_tasks
        FROM s JOIN s o ON o.batch = s.batch AND o.pos = s.n - s.pos - 1
        WHERE s.load - s.lo >= 2 AND (s.hi - s.lo) / s.hi >= 0.05 AND s.pos >= s.n // 2 AND s.load - o.load >= 2 AND (s.load - o.load) / s.load >= 0.05"""
)
def stream_load_exchange(spark, sf):
    load = F.when(F.col("l_quantity") < 10 + (F.col("l_suppkey") % 8) * 4, 1).otherwise(0).cast("bigint").alias("load")
    return state.load_exchange(_stream(spark, sf, "lineitem", F.col("l_orderkey"), [(F.col("l_suppkey") % 8).alias("rank"), load]), "rank", "load")


@query("SELECT (event_id % 4)::INT AS batch, count(*) AS n, min(round(value * 100)::BIGINT) AS min_value, max(round(value * 100)::BIGINT) AS max_value, sum(round(value * 100)::BIGINT)::BIGINT AS sum_value FROM events GROUP BY 1")
def stream_batch_statistics(spark, sf):
    """Statistics start afresh with each batch."""
    return state.batch_statistics(_stream(spark, sf, "events", F.col("event_id"), [_cents()]), "cents")
