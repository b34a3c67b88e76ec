"""Partitioned FIFO queues, redistribution, and work stealing as relations.

A queue is rows with a host (or server key) and a total order; positions replace
heads and tails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattix.operators.ordered import positions
from lattix.operators.scans import clamps, in_ranges, latest, scan
from lattix.plans.lineage import durable


def fifo(df: DataFrame, host: str, order: list[str], out: str = "pos") -> DataFrame:
    """Position of each row in its host's queue, from 0, by ranges of the first order column."""
    return positions(df, [host], order, out)


def push_bounded(df: DataFrame, host: str, order: list[str], capacity: int) -> DataFrame:
    """Positions, and whether a queue of ``capacity`` accepts the push (a full one refuses)."""
    return fifo(df, host, order).withColumn("accepted", F.col("pos") < capacity)


def pop_first(df: DataFrame, host: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each queue, fewer if it holds fewer."""
    return fifo(df, host, order).filter(F.col("pos") < n)


def pop_batch(df: DataFrame, host: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each queue that holds at least ``n``; nothing of shorter ones."""
    sized = positions(df, [host], order, "pos", "_size")
    return sized.filter((F.col("_size") >= n) & (F.col("pos") < n)).drop("_size")


def size_after(df: DataFrame, host: str, pushed: Column, popped: Column) -> DataFrame:
    """Size of each queue from its pushes and pops."""
    return df.groupBy(host).agg((F.count(F.when(pushed, 1)) - F.count(F.when(popped, 1))).alias("size"))


def snapshot(df: DataFrame, host: str, order: str, value: str, popped: Column | None = None) -> DataFrame:
    """Each queue as one array, in order (for queues that fit a row).

    ``popped`` tells rows that have left the queue: a queue whose head has moved can't be
    taken as an array, so its items are null and ``refused`` is true.
    """
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
    if popped is None:
        return df.groupBy(host).agg(rows.alias("items"))
    taken = df.groupBy(host).agg(rows.alias("_items"), F.bool_or(F.coalesce(popped, F.lit(False))).alias("refused"))
    return taken.select(host, F.when(~F.col("refused"), F.col("_items")).alias("items"), "refused")


def resize(df: DataFrame, host: str, order: list[str], capacity: int) -> DataFrame:
    """The queues in rings of another capacity: each row's slot, in the old order; rows beyond it do not fit."""
    sized = positions(df, [host], order, "pos", "_size")
    return sized.withColumns({"slot": F.when(F.col("pos") < capacity, F.col("pos")), "fits": F.col("_size") <= capacity}).drop("_size")


def phases(ops: DataFrame, phase: str, pushes: Column, pops: Column) -> DataFrame:
    """Pushes and pops of each phase between two barriers, and whether it keeps to one kind, as a phased queue must."""
    counts = ops.groupBy(phase).agg(F.count_if(pushes).alias("pushes"), F.count_if(pops).alias("pops"))
    return counts.withColumn("valid", (F.col("pushes") == 0) | (F.col("pops") == 0))


def push_in_rounds(df: DataFrame, host: str, order: list[str], capacity: int) -> DataFrame:
    """Buffered pushes to queues of ``capacity`` that are drained between rounds: refused rows try again, in their order."""
    return fifo(df, host, order).withColumn("round", F.floor(F.col("pos") / capacity).cast("int"))


def migrate(df: DataFrame, host: str, source: int, target: int) -> DataFrame:
    """All of one host's queue moved to another; the order columns keep its order."""
    return df.withColumn(host, F.when(F.col(host) == source, F.lit(target)).otherwise(F.col(host)))


def replay_bounded(ops: DataFrame, host: str, order: list[str], push: Column, item: str, capacity: int) -> DataFrame:
    """What becomes of each push and pop of queues that hold ``capacity`` items, in ``order``: the operations with
    ``size_before``, ``accepted`` and, for a pop that finds the queue not empty, the popped ``item`` of type bigint.

    A push changes the size to min(size + 1, capacity), a pop to max(size - 1, 0).  Such
    functions compose to functions of the same form, so the size before each operation is
    a scan over their composition, and a host with most operations is spread over many
    ranges.  As the queue is first in first out, its k-th accepted pop takes the item of the
    k-th accepted push.  A null in ``push`` is a pop.
    """
    push = F.coalesce(push, F.lit(False))
    step = {"add": F.when(push, 1).otherwise(-1).cast("bigint"), "lo": F.lit(0).cast("bigint"), "hi": F.lit(capacity).cast("bigint")}
    most = 1 << 62
    before = scan(in_ranges(ops.withColumn("_push", push), [host, *order]), [host], step, clamps, {"add": 0, "lo": -most, "hi": most})
    size = F.least(F.greatest(F.col("add"), F.col("lo")), F.col("hi"))  # the composed function of an empty queue
    sized = before.withColumn("size_before", size).drop("add", "lo", "hi")
    sized = durable(sized.withColumn("accepted", F.when(F.col("_push"), F.col("size_before") < capacity).otherwise(F.col("size_before") > 0)))
    done = lambda kind: F.when(F.col("accepted") & (F.col("_push") == kind), 1).otherwise(0).cast("bigint")
    add = lambda a, b: {k: a[k] + b[k] for k in a}
    turn = scan(sized, [host], {"_pushes": done(True), "_pops": done(False)}, add, {"_pushes": 0, "_pops": 0})
    turn = turn.withColumn("_turn", F.when(F.col("accepted"), F.when(F.col("_push"), F.col("_pushes")).otherwise(F.col("_pops")))).drop("_pushes", "_pops")
    given = turn.filter("_push AND accepted").select(F.col(host).alias("_host"), F.col("_turn").alias("_number"), F.col(item).cast("bigint").alias("popped"))
    taken = turn.join(given, (~F.col("_push")) & F.col(host).eqNullSafe(F.col("_host")) & (F.col("_turn") == F.col("_number")), "left")
    return taken.drop("_push", "_turn", "_host", "_number")


def list_order(inserts: DataFrame, node: str, after: str, order: str) -> DataFrame:
    """Positions, from 0, in a list that is built by inserting each ``node`` directly after another one: (node, pos).

    ``inserts`` happen by rising ``order``; ``after`` is null for inserts at the list's head.
    Nodes that were inserted after one node form a tree: a node comes before all that were
    inserted after it, the latest first.  A walk around the tree enters and leaves each
    node once; each step's successor is known from the node's latest child, its earlier
    sibling, or its parent.  Pointer doubling ranks the walk: every round adds the count of
    the step that a pointer leads to and doubles its reach, so 2n steps take log2(2n)
    rounds, each one join on unique keys, checkpointed.  Nodes and orders are unique; what
    was inserted after a node that is nowhere inserted doesn't appear.
    """
    rows = inserts.select(F.col(node).alias("node"), F.col(after).alias("parent"), F.col(order).alias("at"))
    # the sibling that was inserted before: the latest earlier row of the same parent
    elder = scan(in_ranges(rows, ["parent", "at"]), ["parent"], {"set": F.lit(1).cast("bigint"), "_elder": F.col("node").cast("bigint")}, latest, {"set": 0, "_elder": 0})
    nodes = durable(elder.select("node", "parent", "at", F.when(F.col("set") == 1, F.col("_elder")).alias("elder")))
    youngest = nodes.groupBy("parent").agg(F.max_by("node", "at").alias("child"))
    enter = lambda c: F.when(c.isNotNull(), c * 2)  # noqa: E731  steps: twice the node to enter it, and one more to leave it
    leave = lambda c: F.when(c.isNotNull(), c * 2 + 1)
    children = youngest.select(F.col("parent").alias("node"), "child").filter("node IS NOT NULL")
    into = nodes.join(children, "node", "left").select(enter(F.col("node")).alias("step"), F.coalesce(enter(F.col("child")), leave(F.col("node"))).alias("next"), F.lit(1).cast("bigint").alias("n"))
    out = nodes.select(leave(F.col("node")).alias("step"), F.coalesce(enter(F.col("elder")), leave(F.col("parent"))).alias("next"), F.lit(0).cast("bigint").alias("n"))
    walk = durable(into.union(out))
    open_steps = walk.filter("next IS NOT NULL").limit(1).count()
    while open_steps:  # n: nodes entered from the step on, before the step that ``next`` leads to
        to = walk.select(F.col("step").alias("next"), F.col("next").alias("_next"), F.col("n").alias("_n"), F.lit(True).alias("_met"))
        moved = walk.filter("next IS NOT NULL").join(to, "next", "left")
        moved = moved.select("step", F.col("_next").alias("next"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.coalesce("_met", F.lit(False)).alias("met"))
        walk = durable(moved.filter("met").drop("met").union(walk.filter("next IS NULL")))
        open_steps = walk.filter("next IS NOT NULL").limit(1).count()
    # from the first step all nodes are entered, from the last node's step one
    total = F.broadcast(walk.agg(F.max("n").alias("_total")))
    return walk.filter("step % 2 = 0").crossJoin(total).select(F.floor(F.col("step") / 2).alias("node"), (F.col("_total") - F.col("n")).alias("pos"))


def distribute(df: DataFrame, host: Column, n: int, name: str = "host") -> DataFrame:
    """All-to-all: each row goes to its host; one shuffle that aggregations by host reuse."""
    return df.withColumn(name, host).repartition(n, name)


def topology(ranks: DataFrame, rank: str, ranks_per_server: int, n_ranks: Column) -> DataFrame:
    """Role of each rank: whether it serves, its server, and the remote server it steals from."""
    servers = F.floor(n_ranks / ranks_per_server)
    mine = F.floor(F.col(rank) / ranks_per_server)
    return ranks.withColumns(
        {
            "is_server": (F.col(rank) + 1) % ranks_per_server == 0,
            "my_server": mine,
            "n_servers": servers,
            "remote_server": (mine + 1) % servers,
        }
    )


def _checksum(columns: list[str], wrap: Column | None) -> Column:
    plain = F.xxhash64(*columns)
    return plain if wrap is None else F.when(wrap % 2 == 1, F.bitwise_not(plain)).otherwise(plain)


def checksummed(df: DataFrame, columns: list[str], wrap: Column | None = None) -> DataFrame:
    """With the checksum of ``columns``; on odd turns (``wrap``) of a ring it is complemented, so that an old value isn't taken for a new one."""
    return df.withColumn("_checksum", _checksum(columns, wrap))


def valid(df: DataFrame, columns: list[str], wrap: Column | None = None) -> DataFrame:
    """Rows whose payload still has its checksum, of the turn that is read."""
    return df.filter(F.col("_checksum") == _checksum(columns, wrap)).drop("_checksum")


def steal(df: DataFrame, host: str, order: list[str], share: float = 0.5) -> DataFrame:
    """The first rows of each victim's queue that a thief takes.

    The thief compares its count with ``share`` of a queue that shrinks by each
    theft, so of s rows it takes ceil(s * share / (1 + share)): a third for one half.
    """
    sized = positions(df, [host], order, "pos", "victim_size")
    return sized.filter(F.col("pos") < F.ceil(F.col("victim_size") * share / (1 + share)))


#: Execution classes in order of priority; replicated local tasks are taken from the back.
PRIORITIES = {"stolen": 0, "local": 1, "replicated_local": 2, "replicated_migrated": 3, "replicated_remote": 4}


def schedule(df: DataFrame, host: str, kind: str, order: str) -> DataFrame:
    """Execution rank of each task on its host, from 0: by class, first in first out, replicated local last in first out."""
    prio = F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv])[F.col(kind)]
    place = F.when(F.col(kind) == "replicated_local", -F.col(order)).otherwise(F.col(order))
    placed = df.withColumns({"priority": prio, "_place": place})
    # each class is a group of its own, which comes after the more urgent ones
    ranked = positions(placed, [host, "priority"], ["_place"], "_rank")
    sizes = placed.groupBy(host, "priority").agg(F.count("*").alias("_n"))
    before = sizes.select(host, "priority", (F.sum("_n").over(Window.partitionBy(host).orderBy("priority")) - F.col("_n")).alias("_urgent"))
    return ranked.join(before, [host, "priority"]).withColumn("rank", (F.col("_rank") + F.col("_urgent")).cast("int")).drop("_place", "_rank", "_urgent")


def encode_task(owner: Column, index: Column) -> Column:
    """One number of the owner and of an index below 2 ** 24; a larger index is an error, as it would name another owner's task."""
    fits = F.when(index.between(0, (1 << 24) - 1), index.cast("bigint")).when(index.isNotNull(), F.raise_error(F.lit("a task's index is beyond 24 bits")).cast("bigint"))
    return F.shiftleft(owner.cast("bigint"), 24).bitwiseOR(fits)


def task_owner(task: Column) -> Column:
    return F.shiftright(task, 24)


def task_index(task: Column) -> Column:
    return task.bitwiseAND(F.lit((1 << 24) - 1))
