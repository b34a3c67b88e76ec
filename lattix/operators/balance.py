"""Load balancing decisions over a table of ranks (rank, load): one row a rank, so small by nature."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattix.operators.ordered import positions
from lattix.operators.scans import in_ranges, latest, scan
from lattix.plans.lineage import durable

#: Least relative imbalance, share of the difference that moves, share of tasks that is replicated.
MIN_RELATIVE, MOVE_SHARE, REPLICATED_SHARE = 0.05, 0.5, 0.1


def default_load(tasks: DataFrame, rank: str, local: Column, replicated_local: Column, stolen: Column, stolen_replicated: Column | None = None) -> DataFrame:
    """Load of each rank: local, replicated local and stolen tasks (replicated stolen ones if given)."""
    counts = F.count_if(local) + F.count_if(replicated_local) + F.count_if(stolen)
    if stolen_replicated is not None:
        counts = counts + F.count_if(stolen_replicated)
    return tasks.groupBy(F.col(rank).alias("rank")).agg(counts.alias("load"))


def sorted_positions(loads: DataFrame) -> DataFrame:
    """Position of each rank by (load, rank), from 0, and the number of ranks."""
    placed = scan(in_ranges(loads, ["load", "rank"]), [], {"pos": F.lit(1).cast("bigint")}, lambda a, b: {"pos": a["pos"] + b["pos"]}, {"pos": 0})
    return placed.crossJoin(F.broadcast(loads.agg(F.count("*").alias("n"))))


def migrate_default(loads: DataFrame) -> DataFrame:
    """Moves (from_rank, to_rank, n_tasks): the upper half gives half the difference to its mirror in the lower half."""
    loads = durable(loads)
    s = durable(sorted_positions(loads))
    extremes = loads.agg(F.min("load").alias("lo"), F.max("load").alias("hi"))
    mirror = s.select((F.col("n") - 1 - F.col("pos")).alias("pos"), F.col("rank").alias("to_rank"), F.col("load").alias("other"))
    pairs = s.join(mirror, "pos").crossJoin(F.broadcast(extremes))
    gap = F.col("load") - F.col("other")
    wanted = (
        (F.col("load") - F.col("lo") >= 2)
        & (F.try_divide(F.col("hi") - F.col("lo"), F.col("hi")) >= MIN_RELATIVE)
        & (F.col("pos") >= F.floor(F.col("n") / 2))
        & (gap >= 2)
        & (F.try_divide(gap, F.col("load")) >= MIN_RELATIVE)
    )
    moved = F.greatest(F.lit(1), F.floor(gap * MOVE_SHARE)).cast("bigint")
    return pairs.filter(wanted).select(F.col("rank").alias("from_rank"), "to_rank", moved.alias("n_tasks"))


def migrate_aggressive(loads: DataFrame) -> DataFrame:
    """Moves that bring all ranks to the mean (rounded down): surplus meets deficit greedily in rank order.

    Surplus and deficit become adjacent intervals by running sums (a scan over the ranks);
    their overlaps are the moves, found by a sweep over both.
    """
    loads = durable(loads)
    with_mean = loads.crossJoin(F.broadcast(loads.agg(F.floor(F.sum("load") / F.count("*")).alias("mean"))))
    gap = (F.col("load") - F.col("mean")).cast("bigint")
    amounts = {"give": F.greatest(gap, F.lit(0).cast("bigint")), "take": F.greatest(-gap, F.lit(0).cast("bigint"))}
    summed = scan(in_ranges(with_mean, ["rank"]), [], amounts, lambda a, b: {k: a[k] + b[k] for k in a}, {"give": 0, "take": 0})
    side = lambda amount, start: durable(summed.select(F.col("rank").cast("bigint").alias("id"), F.col(start).alias("lo"), (F.col(start) + amount).alias("hi")).filter("hi > lo"))
    both = sweep_disjoint(side(amounts["give"], "give"), side(amounts["take"], "take"))
    return both.select(F.col("a").alias("from_rank"), F.col("b").alias("to_rank"), (F.col("hi") - F.col("lo")).alias("n_tasks"))


def sweep_disjoint(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlaps (a, b, lo, hi) of intervals (id, lo, hi) that don't overlap on their own side: a merge of both sides' starts.

    Each start sees the last interval of the other side that began before it, by one scan
    over all starts; an overlap begins with the later of its two starts.
    """
    mark = lambda df, s: df.select(*[(F.col(c) if k == s else F.lit(0).cast("bigint")).alias(f"{k}_{c}") for k in "ab" for c in ("id", "lo", "hi")], F.col("lo").alias("at"), F.lit(s).alias("side"))
    starts = in_ranges(mark(a, "a").unionByName(mark(b, "b")), ["at", "side"])
    state = {f"{s}{c}": F.col(f"{s}_{c}") for s in "ab" for c in ("id", "lo", "hi")}
    state |= {f"{s}set": (F.col("side") == s).cast("bigint") for s in "ab"}

    def newest(x, y):
        out = {}
        for s in "ab":
            mine = lambda v: {("set" if k[1:] == "set" else k): v[k] for k in v if k[0] == s}  # noqa: B023, E731
            out |= {(s + "set" if k == "set" else k): v for k, v in latest(mine(x), mine(y)).items()}
        return out

    seen = scan(starts, [], state, newest, dict.fromkeys(state, 0), inclusive=True).filter("aset = 1 AND bset = 1")
    lo, hi = F.greatest("alo", "blo"), F.least("ahi", "bhi")
    # the later start begins the overlap; of two equal ones the row of side b, which comes second
    begins = (F.col("at") == lo) & ((F.col("alo") != F.col("blo")) | (F.col("side") == "b"))
    return seen.filter(begins & (hi > lo)).select(F.col("aid").alias("a"), F.col("bid").alias("b"), lo.alias("lo"), hi.alias("hi"))


#: Ranges of an overlap join, an upper bound of the cuts that reach the driver.
SWEEP_RANGES = 256


def overlap_join(a: DataFrame, b: DataFrame, ranges: int = SWEEP_RANGES) -> DataFrame:
    """All overlapping pairs (a, b) of half-open intervals (id bigint, lo, hi bigint), which may overlap on their own side too.

    The starts' quantiles cut the axis into ranges; an interval goes to each range that it
    touches, so a range knows what is open at its beginning.  Inside a range both sides are
    sorted by start: what begins inside an interval is one slice of the other side's
    starts.  A pair is made in the range where its later start lies, so once.  Intervals
    with a null or without length overlap nothing.
    """
    full = lambda df, s: df.filter("lo < hi").select("id", "lo", "hi", F.lit(s).alias("side"))
    both = durable(full(a, 0).union(full(b, 1)))
    cuts = both.agg(F.percentile_approx("lo", [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
    cuts = np.array(sorted(set(cuts)), np.int64)
    bounds = F.array(*[F.lit(int(c)) for c in cuts]) if len(cuts) else F.array().cast("array<bigint>")
    place = lambda x: F.size(F.filter(bounds, lambda c: c <= x))
    dealt = both.withColumn("_range", F.explode(F.sequence(place(F.col("lo")), place(F.col("hi") - 1))))

    def sweep(t: pa.Table) -> pa.Table:
        r, side = t.column("_range")[0].as_py(), t.column("side").to_numpy()
        begin = int(cuts[r - 1]) if r else np.iinfo(np.int64).min
        ids, lo, hi = (t.column(c).to_numpy() for c in ("id", "lo", "hi"))
        lo = np.maximum(lo, begin)
        made = []
        for s in (0, 1):  # rows of the other side that begin inside mine; of equal starts side 0's row counts as first
            mine, other = np.flatnonzero(side == s), np.flatnonzero(side != s)
            other = other[np.argsort(lo[other], kind="stable")]
            first = np.searchsorted(lo[other], lo[mine], "left" if s == 0 else "right")
            n = np.maximum(np.searchsorted(lo[other], hi[mine], "left") - first, 0)
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            x, y = np.repeat(mine, n), other[at]
            # both began before this range: an earlier one has made the pair
            new = (np.maximum(t.column("lo").to_numpy()[x], t.column("lo").to_numpy()[y]) >= begin) if r else np.ones(len(x), bool)
            x, y = x[new], y[new]
            made.append((ids[x], ids[y]) if s == 0 else (ids[y], ids[x]))
        return pa.table({"a": np.concatenate([m[0] for m in made]), "b": np.concatenate([m[1] for m in made])})

    return dealt.groupBy("_range").applyInArrow(sweep, "a bigint, b bigint")


def replicate_ring(loads: DataFrame, share: float = REPLICATED_SHARE) -> DataFrame:
    """Copies (from_rank, to_rank, n_tasks) that each rank sends to its two neighbours on the ring."""
    n = F.count("*").over(Window.partitionBy())
    each = F.floor(F.col("load") * share / 2).cast("bigint")
    rows = loads.select("rank", n.alias("n"), each.alias("n_tasks")).filter("n > 1 and n_tasks > 0")
    sides = rows.withColumn("to_rank", F.explode(F.array_distinct(F.array(F.pmod(F.col("rank") - 1, "n"), F.pmod(F.col("rank") + 1, "n")))))
    return sides.select(F.col("rank").alias("from_rank"), F.col("to_rank").cast("bigint").alias("to_rank"), "n_tasks")


def ring_shift(ranks: DataFrame, rank: str, value: str, n: int, by: int) -> DataFrame:
    """What each rank holds after ``by`` shifts to the next rank: the value of rank - by."""
    sent = ranks.select(F.pmod(F.col(rank) + by, F.lit(n)).alias(rank), F.col(value).alias("received"))
    return ranks.join(sent, rank)


def team_index(members: DataFrame, team: str, rank: str) -> DataFrame:
    """Distinct members of each team with their dense index, from 0."""
    return members.select(team, rank).distinct().withColumn("index", F.row_number().over(Window.partitionBy(team).orderBy(rank)) - 1)


def split_world(rank: Column, n_ranks: int, parts: int) -> Column:
    """Part of each rank when the world is cut into ranges of ceil(n / parts)."""
    return F.floor(rank / -(-n_ranks // parts))


def cap_moves(
    candidates: DataFrame,
    rank: str,
    order: list[str],
    queue_size: Column,
    cap: int = 1,
    exchanged: Column | None = None,
    chosen: DataFrame | None = None,
    task: str | None = None,
) -> DataFrame:
    """Tasks that may move now: at most ``cap`` a rank, from queues of two tasks or more.

    ``exchanged`` tells ranks whose loads have been exchanged since the last decision (others
    wait); ``chosen`` (task, to_rank), if given, are the only tasks that may move, and where.
    """
    w = Window.partitionBy(rank).orderBy(*order)
    if exchanged is not None:
        candidates = candidates.filter(exchanged)
    if chosen is not None:
        candidates = candidates.join(chosen, task)
    return candidates.filter(queue_size >= 2).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")


def cancel(tasks: DataFrame, cancelled: DataFrame, task: str) -> DataFrame:
    return tasks.join(cancelled.select(task), task, "left_anti")


def round_robin(tasks: DataFrame, rank: str, order: list[str], plans: int) -> DataFrame:
    """Plan of each replicated task of a rank, in turn; a rank may hold any share of all tasks."""
    return positions(tasks, [rank], order, "plan").withColumn("plan", F.col("plan") % plans)


#: Decisions by name; ``decide`` takes any function of the same form too.
POLICIES = {"default": migrate_default, "aggressive": migrate_aggressive, "replicate": replicate_ring}


def decide(loads: DataFrame, policy="default") -> DataFrame:
    """Moves (from_rank, to_rank, n_tasks) by a named or given policy (loads -> moves)."""
    return (POLICIES[policy] if isinstance(policy, str) else policy)(loads)
