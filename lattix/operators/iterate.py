"""Iterative numerics: clustering and path simulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.plans.lineage import durable

#: Rounds of a DAG's levels between two checkpoints.
STEPS = 4
#: Centroids are a parameter of the model, not of the data: this bounds what is broadcast.
MAX_CENTROIDS = 10_000


def nearest(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """Points with the nearest centroid's number k (the lowest of equally near ones).

    Centroids (k, cx, cy) travel as one broadcast row of an array, so a point's
    distances are a fold in place: no row is made per pair.
    """
    model = centroids.agg(F.array_sort(F.collect_list(F.struct("k", "cx", "cy"))).alias("_c"))
    best = F.array_min(
        F.transform("_c", lambda c: F.struct(((F.col("x") - c["cx"]) * (F.col("x") - c["cx"]) + (F.col("y") - c["cy"]) * (F.col("y") - c["cy"])).alias("d"), c["k"].alias("k")))
    )
    return points.crossJoin(F.broadcast(model)).withColumn("k", best["k"]).drop("_c")


def kmeans(points: DataFrame, order: str, clusters: int, passes: int) -> DataFrame:
    """Centroids (k, cx, cy) after ``passes``: started from the first points by ``order``; an empty cluster goes to (0, 0)."""
    if clusters > MAX_CENTROIDS:
        raise ValueError(f"at most {MAX_CENTROIDS} clusters")
    first = points.orderBy(order).limit(clusters).select(F.struct(order, "x", "y").alias("p")).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    centroids = first.select(F.posexplode("ps").alias("k", "p")).select("k", F.col("p.x").alias("cx"), F.col("p.y").alias("cy"))
    centroids = durable(centroids)
    for _ in range(passes):
        sums = nearest(points, centroids).groupBy("k").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count("*").alias("n"))
        moved = centroids.select("k").join(sums, "k", "left")
        n = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
        centroids = durable(moved.select("k", (F.coalesce("sx", F.lit(0.0)) / n).alias("cx"), (F.coalesce("sy", F.lit(0.0)) / n).alias("cy")))
    return centroids


def dag_levels(edges: DataFrame) -> DataFrame:
    """Topological level of each node of ``edges`` (a before b): one more than its highest predecessor, 0 without any.

    Each round keeps one row a node, so paths aren't enumerated; a cycle is an error, as
    levels would exceed the number of nodes.
    """
    edges = durable(edges.select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    levels = durable(nodes.withColumn("level", F.lit(0)))
    most = levels.count()
    for _ in range(0, most + 1, STEPS):
        new = levels
        for _ in range(STEPS):
            pushed = edges.join(new.select(F.col("node").alias("a"), "level"), "a").groupBy(F.col("b").alias("node")).agg((F.max("level") + 1).alias("least"))
            new = new.select("node", F.col("level").alias("was")).join(pushed, "node", "left").select("node", "was", F.coalesce("least", F.lit(0)).alias("level"))
        new = durable(new)
        levels = new.select("node", "level")
        if new.filter("level != was").limit(1).count() == 0:
            return levels
    raise ValueError("the edges have a cycle")


def rolling_barrier_payoffs(
    series: DataFrame, order: list[str], normal: str, steps: int, strike: float, barrier: float, start: float, sigma: float, mu: float, rate: float, dt: float, years: float
) -> DataFrame:
    """As ``barrier_payoff``, of paths that overlap: each row of one series ends a path of its own and the ``steps`` - 1 normals before it.

    Rows (order, payoff); the first rows, which end no path, go.  The series is cut into
    ranges, each with the last normals of those before it, so a normal is read once.
    """
    from lattix.operators.scans import in_ranges, with_halo

    ranged = in_ranges(series.select(*order, F.col(normal).cast("double").alias("_z")), order)

    def payoffs(t: pa.Table, halo: int) -> pa.Table:
        z, first = t.column("_z").to_numpy(), max(halo, steps - 1)
        out = t.slice(first).drop(["_z"])
        if len(z) < steps:
            return out.append_column("payoff", pa.array([], pa.float64()))
        s = np.full(len(z) - steps + 1, float(start))
        for step in np.lib.stride_tricks.sliding_window_view(z, steps).T:
            s = np.where(s > barrier, s + mu * s * dt + sigma * s * step, s)
        paid = np.where(s > barrier, np.maximum(s - strike, 0.0), 0.0) * np.exp(-rate * years)
        return out.append_column("payoff", pa.array(paid[first - steps + 1 :]))

    kinds = ", ".join(f"{c} {series.schema[c].dataType.simpleString()}" for c in order)
    return with_halo(ranged, steps - 1, payoffs, f"{kinds}, payoff double")


def barrier_payoff(normals: Column, strike: float, barrier: float, start: float, sigma: float, mu: float, rate: float, dt: float, years: float) -> Column:
    """Discounted payoff of a down-and-out call along one path of normals; the path stops once it touches the barrier."""
    zero = F.lit(float(start))
    step = lambda s, z: F.when(s > barrier, s + mu * s * dt + sigma * s * z).otherwise(s)
    end = F.aggregate(normals, zero, step)
    paid = F.when(end > barrier, F.greatest(end - strike, F.lit(0.0))).otherwise(F.lit(0.0))
    return paid * F.exp(F.lit(-rate * years))
