"""Connected components: solved in one task where the links are few, by DataFrame rounds beyond."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh_join

#: Links (16 bytes each) that one task solves; a count proves it.  More are solved by rounds over all partitions.
MAX_LOCAL_LINKS = 2_000_000


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and the smallest node each one reaches.

    In each round every root with a smaller neighbouring root is hung below it, which
    at least halves the roots of a component; then labels jump to their roots.
    """
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(ids))
    while len(x):
        lx, ly = label[x], label[y]
        apart = lx != ly
        if not apart.any():
            break
        x, y, lx, ly = x[apart], y[apart], lx[apart], ly[apart]
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
    return ids, ids[label]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (id, component) of each ``MAX_LOCAL_LINKS`` links that a task reads."""
    held: list[pa.RecordBatch] = []

    def stars() -> Iterator[pa.RecordBatch]:
        if held:
            t = pa.Table.from_batches(held)
            held.clear()
            ids, component = solve(t.column(0).to_numpy(), t.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(component)], ["id", "component"])

    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n > MAX_LOCAL_LINKS:
            yield from stars()
            n = 0
    yield from stars()


def connected_components(links: DataFrame, max_local: int = MAX_LOCAL_LINKS) -> DataFrame:
    """``links``: a, b (bigint), checkpointed.  One row a node that has a link: id, component (the smallest id reachable).

    Up to ``max_local`` links are solved by one task, without a shuffle.  More are first
    contracted to stars where they lie; then each round gives a node the least label of
    itself and its neighbours, and the label of its label, so a path of length n takes
    O(log n) rounds, each checkpointed.  Links and labels never leave the executors.
    """
    links = links.select("a", "b").filter("a != b")
    if links.count() <= max_local:
        return durable(links.coalesce(1).mapInArrow(_solved, "id bigint, component bigint"))
    stars = links.mapInArrow(_solved, "id bigint, component bigint").filter("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    both = durable(stars.union(stars.select("b", "a")).distinct())
    labels = durable(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:  # labels only fall, so it ends
        near = fresh_join(both.withColumnRenamed("b", "id"), labels, ["id"]).groupBy("a").agg(F.min("component").alias("near"))
        pulled = labels.join(near, labels["id"] == near["a"]).select("id", "component", F.least("component", "near").alias("pulled"))
        targets = labels.select(F.col("id").alias("pulled"), F.col("component").alias("root"))
        jumped = fresh_join(pulled, targets, ["pulled"], "left").select("id", F.least("pulled", "root").alias("component"), (F.least("pulled", "root") != F.col("component")).alias("moved"))
        new = durable(jumped)
        labels = new.select("id", "component")
        if new.filter("moved").limit(1).count() == 0:
            return labels
