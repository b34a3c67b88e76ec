"""Named functions with declared types: the surface of remote calls."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass
class Registry:
    """Functions of one provider.  ``native`` ones build Columns; ``remote`` ones run in Python on Arrow batches."""

    provider: str = "default"
    #: Scheduler pool in which the provider's actions run.
    pool: str | None = None
    _native: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = field(default_factory=dict)
    _remote: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = field(default_factory=dict)

    def native(self, name: str, types: Iterable[str], fn: Callable[..., Column]) -> None:
        self._native[name] = (tuple(types), fn)

    def remote(self, name: str, types: Iterable[str], returns: str, fn: Callable) -> None:
        """``fn``: Arrow arrays in, one Arrow array (struct arrays too) out."""
        self._remote[name] = (tuple(types), F.arrow_udf(fn, returns))

    def call(self, name: str, *args: Column) -> Column:
        """The function's Column; arguments are cast to their declared types."""
        types, fn = self._native.get(name) or self._remote[name]
        if len(types) != len(args):
            raise TypeError(f"{self.provider}.{name} takes {len(types)} arguments, not {len(args)}")
        return fn(*[a.cast(t) for a, t in zip(args, types, strict=True)])

    def run(self, spark: SparkSession, action: Callable):
        """An action in the provider's own pool."""
        context = spark.sparkContext
        before = context.getLocalProperty("spark.scheduler.pool")
        context.setLocalProperty("spark.scheduler.pool", self.pool)
        try:
            return action()
        finally:
            context.setLocalProperty("spark.scheduler.pool", before)

    def publish(self, spark: SparkSession) -> None:
        """Make the remote functions callable from SQL as <provider>_<name>."""
        for name, (_, fn) in self._remote.items():
            spark.udf.register(f"{self.provider}_{name}", fn)


def call_on_host(df: DataFrame, host: str, fn: Callable, schema: str) -> DataFrame:
    """Run ``fn`` (iterator of Arrow batches in and out) where each host's rows are together."""
    return df.repartition(host).mapInArrow(fn, schema)


def timed(spark: SparkSession, seconds: float, action: Callable):
    """The action's result, or ``TimeoutError`` once it takes longer: its jobs are then cancelled."""
    context, tag = spark.sparkContext, f"timed-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"the call took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def table_function(spark: SparkSession, name: str, fn: Callable[..., Iterator[tuple]], returns: str):
    """A generator as a table function: callable here with Columns, and from SQL (LATERAL too) by its name."""

    class Rows:
        def eval(self, *args):
            yield from fn(*args)

    made = F.udtf(Rows, returnType=returns)
    spark.udtf.register(name, made)
    return made


def notify(df: DataFrame, fn: Callable) -> None:
    """A call without an answer: ``fn`` gets each partition's rows."""
    df.foreachPartition(fn)


def with_callback(df: DataFrame, name: str, *metrics: Column):
    """The frame and an observation of ``metrics``, whose values are there once an action on the frame has finished."""
    seen = Observation(name)
    return df.observe(seen, *metrics), seen
