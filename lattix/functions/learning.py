"""Regression: lag features, least squares and gradient descent as aggregations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lag_features(series: DataFrame, order: str, value: str, length: int, by: list[str] | None = None) -> DataFrame:
    """Rows (order, a0 .. a<length-1>, target): the ``length`` values before each one, oldest first; the first rows go.

    ``by`` names series that are independent; without it all rows are one series,
    whose window is one task.  Rows whose ``order`` is null come last.
    """
    w = Window.partitionBy(*(by or [])).orderBy(F.col(order).asc_nulls_last())
    lags = {f"a{k}": F.lag(value, length - k).over(w) for k in range(length)}
    rows = series.select(*(by or []), order, F.col(value).alias("target"), F.row_number().over(w).alias("_n"), *[c.alias(n) for n, c in lags.items()])
    return rows.filter(F.col("_n") > length).select(*(by or []), order, *lags, "target")


def series_lags(series: DataFrame, order: list[str], value: str, length: int) -> DataFrame:
    """As ``lag_features``, of all rows as one series however long: ranges of the order, each with the last rows of those before it.

    ``value`` is taken as double (a null as not a number); columns ``order``, a0 .. a<length-1>, target.
    """
    from lattix.operators.scans import in_ranges, with_halo

    names = [f"a{k}" for k in range(length)]
    ranged = in_ranges(series.select(*order, F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("target")), order)

    def lags(t: pa.Table, halo: int) -> pa.Table:
        v, first = t.column("target").to_numpy(), max(halo, length)
        out = t.slice(first)
        for k, name in enumerate(names):
            out = out.append_column(name, pa.array(v[first - length + k :][: out.num_rows]))
        return out.select([*order, *names, "target"])

    kinds = ", ".join(f"{c} {series.schema[c].dataType.simpleString()}" for c in order)
    return with_halo(ranged, length, lags, f"{kinds}, " + ", ".join(f"{n} double" for n in [*names, "target"]))


def simple_ols(df: DataFrame, y: Column, x: Column, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def fit_in_range(df: DataFrame, features: list[str], target: str, order: str, train: tuple[int, int], validate: tuple[int, int]):
    """Least squares on the rows whose ``order`` lies in ``train``; predictions for those in ``validate`` (both half open)."""
    part = lambda r: df.filter((F.col(order) >= r[0]) & (F.col(order) < r[1]))
    return predict(fit_ols(part(train), features, target), part(validate), features)


def smooth_l1_descent(df: DataFrame, x: Column, y: Column, rate: float, tolerance: float = 1e-3, most: int = 1000, start: tuple[float, float] = (0.0, 0.0)) -> list[tuple[float, float, float]]:
    """Gradient descent of y = w x + b by smooth L1 loss until the loss is below ``tolerance``: (w, b, loss before the step) of each epoch.

    The loss is no polynomial of the parameters, so each epoch is one aggregation over the checkpointed pairs.
    """
    from lattix.functions.scalar import smooth_l1
    from lattix.plans.lineage import durable

    pairs = durable(df.select(x.cast("double").alias("x"), y.cast("double").alias("y")))
    w, b = start
    out = []
    for _ in range(most):
        d = F.lit(w) * F.col("x") + F.lit(b) - F.col("y")
        slope = F.when(F.abs(d) < 1, d).otherwise(F.signum(d))
        got = pairs.agg(F.avg(smooth_l1(d)).alias("loss"), F.avg(slope * F.col("x")).alias("gw"), F.avg(slope).alias("gb")).first()
        if got["loss"] is None:
            break
        w, b = w - rate * got["gw"], b - rate * got["gb"]
        out.append((w, b, got["loss"]))
        if got["loss"] < tolerance:
            break
    return out


#: Widths of the hidden layers.
HIDDEN = (500, 500, 200)


def linear_mlp(df: DataFrame, features: list[str], target: str, hidden: tuple[int, ...] = HIDDEN, epochs: int = 100, rate: float = 0.001, seed: int = 0) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    """Layers without activation, trained by full-batch descent of the mean squared error: weights, biases, and the loss of each epoch.

    Such a net is a linear function, so loss and gradients follow from the sums of products
    of features and target; the data is read once, and only those sums reach the driver.
    """
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in (*features, target)]]
    n = len(columns)
    sums = df.agg(*[F.sum(columns[i] * columns[j]).alias(f"{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    s = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            s[i, j] = s[j, i] = sums[f"{i}_{j}"] or 0.0
    count, xx, xy, yy = max(s[0, 0], 1.0), s[:-1, :-1], s[:-1, -1], s[-1, -1]
    rng = np.random.default_rng(seed)
    sizes = [len(features), *hidden, 1]
    bound = [1 / a**0.5 for a in sizes[:-1]]
    weights = [rng.uniform(-c, c, (a, b)) for a, b, c in zip(sizes, sizes[1:], bound, strict=False)]
    biases = [rng.uniform(-c, c, b) for b, c in zip(sizes[1:], bound, strict=True)]
    losses = []
    for _ in range(epochs):
        # the input with a leading 1 times heads[k] is the input of layer k
        heads = [np.vstack([np.zeros(len(features)), np.eye(len(features))])]
        for w, b in zip(weights, biases, strict=True):
            h = heads[-1] @ w
            h[0] += b
            heads.append(h)
        whole = heads[-1][:, 0]
        losses.append(float(whole @ xx @ whole - 2 * whole @ xy + yy) / count)
        back = (2 * (xx @ whole - xy) / count)[:, None]  # derivative by the whole function's coefficients
        for k in range(len(weights) - 1, -1, -1):
            gw, gb, nxt = heads[k].T @ back, back[0].copy(), back @ weights[k].T
            weights[k], biases[k], back = weights[k] - rate * gw, biases[k] - rate * gb, nxt
    return weights, biases, losses


def mlp_formula(weights: list[np.ndarray], biases: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Coefficients and constant of the linear function that the layers are."""
    w, b = weights[0], biases[0]
    for v, c in zip(weights[1:], biases[1:], strict=True):
        w, b = w @ v, b @ v + c
    return w[:, 0], float(b[0])


def fit_ols(df: DataFrame, features: list[str], target: str):
    """Least squares by normal equations; only sums of products reach the driver."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df.withColumn(target, F.col(target).cast(DoubleType())))
    return LinearRegression(featuresCol="features", labelCol=target, predictionCol="prediction", solver="normal").fit(rows)


def predict(model, df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(df)).drop("features")


def mse_descent(df: DataFrame, x: Column, y: Column, epochs: int, rate: float, start: tuple[float, float] = (0.0, 0.0)) -> list[tuple[float, float, float]]:
    """Full-batch gradient descent of y = w x + b by mean squared error: (w, b, loss before the step) of each epoch.

    Loss and gradients follow from six sums, so the data is read once for all epochs.
    """
    s = df.agg(
        F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy")
    ).first()
    w, b = start
    out = []
    for _ in range(epochs):
        if not s["n"]:
            break
        n = s["n"]
        loss = (w * w * s["xx"] + 2 * w * b * s["x"] + n * b * b - 2 * w * s["xy"] - 2 * b * s["y"] + s["yy"]) / n
        gw, gb = 2 * (w * s["xx"] + b * s["x"] - s["xy"]) / n, 2 * (w * s["x"] + n * b - s["y"]) / n
        w, b = w - rate * gw, b - rate * gb
        out.append((w, b, loss))
    return out
