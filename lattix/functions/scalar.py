"""Element-wise functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def saxpy(a: float, x: Column, y: Column) -> Column:
    return F.lit(a) * x + y


def scale(v: Column, factor: float) -> Column:
    return v * F.lit(factor)


def scale_array(v: Column, factor: float) -> Column:
    return F.transform(v, lambda x: x * F.lit(factor))


def add_arrays(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def truncated_scale(v: Column, factor: int) -> Column:
    """Operand truncated to an integer before it is multiplied."""
    return v.cast("bigint") * factor


def truncated_shift(v: Column, amount: int) -> Column:
    return v.cast("bigint") + amount


def calculator(op: str, a: Column, b: Column) -> Column:
    """struct<value, error_code, error>: division by zero is an error, not an exception."""
    value = {"add": a + b, "sub": a - b, "mul": a * b, "div": F.try_divide(a, b)}[op]
    failed = (b == 0) if op == "div" else F.lit(False)
    return F.struct(
        F.when(~failed, value).alias("value"),
        F.when(failed, 1).otherwise(0).alias("error_code"),
        F.when(failed, F.lit("Division by zero")).alias("error"),
    )


def lenient_float(cell: Column) -> Column:
    """Leading number of a text cell, 0 if there is none."""
    number = F.regexp_extract(F.coalesce(cell, F.lit("")), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def csv_cells(line: Column) -> Column:
    """Cells of a comma-separated line; a trailing comma gives an empty last cell."""
    return F.split(line, ",", -1)


def bulk_prefix(text: Column, local: Column, remote: Column) -> Column:
    """What a bulk transfer moves of an ASCII text: as many bytes as the smaller of both buffers has."""
    return F.left(text, F.least(local, remote))


def djb2(text: Column) -> Column:
    """64-bit djb2 over the UTF-8 bytes (h = 33 h + byte from 5381), as an unsigned number in decimal text."""
    low = F.lit((1 << 32) - 1)
    digits = F.hex(F.encode(text, "UTF-8"))
    bytes_ = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("bigint"))
    start = F.struct(F.lit(0).cast("bigint").alias("hi"), F.lit(5381).cast("bigint").alias("lo"))

    def step(h: Column, b: Column) -> Column:
        lo = h["lo"] * 33 + b
        return F.struct((h["hi"] * 33 + F.shiftright(lo, 32)).bitwiseAND(low).alias("hi"), lo.bitwiseAND(low).alias("lo"))

    join = lambda h: F.conv(F.hex(F.shiftleft(h["hi"], 32).bitwiseOR(h["lo"])), 16, 10)
    return F.aggregate(F.when(F.length(digits) > 0, bytes_).otherwise(F.array().cast("array<bigint>")), start, step, join)


def multiply_hash(key: Column) -> Column:
    return key * 107


def xor_hash(values: Column) -> Column:
    """First value, XORed with itself for each further one: 0 for an even number of values, else the first."""
    return F.when(F.size(values) % 2 == 0, F.lit(0)).otherwise(F.get(values, F.lit(0)))


def prefix(text: Column, n: int) -> Column:
    """What a bulk pull of ``n`` bytes leaves of an ASCII text."""
    return F.left(text, F.lit(n))


def min_max_row(values: Column) -> Column:
    """Row-wise scaling to [0, 1], the label included; a constant row gives zeros."""
    lo, hi = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda x: F.when(hi == lo, F.lit(0.0)).otherwise((x - lo) / (hi - lo)))


def poly_features(x: Column, degree: int = 4) -> Column:
    return F.array(*[F.pow(x, F.lit(k)) for k in range(1, degree + 1)])


def linear_target(features: Column, weights: list[float], bias: float) -> Column:
    terms = [F.get(features, i) * w for i, w in enumerate(weights)]
    return sum(terms[1:], terms[0]) + bias


def formula(weights: list[float], bias: float) -> str:
    return "y = " + " + ".join(f"{w:.3f} x^{len(weights) - i}" for i, w in enumerate(reversed(weights))) + f" {bias:+.3f}"


def smooth_l1(error: Column) -> Column:
    return F.when(F.abs(error) < 1, 0.5 * error * error).otherwise(F.abs(error) - 0.5)
