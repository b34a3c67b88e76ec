"""Records to text or maps and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One field a type that an annotation may hold.
ANNOTATION = "struct<kind:string,i32:int,i64:bigint,f64:double,f32:float,str:string>"
_KINDS = ("i32", "i64", "f64", "f32", "str")


def annotation(kind: str, value: Column) -> Column:
    fields = [F.lit(kind).alias("kind"), *[(value if k == kind else F.lit(None)).alias(k) for k in _KINDS]]
    return F.struct(*fields).cast(ANNOTATION)


def annotations(df: DataFrame, owner: str, key: str, order: str, value: str) -> DataFrame:
    """A map of each owner's annotations: the first write of a key wins."""
    firsts = df.groupBy(owner, key).agg(F.min_by(value, order).alias("_v"))
    return firsts.groupBy(owner).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "_v")), lambda a, b: F.when(a[key] < b[key], -1).otherwise(1))).alias("annotations"))


def get_annotation(m: Column, key: str, kind: str) -> tuple[Column, Column]:
    """Value of the asked type and the found flag (whatever type was set)."""
    entry = F.try_element_at(m, F.lit(key))
    return entry[kind], entry.isNotNull()


def pack(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def unpack(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


def archive_line(*columns: str) -> Column:
    return F.to_csv(F.struct(*columns))


def unarchive(line: Column, schema: str) -> Column:
    return F.from_csv(line, F.lit(schema))


def pack_task(matrix_size: Column, task: Column) -> Column:
    """Size and id of a task in one double: exact below 2 ** 53."""
    return F.shiftleft(matrix_size.cast("bigint"), 32).bitwiseOR(task.cast("bigint")).cast("double")


def unpack_task(packed: Column) -> tuple[Column, Column]:
    bits = packed.cast("bigint")
    return F.shiftright(bits, 32).cast("int"), bits.bitwiseAND(F.lit((1 << 32) - 1))
