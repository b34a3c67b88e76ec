"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Source s holds a share of the corpus's characters; its target share follows from
``weights``, or by default from ``size ** exponent``.  The mean repetition rate is
target share / actual share.  Each document draws a uniform number from MD5 of
(seed, id) and inverts the Poisson distribution of its source's rate, so the draw
depends on nothing but seed and id.  Copies are exploded and shuffled globally:
rows are dealt to partitions and sorted inside them by a key hashed from
(seed, id, copy).

Edge cases: a null source is a source of its own.  A source without characters
gets rate 1.  A source missing from ``weights`` gets target 0.  Null ids draw as
the empty id.  Rows that repeat an id draw the same count.  A null text weighs 0
characters but is replicated like any other.  A text of any length counts whole.
Columns named as the added ones are replaced, others kept, whatever their names.  An
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, let

#: Sources whose rate table may be broadcast; beyond it the rates are joined by a shuffle of ids.
MAX_BROADCAST_SOURCES = 100_000
#: Least count, but 0, at which the array of a distribution begins.
LEAST_FIRST = 32


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of MD5 over the parts, joined by ':'."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def mixing_rates(docs: DataFrame, source_col: str, text_col: str, exponent: float, weights: dict[str, float] | None) -> DataFrame:
    """One row a source: source, chars, rate, first, cdf (the Poisson distribution function from ``first`` on)."""
    sizes = docs.groupBy(F.col(source_col).alias("__lx_source")).agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars"))
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("chars").cast("double"), F.lit(float(exponent))))
    else:
        pairs = [F.lit(x) for name, w in weights.items() for x in (str(name), float(w))]
        table = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
        named = F.try_element_at(table, F.coalesce(F.col("__lx_source").cast("string"), F.lit("")))
        sizes = sizes.withColumn("w", F.coalesce(named, F.lit(0.0)))
    sizes = durable(sizes)
    totals = sizes.agg(F.sum("chars").alias("chars"), F.sum("w").alias("w")).first()  # two numbers
    all_chars, all_w = float(totals["chars"] or 0), float(totals["w"] or 0)
    rate = F.when(F.col("chars") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    if all_w > 0:
        rate = F.when(F.col("chars") == 0, F.lit(1.0)).otherwise((F.col("w") / all_w) / (F.col("chars") / all_chars))
    # terms beyond rate + 12 sqrt(rate) + 30 have less probability than a double resolves
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    # so have those below rate - 12 sqrt(rate) - 30; without them no large rate's terms begin at exp(-rate), which a double can't hold
    low = F.floor(F.col("rate") - 12 * F.sqrt("rate") - 30).cast("int")
    first = F.when(low >= LEAST_FIRST, low).otherwise(F.lit(0))

    def term(n: Column) -> Column:
        """exp(-rate) rate ** n / n! by Stirling's series, whose error is below 1e-13 from LEAST_FIRST on."""
        series = 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5)
        return F.exp((n - F.col("rate")) + n * F.log(F.col("rate") / n) - 0.5 * F.log(2 * math.pi * n) - series)

    def cdf() -> Column:
        lowest = F.when(F.col("__lx_first") == 0, F.exp(-F.col("rate"))).otherwise(term(F.col("__lx_first").cast("double")))
        start = F.struct(lowest.alias("p"), F.array(lowest).alias("c"))

        def step(s: Column, k: Column) -> Column:
            p = s["p"] * F.col("rate") / k
            return F.struct(p.alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + p)).alias("c"))

        return F.aggregate(F.sequence(F.col("__lx_first") + 1, last), start, step)["c"]

    return sizes.withColumn("rate", rate).withColumn("__lx_first", first).withColumn("__lx_cdf", cdf()).select("__lx_source", "chars", "rate", "__lx_first", "__lx_cdf")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    exponent: float = 0.5,
    weights: dict[str, float] | None = None,
    seed: int = 17,
) -> DataFrame:
    """``docs`` with each row repeated by its draw, plus copy (from 0) and shuffle_key, in shuffled order."""
    docs = docs.drop("copy", "shuffle_key")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rates, _ = broadcast_if_small(mixing_rates(docs, source_col, text_col, exponent, weights).select("__lx_source", "__lx_first", "__lx_cdf"), MAX_BROADCAST_SOURCES)
    joined = docs.join(rates, docs[source_col].eqNullSafe(rates["__lx_source"]), "left")
    draw = let(uniform(F.lit(seed), key), lambda u: F.col("__lx_first") + F.size(F.filter(F.col("__lx_cdf"), lambda c: c <= u)))
    counted = joined.withColumn("__lx_n", draw).filter("__lx_n > 0")
    copies = counted.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(0), F.col("__lx_n") - 1)).alias("copy"))
    mixed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed + 1).cast("string"), key, F.col("copy").cast("string"))))
    return mixed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
