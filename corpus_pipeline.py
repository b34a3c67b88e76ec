"""A corpus pipeline: toxic documents go, repeated line chunks and near copies go, benchmark leaks go, sources are mixed.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns the columns of documents; the last one adds ``copy`` and ``shuffle_key``.
``run`` checkpoints what each stage returns, in the cluster's shared folder, so a lost
executor costs one stage's recomputation and no stage runs twice.

Edge cases, of all stages: rows are judged one by one where the operator's rule allows
it (toxicity, decontamination), else by id.  Null and empty texts pass every stage
unchanged.  Rows with a null id neither lose nor justify anything in the deduplicating
stages, and draw as the empty id in the last.  Rows that repeat an id: lines go from the
very text that repeats them; of near copies the smallest id stays, with all its rows;
equal ids draw equal numbers of copies.  Whole texts are read, however long.  Other
columns are kept, whatever their names, but for ``copy`` and ``shuffle_key``, which the
last stage replaces.  An empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattix.llm.common import durable, table
from lattix.llm.decontaminate import drop_contaminated
from lattix.llm.line_dedup import drop_repeated_lines
from lattix.llm.mixing import mix_sources
from lattix.llm.near_dedup import drop_near_duplicates
from lattix.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Training, registers and masked hashes have no equal in SQL; the tests hold run() against a plain Python version, row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else durable(docs), sf_dir)
    return docs
