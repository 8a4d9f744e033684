"""A corpus pipeline over `documents`: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes what the one before kept, as rows of `documents`, and its decisions take effect; between stages the rows
are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import minhash, mixing, packing, pii, quality
from sedimenta.llm.common import stored, table


def same_columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned rules reject."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return same_columns(quality.judge(docs, rules).where(F.col(f"{quality.prefix_of(docs)}kept")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more, the one with the smallest id; of rows with one id, one row.

    Rows with one id are one document to the operator, so of those the smallest by all columns stays. Rows with a null id stay."""
    gone = minhash.linked(docs, similarity="0.8").where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    twice = stored(left.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-twice")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    one = left.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("row"))
    one = one.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
    return same_columns(left.join(twice, "doc_id", "left_anti"), docs).union(one)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return same_columns(pii.redact(docs), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return same_columns(mixing.repeated(mixing.mix(docs), mixing.prefix_of(docs)), docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pack(docs, file="byte_bpe_50k.json", end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", sequences),
]

#: Learned rules and tokenizers are beyond SQL; tests hold each stage against its operator's plain version and against its effect.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
