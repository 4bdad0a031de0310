"""From raw documents to a weighted training mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns the columns of documents; the last adds what the mix takes of each row.
Rows with nulls pass through the stages as their operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, linededup, mix, neardup, quality
from plumbline.llm.common import fresh, saved, table

#: Shingles, union-find and tilted rates are beyond SQL; the tests compare brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules themselves, or whose host does, go."""
    return quality.quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are near copies of an earlier line go, and documents of which no line
    is left; n_chars follows the text."""
    count, gone = fresh(docs, "n_lines", "n_removed")
    out = linededup.dedup_lines(docs)
    return out.where(f"{gone} = 0 or {gone} < {count}").selectExpr(*[f"cast(length(text) as {dict(docs.dtypes)[c]}) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return neardup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark question, re-parameterised or not, go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its copies in the mix and the words they take."""
    return mix.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
