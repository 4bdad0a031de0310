"""What the queries share: the given tables, and frames derived from them by SQL that
Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.paths import work_dir  # noqa: F401

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of sql, in which {orders} and the like stand for the given tables."""
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def plain(sql: str) -> str:
    """The same SQL with the tables' bare names."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
