"""Reading databases over JDBC: partitioned reads, pushed filters, missing tables skipped."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import extract

log = logging.getLogger(__name__)

#: Rows that one task is meant to read, and tasks that read one table at a time at most: each
#: is a connection to the server.
ROWS_PER_TASK, MOST_TASKS, FETCH = 1_000_000, 64, 10_000


def _quoted(name: str) -> str:
    return ".".join('"' + x.replace('"', '""') + '"' for x in name.split("."))


def tables_of(spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> set[str]:
    """The tables and views a connection can see, as `table` and `schema.table`."""
    info = spark._jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        info.setProperty(k, v)
    if properties and "driver" in properties:
        spark._jvm.java.lang.Class.forName(properties["driver"])
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, info)
    try:
        found, out = connection.getMetaData().getTables(None, None, "%", None), set()
        while found.next():
            schema, name = found.getString("TABLE_SCHEM"), found.getString("TABLE_NAME")
            out |= {name, f"{schema}.{name}"}
        return out
    finally:
        connection.close()


def read_table(spark: SparkSession, url: str, table: str, split: str | None = None, where: str | None = None, properties: dict[str, str] | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """A table, whose filters and columns Spark pushes to the server. With a numeric, date or
    timestamp column to split by, it is read in as many ranges of it as its rows ask for;
    the bounds and the count come from one aggregate that the server computes, under the
    same condition. Rows outside the bounds, or with a null, are read too."""
    base = {**(properties or {}), "fetchsize": str(FETCH)}

    def reader(options: dict):
        return spark.read.format("jdbc").options(url=url, **base, **options)

    if split:
        rows = reader({"dbtable": _quoted(table), "pushDownAggregate": "true"}).load()
        rows = rows.where(where) if where else rows
        low, high, n = rows.agg(F.min(split), F.max(split), F.count("*")).head()
        tasks = min(MOST_TASKS, -(-n // rows_per_task))
        if tasks > 1 and low is not None and low != high:
            df = reader({"dbtable": _quoted(table), "partitionColumn": _quoted(split), "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(tasks)}).load()
            return df.where(where) if where else df
    df = reader({"dbtable": _quoted(table)}).load()
    return df.where(where) if where else df


def extract_tables(spark: SparkSession, url: str, tables: dict[str, dict], properties: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """extract for each table of {name: {keys, where, split}}; a missing one is logged and
    skipped."""
    there, out = tables_of(spark, url, properties), {}
    for name, how in tables.items():
        if name not in there:
            log.warning("table %s is missing and skipped", name)
            continue
        out[name] = extract(read_table(spark, url, name, how.get("split"), how.get("where"), properties), how["keys"])
    return out
