"""What several text operators share: word splitting, work tables, checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.paths import delete

SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
#: Rows up to which a joined side is broadcast; above it the join shuffles.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPLIT)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, SPLIT))).otherwise(0).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). A temporary
    one is set only where a local session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/plumbline/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it back: cuts lineage and keeps the
    work of finished stages when executors are lost."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that saved() wrote, once all that reads them has been written too."""
    for df in tables:
        spark, base = df.sparkSession, f"{shared_dir(df.sparkSession).rstrip('/')}/plumbline/".removeprefix("file:").lstrip("/")
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        delete(spark, [f for f in folders if base in f])


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if counting shows that it has at most `rows` rows.
    df should be cheap to read (a written table)."""
    return F.broadcast(df) if len(df.select(F.lit(1)).head(rows + 1)) <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
