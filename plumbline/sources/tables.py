"""Reading and writing tables, row documents, definitions and catalog snapshots."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

#: Roles of columns, kept in the field's metadata under "role": computed columns are never
#: synced, identity columns are inserted but not updated, row-guid columns are left out.
COMPUTED, IDENTITY, ROWGUID = "computed", "identity", "rowguid"


def with_roles(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(c, metadata={"role": roles[c]}) if c in roles else F.col(c) for c in df.columns])


def syncable(schema: T.StructType) -> list[str]:
    """Columns a sync may read, in name order."""
    return sorted(f.name for f in schema.fields if f.metadata.get("role") not in (COMPUTED, ROWGUID))


def extract(df: DataFrame, keys: list[str], where: str | None = None) -> DataFrame:
    """The syncable columns in name order of rows that match, ordered by key."""
    rows = df.where(where) if where else df
    return rows.select(*syncable(df.schema)).orderBy(*keys)


def to_json_rows(df: DataFrame, keys: list[str], name: str = "doc") -> DataFrame:
    """Keys and one JSON document per row, properties in name order, nulls absent."""
    return df.select(*keys, F.to_json(F.struct(*sorted(df.columns))).alias(name))


def from_json_rows(df: DataFrame, schema: T.StructType | str, name: str = "doc") -> DataFrame:
    """Typed rows from JSON documents; a missing property is null."""
    return df.select(F.from_json(name, schema).alias("j")).select("j.*")


def geo_split(df: DataFrame, name: str) -> DataFrame:
    """A (wkt, srid) struct as two plain columns for transport."""
    return df.withColumns({f"{name}_wkt": F.col(name)["wkt"], f"{name}_srid": F.col(name)["srid"]}).drop(name)


def geo_join(df: DataFrame, name: str) -> DataFrame:
    pair = F.when(F.col(f"{name}_wkt").isNotNull(), F.struct(F.col(f"{name}_wkt").alias("wkt"), F.col(f"{name}_srid").alias("srid")))
    return df.withColumn(name, pair).drop(f"{name}_wkt", f"{name}_srid")


COLUMN = "struct<Name:string,DataType:string,Nullable:boolean,Default:string,CheckExpression:string,ComputedExpression:string,Persisted:boolean,Sparse:boolean,Collation:string,DataMaskFunction:string,OldName:string>"
INDEX = "struct<Name:string,IndexColumns:string,IncludeColumns:string,FilterExpression:string,Unique:boolean,PrimaryKey:boolean,UniqueConstraint:boolean,Clustered:boolean,ColumnStore:boolean,FillFactor:int,CompressionType:string>"
FOREIGN_KEY = "struct<Name:string,Columns:string,RelatedTableSchema:string,RelatedTable:string,RelatedColumns:string,DeleteAction:string,UpdateAction:string>"
DEFINITION = ("Schema string, Name string, OldName string, CompressionType string, IsTemporal boolean, "
              f"Columns array<{COLUMN}>, Indexes array<{INDEX}>, XmlIndexes array<struct<Name:string,Column:string,IsPrimary:boolean,PrimaryIndex:string,SecondaryIndexType:string>>, "
              f"ForeignKeys array<{FOREIGN_KEY}>, CheckConstraints array<struct<Name:string,Expression:string>>, "
              "Statistics array<struct<Name:string,Columns:string,SampleSize:int,FilterExpression:string>>, FullTextIndex struct<FullTextCatalog:string,KeyIndex:string,ChangeTracking:string,StopList:string,Columns:string>")


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """All table definitions under a folder; tables without columns are no tables."""
    defs = spark.read.schema(DEFINITION).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return defs.withColumn("Schema", F.coalesce("Schema", F.lit("dbo"))).withColumn("CompressionType", F.coalesce("CompressionType", F.lit("NONE"))).where(F.size("Columns") > 0)


def read_catalog(snapshot: DataFrame, only: DataFrame | None = None, own_schema: str = "tool") -> DataFrame:
    """Column rows (database, schema, table, column, ...) of user tables, without those that
    replication and diagrams leave among them; only(name) lists `table` or `schema.table`,
    in any case."""
    name = F.lower("table")
    made = name.isin("dtproperties", "sysdiagrams") | name.startswith("mspeer_") | name.startswith("mspub_")
    rows = snapshot.where(~F.lower("schema").isin("sys", "information_schema", own_schema.lower()) & ~made)
    if only is None:
        return rows
    names = only.select(F.lower(F.trim("name")).alias("wanted"))
    short = rows.join(names, F.lower("table") == F.col("wanted"), "left_semi")
    full = rows.join(names, F.lower(F.concat_ws(".", "schema", "table")) == F.col("wanted"), "left_semi")
    return short.unionByName(full).distinct()


CODECS = {"NONE": "uncompressed", "ROW": "snappy", "PAGE": "zstd"}


def names_of(keys: list[str]) -> list[str]:
    return [k.rsplit(" ", 1)[0] if k.upper().endswith((" DESC", " ASC")) else k for k in keys]


def ordered(keys: list[str]) -> list:
    return [F.col(k[:-5]).desc() if k.upper().endswith(" DESC") else F.col(k.removesuffix(" ASC")) for k in keys]


def write_clustered(df: DataFrame, path: str, keys: list[str], compression: str = "NONE", partitions: int | None = None) -> None:
    """Write df in ranges of its clustered key (`name` or `name DESC`), sorted inside."""
    order = ordered(keys)
    ranges = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranges.sortWithinPartitions(*order).write.option("compression", CODECS[compression.upper()]).parquet(path)


def covering_projection(df: DataFrame, keys: list[str], include: list[str] = (), where: str | None = None) -> DataFrame:
    """A narrow copy: key and included columns of rows that match, sorted by key."""
    rows = df.where(where) if where else df
    names = names_of(keys)
    return rows.select(*names, *[c for c in include if c not in names]).sortWithinPartitions(*ordered(keys))


def extract_many(spark: SparkSession, base: str, tables: dict[str, dict]) -> dict[str, DataFrame]:
    """extract for each table of {name: {keys, where}}; a missing one is logged and skipped."""
    out = {}
    for name, how in tables.items():
        try:
            df = spark.read.parquet(f"{base}/{name}.parquet")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            log.warning("table %s is missing and skipped", name)
            continue
        out[name] = extract(df, how["keys"], how.get("where"))
    return out
