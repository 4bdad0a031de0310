"""Centroid clustering by dimension-sharded Lloyd rounds.

Vectors are turned into integers, so that all sums and distances are exact, and stored
once in chunks of up to CHUNK vectors, each cut into blocks of WIDTH columns: a row holds
one chunk's block as a packed matrix. A round joins the blocks with the slice of the
centroids over the same columns, and tasks compute partial squared distances of a chunk
to all centroids over one block. The blocks' partial matrices are added by chunk (one
row per block, as many as there are blocks) and the nearest centroid is chosen; ties go
to the smaller number. The choice is joined back to the blocks, and each block's sums
per cluster, added up in the tasks first, give that block's new centroid slice. Slices
are written between rounds, which cuts lineage. The driver sees no vector and no label;
only the slices, k numbers per column whatever the data, are broadcast.

Vectors with another number of components, or with a null or non-finite one, and null
vectors are left out. Repeated ids are rows of their own; a null id is kept and its hash
comes last. With fewer kept vectors than k there are as many centroids as vectors, and
an empty table gives an empty result. Components beyond 2**26 after scaling raise an
error, as squared distances would no longer fit in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

K, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, "1"
#: Columns per block and vectors per chunk: a chunk's block has 64 kB at 8 bits a value,
#: and its partial distances, CHUNK x k, at most 512 kB.
WIDTH, CHUNK = 16, 4096
MOST = 1 << 26


def pack(a: np.ndarray) -> bytes:
    """Whole numbers in the narrowest signed width that holds them; the first byte tells it."""
    low, high = (int(a.min()), int(a.max())) if a.size else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    return bytes([width]) + np.ascontiguousarray(a, dtype=f"<i{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{data[0]}", offset=1).astype(np.int64)


def partial_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c. Floating-point products are used
    only where every sum stays below 2**53, so that they are exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.shape[1] * 4 * most * most < 1 << 53:
        x, c = x.astype(np.float64), c.astype(np.float64)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


def _cut(width: int, id_type: pa.DataType):
    schema = pa.schema([("chunk", pa.int64()), ("block", pa.int32()), ("data", pa.binary()), ("ids", pa.list_(id_type))])

    def run(batches):
        chunk = (TaskContext.get().partitionId() << 32) - 1
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                chunk += 1
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                if x.size and max(-int(x.min()), int(x.max())) > MOST:
                    raise ValueError(f"scaled components must lie within {MOST}")
                n = -(-x.shape[1] // width)
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([pack(x[:, b * width : (b + 1) * width]) for b in range(n)], pa.binary()),
                    pa.array([part.column(0).to_pylist() if b == 0 else None for b in range(n)], pa.list_(id_type))], schema=schema)

    return run


def _measure(k: int):
    """(chunk, block, data, slice) to (chunk, part): a chunk's distances over one block."""
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.binary())])

    def run(batches):
        for batch in batches:
            for chunk, data, cut in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                c = np.array(cut, dtype=np.int64).reshape(k, -1)
                part = pack(partial_distances(unpack(data).reshape(-1, c.shape[1]), c))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([part], pa.binary())], schema=schema)

    return run


def _nearest(k: int):
    """All parts of a chunk, one per block, to the nearest centroids and the distances."""
    schema = pa.schema([("chunk", pa.int64()), ("labels", pa.binary()), ("best", pa.binary())])

    def run(key, parts):
        total = sum(unpack(p) for p in parts.column("part").to_pylist()).reshape(-1, k)
        labels = total.argmin(1)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([pack(labels)], pa.binary()), pa.array([pack(total[np.arange(len(total)), labels])], pa.binary())], schema=schema)

    return run


def _sums(k: int):
    """(block, data, labels) to the sums and sizes of clusters per block and column, one
    set per task and block."""
    schema = pa.schema([("block", pa.int32()), ("cluster", pa.int32()), ("at", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])

    def run(batches):
        sums = {}
        for batch in batches:
            for block, data, labels in zip(*(batch.column(i).to_pylist() for i in range(3))):
                labels = unpack(labels)
                x = unpack(data).reshape(len(labels), -1)
                total, n = sums.setdefault(block, (np.zeros((k, x.shape[1]), dtype=np.int64), np.zeros(k, dtype=np.int64)))
                np.add.at(total, labels, x)
                n += np.bincount(labels, minlength=k)
        for block, (total, n) in sums.items():
            cluster, at = np.divmod(np.arange(total.size), total.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, block), pa.int32()), pa.array(cluster, pa.int32()), pa.array(at, pa.int32()), pa.array(total.ravel(), pa.int64()), pa.array(n[cluster], pa.int64())], schema=schema)

    return run


def _rows(id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches):
        for batch in batches:
            for ids, labels, best in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(unpack(labels), pa.int32()), pa.array(unpack(best), pa.int64())], schema=schema)

    return run


def integers(df: DataFrame, id_col: str, vector_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, x): the usable vectors, each component x as floor(scale * x)."""
    v = F.col(vector_col)
    usable = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    most = F.lit(float(MOST + 1))
    return df.where(usable).select(F.col(id_col).alias("id"), F.transform(v, lambda x: F.greatest(-most, F.least(most, F.floor(x.cast("double") * scale).cast("double"))).cast("bigint")).alias("x"))


def assign(blocks: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """(chunk, labels, best): the nearest of k centroids for every vector of a chunk."""
    slices = centroids.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("cluster", "at", "value"))).alias("s")).select(F.col("block").alias("b"), F.col("s")["value"].alias("slice"))
    # k x dims numbers: bounded by the parameters
    joined = blocks.join(F.broadcast(slices), F.col("block") == F.col("b")).select("chunk", "data", "slice")
    parts = joined.mapInArrow(_measure(k), "chunk bigint, part binary")
    return parts.groupBy("chunk").applyInArrow(_nearest(k), "chunk bigint, labels binary, best binary")


def update(blocks: DataFrame, assigned: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """New centroid slices (block, cluster, at, value); empty clusters keep theirs."""
    sums = blocks.select("chunk", "block", "data").join(assigned.select("chunk", "labels"), "chunk").select("block", "data", "labels").mapInArrow(_sums(k), "block int, cluster int, at int, total bigint, n bigint")
    new = sums.groupBy("block", "cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0")
    new = new.select("block", "cluster", "at", F.expr("(total - pmod(total, n)) div n").alias("new"))
    return centroids.join(F.broadcast(new), ["block", "cluster", "at"], "left").select("block", "cluster", "at", F.coalesce("new", "value").alias("value"))


def cluster(df: DataFrame, id_col: str, vector_col: str, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, distance) of every usable vector, and the final centroids as slices
    (block, cluster, at, value). The start are the k vectors with the smallest sha-256
    of `seed:id`."""
    whole = integers(df, id_col, vector_col, dims, scale)
    id_kind = dict(whole.dtypes)["id"]
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_kind]
    blocks = saved(whole.mapInArrow(_cut(width, id_type), f"chunk bigint, block int, data binary, ids array<{id_kind}>"), "blocks")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = whole.select(hashed.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k)
    start = saved(first.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("h").isNull().alias("last"), "h", "x"))).alias("all")), "start")
    values = start.select(F.posexplode("all").alias("cluster", "c")).select("cluster", F.posexplode("c.x").alias("i", "value"))
    centroids = saved(values.select((F.col("i") / width).cast("int").alias("block"), "cluster", (F.col("i") % width).cast("int").alias("at"), "value"), "centroids")
    k = start.select(F.size("all")).head()[0]
    for _ in range(rounds if k else 0):
        centroids = saved(update(blocks, assign(blocks, centroids, k), centroids, k).coalesce(1), "centroids")
    assigned = assign(blocks, centroids, max(k, 1))
    rows = blocks.where("ids is not null").select("chunk", "ids").join(assigned, "chunk").select("ids", "labels", "best").mapInArrow(_rows(id_type), f"id {id_kind}, cluster int, distance bigint")
    return rows, centroids


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    rows = saved(rows, "clusters")
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digest = centroids.groupBy("cluster").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"].cast("string")), ","), 256).alias("centroid_sha256"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    # a row per centroid and a single row of the total
    known = sums.join(F.broadcast(digest), "cluster").join(F.broadcast(total))
    return rows.join(F.broadcast(known), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
