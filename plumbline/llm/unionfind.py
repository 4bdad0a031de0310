"""Links among the members of shared buckets, and their connected components.

Components come from alternating large-star and small-star steps. Labels never leave
the executors; each round is a partial minimum per node and a join that Spark may split
where a node has very many neighbours. Rounds are written to the shared folder, so a
lost executor costs one round at most."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b), the component being its
    smallest node. Loops and repeated edges do no harm; no edges give no rows."""
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = saved(both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # stars: every node points at one root, and no root points anywhere
        inner = e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
        if inner.unionByName(e.groupBy("u").count().where("count > 1").select("u")).isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Members up to which a bucket is compared pair by pair.
FEW = 8
#: Cells of a block of members that are compared with those of another block in one task.
BLOCK_CELLS = 200_000


def _pairs_of_few(members: DataFrame) -> DataFrame:
    """All pairs of buckets with at most FEW members, each list being that short."""
    few = members.where(F.col("n") <= FEW).groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("l")).select("l").distinct()
    a = few.select("l", F.posexplode("l").alias("i", "a"))
    return a.select("a", F.explode(F.slice("l", F.col("i") + 2, FEW)).alias("b"))


def _compared(cells, t: float):
    """(a, b): links between the rows of a unit, fewest that join what is linked. Rows are
    sorted by unit; `own` ones are compared with all of the unit, `joined` ones are known to
    be in one component. cells(payloads) gives the distinct cells of each."""
    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        nodes, joined, own = ([r[i] for r in rows] for i in (3, 4, 5))
        sets = cells([r[6] for r in rows])
        sizes = np.array([len(x) for x in sets])
        starts = np.cumsum(sizes) - sizes
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
        mark = np.zeros(int(flat.max()) + 1, np.int32)
        group = np.arange(len(rows))
        group[np.array(joined)] = int(np.argmax(joined)) if any(joined) else 0
        found = []
        for k in np.flatnonzero(own):
            mine = flat[starts[k] : starts[k] + sizes[k]]
            mark[mine] = 1
            common = np.add.reduceat(mark[flat], starts)
            mark[mine] = 0
            for j in np.flatnonzero(common >= t * (sizes + sizes[k])):
                if group[j] != group[k]:
                    group[group == group[j]] = group[k]
                    found.append((nodes[k], nodes[j]))
        return found

    def run(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, unit in groupby(rows, key=lambda r: r[:3]):
            if found := links(list(unit)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return run


def _units(led: DataFrame) -> DataFrame:
    """(leader, p, q, node, joined, own) for led(leader, node, size, joined): where members
    are compared. A group of up to BLOCK_CELLS cells is one unit. Of a larger one those not
    joined to the leader make blocks, each of which meets every block of the group."""
    of = led.groupBy("leader").agg(F.sum("size").alias("cells"), F.sum(F.when(~F.col("joined"), F.col("size"))).alias("loose"), F.count(F.when(~F.col("joined"), 1)).alias("n")).where("n > 0")
    one = F.col("cells") <= BLOCK_CELLS

    def blocks(cells: Column) -> Column:
        return F.ceil(cells / BLOCK_CELLS).cast("int")

    rows = led.join(of, "leader").withColumn("h", F.xxhash64("node")).withColumn("a", F.when(one, 1).otherwise(blocks(F.col("loose"))))
    rows = rows.withColumn("b", F.when(one, 0).otherwise(blocks(F.col("cells") - F.col("loose"))))
    at = F.pmod("h", F.when(F.col("joined"), F.greatest("b", F.lit(1))).otherwise(F.col("a"))).cast("int")
    rows = rows.withColumn("at", at)
    loose = F.transform(F.sequence(F.lit(0), F.col("a") + F.col("b") - 1), lambda x: F.struct(F.when(x < F.col("a"), F.least(x, F.col("at"))).otherwise(F.col("at")).alias("p"), F.when(x < F.col("a"), F.greatest(x, F.col("at"))).otherwise(x).alias("q")))
    firm = F.when(one, F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("a") - 1), lambda x: F.struct(x.alias("p"), (F.col("a") + F.col("at")).alias("q"))))
    unit = rows.select("leader", "node", "joined", "at", F.explode(F.when(F.col("joined"), firm).otherwise(loose)).alias("u"))
    return unit.select("leader", "u.p", "u.q", "node", "joined", (~F.col("joined") & (F.col("u.p") == F.col("at"))).alias("own"))


def links_of_buckets(members: DataFrame, measured, nodes: DataFrame, cells, similarity: float) -> DataFrame:
    """(a, b): pairs of nodes of Jaccard similarity `similarity` or more which connect all
    that are linked inside a bucket, from distinct members(key, node).

    measured(pairs(a, b), a < b) gives (a, b, common, na, nb): how many cells two nodes have
    in common and how many each has. nodes is (node, payload), and cells(payloads) turns
    payloads into arrays of distinct cells.

    Buckets of at most FEW members are compared pair by pair. In a larger one the member
    with most fellows leads and is measured against the others. Those not linked to it are
    then compared with all fellows, block by block, each block being one task's work; what is
    linked to the leader already needs no more comparing. So a group of n copies makes n
    pairs, nothing is emitted per pair of a group, and no link that a bucket holds is lost."""
    t = similarity / (1 + similarity)
    counted = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = saved(members.join(counted, "key"), "members")
    large = members.where(F.col("n") > FEW)
    degree = large.groupBy("node").agg(F.sum("n").alias("degree"))
    large = saved(large.join(degree, "node").select("key", "node", "degree"), "large")
    first = large.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("top")).select("key", F.col("top.node").alias("leader"))
    led = saved(large.join(first, "key").where("node <> leader").select("leader", "node").distinct(), "led")
    pairs = _pairs_of_few(members).unionByName(led.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))).distinct()
    m = saved(measured(pairs), "measured")
    links = F.col("common") >= t * (F.col("na") + F.col("nb"))
    both = m.select(F.col("a").alias("leader"), F.col("b").alias("node"), F.col("nb").cast("long").alias("size"), links.alias("joined"))
    both = both.unionByName(m.select(F.col("b").alias("leader"), F.col("a").alias("node"), F.col("na").cast("long").alias("size"), links.alias("joined")))
    units = _units(saved(led.join(both, ["leader", "node"]), "groups"))
    payload = [c for c in nodes.columns if c != "node"][0]
    rows = units.join(nodes, "node").select("leader", "p", "q", "node", "joined", "own", payload)
    found = rows.repartition("leader", "p", "q").sortWithinPartitions("leader", "p", "q").mapInArrow(_compared(cells, t), "a long, b long")
    return saved(m.where(links).select("a", "b").unionByName(found), "links")
