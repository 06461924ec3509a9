"""Graphs dealt into blocks that a task works off to the end, so that only edges between blocks cost a round.

A block holds neighbours in the order of the ids, of a bounded number: its nodes
and the edges inside it are at most `BLOCK_ROWS`, give or take the `HUB` parents of
one node.  The edges of a node with more parents than that stay outside, where
they are summed per task and need not meet.  A graph of no more than `BLOCK_ROWS` nodes
and edges, which is counted first, is a single block.

The functions of one block are linear in it; they see Arrow tables and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.session import materialize, new_folder, path_exists

BLOCK_ROWS = 1 << 19
HUB = 1 << 15


@dataclass
class Dealt:
    """`nodes` with their block; edges with both ends in a block (block), and the others with the blocks of both ends (above, below)."""
    nodes: DataFrame
    inside: DataFrame
    across: DataFrame
    has_across: bool


def deal(nodes: DataFrame, edges: DataFrame) -> Dealt:
    """Deal `nodes` (id, n_parents and more; at least one) and `edges` (parent, child and more) into blocks.

    The blocks are written once: later rounds see the same ones.  Edges from a parent that is no node have no
    block above.
    """
    spark = nodes.sparkSession
    count = nodes.agg(F.count("*"), F.sum(F.least("n_parents", F.lit(HUB)))).first()
    parts = max(1, -(-(count[0] + (count[1] or 0)) // BLOCK_ROWS))
    ranged = materialize(nodes.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()), "ranged-nodes")
    before = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.when(F.col("n_parents") <= HUB, 1 + F.col("n_parents")).otherwise(1)
    upto = F.coalesce(F.sum(weight).over(before), F.lit(0))
    block = F.shiftleft(F.col("part").cast("bigint"), 24) + F.floor(upto / BLOCK_ROWS)
    dealt = materialize(ranged.withColumn("block", block).drop("part"), "dealt-nodes")
    parents = dealt.select(F.col("id").alias("parent"), F.col("block").alias("above"))
    children = dealt.select(F.col("id").alias("child"), F.col("block").alias("below"), (F.col("n_parents") > HUB).alias("hub"))
    inside = F.coalesce((F.col("above") == F.col("below")) & ~F.col("hub"), F.lit(False))
    placed = edges.join(children, "child").join(parents, "parent", "left").withColumn("inside", inside).drop("hub")
    names = [c for c in placed.columns if c != "inside"]
    path = new_folder(spark, "dealt-edges")
    placed.write.partitionBy("inside").parquet(path)
    written = spark.read.schema(T.StructType([*placed.select(*names).schema, T.StructField("inside", T.BooleanType())])).parquet(path)
    within = written.where("inside").select(*[c for c in names if c not in ("above", "below")], F.col("below").alias("block"))
    across = written.where("NOT inside").select(*names)
    return Dealt(dealt, within, across, path_exists(spark, f"{path}/inside=false"))


def in_one_block(df: DataFrame) -> DataFrame:
    return df.withColumn("block", F.lit(0).cast("bigint"))


def in_blocks(nodes: DataFrame, edges: DataFrame, work: Callable, schema: T.StructType) -> DataFrame:
    """`work`(nodes, edges) of each block that has nodes."""
    return nodes.groupBy("block").cogroup(edges.groupBy("block")).applyInArrow(work, schema)


def _listed(ids, edges: pa.Table, source: str = "parent", goal: str = "child") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges by their source's place in `ids`: where those of each source start, their goals' places, their places in `edges`.

    Edges with an end that is not among `ids` (any more) are left out.
    """
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    sources, goals = (pc.index_in(edges[c], value_set=ids).fill_null(-1).to_numpy() for c in (source, goal))
    order = np.argsort(sources, kind="stable")
    order = order[(sources[order] >= 0) & (goals[order] >= 0)]
    return np.searchsorted(sources[order], np.arange(len(ids) + 1)), goals[order], order


def peel(nodes: pa.Table, edges: pa.Table) -> pa.Table:
    """Nodes (id, block, waits_for, level) after freeing all that wait for nothing, and what that frees inside the block, and so on."""
    starts, below, order = _listed(nodes["id"], edges)
    starts, below, steps = starts.tolist(), below.tolist(), edges["steps"].to_numpy()[order].tolist()
    waits, level = nodes["waits_for"].to_pylist(), nodes["level"].to_pylist()
    free = [i for i, n in enumerate(waits) if n == 0]
    for i in free:  # grows while it is walked
        for e in range(starts[i], starts[i + 1]):
            c = below[e]
            level[c] = max(level[c], level[i] + steps[e])
            waits[c] -= 1
            if not waits[c]:
                free.append(c)
    return pa.table({"id": nodes["id"], "block": nodes["block"], "waits_for": pa.array(waits, pa.int64()), "level": pa.array(level, pa.int32())})


def spread(nodes: pa.Table, edges: pa.Table) -> pa.Table:
    """Nodes (id, block, down, up, new_down, new_up: bits) after passing new bits on, down and up the edges inside the block.

    What a node has passed on inside the block, the bits it came with included, stays in new_down and new_up.
    """
    columns = {"id": nodes["id"], "block": nodes["block"]}
    for way, (source, goal) in (("down", ("parent", "child")), ("up", ("child", "parent"))):
        starts, goals, _ = (x.tolist() for x in _listed(nodes["id"], edges, source, goal))
        bits, gained = nodes[way].to_pylist(), nodes[f"new_{way}"].to_pylist()
        waiting = list(gained)
        open_nodes = [i for i, new in enumerate(gained) if new]
        while open_nodes:
            i = open_nodes.pop()
            passed, waiting[i] = waiting[i], 0
            for e in range(starts[i], starts[i + 1]):
                c = goals[e]
                new = passed & ~bits[c]
                if new:
                    if not waiting[c]:
                        open_nodes.append(c)
                    bits[c] |= new
                    waiting[c] |= new
                    gained[c] |= new
        columns |= {way: pa.array(bits, pa.int64()), f"new_{way}": pa.array(gained, pa.int64())}
    return pa.table({c: columns[c] for c in ("id", "block", "down", "up", "new_down", "new_up")})


def on_cycles(edges: pa.Table) -> pa.Table:
    """(id): the nodes in a strongly connected component of two or more, by one walk in depth (Tarjan's algorithm)."""
    ids = pc.unique(pa.chunked_array([*edges["parent"].chunks, *edges["child"].chunks], type=edges["parent"].type))
    starts, below, _ = (x.tolist() for x in _listed(ids, edges))
    n, clock, members = len(ids), 0, []
    seen, low, held, at, open_nodes = [0] * n, [0] * n, [False] * n, starts[:-1], []
    for root in range(n):
        way = [] if seen[root] else [root]
        while way:
            v = way[-1]
            if not seen[v]:
                clock += 1
                seen[v] = low[v] = clock
                held[v] = True
                open_nodes.append(v)
            if at[v] < starts[v + 1]:
                w = below[at[v]]
                at[v] += 1
                if not seen[w]:
                    way.append(w)
                elif held[w]:
                    low[v] = min(low[v], seen[w])
                continue
            way.pop()
            if way:
                low[way[-1]] = min(low[way[-1]], low[v])
            if low[v] == seen[v]:
                cut = len(open_nodes) - 1
                while open_nodes[cut] != v:
                    cut -= 1
                group = open_nodes[cut:]
                del open_nodes[cut:]
                for w in group:
                    held[w] = False
                if len(group) > 1:
                    members += group
    return pa.table({"id": ids.take(pa.array(members, pa.int64()))})


def hops(seeds: pa.Table, edges: pa.Table) -> pa.Table:
    """(id, hops): the seeds and all below them, by least number of edges."""
    ids = pc.unique(pa.chunked_array([*seeds["id"].chunks, *edges["parent"].chunks, *edges["child"].chunks], type=seeds["id"].type))
    starts, below, _ = (x.tolist() for x in _listed(ids, edges))
    found = pc.unique(pc.index_in(seeds["id"], value_set=ids)).to_pylist()
    far = [-1] * len(ids)
    for i in found:
        far[i] = 0
    for i in found:  # grows while it is walked
        for c in below[starts[i] : starts[i + 1]]:
            if far[c] < 0:
                far[c] = far[i] + 1
                found.append(c)
    return pa.table({"id": ids.take(pa.array(found, pa.int64())), "hops": pa.array([far[i] for i in found], pa.int32())})
