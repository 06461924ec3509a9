"""Load order, cycles and failure propagation over an edge table.

Nodes are in `nodes(id)`, edges in `edges(parent, child)` without duplicates or
self edges (see `clean_edges`).  A graph counted to fit into a block (see `blocks`)
is worked off by one task.  Larger ones go round by round: stretches without forks
are passed over by doubling, blocks are worked off side by side, and only what
goes from one block to another takes a round, written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.operators import blocks as B
from ferryline.operators.hierarchy import chase
from ferryline.operators.reach import hops_by_bitmaps
from ferryline.operators.rounds import Rounds
from ferryline.session import Scratch, materialize


SHOWN = 20  # nodes a message names


class CycleError(ValueError):
    """Strict mode met nodes that no order can free; `stuck` holds all of them."""

    def __init__(self, stuck: DataFrame):
        self.stuck = stuck
        shown = [str(row[0]) for row in stuck.orderBy("id").limit(SHOWN).collect()]
        total = stuck.count()
        among = ", ".join(shown) if total <= SHOWN else f"{', '.join(shown)} ({SHOWN} of {total}; all in .stuck)"
        super().__init__(f"no valid load order, cyclic dependency among: {among}")


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among `nodes`."""
    parents = nodes.select(F.col("id").alias("parent"))
    children = nodes.select(F.col("id").alias("child"))
    return edges.join(parents, "parent", "left_semi").join(children, "child", "left_semi")


def topo_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): longest path from a root; level is null for a node on or below a cycle.

    In a graph too large for one task, nodes with one parent hang below the nearest node above that has none or
    several, at a known distance.  Where they are the most, only the others are
    levelled, over edges that count the steps in between, and so on until the rest fits into a task or forks
    prevail.  Then blocks are peeled side by side, each to its end; a round hands what they
    freed on to other blocks, and only blocks with a node that waits for nothing are worked on.
    """
    return _levels(nodes, materialize(edges.select("parent", "child"), "edges"))


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _long_levels(nodes.select("id"), edges.select("parent", "child", F.lit(1).alias("steps")))


def _long_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels over edges(parent, child, steps), one for each pair of nodes; a node that is its own parent is never freed."""
    parents = edges.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("up"), F.max("steps").alias("hops"))
    one, more, n_edges = parents.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") > 1), F.sum("n")).first()
    if (n_edges or 0) <= B.BLOCK_ROWS and nodes.count() + (n_edges or 0) <= B.BLOCK_ROWS:
        return _freed_in_one_task(nodes, edges)
    if one < more:
        return _freed_in_blocks(nodes, edges)
    only = parents.where("n = 1").select(F.col("child").alias("id"), "up", "hops")
    hung = chase(nodes.join(only, "id", "left").select("id", "up", F.coalesce("hops", F.lit(0)).alias("hops")))
    if not more:
        return hung.select("id", F.when(F.col("root").isNotNull(), F.col("hops")).alias("level"))
    # A parent on a cycle, or below one, holds its child for ever: the child waits for itself.
    ends = hung.select(F.col("id").alias("parent"), F.col("root"), "hops")
    above = F.coalesce("root", "child")
    long_edges = edges.join(parents.where("n > 1").select("child"), "child", "left_semi").join(ends, "parent").select(
        above.alias("parent"), "child", (F.col("steps") + F.col("hops")).alias("steps"))
    long_edges = materialize(long_edges.groupBy("parent", "child").agg(F.max("steps").alias("steps")), "long-edges")
    heads = _long_levels(hung.where("root = id").select("id"), long_edges).select(
        F.col("id").alias("root"), F.col("level").alias("start"))
    return hung.join(heads, "root", "left").select("id", (F.col("start") + F.col("hops")).alias("level"))


def _counted(rows: DataFrame) -> DataFrame:
    """Nodes with what they wait for, after adding what came for them: one shuffle, summed per task before it."""
    more = [F.max(c).alias(c) for c in rows.columns if c not in ("id", "waits_for", "level")]
    return rows.groupBy("id").agg(F.sum("waits_for").alias("waits_for"), F.max("level").alias("level"), *more)


def _waiting(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    zero, one, ground = F.lit(0).cast("bigint").alias("waits_for"), F.lit(1).cast("bigint").alias("waits_for"), F.lit(0).alias("level")
    return _counted(nodes.select("id", zero, ground).union(edges.select("child", one, ground)))


def _freed_in_one_task(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    start = B.in_one_block(_waiting(nodes, edges)).select("id", "block", "waits_for", "level")
    done = materialize(B.in_blocks(start, B.in_one_block(edges), B.peel, start.schema), "levels")
    return done.select("id", F.when(F.col("waits_for") == 0, F.col("level")).alias("level"))


def _freed_in_blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    dealt = B.deal(_waiting(nodes, edges).withColumn("n_parents", F.col("waits_for")), edges)
    columns = ["id", "block", "waits_for", "level"]
    state = dealt.nodes.select(*columns)
    rounds = Rounds(nodes.sparkSession, "levels", state.schema)
    is_free = F.col("waits_for") == 0
    # No round number goes into the expressions, so every round runs the same generated code.
    minus, onward = F.lit(-1).cast("bigint").alias("waits_for"), (F.col("level") + F.col("steps")).alias("level")
    while True:
        ready = state.where(is_free).select("block").distinct()
        worked = B.in_blocks(state.join(ready, "block", "left_semi").select(*columns),
                             dealt.inside.join(ready, "block", "left_semi"), B.peel, state.schema)
        rounds.write(worked.union(state.join(ready, "block", "left_anti").select(*columns)), is_free)
        if not (rounds.any_settled() and rounds.any_open() and dealt.has_across):
            break
        freed = rounds.settled_now().select(F.col("id").alias("parent"), "level")
        served = dealt.across.join(freed, "parent").select(F.col("child").alias("id"), F.col("below").alias("block"), minus, onward)
        state = _counted(rounds.open().unionByName(served)).select(*columns)
    waiting = rounds.open().select("id", F.lit(None).cast("int").alias("level"))
    return rounds.settled().select("id", "level").unionByName(waiting)


def stuck_nodes(levels: DataFrame) -> DataFrame:
    """Nodes that no order frees: on a cycle or below one."""
    return levels.where("level IS NULL").select("id")


def assert_acyclic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Strict mode: the levels, or CycleError."""
    levels = topo_levels(nodes, edges)
    stuck = stuck_nodes(levels)
    if not stuck.isEmpty():
        raise CycleError(stuck)
    return levels


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, hops): the seeds and everything below them, by least number of edges.

    Counted to be few, seeds and edges go to one task; else see `hops_by_bitmaps`.
    """
    edges, seeds = materialize(edges.select("parent", "child"), "edges"), seeds.select("id").distinct()
    if edges.count() + seeds.count() > B.BLOCK_ROWS:
        return hops_by_bitmaps(edges, seeds)
    schema = seeds.withColumn("hops", F.lit(0)).schema
    return materialize(B.in_blocks(B.in_one_block(seeds), B.in_one_block(edges), B.hops, schema), "reachable")


def _reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))


MARKS = 4  # independent random orders of the nodes in `_split_by_labels`
ABOVE = [f"above_{i}" for i in range(MARKS)]
BELOW = [f"below_{i}" for i in range(MARKS)]


def _label_both_ways(edges: DataFrame) -> DataFrame:
    """(id, above_i, below_i): in each order, the least node above (or at) a node, and below (or at) it.

    Only labels that changed in the round before are passed on.  The orders are
    hashes of the id: they keep the repetitions in `cycle_members` logarithmic
    where the order of the ids themselves could make them many.
    """
    links = materialize(
        edges.select(F.col("parent").alias("sender"), F.col("child").alias("id"), F.lit(True).alias("down")).union(
            edges.select(F.col("child").alias("sender"), F.col("parent").alias("id"), F.lit(False).alias("down"))
        ), "links")
    marks = [F.struct(F.xxhash64("id", F.lit(i)).alias("mark"), F.col("id").alias("root")) for i in range(MARKS)]
    start = links.select("id").distinct().select(
        "id", *[m.alias(c) for m, c in zip(marks, ABOVE)], *[m.alias(c) for m, c in zip(marks, BELOW)],
        F.lit(True).alias("fresh_above"), F.lit(True).alias("fresh_below"), F.lit(True).alias("fresh"),
    )

    labels = ABOVE + BELOW

    def changed(columns: list[str]):
        return reduce(lambda left, right: left | right, [F.col(c) < F.col(f"old_{c}") for c in columns])

    scratch = Scratch(edges.sparkSession, "labels")
    state = scratch.put(start, "fresh")
    while scratch.holds("fresh=true"):
        senders = state.where("fresh").withColumnRenamed("id", "sender")
        goes_down, goes_up = F.col("down") & F.col("fresh_above"), ~F.col("down") & F.col("fresh_below")
        passed = links.join(senders, "sender").select(
            "id", *[F.when(goes_down, F.col(c)).alias(c) for c in ABOVE],
            *[F.when(goes_up, F.col(c)).alias(c) for c in BELOW], *[F.lit(None).alias(f"old_{c}") for c in labels],
        )
        kept = state.select("id", *labels, *[F.col(c).alias(f"old_{c}") for c in labels])
        step = kept.unionByName(passed).groupBy("id").agg(
            *[F.min(c).alias(c) for c in labels], *[F.min(f"old_{c}").alias(f"old_{c}") for c in labels]
        )
        step = step.select("id", *labels, changed(ABOVE).alias("fresh_above"), changed(BELOW).alias("fresh_below"))
        state = scratch.put(step.withColumn("fresh", F.col("fresh_above") | F.col("fresh_below")), "fresh")
    return state.select("id", *[F.col(f"{c}.root").alias(c) for c in ABOVE + BELOW])


def _merge_stretches(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges with each stretch of nodes that have one parent and one child shrunk to its last node, and (id, root): the
    nodes of stretches with that node.

    A stretch is on a cycle as a whole or not at all.  The root is null in a ring
    without forks; its edges drop out.  Where such nodes are fewer than the others, all stays as it is.
    """
    nothing = F.lit(None).cast(edges.schema["child"].dataType)
    ends = edges.select(F.col("child").alias("id"), F.lit(1).alias("above"), F.lit(0).alias("below"), nothing.alias("up")).union(
        edges.select(F.col("parent").alias("id"), F.lit(0), F.lit(1), F.col("child")))
    shape = ends.groupBy("id").agg(F.sum("above").alias("above"), F.sum("below").alias("below"), F.min("up").alias("up"))
    between = (F.col("above") == 1) & (F.col("below") == 1)
    passing, total = shape.agg(F.count_if(between), F.count("*")).first()
    if 2 * passing < total:
        return edges, None
    stretches = chase(shape.where(between).select("id", "up", F.lit(1).alias("hops"))).select("id", "root")
    ends = stretches.withColumn("inside", F.lit(True))
    place = F.when(F.col("inside"), F.col("root"))
    for end in ("parent", "child"):
        at = ends.select(F.col("id").alias(end), "root", "inside")
        edges = edges.join(at, end, "left").withColumn(end, F.coalesce(place, F.when(F.col("inside").isNull(), F.col(end)))).drop(
            "root", "inside")
    return edges.select("parent", "child").where("parent <> child"), stretches


PIVOTS = 32  # of each pass of `_split_by_pivots`; bits of a bigint


def _pivots(edges: DataFrame) -> list:
    """Up to `PIVOTS` nodes: those with the most ways through them, ties by a hash."""
    ends = edges.select(F.col("parent").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
        edges.select("child", F.lit(0), F.lit(1)))
    degrees = ends.groupBy("id").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    best = degrees.orderBy(F.desc(F.least("out", "into")), F.xxhash64("id")).limit(PIVOTS)
    return [row["id"] for row in best.select("id").collect()]


def _split_by_pivots(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forward and backward components of several pivots at once: (id) of those of two or more nodes, and the edges left.

    A bit for each pivot goes down and up the edges, worked off in blocks; a round hands new bits
    on to other blocks.  Nodes that get the bit of a pivot both ways make its component.  Edges
    whose ends got different bits are on no cycle and drop out.
    """
    spark = edges.sparkSession
    none = F.lit(0).cast("bigint")
    bits = spark.createDataFrame([(p, 1 << i) for i, p in enumerate(_pivots(edges))],
                                 f"id {edges.schema['parent'].dataType.simpleString()}, bit bigint")
    ends = edges.select(F.col("child").alias("id"), F.lit(1).alias("n")).union(edges.select("parent", F.lit(0)))
    dealt = B.deal(ends.groupBy("id").agg(F.sum("n").alias("n_parents")), edges)
    columns = ["id", "block", "down", "up", "new_down", "new_up"]
    own = F.coalesce("bit", none)
    state = dealt.nodes.join(F.broadcast(bits), "id", "left").select(  # as many rows as pivots
        "id", "block", own.alias("down"), own.alias("up"), own.alias("new_down"), own.alias("new_up"))
    scratch = Scratch(spark, "pivot-bits")
    is_new = (F.col("new_down") != 0) | (F.col("new_up") != 0)
    while True:
        ready = state.where(is_new).select("block").distinct()
        worked = B.in_blocks(state.join(ready, "block", "left_semi").select(*columns),
                             dealt.inside.join(ready, "block", "left_semi"), B.spread, state.schema)
        done = scratch.put(worked.union(state.join(ready, "block", "left_anti").select(*columns)).withColumn("fresh", is_new), "fresh")
        if not (scratch.holds("fresh=true") and dealt.has_across):
            break
        fresh = done.where("fresh").select("id", "new_down", "new_up")
        down = dealt.across.join(fresh.withColumnRenamed("id", "parent"), "parent").select(
            F.col("child").alias("id"), F.col("below").alias("block"), none.alias("down"), none.alias("up"), "new_down", none.alias("new_up"))
        up = dealt.across.join(fresh.withColumnRenamed("id", "child"), "child").select(
            F.col("parent").alias("id"), F.col("above").alias("block"), none.alias("down"), none.alias("up"), none.alias("new_down"), "new_up")
        known = done.select("id", "block", "down", "up", none.alias("new_down"), none.alias("new_up"))
        came = known.unionByName(down).unionByName(up).groupBy("id").agg(
            F.max("block").alias("block"), *[F.bit_or(c).alias(c) for c in columns[2:]])
        state = came.select("id", "block", *[F.col(w).bitwiseOR(F.col(f"new_{w}")).alias(w) for w in ("down", "up")],
                            *[F.col(f"new_{w}").bitwiseAND(F.bitwise_not(w)).alias(f"new_{w}") for w in ("down", "up")])
    marks = done.select("id", "down", "up", F.col("down").bitwiseAND(F.col("up")).alias("group"))
    real = marks.where("group <> 0").groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    found = marks.join(real, "group", "left_semi").select("id")
    above, below = (marks.select(F.col("id").alias(end), F.struct("down", "up").alias(f"{end}_bits"), (F.col("group") != 0).alias(f"{end}_done"))
                    for end in ("parent", "child"))
    left = edges.join(above, "parent").join(below, "child").where("NOT parent_done AND NOT child_done AND parent_bits = child_bits")
    return materialize(found, "pivot-components"), left.select("parent", "child")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those that lie only above or only below cycles."""
    for turned in (edges, _reverse(edges)):
        ends = turned.select(F.col("parent").alias("id")).union(turned.select("child")).distinct()
        edges = materialize(_within(edges, stuck_nodes(_levels(ends, turned))), "trimmed-edges")
    return edges


def _split_by_labels(inner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components that random labels tell, as (id), and the edges left: see `_label_both_ways`.

    Where the least node above and the least below are one other node, or the node
    itself and of another one besides, a node is on a cycle with it.
    """
    labels = _label_both_ways(inner)
    roots = F.array_compact(F.array(*[F.when(F.col(a) == F.col(b), F.col(a)) for a, b in zip(ABOVE, BELOW)]))
    groups = labels.select("id", F.explode(F.array_distinct(roots)).alias("root"))
    real = groups.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    settled = labels.select("id", (F.size(roots) > 0).alias("settled"), F.array(*ABOVE, *BELOW).alias("labels"))
    found = materialize(groups.join(real, "root", "left_semi").select("id").distinct(), "label-components")
    parents = settled.select(F.col("id").alias("parent"), "settled", F.col("labels").alias("parent_labels"))
    children = settled.select(F.col("id").alias("child"), F.col("labels").alias("child_labels"))
    left = inner.join(parents, "parent").join(children, "child").where("NOT settled AND parent_labels = child_labels")
    return found, left.select("parent", "child")


def cycle_members(edges: DataFrame, stuck: DataFrame | None = None) -> DataFrame:
    """Nodes on a cycle of two or more.

    Edges counted to fit into a task are searched there.  Of more, what lies only above or below cycles
    is peeled off and stretches without forks shrink to one node.  Then the components of several
    pivots are taken out, which finds a giant one at once, and what is left is trimmed, as long as that takes
    away a third of the edges; random labels tell many small components at a time.  As soon as the rest fits into
    a task, one finishes it.  No pairs of nodes are ever formed.
    """
    edges = materialize(edges.select("parent", "child"), "edges")

    def in_one_task(some: DataFrame) -> DataFrame:
        return B.in_one_block(some).groupBy("block").applyInArrow(B.on_cycles, some.select(F.col("parent").alias("id")).schema)

    if edges.count() <= B.BLOCK_ROWS:
        return materialize(in_one_task(edges), "cyclic")
    if stuck is None:
        ends = edges.select(F.col("parent").alias("id")).union(edges.select(F.col("child").alias("id"))).distinct()
        stuck = stuck_nodes(_levels(ends, edges))
    inner = materialize(_within(edges, stuck), "inner-edges")
    core = materialize(stuck_nodes(_levels(stuck, _reverse(inner))), "core")
    inner, stretches = _merge_stretches(materialize(_within(inner, core), "core-inner"))
    inner = materialize(inner, "core-edges")
    found, count, by_pivots = core.limit(0), inner.count(), True
    while count > B.BLOCK_ROWS:
        members, left = (_split_by_pivots if by_pivots else _split_by_labels)(inner)
        left = materialize(left, "core-edges")
        inner = _trimmed(left) if by_pivots else left
        found, before, count = found.union(members), count, inner.count()
        by_pivots = by_pivots and 3 * count <= 2 * before
    if count:
        found = found.union(in_one_task(inner))
    found = materialize(found.distinct(), "cyclic")
    if stretches is None:
        return found
    on_cycles = stretches.join(found.withColumnRenamed("id", "root"), "root", "left_semi").select("id")
    rings = stretches.where("root IS NULL").select("id")
    return found.join(stretches, "id", "left_anti").union(on_cycles).union(rings)


def blocked_by_cycle(stuck: DataFrame, cyclic: DataFrame) -> DataFrame:
    """Stuck nodes that are not on a cycle themselves."""
    return stuck.join(cyclic, "id", "left_anti")


def load_plan(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, state, level): executable with its level, cyclic, or blocked by a cycle."""
    edges = materialize(edges.select("parent", "child"), "edges")
    levels = materialize(_levels(nodes, edges), "plan-levels")
    cyclic = cycle_members(edges, stuck_nodes(levels)).withColumn("cyclic", F.lit(True))
    state = (
        F.when(F.col("level").isNotNull(), "executable").when(F.col("cyclic").isNotNull(), "cyclic").otherwise("blocked")
    )
    return levels.join(cyclic, "id", "left").select("id", state.alias("state"), "level")


def propagate_failures(nodes: DataFrame, edges: DataFrame, failed: DataFrame) -> DataFrame:
    """(id, status): FAILED for the failed, BLOCKED for all below them, SUCCESS for the rest."""
    reached = reachable(edges.where("parent <> child"), failed)
    status = F.when(F.col("hops").isNull(), "SUCCESS").when(F.col("hops") == 0, "FAILED").otherwise("BLOCKED")
    return nodes.join(reached, "id", "left").select("id", status.alias("status"))
