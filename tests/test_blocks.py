"""Graphs too large for one task, by making tasks small: blocks, pivots and bitmaps against brute force, and what they cost."""

import os
import random

import pytest

from ferryline.operators import blocks as B
from ferryline.operators import graph as G
from ferryline.operators import reach as R
from test_graph import brute_force, jobs_of

PAIR = "parent bigint, child bigint"


@pytest.fixture
def small_blocks(monkeypatch):
    def to(rows, hub=1 << 15):
        monkeypatch.setattr(B, "BLOCK_ROWS", rows)
        monkeypatch.setattr(B, "HUB", hub)

    return to


def graphs():
    rng = random.Random(3)
    near = {(a, min(a + rng.randint(1, 4), 59)) for a in range(59) for _ in range(2)} - {(59, 59)}
    far = {(rng.randrange(60), rng.randrange(60)) for _ in range(90)}
    hub = {(a, 30) for a in range(25)} | {(30, b) for b in range(31, 60)} | {(40, 3), (3, 8), (50, 51), (51, 50)}
    return [sorted(near), sorted(near | {(40, 21), (57, 55)}), sorted((a, b) for a, b in far if a != b), sorted(hub)]


@pytest.mark.parametrize("edges", graphs()[1::2], ids=["chains with cycles", "hub"])
def test_plans_in_blocks_equal_brute_force(spark, small_blocks, edges):
    small_blocks(40, 5)
    below, cyclic, stuck, depth = brute_force(60, edges)
    nodes, pairs = spark.range(60), spark.createDataFrame(edges, PAIR)
    plan = {r.id: (r.state, r.level) for r in G.load_plan(nodes, pairs).collect()}
    assert plan == {v: ("cyclic", None) if v in cyclic else ("blocked", None) if v in stuck else ("executable", depth[v]) for v in range(60)}


@pytest.mark.parametrize("edges", graphs()[2:], ids=["random", "hub"])
def test_hops_by_bitmaps_equal_a_walk(spark, small_blocks, monkeypatch, edges):
    small_blocks(10)
    monkeypatch.setattr(R, "PART_BITS", 3)
    seeds = [5, 33, 33, 70]
    far, ahead = {s: 0 for s in seeds}, sorted(set(seeds))
    while ahead:
        ahead = sorted({b for a, b in edges if a in ahead and b not in far} and {b for a, b in edges if a in ahead} - set(far))
        far |= {b: max(far.values()) + 1 for b in ahead}
    found = G.reachable(spark.createDataFrame([(str(a), str(b)) for a, b in edges], "parent string, child string"),
                        spark.createDataFrame([(str(s),) for s in seeds], "id string"))
    assert {int(r.id): r.hops for r in found.collect()} == far


def test_numbers_on_the_borders_of_bitmaps(spark, small_blocks):
    small_blocks(10)
    chain = spark.range(0, 70_000, 1, 2).selectExpr("id AS parent", "id + 1 AS child").where(
        "parent % 32768 IN (0, 32766, 32767) OR parent % 8 = 7 OR child = 5")
    seeds = spark.createDataFrame([(0,), (32_766,), (4,), (65_534,), (7,)], "id bigint")
    found = {r.id: r.hops for r in G.reachable(chain, seeds).collect()}
    assert found == {0: 0, 1: 1, 4: 0, 5: 1, 7: 0, 8: 1, 32_766: 0, 32_767: 1, 32_768: 2, 32_769: 3, 65_534: 0, 65_535: 1, 65_536: 2, 65_537: 3}


def forked(spark, levels):
    """Two nodes a level, each below both of the level before; 2 x levels nodes in the order of the levels."""
    return spark.range(2, 2 * levels).selectExpr("explode(array(2 * (id div 2) - 2, 2 * (id div 2) - 1)) AS parent", "id AS child")


def test_a_forked_graph_of_a_thousand_levels_takes_few_jobs(spark, small_blocks):
    nodes, edges = spark.range(2000), forked(spark, 1000)
    want = {i: i // 2 for i in range(2000)}
    found, jobs = jobs_of(spark, "one-task", lambda: {r.id: r.level for r in G.topo_levels(nodes, edges).collect()})
    assert found == want and jobs <= 12
    small_blocks(1500)  # four blocks at least, and no level has a job of its own
    found, jobs = jobs_of(spark, "blocks", lambda: {r.id: r.level for r in G.topo_levels(nodes, edges).collect()})
    assert found == want and jobs <= 100


def test_a_forked_ring_takes_few_jobs(spark, small_blocks):
    n = 5000
    ring = spark.range(n).selectExpr("id AS parent", f"explode(array((id + 1) % {n}, (id + 2) % {n})) AS child")
    more = ring.union(spark.createDataFrame([(7000, 3), (9, 8000), (8000, 8001)], PAIR))
    found, jobs = jobs_of(spark, "ring", lambda: {r.id for r in G.cycle_members(more).collect()})
    assert found == set(range(n)) and jobs < 30
    small_blocks(4000)
    found, jobs = jobs_of(spark, "ring-blocks", lambda: {r.id for r in G.cycle_members(more).collect()})
    assert found == set(range(n)) and jobs < 250


def test_many_small_cycles_are_told_by_labels(spark, small_blocks):
    """More components than pivots: labels finish what pivots can't."""
    small_blocks(50)
    rings = spark.range(150).selectExpr("id AS parent", "IF(id % 3 = 2, id - 2, id + 1) AS child")
    chords = spark.range(0, 150, 3).selectExpr("id + 1 AS parent", "id AS child")
    bridges = spark.range(0, 147, 3).selectExpr("id AS parent", "id + 3 AS child")
    edges = rings.union(chords).union(bridges)
    assert {r.id for r in G.cycle_members(edges).collect()} == set(range(150))


def test_a_hop_reads_what_its_frontier_touches(spark, small_blocks, monkeypatch):
    small_blocks(10)
    monkeypatch.setattr(R, "PART_BITS", 8)
    reads = []
    plain = R._Parts.read

    def size(path):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))

    def read(self, parts=None, last=False):
        if parts is not None:
            name = os.path.basename(self.folder).split("-")[0]
            below = [os.path.join(d, s) for d, subs, _ in os.walk(self.folder.removeprefix("file:")) for s in subs
                     if s.startswith("part=") and int(s[5:]) in parts]
            reads.append((name, sum(map(size, below)), size(self.folder.removeprefix("file:"))))
        return plain(self, parts, last)

    monkeypatch.setattr(R._Parts, "read", read)
    far = spark.range(0, 20_000).selectExpr("id AS parent", "id + 20000 AS child")  # a crowd that the seeds don't reach
    chain = spark.range(100_000, 100_006).selectExpr("id AS parent", "id + 1 AS child")
    found = {r.id: r.hops for r in G.reachable(far.union(chain), spark.createDataFrame([(100_000,)], "id bigint")).collect()}
    assert found == {100_000 + i: i for i in range(7)}
    links = [r for r in reads if r[0] == "links"]
    assert len(links) == 7 and all(read * 20 < whole for _, read, whole in links)
