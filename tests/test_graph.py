import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from ferryline.operators import edges as E
from ferryline.operators import graph as G
from ferryline.operators import hierarchy as H

EDGE = "parent string, child string"


def frames(spark, nodes, edges):
    included = spark.createDataFrame([(n,) for n in nodes], "id string")
    return included, E.clean_edges(spark.createDataFrame(edges, EDGE), included)


def levels(spark, nodes, edges):
    return {r.id: r.level for r in G.topo_levels(*frames(spark, nodes, edges)).collect()}


def test_parents_first(spark):
    found = levels(spark, ["order_items", "orders", "customers"], [("customers", "orders"), ("orders", "order_items")])
    assert found == {"customers": 0, "orders": 1, "order_items": 2}


def test_external_and_self_edges_do_not_count(spark):
    assert levels(spark, ["products", "customers"], [("external_table", "products")]) == {"products": 0, "customers": 0}
    assert levels(spark, ["employees"], [("Employees ", "employees")]) == {"employees": 0}


def test_blank_id_is_an_error(spark):
    with pytest.raises(PySparkException):
        frames(spark, ["customers"], [("customers", " ")])[1].count()


def test_strict_mode_names_the_cycle(spark):
    with pytest.raises(G.CycleError, match="a, b") as error:
        G.assert_acyclic(*frames(spark, ["a", "b", "c"], [("a", "b"), ("b", "a")]))
    assert error.value.stuck.count() == 2


def test_best_effort_plan(spark, rows):
    edges = [("tasks", "task_links"), ("task_links", "tasks"), ("tasks", "task_assignments")]
    plan = G.load_plan(*frames(spark, ["projects", "tasks", "task_links", "task_assignments"], edges))
    assert rows(plan) == [("projects", "executable", 0), ("task_assignments", "blocked", None),
                          ("task_links", "cyclic", None), ("tasks", "cyclic", None)]


def test_failures_block_what_is_below(spark, rows):
    nodes, edges = frames(spark, "abcd", [("a", "b"), ("b", "c"), ("b", "b")])
    failed = nodes.where("id = 'a'")
    assert rows(G.propagate_failures(nodes, edges, failed)) == [
        ("a", "FAILED"), ("b", "BLOCKED"), ("c", "BLOCKED"), ("d", "SUCCESS")]
    assert rows(E.blocked_by(edges, failed)) == [("b", "a")]


def brute_force(n, edges):
    below = {v: set() for v in range(n)}
    for _ in range(n + 1):
        for a, b in edges:
            below[a] |= {b} | below[b]
    cyclic = {v for v in range(n) if v in below[v]}
    stuck = cyclic | {v for v in range(n) if any(v in below[c] for c in cyclic)}
    depth = {v: 0 for v in range(n) if v not in stuck}
    for _ in range(n):
        for a, b in edges:
            if b in depth:
                depth[b] = max(depth[b], depth[a] + 1)
    return below, cyclic, stuck, depth


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 8), st.integers(0, 8)).filter(lambda e: e[0] != e[1]), max_size=14))
def test_plan_equals_brute_force(spark, edges):
    nodes = spark.range(9).select("id")
    pairs = spark.createDataFrame(list(edges), "parent bigint, child bigint")
    below, cyclic, stuck, depth = brute_force(9, edges)
    found = {r.id: (r.state, r.level) for r in G.load_plan(nodes, pairs).collect()}
    for v in range(9):
        want = ("cyclic", None) if v in cyclic else ("blocked", None) if v in stuck else ("executable", depth[v])
        assert found[v] == want
    reached = {r.id for r in G.reachable(pairs, nodes.where("id = 0")).collect()}
    assert reached == {0} | below[0]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 12)), min_size=10, max_size=10))
def test_depth_equals_walking_up(spark, parents):
    table = spark.createDataFrame(list(enumerate(parents)), "id bigint, up bigint")
    found = {r.id: r.depth for r in H.hierarchy_depth(table, "id", "up").collect()}
    for v in range(10):
        at, steps = v, 0
        while steps <= 10 and parents[at] is not None and parents[at] < 10:
            at, steps = parents[at], steps + 1
        assert found[v] == (steps if steps <= 10 else H.UNREACHED)


def test_long_chain_and_order(spark, rows):
    chain = spark.range(200).selectExpr("id", "nullif(id - 1, -1) AS up")
    assert {r.id: r.depth for r in H.hierarchy_depth(chain, "id", "up").collect()} == {i: i for i in range(200)}
    staff = spark.createDataFrame([(3, 1), (1, None), (2, 1), (4, 4), (5, 4), (6, 9)], "id int, manager_id int")
    assert [tuple(r) for r in H.hierarchy_order(staff, "id", "manager_id").collect()] == [
        (1, None, 0), (6, 9, 0), (2, 1, 1), (3, 1, 1), (4, 4, H.UNREACHED), (5, 4, H.UNREACHED)]
    assert rows(H.roots(staff, "id", "manager_id")) == [(1, None), (6, 9)]
    assert rows(H.unreached(staff, "id", "manager_id")) == [(4, 4), (5, 4)]


def test_levels_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    from ferryline.operators.rounds import Rounds

    written = []
    write = Rounds.write
    monkeypatch.setattr(Rounds, "write", lambda self, df, settled: (written.append(1), write(self, df, settled))[1])
    nodes = spark.range(300)
    chain = nodes.where("id > 0").selectExpr("id - 1 AS parent", "id AS child")
    assert {r.id: r.level for r in G.topo_levels(nodes, chain).collect()} == {i: i for i in range(300)}
    assert len(written) <= 11
    ring = chain.union(spark.range(1).selectExpr("bigint(20) AS parent", "bigint(10) AS child"))
    found = {r.id: r.level for r in G.topo_levels(nodes, ring.where("child <> 10 OR parent = 20")).collect()}
    assert found == {i: i if i < 10 else None for i in range(300)}


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        result = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_rings_and_forked_chains_take_few_jobs(spark):
    def ring(n):
        return spark.range(n).selectExpr("id AS parent", f"(id + 1) % {n} AS child")

    # a chord closes a shorter cycle; 5000 feeds the ring and 6000 hangs below it
    more = spark.createDataFrame([(1500, 100), (5000, 3), (7, 6000)], "parent bigint, child bigint")
    found, jobs = jobs_of(spark, "ring", lambda: {r.id for r in G.cycle_members(ring(2000).union(more)).collect()})
    assert found == set(range(2000)) and jobs < 250
    plain, jobs = jobs_of(spark, "plain-ring", lambda: {r.id for r in G.cycle_members(ring(2000)).collect()})
    assert plain == set(range(2000)) and jobs < 120

    nodes = spark.range(2000)
    chain = nodes.where("id > 0").selectExpr("id - 1 AS parent", "id AS child")
    forked = chain.union(spark.createDataFrame([(5, 1000), (2, 1990)], "parent bigint, child bigint"))
    found, jobs = jobs_of(spark, "chain", lambda: {r.id: r.level for r in G.topo_levels(nodes, forked).collect()})
    assert found == {i: i for i in range(2000)} and jobs < 150


def test_a_chain_of_diamonds_and_its_knot(spark):
    # a0 -> b0, c0 -> a1 -> ...; a second edge set knots the last diamond into a cycle
    edges = [e for i in range(0, 90, 3) for e in [(i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3)]]
    pairs = spark.createDataFrame(edges, "parent bigint, child bigint")
    found = {r.id: r.level for r in G.topo_levels(spark.range(91), pairs).collect()}
    assert found == {i: 2 * (i // 3) + (i % 3 > 0) for i in range(91)}
    knot = pairs.union(spark.createDataFrame([(89, 60)], "parent bigint, child bigint"))
    plan = {r.id: (r.state, r.level) for r in G.load_plan(spark.range(91), knot).collect()}
    for i in range(91):
        on = 60 <= i < 90 and i != 88
        want = ("executable", 2 * (i // 3) + (i % 3 > 0)) if i < 60 else ("cyclic", None) if on else ("blocked", None)
        assert plan[i] == want, i


def test_edges_between_contract_keys(spark, rows):
    mapping = spark.createDataFrame([(0, "s.a", "A"), (1, "s.b", "B"), (2, "s.a", "A2")],
                                    "ordinal int, source_id string, contract_key string")
    edges = spark.createDataFrame([("s.a", "s.b"), ("s.x", "s.b")], EDGE)
    assert rows(E.map_edges(edges, mapping)) == [("a2", "b")]


def test_foreign_key_rows_become_edges(spark, rows):
    fk = spark.createDataFrame([("public", "customers", "public", "orders"), ("public", "orders", "public", "orders"),
                                (None, "Customers", "", "ORDERS"), ("x", "other", "public", "orders")],
                               "pk_schema string, pk_table string, fk_schema string, fk_table string")
    included = spark.createDataFrame([("public.customers",), ("public.orders",)], "id string")
    assert rows(E.included_edges(fk, included)) == [("public.customers", "public.orders")]


def test_self_references(spark, rows):
    fk = spark.createDataFrame([
        ("e", "e", "fk1", "manager_id", "id"),
        ("two", "two", "a", "x", "id"), ("two", "two", "b", "y", "id"),
        ("wide", "wide", "a", "x", "id"), ("wide", "wide", "a", "y", "id2"), ("wide", "wide", "a", "z", "id3"),
        ("other", "e", "f", "e_id", "id"), ("plain", "plain", None, "up", "id"),
    ], "table_id string, ref_id string, fk_name string, fk_column string, pk_column string")
    assert rows(E.self_references(fk)) == [("e", "id", "manager_id"), ("plain", "id", "up")]


def test_aliases(spark, rows):
    contract = spark.createDataFrame([(0, "Clients", "crm", "people", None, "customers"), (1, "people", "x", "people", "", "")],
                                     "ordinal int, contract_key string, source_schema string, source_table string,"
                                     "target_schema string, target_table string")
    index = E.alias_index(contract)
    assert dict(rows(index)) == {"clients": "clients", "people": "clients", "crm.people": "clients",
                                 "customers": "clients", "x.people": "people"}
    names = spark.createDataFrame([("People",), (" crm.people",), ("other",), ("x.people",)], "name string")
    assert E.distinct_tables(names, index).first()[0] == 3
