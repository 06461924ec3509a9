"""Dependency edges, load order, cycles, failures, and hierarchies of rows.

The dependency graph has one node per part.  Part k depends on the parts k div 2
and k div 3, and k div 4 depends on k where k is a promoted part of size 50,
which closes a cycle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ferryline.operators import edges as E
from ferryline.operators import graph as G
from ferryline.operators import hierarchy as H
from ferryline.queries import query
from ferryline.sources.tables import scan

# --- edges -------------------------------------------------------------------
# Parts and suppliers share one name space, so a line can point a name at itself.


def _named_edges(spark, d):
    return scan(spark, "lineitem", d).select(
        F.concat(F.lit("\tN_"), "l_suppkey", F.lit(" ")).alias("parent"),
        F.concat(F.lit(" n_"), "l_partkey", F.lit("\n")).alias("child"),
    )


def _included(spark, d):
    return scan(spark, "part", d).where("p_size > 10").select(F.concat(F.lit("N_"), "p_partkey").alias("id"))


CLEAN_SQL = """
    SELECT DISTINCT 'n_' || l_suppkey AS parent, 'n_' || l_partkey AS child FROM lineitem
    WHERE l_suppkey <> l_partkey AND l_suppkey IN (SELECT p_partkey FROM part WHERE p_size > 10)
                                 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)
"""


@query("clean_edges", CLEAN_SQL)
def clean_edges(spark, d):
    return E.clean_edges(_named_edges(spark, d), _included(spark, d))


@query("ordered_names", "SELECT DISTINCT lower(p_name) AS id FROM part ORDER BY id")
def ordered_names(spark, d):
    return E.ordered_names(scan(spark, "part", d).select(F.concat(F.lit(" "), F.initcap("p_name"))))


@query("included_edges", """
    SELECT DISTINCT 'brand.t' || l_suppkey AS parent, 'public.t' || l_partkey AS child FROM lineitem
    WHERE l_suppkey IN (SELECT p_partkey FROM part WHERE p_size > 25)
      AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25)
""")
def included_edges(spark, d):
    rows = scan(spark, "lineitem", d).select(
        F.lit("Brand").alias("pk_schema"), F.concat(F.lit("T"), "l_suppkey").alias("pk_table"),
        F.lit(" ").alias("fk_schema"), F.concat(F.lit("t"), "l_partkey").alias("fk_table"),
    )
    part = scan(spark, "part", d)
    schema = F.when(F.col("p_size") > 25, "brand.t").when(F.col("p_size") < 25, "public.t").otherwise("none.t")
    return E.included_edges(rows, part.select(F.concat(schema, "p_partkey").alias("id")))


@query("map_edges", """
    WITH named AS (SELECT p_name, max_by(p_partkey, p_partkey) AS k FROM part GROUP BY p_name)
    SELECT 'k' || a.k AS parent, 'k' || b.k AS child FROM lineitem
    JOIN part p ON p.p_partkey = l_partkey JOIN part s ON s.p_partkey = l_suppkey
    JOIN named a ON a.p_name = s.p_name JOIN named b ON b.p_name = p.p_name
""")
def map_edges(spark, d):
    part = scan(spark, "part", d)
    mapping = part.select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("source_id"),
                          F.concat(F.lit(" K"), "p_partkey").alias("contract_key"))
    children = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("child"))
    parents = part.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("parent"))
    lines = scan(spark, "lineitem", d).select("l_partkey", "l_suppkey")
    edges = lines.join(children, "l_partkey").join(parents, "l_suppkey").select("parent", "child")
    return E.map_edges(edges, mapping)


@query("in_degree", f"""
    SELECT 'n_' || p_partkey AS id, coalesce(n, 0) AS n_parents FROM part
    LEFT JOIN (SELECT child, count(*) AS n FROM ({CLEAN_SQL}) GROUP BY child) ON child = 'n_' || p_partkey
""")
def in_degree(spark, d):
    nodes = scan(spark, "part", d).select(F.concat(F.lit("n_"), "p_partkey").alias("id"))
    return E.in_degree(nodes, clean_edges(spark, d))


@query("dependency_analysis", f"""
    SELECT 'n_' || p_partkey AS id, CASE WHEN parent IS NULL THEN 'independent' ELSE 'dependent' END AS kind, parent
    FROM part LEFT JOIN ({CLEAN_SQL}) ON child = 'n_' || p_partkey
""")
def dependency_analysis(spark, d):
    nodes = scan(spark, "part", d).select(F.concat(F.lit("n_"), "p_partkey").alias("id"))
    return E.dependency_analysis(nodes, clean_edges(spark, d))


@query("blocked_parents", """
    SELECT DISTINCT l_partkey AS table_id, l_suppkey AS blocked_by FROM lineitem
    JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal < 0 WHERE l_partkey <> l_suppkey
""")
def blocked_parents(spark, d):
    edges = scan(spark, "lineitem", d).select(F.col("l_suppkey").alias("parent"), F.col("l_partkey").alias("child"))
    return E.blocked_by(edges, scan(spark, "supplier", d).where("s_acctbal < 0").select("s_suppkey"))


@query("self_references", """
    WITH own AS (
        SELECT l_partkey AS t, CASE WHEN l_returnflag = 'A' THEN 'f' || l_suppkey
                                    ELSE 'c' || l_linenumber || '->p' || l_suppkey END AS fk,
               'p' || l_suppkey AS pk_column, 'c' || l_linenumber AS fk_column
        FROM lineitem WHERE l_linestatus = 'F' AND l_discount < 0.02),
    single AS (SELECT t, fk, min(pk_column) AS pk_column, min(fk_column) AS fk_column FROM own
               GROUP BY t, fk HAVING count(*) = 1)
    SELECT 't' || t AS table_id, min(pk_column) AS pk_column, min(fk_column) AS fk_column
    FROM single GROUP BY t HAVING count(*) = 1
""")
def self_references(spark, d):
    lines = scan(spark, "lineitem", d)
    own = (F.col("l_linestatus") == "F") & (F.col("l_discount") < 0.02)
    rows = lines.select(
        F.concat(F.lit("t"), "l_partkey").alias("table_id"),
        F.concat(F.when(own, "t").otherwise("other"), F.col("l_partkey")).alias("ref_id"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("f"), "l_suppkey")).otherwise("").alias("fk_name"),
        F.concat(F.lit("c"), "l_linenumber").alias("fk_column"),
        F.concat(F.lit("p"), "l_suppkey").alias("pk_column"),
    )
    return E.self_references(rows)


ALIAS_SQL = """
    entries AS (
        SELECT p_partkey, 0 AS pos, 'k' || p_partkey AS alias FROM part
        UNION ALL SELECT p_partkey, 1, p_name FROM part
        UNION ALL SELECT p_partkey, 2, lower(p_brand) || '.' || p_name FROM part
        UNION ALL SELECT p_partkey, 3, lower(p_type) FROM part
        UNION ALL SELECT p_partkey, 4, CASE WHEN p_size > 25 THEN 'tgt.' ELSE '' END || lower(p_type) FROM part),
    aliases AS (SELECT alias, 'k' || p_partkey AS canonical FROM (
        SELECT *, row_number() OVER (PARTITION BY alias ORDER BY p_partkey, pos) AS rn FROM entries) WHERE rn = 1)
"""


def _contract(spark, d):
    return scan(spark, "part", d).select(
        F.col("p_partkey").alias("ordinal"), F.concat(F.lit(" K"), "p_partkey").alias("contract_key"),
        F.col("p_brand").alias("source_schema"), F.col("p_name").alias("source_table"),
        F.when(F.col("p_size") > 25, "Tgt").alias("target_schema"), F.col("p_type").alias("target_table"),
    )


@query("alias_index", f"WITH {ALIAS_SQL} SELECT alias, canonical FROM aliases")
def alias_index(spark, d):
    return E.alias_index(_contract(spark, d))


@query("distinct_tables", f"""
    WITH {ALIAS_SQL} SELECT count(DISTINCT coalesce(canonical, n.alias)) AS n_tables
    FROM (SELECT p_name AS alias FROM part UNION ALL SELECT lower(p_brand) FROM part) n
    LEFT JOIN aliases a ON a.alias = n.alias
""")
def distinct_tables(spark, d):
    part = scan(spark, "part", d)
    names = part.select(F.upper("p_name").alias("name")).union(part.select(F.concat(F.lit(" "), "p_brand")))
    return E.distinct_tables(names, E.alias_index(_contract(spark, d)))


# --- order and cycles --------------------------------------------------------


def _graph(spark, d):
    part = scan(spark, "part", d)
    edges = part.selectExpr(
        "explode(array(struct(p_partkey div 2 AS parent, p_partkey AS child),"
        "              struct(p_partkey div 3 AS parent, p_partkey AS child),"
        "              if(p_size = 50 AND p_type = 'PROMO', struct(p_partkey AS parent, p_partkey div 4 AS child), NULL))) AS e"
    ).where("e IS NOT NULL AND e.parent <> e.child")
    return part.select(F.col("p_partkey").alias("id")), edges.select("e.parent", "e.child").distinct()


GRAPH_SQL = """
    edges AS (
        SELECT DISTINCT parent, child FROM (
            SELECT p_partkey // 2 AS parent, p_partkey AS child FROM part
            UNION ALL SELECT p_partkey // 3, p_partkey FROM part
            UNION ALL SELECT p_partkey, p_partkey // 4 FROM part WHERE p_size = 50 AND p_type = 'PROMO')
        WHERE parent <> child),
    below AS (SELECT parent AS a, child AS b FROM edges
              UNION SELECT a, child FROM below JOIN edges ON parent = b),
    cyclic AS (SELECT a AS id FROM below WHERE a = b),
    stuck AS (SELECT id FROM cyclic UNION SELECT b FROM below WHERE a IN (SELECT id FROM cyclic)),
    depths AS (SELECT p_partkey AS id, 0 AS depth FROM part
                   WHERE p_partkey NOT IN (SELECT child FROM edges)
               UNION SELECT child, depth + 1 FROM depths JOIN edges ON parent = id
                   WHERE child NOT IN (SELECT id FROM stuck)),
    levels AS (SELECT id, CAST(max(depth) AS INTEGER) AS level FROM depths GROUP BY id)
"""


@query("topo_levels", f"""
    WITH RECURSIVE {GRAPH_SQL}
    SELECT p_partkey AS id, level FROM part LEFT JOIN levels ON id = p_partkey
""")
def topo_levels(spark, d):
    return G.topo_levels(*_graph(spark, d))


@query("stuck_nodes", f"WITH RECURSIVE {GRAPH_SQL} SELECT id FROM stuck")
def stuck_nodes(spark, d):
    try:
        return G.stuck_nodes(G.assert_acyclic(*_graph(spark, d)))
    except G.CycleError as error:
        return error.stuck


@query("cycle_members", f"WITH RECURSIVE {GRAPH_SQL} SELECT id FROM cyclic")
def cycle_members(spark, d):
    return G.cycle_members(_graph(spark, d)[1])


@query("blocked_by_cycle", f"WITH RECURSIVE {GRAPH_SQL} SELECT id FROM stuck EXCEPT SELECT id FROM cyclic")
def blocked_by_cycle(spark, d):
    nodes, edges = _graph(spark, d)
    stuck = G.stuck_nodes(G.topo_levels(nodes, edges))
    return G.blocked_by_cycle(stuck, G.cycle_members(edges, stuck))


@query("load_plan", f"""
    WITH RECURSIVE {GRAPH_SQL}
    SELECT p_partkey AS id, CASE WHEN p_partkey IN (SELECT id FROM cyclic) THEN 'cyclic'
                                 WHEN p_partkey IN (SELECT id FROM stuck) THEN 'blocked' ELSE 'executable' END AS state,
           level
    FROM part LEFT JOIN levels ON id = p_partkey
""")
def load_plan(spark, d):
    return G.load_plan(*_graph(spark, d))


@query("reachable", f"""
    WITH RECURSIVE {GRAPH_SQL}
    SELECT DISTINCT id FROM (SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#7'
                             UNION ALL SELECT b FROM below JOIN part ON p_partkey = a AND p_brand = 'Brand#7')
""")
def reachable(spark, d):
    seeds = scan(spark, "part", d).where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("id"))
    return G.reachable(_graph(spark, d)[1], seeds).select("id")


@query("propagate_failures", f"""
    WITH RECURSIVE {GRAPH_SQL}
    SELECT p_partkey AS id, CASE WHEN p_size = 1 THEN 'FAILED'
        WHEN p_partkey IN (SELECT b FROM below JOIN part ON p_partkey = a AND p_size = 1) THEN 'BLOCKED'
        ELSE 'SUCCESS' END AS status
    FROM part
""")
def propagate_failures(spark, d):
    nodes, edges = _graph(spark, d)
    failed = scan(spark, "part", d).where("p_size = 1").select(F.col("p_partkey").alias("id"))
    return G.propagate_failures(nodes, edges, failed)


# --- hierarchies -------------------------------------------------------------
# Part k hangs below k div 2, except that a part of size 50 hangs below its own
# child 2k + 1: a cycle if that part exists, a root if it does not.

TREE = "CASE WHEN p_size = 50 THEN 2 * p_partkey + 1 WHEN p_partkey > 0 THEN p_partkey {div} 2 END"
TREE_SQL = f"""
    tree AS (SELECT p_partkey AS id, {TREE.format(div='//')} AS up FROM part),
    reached AS (SELECT id, 0 AS depth FROM tree WHERE up IS NULL OR up NOT IN (SELECT id FROM tree)
                UNION ALL SELECT t.id, depth + 1 FROM tree t JOIN reached r ON t.up = r.id)
"""


def _tree(spark, d):
    return scan(spark, "part", d).selectExpr("p_partkey", f"{TREE.format(div='div')} AS parent", "p_name")


@query("hierarchy_depth", f"""
    WITH RECURSIVE {TREE_SQL}
    SELECT t.id AS p_partkey, CAST(coalesce(depth, 2147483647) AS INTEGER) AS depth
    FROM tree t LEFT JOIN reached r ON r.id = t.id
""")
def hierarchy_depth(spark, d):
    return H.hierarchy_depth(_tree(spark, d), "p_partkey", "parent")


@query("hierarchy_chain", """
    SELECT conv_id * 1000 + turn AS id, CAST(turn AS INTEGER) AS depth FROM conversations
""")
def hierarchy_chain(spark, d):
    turns = scan(spark, "conversations", d).selectExpr(
        "conv_id * 1000 + turn AS id", "CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent"
    )
    return H.hierarchy_depth(turns, "id", "parent")


@query("hierarchy_order", f"""
    WITH RECURSIVE {TREE_SQL}
    SELECT p_partkey, t.up AS parent, p_name, CAST(coalesce(depth, 2147483647) AS INTEGER) AS depth
    FROM part JOIN tree t ON t.id = p_partkey LEFT JOIN reached r ON r.id = p_partkey
""")
def hierarchy_order(spark, d):
    return H.hierarchy_order(_tree(spark, d), "p_partkey", "parent")


@query("hierarchy_roots", f"""
    WITH RECURSIVE {TREE_SQL} SELECT id AS p_partkey, up AS parent FROM tree
    WHERE up IS NULL OR up NOT IN (SELECT id FROM tree)
""")
def hierarchy_roots(spark, d):
    return H.roots(_tree(spark, d), "p_partkey", "parent").select("p_partkey", "parent")


@query("hierarchy_children", f"""
    WITH RECURSIVE {TREE_SQL} SELECT id AS p_partkey, up AS parent FROM tree
    WHERE up IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')
""")
def hierarchy_children(spark, d):
    promoted = scan(spark, "part", d).where("p_type = 'PROMO'").select("p_partkey")
    return H.children_of(_tree(spark, d), promoted, "p_partkey", "parent").select("p_partkey", "parent")


@query("hierarchy_cyclic_rows", f"""
    WITH RECURSIVE {TREE_SQL} SELECT id AS p_partkey, up AS parent FROM tree WHERE id NOT IN (SELECT id FROM reached)
""")
def hierarchy_cyclic_rows(spark, d):
    return H.unreached(_tree(spark, d), "p_partkey", "parent").select("p_partkey", "parent")
