"""Plans that must hold when one key has a third of all rows."""

import pytest
from pyspark.sql import functions as F

from ferryline.operators import graph as G
from ferryline.operators import keys as K
from ferryline.operators import merge as M

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def small_limits(spark):
    """Limits so low that the test data counts as skewed, and no broadcast to hide it."""
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def lines(spark):
    """60,000 rows, 20,000 of them with key 7."""
    hot = F.when(F.col("id") < 20_000, 7).otherwise(F.col("id") % 5_000)
    return spark.range(0, 60_000, 1, 8).select("id", hot.cast("bigint").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))


def final_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_orphan_is_split(spark, small_limits, lines):
    parents = spark.range(5_000).where("id <> 7").withColumnRenamed("id", "pk")
    lost = K.orphans(lines, parents, "k", "pk")
    assert len(lost.collect()) == 20_000 + 8
    assert "skew=true" in final_plan(lost)


def test_hot_key_is_cut_down_before_the_shuffle(spark, small_limits, lines):
    newest = M.latest_per_key(lines, ["k"], ["id"])
    assert len(newest.collect()) == 5_000
    assert [kind in final_plan(newest) for kind in ("row_number(), 1, Partial", "row_number(), 1, Final")] == [True, True]


def test_duplicates_are_counted_before_the_shuffle(spark, small_limits, lines):
    found = K.key_duplicates(lines, ["k"])
    assert {r.k: r.n_rows for r in found.collect()}[7] == 20_008
    assert final_plan(found).count("HashAggregate") >= 2


def test_null_keys_bypass_the_join(spark, small_limits, lines):
    source = lines.withColumn("k", F.when(F.col("k") != 7, F.col("k")))
    merged = M.merge_upsert(lines.where("id >= 20000"), source, ["k"], ["id"])
    counts = {r.n: r.c for r in merged.groupBy(F.col("k").isNull().alias("n")).agg(F.count("*").alias("c")).collect()}
    assert counts == {True: 20_008, False: 4_999 + 8}  # the eight old rows of key 7 stay


def test_star_graph(spark, small_limits):
    """One node above a third of all others, which is also below another third."""
    nodes = spark.range(9_001)
    edges = nodes.where("id BETWEEN 1 AND 3000").selectExpr("0 AS parent", "id AS child").union(
        nodes.where("id > 6000").selectExpr("id AS parent", "0 AS child"))
    levels = G.topo_levels(nodes, edges.selectExpr("cast(parent AS bigint) parent", "cast(child AS bigint) child"))
    assert {r.level: r["count"] for r in levels.groupBy("level").count().collect()} == {0: 6_000, 1: 1, 2: 3_000}


def test_rows_leave_the_merge_in_buckets(spark, small_limits, folder):
    """Eight shuffle partitions, four buckets: each bucket is written by exactly two tasks."""
    from ferryline.sources.tables import VersionedTable

    rows = spark.range(20_000).selectExpr("id * 7 AS id").withColumn("v", F.sha2(F.col("id").cast("string"), 256))
    table = VersionedTable(spark, folder, rows.schema, ["id"], buckets=4)
    table.publish(table.stage_upsert(rows), "r")
    files = [r[0] for r in table.read().select(F.input_file_name()).distinct().collect()]
    per_bucket = {f"load_bucket={b}": sum(f"load_bucket={b}/" in f for f in files) for b in range(4)}
    assert set(per_bucket.values()) == {2} and table.count() == 20_000
