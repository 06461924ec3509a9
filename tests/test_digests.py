"""Digests of ranges find what joining whole tables finds."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferryline.operators.digests import missing_by_digest
from ferryline.streaming.upsert import keep_digests, late_rows, late_rows_by_digest

LAYOUT = "k int, at double, v string"
row = st.tuples(st.one_of(st.none(), st.integers(0, 12)), st.one_of(st.none(), st.integers(0, 40).map(float), st.just(float("nan"))), st.just("x"))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(source=st.lists(row, max_size=12), target=st.lists(row, max_size=12))
def test_the_same_rows_as_a_join(spark, rows, source, target):
    """NULL and repeated keys, missing and odd cursors, keys under another cursor, empty sides."""
    s, t = spark.createDataFrame(source, LAYOUT), spark.createDataFrame(target, LAYOUT)
    have = {k for k, _, _ in target}
    want = sorted(str(r) for r in source if r[0] is None or r[0] not in have)
    got = missing_by_digest(s, t, t, "at", ["k"], [16, 4, 1])
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_one_late_row_in_a_million(spark, folder):
    rows = spark.range(1_000_000).selectExpr("id", "timestamp_seconds(1700000000 + id) AS at", "concat('v', id) AS v")
    rows.write.parquet(f"{folder}/source")
    rows.where("id <> 654321").write.parquet(f"{folder}/target")
    source, target = spark.read.parquet(f"{folder}/source"), spark.read.parquet(f"{folder}/target")
    last, widths = "2023-11-25 00:00:00", [86_400e6, 3_600e6, 60e6]
    found = late_rows_by_digest(source, target, "at", last, ["id"], widths)
    assert [tuple(r) for r in found.select("id", "v").collect()] == [(654321, "v654321")]
    assert late_rows(source, target, "at", last, ["id"]).exceptAll(found).isEmpty()


def test_an_unchanged_past_does_not_open_the_target(spark, folder):
    import shutil

    rows = spark.range(5_000).selectExpr("id", "date_add(DATE'2024-01-01', cast(id / 50 AS int)) AS at", "id % 7 AS v")
    rows.write.parquet(f"{folder}/source")
    rows.write.parquet(f"{folder}/target")
    source, target = spark.read.parquet(f"{folder}/source"), spark.read.parquet(f"{folder}/target")
    keep_digests(target, "at", "2024-03-31", ["id"], 8, f"{folder}/kept")
    kept = spark.read.parquet(f"{folder}/kept")
    shutil.move(f"{folder.removeprefix('file:')}/target", f"{folder.removeprefix('file:')}/away")  # reading it would fail
    assert late_rows_by_digest(source, target, "at", "2024-03-31", ["id"], [8, 1], kept).count() == 0
    shutil.move(f"{folder.removeprefix('file:')}/away", f"{folder.removeprefix('file:')}/target")
    more = source.union(spark.createDataFrame([(9_000, 3)], "id bigint, v bigint").selectExpr("id", "DATE'2024-02-02' AS at", "v"))
    late = late_rows_by_digest(more, target, "at", "2024-03-31", ["id"], [8, 1], kept)
    assert [(r.id, r.v) for r in late.collect()] == [(9_000, 3)]


def test_cursors_that_have_no_number_are_refused(spark):
    text = spark.range(3).select("id", F.col("id").cast("string").alias("at"))
    with pytest.raises(ValueError, match="numbers, dates or instants"):
        missing_by_digest(text, text, text, "at", ["id"], [1])
    with pytest.raises(ValueError, match="one type"):
        missing_by_digest(text, spark.range(3).withColumn("at", F.col("id")), spark.range(3).withColumn("at", F.col("id")), "at", ["id"], [1])
