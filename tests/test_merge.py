import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferryline.operators import merge as M
from ferryline.sources.buckets import BucketedTable
from ferryline.sources.tables import VersionedTable

LAYOUT = "k int, part string, seq int, value string"
row = st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.sampled_from("ab"), st.integers(0, 3), st.sampled_from("xyz"))


def upserted(target, source):
    """Brute force: rows applied one by one in order."""
    order = sorted(source, key=lambda r: (r[2], r[3]))
    table = {r[:2]: r for r in target}
    extra = []
    for r in order:
        if r[0] is None:
            extra.append(r)
        else:
            table[r[:2]] = r
    return sorted(map(str, list(table.values()) + extra))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(target=st.lists(row.filter(lambda r: r[0] is not None), max_size=6, unique_by=lambda r: r[:2]),
       source=st.lists(row, max_size=12))
def test_merge_equals_brute_force(spark, target, source):
    old, new = spark.createDataFrame(target, LAYOUT), spark.createDataFrame(source, LAYOUT)
    once = M.merge_upsert(old, new, ["k", "part"], ["seq"])
    assert sorted(str(tuple(r)) for r in once.collect()) == upserted(target, source)


def test_upsert_twice_is_once(spark, rows):
    old = spark.createDataFrame([(1, "a", 0, "x"), (2, "a", 0, "x")], LAYOUT)
    new = spark.createDataFrame([(2, "a", 1, "y"), (2, "a", 2, "z"), (3, "b", 0, "x")], LAYOUT)
    once = M.merge_upsert(old, new, ["k", "part"], ["seq"])
    assert rows(once) == rows(M.merge_upsert(once, new, ["k", "part"], ["seq"]))


def test_no_key_is_an_error(spark):
    df = spark.createDataFrame([], LAYOUT)
    with pytest.raises(ValueError):
        M.merge_upsert(df, df, [" ", None])


def test_merge_changes(spark, rows):
    old = spark.createDataFrame([(1, "a", 0, None), (2, "a", 0, "x")], LAYOUT)
    new = spark.createDataFrame([(1, "a", 0, None), (2, "a", 0, "y"), (3, "a", 0, "x"), (None, "a", 0, "x")], LAYOUT)
    found = M.merge_changes(old, new, ["k", "part"]).select("k", "change")
    assert rows(found) == [(None, "insert"), (1, "unchanged"), (2, "update"), (3, "insert")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batches=st.lists(st.lists(row, max_size=8), min_size=1, max_size=3))
def test_versioned_table_equals_brute_force(spark, batches):
    from ferryline.session import new_folder

    schema = spark.createDataFrame([], LAYOUT).schema
    table = VersionedTable(spark, new_folder(spark, "merge"), schema, ["k", "part"], buckets=3)
    want, nulls = [], []
    for i, batch in enumerate(batches):
        staged = table.stage_upsert(spark.createDataFrame(batch, LAYOUT), None, ["seq"], small_batch=True)
        before = sorted(str(tuple(r)) for r in table.read().collect())
        assert before == sorted(map(str, want + nulls))  # staged rows are not visible yet
        table.publish(staged, f"run-{i}")
        nulls += [r for r in batch if r[0] is None]
        done = upserted(want, [r for r in batch if r[0] is not None])
        want = [eval(r) for r in done]
        assert staged.rows_after == table.count() == len(want) + len(nulls)
    assert sorted(str(tuple(r)) for r in table.read().collect()) == sorted(map(str, want + nulls))


def test_small_batch_leaves_other_buckets_alone(spark, folder):
    schema = spark.createDataFrame([], LAYOUT).schema
    table = VersionedTable(spark, folder, schema, ["k"], buckets=16)
    table.publish(table.stage_upsert(spark.range(100).selectExpr("cast(id AS int) k", "'a' part", "0 seq", "'x' value")), "1")
    staged = table.stage_upsert(spark.createDataFrame([(7, "b", 1, "y")], LAYOUT), small_batch=True)
    assert staged.view.base == 1 and list(staged.view.since.values()) == [2]
    assert (staged.rows_before, staged.rows_after) == (100, 100)
    table.publish(staged, "2")
    assert table.read().where("k = 7").first().part == "b"
    assert table.commit_of("1")["version"] == 1 and table.commit_of("none") is None


def test_append_adds_every_row(spark, folder):
    schema = spark.createDataFrame([], LAYOUT).schema
    table = VersionedTable(spark, folder, schema)
    for i in range(2):
        table.publish(table.stage_append(spark.createDataFrame([(1, "a", 0, "x")] * 3, LAYOUT)), f"{i}")
    assert table.count() == table.read().count() == 6


def test_checked_keys_are_read_less(spark, rows, tmp_path):
    old = [(1, "a", 0, "x"), (None, "a", 0, "x"), (2, "a", 0, "x")]
    spark.createDataFrame(old, LAYOUT).write.parquet(f"{tmp_path}/target")
    spark.createDataFrame([(2, "a", 1, "y"), (2, "a", 2, "z"), (3, "b", 0, "x")], LAYOUT).write.parquet(f"{tmp_path}/source")
    target, source = spark.read.parquet(f"{tmp_path}/target"), spark.read.parquet(f"{tmp_path}/source")
    merged = M.merge_upsert(target, source, ["k", "part"], ["seq"], keys_set=True)
    assert rows(merged) == rows(M.merge_upsert(target, source, ["k", "part"], ["seq"]))
    plan = merged._jdf.queryExecution().sparkPlan().toString()
    assert plan.count(f"{tmp_path}/target") <= 2 and plan.count(f"{tmp_path}/source") <= 2
    assert plan.count("FileScan parquet") == 4


def exchanges_above(df, source: str) -> int:
    """Shuffles on the way from a scan of `source` up to the root of the plan."""
    depth, found = None, 0
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    for line in reversed(lines):
        indent = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if depth is None:
            depth = indent if "FileScan" in line and source in line else None
        elif indent < depth:
            depth = indent
            found += "Exchange" in line
    assert depth is not None
    return found


def test_a_bucketed_target_is_not_shuffled(spark, folder):
    old = spark.range(5_000).selectExpr("id AS k", "concat('old', id) AS v", "0L AS seq")
    new = spark.range(4_000, 6_000).selectExpr("id AS k", "concat('new', id) AS v", "id % 3 AS seq")
    table = BucketedTable(spark, folder, old.schema, ["k"], buckets=16)
    assert table.version() == 0 and table.read().count() == 0
    assert table.upsert(old, "r1") == 1
    merged = table.merged(new.union(new.selectExpr("k", "'older'", "-1L")), ["seq"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges_above(merged, table._name(1)) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    table.upsert(new.union(new.selectExpr("k", "'older'", "-1L")), "r2", ["seq"])
    again = BucketedTable(spark, folder, old.schema, ["k"], buckets=16)
    assert again.version() == 2
    found = {r.k: r.v for r in again.read().collect()}
    assert found == {i: f"old{i}" if i < 4_000 else f"new{i}" for i in range(6_000)}
    files = [r[0] for r in again.read().selectExpr("input_file_name()").distinct().collect()]
    assert len(files) == 16  # a file a bucket


def test_a_bucketed_target_gets_more_buckets_as_it_grows(spark, folder, monkeypatch):
    from ferryline.sources import buckets

    monkeypatch.setattr(buckets, "BUCKET_ROWS", 100)
    table = BucketedTable(spark, folder, spark.range(1).selectExpr("id AS k", "'' AS v").schema, ["k"], buckets=2)
    want = {}
    for first, last, expected in ((0, 150, 2), (100, 900, 8), (850, 910, 16), (0, 5, 16)):  # 900 rows by the third
        table.upsert(spark.range(first, last).selectExpr("id AS k", f"'{last}' AS v"), f"r{last}")
        want |= {i: str(last) for i in range(first, last)}
        again = BucketedTable(spark, folder, table.schema, ["k"], buckets=2)
        spark.sql(f"DROP TABLE {table._name(table.version())}")  # as in another session
        assert {r.k: r.v for r in again.read().collect()} == want and again._published()[1] == expected
        files = again.read().groupBy(F.input_file_name().alias("f")).count().collect()
        assert expected // 2 < len(files) <= expected and max(r["count"] for r in files) < 200
    assert again.version() == 4


def test_another_session_declares_the_buckets_anew(spark, folder):
    rows = spark.range(100).selectExpr("id AS k", "named_struct('a', id, 'b', array(id)) AS v")
    BucketedTable(spark, folder, rows.schema, ["k"], buckets=4).upsert(rows, "r")
    table = BucketedTable(spark, folder, rows.schema, ["k"], buckets=4)
    spark.sql(f"DROP TABLE {table._name(1)}")
    assert table.read().count() == 100
    assert table.upsert(rows.where("k < 10"), "r2") == 2 and table.read().count() == 100


def test_a_bucketed_key_must_be_set(spark, folder):
    rows = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    with pytest.raises(Exception, match="must not be NULL"):
        BucketedTable(spark, folder, rows.schema, ["k"], buckets=2).upsert(rows, "r")


def test_a_source_is_read_once_for_its_null_keys(spark, folder):
    spark.range(100).selectExpr("nullif(id % 7, 3) AS k", "id AS seq").write.parquet(folder)
    source = spark.read.parquet(folder)
    kept = M.rows_to_write(source, ["k"], ["seq"])
    assert kept._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted((r.k is None, r.seq) for r in kept.collect()) == sorted(
        [(True, i) for i in range(100) if i % 7 == 3] + [(False, max(i for i in range(100) if i % 7 == k)) for k in (0, 1, 2, 4, 5, 6)])
