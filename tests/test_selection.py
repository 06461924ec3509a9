import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.operators import selection as S


@pytest.fixture
def orders(spark):
    day = dt.datetime(2026, 1, 1)
    data = [(i, day + dt.timedelta(days=i // 3), i % 2 == 0) for i in range(30)] + [(99, None, True)]
    return spark.createDataFrame(data, "id int, updated_at timestamp_ntz, active boolean")


def test_full_filter(orders):
    assert S.where(orders, "active = true").count() == 16
    assert S.where(orders, " ").count() == 31


def test_cursor_is_strict_and_skips_nulls(orders):
    taken = S.after_cursor(orders, "updated_at", "2026-01-05T00:00:00")
    assert taken.count() == 15 and taken.where("updated_at IS NULL").count() == 0


def test_filter_with_or_stays_inside_the_cursor_bound(orders):
    rows = S.where(S.after_cursor(orders, "updated_at", "2026-01-05"), "id = 0 OR active")
    assert rows.where("updated_at <= '2026-01-05'").count() == 0


def test_quote_in_a_cursor_is_never_sql(orders):
    with pytest.raises(PySparkException):
        S.after_cursor(orders, "updated_at", "2026-05-01T10:00:00' OR '1'='1").count()


@pytest.mark.parametrize("column, start", [(None, "2026-01-01"), ("", "2026-01-01"), ("updated_at", None)])
def test_missing_cursor_or_start_is_an_error(orders, column, start):
    with pytest.raises(ValueError):
        S.after_cursor(orders, column, start)


def test_batch_of_exactly_n(orders):
    batch = S.next_batch(orders, "updated_at", "2026-01-01", n=7, tie_break=["id"])
    assert [r.id for r in batch.collect()] == list(range(3, 10))
    with pytest.raises(ValueError):
        S.next_batch(orders, "updated_at", "2026-01-01", n=0)


def test_batch_keeps_ties(orders):
    batch = S.next_batch_with_ties(orders, "updated_at", "2026-01-01", n=7)
    assert sorted(r.id for r in batch.collect()) == list(range(3, 12))
    assert S.batch_cursor(batch, "updated_at").first()[0] == dt.datetime(2026, 1, 4)


def test_empty_batch_has_no_cursor(orders):
    batch = S.next_batch_with_ties(orders, "updated_at", "2027-01-01", n=7)
    assert tuple(S.batch_cursor(batch, "updated_at").first()) == (None, 0)


def test_union_of_batches_is_the_source(orders):
    start, seen = "2025-01-01", []
    while True:
        batch = S.next_batch_with_ties(orders, "updated_at", start, n=4)
        last = S.batch_cursor(batch, "updated_at").first()[0]
        if last is None:
            break
        seen += [r.id for r in batch.collect()]
        start = str(last)
    assert sorted(seen) == list(range(30))


@pytest.mark.parametrize("data_type, expression", [
    ("bigint", "id * 7 % 50"), ("double", "id / 7"), ("decimal(12,3)", "id / 3"), ("date", "date '2020-01-01' + cast(id % 40 AS int)"),
    ("timestamp", "timestamp '2020-01-01 00:00:00' + make_dt_interval(0, cast(id AS int), cast(id % 3 AS int), 0.000001)"),
    ("timestamp_ntz", "timestamp_ntz '2020-03-29 00:00:00' + make_dt_interval(0, 0, cast(id * 7 AS int), cast(id / 1000 AS decimal(18,6)))"),
    ("string", "concat('k', id % 37)"), ("bigint", "9007199254740992 + id"),
])
@pytest.mark.parametrize("n", [1, 40, 119, 120, 500])
def test_large_selection_equals_sorting(spark, monkeypatch, data_type, expression, n):
    """The range search finds what a full sort finds, for every orderable type."""
    monkeypatch.setattr(S, "TOP_K_ROWS", 3)
    monkeypatch.setattr(S, "SLICES", 5)
    df = spark.range(0, 120, 1, 4).selectExpr(f"cast({expression} AS {data_type}) AS c")
    ordered = [r[0] for r in df.orderBy("c").select(F.col("c").cast("string")).collect()]
    if data_type == "timestamp":
        ordered = [f"{text}Z" for text in ordered]  # instants are written in UTC, the zone of these tests
    assert S.kth_cursor(df, "c", n) == ordered[min(n, 120) - 1]


@pytest.mark.parametrize("low, high", [(None, None), (10.0, 20.0), (31.0, 39.5), (90.0, None), (None, 1.0), (33.0, 33.0)])
def test_a_bracket_that_misses_is_seen(spark, monkeypatch, low, high):
    monkeypatch.setattr(S, "TOP_K_ROWS", 3)
    values = spark.range(0, 200, 1, 4).selectExpr("id div 3 AS c")
    assert S._kth_in_bracket(values, 101, low, high) == "33"


def test_a_batch_takes_two_passes(spark, monkeypatch, folder):
    """Many rows, a hot value, NaN, and few rows around the wanted one counted."""
    monkeypatch.setattr(S, "TOP_K_ROWS", 3)
    spark.range(0, 200_000, 1, 4).selectExpr("CASE WHEN id % 3 = 0 THEN 5000D WHEN id = 1 THEN double('NaN') ELSE id / 7 END AS c").write.parquet(folder)
    values = spark.read.parquet(folder)
    ordered = sorted(r.c for r in values.where("NOT isnan(c)").collect())
    scans = []
    plain = S._kth_in_bracket
    monkeypatch.setattr(S, "_kth_in_bracket", lambda *a: (scans.append(a[2:]), plain(*a))[1])
    monkeypatch.setattr(S, "_kth_by_slices", lambda *a: pytest.fail("the bracket missed"))
    for n in (4, 500, 30_000, 60_000, 150_000, 199_000):
        assert float(S.kth_cursor(values, "c", n)) == ordered[n - 1]
    assert S.kth_cursor(values, "c", 200_000) == "NaN" and len(scans) == 6
    assert all(low is None or high is None or sum(low <= v <= high for v in ordered) < 3_000 or low <= 5000 <= high for low, high in scans)


def test_kth_of_nothing(spark):
    assert S.kth_cursor(spark.range(0), "id", 20_000) is None


def test_large_exact_batch(spark, monkeypatch):
    monkeypatch.setattr(S, "TOP_K_ROWS", 3)
    batch = S.next_batch(spark.range(100).selectExpr("id div 2 AS c"), "c", 10, n=15)
    assert sorted(r.c for r in batch.collect()) == sorted([11 + i // 2 for i in range(15)])


def test_effective_start(spark, rows):
    specs = spark.createDataFrame([("a", "1"), ("b", "2")], "state_key string, start_value string")
    state = spark.createDataFrame([("a", "9")], "state_key string, last_value string")
    assert rows(S.effective_start(specs, state)) == [("a", "9", True), ("b", "2", False)]


def test_conform(spark):
    target = T.StructType([T.StructField("ID", T.IntegerType()), T.StructField("status", T.VarcharType(9)),
                           T.StructField("price", T.DecimalType(5, 2))])
    source = spark.createDataFrame([("1", "2.345"), ("x", "9999")], "id string, PRICE string")
    shaped = S.conform(source, target, {"status": "pending"})
    assert shaped.columns == ["ID", "status", "price"]
    assert [(r.ID, r.status, r.price and str(r.price)) for r in shaped.collect()] == [
        (1, "pending", "2.35"), (None, "pending", None)]
    with pytest.raises(ValueError, match="email"):
        S.conform(source.withColumn("email", F.lit("")), target)
