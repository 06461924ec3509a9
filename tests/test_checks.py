import pytest
from pyspark.sql import functions as F

from ferryline.operators import keys as K
from ferryline.operators import rows as R
from ferryline.operators import schema_diff as D
from ferryline.plans.contract import columns
from ferryline.sources.catalog import declared_catalog

MAPPING = "ordinal int, source_id string, target_id string, target_schema string, target_table string"


@pytest.fixture
def customers(spark):
    ddl = """id int NOT NULL, first_name varchar(5) NOT NULL, price decimal(4,2), created_at timestamp_ntz,
             country varchar(10) NOT NULL"""
    return R.TargetSchema(columns(ddl), ["id"], unique=["first_name"], defaults={"country": "España"})


def test_row_rules(spark, rows, customers):
    layout = "ID bigint, first_name string, price double, created_at string"
    source = spark.createDataFrame([
        (1, "Ana", 1.5, "2026-01-01 00:00:00"),
        (2, None, 1.5, None),
        (3, "Anastasia", 100.0, "no date"),
        (3_000_000_000, "Bo", None, None),
        (None, "Bo", None, None),
    ], layout)
    found = R.row_violations(source, customers, ["first_name"])
    assert rows(found) == sorted([
        (None, "first_name", "not_null"), ("Anastasia", "created_at", "bad_cast"), ("Anastasia", "first_name", "too_long"),
        ("Anastasia", "price", "overflow"), ("Bo", "id", "overflow"), ("Bo", "id", "not_null"),
    ], key=lambda r: [(v is not None, str(v)) for v in r])
    good, rejects = R.split_rejects(source, customers)
    assert [(r.id, r.country) for r in good.collect()] == [(1, "España")]
    assert good.count() + rejects.count() == source.count()
    with pytest.raises(ValueError):
        R.check_rows(source.withColumn("email", F.lit("")), customers)


def test_orphans_and_duplicates(spark, rows):
    child = spark.createDataFrame([(1, 7), (2, 8), (3, None), (4, 8)], "id int, fk int")
    parent = spark.createDataFrame([(7,), (7,)], "pk int")
    assert rows(K.orphans(child, parent, "fk", "pk")) == [(2, 8), (4, 8)]
    assert rows(K.orphan_counts(child, parent, "fk", "pk")) == [(8, 2)]
    assert rows(K.key_duplicates(child, ["fk"])) == [(8, 2)]


def _catalog(spark, schema, table="public.customers"):
    return declared_catalog(spark, {table: schema})


def _diff(spark, rows, source, target, source_id="public.customers", target_id="public.customers", extra=()):
    mapping = spark.createDataFrame(
        [(0, source_id, target_id, *target_id.split(".")), *extra], MAPPING)
    found = D.schema_diff(mapping, _catalog(spark, source, source_id), _catalog(spark, target, target_id))
    return [(r[2], r[3]) for r in rows(found) if r[0] == source_id]


def schema(ddl, *args, **kwargs):
    return R.TargetSchema(columns(ddl), *args, **kwargs)


def test_compatible_schemas(spark, rows):
    source = schema("id int NOT NULL, email varchar(255)", ["id"])
    target = schema("ID bigint NOT NULL, Email varchar(255), extra int", ["ID"])
    assert _diff(spark, rows, source, target) == []


@pytest.mark.parametrize("source, target, expected", [
    ("id int, email varchar(10)", "id int", [("email", "missing_column")]),
    ("created_at timestamp_ntz", "created_at varchar(50)", [("created_at", "type_mismatch")]),
    ("email varchar(20)", "email varchar(10)", [("email", "too_short")]),
    ("email varchar(20)", "email string", []),
    ("email string NOT NULL", "email string", [("email", "nullability")]),
    ("email string", "email string NOT NULL", [("email", "nullability")]),
    ("tags array<int>", "tags array<string>", []),
    ("tags array<int>", "tags map<int,int>", [("tags", "type_mismatch")]),
])
def test_column_rules(spark, rows, source, target, expected):
    assert _diff(spark, rows, schema(source), schema(target)) == expected


def test_lost_primary_key_and_unique(spark, rows):
    source = schema("id int, email string", unique=["email"], primary_key=["id"])
    target = schema("id int NOT NULL, email string")
    assert _diff(spark, rows, source, target) == [("email", "unique"), ("id", "primary_key"), ("id", "unique")]


@pytest.mark.parametrize("parent, expected", [
    ("public.customers", []), ("public.other", [("customer_id", "foreign_key")]), (None, [("customer_id", "foreign_key")]),
])
def test_foreign_keys(spark, rows, parent, expected):
    fk = [R.ForeignKey("customer_id", "crm.people", "id")]
    other = [R.ForeignKey("customer_id", parent, "id")] if parent else []
    people = (1, "crm.people", "public.customers", "public", "customers")
    found = _diff(spark, rows, schema("customer_id int", foreign_keys=fk), schema("customer_id int", foreign_keys=other),
                  "public.orders", "public.orders", [people])
    assert found == expected


def test_foreign_key_to_a_table_that_is_not_migrated_is_skipped(spark, rows):
    fk = [R.ForeignKey("customer_id", "crm.people", "id")]
    assert _diff(spark, rows, schema("customer_id int", foreign_keys=fk), schema("customer_id int")) == []


def test_missing_tables(spark, rows):
    mapping = spark.createDataFrame([(0, "a.s", "a.t", "a", "t"), (1, "a.x", "a.y", "a", "y")], MAPPING)
    have = spark.createDataFrame([("a.t", "id")], "table_id string, column_name string")
    assert rows(D.missing_tables(mapping, have, "target")) == [("a.y", "target")]


def test_simple_unique_columns(spark, rows):
    index = spark.createDataFrame([
        ("t", "ix1", "Email", False), ("t", "IX1", "email", False), ("t", "ix2", "a", False), ("t", "ix2", "b", False),
        ("t", "ix3", "c", True), ("t", None, "d", False), ("t", "ix4", " ", False),
    ], "table_id string, index_name string, column_name string, non_unique boolean")
    assert rows(K.simple_unique_columns(index)) == [("t", "d"), ("t", "email")]
