import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ferryline.functions import ids
from ferryline.functions.text import EMPTY_MESSAGE, redact, redact_url
from ferryline.functions.types import type_family


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_table_ids(spark):
    assert one(spark, ids.table_id(F.col("s"), F.col("t")), s=None, t=" Customers ") == "public.customers"
    assert one(spark, ids.table_id(F.col("s"), F.col("t")), s="\tSales\n", t=" Orders ") == "sales.orders"
    assert tuple(one(spark, ids.split_id(F.col("i")), i=" Public.Customers ")) == ("public", "customers")
    assert tuple(one(spark, ids.split_id(F.col("i")), i="a.b.c")) == ("a", "b.c")


@pytest.mark.parametrize("bad", ["customers", ".x", "x.", " ", None])
def test_malformed_ids_fail(spark, bad):
    with pytest.raises(PySparkException):
        one(spark, ids.split_id(F.col("i").cast("string")), i=bad)


def test_blank_table_fails(spark):
    with pytest.raises(PySparkException):
        one(spark, ids.table_id(F.col("s"), F.col("t")), s="public", t=" ")


def test_strip_takes_control_characters(spark):
    assert one(spark, ids.strip(F.col("x")), x="\x00\t a b \r\n") == "a b"


@pytest.mark.parametrize("message, expected", [
    ("password=superSecretValue token=abc123 schema mismatch",
     "password=[REDACTED] token=[REDACTED] schema mismatch"),
    ('{"jwt": "a b", "x": 1}', '{"jwt": "[REDACTED]", "x": 1}'),
    ("see https://me:pw@host/x", "see https://me:[REDACTED]@host/x"),
    ("Authorization: Bearer ab.c-d end", "Authorization: Bearer [REDACTED] end"),
    ("GET /?api_key=1&x=2", "GET /?api_key=[REDACTED]&x=2"),
    ("PWD : x;y", "PWD : [REDACTED];y"),
    ("", EMPTY_MESSAGE), (" \t\n", EMPTY_MESSAGE), (None, EMPTY_MESSAGE),
])
def test_redact(spark, message, expected):
    assert one(spark, redact(F.col("m").cast("string")), m=message) == expected


def test_redact_url(spark):
    url = "jdbc:postgresql://u:p@h/db?password=a&passwd:b"
    assert one(spark, redact_url(F.col("u")), u=url) == "jdbc:postgresql://u:***@h/db?password=***&passwd:***"
    assert one(spark, redact_url(F.col("u").cast("string")), u=None) is None


@pytest.mark.parametrize("code, family", [
    (4, "NUMERIC"), (-5, "NUMERIC"), (12, "TEXT"), (-16, "TEXT"), (93, "TEMPORAL"), (2014, "TEMPORAL"),
    (16, "BOOLEAN"), (-7, "BOOLEAN"), (2004, "BINARY"), (2003, "OTHER_2003"), (1111, "OTHER_1111"),
])
def test_type_family(spark, code, family):
    assert one(spark, type_family(F.col("c")), c=code) == family


def test_duration(spark):
    value = one(spark, ids.duration_ms(F.col("a"), F.col("b")), a="2026-01-01T00:00:00", b="2026-01-01T00:01:00.250")
    assert value == 60_250
