"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferryline.functions import ids
from ferryline.functions.text import redact, redact_url
from ferryline.functions.types import type_family
from ferryline.queries import query
from ferryline.sources.tables import scan

REDACT_SQL = r"""
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({text},
      '(?i)(password|pwd|token|jwt|secret|api_key|apikey)(\s*[=:]\s*)[^\s,;}}&]+', '\1\2[REDACTED]', 'g'),
      '(?i)("(?:password|pwd|token|jwt|secret|api_key|apikey)"\s*:\s*")[^"]*(")', '\1[REDACTED]\2', 'g'),
      '(?i)(https?://[^\s/@:]+:)[^\s/@]+(@)', '\1[REDACTED]\2', 'g'),
      '(?i)Bearer\s+[A-Za-z0-9._\-]+', 'Bearer [REDACTED]', 'g'),
      '(?i)(Authorization:\s*Bearer\s+)[A-Za-z0-9._\-]+', '\1[REDACTED]', 'g'),
      '(?i)([?&](?:password|pwd|token|jwt|secret|api_key|apikey)=)[^&\s]*', '\1[REDACTED]', 'g')
"""


@query("redact_documents", f"SELECT doc_id, {REDACT_SQL.format(text='text')} AS text FROM documents")
def redact_documents(spark, d):
    return scan(spark, "documents", d).select("doc_id", redact(F.col("text")).alias("text"))


# A connection string per customer, with its secret in three places.
URL_SQL = """'jdbc:postgresql://' || replace(c_name, '#', '') || ':' || c_mktsegment || '@db' || c_nationkey
             || '/x?Password=' || c_acctbal || '&pwd:' || c_custkey || ' ssl=true'"""


@query("redact_urls", rf"""
    SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(url,
        '(?i)(password|passwd|pwd)=([^;&\s]+)', '\1=***', 'g'),
        '(?i)(password|passwd|pwd):([^@\s]+)', '\1:***', 'g'),
        '(?i)(//[^:/\s]+:)([^@/\s]+)(@)', '\1***\3', 'g') AS url
    FROM (SELECT c_custkey, {URL_SQL} AS url FROM customer)
""")
def redact_urls(spark, d):
    rows = scan(spark, "customer", d).selectExpr("c_custkey", f"{URL_SQL} AS url")
    return rows.select("c_custkey", redact_url(F.col("url")).alias("url"))


@query("table_ids", """
    SELECT p_partkey, schema_name || '.' || table_name AS table_id, schema_name, table_name FROM (
        SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'public' ELSE lower(p_brand) END AS schema_name,
               replace(lower(p_name), ' ', '_') || '_' || p_partkey AS table_name FROM part)
""")
def table_ids(spark, d):
    named = scan(spark, "part", d).select(
        "p_partkey",
        F.when(F.col("p_type") == "PROMO", F.lit(" \t")).otherwise(F.concat(F.lit("\t"), "p_brand", F.lit(" "))).alias("s"),
        F.concat(F.lit(" \n"), F.upper(F.translate("p_name", " ", "_")), F.lit("_"), "p_partkey", F.lit("\r\n")).alias("t"),
    )
    table = named.select("p_partkey", ids.table_id(F.col("s"), F.col("t")).alias("table_id"))
    parts = ids.split_id(F.col("table_id"))
    return table.select("p_partkey", "table_id", parts["schema"].alias("schema_name"), parts["table"].alias("table_name"))


@query("type_families", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE
        WHEN code IN (-6, 5, 4, -5, 6, 7, 8, 2, 3) THEN 'NUMERIC'
        WHEN code IN (1, 12, -1, -15, -9, -16) THEN 'TEXT'
        WHEN code IN (91, 92, 2013, 93, 2014) THEN 'TEMPORAL'
        WHEN code IN (16, -7) THEN 'BOOLEAN'
        WHEN code IN (-2, -3, -4, 2004) THEN 'BINARY'
        ELSE 'OTHER_' || code END AS family
    FROM (SELECT *, CAST(l_quantity AS INTEGER) - 17 AS code FROM lineitem)
""")
def type_families(spark, d):
    code = F.col("l_quantity").cast("int") - 17
    return scan(spark, "lineitem", d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", type_family(code).alias("family")
    )


@query("durations", """
    SELECT user_id, event_id, date_diff('millisecond', first_ts, ts) AS elapsed_ms FROM (
        SELECT user_id, event_id, date_trunc('millisecond', ts) AS ts,
               TIMESTAMP '2024-01-01 00:00:00' AS first_ts FROM events)
""")
def durations(spark, d):
    start = F.lit("2024-01-01T00:00:00")
    return scan(spark, "events", d).select(
        "user_id", "event_id", ids.duration_ms(start, F.date_trunc("millisecond", F.col("ts"))).alias("elapsed_ms")
    )
