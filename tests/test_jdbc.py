"""JDBC targets without a database: the statements they would run, tried on DuckDB in this process."""

import inspect

import compare
import pytest

from ferryline.operators import schema_diff as D
from ferryline.operators.rows import TargetSchema
from ferryline.plans import contract as C
from ferryline.plans.loads import full_load, incremental_load
from ferryline.sources import catalog, jdbc
from ferryline.sources.tables import VersionedTable
from ferryline.streaming.upsert import stream_upsert

CONNECTION = jdbc.Connection("jdbc:postgresql://h/db", "u", "p")


@pytest.fixture
def con():
    return compare.duckdb.connect()


@pytest.mark.parametrize("merge", ["on conflict", "merge"])
def test_merge_statement(con, merge):
    con.execute("CREATE TABLE t (a INT, b INT, v VARCHAR, w INT, PRIMARY KEY (a, b))")
    con.execute("INSERT INTO t VALUES (1, 1, 'old', 1), (1, 2, 'old', 1)")
    con.execute("CREATE TABLE s AS SELECT * FROM (VALUES (1, 2, 'new', 2), (2, 1, 'new', 2)) x(a, b, v, w)")
    assert con.execute(jdbc.new_rows_query("t", "s", ["a", "b"])).fetchone() == (1,)
    statement = jdbc.merge_statement(merge, "t", "s", ["a", "b", "v", "w"], ["a", "b"])
    # Oracle allows, and DuckDB refuses, the alias in front of an updated column.
    con.execute(statement.replace("SET t.v", "SET v").replace(", t.w", ", w"))
    assert con.execute("SELECT * FROM t ORDER BY a, b").fetchall() == [
        (1, 1, "old", 1), (1, 2, "new", 2), (2, 1, "new", 2)]


@pytest.mark.parametrize("merge", ["on conflict", "merge"])
def test_a_newer_stored_row_stays(con, merge):
    con.execute("CREATE TABLE t (k INT PRIMARY KEY, v VARCHAR, day INT, n INT)")
    con.execute("INSERT INTO t VALUES (1, 'old', 5, 1), (2, 'old', 5, 1), (3, 'old', 5, 1), (4, 'old', NULL, 1), (5, 'old', 5, NULL), (6, 'old', 5, 2)")
    con.execute("CREATE TABLE s AS SELECT * FROM (VALUES (1, 'new', 6, 0), (2, 'new', 4, 9), (3, 'new', 5, 1), (4, 'new', 0, 0), "
                "(5, 'new', NULL, 3), (6, 'new', 5, 1), (7, 'new', 1, 1)) x(k, v, day, n)")
    statement = jdbc.merge_statement(merge, "t", "s", ["k", "v", "day", "n"], ["k"], ["day", "n"])
    con.execute(statement.replace("SET t.v", "SET v").replace(", t.day =", ", day =").replace(", t.n =", ", n ="))
    assert [r[0] for r in con.execute("SELECT v FROM t ORDER BY k").fetchall()] == ["new", "old", "new", "new", "old", "old", "new"]


def test_what_decides_is_assigned_last():
    statement = jdbc.merge_statement("on duplicate key", "t", "s", ["k", "day", "n", "v"], ["k"], ["day", "n"])
    change = statement.split("ON DUPLICATE KEY UPDATE ")[1]
    assert change.index("v = IF(") < change.index("n = IF(") < change.index("day = IF(")


def test_both_targets_take_the_same_arguments():
    for name in ("stage_upsert", "stage_append", "publish", "commit_of"):
        own, other = (inspect.signature(getattr(c, name)).parameters for c in (VersionedTable, jdbc.JdbcTable))
        assert list(own) == list(other), name


def test_a_stream_into_a_database_target(spark, con, folder):
    con.execute("CREATE TABLE t (id INT PRIMARY KEY, name VARCHAR, seq INT)")
    target = DuckTable(spark, con, "t", ["id"])
    for i, rows in enumerate([[(1, "a", 5), (2, "b", 1)], [(1, "late", 4), (2, "c", 2)]]):
        spark.createDataFrame(rows, "id int, name string, seq int").write.parquet(f"{folder}/in/{i}")
        stream = spark.readStream.schema("id int, name string, seq int").parquet(f"{folder}/in/*")
        stream_upsert(stream, target, ["id"], f"{folder}/checkpoint", ["seq"], name=f"duck{i}")
    assert con.execute("SELECT * FROM t ORDER BY id").fetchall() == [(1, "a", 5), (2, "c", 2)]


def test_merge_statement_texts():
    assert jdbc.merge_statement("on duplicate key", "t", "s", ["k", "v"], ["k"]) == (
        "INSERT INTO t (k, v) SELECT k, v FROM s ON DUPLICATE KEY UPDATE v = VALUES(v)")
    assert jdbc.merge_statement("merge;", "t", "s", ["k"], ["k"]) == (
        "MERGE INTO t t USING s s ON (t.k = s.k) WHEN NOT MATCHED THEN INSERT (k) VALUES (s.k);")
    assert jdbc.merge_statement("on conflict", "t", "s", ["k"], ["k"]).endswith("ON CONFLICT (k) DO NOTHING")


class DuckTable(jdbc.JdbcTable):
    """A JDBC target whose traffic goes to DuckDB instead of a driver."""

    def __init__(self, spark, con, table, keys=None):
        super().__init__(spark, CONNECTION, table, keys)
        self.con = con

    def read(self):
        return self.spark.createDataFrame(self.con.execute(f"SELECT * FROM {self.table}").fetchall(), "id int, name string, seq int")

    def _number(self, query):
        return self.con.execute(query).fetchone()[0]

    def _stage(self, df):
        self.con.execute(f"CREATE OR REPLACE TABLE {self.staging} AS SELECT * FROM {self.table} LIMIT 0")
        rows = [tuple(r) for r in df.collect()]
        if rows:
            self.con.executemany(f"INSERT INTO {self.staging} VALUES (?, ?, ?)", rows)

    def _ensure_log(self):
        self.con.execute(f"CREATE TABLE IF NOT EXISTS {self.log} (table_name TEXT, run_id TEXT, last_value TEXT)")

    def commit_of(self, run_id, entry=None):
        self._ensure_log()
        found = self.con.execute(f"SELECT last_value FROM {self.log} WHERE run_id = ?", [run_id]).fetchone()
        return found and {"run_id": run_id, "cursor": found[0]}

    def publish(self, staged, run_id, cursor=None, entry=None, selected=None):
        self._ensure_log()
        self.con.execute(staged.statement)
        self.con.execute(f"INSERT INTO {self.log} VALUES (?, ?, ?)", [self.table, run_id, cursor])


def load(**settings):
    schema = TargetSchema(C.columns("id int, name string, seq int"), ["id"])
    return C.TableLoad("t", C.TableRef("t"), C.TableRef("t", "public"), schema, enabled=True, **settings)


def test_loads_into_a_database_target(spark, con, folder):
    con.execute("CREATE TABLE t (id INT PRIMARY KEY, name VARCHAR, seq INT)")
    target = DuckTable(spark, con, "t", ["id"])
    source = spark.createDataFrame([(i, f"n{i}", i // 2) for i in range(10)], "id int, name string, seq int")
    first = full_load(load(where="id < 5", snapshot=True), source, target, "r1")
    assert (first.target_before, first.target_after, first.outcome) == (0, 5, "UPSERT_INSERTS_ONLY")
    second = full_load(load(), source, target, "r2")
    assert (second.target_net_delta, second.outcome) == (5, "UPSERT_INSERTS_AND_UPDATES")
    assert full_load(load(), source, target, "r2").warnings  # the run is in the log
    spec = load(migration_type="incremental", incremental=C.Incremental("seq", "2", 3, "append"))
    with pytest.raises(compare.duckdb.ConstraintException):  # the database enforces its key
        incremental_load(spec, source, target, "r3", f"{folder}/state")
    assert target.count() == 10


def test_catalog_queries(spark, con, monkeypatch, rows):
    con.execute("CREATE TABLE people (id INTEGER PRIMARY KEY, email VARCHAR UNIQUE, boss INTEGER REFERENCES people(id))")
    con.execute("CREATE TABLE visits (id BIGINT NOT NULL, person INTEGER REFERENCES people(id))")
    types = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string"}

    def ask(spark, connection, query):
        found = con.execute(query)
        layout = ", ".join(f"{c[0]} {types.get(str(c[1]), 'string')}" for c in found.description)
        return spark.createDataFrame(found.fetchall(), layout)

    monkeypatch.setattr(catalog, "jdbc_query", ask)
    found = catalog.database_catalog(spark, CONNECTION)
    nullable = {(r.table_id, r.column_name): (r.jdbc_type, r.nullable) for r in found["columns"].collect()}
    assert nullable[("main.visits", "id")] == (-5, False) and nullable[("main.visits", "person")] == (4, True)
    assert rows(found["primary_keys"]) == [("main.people", "id")]
    assert rows(found["foreign_keys"].select("table_id", "column_name", "ref_id", "ref_column")) == [
        ("main.people", "boss", "main.people", "id"), ("main.visits", "person", "main.people", "id")]
    mapping = spark.createDataFrame([(0, "main.people", "main.people", "main", "people")],
                                    "ordinal int, source_id string, target_id string, target_schema string, target_table string")
    assert D.schema_diff(mapping, found, found).count() == 0
    assert rows(catalog.database_foreign_keys(spark, CONNECTION))[1] == ("main", "people", "main", "visits")
    assert [r.table_id for r in catalog.database_self_references(spark, CONNECTION).where("table_id = ref_id").collect()] == ["main.people"]
