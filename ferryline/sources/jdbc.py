"""Databases by JDBC: parallel reads, appends, and targets that upsert.

Spark's writer has no upsert.  `JdbcTable` writes the rows to a staging table in
parallel and then has the database merge it in one statement.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.operators.merge import clean_keys, rows_to_write
from ferryline.session import one_row

DEFAULT_DRIVER = "org.postgresql.Driver"  # fixed value

# How a database merges staged rows; the SQL standard's MERGE unless named here by the URL's sub-protocol.
MERGES = {"postgresql": "on conflict", "mysql": "on duplicate key", "mariadb": "on duplicate key", "sqlserver": "merge;"}


@dataclass(frozen=True)
class Connection:
    url: str
    user: str | None = None
    password: str | None = None
    driver: str | None = None
    database_type: str | None = None

    @property
    def options(self) -> dict[str, str]:
        given = {"url": self.url, "driver": self.driver or DEFAULT_DRIVER, "user": self.user, "password": self.password}
        return {key: value for key, value in given.items() if value and value.strip()}

    @property
    def protocol(self) -> str:
        """The sub-protocol of the JDBC URL, as in jdbc:<sub-protocol>:..., unless it is set."""
        return (self.database_type or self.url.removeprefix("jdbc:").partition(":")[0]).strip().lower()

    @property
    def merge(self) -> str:
        return MERGES.get(self.protocol, "merge")


def jdbc_scan(spark: SparkSession, connection: Connection, table: str, partition_column: str | None = None,
              partitions: int = 64, fetch_size: int = 10_000) -> DataFrame:
    """A table, read by `partitions` connections over ranges of a numeric or temporal column.

    Filters and column choices made on the result are pushed to the database.
    """
    reader = spark.read.format("jdbc").options(**connection.options).option("fetchsize", fetch_size)
    if partition_column is None:
        return reader.option("dbtable", table).load()
    bounds = f"SELECT MIN({partition_column}) AS low, MAX({partition_column}) AS high FROM {table}"
    low, high = jdbc_query(spark, connection, bounds).selectExpr("cast(low as string)", "cast(high as string)").first()
    if low is None:
        return reader.option("dbtable", table).load()
    return (
        reader.option("dbtable", table)
        .option("partitionColumn", partition_column)
        .option("lowerBound", low)
        .option("upperBound", high)
        .option("numPartitions", partitions)
        .load()
    )


def jdbc_query(spark: SparkSession, connection: Connection, query: str) -> DataFrame:
    """A query the database runs itself, for instance ORDER BY with LIMIT on an indexed cursor."""
    return spark.read.format("jdbc").options(**connection.options).option("query", query).load()


def jdbc_append(df: DataFrame, connection: Connection, table: str, batch_size: int = 10_000) -> None:
    """INSERT all rows, one connection per partition."""
    df.write.format("jdbc").options(**connection.options).option("dbtable", table).option(
        "batchsize", batch_size
    ).mode("append").save()


def _not_older(new: str, old: str, order_by: list[str]) -> str:
    """Condition that a row comes at or after another by `order_by`, a NULL before all else; `new` and `old` are forms of a column."""
    condition = "1 = 1"
    for column in reversed(order_by):
        n, o = new.format(column), old.format(column)
        same = f"({n} = {o} OR ({n} IS NULL AND {o} IS NULL))"
        condition = f"({n} > {o} OR ({o} IS NULL AND {n} IS NOT NULL) OR ({same} AND {condition}))"
    return condition


def merge_statement(merge: str, table: str, staging: str, columns: list[str], keys: list[str],
                    newer_by: list[str] | None = None) -> str:
    """The statement that upserts a staging table into `table`, in one of the forms of `MERGES`.

    With `newer_by` a stored row stays where the staged one is older by these columns.
    """
    names = ", ".join(columns)
    values = [c for c in columns if c not in keys]
    if merge == "on conflict":
        change = ", ".join(f"{c} = EXCLUDED.{c}" for c in values)
        newer = f" WHERE {_not_older('EXCLUDED.{}', table + '.{}', newer_by)}" if newer_by else ""
        action = f"DO UPDATE SET {change}{newer}" if values else "DO NOTHING"
        return (f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging} "
                f"ON CONFLICT ({', '.join(keys)}) {action}")
    if merge == "on duplicate key":
        newer = _not_older("VALUES({})", table + ".{}", newer_by) if newer_by else ""
        # assignments see those before them: what decides is assigned last, the least of it first
        last = [c for c in reversed(newer_by or []) if c in values]
        change = ", ".join(f"{c} = IF({newer}, VALUES({c}), {table}.{c})" if newer else f"{c} = VALUES({c})"
                           for c in [c for c in values if c not in last] + last or keys)
        return f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging} ON DUPLICATE KEY UPDATE {change}"
    match = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    change = ", ".join(f"t.{c} = s.{c}" for c in values)
    newer = f" AND {_not_older('s.{}', 't.{}', newer_by)}" if newer_by else ""
    update = f"WHEN MATCHED{newer} THEN UPDATE SET {change} " if values else ""
    insert = f"WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({', '.join(f's.{c}' for c in columns)})"
    end = ";" if merge.endswith(";") else ""
    return f"MERGE INTO {table} t USING {staging} s ON ({match}) {update}{insert}{end}"


def insert_statement(table: str, staging: str, columns: list[str]) -> str:
    names = ", ".join(columns)
    return f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging}"


def new_rows_query(table: str, staging: str, keys: list[str]) -> str:
    """How many staged rows the target does not have yet."""
    match = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    return f"SELECT COUNT(*) AS n FROM {staging} s WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE {match})"


@dataclass
class JdbcStaged:
    statement: str
    rows_before: int
    rows_after: int


class JdbcTable:
    """A database table as the target of a load; used like a `VersionedTable`.

    Rows go to a staging table in parallel.  Publishing merges them and writes
    the run into a log table in one transaction, so a run started again finds
    itself there.  The database enforces its own keys.
    """

    enforces_constraints = True

    def __init__(self, spark: SparkSession, connection: Connection, table: str, keys: list[str] | None = None,
                 staging: str | None = None, log: str = "ferryline_runs"):
        self.spark, self.connection, self.table, self.keys = spark, connection, table, keys or []
        self.staging, self.log = staging or f"{table}_staged", log

    def read(self) -> DataFrame:
        return jdbc_scan(self.spark, self.connection, self.table)

    def count(self) -> int:
        return self._number(f"SELECT COUNT(*) AS n FROM {self.table}")

    def commit_of(self, run_id: str, entry: str | None = None) -> dict | None:
        self._ensure_log()
        runs = self.spark.read.format("jdbc").options(**self.connection.options).option("dbtable", self.log).load()
        same = (F.col("table_name") == self.table) & (F.col("run_id") == run_id) & (F.col("entry") == (entry or "-"))
        found = runs.where(same).limit(1).collect()
        return {"run_id": run_id, "cursor": found[0]["last_value"]} if found else None

    def stage_append(self, df: DataFrame, n_rows: int | None = None) -> JdbcStaged:
        self._stage(df)
        before, added = self.count(), self._number(f"SELECT COUNT(*) AS n FROM {self.staging}")
        return JdbcStaged(insert_statement(self.table, self.staging, df.columns), before, before + added)

    def stage_upsert(self, df: DataFrame, keys: list[str] | None = None, order_by: list[str] | None = None,
                     small_batch: bool = False, keep_newer: bool = False, keys_set: bool = False,
                     n_rows: int | None = None) -> JdbcStaged:
        keys = clean_keys(keys or self.keys)
        self._stage(rows_to_write(df, keys, order_by, keys_set))
        before, added = self.count(), self._number(new_rows_query(self.table, self.staging, keys))
        newer_by = order_by if keep_newer else None
        statement = merge_statement(self.connection.merge, self.table, self.staging, df.columns, keys, newer_by)
        return JdbcStaged(statement, before, before + added)

    def publish(self, staged: JdbcStaged, run_id: str, cursor: str | None = None, entry: str | None = None,
                selected: int | None = None) -> None:
        self._ensure_log()
        logged = f"INSERT INTO {self.log} (table_name, run_id, entry, last_value) VALUES (?, ?, ?, ?)"
        values = [self.table, run_id, entry or "-", cursor]
        _transaction(self.spark, self.connection, [(staged.statement, []), (logged, values)])

    def _stage(self, df: DataFrame) -> None:
        df.write.format("jdbc").options(**self.connection.options).option("dbtable", self.staging).mode("overwrite").save()

    def _number(self, query: str) -> int:
        return int(jdbc_query(self.spark, self.connection, query).first()[0])

    def _ensure_log(self) -> None:
        names = ("table_name", "run_id", "entry", "last_value")
        none = one_row(self.spark, **{name: F.lit("") for name in names}).where("false")
        none.write.format("jdbc").options(**self.connection.options).option("dbtable", self.log).mode("append").save()


def _transaction(spark: SparkSession, connection: Connection, statements: list[tuple[str, list]]) -> None:
    """Run statements over the driver's JDBC connection, all or none."""
    jvm = spark.sparkContext._jvm
    registry = jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry
    driver = connection.options["driver"]
    registry.register(driver)
    properties = jvm.java.util.Properties()
    for key in ("user", "password"):
        if key in connection.options:
            properties.setProperty(key, connection.options[key])
    opened = registry.get(driver).connect(connection.url, properties)
    try:
        opened.setAutoCommit(False)
        for text, values in statements:
            statement = opened.prepareStatement(text)
            for place, value in enumerate(values, 1):
                statement.setString(place, value)
            statement.execute()
        opened.commit()
    finally:
        opened.close()
