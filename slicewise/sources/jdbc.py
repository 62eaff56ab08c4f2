"""A catalog read from a PostgreSQL database by JDBC.

Keys and columns come from the information schema; rows are read in parallel
where a table has a single integer primary key. With ``one_moment`` a connection of the driver holds a
snapshot open, and every reader's session adopts it, so all tables are read as they were at
one moment, however many connections read them and however long. Tests know the statements and how
Spark runs them, but there is no PostgreSQL on the build machine.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import DEFAULT_SCHEMA, Catalog, Column, ForeignKey, Table, without_partitions

COLUMNS = """
    SELECT n.nspname AS schema_name, c.relname AS table_name, a.attname AS column_name, a.attnum AS place,
           format_type(a.atttypid, a.atttypmod) AS type, NOT a.attnotnull AS nullable,
           a.attgenerated = 's' AS generated, a.attidentity = 'a' AS identity, pg_get_expr(d.adbin, d.adrelid) AS default_value
    FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid JOIN pg_namespace n ON n.oid = c.relnamespace
    LEFT JOIN pg_attrdef d ON d.adrelid = a.attrelid AND d.adnum = a.attnum
    WHERE c.relkind IN ('r', 'p') AND a.attnum > 0 AND NOT a.attisdropped
      AND n.nspname NOT IN ('pg_catalog', 'information_schema')
"""
CONSTRAINTS = """
    SELECT n.nspname AS schema_name, c.relname AS table_name, k.conname AS name, k.contype::text AS kind,
           pn.nspname AS parent_schema, p.relname AS parent_table,
           array_to_string(ARRAY(SELECT a.attname FROM unnest(k.conkey) WITH ORDINALITY u(num, i)
               JOIN pg_attribute a ON a.attrelid = k.conrelid AND a.attnum = u.num ORDER BY i), chr(31)) AS columns,
           array_to_string(ARRAY(SELECT a.attname FROM unnest(k.confkey) WITH ORDINALITY u(num, i)
               JOIN pg_attribute a ON a.attrelid = k.confrelid AND a.attnum = u.num ORDER BY i), chr(31)) AS parent_columns
    FROM pg_constraint k JOIN pg_class c ON c.oid = k.conrelid JOIN pg_namespace n ON n.oid = c.relnamespace
    LEFT JOIN pg_class p ON p.oid = k.confrelid LEFT JOIN pg_namespace pn ON pn.oid = p.relnamespace
    WHERE k.contype IN ('p', 'f', 'u')
"""
PARTITIONS = """
    SELECT n.nspname || '.' || c.relname AS child, pn.nspname || '.' || p.relname AS parent
    FROM pg_inherits i JOIN pg_class c ON c.oid = i.inhrelid JOIN pg_namespace n ON n.oid = c.relnamespace
    JOIN pg_class p ON p.oid = i.inhparent JOIN pg_namespace pn ON pn.oid = p.relnamespace
    WHERE c.relispartition
"""


class Snapshot:
    """A transaction of the driver that keeps a snapshot open; ``options`` make a reader's session adopt it."""

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str]) -> None:
        self.connection = connect(spark, url, properties)
        self.connection.setAutoCommit(False)
        statement = self.connection.createStatement()
        statement.execute("SET TRANSACTION ISOLATION LEVEL REPEATABLE READ, READ ONLY")
        rows = statement.executeQuery("SELECT pg_export_snapshot()")
        rows.next()
        self.name = rows.getString(1)
        statement.close()

    @property
    def options(self) -> dict[str, str]:
        # with a fetch size Spark reads within a transaction, at whose start the session's statement runs
        said = self.name.replace("'", "''")
        return {"fetchsize": "10000", "sessionInitStatement": f"SET TRANSACTION ISOLATION LEVEL REPEATABLE READ, READ ONLY; SET TRANSACTION SNAPSHOT '{said}'"}

    def close(self) -> None:
        """Nothing can be read of this moment from now on."""
        self.connection.close()


def connect(spark: SparkSession, url: str, properties: dict[str, str]):
    """A connection of the driver."""
    jvm = spark._jvm
    known = jvm.java.util.Properties()
    for key, value in properties.items():
        known.setProperty(key, str(value))
    if "driver" in properties:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(properties["driver"])
    return jvm.java.sql.DriverManager.getConnection(url, known)


def read_sql(spark: SparkSession, url: str, query: str, properties: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **properties).load()


def read_table(spark: SparkSession, url: str, name: str, integer_key: str | None, properties: dict[str, str], partitions: int = 32) -> DataFrame:
    schema, table = name.split(".", 1)
    source = f'"{schema}"."{table}"'
    reader = spark.read.format("jdbc").options(url=url, dbtable=source, **properties)
    if integer_key:
        low, high = read_sql(spark, url, f'SELECT min("{integer_key}") AS low, max("{integer_key}") AS high FROM {source}', properties).first()
        if low is not None:
            reader = reader.options(partitionColumn=f'"{integer_key}"', lowerBound=low, upperBound=high, numPartitions=partitions)
    return reader.load()


def catalog(spark: SparkSession, url: str, properties: dict[str, str] | None = None, partitions: int = 32, default_schema: str = DEFAULT_SCHEMA, one_moment: bool = False) -> Catalog:
    """The tables of a database; partitions are part of their root table. Names without a schema are in ``default_schema``.
    With ``one_moment`` all of them, their keys and columns too, are read of one snapshot until the catalog is closed."""
    properties = {"driver": "org.postgresql.Driver"} | (properties or {})
    snapshot = Snapshot(spark, url, properties) if one_moment else None
    properties |= snapshot.options if snapshot else {}
    columns = read_sql(spark, url, COLUMNS, properties).orderBy("schema_name", "table_name", "place").collect()
    found = read_sql(spark, url, CONSTRAINTS, properties).withColumns({c: F.split(c, "\x1f") for c in ("columns", "parent_columns")}).collect()
    parents = {r["child"]: r["parent"] for r in read_sql(spark, url, PARTITIONS, properties).collect()}
    tables: dict[str, Table] = {}
    for r in columns:
        name = f"{r['schema_name']}.{r['table_name']}"
        column = Column(r["column_name"], r["type"], r["nullable"], False, r["generated"], r["identity"], r["default_value"])
        tables[name] = replace(tables.get(name, Table(name, ())), columns=(*(tables[name].columns if name in tables else ()), column))
    for r in found:
        name = f"{r['schema_name']}.{r['table_name']}"
        if name not in tables:
            continue
        if r["kind"] == "p":
            tables[name] = replace(tables[name], primary_key=tuple(r["columns"]))
        elif r["kind"] == "f":
            fk = ForeignKey(r["name"], name, f"{r['parent_schema']}.{r['parent_table']}", tuple(r["columns"]), tuple(r["parent_columns"]))
            tables[name] = replace(tables[name], foreign_keys=(*tables[name].foreign_keys, fk))
        elif len(r["columns"]) == 1:
            tables[name] = replace(tables[name], columns=tuple(replace(c, unique=True) if c.name == r["columns"][0] else c for c in tables[name].columns))
    for name, table in tables.items():
        pk = table.primary_key[0] if len(table.primary_key) == 1 else None
        integer = pk if pk and table.column(pk).type in ("smallint", "integer", "bigint") else None
        tables[name] = replace(table, load=lambda s, n=name, k=integer: read_table(s, url, n, k, properties, partitions))
    out = Catalog(spark, without_partitions(tables.values(), parents), default_schema)
    out.snapshot = snapshot
    return out
