"""Loading a slice: all of it or nothing.

A load stages every table where nobody reads, parents first, in parallel by Spark; then the staged rows are counted and
their keys checked; then all tables are published at once. Files are published by replacing the
pointer of their folder (``sources/versions``), a database's tables by one transaction of one connection
that empties what is replaced, children first, copies the staged rows and sets the sequences. A load that
stops at any point leaves all tables as they were.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quoting import quote_columns, quote_table
from ..plans.graph import load_order
from ..sources.catalog import Catalog, split_name
from ..sources.jdbc import connect
from ..sources.versions import ChangedMeanwhile, Versions
from .keys import labelled, orphan_keys
from .subset import Slice


class LoadError(ValueError):
    """A slice that would leave rows without parents, or a target that can't take it."""


Sequences = list[tuple[str, str, int]]


class Target(Protocol):
    """Where tables go. One object is one load."""

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a table's rows where nobody reads them, and gives them back from there."""

    def publish(self, order: list[str], replace: bool, sequences: Sequences) -> bool:
        """Adds the staged rows of all tables (parents first), instead of what they held with ``replace``, at once;
        and sets the sequences (table, column, last value). False if there are no sequences to set."""

    def discard(self) -> None:
        """Removes what was staged."""


class _Versioned:
    """Tables of a folder with a pointer. What a table held before is where ``_before`` says."""

    versions: Versions
    version: str

    def _write(self, name: str, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _before(self, name: str) -> list[str]:
        return self.versions.folders(name)

    def _begin(self, spark: SparkSession, root: str) -> None:
        if not self.version:
            self.versions = Versions(spark, root)
            self.version = self.versions.begin()

    def publish(self, order: list[str], replace: bool, sequences: Sequences) -> bool:
        if order:
            staged = {name: [self.versions.staged(self.version, name)] for name in order}
            try:
                self.versions.publish(self.version, {name: ([] if replace else self._before(name)) + new for name, new in staged.items()})
            except ChangedMeanwhile as e:
                raise LoadError(str(e)) from e
            self.version = ""
        return False

    def discard(self) -> None:
        if self.version:
            self.versions.discard(self.version)
            self.version = ""


@dataclass
class ParquetTarget(_Versioned):
    """A folder of Parquet tables, read by ``versions.loaded``."""

    path: str
    version: str = field(default="", compare=False)

    def __post_init__(self) -> None:
        if not self.path.strip("/ "):
            raise LoadError("the target names no folder")

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        self._begin(df.sparkSession, self.path)
        return self._write(name, df, self.versions.staged(self.version, name))


@dataclass
class RegistryTarget(_Versioned):
    """The tables of a registry, in their formats: catalogs made of it from then on read what was loaded."""

    catalog: Catalog
    version: str = field(default="", compare=False)

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        table = self.catalog.table(name)
        if not table.path or not self.catalog.root:
            raise LoadError(f"the registry states no path for {name}")
        self._begin(df.sparkSession, self.catalog.root)
        path = self.versions.staged(self.version, name)
        df.write.format(table.format).save(path)
        return df.sparkSession.read.format(table.format).schema(df.schema).load(path)

    def _before(self, name: str) -> list[str]:
        before, path = self.versions.folders(name), self.catalog.table(name).path
        if before:
            return before
        if not path.startswith(f"{self.versions.root}/"):
            raise LoadError(f"{name} is outside the registry's folder: it can be replaced, but not added to")
        return [path]

    def publish(self, order: list[str], replace: bool, sequences: Sequences) -> bool:
        super().publish(order, replace, sequences)
        for name in order:
            self.catalog.moved(name, self.versions.folders(name))
        return False


@dataclass
class JdbcTarget:
    """Tables of a database.

    Rows are staged in tables of their own, by many connections, and published by statements in one transaction.
    On PostgreSQL the replaced tables are truncated with cascade, triggers and keys are off in
    that transaction with ``disable_triggers``, and sequences are set; elsewhere rows are deleted, and there are no sequences to set.
    """

    url: str
    properties: dict[str, str] = field(default_factory=dict)
    disable_triggers: bool = False
    spark: SparkSession | None = field(default=None, compare=False)
    staged: dict[str, str] = field(default_factory=dict, compare=False)
    columns: dict[str, list[str]] = field(default_factory=dict, compare=False)
    identity: set[str] = field(default_factory=set, compare=False)

    def __post_init__(self) -> None:
        if not self.url.startswith("jdbc:"):
            raise LoadError(f"no JDBC URL: {self.url!r}")
        if self.disable_triggers and not self.postgresql:
            raise LoadError("triggers can be disabled on PostgreSQL only")

    @property
    def postgresql(self) -> bool:
        return self.url.startswith("jdbc:postgresql:")

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        self.spark = df.sparkSession
        schema, table = split_name(name)
        stage = f"{schema}.{table[:40]}_stage_{uuid.uuid4().hex[:12]}"
        # a copy of the table's own columns, so that values are converted as for the table itself
        self.run([f"CREATE TABLE {quote_table(stage)} AS SELECT * FROM {quote_table(name)} WITH NO DATA"])
        self.staged[name], self.columns[name] = stage, df.columns
        options = self.properties | {"url": self.url, "dbtable": quote_table(stage)}
        df.write.format("jdbc").mode("append").options(**options).save()
        return df.sparkSession.read.format("jdbc").options(**options).load().select(*[F.col(f"`{c}`") for c in df.columns])

    def statements(self, order: list[str], replace: bool, sequences: Sequences) -> list[str]:
        """What publishes the staged rows, to be run in one transaction."""
        out = ["SET LOCAL session_replication_role = replica"] if self.disable_triggers else []
        if replace and self.postgresql and order:
            out.append(f"TRUNCATE {', '.join(quote_table(name) for name in reversed(order))} CASCADE")
        elif replace:
            out += [f"DELETE FROM {quote_table(name)}" for name in reversed(order)]
        for name in order:
            columns = quote_columns(self.columns[name])
            given = " OVERRIDING SYSTEM VALUE" if name in self.identity and self.postgresql else ""
            out.append(f"INSERT INTO {quote_table(name)} ({columns}){given} SELECT {columns} FROM {quote_table(self.staged[name])}")
        text = lambda x: "'" + x.replace("'", "''") + "'"
        # a table without a sequence has none to set: setval of null is null
        return out + ([f"SELECT setval(pg_get_serial_sequence({text(quote_table(t))}, {text(c)}), {int(last)})" for t, c, last in sequences] if self.postgresql else [])

    def publish(self, order: list[str], replace: bool, sequences: Sequences) -> bool:
        if order:
            self.run(self.statements(order, replace, sequences))
        return bool(sequences) and self.postgresql

    def discard(self) -> None:
        dropped, self.staged = self.staged, {}
        for stage in dropped.values():
            self.run([f"DROP TABLE {quote_table(stage)}"])

    def run(self, statements: list[str]) -> None:
        """Runs statements in one transaction of one connection of the driver: all of them or none."""
        from py4j.protocol import Py4JJavaError

        connection = connect(self.spark or SparkSession.active(), self.url, self.properties)
        try:
            connection.setAutoCommit(False)
            for text in statements:
                statement = connection.createStatement()
                try:
                    statement.execute(text)
                finally:
                    statement.close()
            connection.commit()
        except Py4JJavaError as e:
            connection.rollback()
            raise LoadError(f"the database refused: {e.java_exception.getMessage()}") from e
        finally:
            connection.close()


@dataclass
class LoadResult:
    order: list[str]
    rows: dict[str, int]
    next_values: dict[str, int] = field(default_factory=dict)
    dry_run: bool = False
    sequences_set: bool = False


def dangling(cut: Slice, tables: Iterable[str] | None = None) -> DataFrame:
    """(child_table, constraint_name, orphan_count) of keys between tables of the slice."""
    names = set(cut.tables if tables is None else tables)
    keys = [fk for fk in cut.catalog.constraints(names) if fk.parent in names]
    if not keys:
        return cut.catalog.spark.createDataFrame([], "child_table string, constraint_name string, orphan_count long")
    return labelled(cut.catalog.spark, orphan_keys(cut.tables, keys), [(fk.child, fk.name) for fk in keys], "child_table string, constraint_name string")


def next_sequence_values(catalog: Catalog, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, last_value): the largest integer key of each table, 1 for an empty one."""
    parts = []
    for name, df in tables.items():
        key = catalog.table(name).primary_key
        if len(key) == 1 and dict(df.dtypes)[key[0]] in ("smallint", "int", "bigint"):
            parts.append(df.agg(F.coalesce(F.max(f"`{key[0]}`").cast("long"), F.lit(1)).cast("long").alias("last_value")).select(F.lit(name).alias("table_name"), F.lit(key[0]).alias("column_name"), "last_value"))
    if not parts:
        return catalog.spark.createDataFrame([], "table_name string, column_name string, last_value long")
    return reduce(DataFrame.unionByName, parts)


def _checked(cut: Slice) -> None:
    bad = dangling(cut).where("orphan_count > 0").collect()  # one row per constraint
    if bad:
        raise LoadError("; ".join(f"{r['child_table']}.{r['constraint_name']}: {r['orphan_count']} row(s) without parent" for r in bad))


def apply(cut: Slice, target: Target, force: bool = False, dry_run: bool = False, verify: bool = True, sync_sequences: bool = False) -> LoadResult:
    """Load a slice; ``force`` replaces what the tables hold. A dry run only counts and checks.

    Each table's rows are made once, when they are staged; what is counted and checked are the staged rows.
    """
    order = load_order(cut.catalog, cut.filled)
    ready = cut
    try:
        if not dry_run:
            empty = {name: df.limit(0) for name, df in cut.tables.items() if name not in cut.filled}
            ready = Slice(cut.catalog, empty | {name: target.stage(name, cut.tables[name]) for name in order}, cut.root)
        if verify:
            _checked(ready)
        counts = {r["table_name"]: r["row_count"] for r in ready.row_counts().collect()} if order else {}
        result = LoadResult(order, counts, dry_run=dry_run)
        found: Sequences = []
        if sync_sequences:
            found = [(r["table_name"], r["column_name"], r["last_value"]) for r in next_sequence_values(cut.catalog, {n: ready.tables[n] for n in order}).collect()]  # one row per table
            result.next_values = {table: last for table, _, last in found}
        if not dry_run:
            result.sequences_set = target.publish(order, force, found)
        return result
    finally:
        if not dry_run:
            target.discard()
