"""A registry of tables and their keys.

Spark has no usable key metadata for Parquet tables, so keys are declared here,
as Python objects or as YAML. Table names are ``schema.table``; a name without
a schema is in ``public``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .partitions import Leaf, leaves, touched

DEFAULT_SCHEMA = "public"


def split_name(name: str, default_schema: str = DEFAULT_SCHEMA) -> tuple[str, str]:
    """Schema and table, cut at the first dot."""
    head, dot, tail = name.partition(".")
    return (head, tail) if dot else (default_schema, name)


def qualify(name: str, default_schema: str = DEFAULT_SCHEMA) -> str:
    return ".".join(split_name(name, default_schema))


def short(name: str) -> str:
    """The table without its schema."""
    return split_name(name)[1]


@dataclass(frozen=True)
class Column:
    """``type`` is the logical type of the source database, e.g. ``character varying(255)``."""

    name: str
    type: str
    nullable: bool = True
    unique: bool = False
    generated: bool = False
    identity: bool = False
    default: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    """A constraint with its column pairs in order."""

    name: str
    child: str
    parent: str
    child_cols: tuple[str, ...]
    parent_cols: tuple[str, ...]

    def label(self) -> str:
        return f"{join_columns(self.child_cols)} -> {self.parent}.{join_columns(self.parent_cols)}"


def join_columns(columns: Iterable[str]) -> str:
    columns = list(columns)
    return columns[0] if len(columns) == 1 else f"({','.join(columns)})"


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    load: Callable[[SparkSession], DataFrame] | None = field(default=None, compare=False)
    path: str = ""  # where a registry says the rows are, and in which format
    format: str = "parquet"
    parts: tuple[Leaf, ...] = ()  # the leaves of a partitioned table

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def schema(self) -> str:
        return split_name(self.name)[0]

    @property
    def key_columns(self) -> set[str]:
        return set(self.primary_key) | {c for fk in self.foreign_keys for c in fk.child_cols}

    @property
    def generated(self) -> list[str]:
        return [c.name for c in self.columns if c.generated]

    @property
    def has_identity(self) -> bool:
        return any(c.identity for c in self.columns)


class UnknownTable(KeyError):
    """A name that the catalog doesn't have."""


class _Frames(Mapping):
    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog

    def __getitem__(self, name: str) -> DataFrame:
        return self.catalog.df(name)

    def __iter__(self) -> Iterator[str]:
        return iter(self.catalog.tables)

    def __len__(self) -> int:
        return len(self.catalog.tables)


class Catalog:
    def __init__(self, spark: SparkSession | None, tables: Iterable[Table], default_schema: str = DEFAULT_SCHEMA) -> None:
        self.spark = spark
        self.default_schema = default_schema
        self.root = ""  # the folder of a registry's tables
        self.snapshot = None  # what holds a database's moment open
        self.tables = {t.name: t for t in sorted(tables, key=lambda t: t.name)}
        self._frames: dict[str, DataFrame] = {}
        for table in self.tables.values():
            for fk in table.foreign_keys:
                self._check(table, fk)

    def _check(self, table: Table, fk: ForeignKey) -> None:
        if len(fk.child_cols) != len(fk.parent_cols) or fk.child != table.name:
            raise ValueError(f"foreign key {fk.name} of {table.name} is malformed")
        missing = [c for c in fk.child_cols if not table.column(c)]
        if fk.parent in self.tables:
            missing += [c for c in fk.parent_cols if not self.tables[fk.parent].column(c)]
        if missing:
            raise ValueError(f"foreign key {fk.name} names unknown columns: {', '.join(missing)}")

    def resolve(self, name: str) -> str:
        """The qualified name; raises UnknownTable."""
        full = qualify(name, self.default_schema)
        if full not in self.tables:
            raise UnknownTable(f"no table named {name}")
        return full

    def table(self, name: str) -> Table:
        return self.tables[self.resolve(name)]

    def has(self, name: str) -> bool:
        return qualify(name, self.default_schema) in self.tables

    def names(self) -> list[str]:
        return list(self.tables)

    def df(self, name: str) -> DataFrame:
        """The table's rows; the same DataFrame each time, so that its file listing is taken once."""
        full = self.resolve(name)
        if full not in self._frames:
            if self.tables[full].load is None:
                raise ValueError(f"table {full} has no data source")
            self._frames[full] = self.tables[full].load(self.spark)
        return self._frames[full]

    def df_with(self, name: str, keys: list[tuple[DataFrame, Mapping[str, str]]]) -> DataFrame:
        """The table's rows that can have one of the keys: of a partitioned table those of leaves whose bounds allow
        it, of another all. A key is a table of keys and which of its columns the table's columns are compared with."""
        full = self.resolve(name)
        table, whole = self.tables[full], self.df(full)
        if not table.parts or not keys:
            return whole
        kinds = dict(whole.dtypes)
        found = {leaf for part, columns in keys for leaf in touched(list(table.parts), part, columns, kinds)}
        if len(found) == len(table.parts):
            return whole
        paths = [leaf.path for leaf in table.parts if leaf in found]
        return self.spark.read.format(table.format).schema(whole.schema).load(paths) if paths else whole.limit(0)

    @property
    def frames(self) -> Mapping[str, DataFrame]:
        """The tables' rows by qualified name."""
        return _Frames(self)

    def pin(self) -> None:
        """Lists the files of all tables now: whatever is read of this catalog later is read from these files."""
        for name, table in self.tables.items():
            if table.load is not None:
                self.df(name)

    def close(self) -> None:
        """Lets go of a database's moment; a catalog of files has none to let go."""
        if self.snapshot:
            self.snapshot.close()
            self.snapshot = None

    def moved(self, name: str, folders: list[str]) -> None:
        """A table's rows are in other folders from now on."""
        full = self.resolve(name)
        table, shape = self.tables[full], self.df(full).schema
        self.tables[full] = replace(table, load=lambda s: s.read.format(table.format).schema(shape).load(folders))
        del self._frames[full]

    def constraints(self, tables: Iterable[str] | None = None) -> list[ForeignKey]:
        """Foreign keys of the tables, by child and name."""
        names = self.names() if tables is None else [self.resolve(t) for t in tables]
        return sorted((fk for n in names for fk in self.tables[n].foreign_keys), key=lambda fk: (fk.child, fk.name))

    def with_foreign_keys(self, keys: Iterable[ForeignKey]) -> Catalog:
        """A catalog that also has these constraints."""
        tables = dict(self.tables)
        for fk in keys:
            tables[fk.child] = replace(tables[fk.child], foreign_keys=(*tables[fk.child].foreign_keys, fk))
        out = Catalog(self.spark, tables.values(), self.default_schema)
        out._frames, out.root = dict(self._frames), self.root
        return out


_TYPES = {"int": "integer", "bigint": "bigint", "smallint": "smallint", "double": "double precision", "float": "real", "string": "text", "boolean": "boolean", "date": "date", "timestamp": "timestamp with time zone", "timestamp_ntz": "timestamp without time zone", "binary": "bytea"}


def logical_type(spark_type: str) -> str:
    """The logical type of a Spark type that nobody declared."""
    return _TYPES.get(spark_type, "numeric" + spark_type[7:] if spark_type.startswith("decimal") else spark_type)


def table_of(name: str, df: DataFrame, primary_key: Iterable[str] = (), foreign_keys: Iterable[tuple] = (), types: dict[str, str] | None = None, generated: Iterable[str] = (), identity: Iterable[str] = (), unique: Iterable[str] = (), not_null: Iterable[str] = ()) -> Table:
    """A table with the columns of ``df``; ``foreign_keys`` are (columns, parent, parent columns[, name])."""
    name = qualify(name)
    pk = tuple(primary_key)
    required = {*pk, *not_null}
    columns = tuple(Column(c, (types or {}).get(c) or logical_type(t), c not in required, c in set(unique), c in set(generated), c in set(identity)) for c, t in df.dtypes)
    keys = []
    for fk in foreign_keys:
        own, parent, theirs = tuple(fk[0]), qualify(fk[1]), tuple(fk[2])
        keys.append(ForeignKey(fk[3] if len(fk) > 3 else f"{short(name)}_{'_'.join(own)}_fkey", name, parent, own, theirs))
    return Table(name, columns, pk, tuple(keys), lambda spark: df)


def from_yaml(spark: SparkSession, path: str | Path, data_dir: str | None = None) -> Catalog:
    """A catalog from a YAML registry.

    ``tables: {name: {path, format, primary_key, foreign_keys: [{columns, table,
    references, name}], types, generated, identity, unique, not_null, partitions}}``; a path is
    relative to ``data_dir`` and defaults to ``<table>.parquet``. Tables that were loaded are read from
    where the folder's pointer says, all of one state (``versions``).
    """
    import yaml

    from .versions import Versions

    spec = yaml.safe_load(Path(path).read_text()) or {}
    base = data_dir if data_dir is not None else spec.get("data_dir", str(Path(path).parent))
    tables, versions = [], Versions(spark, base)
    for name, t in (spec.get("tables") or {}).items():
        t = t or {}
        where = t.get("path", f"{short(name)}.parquet")
        full = where if "://" in where or where.startswith("/") else f"{base}/{where}"
        kind = t.get("format", "parquet")
        folders = versions.folders(qualify(name)) or [full]
        parts = leaves(t["partitions"], base) if t.get("partitions") and not versions.folders(qualify(name)) else []
        df = spark.read.format(kind).load([leaf.path for leaf in parts] or folders)
        keys = [(fk["columns"], fk["table"], fk["references"], *([fk["name"]] if "name" in fk else [])) for fk in t.get("foreign_keys", [])]
        made = table_of(name, df, t.get("primary_key", ()), keys, t.get("types"), t.get("generated", ()), t.get("identity", ()), t.get("unique", ()), t.get("not_null", ()))
        tables.append(replace(made, path="" if parts else full, format=kind, parts=tuple(parts)))
    out = Catalog(spark, tables, spec.get("default_schema", DEFAULT_SCHEMA))
    out.root = versions.root
    return out


def partition_roots(parents: dict[str, str]) -> dict[str, str]:
    """Partition to the table at the top of its partition tree."""
    out = {}
    for name in parents:
        at, seen = name, set()
        while at in parents and at not in seen:
            seen.add(at)
            at = parents[at]
        out[name] = at
    return out


def without_partitions(tables: Iterable[Table], parents: dict[str, str]) -> list[Table]:
    """The tables without partitions; keys that reference a partition reference its root."""
    roots = partition_roots(parents)
    return [replace(t, foreign_keys=tuple(replace(fk, parent=roots.get(fk.parent, fk.parent)) for fk in t.foreign_keys)) for t in tables if t.name not in roots]
