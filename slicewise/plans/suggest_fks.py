"""Foreign keys that nobody declared: ``*_id`` columns and the tables they seem to name."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.quoting import quote_ident, quote_table
from ..operators.integrity import tables_of
from ..operators.keys import counts_by_tag, orphan_keys
from ..operators.sketches import BUCKETS, broken, compared_as, ranges, refuted, sketches
from ..scratch import freeze
from ..sources.catalog import Catalog, ForeignKey, short, split_name


@dataclass(frozen=True)
class Suggestion:
    child: str
    column: str
    parent: str | None = None
    parent_column: str | None = None
    checked: bool = False
    orphans: int = 0

    def foreign_key(self) -> ForeignKey:
        return ForeignKey(f"{short(self.child)}_{self.column}_fkey", self.child, self.parent, (self.column,), (self.parent_column,))


def stem(column: str) -> str | None:
    """What an ``_id`` column names."""
    lower = column.lower()
    return lower.removesuffix("_id") or None if lower.endswith("_id") else None


def name_forms(word: str) -> list[str]:
    """Table names for a word: itself and its common English plurals."""
    out = [word, word + "s"]
    if word.endswith("y"):
        out.append(word[:-1] + "ies")
    elif word.endswith(("s", "x", "z", "ch", "sh")):
        out.append(word + "es")
    return out


def type_family(logical: str) -> str:
    base = logical.partition("(")[0].strip().lower()
    return "integer" if base in ("smallint", "integer", "bigint", "int2", "int4", "int8") else base


def find_parent(catalog: Catalog, schema: str, word: str, logical: str) -> tuple[str, str] | None:
    """The table whose lone primary key fits; of several one in the same schema, then by name."""
    for form in name_forms(word):
        named = sorted((t for t in catalog.names() if short(t) == form), key=lambda t: (split_name(t)[0] != schema, t))
        for name in named:
            table = catalog.table(name)
            if len(table.primary_key) == 1 and type_family(table.column(table.primary_key[0]).type) == type_family(logical):
                return name, table.primary_key[0]
    return None


def suggest(catalog: Catalog, tables: Iterable[str] | None = None) -> list[Suggestion]:
    """Candidates by name and type, columns that no table fits included."""
    out = []
    for name in sorted(catalog.names() if tables is None else map(catalog.resolve, tables)):
        table = catalog.table(name)
        referencing = {c for fk in table.foreign_keys for c in fk.child_cols}
        for column in table.columns:
            word = stem(column.name)
            if word is None or column.name in referencing or table.primary_key == (column.name,):
                continue
            parent = find_parent(catalog, table.schema, word, column.type)
            out.append(Suggestion(name, column.name, *(parent or (None, None))))
    return out


def validate(catalog: Catalog, suggestions: list[Suggestion]) -> list[Suggestion]:
    """The suggestions with their orphans counted, in one job that scans each table once."""
    places = [i for i, s in enumerate(suggestions) if s.parent]
    if not places:
        return list(suggestions)
    keys = [suggestions[i].foreign_key() for i in places]
    found = counts_by_tag(orphan_keys(tables_of(catalog, keys), keys)).collect()  # one row per suggestion at most
    counts = dict.fromkeys(places, 0) | {places[r["tag"]]: r["n"] for r in found}
    return [replace(s, checked=True, orphans=counts[i]) if i in counts else s for i, s in enumerate(suggestions)]


def pairs_by_type(catalog: Catalog, tables: Iterable[str] | None = None) -> list[Suggestion]:
    """Every column that is in no key of its own, with every lone primary key of its type, whatever their names."""
    kind = lambda name, column: (type_family(catalog.table(name).column(column).type), compared_as(catalog.df(name).select(f"`{column}`").schema[0].dataType))
    parents: dict[tuple, list[tuple[str, str]]] = {}
    for name in sorted(catalog.names()):
        if len(key := catalog.table(name).primary_key) == 1:
            parents.setdefault(kind(name, key[0]), []).append((name, key[0]))
    out = []
    for name in sorted(catalog.names() if tables is None else map(catalog.resolve, tables)):
        table = catalog.table(name)
        referencing = {c for fk in table.foreign_keys for c in fk.child_cols}
        for column in table.columns:
            if column.name not in referencing and table.primary_key != (column.name,):
                out += [Suggestion(name, column.name, *parent) for parent in parents.get(kind(name, column.name), [])]
    return out


def screened(catalog: Catalog, suggestions: list[Suggestion], buckets: int = BUCKETS) -> list[Suggestion]:
    """The suggestions that sketches of the values don't refute, from one scan of each table. None that holds is
    refuted; columns without any value are left out."""
    columns, pairs = _columns_and_pairs(suggestions)
    if not pairs:
        return []
    sketch = freeze(sketches({name: catalog.df(name) for name, _ in columns}, columns, buckets), "key_sketches")
    filled = {r["tag"] for r in ranges(sketch).collect()}  # a row for each column
    return _without(catalog, {s: p for s, p in pairs.items() if p[0] in filled}, lambda df: refuted(sketch, df))


def held(catalog: Catalog, suggestions: list[Suggestion]) -> list[Suggestion]:
    """The suggestions that no row contradicts, from one scan of each table however many there are."""
    columns, pairs = _columns_and_pairs(suggestions)
    tables = {name: catalog.df(name) for name, _ in columns}
    return [replace(s, checked=True, orphans=0) for s in _without(catalog, pairs, lambda df: broken(tables, columns, df))]


def _columns_and_pairs(suggestions: list[Suggestion]) -> tuple[list[tuple[str, str]], dict[Suggestion, tuple[int, int]]]:
    """The columns, each once, and for each suggestion the places of its own."""
    named = [s for s in suggestions if s.parent]
    columns = list(dict.fromkeys(use for s in named for use in ((s.child, s.column), (s.parent, s.parent_column))))
    place = {use: tag for tag, use in enumerate(columns)}
    return columns, {s: (place[s.child, s.column], place[s.parent, s.parent_column]) for s in named}


def _without(catalog: Catalog, pairs: dict[Suggestion, tuple[int, int]], find: Callable[[DataFrame], DataFrame]) -> list[Suggestion]:
    if not pairs:
        return []
    found = find(catalog.spark.createDataFrame(sorted(set(pairs.values())), "inner int, outer int"))
    bad = {(r["inner"], r["outer"]) for r in found.collect()}  # at most a row for each pair of columns
    return [s for s, pair in pairs.items() if pair not in bad]


def discover(catalog: Catalog, tables: Iterable[str] | None = None, buckets: int = BUCKETS) -> list[Suggestion]:
    """Keys that hold in the data, whatever columns are called: pairs by type, screened by sketches, the rest probed."""
    return held(catalog, screened(catalog, pairs_by_type(catalog, tables), buckets))


def suggestions_df(spark: SparkSession, suggestions: Iterable[Suggestion]) -> DataFrame:
    rows = [(s.child, s.column, s.parent, s.parent_column, s.checked, s.orphans) for s in suggestions]
    return spark.createDataFrame(rows, "child_table string, child_column string, parent_table string, parent_column string, checked boolean, orphan_count long")


def format_suggestions(suggestions: list[Suggestion], show_unmatched: bool = False) -> str:
    """A section for each table, a line for each column that could be a key, and how many there are."""
    shown = [s for s in suggestions if s.parent or show_unmatched]
    sections: dict[str, list[str]] = {}
    for s in shown:
        if not s.parent:
            text = "names no table that there is"
        else:
            found = "not looked at" if not s.checked else f"{s.orphans} row(s) fit no parent" if s.orphans else "every row fits"
            text = f"{s.parent}.{s.parent_column}: {found}"
        sections.setdefault(s.child, []).append(f"  {s.column} -> {text}")
    matched = [s for s in suggestions if s.parent]
    whole = f"{len(matched)} key(s) suggested" if matched else "no key suggested"
    if any(s.checked for s in matched):
        whole += f", {sum(s.checked and not s.orphans for s in matched)} of them hold"
    if others := len(shown) - len(matched):
        whole += f"; {others} column(s) left over"
    return "".join(f"{table}\n" + "\n".join(lines) + "\n\n" for table, lines in sections.items()) + whole + "\n"


def format_ddl(suggestions: Iterable[Suggestion]) -> str:
    """One ALTER TABLE for each candidate; NOT VALID where there are orphans."""
    parts = ["-- Keys that column names suggest. Look at each statement before it is run.\n"]
    for s in suggestions:
        if s.parent:
            note = "rows not looked at" if not s.checked else f"{s.orphans} row(s) fit no parent" if s.orphans else "every row fits"
            parts.append(
                f"-- {s.child}.{s.column} -> {s.parent}.{s.parent_column} ({note})\n"
                f"ALTER TABLE {quote_table(s.child)}\n  ADD CONSTRAINT {quote_ident(s.foreign_key().name)}\n"
                f"  FOREIGN KEY ({quote_ident(s.column)}) REFERENCES {quote_table(s.parent)} ({quote_ident(s.parent_column)}){' NOT VALID' if s.orphans else ''};\n"
            )
    return "\n".join(parts if len(parts) > 1 else [*parts, "-- There are none.\n"])
