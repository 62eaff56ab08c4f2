"""Referentially closed slices.

A slice starts from a root query or from every table that has a column with a
given value. Rows reached *down* (parent to child) expand further down; rows
needed *up* (child to parent) are there for integrity only. Closures are semi
joins on key columns; a child with several ways in is filtered once by
``EXISTS ... OR EXISTS ...``, so its rows keep their multiplicity and need no
primary key.

A table's rows are a plan that is made when they are asked for. What other tables
need of them, the key columns, is written once as a narrow table and joined from
there, so a large table is read once for its keys, if any other table wants them,
and once for its rows, whatever hangs on it. Where the key graph has no cycle each
direction is one pass over the tables. In a cycle whose tables each have one key in it, as a
tree has, paths are doubled (``reach``), so rounds are the logarithm of the depth; other cycles, and hops
where a depth is given, follow the keys found last. Masks are applied when all keys have been followed.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import ExitStack
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import to_spark
from ..plans.graph import children_of, cycles, load_order
from ..scratch import freeze, sent_if_small
from ..sources.catalog import Catalog, ForeignKey, short
from .keys import key_value, kinds_of
from .masking import apply_masks, parse_filters, parse_masks
from .reach import NODE, TO, reached_from, renamed
from .seen import Seen

MAX_ROUNDS = 100


class SubsetError(ValueError):
    """The slice can't be taken as asked."""


@dataclass
class SubsetSpec:
    """What to slice.

    ``root``: a table and an SQL tail (``orders WHERE o_orderkey < 10``);
    ``seed``: ``column=value``; one of the two. ``limit``: most rows of a table
    that down steps add, by its key. ``depth``: most down hops from the start.
    ``expand_includes``: whether whole included tables expand down as well.
    ``first_fk_only``: of several keys between two tables follow one down.
    ``table_level``: rows of a table that was reached down expand however they
    were reached themselves. ``materialize``: write each table's rows once when
    they are known, so that several uses of the slice don't compute them again.
    """

    root: str | None = None
    seed: str | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    filters: list[str] = field(default_factory=list)
    masks: list[str] = field(default_factory=list)
    limit: int = 0
    depth: int = 0
    expand_includes: bool = True
    first_fk_only: bool = False
    table_level: bool = False
    force_key_masks: bool = False
    materialize: bool = False
    max_rounds: int = MAX_ROUNDS


class Tables(Mapping):
    """Tables by name, in order, each made when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


@dataclass
class Slice:
    """Tables of a slice, parents first, and how it was taken.

    ``tables`` are those that keys or the spec lead to; one in which nothing was
    found counts as untouched, like those that nothing leads to.
    """

    catalog: Catalog
    tables: Mapping[str, DataFrame]
    root: str
    masks: list[str] = field(default_factory=list)
    filters: list[str] = field(default_factory=list)
    unreached: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    truncated: list[str] = field(default_factory=list)

    def row_counts(self) -> DataFrame:
        """(table_name, row_count) of each table that has rows."""
        parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in self.tables.items()]
        return reduce(DataFrame.unionByName, parts).where("row_count > 0")

    @cached_property
    def filled(self) -> dict[str, DataFrame]:
        """The tables that have rows, parents first; one job looks for a row of each."""
        flags = [df.limit(1).select(F.lit(name).alias("table_name")) for name, df in self.tables.items()]
        found = {r["table_name"] for r in reduce(DataFrame.unionByName, flags).collect()} if flags else set()
        return {name: df for name, df in self.tables.items() if name in found}

    @property
    def untouched(self) -> list[str]:
        """Tables of which the slice has no row."""
        return sorted({*self.unreached, *self.tables.keys() - self.filled.keys()})


def split_root(spec: str) -> tuple[str, str]:
    """Table and SQL tail."""
    parts = spec.split(maxsplit=1)
    if not parts:
        raise SubsetError("the root is empty")
    return parts[0], parts[1] if len(parts) > 1 else ""


class Rows:
    """A table's rows in a slice. ``keys`` are their key columns, written when they are first
    asked for; rows repeated in them change nothing. ``ways`` says how they come in, if that is
    all there is to say of them."""

    def __init__(self, make: Callable[[], DataFrame], columns: list[str], ways: Callable[[], list[Way]] | None = None) -> None:
        self._make, self._columns, self.ways = make, columns, ways

    @cached_property
    def df(self) -> DataFrame:
        return self._make()

    @cached_property
    def keys(self) -> DataFrame:
        return freeze(narrow(self.df, self._columns), "slice_keys")


def narrow(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])


@dataclass(frozen=True)
class Way:
    """Rows come in whose columns (first of each pair) are among the keys' (second), and for
    which the condition holds, if there is one."""

    keys: DataFrame
    pairs: tuple[tuple[str, str], ...]
    condition: str = ""


def children_in(fk: ForeignKey, parents: DataFrame, condition: str = "") -> Way:
    return Way(parents, tuple(zip(fk.child_cols, fk.parent_cols, strict=True)), condition)


def parents_of(fk: ForeignKey, children: DataFrame) -> Way:
    return Way(children, tuple(zip(fk.parent_cols, fk.child_cols, strict=True)))


_numbers = itertools.count()


def rows_by(base: DataFrame, ways: list[Way]) -> DataFrame:
    """Rows of ``base`` that come in by any of the ways, each as often as it is there."""
    wide, conditions = base, []
    for way in ways:
        n = next(_numbers)  # names of their own keep a table's columns apart from those of its keys
        wide = wide.withColumns({f"own_{n}_{i}": F.col(f"`{own}`") for i, (own, _) in enumerate(way.pairs)})
        named = sent_if_small(way.keys.select(*[F.col(f"`{theirs}`").alias(f"key_{n}_{i}") for i, (_, theirs) in enumerate(way.pairs)]))
        match = reduce(Column.__and__, [F.col(f"key_{n}_{i}") == F.col(f"own_{n}_{i}").outer() for i in range(len(way.pairs))])
        found = named.where(match).exists()
        conditions.append(found & F.expr(way.condition) if way.condition else found)
    return wide.where(reduce(Column.__or__, conditions)).select(*[F.col(f"`{c}`") for c in base.columns])


class Extraction:
    """One run of a spec over a catalog."""

    def __init__(self, catalog: Catalog, spec: SubsetSpec) -> None:
        if bool(spec.root) == bool(spec.seed):
            raise SubsetError("give either a root or a seed")
        self.catalog, self.spec = catalog, spec
        self.excluded = self._named(spec.exclude)
        self.masks = parse_masks(catalog, spec.masks, spec.force_key_masks)
        self.filters = parse_filters(catalog, spec.filters)
        self.sealed: set[str] = set()
        self.settled: set[ForeignKey] = set()  # constraints whose parents are all in the slice already
        self.warnings: list[str] = []
        self.truncated: list[str] = []
        self.below = {p: [fk for fk in fks if fk.child not in self.excluded] for p, fks in children_of(catalog).items()}
        if spec.first_fk_only:
            for parent, fks in self.below.items():
                self.below[parent] = list({fk.child: fk for fk in reversed(fks)}.values())
        self.into: dict[str, list[ForeignKey]] = {}
        for fks in self.below.values():
            for fk in fks:
                self.into.setdefault(fk.child, []).append(fk)

    def _named(self, names: Iterable[str]) -> set[str]:
        """Qualified names; a short name stands for the table in any schema."""
        out = set()
        for name in names:
            found = {t for t in self.catalog.names() if t == name or t.split(".", 1)[1] == name}
            if not found:
                raise SubsetError(f"no table named {name}")
            out |= found
        return out

    # -- where a slice starts

    def start(self) -> dict[str, DataFrame]:
        rows = self._roots() if self.spec.root else self._seeds()
        for name in self.spec.include:
            full = self.catalog.resolve(name)
            if full in self.excluded:
                raise SubsetError(f"{name} is both included and excluded")
            rows[full] = self.catalog.df(full)
        return rows

    def _roots(self) -> dict[str, DataFrame]:
        name, tail = split_root(self.spec.root)
        full = self.catalog.resolve(name)
        if full in self.excluded:
            raise SubsetError(f"the root {name} is excluded")
        view = f"root_{uuid.uuid4().hex}"
        self.catalog.df(full).createTempView(view)
        # the tail may name the table's columns by the table
        alias = f"AS `{short(full)}` " if not tail or tail.split(maxsplit=1)[0].lower() in ("where", "order", "limit", "offset") else ""
        try:
            rows = self.catalog.spark.sql(f"SELECT * FROM {view} {alias}{to_spark(tail)}")  # a trusted operator's SQL; analysis errors surface here
        finally:
            self.catalog.spark.catalog.dropTempView(view)
        if not tail.lower().startswith("where") or any(w in tail.lower() for w in ("rand", "limit", "uuid")):
            rows = freeze(rows, "root") if tail else rows  # every use must see the same rows
        if rows.isEmpty():
            raise SubsetError(f"the root query finds no rows in {full}")
        return {full: rows}

    def _seeds(self) -> dict[str, DataFrame]:
        column, equals, value = self.spec.seed.partition("=")
        column, value = column.strip(), value.strip()
        if not equals or not column:
            raise SubsetError("a seed reads column=value")
        rows = {}
        for name, table in self.catalog.tables.items():
            if name in self.excluded or not table.column(column):
                continue
            base = self.catalog.df(name)
            found = base.where(F.col(f"`{column}`") == F.lit(value).cast(base.schema[column].dataType))
            if not found.isEmpty():
                rows[name] = found
        if not rows:
            raise SubsetError(f"no table has rows with {self.spec.seed}")
        self.sealed = set(rows)
        return rows

    # -- adding rows

    def key(self, name: str) -> list[str]:
        return list(self.catalog.table(name).primary_key) or self.catalog.df(name).columns

    def key_columns(self, name: str) -> list[str]:
        """The columns by which other tables' rows follow from this one's, and this one's key."""
        table = self.catalog.table(name)
        used = {*table.key_columns, *(c for fk in self.catalog.constraints() if fk.parent == name for c in fk.parent_cols)}
        return [c for c in self.catalog.df(name).columns if c in used]

    def rows(self, name: str, make: Callable[[], DataFrame], ways: Callable[[], list[Way]] | None = None) -> Rows:
        return Rows((lambda: freeze(make(), "slice")) if self.spec.materialize else make, self.key_columns(name), ways)

    def missing(self, name: str, rows: DataFrame, have: DataFrame) -> DataFrame:
        """``rows`` that ``have`` lacks, by key, nulls being equal. Whole rows as keys are joined by a shuffle."""
        keys = have.select(*[F.col(f"`{c}`").alias(f"have_{i}") for i, c in enumerate(self.key(name))]).distinct()
        keys = sent_if_small(freeze(keys, "have_keys")) if self.catalog.table(name).primary_key else keys.hint("merge")
        return rows.join(keys, [rows[f"`{c}`"].eqNullSafe(keys[f"have_{i}"]) for i, c in enumerate(self.key(name))], "left_anti")

    def added(self, name: str, have: Rows, found: DataFrame) -> DataFrame:
        """The rows of ``have`` and those found that it lacks."""
        return have.df.unionByName(self.missing(name, found, have.keys if self.catalog.table(name).primary_key else have.df))

    def matching(self, name: str, ways: list[Way]) -> DataFrame:
        """Rows that come in by the ways; of a partitioned table leaves that no key falls into aren't read."""
        return rows_by(self.catalog.df_with(name, [(way.keys, dict(way.pairs)) for way in ways]), ways)

    def down_way(self, fk: ForeignKey, parents: DataFrame) -> Way:
        return children_in(fk, parents, self.filters.get(fk.child, ""))

    def capped(self, name: str, rows: DataFrame) -> DataFrame:
        if not self.spec.limit:
            return rows
        wider = freeze(rows.orderBy(*[F.col(f"`{c}`") for c in self.key(name)]).limit(self.spec.limit + 1), "limited")
        if wider.count() > self.spec.limit:
            self.truncated.append(name)
            wider = freeze(wider.orderBy(*[F.col(f"`{c}`") for c in self.key(name)]).limit(self.spec.limit), "limited")
        return wider

    # -- closures

    def down(self, start: dict[str, Rows]) -> dict[str, Rows]:
        """Start rows and all rows below them."""
        rows = dict(start)
        sources = dict(start)
        if not self.spec.expand_includes:
            sources = {t: r for t, r in start.items() if t not in {self.catalog.resolve(i) for i in self.spec.include}}
        if self.spec.depth:
            return rows | self._down_by_hops(start, sources)
        for group in cycles(self.catalog, self._below(sources)):
            found: dict[str, Rows] = {}
            for name in sorted(group):
                ways = [fk for fk in self._entries(name) if fk.parent in sources and fk.parent not in group]
                if ways:
                    found[name] = self._found_below(name, ways, dict(sources))
                if len(ways) == 1 and name not in start and len(group) == 1 and ways[0].parent != name:
                    self.settled.add(ways[0])
            loops = [fk for name in group for fk in self._entries(name) if fk.parent in group]
            if loops:
                begin = {t: self._together(t, sources.get(t), found.get(t)) for t in sorted(group)}
                follow = lambda fk, last: (fk.child, self.down_way(fk, last[fk.parent])) if fk.parent in last else None
                found = self._looped({t: r for t, r in begin.items() if r}, group, follow, loops, True)
            for name, own in found.items():
                rows[name] = sources[name] = self._together(name, None if loops and name in sources else rows.get(name), own)
        return rows

    def _by_ways(self, name: str, ways: Callable[[], list[Way]]) -> Rows:
        return self.rows(name, lambda: self.matching(name, ways()), ways)

    def _found_below(self, name: str, fks: list[ForeignKey], sources: dict[str, Rows]) -> Rows:
        ways = lambda: [self.down_way(fk, sources[fk.parent].keys) for fk in fks]
        return self.rows(name, lambda: self.capped(name, self.matching(name, ways()))) if self.spec.limit else self._by_ways(name, ways)

    def _together(self, name: str, have: Rows | None, found: Rows | None) -> Rows | None:
        if have is None or found is None:
            return found if have is None else have
        return self.rows(name, lambda: self.added(name, have, found.df))

    def _entries(self, name: str) -> list[ForeignKey]:
        return [] if name in self.sealed else self.into.get(name, [])

    def _below(self, tables: Iterable[str]) -> set[str]:
        seen, todo = set(), list(tables)
        while todo:
            name = todo.pop()
            if name not in seen:
                seen.add(name)
                todo += [fk.child for fk in self.below.get(name, []) if fk.child not in self.sealed]
        return seen

    def _down_by_hops(self, start: dict[str, Rows], sources: dict[str, Rows]) -> dict[str, Rows]:
        """Rows within a number of hops. Each hop reads a table once, for the keys of the rows below
        those found last, and the rows are read once at the end; with a limit a hop looks below
        all rows so far, since those that count may change."""
        have = {t: r.keys for t, r in sources.items() if self.below.get(t)}
        last, rows = dict(have), {}
        for hop in range(self.spec.depth):
            ways: dict[str, list[Way]] = {}
            for name in sorted({fk.child for p in last for fk in self.below.get(p, [])}):
                own = [self.down_way(fk, last[fk.parent]) for fk in self._entries(name) if fk.parent in last]
                if own:
                    ways[name] = own
            if hop + 1 == self.spec.depth or not ways:
                break
            new = {}
            for name, own in ways.items():
                if not self.below.get(name):
                    continue
                found = narrow(self.capped(name, self.matching(name, own)), self.key_columns(name))
                if name in have and not self.spec.limit:
                    found = found.join(sent_if_small(have[name]), [found[f"`{c}`"].eqNullSafe(have[name][f"`{c}`"]) for c in self.key_columns(name)], "left_anti")
                new[name] = freeze(found, "hop_keys")
            for name, found in new.items():
                have[name] = have[name].unionByName(found) if name in have and not self.spec.limit else found
                if self.spec.limit and name in sources:
                    have[name] = have[name].unionByName(sources[name].keys)
            last = dict(have) if self.spec.limit else new
        for name in sorted({fk.child for p in have for fk in self.below.get(p, [])}):
            own = [self.down_way(fk, have[fk.parent]) for fk in self._entries(name) if fk.parent in have]
            if own:
                found = self.rows(name, lambda name=name, own=own: self.capped(name, self.matching(name, own)), None if self.spec.limit else lambda own=own: own)
                rows[name] = self._together(name, start.get(name), found)
        return rows

    def up(self, rows: dict[str, Rows]) -> dict[str, Rows]:
        """The rows and all rows that their keys reference, however far up."""
        rows, grown = dict(rows), set()
        for group in reversed(cycles(self.catalog, self._above(rows))):
            for name in sorted(group):
                ways = [fk for fk in self._references(name) if fk.child in rows and fk.child not in group and (fk not in self.settled or fk.child in grown)]
                if ways:
                    rows[name] = self._found_above(name, ways, dict(rows))
                    grown.add(name)
            loops = [fk for name in group for fk in self._references(name) if fk.child in group]
            begin = {t: rows[t] for t in group if t in rows}
            if loops and begin:
                grown |= group
                rows |= self._looped(begin, group, lambda fk, last: (fk.parent, parents_of(fk, last[fk.child])) if fk.child in last else None, loops, False)
        return rows

    def _found_above(self, name: str, fks: list[ForeignKey], rows: dict[str, Rows]) -> Rows:
        have = rows.get(name)
        ways = lambda: [parents_of(fk, rows[fk.child].keys) for fk in fks]
        if have is None:
            return self._by_ways(name, ways)
        if have.ways:  # all ways in one pass over the table
            return self._by_ways(name, lambda: have.ways() + ways())
        return self.rows(name, lambda: self.added(name, have, self.matching(name, ways())))

    def _references(self, name: str) -> list[ForeignKey]:
        if name in self.excluded:
            return []
        return [fk for fk in self.catalog.constraints() if fk.parent == name and fk.child not in self.excluded]

    def _above(self, tables: Iterable[str]) -> set[str]:
        seen, todo = set(), list(tables)
        while todo:
            name = todo.pop()
            if name not in seen and name in self.catalog.tables and name not in self.excluded:
                seen.add(name)
                todo += [fk.parent for fk in self.catalog.table(name).foreign_keys]
        return seen

    def _looped(self, begin: dict[str, Rows], group: set[str], step: Callable, edges: list[ForeignKey], downwards: bool) -> dict[str, Rows]:
        """The tables of a cycle, iterated when one of them is first asked for."""
        done: list[dict[str, DataFrame]] = []

        def make(name: str) -> DataFrame:
            if not done:
                start = {t: r.df for t, r in begin.items()}
                done.append(self._doubled(start, group, edges, downwards) if self._can_double(edges, downwards) else self._iterate(start, step, edges, downwards))
            return done[0][name] if name in done[0] else self.catalog.df(name).limit(0)

        return {t: Rows(lambda t=t: make(t), self.key_columns(t)) for t in sorted(group)}

    def _can_double(self, edges: list[ForeignKey], downwards: bool) -> bool:
        """Whether each table of a cycle has one key in it, so that a row has one parent there, and all keys to
        a table mean the same values of it. A limit counts hop by hop."""
        if len({fk.child for fk in edges}) < len(edges) or (downwards and self.spec.limit):
            return False
        into: dict[str, set] = {}
        for fk in edges:
            into.setdefault(fk.parent, set()).add((fk.parent_cols, *map(str, kinds_of(self.catalog.frames, fk))))
        return all(len(x) == 1 for x in into.values())

    def _doubled(self, begin: dict[str, DataFrame], group: set[str], edges: list[ForeignKey], downwards: bool) -> dict[str, DataFrame]:
        """Rows of a cycle's tables to the fixpoint, along doubled paths. A row is a node by the key that others reference,
        and points to its parent's; what a filter excludes has no pointer, since no step leads down to it."""
        tags = {t: i for i, t in enumerate(sorted(group))}
        own = {fk.child: fk for fk in edges}
        into = {fk.parent: fk for fk in edges}

        def node(table: str, fk: ForeignKey, columns: tuple[str, ...], names: tuple[str, ...]) -> list[Column]:
            num, text = key_value(columns, kinds_of(self.catalog.frames, fk))
            return [F.lit(tags[table]).alias(names[0]), F.coalesce(num, F.lit(0)).alias(names[1]), F.coalesce(text, F.lit("")).alias(names[2])]

        whole = lambda columns: reduce(Column.__and__, [F.col(f"`{c}`").isNotNull() for c in columns])
        here = lambda df, t: df.where(whole(into[t].parent_cols)).select(*node(t, into[t], into[t].parent_cols, NODE))
        pairs = []
        for t in sorted(group):
            rows = self.catalog.df(t)
            if downwards and t in self.filters:
                rows = rows.where(self.filters[t])
            fk = own[t]
            rows = rows.where(whole(fk.child_cols) & whole(into[t].parent_cols))
            pairs.append(rows.select(*node(t, into[t], into[t].parent_cols, NODE), *node(fk.parent, fk, fk.child_cols, TO)))
        pairs = freeze(reduce(DataFrame.unionByName, pairs).distinct(), "key_pairs")
        start = reduce(DataFrame.unionByName, [here(df, t) for t, df in begin.items()])
        reached = sent_if_small(reached_from(start, pairs, ahead=not downwards))
        if not downwards:  # the rows that are pointed to; what the start holds comes from the start
            reached = sent_if_small(freeze(renamed(pairs.join(reached, list(NODE), "left_semi"), TO, NODE).distinct(), "reached"))
        out = dict(begin)
        for t in sorted(group):
            fk, columns = (own[t], own[t].child_cols) if downwards else (into[t], into[t].parent_cols)
            base = self.catalog.df(t)
            rows = base.where(self.filters[t]) if downwards and t in self.filters else base
            at = node(fk.parent, fk, columns, TO)
            wide = rows.where(whole(columns)).withColumns({f"reach_{c}": x for c, x in zip(TO, at, strict=True)})
            found = wide.join(renamed(reached, NODE, tuple(f"reach_{c}" for c in TO)), [f"reach_{c}" for c in TO], "left_semi").select(*[F.col(f"`{c}`") for c in base.columns])
            out[t] = freeze(begin[t].unionByName(self.missing(t, found, begin[t])) if t in begin else found, "cycle")
        return out

    def _iterate(self, begin: dict[str, DataFrame], step: Callable, edges: list[ForeignKey], downwards: bool) -> dict[str, DataFrame]:
        """Rows of a cycle's tables to the fixpoint, following only the rows found last; a round shuffles what it
        finds, and not the rows before."""
        have: dict[str, list[DataFrame]] = {}
        with ExitStack() as stack:
            seen: dict[str, Seen] = {}

            def keep(name: str, rows: DataFrame) -> None:
                if name not in seen:
                    seen[name] = stack.enter_context(Seen(self.catalog.spark, self.key(name)))
                seen[name].add(rows)
                have.setdefault(name, []).append(rows)

            last = {t: freeze(df, "cycle") for t, df in begin.items()}
            for name, rows in last.items():
                keep(name, rows)
            for _ in range(self.spec.max_rounds):
                ways: dict[str, list[Way]] = {}
                for fk in edges:
                    if way := step(fk, last):
                        ways.setdefault(way[0], []).append(way[1])
                last = {}
                for name, conditions in ways.items():
                    found = self.matching(name, conditions)
                    if downwards:
                        found = self.capped(name, found)
                    new = freeze(seen[name].new(found) if name in seen else found, "cycle")
                    if not new.isEmpty():
                        last[name] = new
                for name, new in last.items():
                    keep(name, new)
                if not last:
                    return {t: reduce(DataFrame.unionByName, parts) for t, parts in have.items()}
        raise SubsetError(f"no fixpoint after {self.spec.max_rounds} rounds")

    def closure(self) -> dict[str, Rows]:
        start = {t: Rows(lambda df=df: df, self.key_columns(t)) for t, df in self.start().items()}
        if not self.spec.table_level:
            return self.up(self.down(start))
        # rows of tables reached down expand whatever brought them there
        rows, before = start, None
        for _ in range(self.spec.max_rounds):
            self.settled = set()
            down = self.down({t: r for t, r in rows.items() if t in self._below(start)})
            frozen = {t: freeze(r.df, "table_level") for t, r in self.up({**rows, **down}).items()}
            rows = {t: Rows(lambda df=df: df, self.key_columns(t)) for t, df in frozen.items()}
            counts = {t: df.count() for t, df in frozen.items()}
            if counts == before:
                return rows
            before = counts
        raise SubsetError(f"no fixpoint after {self.spec.max_rounds} rounds")

    def run(self) -> Slice:
        rows = self.closure()
        for name in sorted(rows):
            for fk in self.catalog.table(name).foreign_keys:
                if fk.parent in self.excluded:
                    self.warnings.append(f"{name}.{fk.name} references the excluded table {fk.parent}")
        order = load_order(self.catalog, rows, lambda names: self.warnings.append(f"circular keys: {', '.join(names)}"))
        tables = Tables({name: lambda name=name: apply_masks(rows[name].df, self.masks.get(name, {}), self.catalog.table(name).generated) for name in order})
        if self.spec.limit:
            list(tables.values())  # what a limit cuts off is known when the rows are
        unreached = [t for t in self.catalog.names() if t not in rows and t not in self.excluded]
        return Slice(self.catalog, tables, self.spec.root or self.spec.seed, list(self.spec.masks), list(self.spec.filters), unreached, sorted(set(self.warnings)), sorted(set(self.truncated)))


def extract(catalog: Catalog, spec: SubsetSpec | None = None, **options) -> Slice:
    """The slice that a spec (or its fields as keywords) asks for."""
    return Extraction(catalog, spec or SubsetSpec(**options)).run()
