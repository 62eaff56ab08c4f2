"""Orphan rows: rows whose foreign key has no parent.

A row with a null in any key column is exempt (MATCH SIMPLE). All constraints of a
catalog are looked at in one pass over its tables (``keys``), and the samples of all that
are broken in a second one over their children.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quoting import quote_ident, quote_table
from ..scratch import freeze
from ..sources.catalog import Catalog, ForeignKey
from .keys import counts_by_tag, first_orphans, labelled, orphan_keys


def orphans(child: DataFrame, parent: DataFrame, child_cols: Iterable[str], parent_cols: Iterable[str]) -> DataFrame:
    """Rows of ``child`` whose key isn't in ``parent``; whole rows, in any number."""
    pairs = list(zip(child_cols, parent_cols, strict=True))
    keys = parent.select(*[F.col(f"`{p}`").alias(f"parent_key_{i}") for i, (_, p) in enumerate(pairs)])
    present = child.dropna(subset=[c for c, _ in pairs])
    return present.join(keys, [present[f"`{c}`"] == keys[f"parent_key_{i}"] for i, (c, _) in enumerate(pairs)], "left_anti")


def orphans_of(catalog: Catalog, fk: ForeignKey) -> DataFrame:
    return orphans(catalog.df(fk.child), catalog.df(fk.parent), fk.child_cols, fk.parent_cols)


LABELS = "child_table string, constraint_name string, child_columns string, parent_table string, parent_columns string"


def label_of(fk: ForeignKey) -> tuple:
    return fk.child, fk.name, ",".join(fk.child_cols), fk.parent, ",".join(fk.parent_cols)


def tables_of(catalog: Catalog, keys: Iterable[ForeignKey]) -> dict[str, DataFrame]:
    return {name: catalog.df(name) for fk in keys for name in (fk.child, fk.parent)}


def orphan_counts(catalog: Catalog, tables: Iterable[str] | None = None) -> DataFrame:
    """One row per constraint of the tables, orphan-free ones included."""
    keys = catalog.constraints(tables)
    if not keys:
        return catalog.spark.createDataFrame([], f"{LABELS}, orphan_count long")
    return labelled(catalog.spark, orphan_keys(tables_of(catalog, keys), keys), [label_of(fk) for fk in keys], LABELS)


def sample_columns(catalog: Catalog, fk: ForeignKey) -> list[str]:
    """Primary key, then key columns, each once."""
    return list(dict.fromkeys([*catalog.table(fk.child).primary_key, *fk.child_cols]))


def orphan_samples(catalog: Catalog, fk: ForeignKey, samples: int = 3) -> DataFrame:
    """The first orphans by the sampled columns."""
    columns = [f"`{c}`" for c in sample_columns(catalog, fk)]
    return orphans_of(catalog, fk).select(*columns).orderBy(*columns).limit(samples)


def all_orphan_samples(catalog: Catalog, tables: Iterable[str] | None = None, samples: int = 3) -> DataFrame:
    """(child_table, constraint_name, place, sample): the first orphans of every constraint, as JSON text of the sampled columns."""
    keys = catalog.constraints(tables)
    schema = "child_table string, constraint_name string, place int, sample string"
    if not keys:
        return catalog.spark.createDataFrame([], schema)
    frames = tables_of(catalog, keys)
    found = freeze(orphan_keys(frames, keys), "orphan_keys")
    rows = first_orphans(frames, keys, found, [sample_columns(catalog, fk) for fk in keys], samples)
    one_of = lambda of: F.coalesce(*[F.when(F.col("tag") == tag, of(tag, fk)) for tag, fk in enumerate(keys)])
    return rows.select(
        one_of(lambda tag, fk: F.lit(fk.child)).alias("child_table"),
        one_of(lambda tag, fk: F.lit(fk.name)).alias("constraint_name"),
        "place",
        one_of(lambda tag, fk: F.to_json(f"key_{tag}", {"ignoreNullFields": "false"})).alias("sample"),
    )


@dataclass
class OrphanResult:
    constraint: ForeignKey
    count: int
    columns: list[str] = field(default_factory=list)
    samples: list[tuple] = field(default_factory=list)


def check(catalog: Catalog, tables: Iterable[str] | None = None, samples: int = 3) -> list[OrphanResult]:
    """Counts of every constraint and a few orphans of those that have any."""
    keys = catalog.constraints(tables)
    if not keys:
        return []
    frames = tables_of(catalog, keys)
    found = freeze(orphan_keys(frames, keys), "orphan_keys")
    columns = [sample_columns(catalog, fk) for fk in keys]
    # counts (place 0) and samples together are one job, of at most 1 + samples rows a constraint
    rows = counts_by_tag(found).withColumn("place", F.lit(0))
    if samples > 0:
        rows = rows.unionByName(first_orphans(frames, keys, found, columns, samples), allowMissingColumns=True)
    results = [OrphanResult(fk, 0) for fk in keys]
    for row in sorted(rows.collect(), key=lambda r: (r["tag"], r["place"])):
        result = results[row["tag"]]
        if row["place"]:
            result.columns = columns[row["tag"]]
            result.samples.append(tuple(row[f"key_{row['tag']}"]))
        else:
            result.count = row["n"]
    return results


def total_orphans(results: Iterable[OrphanResult]) -> int:
    return sum(r.count for r in results)


def format_check(results: list[OrphanResult]) -> str:
    """A section for each table, a line for each of its keys, and what it comes to."""
    sections: dict[str, list[str]] = {}
    for r in results:
        verdict = f"{r.count} without a parent" if r.count else "complete"
        lines = sections.setdefault(r.constraint.child, [])
        lines.append(f"  {r.constraint.label()} [{r.constraint.name}]: {verdict}")
        lines += ["    e.g. " + ", ".join(f"{c} = {'null' if v is None else v}" for c, v in zip(r.columns, s, strict=True)) for s in r.samples]
    bad = [r for r in results if r.count]
    whole = f"{len(results)} key(s) checked, {len(bad)} broken"
    whole += f": {total_orphans(results)} row(s) without a parent in {', '.join(dict.fromkeys(r.constraint.child for r in bad))}" if bad else ""
    return "".join(f"{table}\n" + "\n".join(lines) + "\n\n" for table, lines in sections.items()) + whole + "\n"


def orphan_predicate(fk: ForeignKey) -> str:
    """PostgreSQL text of the condition that makes row ``c`` an orphan."""
    present = [f"c.{quote_ident(x)} IS NOT NULL" for x in fk.child_cols]
    same = " AND ".join(f"p.{quote_ident(y)} = c.{quote_ident(x)}" for x, y in zip(fk.child_cols, fk.parent_cols, strict=True))
    return " AND ".join([*present, f"NOT EXISTS (SELECT 1 FROM {quote_table(fk.parent)} AS p WHERE {same})"])


def format_cleanup_sql(results: Iterable[OrphanResult]) -> str:
    """A script that deletes orphans from the source database, to be reviewed first."""
    parts = ["-- Orphans of the slice's source. Look at each statement before it is run.\n"]
    for r in results:
        if r.count:
            fk = r.constraint
            parts.append(f"-- {r.count} row(s) by {fk.name}\nDELETE FROM {quote_table(fk.child)} AS c\nWHERE {orphan_predicate(fk)};\n")
    return "\n".join(parts if len(parts) > 1 else [*parts, "-- There are none.\n"])


def repaired(catalog: Catalog, fk: ForeignKey) -> DataFrame:
    """The child without its orphans."""
    child, parent = catalog.df(fk.child), catalog.df(fk.parent)
    keys = parent.select(*[F.col(f"`{p}`").alias(f"parent_key_{i}") for i, p in enumerate(fk.parent_cols)])
    exempt = child.where(" OR ".join(f"`{c}` IS NULL" for c in fk.child_cols))
    matched = child.join(keys, [child[f"`{c}`"] == keys[f"parent_key_{i}"] for i, c in enumerate(fk.child_cols)], "left_semi")
    return matched.unionByName(exempt)
