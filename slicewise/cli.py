"""Command line: python -m slicewise.cli COMMAND.

The connection is a YAML registry of tables, a folder of Parquet tables beside
one, or a jdbc: URL; by flag, profile or DATABASE_URL.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

from .config import Profile, find_profile, resolve_masks
from .operators.integrity import check, format_check, format_cleanup_sql, total_orphans
from .operators.load import JdbcTarget, LoadError, ParquetTarget, RegistryTarget, Target, apply
from .operators.subset import SubsetSpec, extract
from .plans.graph import format_inspect, format_roots, reachable, root_candidates
from .plans.pii import Confidence, analyze, format_analysis, policy_yaml
from .plans.suggest_fks import discover, format_ddl, format_suggestions, pairs_by_type, suggest, validate
from .sources import jdbc, slices
from .sources.catalog import DEFAULT_SCHEMA, Catalog, from_yaml


def comma_list(values: list[str]) -> list[str]:
    return [part.strip() for value in values for part in value.split(",") if part.strip()]


def open_catalog(spark: SparkSession, connection: str, schema: str = "", timeout: int = 0, one_moment: bool = False) -> Catalog:
    """A database's catalog, or a registry's; with ``one_moment`` a database is read of one snapshot, as files always are."""
    if connection.startswith("jdbc:"):
        return jdbc.catalog(spark, connection, {"queryTimeout": str(timeout)} if timeout else None, default_schema=schema or DEFAULT_SCHEMA, one_moment=one_moment)
    path = Path(connection)
    catalog = from_yaml(spark, path / "catalog.yaml" if path.is_dir() else path)
    if schema:
        catalog.default_schema = schema
    return catalog


def open_target(where: str, catalog: Catalog, connection: str, disable_triggers: bool = False) -> Target:
    """Where a load goes: a folder or JDBC URL that is named, or else the tables of the connection."""
    if where.startswith("jdbc:") or (not where and connection.startswith("jdbc:")):
        return JdbcTarget(where or connection, {"driver": "org.postgresql.Driver"} if "postgresql" in (where or connection) else {}, disable_triggers, catalog.spark, identity={t.name for t in catalog.tables.values() if t.has_identity})
    if disable_triggers:
        raise LoadError("only a database has triggers to disable")
    if not where or where == connection:
        return RegistryTarget(catalog)
    if where.endswith((".yaml", ".yml")) or (Path(where) / "catalog.yaml").is_file():
        return RegistryTarget(open_catalog(catalog.spark, where))
    return ParquetTarget(where)


def elapsed(seconds: float) -> str:
    return f"{seconds * 1000:.0f} ms" if seconds < 1 else f"{seconds:.1f} s" if seconds < 60 else f"{seconds // 60:.0f} min {seconds % 60:.0f} s"


@contextmanager
def timed(what: str, verbose: bool) -> Iterator[None]:
    """With ``verbose`` says on stderr how long a step took."""
    began = time.monotonic()
    yield
    if verbose:
        print(f"{what}: {elapsed(time.monotonic() - began)}", file=sys.stderr)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="slicewise", description=__doc__)
    top.add_argument("--profile", help="profile file (default: .slicewise.yaml in the working folder)")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, scoped: bool = True) -> argparse.ArgumentParser:
        out = commands.add_parser(name, help=text, description=text)
        out.add_argument("--connection")
        out.add_argument("--schema")
        if scoped:
            out.add_argument("--root", help="only tables reachable from this one")
            out.add_argument("--depth", type=int, default=0, help="key hops from the root (0: any)")
            out.add_argument("--statement-timeout", type=int, default=0, help="seconds until running jobs are cancelled")
            out.add_argument("--verbose", action="store_true")
        return out

    c = command("extract", "Take a referentially closed slice.", scoped=False)
    for name in ("root", "seed", "output", "masks-file"):
        c.add_argument(f"--{name}", *(["-o"] if name == "output" else []))
    c.add_argument("--format", choices=["parquet", "jsonl", "json", "sql"])
    for name in ("limit", "depth", "statement-timeout"):
        c.add_argument(f"--{name}", type=int)
    for name in ("include", "exclude", "mask", "mask-policy", "filter"):
        c.add_argument(f"--{name}", action="append", default=[])
    for name in ("no-masks", "transaction", "on-conflict-do-nothing", "dry-run", "verbose"):
        c.add_argument(f"--{name}", action="store_true")
    c = command("apply", "Load a slice, parents first.", scoped=False)
    c.add_argument("slice")
    c.add_argument("--target", help="folder or jdbc: URL (default: the tables of the connection)")
    for name in ("force", "dry-run", "disable-triggers", "sync-sequences"):
        c.add_argument(f"--{name}", action="store_true")
    c = command("check", "Count rows whose foreign key has no parent.")
    c.add_argument("--samples", type=int, default=3)
    c.add_argument("--emit-sql", action="store_true")
    c = command("suggest-fks", "Find undeclared foreign keys.")
    for name in ("show-unmatched", "emit-sql"):
        c.add_argument(f"--{name}", action="store_true")
    looks = c.add_mutually_exclusive_group()
    looks.add_argument("--names-only", action="store_true", help="don't look at rows")
    looks.add_argument("--by-values", action="store_true", help="any column whose values are all in a key of its type")
    c = command("suggest-roots", "Rank tables to start a slice from.", scoped=False)
    c.add_argument("--top", type=int, default=10)
    c = command("analyze", "Find columns with personal data.")
    c.add_argument("--min-confidence", default="low")
    c.add_argument("--yaml", action="store_true")
    c.add_argument("--output", "-o")
    command("inspect", "Show tables, columns and keys.")
    return top


def merged_spec(args: argparse.Namespace, profile: Profile) -> SubsetSpec:
    """Flags before profile before defaults; masks of the command line come last and so win."""
    own = profile.extract
    masks = resolve_masks(profile, args.masks_file or "", comma_list(args.mask_policy), os.getcwd(), args.no_masks) + args.mask
    filters = [f"{k}={v}" for k, v in (own.get("filters") or {}).items()]
    named = {f.partition("=")[0].strip() for f in args.filter}
    root, seed = args.root, args.seed
    if not root and not seed:
        root, seed = own.get("root"), own.get("seed")
    return SubsetSpec(
        root=root,
        seed=seed,
        include=comma_list(args.include) or own.get("include") or [],
        exclude=comma_list(args.exclude) or own.get("exclude") or [],
        filters=[f for f in filters if f.partition("=")[0] not in named] + args.filter,
        masks=masks,
        limit=args.limit if args.limit is not None else own.get("limit", 0),
        depth=args.depth if args.depth is not None else own.get("depth", 0),
        materialize=True,
    )


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    profile = find_profile(args.profile) or Profile()
    connection = args.connection or profile.connection or os.environ.get("DATABASE_URL", "")
    if not connection:
        print("no connection: use --connection, a profile or DATABASE_URL", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("slicewise").getOrCreate()
    timeout = getattr(args, "statement_timeout", None) or profile.extract.get("statement_timeout", 0)
    verbose = getattr(args, "verbose", False)
    with timed("catalog", verbose):
        # a load must not wait for a moment of its own
        catalog = open_catalog(spark, connection, args.schema or profile.schema, timeout, one_moment=args.command != "apply")
    try:
        with cancelled_after(spark, timeout), timed(args.command, verbose):
            return run(args, profile, catalog, connection)
    finally:
        catalog.close()


class cancelled_after:
    """Cancels the jobs that run inside after a number of seconds (0: never)."""

    def __init__(self, spark: SparkSession, seconds: int) -> None:
        self.spark, self.seconds, self.timer = spark, seconds, None

    def __enter__(self) -> None:
        if self.seconds:
            from threading import Timer

            self.spark.addTag("slicewise-timeout")
            self.timer = Timer(self.seconds, self.spark.interruptTag, ["slicewise-timeout"])
            self.timer.start()

    def __exit__(self, *error: object) -> None:
        if self.timer:
            self.timer.cancel()
            self.spark.removeTag("slicewise-timeout")


def run(args: argparse.Namespace, profile: Profile, catalog: Catalog, connection: str) -> int:
    verbose = getattr(args, "verbose", False)
    if args.command == "extract":
        with timed("rows", verbose):
            cut = extract(catalog, merged_spec(args, profile))
            cut.filled  # noqa: B018  rows are found when they are asked for
        for warning in cut.warnings:
            print(f"Warning: {warning}", file=sys.stderr)
        output, form = args.output or profile.extract.get("output"), args.format or profile.extract.get("format") or "parquet"
        if args.dry_run or not output:
            for r in cut.row_counts().collect():
                print(f"{r['table_name']}: {r['row_count']} rows")
        elif form == "jsonl":
            slices.write_lines(cut, output, "overwrite")
        elif form == "json":
            Path(output).parent.mkdir(parents=True, exist_ok=True)
            slices.write_document(cut, output)
        elif form == "sql":
            own = profile.extract
            slices.write_sql(cut, output, args.transaction or own.get("transaction", False), args.on_conflict_do_nothing or own.get("on_conflict_do_nothing", False), "overwrite")
        else:
            slices.write_parquet(cut, output, "overwrite")
        return 0
    if args.command == "apply":
        cut = slices.read_document(catalog, args.slice) if args.slice.endswith(".json") else slices.read_slice(catalog, args.slice)
        own = profile.apply
        try:
            target = open_target(args.target or "", catalog, connection, args.disable_triggers or own.get("disable_triggers", False))
            result = apply(cut, target, args.force or own.get("force", False), args.dry_run, sync_sequences=args.sync_sequences or own.get("sync_sequences", False))
        except LoadError as e:
            print(f"not loaded: {e}", file=sys.stderr)
            return 1
        for name in result.order:
            print(f"{name}: {result.rows[name]} rows" + (f", last key {result.next_values[name]}" if name in result.next_values else ""))
        return 0
    scope = reachable(catalog, args.root, args.depth) if getattr(args, "root", None) else catalog.names()
    if args.command == "check":
        with timed(f"{len(catalog.constraints(scope))} constraint(s)", verbose):
            results = check(catalog, scope, args.samples)
        print(format_cleanup_sql(results) if args.emit_sql else format_check(results), end="")
        return 1 if total_orphans(results) else 0
    if args.command == "suggest-fks":
        found = (pairs_by_type if args.by_values else suggest)(catalog, scope)
        with timed(f"{len(found)} column(s)", verbose):
            if args.by_values:
                found = discover(catalog, scope)
            elif not args.names_only:
                found = validate(catalog, found)
        print(format_ddl(found) if args.emit_sql else format_suggestions(found, args.show_unmatched), end="")
    elif args.command == "suggest-roots":
        print(format_roots(root_candidates(catalog)[: args.top]), end="")
    elif args.command == "analyze":
        matches = analyze(catalog, scope, Confidence.parse(args.min_confidence))
        text = policy_yaml(catalog, matches, profile.database_id or "default") if args.yaml else format_analysis(catalog, matches, len(scope))
        if args.output:
            Path(args.output).write_text(text, encoding="utf-8")
        else:
            print(text, end="")
    else:
        print(format_inspect(catalog, scope), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
