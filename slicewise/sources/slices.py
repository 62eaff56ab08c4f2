"""Slices on disk.

The native form is a folder with a Parquet table for each table and a manifest; the
same with JSON lines has values as text where JSON has no such type. The SQL form is one
folder of INSERT statements, cut into steps in load order. The JSON document ``{meta,
table_order, tables: {name: {columns, rows, identity_columns}}}`` is for interchange (``document``).
"""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quoting import backtick
from ..functions.rendering import insert_statements, parsed, rendered
from ..operators.subset import Slice
from . import document
from .catalog import Catalog


def manifest(cut: Slice) -> dict:
    return {
        "extracted_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "root": cut.root,
        "masks_applied": cut.masks,
        "filters_applied": cut.filters,
        "untouched_tables": cut.untouched,
        "warnings": cut.warnings,
        "truncated": cut.truncated,
        "table_order": list(cut.filled),
    }


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\n\n")


def write_parquet(cut: Slice, path: str, mode: str = "error") -> None:
    """``path/<table>`` for each table that has rows, and ``path/manifest`` last, so that a folder with one is complete."""
    for name, df in cut.filled.items():
        df.write.mode(mode).parquet(f"{path}/{name}")
    _write_text(cut.catalog.spark, json.dumps(manifest(cut)), f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])


def _with_meta(catalog: Catalog, tables: dict[str, DataFrame], meta: dict) -> Slice:
    return Slice(catalog, tables, meta["root"], meta["masks_applied"], meta["filters_applied"], meta["untouched_tables"], meta["warnings"], meta["truncated"])


def read_slice(catalog: Catalog, path: str) -> Slice:
    """A slice from a folder of Parquet tables or JSON lines, whichever the manifest says."""
    meta = read_manifest(catalog.spark, path)
    if meta.get("format") == "jsonl":
        return _with_meta(catalog, {name: _read_lines(catalog, name, f"{path}/{name}", meta["columns"][name]) for name in meta["table_order"]}, meta)
    return _with_meta(catalog, {name: catalog.spark.read.parquet(f"{path}/{name}") for name in meta["table_order"]}, meta)


def write_lines(cut: Slice, path: str, mode: str = "error", seconds_only: bool = False) -> None:
    """``path/<table>`` folders of JSON lines, written in parallel, and ``path/manifest`` last."""
    columns = {}
    for name in cut.filled:
        rows = rendered_rows(cut, name, seconds_only)
        columns[name] = rows.columns
        rows.write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/{name}")
    _write_text(cut.catalog.spark, json.dumps(manifest(cut) | {"format": "jsonl", "columns": columns}), f"{path}/manifest")


def _read_lines(catalog: Catalog, name: str, path: str, columns: list[str]) -> DataFrame:
    """Every value is read as text and made one of the catalog's type, so large integers keep all digits."""
    types = dict(catalog.df(name).dtypes)
    rows = catalog.spark.read.schema(", ".join(f"{backtick(c)} string" for c in columns)).json(path)
    return rows.select(*[parsed(F.col(backtick(c)), types[c]).alias(c) for c in columns])


def write_sql(cut: Slice, path: str, transaction: bool = False, on_conflict_do_nothing: bool = False, mode: str = "error") -> None:
    """``path/step=NNNN_<table>`` folders of INSERT statements, written in parallel by one job.

    Run in the order of their names they load the slice; the first and last begin and commit
    where a transaction is asked for. What an earlier slice left in the folder is gone after
    an overwrite.
    """
    spark = cut.catalog.spark
    head = f"-- Root: {cut.root}\n" + ("BEGIN;" if transaction else "")
    line = lambda step, text: spark.createDataFrame([(text, step)], "value string, step string")
    steps = [line("0000_begin", head)]
    for number, (name, df) in enumerate(cut.filled.items(), 1):
        identity = cut.catalog.table(name).has_identity
        steps.append(insert_statements(df, name, identity, on_conflict_do_nothing).withColumn("step", F.lit(f"{number:04d}_{name}")))
    if transaction:
        steps.append(line("9999_commit", "COMMIT;"))
    reduce(DataFrame.unionByName, steps).write.mode(mode).partitionBy("step").text(path)


def rendered_rows(cut: Slice, name: str, seconds_only: bool = False) -> DataFrame:
    """The table's rows as the JSON document states them."""
    table = cut.catalog.table(name)
    logical = {c.name: c.type for c in table.columns}
    return cut.tables[name].select(*[rendered(F.col(f"`{c}`"), t, logical.get(c, ""), seconds_only).alias(c) for c, t in cut.tables[name].dtypes])


def write_document(cut: Slice, path: str, seconds_only: bool = False) -> None:
    """The JSON document, written in parallel: as one file if it is small, else as a folder of parts whose bytes end to end it is."""
    meta = manifest(cut)
    order = meta.pop("table_order")
    meta = {k: v for k, v in meta.items() if v or k in ("extracted_at", "root")}
    spark = cut.catalog.spark
    line = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    lines = [line(f'{{"meta": {json.dumps(meta)},\n"table_order": {json.dumps(order)},\n"tables": {{')]
    for i, name in enumerate(order):
        rows = rendered_rows(cut, name, seconds_only)
        head = f'{"," if i else ""}{json.dumps(name)}: {{"columns": {json.dumps(rows.columns)}, "identity_columns": {json.dumps(cut.catalog.table(name).has_identity)}, "rows": ['
        lines += [line(head), document.row_lines(rows), line("]}")]
    document.write_parts(spark, [*lines, line("}}")], path if "://" in path else os.path.abspath(path))


def read_document(catalog: Catalog, path: str) -> Slice:
    """A slice from the JSON document, a file or a folder of parts, read in parallel whatever its lines; values are cast to
    the catalog's types, so large integers keep all digits."""
    spark = catalog.spark
    said, rows = document.read_rows(spark, path if "://" in path else os.path.abspath(path))
    tables, meta = said["tables"], said["meta"]
    starts = sorted(t["rows"][0] for t in tables.values() if t["rows"])
    out = {}
    for name in [n for n in said.get("table_order") or sorted(tables) if n in tables]:
        first, columns = (tables[name]["rows"] or [None])[0], tables[name]["columns"]
        own = rows.where(F.lit(False)) if first is None else rows.where(F.col("at") >= first)
        if first is not None and first != starts[-1]:
            own = own.where(F.col("at") < starts[starts.index(first) + 1])
        types = dict(catalog.df(name).dtypes)
        values = own.select(F.from_json("text", "array<string>").alias("r"))
        out[name] = values.select(*[parsed(F.col("r")[i], types[c]).alias(c) for i, c in enumerate(columns)])
    return Slice(catalog, out, meta["root"], meta.get("masks_applied") or [], meta.get("filters_applied") or [], meta.get("untouched_tables") or [])
