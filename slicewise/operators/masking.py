"""Masks: columns replaced by SQL expressions over the same row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import to_spark
from ..sources.catalog import Catalog


class MaskError(ValueError):
    """A mask or filter that the catalog can't take."""


def parse_masks(catalog: Catalog, specs: Iterable[str], force_keys: bool = False) -> dict[str, dict[str, str]]:
    """Table to column to expression, from ``[schema.]table.column=expression``; later specs win.

    Key columns can't be masked unless forced: masked keys no longer match.
    """
    out: dict[str, dict[str, str]] = {}
    for spec in specs:
        target, equals, expression = spec.partition("=")
        name, dot, column = target.strip().rpartition(".")
        if not equals or not dot or not expression.strip():
            raise MaskError(f"a mask reads [schema.]table.column=expression: {spec!r}")
        table = catalog.table(name)
        if not table.column(column):
            raise MaskError(f"{table.name} has no column {column}")
        if column in table.key_columns and not force_keys:
            raise MaskError(f"{table.name}.{column} is a key column")
        out.setdefault(table.name, {})[column] = expression.strip()
    return out


def parse_filters(catalog: Catalog, specs: Iterable[str]) -> dict[str, str]:
    """Table to condition, from ``table=condition``."""
    out = {}
    for spec in specs:
        name, equals, condition = spec.partition("=")
        if not equals or not condition.strip():
            raise MaskError(f"a filter reads table=condition: {spec!r}")
        out[catalog.resolve(name.strip())] = to_spark(condition.strip())
    return out


def apply_masks(df: DataFrame, masks: dict[str, str], generated: Iterable[str] = ()) -> DataFrame:
    """Masked columns keep place and type; every expression sees the unmasked row; generated columns go."""
    types = dict(df.dtypes)
    masked = df.withColumns({c: F.expr(to_spark(e)).cast(types[c]) for c, e in masks.items()}) if masks else df
    return masked.drop(*generated)
