"""Quoting of identifiers and literals for emitted PostgreSQL text."""

from __future__ import annotations

from collections.abc import Iterable

from ..sources.catalog import split_name


def quote_ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def quote_table(name: str) -> str:
    return ".".join(quote_ident(part) for part in split_name(name))


def quote_columns(names: Iterable[str]) -> str:
    return ", ".join(quote_ident(n) for n in names)


def backtick(name: str) -> str:
    """Quoting for Spark SQL."""
    return "`" + name.replace("`", "``") + "`"
