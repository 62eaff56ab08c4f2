"""Tables of files that are partitioned by bounds, in any depth: a tree whose leaves hold the rows.

``{by: range, column: day, of: {name: {from: .., to: ..}, ..}}`` with ``by: list`` and ``{values: [..]}`` (null may be one) or ``by: hash``
(no bounds, never pruned); ``{default: true}`` takes what no other takes. A part is ``{path: ..}`` or has ``partitions`` of its own.
Ranges hold their lower bound and not their upper one; a missing bound is open.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PartitionError(ValueError):
    """A partition tree that isn't one."""


@dataclass(frozen=True)
class Bound:
    """What a part says of a column; without low, high and values nothing, but that it isn't null."""

    column: str
    low: object = None
    high: object = None
    values: tuple = ()
    anything: bool = False

    def may_hold(self, column: Column, kind: str) -> Column:
        """Whether a row with that value may be in the part; null values are only where a list or a default has them."""
        if self.anything:
            return F.lit(True)
        as_kind = lambda x: F.lit(x).cast(kind)
        if self.values:
            held = [column == as_kind(v) for v in self.values if v is not None]
            null = column.isNull() if None in self.values else F.lit(False)
            return null | F.coalesce(reduce(Column.__or__, held), F.lit(False)) if held else null
        out = column.isNotNull()
        if self.low is not None:
            out &= column >= as_kind(self.low)
        if self.high is not None:
            out &= column < as_kind(self.high)
        return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class Leaf:
    """A part that holds rows, with the bounds of all parts that it is in."""

    name: str
    path: str
    bounds: tuple[Bound, ...]


def leaves(tree: Mapping, base: str, above: tuple[Bound, ...] = ()) -> list[Leaf]:
    """The leaves of a partition tree as a registry states it, with paths below ``base``."""
    by, column, out = tree.get("by"), tree.get("column"), []
    if by not in ("range", "list", "hash") or not column or not tree.get("of"):
        raise PartitionError("a partitioned table needs by (range, list or hash), column and of")
    for name, part in tree["of"].items():
        part = part or {}
        if part.get("default") or by == "hash":
            bound = Bound(column, anything=True)
        elif by == "list":
            if not part.get("values"):
                raise PartitionError(f"the list partition {name} has no values")
            bound = Bound(column, values=tuple(part["values"]))
        else:
            bound = Bound(column, part.get("from"), part.get("to"))
        if "partitions" in part:
            out += leaves(part["partitions"], base, (*above, bound))
        else:
            path = part.get("path", f"{name}.parquet")
            out.append(Leaf(name, path if "://" in path or path.startswith("/") else f"{base}/{path}", (*above, bound)))
    return out


def touched(parts: list[Leaf], keys: DataFrame, columns: Mapping[str, str], kinds: Mapping[str, str]) -> list[Leaf]:
    """The leaves in which rows may be whose columns have one of the keys; ``columns`` maps a table's column to that of
    the keys, and bounds of others tell nothing. One job, of one row of a flag for each leaf."""
    if not any(b.column in columns and not b.anything for leaf in parts for b in leaf.bounds):
        return parts
    may = [reduce(Column.__and__, [b.may_hold(F.col(f"`{columns[b.column]}`"), kinds[b.column]) for b in leaf.bounds if b.column in columns], F.lit(True)) for leaf in parts]
    flags = keys.agg(*[F.max(m).alias(f"leaf_{i}") for i, m in enumerate(may)]).first()
    return [leaf for leaf, flag in zip(parts, flags, strict=True) if flag]
