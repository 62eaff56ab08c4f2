"""The keys of many constraints in one pass over the tables.

Each table is scanned once, whatever the number of its keys: its key columns are unpivoted
to rows (tag, value, as child or as parent), which are combined before and after one
shuffle, so that a value that a third of all rows have is a row for each task. A value
that no parent has is an orphan's, and its count says of how many rows. Nothing is joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from ..sources.catalog import ForeignKey

VALUE = ("tag", "num", "text")


def common_type(spark: SparkSession, a: DataType, b: DataType) -> DataType:
    """The type in which Spark compares the two."""
    both = F.coalesce(F.lit(None).cast(a), F.lit(None).cast(b))
    return a if a == b else spark.range(0).select(both.alias("both")).schema["both"].dataType


def _as_text(column: Column, kind: DataType) -> Column:
    """Text that is equal where values are."""
    name = kind.typeName()
    if name == "timestamp":
        return F.unix_micros(column).cast("string")  # its own text depends on the zone and repeats an hour
    if name in ("double", "float"):
        return (column + F.lit(0.0)).cast("string")  # of the zeros there is one
    if name == "binary":
        return F.hex(column)
    return F.to_json(F.struct(column)) if name in ("array", "struct", "map") else column.cast("string")


def key_value(columns: Sequence[str], kinds: Sequence[DataType]) -> tuple[Column, Column]:
    """(num, text) of a key in the types in which it is compared; a key of one integer needs no text."""
    cast = [F.col(f"`{c}`").cast(k) for c, k in zip(columns, kinds, strict=True)]
    if len(cast) == 1 and isinstance(kinds[0], IntegralType):
        return cast[0].cast("long"), F.lit(None).cast("string")
    texts = [_as_text(c, k) for c, k in zip(cast, kinds, strict=True)]
    return F.lit(None).cast("long"), texts[0] if len(texts) == 1 else F.concat(*[x for t in texts for x in (F.length(t).cast("string"), F.lit(":"), t)])


def identity(df: DataFrame, columns: Sequence[str]) -> Column:
    """Text that is equal where rows are, nulls being equal; it is never null."""
    parts = [_as_text(F.col(f"`{c}`"), df.select(f"`{c}`").schema[0].dataType) for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("null")) for t in parts])


def kinds_of(tables: Mapping[str, DataFrame], fk: ForeignKey) -> list[DataType]:
    child, parent = tables[fk.child], tables[fk.parent]
    return [common_type(child.sparkSession, child.select(f"`{c}`").schema[0].dataType, parent.select(f"`{p}`").schema[0].dataType) for c, p in zip(fk.child_cols, fk.parent_cols, strict=True)]


def _unpivoted(df: DataFrame, uses: list[tuple[int, tuple[str, ...], list[DataType], bool]]) -> DataFrame:
    """(tag, num, text, n, parent) of each use of a table's columns that has no null."""
    rows = []
    for tag, columns, kinds, parent in uses:
        num, text = key_value(columns, kinds)
        whole = reduce(Column.__and__, [F.col(f"`{c}`").isNotNull() for c in columns])
        rows.append(F.when(whole, F.struct(F.lit(tag).alias("tag"), num.alias("num"), text.alias("text"), F.lit(0 if parent else 1).cast("long").alias("n"), F.lit(parent).alias("parent"))))
    return df.select(F.explode(F.array(*rows)).alias("use")).where("use IS NOT NULL").select("use.*")


def orphan_keys(tables: Mapping[str, DataFrame], keys: Sequence[ForeignKey]) -> DataFrame:
    """(tag, num, text, n): values of the keys' children that no parent has, and how many rows have them.

    ``tag`` is the key's place among ``keys``. A row with a null in any key column is exempt (MATCH SIMPLE).
    """
    uses: dict[str, list] = {}
    for tag, fk in enumerate(keys):
        kinds = kinds_of(tables, fk)
        uses.setdefault(fk.child, []).append((tag, fk.child_cols, kinds, False))
        uses.setdefault(fk.parent, []).append((tag, fk.parent_cols, kinds, True))
    rows = reduce(DataFrame.unionByName, [_unpivoted(tables[name], own) for name, own in uses.items()])
    return rows.groupBy(*VALUE).agg(F.sum("n").alias("n"), F.max("parent").alias("parent")).where("NOT parent").drop("parent")


def counts_by_tag(found: DataFrame) -> DataFrame:
    """(tag, n) of the keys that have orphans."""
    return found.groupBy("tag").agg(F.sum("n").alias("n"))


def labelled(spark: SparkSession, found: DataFrame, labels: list[tuple], names: str) -> DataFrame:
    """``labels`` (as the columns that ``names`` declares), one row for each tag, with orphan_count."""
    rows = spark.createDataFrame([(tag, *label) for tag, label in enumerate(labels)], f"tag int, {names}").coalesce(1)
    return rows.join(F.broadcast(counts_by_tag(found)), "tag", "left").select(*rows.columns[1:], F.coalesce("n", F.lit(0)).cast("long").alias("orphan_count"))


def first_orphans(tables: Mapping[str, DataFrame], keys: Sequence[ForeignKey], found: DataFrame, columns: Sequence[Sequence[str]], most: int) -> DataFrame:
    """(tag, place, and for each key a struct of its columns, null for others): the first ``most`` orphans of each key.

    ``found`` are the orphan keys, ``columns`` those of each key by which orphans are shown and ordered. A child is
    scanned once more, and of each key's rows no task sends more than ``most``.
    """
    by_child: dict[str, list[int]] = {}
    for tag, fk in enumerate(keys):
        by_child.setdefault(fk.child, []).append(tag)
    parts = []
    for child, tags in by_child.items():
        uses = []
        for tag in tags:
            num, text = key_value(keys[tag].child_cols, kinds_of(tables, keys[tag]))
            whole = reduce(Column.__and__, [F.col(f"`{c}`").isNotNull() for c in keys[tag].child_cols])
            shown = [(F.struct(*[F.col(f"`{c}`") for c in columns[t]]) if t == tag else F.lit(None)).alias(f"key_{t}") for t in tags]
            uses.append(F.when(whole, F.struct(F.lit(tag).alias("tag"), num.alias("num"), text.alias("text"), *shown)))
        rows = tables[child].select(F.explode(F.array(*uses)).alias("use")).where("use IS NOT NULL").select("use.*")
        own = found.where(F.col("tag").isin(tags)).select(*[F.col(c).alias(f"orphan_{c}") for c in VALUE])
        same = reduce(Column.__and__, [rows[c].eqNullSafe(own[f"orphan_{c}"]) for c in VALUE])
        order = Window.partitionBy("tag").orderBy(*[f"key_{t}" for t in tags])
        rows = rows.join(own, same, "left_semi").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
        parts.append(rows.drop("num", "text"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
