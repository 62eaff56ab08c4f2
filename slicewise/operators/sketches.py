"""Small summaries of columns' values that tell which columns surely aren't contained in which.

A value's hash names one of ``buckets`` buckets and one of the bucket's 64 bits. A column's sketch is a row for each
bucket that it has values in: the least hash and the bits of all. Both merge by plain aggregates, so one scan a
table makes the sketches of all its columns, and a task sends at most a row for each column and bucket, however many rows it
read and however often a value is there.

Of two columns the first has a value that the second lacks if, in some bucket, the second has nothing, or its least
hash is larger, or it lacks a bit; also if the first's least or largest number lies outside the second's. Equal values have
equal hashes, so nothing that is contained is ever refuted. Where nothing is refuted an exact probe tells (``broken``):
values are grouped with the set of columns they are in, as bits, so a column is unpivoted once whatever the number of its pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, LongType

from .keys import key_value

BUCKETS = 4096  # a power of two


def compared_as(kind: DataType) -> DataType:
    """Integers of all widths are compared as one type, others as their own."""
    return LongType() if isinstance(kind, IntegralType) else kind


def _unpivoted(tables: Mapping[str, DataFrame], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """(tag, num, text) of all values of the columns, each table scanned once; nulls are left out."""
    by_table: dict[str, list[int]] = {}
    for tag, (name, _) in enumerate(columns):
        by_table.setdefault(name, []).append(tag)
    parts = []
    for name, tags in by_table.items():
        df, uses = tables[name], []
        for tag in tags:
            column = columns[tag][1]
            num, text = key_value([column], [compared_as(df.select(f"`{column}`").schema[0].dataType)])
            uses.append(F.when(F.col(f"`{column}`").isNotNull(), F.struct(F.lit(tag).alias("tag"), num.alias("num"), text.alias("text"))))
        parts.append(df.select(F.explode(F.array(*uses)).alias("use")).where("use IS NOT NULL").select("use.*"))
    return reduce(DataFrame.unionByName, parts)


def sketches(tables: Mapping[str, DataFrame], columns: Sequence[tuple[str, str]], buckets: int = BUCKETS) -> DataFrame:
    """(tag, bucket, n, least, bits, low, high) of (table, column) pairs; ``tag`` is a pair's place.

    ``n`` counts rows with a value, ``low`` and ``high`` are the bounds of numbers. A column without values has no rows.
    """
    if buckets < 1 or buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    shift = buckets.bit_length() - 1
    rows = _unpivoted(tables, columns).withColumn("hash", F.xxhash64("num", "text"))
    rows = rows.select("tag", "num", "hash", F.expr(f"int(hash & {buckets - 1})").alias("bucket"), F.expr(f"shiftleft(1L, int(shiftright(hash, {shift}) & 63))").alias("bit"))
    return rows.groupBy("tag", "bucket").agg(F.count("*").alias("n"), F.min("hash").alias("least"), F.bit_or("bit").alias("bits"), F.min("num").alias("low"), F.max("num").alias("high"))


def ranges(sketch: DataFrame) -> DataFrame:
    """(tag, n, low, high) of the columns that have values."""
    return sketch.groupBy("tag").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def refuted(sketch: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (inner, outer) tags of ``pairs`` whose inner column surely has a value that the outer lacks.

    ``sketch`` is read twice, so it should be a written table.
    """
    own = sketch.select(F.col("tag").alias("inner"), "bucket", "least", "bits", "low", "high").join(pairs, "inner")
    other = sketch.select(F.col("tag").alias("outer"), "bucket", F.col("least").alias("outer_least"), F.col("bits").alias("outer_bits"))
    missing = F.col("outer_least").isNull() | (F.col("least") < F.col("outer_least")) | (F.expr("bits & ~outer_bits") != 0)
    bounds = ranges(sketch).select(F.col("tag").alias("outer"), F.col("low").alias("outer_low"), F.col("high").alias("outer_high"))
    outside = F.coalesce((F.col("low") < F.col("outer_low")) | (F.col("high") > F.col("outer_high")), F.lit(False))
    return own.join(other, ["outer", "bucket"], "left").join(bounds, "outer", "left").where(missing | outside).select("inner", "outer").distinct()


def broken(tables: Mapping[str, DataFrame], columns: Sequence[tuple[str, str]], pairs: DataFrame) -> DataFrame:
    """The (inner, outer) tags of ``pairs`` whose inner column has a value that the outer lacks, exactly."""
    words = range((len(columns) + 62) // 63)
    bits = [F.when(F.expr(f"int(tag / 63) = {w}"), F.expr("shiftleft(1L, tag % 63)")).otherwise(F.lit(0).cast("long")) for w in words]
    sets = _unpivoted(tables, columns).groupBy("num", "text").agg(*[F.bit_or(b).alias(f"in_{w}") for w, b in zip(words, bits, strict=True)])
    sets = sets.select(F.array(*[f"in_{w}" for w in words]).alias("within")).distinct()
    has = lambda tag: f"(shiftright(within[int({tag} / 63)], {tag} % 63) & 1) = 1"
    inner = F.filter(F.sequence(F.lit(0), F.lit(len(columns) - 1)), lambda tag: (F.call_function("shiftright", F.col("within")[(tag / 63).cast("int")], tag % 63).bitwiseAND(F.lit(1))) == 1)
    return sets.select("within", F.explode(inner).alias("inner")).join(pairs, "inner").where(f"NOT {has('outer')}").select("inner", "outer").distinct()
