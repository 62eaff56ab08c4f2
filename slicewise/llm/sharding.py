"""A uniform shuffle into shards of exact sizes, by DataFrame operations only.

1. Each partition permutes its rows locally (a sort by a random key, no
   shuffle) and the result is written once, which pins partition and rank.
2. The communication matrix (rows from partition p to shard s) is drawn with
   the law that a uniform permutation gives it: the counts of the whole table
   are split among ranges of partitions, then among partitions, each split a
   multivariate hypergeometric draw made of univariate ones. A draw inverts the
   distribution function over the support within 12 standard deviations.
3. Rows are exchanged: ranks below the first count go to shard 0, and so on.
4. Each shard is permuted again: rows are dealt to buckets of a random hash,
   sorted within the bucket, and numbered from the bucket's offset, so that no
   task ever holds a whole shard. Buckets are as many as rows and bytes ask for.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import freeze

#: partitions (or ranges of partitions) split by one row of the draw
FAN_OUT = 256
#: rows and bytes that one bucket of the second permutation holds on average, at most
BUCKET_ROWS = 50_000
BUCKET_BYTES = 64 << 20


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hypergeometric(good: Column, total: Column, sample: Column, uniform: Column) -> Column:
    """How many of ``good`` among ``total`` fall into a random ``sample``."""

    def draw(p: Column) -> Column:
        g, t, n, u = p["g"], p["t"], p["n"], p["u"]
        mean = n * g / t
        sd = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - g / t) * (t - n) / F.greatest(t - 1, F.lit(1.0))))
        low = F.greatest(F.lit(0.0), n - (t - g), F.floor(mean - 12 * sd - 12).cast("double"))
        high = F.least(n, g, F.ceil(mean + 12 * sd + 12).cast("double"))
        return _let(F.struct(g.alias("g"), t.alias("t"), n.alias("n"), u.alias("u"), low.alias("low"), F.greatest(low, high).alias("high")), invert)

    def invert(p: Column) -> Column:
        g, t, n = p["g"], p["t"], p["n"]
        values = F.sequence(p["low"].cast("long"), p["high"].cast("long"))

        def weight_after(w: Column, i: Column) -> Column:
            return w * (g - i) * (n - i) / ((i + 1) * (t - g - n + i + 1))

        total = F.aggregate(
            values,
            F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")),
            lambda a, i: F.struct(weight_after(a["w"], i.cast("double")).alias("w"), (a["sum"] + a["w"]).alias("sum")),
            lambda a: a["sum"] * p["u"],
        )

        def pick(goal: Column) -> Column:
            return F.aggregate(
                values,
                F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), p["low"].alias("at")),
                lambda a, i: F.struct(
                    weight_after(a["w"], i.cast("double")).alias("w"),
                    (a["sum"] + a["w"]).alias("sum"),
                    F.when(a["sum"] <= goal, i.cast("double")).otherwise(a["at"]).alias("at"),
                ),
                lambda a: a["at"].cast("long"),
            )

        return _let(total, pick)

    whole = F.struct(good.cast("double").alias("g"), total.cast("double").alias("t"), sample.cast("double").alias("n"), uniform.alias("u"))
    certain = F.when((good == 0) | (sample == 0), F.lit(0).cast("long")).when(sample >= total, good.cast("long"))
    return certain.otherwise(_let(whole, draw))


def _uniform(*key: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / float(1 << 53)


def _deal(counts: Column, sample: Column, *key: Column) -> Column:
    """Multivariate draw: how a random sample of the given size falls upon ``counts``."""
    start = F.struct(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), sample.cast("long").alias("left"), F.array().cast("array<long>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        got = _hypergeometric(x, a["total"], a["left"], _uniform(*key, F.size(a["out"])))
        return _let(got, lambda k: F.struct((a["total"] - x).alias("total"), (a["left"] - k).alias("left"), F.concat(a["out"], F.array(k)).alias("out")))

    return F.aggregate(counts, start, step, lambda a: a["out"])


def _split(counts: Column, sizes: Column, *key: Column) -> Column:
    """One vector for each of ``sizes``, which together make up ``counts``."""
    start = F.struct(counts.alias("rest"), F.array().cast("array<array<long>>").alias("out"))

    def step(a: Column, size: Column) -> Column:
        got = _deal(a["rest"], size, *key, F.size(a["out"]))
        return _let(got, lambda v: F.struct(F.zip_with(a["rest"], v, lambda x, y: x - y).alias("rest"), F.concat(a["out"], F.array(v)).alias("out")))

    return F.aggregate(sizes, start, step, lambda a: a["out"])


def communication_matrix(sizes: DataFrame, shard_sizes: list[int], seed: int = 0) -> DataFrame:
    """(part, counts): how many rows each partition sends to each shard.

    ``sizes`` holds (part int, rows long). Row sums are the partitions' rows,
    column sums the shards' sizes. One row of the result per row of ``sizes``.
    """
    spark = sizes.sparkSession
    top = sizes.agg(F.max("part")).first()[0] or 0
    levels = 1
    while FAN_OUT**levels <= top:
        levels += 1
    vectors = spark.range(1).select(F.lit(0).cast("long").alias("node"), F.array(*[F.lit(x).cast("long") for x in shard_sizes]).alias("counts"))
    for level in range(1, levels + 1):
        width = FAN_OUT ** (levels - level)
        child = F.floor(F.col("part") / width).cast("long")
        nodes = sizes.groupBy(child.alias("child")).agg(F.sum("rows").alias("rows"))
        families = nodes.groupBy(F.floor(F.col("child") / FAN_OUT).cast("long").alias("node")).agg(F.sort_array(F.collect_list(F.struct("child", "rows"))).alias("family"))
        drawn = families.join(vectors, "node").select("family", _split(F.col("counts"), F.col("family.rows"), F.lit(seed), F.lit(level), F.col("node")).alias("drawn"))
        pairs = F.zip_with("family", "drawn", lambda f, v: F.struct(f["child"].alias("node"), v.alias("counts")))
        vectors = drawn.select(F.explode(pairs).alias("x")).select("x.node", "x.counts")
    return vectors.select(F.col("node").cast("int").alias("part"), "counts")


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row has: those of its strings, and 8 for any other column."""
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") if t in ("string", "binary") else F.lit(8).cast("long") for c, t in df.dtypes]
    return reduce(Column.__add__, sizes, F.lit(0).cast("long"))


def shard(df: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """``df`` with the columns shard (int) and slot (long, gapless from 0 in each shard).

    A uniform random permutation of the rows; shard sizes differ by one at
    most. Columns of ``df`` named shard or slot are replaced; nulls, empty and
    repeated rows are rows like any other; an empty table stays empty. A rerun
    over the same files deals alike.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    rows = rows.withColumns({"luck": F.rand(seed), "bytes": row_bytes(rows)}).sortWithinPartitions("luck").drop("luck")
    number = F.monotonically_increasing_id()
    rows = freeze(rows.withColumn("number", number), "shard_rows")
    part, rank = F.shiftright("number", 33).cast("int"), F.col("number").bitwiseAND((1 << 33) - 1)
    rows = rows.withColumn("part", part).withColumn("rank", rank)
    sizes = freeze(rows.groupBy("part").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")), "shard_sizes")
    total, size = (x or 0 for x in sizes.agg(F.sum("rows"), F.sum("bytes")).first())
    matrix = freeze(communication_matrix(sizes.select("part", "rows"), [total // shards + (s < total % shards) for s in range(shards)], seed), "shard_matrix")
    ends = matrix.select("part", F.transform("counts", lambda x, i: F.aggregate(F.slice("counts", 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y)).alias("ends"))
    buckets = max(1, math.ceil(total / shards / BUCKET_ROWS), math.ceil(size / shards / BUCKET_BYTES))
    sent = rows.join(ends, "part").select(
        *[f"c{i}" for i in range(len(kept))],
        "number",
        F.size(F.filter("ends", lambda x: x <= F.col("rank"))).alias("shard"),
        F.xxhash64(F.lit(seed), F.lit("second"), "number").alias("luck"),
    ).withColumn("bucket", F.pmod(F.shiftright("luck", 20), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = freeze(sent.groupBy("shard", "bucket").agg(F.count("*").alias("n")), "shard_buckets").select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("luck", "number")
    numbered = sent.withColumn("place", F.row_number().over(within)).join(offsets, ["shard", "bucket"])
    return numbered.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "shard", (F.col("offset") + F.col("place") - 1).alias("slot"))
