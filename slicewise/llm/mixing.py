"""Mixing sources to target weights by capped water-filling.

The per-source table (one row per source) is aggregated before any shuffle.
Targets start at ``share * total * weight / sum of weights``; a source above
its cap (``max_epochs`` times its size) is clamped there and what it cannot
take is dealt again to the others by weight, until no source is above its cap.
Each round moves two sums to the driver, nothing else.

A target of ``r`` times the source's size takes every document ``floor(r)``
times and a seeded sample for the rest: documents ordered by a seeded hash are
taken once more until the fraction of the source's words is reached. Buckets of
the hash's first bits find the place where that happens, level by level: each
level cuts the one bucket per source that straddles the place into finer ones, until
a bucket holds some BUCKET_DOCS documents however many the source has; only those
are sorted. The outcome is one place per source, so whether a document is taken
follows from the document and its source's row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import freeze

BUCKET_DOCS = 256
#: bits of the hash that one level adds: a level sums at most 2 to the power of it buckets a source
LEVEL_BITS = 16
LUCK_BITS = 63
#: the order in which a source's documents are taken
PLACE = ("mix_luck", "mix_id", "mix_size", "mix_text", "mix_number")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def repeating_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """``sources`` (column source) in code point order, null last, with weights in turn.

    Sources are sorted by a shuffle and numbered where they are; only the number of sources of
    each partition meets in one task, so there may be as many as hosts of the web.
    """
    ordered = freeze(sources.select("source").orderBy(F.col("source").asc_nulls_last()).withColumn("number", F.monotonically_increasing_id()), "mix_ordered")
    ordered = ordered.withColumn("part", F.shiftright("number", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.col("offset") + F.col("number").bitwiseAND((1 << 33) - 1)
    turn = F.pmod(place, F.lit(len(weights))).cast("int")
    return ordered.join(offsets, "part").select("source", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1).alias("weight"))


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Adds target to (source, source_size, weight)."""
    sources = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    total, room = sources.agg(F.sum("source_size"), F.sum(F.when(F.col("weight") > 0, F.col("cap")))).first()
    wanted = min(share * (total or 0), room or 0)
    level = 0.0
    while True:
        clamped = (F.col("cap") <= F.col("weight") * level) if level else F.lit(False)
        fixed, free = sources.agg(F.sum(F.when(clamped, F.col("cap"))), F.sum(F.when(~clamped, F.col("weight")))).first()
        rising = (wanted - (fixed or 0.0)) / free if free else math.inf
        if rising <= level * (1 + 1e-12) or math.isinf(rising):
            break
        level = rising
    return sources.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level)) if not math.isinf(level) else F.col("cap")).drop("cap")


def _placed(rows: DataFrame, seed: int) -> DataFrame:
    """Rows of (mix_id, mix_source, mix_size, mix_text, mix_number) with the source's key and their luck; what is null doesn't count in it."""
    key = F.coalesce(F.concat(F.lit("="), F.col("mix_source")), F.lit("null"))
    return rows.withColumns({"mix_key": key, "mix_luck": F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_id", "mix_source", "mix_size", "mix_text", "mix_number"), 64 - LUCK_BITS)})


def _sized(docs: DataFrame, shared: bool) -> DataFrame:
    """Adds mix_id, mix_source and mix_size to (id, text, source), and with shared ids a hash of the text."""
    return docs.withColumns({"mix_id": F.col("id"), "mix_source": F.col("source"), "mix_size": word_count(F.col("text")), "mix_text": F.xxhash64("text") if shared else F.lit(None).cast("long")})


def _ids_are_shared(rows: DataFrame, id_col: str) -> bool:
    return rows.groupBy(id_col).count().where(f"count > 1 OR `{id_col}` IS NULL").limit(1).count() > 0


def _numbers(sized: DataFrame) -> DataFrame:
    """(mix_row, mix_number) of rows that equal another one: 0, 1, ... among them, except for the 0.

    Rows of one partition are numbered on from how many equal ones the partitions before have, so no task
    holds all that are equal. Whatever the partitions are, as many rows get as many numbers.
    """
    hashed = sized.select("mix_row", F.shiftright("mix_row", 33).alias("part"), *[F.xxhash64("mix_id", "mix_source", "mix_size", "mix_text", F.isnull("mix_id"), F.isnull("mix_source"), F.lit(n)).alias(f"same{n}") for n in (1, 2)])
    same, parts = ["same1", "same2"], Window.partitionBy("same1", "same2")
    counts = hashed.groupBy(*same, "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*same, "part", before.alias("before"), F.sum("n").over(parts).alias("all")).where("all > 1").drop("all")
    place = F.row_number().over(Window.partitionBy(*same, "part").orderBy("mix_row")) - 1
    return hashed.join(counts, [*same, "part"]).select("mix_row", (F.col("before") + place).alias("mix_number")).where("mix_number > 0")


def mixing_plan(sized: DataFrame, weights: DataFrame | tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """One row per source: mix_key, source_size, target, whole, below, last.

    A document is taken ``whole`` times, and once more if its luck is under ``below`` or its
    place (PLACE) is not after ``last``; a null is before all.
    """
    sources = freeze(sized.groupBy("mix_key", "mix_source").agg(F.sum("mix_size").alias("source_size"), F.count("*").alias("docs")), "mix_sources")
    if isinstance(weights, tuple):
        weights = repeating_weights(sources.select(F.col("mix_source").alias("source")), weights)
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    weights = weights.select(key.alias("mix_key"), F.col("weight").cast("double").alias("weight"))
    sources = freeze(water_fill(sources.join(weights, "mix_key", "left").fillna(0.0, ["weight"]), share, max_epochs), "mix_targets")

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = sources.withColumn("whole", F.floor(ratio + 1e-12).cast("int"))
    plan = plan.withColumn("goal", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).select("mix_key", "source_size", "target", "whole", "goal")
    # the bucket where a source's sample ends, and the words still wanted there
    largest = sources.agg(F.max("docs")).first()[0] or 0
    bits = min(LUCK_BITS, math.ceil(math.log2(max(1.0, largest / BUCKET_DOCS))))
    edge = plan.select("mix_key", F.lit(0).cast("long").alias("bucket"), F.col("goal").alias("left"))
    done, upto = 0, Window.partitionBy("mix_key").orderBy("bucket")  # at most 2 ** LEVEL_BITS rows a source
    while True:
        level = min(LEVEL_BITS, bits - done)
        sums = _inside(sized, edge, done).groupBy("mix_key", "left", _bucket(done + level).alias("bucket")).agg(F.sum("mix_size").alias("words"))
        reach = sums.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") > F.col("left"))
        edge = reach.groupBy("mix_key").agg(F.min(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("words")).alias("left"))).alias("edge"))
        edge, done = freeze(edge.select("mix_key", "edge.bucket", "edge.left"), "mix_edges"), done + level
        if done == bits:
            break
    # in that bucket a document is taken if more than half of it lies below the end
    running = Window.partitionBy("mix_key").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)
    border = _inside(sized, edge, done).withColumn("upto", F.sum("mix_size").over(running)).where(F.col("upto") - F.col("mix_size") / 2 < F.col("left"))
    ends = border.groupBy("mix_key").agg(F.max(_place()).alias("last"))
    plan = plan.join(edge.select("mix_key", "bucket"), "mix_key", "left").join(ends, "mix_key", "left")
    whole = F.when(F.col("bucket").isNull() & (F.col("goal") > 0), F.col("whole") + 1).otherwise(F.col("whole"))
    below = F.shiftleft("bucket", LUCK_BITS - done) if done else F.lit(None).cast("long")
    return freeze(plan.select("mix_key", "source_size", "target", whole.alias("whole"), below.alias("below"), "last"), "mix_plan")


def _bucket(bits: int) -> Column:
    """The first bits of a document's luck."""
    return F.shiftright("mix_luck", LUCK_BITS - bits) if bits else F.lit(0).cast("long")


def _inside(sized: DataFrame, edge: DataFrame, bits: int) -> DataFrame:
    """Documents in their source's bucket of that many bits, and the words wanted there; one row per source is joined."""
    return sized.withColumn("bucket", _bucket(bits)).join(edge, ["mix_key", "bucket"]).drop("bucket")


def _place() -> Column:
    return F.struct(*PLACE)


def _copies(whole: str, below: str, last: str) -> Column:
    once = F.coalesce(F.col("mix_luck") < F.col(below), F.lit(False)) | F.coalesce(_place() <= F.col(last), F.lit(False))
    return F.col(whole) + once.cast("int")


def mix(docs: DataFrame, weights: DataFrame | tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken.

    ``size`` counts words; ``target`` is the source's; ``copies`` says how often
    the mix takes the document and ``taken = copies * size``. A null source is a
    source of its own, last in order; a null text has size 0. ``weights`` is a
    table (source, weight) or weights given to the sources in code point order,
    in turn; a source that the table lacks weighs 0 and is not taken. Documents
    without words take nothing, however often. Where ids are null or shared, the text and a
    number among equal rows tell rows apart, so targets are met then too; of rows repeated in full
    some are taken. Extra columns are ignored; an empty table gives an empty result. Reruns agree.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    shared = _ids_are_shared(own, "id")
    sized = freeze(_sized(own, shared).drop("id", "text", "source").withColumn("mix_row", F.monotonically_increasing_id()), "mix_sizes")
    sized = _placed(sized.join(freeze(_numbers(sized), "mix_numbers"), "mix_row", "left") if shared else sized.withColumn("mix_number", F.lit(None).cast("long")), seed)
    out = sized.join(mixing_plan(sized, weights, share, max_epochs), "mix_key").withColumn("copies", _copies("whole", "below", "last"))
    return out.select(F.col("mix_id").alias(id_col), F.col("mix_source").alias(source_col), F.col("mix_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("mix_size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: DataFrame | tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as ``mix`` takes it.

    A row's copies follow from the row and its source's plan, so the texts
    aren't shuffled. All columns are kept, also those with names that ``mix`` has. Nulls,
    empty texts, ties and repeated rows are taken as ``mix`` says: a row
    without words is there once for each whole copy of its source (and once more if
    the sample reaches it). Where ids are null or shared, rows are numbered on a copy, so that
    the numbers stay. An empty table stays empty.
    """
    shared = _ids_are_shared(docs, id_col)
    # the rows' own columns are kept aside, whatever they are called
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_whole"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    whole = freeze(whole.withColumn("mix_row", F.monotonically_increasing_id()), "mix_rows") if shared else whole.withColumn("mix_row", F.lit(None).cast("long"))
    rows = _sized(whole, shared)
    sized = freeze(rows.select("mix_row", "mix_id", "mix_source", "mix_size", "mix_text"), "mix_sizes")
    if shared:
        numbers = freeze(_numbers(sized), "mix_numbers")
        rows, sized = rows.join(numbers, "mix_row", "left"), sized.join(numbers, "mix_row", "left")
    else:
        rows, sized = (x.withColumn("mix_number", F.lit(None).cast("long")) for x in (rows, sized))
    plan = mixing_plan(_placed(sized, seed), weights, share, max_epochs).select("mix_key", F.struct("whole", "below", "last").alias("mix_plan"))
    placed = _placed(rows, seed).join(plan, "mix_key")
    copies = F.array_repeat(F.lit(1), _copies("mix_plan.whole", "mix_plan.below", "mix_plan.last"))
    return placed.withColumn("mix_copy", F.explode(copies)).select("mix_whole.*")
