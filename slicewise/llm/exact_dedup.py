"""Exact dedup by two-pass Bloom filtering.

Pass one writes a narrow table (id, SHA-256 of the text) and builds a blocked
Bloom filter of the hashes that occur at least twice. Every task sends, for each
block it touches, the bits that it has seen and those that it has seen again, as
sorted places; places of one block merge in two levels with
``again = again1 | again2 | (seen1 & seen2)``. So a text costs a few bytes however many tasks
build, and all of them do. Pass two probes the narrow table; only rows whose bits
are all seen again can have a twin, and only those (as id and hash, never the
text) shuffle. The rest pass straight through. False positives cost a little
shuffle and nothing else, because the groups are formed on the full SHA-256.

The filter is bounded: hash space is cut into slices so that the filter of one
slice never exceeds ``filter_mb``, whatever the row count; it is broadcast
because of that bound. The narrow table is written once, each task's rows in order of
their slices, so that a slice reads the pages it needs. What a slice's filter says of its
rows is written out before the next filter is built, so one filter is alive at a time; how many
files that gives follows from the rows, not from the slices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import freeze, freeze_parts

BLOCK_BITS = 1 << 15
BLOCK_BYTES = BLOCK_BITS // 8
#: groups of tasks whose places of a block merge first
MERGERS = 16
#: rows whose places a task keeps before it sends them
BUILD_ROWS = 1 << 20
#: rows of a file of what was probed
FILE_ROWS = 250_000


def _places(bits: np.ndarray) -> list[np.ndarray]:
    """The three places in its block of each text."""
    return [(bits >> np.uint64(15 * i)).astype(np.int64) & (BLOCK_BITS - 1) for i in range(3)]


def _lists(key: np.ndarray, blocks: np.ndarray) -> pa.Array:
    """Of sorted keys (block, place) the places of each block, as binary values."""
    ends = np.searchsorted(key, np.append(blocks, blocks[-1] + 1) * BLOCK_BITS) * 2
    data = (key & (BLOCK_BITS - 1)).astype(np.uint16)
    return pa.Array.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, merger, seen, again) of the blocks that a task touched."""
    merger = TaskContext.get().partitionId() % MERGERS
    waiting, n = [], 0

    def rows() -> pa.RecordBatch:
        key, times = np.unique(np.concatenate(waiting), return_counts=True)
        blocks = np.unique(key // BLOCK_BITS)
        return pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(np.full(len(blocks), merger, np.int32)), _lists(key, blocks), _lists(key[times > 1], blocks)], ["block", "merger", "seen", "again"])

    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        bits = batch.column("bits").to_numpy().view(np.uint64)
        waiting += [block * BLOCK_BITS + place for place in _places(bits)]
        n += len(block)
        if n >= BUILD_ROWS:
            yield rows()
            waiting, n = [], 0
    if waiting:
        yield rows()


def _united(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of a block that were seen in any of the rows, and those seen again."""
    seen, times = np.unique(np.frombuffer(b"".join(rows["seen"]), np.uint16), return_counts=True)
    return seen, np.union1d(np.frombuffer(b"".join(rows["again"]), np.uint16), seen[times > 1])


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    seen, again = _united(rows)
    return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "seen": [seen.tobytes()], "again": [again.tobytes()]})


def _filter(rows: pd.DataFrame) -> pd.DataFrame:
    """The block of the filter; none if nothing was seen again."""
    _, again = _united(rows)
    plane = np.zeros(BLOCK_BITS, bool)
    plane[again] = True
    words = [np.packbits(plane, bitorder="little").view(np.int64)]
    return pd.DataFrame({"filter_block": [int(rows["block"].iloc[0])], "words": words}).iloc[: len(again)]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_mb: int = 64, bits_per_text: int = 8) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the
    row with the largest id stays, a null id counting as smallest; of rows
    that also share the id one stays. Extra columns are ignored; an empty
    table gives an empty result. Very long texts only enter the hash.
    """
    n_rows = docs.count()
    blocks = max(1, math.ceil(n_rows * bits_per_text / BLOCK_BITS))
    per_slice = max(1, (filter_mb << 20) // BLOCK_BYTES)
    slices = math.ceil(blocks / per_slice)
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    keyed = docs.select(F.col(id_col).alias("id"), digest.alias("digest")).select(
        "id",
        "digest",
        F.monotonically_increasing_id().alias("row"),
        F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(blocks)).alias("block"),
        F.xxhash64("digest", F.lit(2)).alias("bits"),
    )
    keyed = keyed.withColumn("slice", F.floor(F.col("block") / per_slice).cast("int"))
    keyed = freeze(keyed.sortWithinPartitions("slice") if slices > 1 else keyed, "exact_dedup")
    files = max(1, math.ceil(n_rows / slices / FILE_ROWS))

    def probed() -> Iterator[DataFrame]:
        for number in range(slices):
            part = keyed.where(F.col("slice") == number) if slices > 1 else keyed
            built = part.select("block", "bits").mapInArrow(_build, "block long, merger int, seen binary, again binary")
            merged = built.groupBy("block", "merger").applyInPandas(_merge, "block long, seen binary, again binary")
            # at most filter_mb, by the choice of slices; written out before the next slice's filter is built
            twice = F.broadcast(freeze(merged.groupBy("block").applyInPandas(_filter, "filter_block long, words array<long>"), "exact_dedup_filter"))
            found = (part.coalesce(files) if slices > 1 else part).join(twice, part["block"] == twice["filter_block"], "left")
            flags = [F.getbit(F.element_at("words", (F.shiftrightunsigned("bits", 15 * i).bitwiseAND(BLOCK_BITS - 1) / 64).cast("int") + 1), F.shiftrightunsigned("bits", 15 * i).bitwiseAND(63).cast("int")) == 1 for i in range(3)]
            yield found.select("id", "digest", "row", F.coalesce(flags[0] & flags[1] & flags[2], F.lit(False)).alias("maybe"))

    rows = freeze_parts(probed(), "exact_dedup_probed")
    repeated = rows.where("maybe").select("id", "digest", "row")
    # one row per text, combined before the shuffle: a text that fills a third of the table is a few rows by then
    groups = freeze(repeated.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("group_size")), "exact_dedup_groups")
    again = repeated.join(groups, "digest").select("id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "digest")
    alone = rows.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return again.unionByName(alone).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
