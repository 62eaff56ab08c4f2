"""Removal of passages that occur elsewhere: seeds on winnowed anchors, extended both ways.

A window is ``width`` consecutive words of a document; the words of every window whose
words start anywhere else are removed, the first occurrence too.

* Documents with the same words are told by the hash of their words: where they hold a
  window all of it repeats, and one of them stands for the others from there on.
* Seeds: of each window the leftmost smallest hash among its ``GRAM``-word strings is its
  anchor, the same wherever the window occurs. Documents are joined on anchors: of
  equal ones in a batch one row travels and counts them, the others are known to be
  shared; an anchor that no other place has is done.
* Extension: a shared anchor grows to the left and to the right into each window whose
  anchor it is. Two places agree on ``l`` words to the left and the rest to the right
  exactly if those windows' keys, 128 bits over all their words, are equal. Equal keys of a
  batch settle there, one row of them travels; so a passage that a third of all
  documents share sends a row for each batch, and no pair of places is ever made.
* Overlapping windows of a document unite to its maximal repeats, each of ``width`` words or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import words
from .suffix_dedup import merge_spans
from .tables import freeze, text_or_empty

WIDTH = 35
GRAM = 12
#: words looked at together; bounds memory on long texts
PIECE = 1 << 20
_ONE, _TWO = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def _windows(hashes: np.ndarray, width: int, seed: np.uint64) -> np.ndarray:
    """A hash of each ``width`` words in a row, by a rolling sum over their hashes."""
    n = len(hashes)
    up = np.full(n + 1, seed, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(n + 1, np.uint64(pow(int(seed), -1, 1 << 64)), np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.mix(hashes ^ seed) * up[:n])))
    return words.mix((c[width:] - c[: n - width + 1]) * down[: n - width + 1])


def anchors(hashes: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window) of each anchor of a text's word hashes; its windows go on to the next one's first."""
    span = width - GRAM + 1
    places, grams, firsts = [], [], []
    for low in range(0, len(hashes) - width + 1, PIECE):
        piece = hashes[low : low + PIECE + width - 1]
        gram = _windows(piece, GRAM, _ONE)
        least, at, wide = gram, np.arange(len(gram)), 1
        while wide < span:
            step = min(wide, span - wide)
            left, right = least[:-step], least[step:]
            at = np.where(left <= right, at[:-step], at[step:])
            least = np.minimum(left, right)
            wide += step
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        places.append(at[first] + low)
        grams.append(gram[at[first]])
        firsts.append(first + low)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place, gram, first = map(np.concatenate, (places, grams, firsts))
    new = np.concatenate(([True], place[1:] != place[:-1]))  # a piece may go on with the last one's anchor
    return place[new], gram[new], first[new]


def word_hashes(text: np.ndarray) -> np.ndarray:
    """Hashes of a text's words, unchanged."""
    return words.word_hashes(text, lower=False)


def _words_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, row, n_words, words_sha256): what tells documents' words apart."""
    for batch in batches:
        split = [t.split() for t in batch.column("text").to_pylist()]
        keys = [hashlib.sha256(b" ".join(t)).digest() for t in split]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([len(t) for t in split], pa.int64()), pa.array(keys, pa.binary())], ["row", "n_words", "words_key"])


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, row, place, times). Of a batch's equal grams one row stands for all and counts
    them; the others (0) are known to be shared and travel anywhere."""
    for batch in batches:
        rows = batch.column("row").to_numpy()
        found = [anchors(word_hashes(t))[:2] for t in words.texts(batch.column("text"))]
        row = np.repeat(rows, [len(f[0]) for f in found])
        place = np.concatenate([f[0] for f in found] + [np.zeros(0, np.int64)])
        gram = np.concatenate([f[1] for f in found] + [np.zeros(0, np.uint64)])
        _, first, inverse, times = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
        times = times.astype(np.int32)[inverse]
        other = first[inverse] != np.arange(len(gram))
        times[other] = 0
        gram[other] = words.mix(gram[other] + place[other].astype(np.uint64) * _ONE + row[other].astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(row), pa.array(place.astype(np.int32)), pa.array(times)], ["gram", "row", "place", "times"])


def _shared(keys: list[str]):
    """Of rows sorted by keys, (row, place) of those whose keys aren't alone, and of those with times 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last row so far: its keys, row, place, and whether it has been put out
        for batch in batches:
            *key, row, place, times = (batch.column(c).to_numpy() for c in (*keys, "row", "place", "times"))
            own = times > 0
            out_row, out_place = [row[~own]], [place[~own]]
            key, row, place, times = [k[own] for k in key], row[own], place[own], times[own]
            if len(row):
                again = np.concatenate(([last is not None and all(k[0] == x for k, x in zip(key, last[0], strict=True))], np.logical_and.reduce([k[1:] == k[:-1] for k in key])))
                keep = again | (times > 1) | np.concatenate((again[1:], [False]))
                if again[0] and not last[3]:
                    out_row.append(np.array([last[1]]))
                    out_place.append(np.array([last[2]], np.int32))
                out_row.append(row[keep])
                out_place.append(place[keep])
                last = ([k[-1] for k in key], row[-1], place[-1], keep[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_row), pa.int64()), pa.array(np.concatenate(out_place), pa.int32())], ["row", "place"])

    return run


def _extended(width: int = WIDTH):
    """(one, two, row, place, times) of each window into which (row, text, places) grows, settled within a batch as seeds are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, twos, starts, counts = [], [], [], []
            for text, places in zip(words.texts(batch.column("text")), batch.column("places"), strict=True):
                hashes = word_hashes(text)
                place, _, first = anchors(hashes, width)
                end = np.append(first[1:], len(hashes) - width + 1)
                grown = np.isin(place, np.array(places.values))
                windows = np.zeros(len(hashes) - width + 2, np.int32)
                np.add.at(windows, first[grown], 1)
                np.add.at(windows, end[grown], -1)
                start = np.flatnonzero(np.cumsum(windows[:-1]))
                ones.append(_windows(hashes, width, _ONE)[start])
                twos.append(_windows(hashes, width, _TWO)[start])
                starts.append(start)
                counts.append(len(start))
            one, two, start = (np.concatenate([*x, np.zeros(0, kind)]) for x, kind in ((ones, np.uint64), (twos, np.uint64), (starts, np.int64)))
            row = np.repeat(batch.column("row").to_numpy(), counts)
            order = np.lexsort((two, one))
            one, two, row, start = one[order], two[order], row[order], start[order]
            fresh = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))[: len(one)]
            times = np.zeros(len(one), np.int32)
            at = np.flatnonzero(fresh)
            times[at] = np.diff(np.append(at, len(one)))
            one[~fresh] = words.mix(start[~fresh].astype(np.uint64) * _ONE + row[~fresh].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(row), pa.array(start.astype(np.int32)), pa.array(times)], ["one", "two", "row", "place", "times"])

    return run


def _cut(width: int = WIDTH):
    """What is left of each text's words, as counts and a hash, and the spans of words that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for text, copy, starts in zip(batch.column("text").to_pylist(), batch.column("copy").to_pylist(), batch.column("starts"), strict=True):
                split, spans = text.split(), []
                if copy and len(split) >= width:
                    spans = [(0, len(split))]
                elif starts.is_valid:
                    start = np.array(starts.values, np.int64)
                    spans = merge_spans(start, start + width)
                at, kept = 0, []
                for start, end in spans:
                    kept += split[at:start]
                    at = end
                kept += split[at:]
                for column, value in zip(columns, (len(split), len(split) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"start": a, "end": b} for a, b in spans]), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_words", "n_removed", "kept_sha256", "removed"])

    return run


def remove_shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, removed.

    Words are runs of other characters than space and U+0009 to U+000D, unchanged. ``removed`` are the maximal
    runs (start, end) of words that windows of 35 cover whose words also start at another place, in another
    document or the same; so no occurrence stays. Windows are judged on the input and never cross documents. Null
    counts as empty; texts of fewer words lose nothing; rows that share an id or have none are documents of
    their own, and rows repeated in full are copies of each other. Extra columns are ignored; an empty table
    gives an empty result. What is kept is hashed with one space between words.
    """
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    if isinstance(source.schema["id"].dataType, IntegralType) and not source.groupBy("id").count().where("count > 1 OR id IS NULL").limit(1).count():
        source = source.withColumn("row", F.col("id").cast("long"))
    else:  # rows are numbered on a copy, so that the numbers stay
        source = freeze(source.withColumn("row", F.monotonically_increasing_id()), "passages_rows")
    keys = freeze(source.select("row", "text").mapInArrow(_words_key, "row long, n_words long, words_key binary").where(F.col("n_words") >= WIDTH), "passages_keys")
    groups = freeze(keys.groupBy("words_key").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1"), "passages_groups")
    copies = freeze(keys.join(groups, "words_key").select("row", (F.col("row") == F.col("first")).alias("first"), F.lit(True).alias("copy")), "passages_copies")
    apart = source.join(copies.where("not first"), "row", "left_anti").select("row", "text")

    seeds = apart.mapInArrow(_seed_rows, "gram long, row long, place int, times int")
    seeds = seeds.repartition("gram").sortWithinPartitions("gram").mapInArrow(_shared(["gram"]), "row long, place int")
    seeds = freeze(seeds.groupBy("row").agg(F.collect_list("place").alias("places")), "passages_seeds")
    grown = apart.join(seeds, "row").select("row", "text", "places").mapInArrow(_extended(), "one long, two long, row long, place int, times int")
    starts = grown.repartition("one").sortWithinPartitions("one", "two").mapInArrow(_shared(["one", "two"]), "row long, place int")
    starts = freeze(starts.groupBy("row").agg(F.collect_list("place").alias("starts")), "passages_starts")

    whole = source.join(copies.select("row", "copy"), "row", "left").join(starts, "row", "left").select("id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "starts")
    kind = whole.schema["id"].dataType.simpleString()
    return whole.mapInArrow(_cut(), f"id {kind}, n_words long, n_removed long, kept_sha256 string, removed array<struct<start: long, end: long>>").withColumnRenamed("id", id_col)
