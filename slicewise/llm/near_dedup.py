"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

Two permutations of one domain make all coordinates: ``sigma`` places a shingle
and coordinate k is the minimum of ``pi`` at the places shifted by k, so the
coordinates of a shingle are one contiguous slice of ``pi``. 48 bands of 5
coordinates miss a pair at Jaccard 0.75 with probability 2.3e-6.

Documents with the same shingle set are one node from the start. Of the nodes
that share a band bucket with another, the shingles that no other has are
counted: a node can't share more than the rest of its set, which rules out most
false candidates exactly (copies edited too much for a link among them) before
any pair is made. Nodes that are left join their bucket's centre, not
each other; links are confirmed on the full sets. Nodes of a bucket that this
leaves in different components are then joined across components by the prefixes
of their sets, which is the exact way for what the stars leave open: no bucket
is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import components
from .tables import freeze, text_or_empty

BANDS, ROWS = 48, 5
COORDINATES = BANDS * ROWS
DOMAIN = 1 << 22
#: members compared with one copy of a bucket's centre
MEMBERS = 64
#: bytes of candidate ids that may be broadcast
BROADCAST_BYTES = 64 << 20


@lru_cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    sigma, pi = (rng.permutation(DOMAIN).astype(np.uint32) for _ in range(2))
    return sigma, sliding_window_view(np.concatenate([pi, pi[:COORDINATES]]), COORDINATES)


def signature(shingles: np.ndarray) -> np.ndarray:
    sigma, shifted = _permutations()
    places = sigma[(shingles & np.uint64(DOMAIN - 1)).astype(np.int64)]
    out = np.full(COORDINATES, DOMAIN, np.uint32)
    for at in range(0, len(places), 1024):
        np.minimum(out, shifted[places[at : at + 1024]].min(axis=0), out=out)
    return out


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), 1))
    for row in range(ROWS):
        keys = words.mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, row])
    return keys.view(np.int64)


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return np.array([shingles.sum(dtype=np.uint64), words.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, prints, signatures = [], [], []
        for text in words.texts(batch.column("text")):
            found = words.shingles(words.word_hashes(text))
            sizes.append(len(found))
            prints.append(fingerprint(found) if len(found) else None)
            if len(found):
                signatures.append(signature(found))
        keys = _band_keys(np.array(signatures, np.uint32).reshape(-1, COORDINATES))
        ends = np.concatenate([[0], np.cumsum(np.array(sizes) > 0)]) * BANDS
        bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), bands], ["id", "n", "print", "bands"])


def _candidate_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, sets = [], []
        for i, (text, wanted) in enumerate(zip(words.texts(batch.column("text")), batch.column("print").to_pylist(), strict=True)):
            found = words.shingles(words.word_hashes(text))
            if fingerprint(found) == wanted:
                keep.append(i)
                sets.append(found.view(np.int64))
        ends = np.cumsum([0] + [len(x) for x in sets])
        shingles = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(keep, pa.int64())), shingles], ["node", "shingles"])


def _confirm(threshold: int):
    """Rows (v, salt, u, shingles) sorted so that the centre v comes first, with u null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            found_u, found_v = [], []
            lists = batch.column("shingles")
            values, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for i, (u, v) in enumerate(zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True)):
                own = values[ends[i] : ends[i + 1]]
                if u is None:
                    centre = own.copy()
                    continue
                at = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                both = int((centre[at] == own).sum())
                if 100 * both >= threshold * (len(own) + len(centre) - both):
                    found_u.append(u)
                    found_v.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(found_u, pa.int64()), pa.array(found_v, pa.int64())], ["u", "v"])

    return run


def _confirmed(edges: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The edges (u, v) whose Jaccard similarity is at least threshold percent."""
    parts = freeze(edges.groupBy("v").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts")), "near_centres")
    members = edges.join(parts, "v").select("v", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int").alias("salt"), "u").join(sets.withColumnRenamed("node", "u"), "u")
    centres = parts.select("v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("u")).join(sets.withColumnRenamed("node", "v"), "v")
    rows = members.select("v", "salt", "u", "shingles").unionByName(centres.select("v", "salt", "u", "shingles"))
    rows = rows.repartition("v", "salt").sortWithinPartitions("v", "salt", F.col("u").asc_nulls_first())
    return freeze(rows.mapInArrow(_confirm(threshold), "u long, v long"), "near_links")


def near_dedup(docs: DataFrame, threshold: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) runs between ASCII white space; sets are
    distinct 5-word shingles, or the whole sequence of fewer words. Documents
    are linked when 100 * intersection >= threshold * union. ``component_id`` is
    the smallest id reachable; ``kept`` is true where it is the row's own id, so
    rows repeated under one id are kept or dropped together. Null and empty
    texts have an empty set, are linked with nothing and stay. A null id is
    never a component id unless the group has no other. Extra columns are
    ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    rows = freeze(source.mapInArrow(_sets, f"id {source.schema['id'].dataType.simpleString()}, n long, print binary, bands array<long>"), "near_rows")
    some = rows.where("n > 0")
    order = F.struct(F.isnull("id").alias("last"), "id")
    nodes = some.groupBy("print").agg(F.min(order).alias("first"), F.max("n").alias("n"), F.any_value("bands").alias("bands"))
    nodes = freeze(nodes.select(F.monotonically_increasing_id().alias("node"), "print", F.col("first.id").alias("id"), "n", "bands"), "near_nodes")

    placed = nodes.select("node", "n", F.explode("bands").alias("key"))
    buckets = placed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    members = freeze(placed.join(freeze(buckets, "near_buckets"), "key"), "near_members")
    wanted = members.select("node").distinct().join(nodes.select("node", "print", "id"), "node")
    wanted = freeze(wanted, "near_wanted")
    if wanted.count() * 48 <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    again = source.join(wanted, source["id"].eqNullSafe(wanted["id"])).select("node", "print", "text")
    sets = freeze(again.mapInArrow(_candidate_sets, "node long, shingles array<long>").dropDuplicates(["node"]), "near_sets")

    # what a node can share with others at most: its set without the shingles that no other candidate has
    owners = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("nodes"), F.min("node").alias("node"))
    own = owners.where("nodes = 1").groupBy("node").agg(F.count("*").alias("own"))
    sizes = sets.select("node", F.size("shingles").cast("long").alias("n")).join(own, "node", "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("most"))
    sizes = freeze(sizes.where(100 * F.col("most") >= threshold * F.col("n")), "near_sizes")
    members = freeze(members.select("key", "node").join(sizes, "node"), "near_left")

    def possible(n: str, most: str, n2: str, most2: str) -> F.Column:
        both = F.least(most, most2)
        return 100 * both >= threshold * (F.col(n) + F.col(n2) - both)

    # a bucket's centre is the node with the smallest share of shingles of its own: likeliest what the others were copied from
    best = F.struct((1 - F.col("most") / F.col("n")).alias("own"), "node", "n", "most")
    centres = members.groupBy("key").agg(F.min(best).alias("c"), F.count("*").alias("nodes")).where("nodes > 1")
    centres = freeze(centres.select("key", "c.own", F.col("c.node").alias("v"), F.col("c.n").alias("n2"), F.col("c.most").alias("most2")), "near_centres")
    stars = members.join(centres, "key").where("node <> v").where(possible("n", "most", "n2", "most2"))
    stars = freeze(stars.select(F.col("node").alias("u"), "v", "own").distinct(), "near_stars")
    sets = freeze(sets.join(sizes.select("node"), "node", "left_semi"), "near_left_sets")

    tried = stars.select("u", "v").limit(0)
    links = None
    labels = None
    for step in range(3):
        if step == 0:  # one link of each node, then the others that still matter
            edges = stars.groupBy("u").agg(F.min(F.struct("own", "v")).alias("best")).select("u", "best.v")
        elif step == 1:
            edges = _across(stars, labels).join(tried, ["u", "v"], "left_anti")
        else:
            edges = _open_pairs(members, sets, labels, threshold).join(tried, ["u", "v"], "left_anti")
        edges = freeze(edges, "near_edges")
        tried = freeze(tried.unionByName(edges), "near_tried")
        new = _confirmed(edges, sets, threshold)
        links = new if links is None else links.unionByName(new)
        labels = freeze(components(links), "near_labels")

    whole = nodes.join(labels, "node", "left").select("print", "id", F.coalesce("label", "node").alias("label"))
    # frozen, so that the join below has exchanges of its own, which adaptive execution splits for a large component
    first = freeze(whole.groupBy("label").agg(F.min(order).alias("first")), "near_firsts")
    of_print = freeze(whole.join(first, "label").select("print", F.col("first.id").alias("component_id")), "near_components")
    out = rows.select("id", "n", "print").join(of_print, "print", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _across(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges whose ends are in different components so far."""
    of_u = labels.select(F.col("node").alias("u"), F.col("label").alias("label_u"))
    of_v = labels.select(F.col("node").alias("v"), F.col("label").alias("label_v"))
    both = edges.join(of_u, "u", "left").join(of_v, "v", "left")
    return both.where(F.coalesce("label_u", "u") != F.coalesce("label_v", "v")).select("u", "v")


def _open_pairs(members: DataFrame, sets: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """Every pair of nodes in different components that may be linked, of buckets with such nodes.

    An exact set-similarity join by prefixes: shingles are ordered by how many
    of these nodes have them, rarest first; linked sets share one among their
    first ones, and from the first one they share as many must follow as the
    link needs. Shingles that one node has alone only take up places. So sets
    that are alike but not linked (copies of one text with edits of their own)
    don't meet.
    """
    labelled = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    open_nodes = freeze(labelled.join(mixed, "key", "left_semi").select("node", "label").distinct(), "near_open")
    shingles = sets.join(open_nodes, "node").select("node", "label", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    common = shingles.groupBy("shingle").agg(F.count("*").alias("nodes")).where("nodes > 1")
    ordered = shingles.join(common, "shingle").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("nodes", "shingle"))).alias("held"))
    first = F.floor((100 - threshold) * F.col("n") / 100) + 1
    own = F.col("n") - F.size("held")
    ordered = ordered.withColumn("own", own).withColumn("held", F.slice("held", 1, F.greatest(F.lit(0), first - own).cast("int")))
    prefixes = freeze(ordered.select("node", "label", "n", "own", F.posexplode("held").alias("i", "x")).select("node", "label", "n", (F.col("own") + F.col("i")).alias("at"), F.col("x.shingle").alias("shingle")), "near_prefixes")
    larger = prefixes.select("shingle", *(F.col(c).alias(f"{c}2") for c in ("node", "label", "n", "at")))
    needed = F.ceil(threshold * (F.col("n") + F.col("n2")) / (100 + threshold))
    rest = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))  # this one and what may follow
    ahead = F.col("at") <= F.col("n") - F.ceil(2 * threshold * F.col("n") / (100 + threshold))
    order = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("node") < F.col("node2")))
    pairs = prefixes.where(ahead).join(larger, "shingle").where(order & (F.col("label") != F.col("label2")) & (rest >= needed) & (100 * F.col("n") >= threshold * F.col("n2")))
    return pairs.select(F.greatest("node", "node2").alias("u"), F.least("node", "node2").alias("v")).distinct()
