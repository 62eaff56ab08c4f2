"""Alignment of two tokenizers over a corpus.

Tokenizer A is a byte-level BPE, B a piece BPE with byte fallback. Both leave words alone:
a space between two characters that aren't white space begins a token of either, so a
text's tokens are those of its units, the pieces between such spaces. Each task encodes a
unit once, new ones laid end to end again, and remembers as many as UNITS; long texts are
never held as tokens whole.

The tokens of all new units are laid end to end as two streams of byte ends (cumsum). Ends
in both streams (intersect1d) cut them into groups, whose labels come by searchsorted. Two
tokens are linked if they end together: for each A token the range of B tokens with its
end, expanded by repeat.

Links are counted within a task, then by id pair and salt, then by id pair. The counts of
the most frequent pairs, at most HOT_PAIRS, are broadcast to the documents; links of the
others, which are rare by that, join their counts by a shuffle. So no row is ever sent for
a frequent pair and no task holds all links of one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import freeze

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: units that a task remembers, and their characters, before it forgets all
UNITS, UNIT_CHARS = 400_000, 16_000_000
#: characters of units that are encoded as one text
JOINED = 20_000
#: characters of texts that are looked at together
PIECE = 2_000_000
#: id pairs that a task counts before it sends them
PAIRS = 2_000_000
SALTS = 16
#: id pairs whose counts are broadcast: 17 bytes each
HOT_PAIRS = 1 << 20
_SPACE = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = re.compile(r"\s | \s")


# ---- tokenizers


def byte_of_character() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others in turn for 256 and up."""
    own = {b: b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r}
    others = (b for b in range(256) if b not in own)
    return {chr(c): b for b, c in own.items()} | {chr(256 + n): b for n, b in enumerate(others)}


@dataclass
class Vocabulary:
    """Bytes of each id, laid end to end, and where they end."""

    data: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, entries: list[bytes]) -> Vocabulary:
        return cls(np.frombuffer(b"".join(entries), np.uint8), np.cumsum([0] + [len(e) for e in entries]))

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        return self.end[ids + 1] - self.end[ids]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spread(self.end[ids], self.lengths(ids))]


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


@lru_cache(maxsize=1)
def tokenizers(folder: str):
    """(encode A, its vocabulary, encode B, its vocabulary); an encoder takes a list of texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{folder}/{A_FILE}")
    a.encode_special_tokens = True  # their strings in a text are ordinary text
    byte = byte_of_character()
    with open(f"{folder}/{A_FILE}", encoding="utf-8") as file:
        described = json.load(file)
    entries = {i: bytes(byte[c] for c in token) for token, i in described["model"]["vocab"].items()}
    entries |= {t["id"]: t["content"].encode() for t in described["added_tokens"]}
    b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{B_FILE}")
    pieces = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        pieces.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    return (
        lambda texts: [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)],
        Vocabulary.of([entries.get(i, b"") for i in range(max(entries) + 1)]),
        lambda texts: b.encode(texts, num_threads=1),
        Vocabulary.of(pieces),
    )


# ---- units


@dataclass
class Units:
    """What is known of units: counts, the text of their groups, and the A-B id pairs of their links (end to end)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    right: np.ndarray  # whether the joined bytes of either tokenizer are the unit's
    groups: list[str]
    links: np.ndarray
    link_end: np.ndarray  # one more than units

    def __add__(self, other: Units) -> Units:
        both = lambda name: np.concatenate((getattr(self, name), getattr(other, name)))
        ends = np.concatenate((self.link_end, other.link_end[1:] + self.link_end[-1]))
        return Units(both("n_a"), both("n_b"), both("n_groups"), both("right"), self.groups + other.groups, both("links"), ends)


def _numbers(ids: np.ndarray, separator: np.ndarray) -> np.ndarray:
    """Decimal ids under 10 ** 7, each with a separator behind it, as eight bytes with zeros before them."""
    out = np.zeros((len(ids), 8), np.uint8)
    out[:, 7] = separator
    rest = ids.copy()
    for place in range(6, -1, -1):
        out[:, place] = np.where((rest > 0) | (place == 6), rest % 10 + 48, 0)
        rest //= 10
    return out


def _joined(texts: list[str]) -> tuple[list[str], list[int]]:
    """Texts of several units each, and how many; a unit with white space at an end is one of its own."""
    out, each, chars = [], [], 0
    for text in texts:
        alone = not text or text[0].isspace() or text[-1].isspace()
        if alone or not out or chars > JOINED:
            out.append([])
            chars = 1 + JOINED * alone
        out[-1].append(text)
        chars += len(text)
    each = [len(x) for x in out]
    return [" ".join(x) for x in out], each


def _encoded(texts: list[str], folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A ids, B ids, how many of each a text has, whether both give back the text's bytes)."""
    encode_a, bytes_a, encode_b, bytes_b = tokenizers(folder)
    raw = [b" " + t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(t) for t in raw], np.int64)
    right, out = np.ones(len(texts), bool), []
    for found, vocabulary in ((encode_a([" " + t for t in texts]), bytes_a), (encode_b(texts), bytes_b)):
        n = np.array([len(x) for x in found], np.int64)
        ids = np.concatenate([np.array(x, np.int64) for x in found]) if found else np.zeros(0, np.int64)
        upto = np.concatenate(([0], np.cumsum(vocabulary.lengths(ids))))[np.concatenate(([0], np.cumsum(n)))]
        same = np.diff(upto) == size
        joined, at = vocabulary.joined(ids), np.flatnonzero(same)
        want = np.frombuffer(b"".join(raw[i] for i in at), np.uint8)
        differ = joined[spread(upto[at], size[at])] != want
        same[at[np.repeat(np.arange(len(at)), size[at])[differ]]] = False
        right &= same
        out.append((ids, n))
    (a, n_a), (b, n_b) = out
    return a[np.repeat(right, n_a)], b[np.repeat(right, n_b)], n_a * right, n_b * right, right


def align_units(texts: list[str], folder: str) -> Units:
    """The units' tokens cut into groups where both tokenizers end, and linked where two tokens end together."""
    _, bytes_a, _, bytes_b = tokenizers(folder)
    wholes, each = _joined(texts)
    a, b, n_a, n_b, right = _encoded(wholes, folder)
    if not right.all():  # the units of a text that isn't given back are looked at one by one
        first = np.cumsum([0, *each])
        alone = set(np.flatnonzero(~right).tolist())
        pieces = [x for k, whole in enumerate(wholes) for x in (texts[first[k] : first[k + 1]] if k in alone else [whole])]
        each = [n for k, count in enumerate(each) for n in ([1] * count if k in alone else [count])]
        a, b, n_a, n_b, right = _encoded(pieces, folder)
    right = np.repeat(right, each)
    size = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts], np.int64) * right
    unit_end = np.cumsum(size)
    upto = np.concatenate(([0], unit_end))
    end_a, end_b = np.cumsum(bytes_a.lengths(a)), np.cumsum(bytes_b.lengths(b))
    per_unit = lambda ends: np.diff(np.searchsorted(ends, upto, side="right"))  # noqa: E731  the ends of units are ends of tokens, and cuts
    n_a, n_b = per_unit(end_a), per_unit(end_b)
    cuts = np.intersect1d(end_a, end_b, assume_unique=bool((end_a[1:] > end_a[:-1]).all() and (end_b[1:] > end_b[:-1]).all()))
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    n_groups = per_unit(cuts)
    low = np.searchsorted(end_b, end_a, side="left")
    times = np.searchsorted(end_b, end_a, side="right") - low
    links = np.repeat(a, times) << 32 | b[spread(low, times)]
    link_end = np.concatenate(([0], np.cumsum(times)))[np.concatenate(([0], np.cumsum(n_a)))]
    # a token's place among both: after all tokens of groups before, A before B
    upto_a, upto_b = (np.cumsum(np.bincount(g, minlength=len(cuts))) for g in (group_a, group_b))
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[upto_a - 1] = last_b[upto_b - 1] = True
    written = np.zeros((len(a) + len(b), 8), np.uint8)
    written[np.arange(len(a)) + np.concatenate(([0], upto_b))[group_a]] = _numbers(a, np.where(last_a, ord("|"), ord(",")))
    written[np.arange(len(b)) + upto_a[group_b]] = _numbers(b, np.where(last_b, ord(";"), ord(",")))
    flat = written.reshape(-1)
    ends = np.concatenate(([0], np.cumsum(written.astype(bool).sum(axis=1))))[np.concatenate(([0], np.cumsum(n_a + n_b)))].tolist()
    text = flat[flat != 0].tobytes().decode("ascii")
    groups = [text[x : y - 1] for x, y in zip(ends, ends[1:])]
    return Units(n_a, n_b, n_groups, right, groups, links, link_end)


class Memory:
    """Units of a task that have been encoded, each once."""

    def __init__(self, folder: str) -> None:
        self.folder, self.place, self.chars, self.known = folder, {}, 0, None

    def of(self, units: list[str]) -> tuple[Units, np.ndarray]:
        """What is known of units, and each one's place in it."""
        if len(self.place) > UNITS or self.chars > UNIT_CHARS:
            self.place, self.chars, self.known = {}, 0, None
        new = list(dict.fromkeys(u for u in units if u not in self.place))
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.chars += sum(map(len, new))
            added = align_units(new, self.folder)
            self.known = self.known + added if self.known else added
        return self.known, np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))


def units_of(text: str) -> list[str]:
    """The pieces of a text between single spaces that have no white space beside them."""
    return _SPACE.split(text) if text[0] == " " or text[-1] == " " or _ODD_SPACE.search(text) else text.split(" ")


def _documents(folder: str, keep_groups: bool):
    """Of each text its counts, the hash of its groups, and its id pairs with how often they are linked."""

    def some(texts: list[str], memory: Memory) -> list:
        split = [units_of(t) if t else [] for t in texts]
        n = np.array([len(u) for u in split], np.int64)
        if not n.sum():
            empty = np.zeros(len(texts), np.int64)
            return [empty, empty, empty, empty, ["" for _ in texts], [None for _ in texts], np.zeros(0, np.int64), np.zeros(0, np.int64), empty]
        known, place = memory.of([u for units in split for u in units])
        bounds = np.concatenate(([0], np.cumsum(n)))
        total = lambda values: np.diff(np.concatenate(([0], np.cumsum(values[place])))[bounds])
        right = (total(~known.right) == 0) & (n > 0)
        counts = [total(v) * right for v in (known.n_a, known.n_b, known.n_groups)]
        kept = place[np.repeat(right, n)]
        length = known.link_end[kept + 1] - known.link_end[kept]
        links = known.links[spread(known.link_end[kept], length)]
        n_links = total(np.diff(known.link_end)) * right
        of = np.repeat(np.arange(len(texts)), n_links)
        order = np.lexsort((links, of))
        links, of = links[order], of[order]
        fresh = np.flatnonzero(np.concatenate(([True], (links[1:] != links[:-1]) | (of[1:] != of[:-1]))) if len(links) else np.zeros(0, bool))
        times = np.diff(np.append(fresh, len(links)))
        groups = [";".join([known.groups[i] for i in place[x:y].tolist()]) if ok else None for x, y, ok in zip(bounds.tolist(), bounds[1:].tolist(), right.tolist())]
        hashes = ["" if g is None else hashlib.sha256(g.encode()).hexdigest() for g in groups]
        return [*counts, n_links, hashes, groups, links[fresh], times, np.bincount(of[fresh], minlength=len(texts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(folder)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            low = 0
            while low < len(texts):
                high, chars = low, 0
                while high < len(texts) and (high == low or chars + len(texts[high]) <= PIECE):
                    chars += len(texts[high])
                    high += 1
                n_a, n_b, n_groups, n_links, hashes, groups, pairs, times, n_pairs = some(texts[low:high], memory)
                ends = pa.array(np.concatenate(([0], np.cumsum(n_pairs))), pa.int32())
                columns = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
                columns += [pa.array(hashes, pa.string()), pa.array(groups if keep_groups else [None] * len(hashes), pa.string())]
                columns += [pa.ListArray.from_arrays(ends, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(low, high - low), *columns], ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times"])
                low = high

    return run


# ---- counts


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs and times of a batch, end to end, and how many each row has."""
    pairs, times = batch.column("pairs"), batch.column("times")
    return pairs.flatten().to_numpy(), times.flatten().to_numpy(), np.diff(pairs.offsets.to_numpy())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, salt, n): links of each id pair in a task."""
    salt = TaskContext.get().partitionId() % SALTS
    pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.full(len(pair), salt, np.int32)), pa.array(n)], ["pair", "salt", "n"])

    for batch in batches:
        pairs, times, _ = _lists(batch)
        both, inverse = np.unique(np.concatenate((pair, pairs)), return_inverse=True)
        sums = np.zeros(len(both), np.int64)
        np.add.at(sums, inverse, np.concatenate((n, times)))
        pair, n = both, sums
        if len(pair) > PAIRS:
            yield rows()
            pair, n = pair[:0], n[:0]
    yield rows()


def _rated(frequent):
    """n_best and count_sum over the pairs that are broadcast, and the pairs that aren't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = frequent.value
        for batch in batches:
            pairs, times, each = _lists(batch)
            at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            upto = np.concatenate(([0], np.cumsum(each)))
            total = lambda values: np.diff(np.concatenate(([0], np.cumsum(values)))[upto])  # noqa: B023, E731
            n_best, count_sum = (total(times * hit * v[at]) if len(known) else np.zeros(len(each), np.int64) for v in (best, count))
            ends = pa.array(np.concatenate(([0], np.cumsum(total(~hit)))), pa.int32())
            rare = [pa.ListArray.from_arrays(ends, pa.array(v[~hit], pa.int64())) for v in (pairs, times)]
            old = [batch.column(c) for c in ("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")]
            yield pa.RecordBatch.from_arrays([*old, pa.array(n_best), pa.array(count_sum), *rare], ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "n_best", "count_sum", "pairs", "times"])

    return run


def align(docs: DataFrame, folder: str = FOLDER, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per input row (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups), and per id pair that is
    linked (a, b, n, best).

    A encodes a space and the text, B the text, both without special tokens, whose strings are plain text. Offsets where
    tokens of both end cut them into groups, written ``a1,a2|b1;a3|b2,b3`` (``groups``, null unless they are to be kept).
    Two tokens are linked if they end together. ``n`` counts an id pair's links in all rows, repeated rows too; ``best``
    says that no A id has more links with b. ``n_best`` counts a row's links of such pairs, ``count_sum`` sums n over its
    links. Texts that are null or empty, or that either tokenizer's bytes don't give back (U+2581), have no tokens: zeros
    and an empty hash. Ids may be null or shared; extra columns are ignored; an empty table gives empty results.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    head = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"
    found = source.mapInArrow(_documents(folder, keep_groups), f"{head}, pairs array<long>, times array<long>")
    found = freeze(found.withColumn("row", F.monotonically_increasing_id()), "aligned_documents")
    salted = found.select("pairs", "times").mapInArrow(_counted, "pair long, salt int, n long").groupBy("pair", "salt").agg(F.sum("n").alias("n"))
    # a task's pairs are bounded, and so are a pair's rows: one for each salt
    pairs = freeze(salted.groupBy("pair").agg(F.sum("n").alias("n")), "aligned_pairs").withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1))
    most = F.broadcast(pairs.groupBy("b").agg(F.max("n").alias("most")))  # at most a row for each id of B
    rated = freeze(pairs.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "aligned_rated")
    # the powers of two under which a count lies are at most 64 rows
    by_size = sorted(((r[0], r[1]) for r in rated.groupBy(F.length(F.bin("n")).alias("bits")).count().collect()), reverse=True)
    total, bits = 0, 65
    for size, n in by_size:
        if total + n > HOT_PAIRS:
            break
        total, bits = total + n, size
    hot = F.length(F.bin("n")) >= bits
    table = rated.where(hot).orderBy("pair").toPandas()
    frequent = spark.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64), table["best"].to_numpy(bool)))
    rows = found.mapInArrow(_rated(frequent), f"row long, {head}, n_best long, count_sum long, pairs array<long>, times array<long>")
    if total < sum(n for _, n in by_size):
        rows = freeze(rows, "aligned_rows")
        links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
        rare = links.join(rated.where(~hot), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"))
        rows = rows.join(rare, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    rows = rows.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")
    return rows, rated.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b"), "n", "best")
