"""Removal of byte strings that occur earlier, by a distributed suffix merge sort.

A byte goes when a ``width``-byte string that covers it also starts earlier.

* Documents that equal an earlier one are settled by their hash.
* Sorting every suffix is not needed. Each window of ``width`` bytes contains the
  same anchors wherever it occurs: the place of the smallest hash among its
  32-byte strings. Two equal windows hence have a common anchor at the same
  offset, and only suffixes at anchors whose 32 bytes occur twice are sorted,
  with the bytes to their left. This loses no repeat.
* A fixed number of tasks, whatever the input's size, each sort their suffixes
  (Spark's sort, which spills) into one run. It is front-coded: what a suffix
  shares with the one before isn't sent. Suffixes with equal surroundings are
  combined into the earliest, so a passage that a third of all documents share is
  one entry of each run. The others are settled: they leave the run as narrow rows
  of bounded size that go past the merge, to ranges of their own dealt in turn.
* Runs are cut at splitters taken from a sample of the suffixes, and exchanged in
  blocks. Splitters compare whole suffixes and what is to their left, so a start
  that very many suffixes have is cut as well.
* A loser tree merges the runs of a range. Every contender knows how much it shares
  with the suffix last put out; contenders are compared by that number alone, and
  byte by byte only from there on where it is the same. Blocks arrive in the
  order in which the merge runs out of them (that of the suffix before each), so
  a task holds one block of a run. Where there are more runs than a merge
  takes, groups of them are merged first, pass after pass.
* In the merged order, the right parts of two windows are equal when no common
  prefix between them is shorter; with the left parts' hashes that makes the
  classes of equal windows, of which all but the earliest are repeats. This is
  done for a chunk of the order at a time. Chunks end between two 32-byte
  starts; where one start has too many suffixes for that, and at the splitters,
  the windows that may go on beyond the end send their earliest place, and
  those meet once more by window: at most one row for each window and chunk.
"""

from __future__ import annotations

import hashlib
import itertools
from bisect import bisect_left
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .tables import freeze, text_or_empty

WIDTH = 100
GRAM = 32
PLACE_BITS = 28
#: windows looked at together; bounds memory on long texts
PIECE = 1 << 20
#: runs, and ranges of the merge, for each core of the cluster
TASKS_PER_CORE = 4
#: suffixes of the sample for each range
SAMPLES = 16
#: suffixes of a block, the unit of exchange
BLOCK = 256
#: settled places of one row
SETTLED = 4096
#: runs that one merge takes; it holds a block of each
FAN_IN = 1024
#: suffixes classified together, or twice as many where no end between two starts comes
CHUNK = 20_000


# ---- anchors


def anchors(text: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's anchors: for each window the leftmost smallest 32-byte hash."""
    span = width - GRAM + 1
    places, hashes = [], []
    for low in range(0, len(text) - width + 1, PIECE):
        piece = text[low : low + PIECE + width - 1]
        c = words.rolling(piece)
        n = len(piece) - GRAM + 1
        grams = words.mix((c[GRAM:] - c[:n]) * words.powers(n)[1])
        least = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(n, dtype=np.uint64)
        wide = 1
        while wide < span:
            step = min(wide, span - wide)
            least = np.minimum(least[:-step], least[step:])
            wide += step
        at = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        places.append(at + low)
        hashes.append(grams[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, doc, place, times). Of a batch's equal hashes one row stands for all
    and counts them; the others (0) are known to repeat and travel anywhere."""
    for batch in batches:
        docs = batch.column("doc").to_numpy()
        found = [anchors(text) for text in words.texts(batch.column("text"))]
        doc = np.repeat(docs, [len(f[0]) for f in found])
        place = np.concatenate([f[0] for f in found] + [np.zeros(0, np.int64)])
        gram = np.concatenate([f[1] for f in found] + [np.zeros(0, np.uint64)])
        _, first, inverse, times = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
        times = times.astype(np.int32)[inverse]
        other = first[inverse] != np.arange(len(gram))
        times[other] = 0
        gram[other] = words.mix(gram[other] + place[other].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + doc[other].astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(doc), pa.array(place.astype(np.int32)), pa.array(times)], ["gram", "doc", "place", "times"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, (doc, place) of those whose hash is not alone."""
    last = None  # the last row so far: its hash, doc, place, and whether it has been put out
    for batch in batches:
        gram, doc, place, times = (batch.column(c).to_numpy() for c in ("gram", "doc", "place", "times"))
        own = times > 0
        out_doc, out_place = [doc[~own]], [place[~own]]
        gram, doc, place, times = gram[own], doc[own], place[own], times[own]
        if len(gram):
            same = np.concatenate(([last is not None and gram[0] == last[0]], gram[1:] == gram[:-1]))
            keep = same | (times > 1) | np.concatenate((same[1:], [False]))
            if same[0] and not last[3]:
                out_doc.append(np.array([last[1]]))
                out_place.append(np.array([last[2]], np.int32))
            out_doc.append(doc[keep])
            out_place.append(place[keep])
            last = (gram[-1], doc[-1], place[-1], keep[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_doc), pa.int64()), pa.array(np.concatenate(out_place), pa.int32())], ["doc", "place"])


# ---- runs


def _surroundings(width: int = WIDTH, rows: int = 20_000):
    """(suffix, left, doc, place) of each place of (number, text, places)."""
    names, kinds = ["suffix", "left", "doc", "place"], [pa.binary(), pa.binary(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]
        for batch in batches:
            for doc, text, places in zip(batch.column("number").to_pylist(), words.texts(batch.column("text")), batch.column("places").to_pylist(), strict=True):
                text = text.tobytes()
                for low in range(0, len(places), rows):
                    some = places[low : low + rows]
                    for column, values in zip(out, ([text[p : p + width] for p in some], [text[max(0, p - width + GRAM) : p] for p in some], [doc] * len(some), some), strict=True):
                        column += values
                    if len(out[0]) >= rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                        out = [[], [], [], []]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return run


def padded(data: np.ndarray, length: np.ndarray, width: int, right: bool = False) -> np.ndarray:
    """Byte strings laid end to end as rows of a table, zeros after them (before them with ``right``)."""
    inside = np.arange(width) >= width - length[:, None] if right else np.arange(width) < length[:, None]
    out = np.zeros(inside.shape, np.uint8)
    out[inside] = data
    return out


@dataclass
class Suffixes:
    """Sorted suffixes with what each shares with the one before, the bytes to their left, and their places."""

    shared: np.ndarray
    suffix: np.ndarray  # table, zeros after
    length: np.ndarray
    left: np.ndarray  # table, zeros before
    left_length: np.ndarray
    doc: np.ndarray
    place: np.ndarray

    def rows(self, of) -> Suffixes:
        return Suffixes(*(getattr(self, name)[of] for name in self.__dataclass_fields__))


BLOCKS = "part int, run int, place_in_run int, forecast binary, final boolean, shared binary, length binary, tails binary, left_length binary, lefts binary, doc binary, place binary, done binary"
_KINDS = {"int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
_COLUMNS = dict(part.split() for part in BLOCKS.split(", "))


class RunWriter:
    """Cuts a run into front-coded blocks. ``forecast`` is the suffix before a block: a merge
    needs the block when it has put that out. It is null for the first of a part."""

    def __init__(self, run: int) -> None:
        self.run, self.blocks, self.pending, self.before = run, 0, None, None

    def put(self, part: int, some: Suffixes) -> Iterator[dict]:
        """Blocks that are complete; what is added comes after all that was."""
        for low in range(0, len(some.shared), BLOCK):
            block = some.rows(slice(low, low + BLOCK))
            fresh = self.pending is None or self.pending["part"] != part
            if fresh:
                block.shared = block.shared.copy()
                block.shared[0] = 0
            yield from self.flush(final=fresh)
            places = np.arange(block.suffix.shape[1])
            self.pending = {
                "part": part,
                "run": self.run,
                "place_in_run": self.blocks,
                "forecast": None if fresh else self.before,
                "shared": block.shared.astype(np.uint8).tobytes(),
                "length": block.length.astype(np.uint8).tobytes(),
                "tails": block.suffix[(places >= block.shared[:, None]) & (places < block.length[:, None])].tobytes(),
                "left_length": block.left_length.astype(np.uint8).tobytes(),
                "lefts": block.left[np.arange(block.left.shape[1]) >= block.left.shape[1] - block.left_length[:, None]].tobytes(),
                "doc": block.doc.astype(np.int64).tobytes(),
                "place": block.place.astype(np.int32).tobytes(),
            }
            self.blocks += 1
            self.before = block.suffix[-1, : block.length[-1]].tobytes()

    def flush(self, final: bool = True) -> Iterator[dict]:
        if self.pending:
            yield self.pending | {"final": final}
            self.pending = None


class SettledWriter:
    """Rows of settled (doc, start, end), none of more than ``most`` places, dealt in turn to the ranges behind those of the merge."""

    def __init__(self, run: int, parts: int, most: int) -> None:
        self.run, self.parts, self.most, self.turn, self.waiting, self.n = run, parts, most, run, [], 0

    def put(self, places: np.ndarray) -> Iterator[dict]:
        self.waiting.append(places)
        self.n += len(places)
        if self.n >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[dict]:
        places = np.concatenate([*self.waiting, np.zeros((0, 3), np.int64)]).astype(np.int64)
        for low in range(0, len(places), self.most):
            yield {"part": self.parts + self.turn % self.parts, "run": self.run, "place_in_run": -1, "done": places[low : low + self.most].tobytes()}
            self.turn += 1
        self.waiting, self.n = [], 0


def block_rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _KINDS[k]) for c, k in _COLUMNS.items()], list(_COLUMNS))


def _front_coded(splitters: list[tuple[bytes, bytes]], width: int = WIDTH):
    """The blocks of a task's run, from rows sorted by suffix, left, doc and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, part, last = RunWriter(TaskContext.get().partitionId()), 0, None
        settled = SettledWriter(writer.run, len(splitters) + 1, SETTLED)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            (suffix, ends), (left, left_ends) = (words.flat(batch.column(c)) for c in ("suffix", "left"))
            length, left_length = np.diff(ends), np.diff(left_ends)
            suffix, left = padded(suffix, length, width), padded(left, left_length, width - GRAM, True)
            doc, place = batch.column("doc").to_numpy(), batch.column("place").to_numpy().astype(np.int64)
            if last is None:
                last = suffix[0], -1, left[0], -1
            before = [np.concatenate([[x], y[:-1]]) for x, y in zip(last, (suffix, length, left, left_length), strict=True)]
            last = suffix[-1], length[-1], left[-1], left_length[-1]
            differ = np.concatenate([suffix != before[0], np.ones((n, 1), bool)], axis=1).argmax(axis=1)
            shared = np.maximum(0, np.minimum(differ, np.minimum(length, before[1])))
            same = (differ == width) & (length == before[1]) & (left_length == before[3]) & (left == before[2]).all(axis=1)
            least = np.maximum(0, width - length)
            whole = same & (left_length >= least)  # an earlier one has the same surroundings, windows included
            out = list(settled.put(np.stack([doc, place - left_length, place + width - least], axis=1)[whole]))
            found, kept = Suffixes(shared, suffix, length, left, left_length, doc, place), ~same
            key = lambda i: (batch.column("suffix")[i].as_py(), batch.column("left")[i].as_py())  # noqa: B023, E731
            at = 0
            while at < n:
                end = n if part == len(splitters) or key(n - 1) < splitters[part] else bisect_left(range(n), splitters[part], lo=at, key=key)
                rows = np.arange(at, end)
                out += writer.put(part, found.rows(rows[kept[at:end]]))
                at = end
                part += end < n
            yield block_rows(out)
        yield block_rows([*writer.flush(), *settled.flush()])

    return run


# ---- merging


@dataclass
class Block:
    part: int
    run: int
    forecast: bytes | None
    final: bool
    shared: list[int]
    length: list[int]
    tails: bytes
    left: np.ndarray
    left_length: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    base: int = 0  # number of its first suffix among all that a merge opened
    taken: int = 0


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, Iterator[dict]]]:
    """Stretches of rows that are settled and of rows that are blocks, one row at a time."""
    rows = ({c: batch.column(c)[i].as_py() for c in _COLUMNS} for batch in batches for i in range(batch.num_rows))
    return itertools.groupby(rows, key=lambda row: row["done"] is not None)


def read_block(row: dict, width: int = WIDTH) -> Block:
    left_length = np.frombuffer(row["left_length"], np.uint8).astype(np.int64)
    left = padded(np.frombuffer(row["lefts"], np.uint8), left_length, width - GRAM, True)
    return Block(row["part"], row["run"], row["forecast"], row["final"], list(row["shared"]), list(row["length"]), row["tails"], left, left_length, np.frombuffer(row["doc"], np.int64), np.frombuffer(row["place"], np.int32).astype(np.int64))


def shared_prefix(a: bytes, b: bytes, low: int) -> int:
    """Length of the common prefix of two suffixes that share ``low`` bytes."""
    high = min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:  # a[:low] is shared, a[:high] is not
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def merge_runs(blocks: Iterator[Block]) -> Iterator[tuple[Block, int, int, bytes]]:
    """(block, place in it, what it shares with the one before, suffix) in order, by a loser tree.

    ``blocks`` come by their forecast, those without first; of a run they come in its order.
    ``known[r]`` is how much run r's current suffix shares with the suffix last put out.
    """
    first, blocks = [], iter(blocks)
    ahead = None
    for ahead in blocks:
        if ahead.forecast is not None:
            break
        first.append(ahead)
        ahead = None
    if ahead is not None:
        blocks = itertools.chain([ahead], blocks)
    n, opened = len(first), 0
    own, at, tail_at = [None] * n, [0] * n, [0] * n
    current: list[bytes | None] = [None] * n
    known = [0] * n
    slot = {block.run: r for r, block in enumerate(first)}
    waiting: dict[int, deque[Block]] = defaultdict(deque)

    def start(r: int, block: Block) -> None:
        nonlocal opened
        own[r], at[r], tail_at[r], block.base = block, 0, 0, opened
        opened += len(block.shared)

    def advance(r: int) -> None:
        block, i = own[r], at[r]
        if i == len(block.shared):
            if block.final:
                current[r] = None
                return
            while not waiting[r]:  # the one asked for is next, but for those with the same forecast
                ahead = next(blocks)
                waiting[slot[ahead.run]].append(ahead)
            block, i = waiting[r].popleft(), 0
            start(r, block)
        shared = known[r] = block.shared[i]
        rest, low = block.length[i] - shared, tail_at[r]
        tail = block.tails[low : low + rest]
        current[r] = current[r][:shared] + tail if shared else tail
        tail_at[r] = low + rest
        at[r] = i + 1

    def beats(a: int, b: int) -> bool:
        """Whether run a comes before run b; tells the loser what it shares with the winner."""
        x, y = current[a], current[b]
        if y is None:
            return True
        if x is None:
            return False
        if known[a] != known[b]:
            return known[a] > known[b]
        both = shared_prefix(x, y, known[a])
        if both == len(x) or (both < len(y) and x[both] < y[both]):
            known[b] = both
            return True
        known[a] = both
        return False

    for r, block in enumerate(first):
        start(r, block)
        advance(r)
    size = 1 << max(0, (n - 1).bit_length())
    losers = [-1] * size

    def play(node: int) -> int:
        if node >= size:
            return node - size if node - size < n else -1
        a, b = play(2 * node), play(2 * node + 1)
        if b < 0 or (a >= 0 and beats(a, b)):
            losers[node] = b
            return a
        losers[node] = a
        return b

    winner = play(1) if n else -1
    while winner >= 0 and current[winner] is not None:
        yield own[winner], at[winner] - 1, known[winner], current[winner]
        advance(winner)
        node = (winner + size) >> 1
        while node:
            other = losers[node]
            if other >= 0 and not beats(winner, other):
                losers[node], winner = winner, other
            node >>= 1


@dataclass
class Chunk:
    """Suffixes of a merge, collected in order; each open block gives a stretch of its rows."""

    numbers: list[int] = field(default_factory=list)
    shared: list[int] = field(default_factory=list)
    suffixes: list[bytes] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)

    def add(self, block: Block, i: int, shared: int, suffix: bytes) -> None:
        if not i:
            self.blocks.append(block)
        self.numbers.append(block.base + i)
        self.shared.append(shared)
        self.suffixes.append(suffix)

    def take(self, width: int = WIDTH) -> Suffixes:
        """What was collected; the chunk is empty then."""
        numbers, suffixes = np.array(self.numbers, np.int64), self.suffixes
        in_order = np.sort(numbers)
        rows = np.searchsorted(in_order, numbers)
        stretches = []
        for block in sorted(self.blocks, key=lambda b: b.base):
            low = block.taken
            block.taken = int(np.searchsorted(in_order, block.base + len(block.shared)) - np.searchsorted(in_order, block.base)) + low
            stretches.append((block, slice(low, block.taken)))
        column = lambda name: np.concatenate([getattr(b, name)[s] for b, s in stretches])[rows]
        length = np.array([len(s) for s in suffixes], np.int64)
        table = padded(np.frombuffer(b"".join(suffixes), np.uint8), length, width)
        out = Suffixes(np.array(self.shared, np.int64), table, length, column("left"), column("left_length"), column("doc"), column("place"))
        self.blocks = [b for b in self.blocks if b.taken < len(b.shared)]
        self.numbers, self.shared, self.suffixes = [], [], []
        return out


def _merged_runs(width: int = WIDTH):
    """Blocks of one run for each group of runs of a part, and settled rows as they are; rows sorted by part, group and forecast."""

    def merged(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for (part, group), blocks in itertools.groupby((read_block(r, width) for r in rows), key=lambda b: (b.part, b.run // FAN_IN)):
            writer, chunk = RunWriter(group), Chunk()
            for item in merge_runs(blocks):
                chunk.add(*item)
                if len(chunk.numbers) == CHUNK:
                    yield block_rows(list(writer.put(part, chunk.take(width))))
            if chunk.numbers:
                yield block_rows(list(writer.put(part, chunk.take(width))))
            yield block_rows(list(writer.flush()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for settled, rows in rows_of(batches):
            yield from (block_rows([row]) for row in rows) if settled else merged(rows)

    return run


def classify(some: Suffixes, cross: np.ndarray, width: int = WIDTH) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]:
    """(doc, start, end) of the bytes that repeated windows cover, and for each number of bytes to
    the left the rows whose window is the earliest of its class here, and may be found elsewhere.

    ``cross`` is what a suffix shares with those before or after all these, at most.
    """
    shared, lefts, doc, place = some.shared, some.left, some.doc, some.place
    earliest = []
    near = shared >= GRAM
    keep = near | np.concatenate((near[1:], [False])) | (cross >= GRAM)
    order = np.flatnonzero(keep)[np.lexsort((place[keep], doc[keep]))]  # earliest first
    span = lefts.shape[1]
    repeated = np.zeros((len(order), span + 3), bool)  # a false column at each side
    left_hash = np.zeros(len(order), np.uint64)
    for a in range(span + 1):
        if a:
            left_hash = words.mix(left_hash + lefts[order, span - a].astype(np.uint64) + np.uint64(1))
        right_class = np.cumsum(shared < width - a)[order].astype(np.uint64)
        valid = np.flatnonzero((some.left_length[order] >= a) & (some.length[order] >= width - a))
        key = words.mix(left_hash[valid] ^ words.mix(right_class[valid] + np.uint64(a << 40)))
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        repeated[valid, a + 1] = first[inverse] != np.arange(len(valid))
        one = order[valid[first]]
        earliest.append(one[cross[one] >= width - a])
    edge = repeated[:, 1:] != repeated[:, :-1]
    row, column = np.nonzero(edge)
    row, low, high = row[::2], column[::2], column[1::2] - 1  # offsets low..high repeat
    return (doc[order][row], place[order][row] - high, place[order][row] - low + width), earliest


def _chunk_spans(some: Suffixes, below: int, above: int, width: int) -> Iterator[tuple]:
    """(doc, start, end, None) of what repeats in a chunk, and (doc, start, end, key) of each
    window's earliest place where the window may go on before or after the chunk."""
    some.shared[0] = below
    upward = np.minimum.accumulate(np.append(some.shared[1:], above)[::-1])[::-1]
    found, earliest = classify(some, np.maximum(np.minimum.accumulate(some.shared), upward), width)
    yield *found, None
    for a, at in enumerate(earliest):
        if len(at):
            keys = [hashlib.blake2b(some.left[i, some.left.shape[1] - a :].tobytes() + some.suffix[i, : width - a].tobytes(), digest_size=16, salt=bytes([a])).digest() for i in at.tolist()]
            yield some.doc[at], some.place[at] - a, some.place[at] - a + width, keys


def _spans(splitters: list[tuple[bytes, bytes]], width: int = WIDTH):
    """What repeats, from the blocks of a range's runs, sorted by part and forecast."""

    def merged(rows: Iterator[dict]) -> Iterator[tuple]:
        for part, blocks in itertools.groupby((read_block(r, width) for r in rows), key=lambda b: b.part):
            low, high = splitters[part - 1][0] if part else b"", splitters[part][0] if part < len(splitters) else b""
            chunk, below, last = Chunk(), None, b""
            for item in merge_runs(blocks):
                if below is None:
                    below = shared_prefix(low, item[3], 0)
                elif len(chunk.numbers) >= CHUNK and (item[2] < GRAM or len(chunk.numbers) >= 2 * CHUNK):
                    yield from _chunk_spans(chunk.take(width), below, item[2], width)
                    below = item[2]
                chunk.add(*item)
                last = item[3]
            if chunk.numbers:
                yield from _chunk_spans(chunk.take(width), below, shared_prefix(last, high, 0), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for settled, rows in rows_of(batches):
            for *span, keys in ((*np.frombuffer(r["done"], np.int64).reshape(-1, 3).T, None) for r in rows) if settled else merged(rows):
                columns = [pa.array(np.ascontiguousarray(x), pa.int64()) for x in span]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.binary()) if keys is None else pa.array(keys, pa.binary())], ["doc", "start", "end", "key"])

    return run


# ---- the operator


def _cut(width: int):
    """What is left of each text, as counts and a hash or as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text, copy, spans in zip(words.texts(batch.column("text")), batch.column("copy").to_pylist(), batch.column("spans"), strict=True):
                text = text.tobytes()
                found = [(0, len(text))] if copy and len(text) >= width else merge_spans(np.array(spans.values.flatten()[0]), np.array(spans.values.flatten()[1])) if spans.is_valid else []
                at, kept = 0, []
                for start, end in found:
                    kept.append(text[at:start])
                    at = end
                kept.append(text[at:])
                left = b"".join(kept)
                for column, value in zip(columns, (len(text), len(text) - len(left), len(found), hashlib.sha256(left).hexdigest(), [{"start": a, "end": b} for a, b in found]), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return run


def merge_spans(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))
    return list(zip(start[new].tolist(), end[last].tolist(), strict=True))


def splitters_of(source: DataFrame, places: DataFrame, parts: int) -> list[tuple[bytes, bytes]]:
    """At most ``parts - 1`` (suffix, left) that cut the suffixes into ranges of like size; all of a sample with fewer.

    From a seeded sample of SAMPLES to twice as many for each range, without repeats: suffixes
    with equal surroundings are one entry of a run, however many they are.
    """
    n = places.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    share = max(1, n // (parts * SAMPLES))
    some = places.withColumn("places", F.filter("places", lambda p: F.pmod(F.xxhash64("doc", p), F.lit(share)) == 0)).where(F.size("places") > 0)
    rows = source.join(F.broadcast(some), "doc").select("number", "text", "places")  # bounded by the sample
    found = sorted((bytes(r[0]), bytes(r[1])) for r in rows.mapInArrow(_surroundings(), "suffix binary, left binary, doc long, place int").select("suffix", "left").distinct().collect())
    return [found[i * len(found) // parts] for i in range(1, parts)] if len(found) >= parts else found


def sorted_runs(source: DataFrame, places: DataFrame, tasks: int, splitters: list[tuple[bytes, bytes]]) -> DataFrame:
    """The front-coded blocks of at most ``tasks`` runs, one of each task, of (doc, text) and (doc, number, places)."""
    rows = source.join(places, "doc").select("number", "text", "places").coalesce(tasks)
    rows = rows.mapInArrow(_surroundings(), "suffix binary, left binary, doc long, place int")
    return rows.sortWithinPartitions("suffix", "left", "doc", "place").mapInArrow(_front_coded(splitters), BLOCKS)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tasks: int | None = None) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, removed.

    ``removed`` are the maximal runs (start, end) of removed bytes. Earlier means a
    smaller id, or the same document and an earlier start; a null id is the
    smallest. Strings are judged on the input and never cross documents. Rows
    that share an id are ordered by their texts' hash and then anyhow, so of
    rows repeated in full one stays whole. Null counts as empty; texts under
    100 bytes lose nothing; extra columns are ignored; an empty table gives an
    empty result. Ids are integers. ``tasks`` is the number of sorted runs and of
    ranges that are merged; by default TASKS_PER_CORE for each core of the cluster.
    """
    tasks = tasks or TASKS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    digest, by_id = F.unhex(F.sha2("text", 256)), F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))
    source = source.withColumn("doc", by_id)
    narrow, numbers = freeze(source.select("doc", digest.alias("digest"), F.col("doc").alias("number")), "repeats_digests"), None
    if narrow.groupBy("doc").count().where("count > 1").limit(1).count():  # shared ids: a document is a pinned row, and only narrow rows are put in order
        source = freeze(source.withColumn("doc", F.monotonically_increasing_id()), "repeats_rows")
        ordered = source.select(by_id.alias("by_id"), "doc", digest.alias("digest")).orderBy("by_id", "digest", "doc")
        narrow = freeze(ordered.select("doc", "digest", F.monotonically_increasing_id().alias("number")), "repeats_numbers")
        numbers = narrow.select("doc", "number")
    firsts = freeze(narrow.groupBy("digest").agg(F.min("number").alias("first"), F.count("*").alias("n")).where("n > 1"), "repeats_firsts")
    copies = freeze(narrow.join(firsts, "digest").where("number <> first").select("doc", F.lit(True).alias("copy")), "repeats_copies")
    unique = source.join(copies, "doc", "left_anti").select("doc", "text")

    rows = unique.mapInArrow(_anchor_rows, "gram long, doc long, place int, times int")
    found = rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(_repeated, "doc long, place int")
    places = found.groupBy("doc").agg(F.sort_array(F.collect_list("place")).alias("places"))
    places = freeze(places.join(numbers, "doc") if numbers else places.withColumn("number", F.col("doc")), "repeats_places")
    splitters = splitters_of(source.select("doc", "text"), places, tasks)
    blocks = sorted_runs(source.select("doc", "text"), places, tasks, splitters)
    runs = tasks
    while runs > FAN_IN:
        group = F.floor(F.col("run") / FAN_IN).cast("int")
        blocks = blocks.repartition(tasks, "part", group).sortWithinPartitions("part", group, "forecast", "place_in_run").mapInArrow(_merged_runs(), BLOCKS)
        blocks, runs = freeze(blocks, "repeats_runs"), -(-runs // FAN_IN)
    # the ranges of the merge, and as many through which settled rows pass
    merged = blocks.repartitionById(2 * (len(splitters) + 1), F.col("part")).sortWithinPartitions("part", "forecast", "place_in_run")
    merged = freeze(merged.mapInArrow(_spans(splitters), "doc long, start long, end long, key binary"), "repeats_spans")
    # a window's rows here are as many as its start has chunks
    places_of_window = Window.partitionBy("key").orderBy("doc", "start")
    later = merged.where("key is not null").withColumn("n", F.row_number().over(places_of_window)).where("n > 1")
    spans = merged.where("key is null").drop("key").unionByName(later.select("doc", "start", "end"))
    spans = spans.groupBy(F.col("doc").alias("number")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = spans.join(numbers, "number") if numbers else spans.withColumnRenamed("number", "doc")
    spans = freeze(spans.select("doc", "spans"), "repeats_by_doc")

    whole = source.join(copies, "doc", "left").join(spans, "doc", "left").select("id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans")
    kind = whole.schema["id"].dataType.simpleString()
    out = whole.mapInArrow(_cut(WIDTH), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, end: long>>")
    return out.withColumnRenamed("id", id_col)
