"""Benchmark decontamination: BM25 over test items, block-max WAND, verification.

The index holds the test items, and as entries of their own the questions that
tell alone; every passage of the corpus is a query. BM25 impacts are divided by
the entry's score against itself, so that 1 means "all of the entry's weight is in
the passage". What the verification accepts has a least share for each entry. Impacts
of questions are scaled so that it is the threshold, and impacts of whole items are
where it is below the threshold, so that one threshold serves all entries and throws
away nothing that would be verified. Entries are ordered by length and cut into blocks of
four. For each passage the block maxima of its rarer terms, and what its commoner terms can
add at most, tell which blocks may reach the threshold; where none can the passage is done.
Elsewhere WAND with block maxima finds every item above the threshold. Hits are
verified on five-word shingles of the item's question and answer.

Items of like length have an index of their own. Its passages overlap by half and are twice
as long as its longest item, so that a leaked item is whole in one of them, and a very
long item doesn't make the passages of short ones longer. The indexes are dealt to
passes over the corpus, of a bounded number of item words each; a pass's hits are written
out before the next pass's indexes are built. Item counts are over all items.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .licenses import tokens
from .tables import freeze, freeze_parts, text_or_empty

K1, B = 1.2, 0.75
BLOCK = 4
LEAST_STRIDE = 32
#: words of the items of the first index; each further one has items up to four times as long
SHORT_ITEM = 64
#: words of test items in the indexes of one pass over the corpus
PART_WORDS = 2_000_000
#: cells of passages and blocks looked at together, at most
CELLS = 1 << 22
EPSILON = 1e-9
#: words of a part times shingles that may be missing, up to which the least share is found place by place
SHARE_WORK = 4_000_000


def split_item(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Question and answer: the last sentence answers; of a single one the last quarter of the words."""
    sentences = [t for t in (tokens(s) for s in re.split(rb"[.?!\n]+", text)) if t]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    found = sentences[0] if sentences else []
    cut = len(found) - len(found) // 4
    return found[:cut], found[cut:]


def shingle_set(found: list[bytes], width: int = 5) -> set[tuple[bytes, ...]]:
    if not found:
        return set()
    width = min(width, len(found))
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


def overlap(part: list[bytes], region: list[bytes]) -> float:
    """Share of a part's shingles that a region holds; 0 for a part without words."""
    own = shingle_set(part)
    width = min(5, len(part))
    held = {tuple(region[i : i + width]) for i in range(len(region) - width + 1)} if own else set()
    return len(own & held) / len(own) if own else 0.0


@dataclass
class Item:
    item_id: int
    question: list[bytes]
    answer: list[bytes]

    @property
    def words(self) -> list[bytes]:
        return self.question + self.answer


def least_share(found: list[bytes], impacts: dict[bytes, float], least: float) -> float:
    """A lower bound of the share of its weight that a text has which holds ``least`` of the part's shingles.

    A word that the text doesn't have takes all shingles around it away; the most weight that
    can go with the shingles that may be missing is found place by place. The weight of a
    repeated word is dealt to its places, which can only lower the bound. For very long parts
    a looser bound does: a place in the middle takes as many shingles as a shingle has places.
    """
    width = min(5, len(found))
    places, own = len(found) - width + 1, len(shingle_set(found))
    missing = next(m for m in range(own, -1, -1) if (own - m) / own >= least)
    spare = missing + places - own  # of repeated shingles each place counts
    times = Counter(found)
    if len(found) * spare > SHARE_WORK:
        heaviest = sorted((impacts[w] / times[w] for w in found), reverse=True)[: spare + 2 * (width - 1)]
        return max(0.0, 1 - sum(heaviest) / sum(impacts.values()))
    # most[d, c]: the weight that is gone at c lost shingles, the last lost word d + 1 places back (width or more: the last row)
    most = np.full((width, spare + 1), -np.inf)
    most[-1, 0] = 0.0
    for at, word in enumerate(found):
        lost = np.full(spare + 1, -np.inf)
        for d in range(width):
            cost = max(0, min(at, places - 1) - max(at - d, 0) + 1)
            if cost <= spare:
                np.maximum(lost[cost:], most[d, : spare + 1 - cost] + impacts[word] / times[word], out=lost[cost:])
        most[-1] = np.maximum(most[-1], most[-2]) if width > 1 else most[-1]
        if width > 1:
            most[1:-1] = most[:-2].copy()
            most[0] = lost
        else:
            most[0] = np.maximum(most[0], lost)
    return 1 - float(most.max()) / sum(impacts.values())


class Index:
    """An inverted index over some of the items, with block maxima.

    ``items`` come with the number of items that hold each of their words;
    ``n_items`` and ``mean_words`` are of all items.
    """

    def __init__(self, items: list[Item], held_by: dict[bytes, int], n_items: int, mean_words: float, longest: int, threshold: float, least: float = 0.75) -> None:
        idf = {term: math.log(1 + (n_items - held + 0.5) / (held + 0.5)) for term, held in held_by.items()}
        entries = []  # the entry, the item that it stands for, and whether that item's question tells alone
        for item in items:
            if item.words:
                asks = self.tells(item, idf, n_items)
                entries.append((item, item, asks))
                if asks and item.answer:
                    entries.append((Item(item.item_id, item.question, []), item, True))
        entries.sort(key=lambda x: (len(x[0].words), str(x[0].item_id)))
        self.items, self.wholes, self.asks = ([x[i] for x in entries] for i in range(3))
        self.raised: list[float] = []
        self.threshold = threshold
        self.stride = max(LEAST_STRIDE, longest)
        self.terms: dict[bytes, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for ordinal, item in enumerate(self.items):
            impacts = {}
            for term, times in Counter(item.words).items():
                impacts[term] = idf[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * len(item.words) / mean_words))
            raised = threshold / max(EPSILON, least_share(item.words, impacts, least) - EPSILON)
            self.raised.append(raised if item is not self.wholes[ordinal] else max(1.0, raised))
            whole = sum(impacts.values()) / self.raised[-1]
            for term, impact in impacts.items():
                if (t := self.terms.setdefault(term, len(postings))) == len(postings):
                    postings.append([])
                postings[t].append((ordinal, impact / whole))
        self.ordinals = [[o for o, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.top = [max(x for _, x in p) for p in postings]
        self.block_max: list[dict[int, float]] = []
        for p in postings:
            most: dict[int, float] = {}
            for o, x in p:
                most[o // BLOCK] = max(most.get(o // BLOCK, 0.0), x)
            self.block_max.append(most)
        self.blocks = max(1, math.ceil(len(self.items) / BLOCK))
        common = [len(m) > max(4, self.blocks // 12) for m in self.block_max]
        self.common = np.full(len(postings) + 1, -1)  # the last place is for unknown words
        self.common[:-1][common] = np.arange(sum(common))
        self.common_max = np.zeros((sum(common), self.blocks), np.float32)
        starts, pair_block, pair_max = [0], [], []
        for t, most in enumerate(self.block_max):
            if common[t]:
                self.common_max[self.common[t], list(most)] = list(most.values())
            else:
                pair_block += most.keys()
                pair_max += most.values()
            starts.append(len(pair_block))
        self.common_top = self.common_max.max(axis=1) if len(self.common_max) else np.zeros(0, np.float32)
        self.starts, self.pair_block, self.pair_max = np.array(starts), np.array(pair_block, np.int64), np.array(pair_max, np.float64)

    @staticmethod
    def tells(item: Item, idf: dict[bytes, float], n_items: int) -> bool:
        """Whether a question is a leak without its answer: it is half of the item or more, or has a
        whole shingle and words so rare that by chance none in ``n_items`` items has them all."""
        if 2 * len(item.question) >= len(item.words):
            return True
        return len(item.question) >= 5 and sum(idf[w] for w in set(item.question)) >= 2 * math.log(1 + n_items)

    def live(self, ids: np.ndarray) -> dict[int, set[int]]:
        """Passages with the blocks whose maxima reach the threshold in them.

        Where a passage's common terms could reach it alone, its sums over all blocks are taken;
        elsewhere only blocks are looked at that its rarer terms have.
        """
        out: dict[int, set[int]] = {}
        total, size = self.passages(len(ids)), len(self.terms)
        goal, at_once = self.threshold - 1e-4, max(1, min(256, CELLS // self.blocks))
        for low in range(0, total, at_once):
            n = min(at_once, total - low)
            own = ids[low * self.stride : (low + n + 1) * self.stride] if low + n < total else ids[low * self.stride :]
            at = np.flatnonzero(own >= 0)
            half = at // self.stride
            keys = np.unique(np.concatenate([np.minimum(half, n - 1) * size + own[at], np.clip(half - 1, 0, n - 1) * size + own[at]]))
            passage, term = keys // size, keys % size
            column = self.common[term]
            is_common = column >= 0
            present = np.zeros((n, len(self.common_max)), np.float32)
            present[passage[is_common], column[is_common]] = 1
            most = present @ self.common_top
            passage, term = passage[~is_common], term[~is_common]
            counts = self.starts[term + 1] - self.starts[term]
            pair = np.repeat(self.starts[term], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            cells, rarer = np.repeat(passage, counts) * self.blocks + self.pair_block[pair], self.pair_max[pair]
            dense = most >= goal
            if dense.any():
                row = np.cumsum(dense) - 1
                inside = dense[cells // self.blocks]
                bound = (present[dense] @ self.common_max).ravel().astype(np.float64)
                bound += np.bincount(row[cells[inside] // self.blocks] * self.blocks + cells[inside] % self.blocks, weights=rarer[inside], minlength=len(bound))
                found = np.flatnonzero(bound >= goal)
                cells, rarer = cells[~inside], rarer[~inside]
                found = np.flatnonzero(dense)[found // self.blocks] * self.blocks + found % self.blocks
                for cell in found.tolist():
                    out.setdefault(low + cell // self.blocks, set()).add(cell % self.blocks)
            if len(cells):
                cells, where = np.unique(cells, return_inverse=True)
                bound = np.bincount(where, weights=rarer, minlength=len(cells))
                maybe = bound + most[cells // self.blocks] >= goal
                cells, bound = cells[maybe], bound[maybe]
                bound += (present[cells // self.blocks] * self.common_max[:, cells % self.blocks].T).sum(axis=1)
                for cell in cells[bound >= goal].tolist():
                    out.setdefault(low + cell // self.blocks, set()).add(cell % self.blocks)
        return out

    def passages(self, n_words: int) -> int:
        return max(1, math.ceil(n_words / self.stride) - 1)

    def search(self, terms: list[int], live: set[int] | None = None) -> list[tuple[int, float]]:
        """Every (ordinal, score) at or above the threshold: WAND with block maxima."""
        goal = self.threshold - EPSILON
        cursors = [[self.ordinals[t][0], t, 0] for t in terms]
        out = []

        def advance(cursor: list[int], to: int) -> bool:
            own = self.ordinals[cursor[1]]
            cursor[2] = bisect_left(own, to, cursor[2])
            if cursor[2] == len(own):
                return False
            cursor[0] = own[cursor[2]]
            return True

        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for i, cursor in enumerate(cursors):
                total += self.top[cursor[1]]
                if total >= goal:
                    pivot = i
                    break
            if pivot < 0:
                break
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            block = at // BLOCK
            reach = sum(self.block_max[c[1]].get(block, 0.0) for c in cursors[: pivot + 1]) if live is None or block in live else 0.0
            if reach < goal:
                to = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                moved = cursors[: pivot + 1]
            elif cursors[0][0] == at:
                moved, to = cursors[: pivot + 1], at + 1
                score = sum(self.impacts[c[1]][c[2]] for c in moved)
                if score >= goal:
                    out.append((at, score))
            else:
                to = at
                moved = [c for c in cursors[:pivot] if c[0] < at]
            gone = [id(c) for c in moved if not advance(c, to)]
            if gone:
                cursors = [c for c in cursors if id(c) not in gone]
        return out

    def leaks(self, found: list[bytes], least: float) -> list[tuple[int, float, float, float, float]]:
        """(item_id, score, question, answer and whole overlap) of the items that a text of these words leaks."""
        if not found or not self.items:
            return []
        get = self.terms.get
        ids = np.array([get(w, -1) for w in found], np.int64)
        best: dict[int, tuple[Item, float, float, float, float]] = {}
        for passage, live in self.live(ids).items():
            start = passage * self.stride
            end = len(found) if passage == self.passages(len(found)) - 1 else start + 2 * self.stride
            terms = np.unique(ids[start:end])
            for ordinal, score in self.search(terms[terms >= 0].tolist(), live):
                item = self.wholes[ordinal]
                margin = len(item.words)
                region = found[max(0, start - margin) : end + margin]
                question, answer, whole = (overlap(x, region) for x in (item.question, item.answer, item.words))
                asked = question if self.asks[ordinal] else 0.0
                share = score / self.raised[ordinal]
                if max(asked, whole) >= least and share > best.get(id(item), (item, 0.0))[1]:
                    best[id(item)] = (item, share, question, answer, whole)
        return [(item.item_id, *x) for item, *x in best.values()]


def _index_parts(items: DataFrame, item_col: str, text_col: str, threshold: float, least: float, part_words: int) -> Iterator[list[Index]]:
    """The indexes of each pass, one pass after the other; a pass's items fit the driver by ``part_words``."""
    source = items.select(F.col(item_col).alias("item_id"), text_or_empty(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [split_item(bytes(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), *(pa.array([s[i] for s in split], pa.list_(pa.binary())) for i in (0, 1))], ["item_id", "question", "answer"])

    kind = source.schema["item_id"].dataType.simpleString()
    split = source.mapInArrow(run, f"item_id {kind}, question array<binary>, answer array<binary>").withColumn("all", F.concat("question", "answer")).where(F.size("all") > 0)
    split = freeze(split.withColumn("class", F.greatest(F.lit(0), F.ceil(F.log2(F.size("all") / SHORT_ITEM) / 2)).cast("int")), "benchmark_items")
    # one row per length class, of which there are as many as powers of four up to the longest item
    classes = split.groupBy("class").agg(F.count("*").alias("items"), F.sum(F.size("all")).alias("words"), F.max(F.size("all")).alias("longest")).orderBy("class").collect()
    if not classes:
        return
    n_items, n_words = sum(c["items"] for c in classes), sum(c["words"] for c in classes)
    held_by = freeze(split.select(F.explode(F.array_distinct("all")).alias("term")).groupBy("term").count(), "benchmark_terms")

    def index(c, part: int, parts: int) -> Index:
        own = split.where((F.col("class") == c["class"]) & (F.pmod(F.xxhash64("item_id", "all"), F.lit(parts)) == part))
        terms = own.select(F.explode("all").alias("term")).distinct().join(held_by, "term")
        counts = {bytes(r["term"]): r["count"] for r in terms.collect()}
        found = [Item(r["item_id"], [bytes(w) for w in r["question"]], [bytes(w) for w in r["answer"]]) for r in own.select("item_id", "question", "answer").collect()]
        return Index(found, counts, n_items, n_words / n_items, c["longest"], threshold, least)

    held, room = [], part_words
    for c in classes:
        parts = min(-(-c["words"] // part_words), c["items"])
        for part in range(parts):
            if held and room < c["words"] / parts:
                yield held
                held, room = [], part_words
            held.append(index(c, part, parts))
            room -= c["words"] / parts
    yield held


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, least: float = 0.75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """One row for each document and test item that it leaks, and none for clean documents:
    id, item id, score, question_overlap, answer_overlap, overlap.

    A hit counts when at least ``least`` of the shingles of question and answer
    together, or of a question that tells alone, are in the passage and its margins. A
    question tells alone if it is half of the item or more, or has five words or more
    and together they are rare among the items. An answer without its question is no leak:
    its overlap is told, and decides nothing. ``score`` is the best passage's BM25 over
    the score of item or question against itself; ``threshold`` bounds it from below
    except where a text with ``least`` of the shingles can have less, so that no copy
    spread over at most the words of the longest item of like length is lost before it is
    verified. Words are lower-cased runs of letters and digits, so case and
    punctuation don't hide a leak. Null and empty texts and items match
    nothing; repeated rows are reported again; extra columns are ignored; empty
    tables give an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    item_type = items.schema[item_col].dataType.simpleString()
    shape = f"id {id_type}, item {item_type}, score double, question_overlap double, answer_overlap double, overlap double"
    item_arrow = pa.int64() if item_type in ("bigint", "int", "smallint", "tinyint") else pa.string()

    def scan(indexes: list[Index]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, found = [], []
                for i, text in enumerate(words.texts(batch.column("text"))):
                    split = tokens(text.tobytes())
                    leaks = [leak for index in indexes for leak in index.leaks(split, least)]
                    rows += [i] * len(leaks)
                    found += leaks
                columns = [pa.array([x[0] for x in found], item_arrow).cast({"int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(item_type, item_arrow))]
                columns += [pa.array([x[i] for x in found], pa.float64()) for i in range(1, 5)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), *columns], ["id", "item", "score", "question_overlap", "answer_overlap", "overlap"])

        return run

    found = freeze_parts((source.mapInArrow(scan(indexes), shape) for indexes in _index_parts(items, item_col, item_text_col, threshold, least, part_words)), "leaks")
    if found is None:
        found = source.limit(0).select("id", F.lit(None).cast(item_type).alias("item"), *(F.lit(0.0).alias(c) for c in ("score", "question_overlap", "answer_overlap", "overlap")))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "score", "question_overlap", "answer_overlap", "overlap")
