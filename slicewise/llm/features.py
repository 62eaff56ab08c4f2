"""Text features of the classifiers, and the split of labelled rows."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .tables import freeze

# fixed values: names of the structure statistics, in order
STATISTICS = (
    "log_bytes", "log_words", "mean_word_bytes", "upper", "digits", "spaces", "line_feeds", "sentence_marks", "commas", "exclamations", "symbols", "pipes", "angles", "quotes", "non_ascii", "distinct_words", "repeated_lines", "log_chars",
)
_CLASSES = [bytes(range(65, 91)), b"0123456789", b" \t", b"\n", b".?;:", b",", b"!", b"#$%&*+=@^_~\\/", b"|", b"<>{}[]", b"\"'`", bytes(range(128, 256))]


def held_out(doc_id: Column) -> Column:
    """True for ids that no classifier learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def statistics(text: np.ndarray, hashes: np.ndarray, n_chars: int | None = None) -> np.ndarray:
    """Structure statistics of a text and of its metadata."""
    counts = np.bincount(text, minlength=256)
    n, n_words = max(len(text), 1), len(hashes)
    shares = [counts[list(x)].sum() / n for x in _CLASSES]
    distinct = len(np.unique(hashes)) / n_words if n_words else 1.0
    lines = text.tobytes().split(b"\n")
    repeated = 1 - len(set(lines)) / len(lines)
    chars = n_chars if n_chars is not None else len(text) - counts[128:192].sum()
    return np.array([np.log1p(len(text)), np.log1p(n_words), n / max(n_words, 1), *shares, distinct, repeated, np.log1p(max(chars, 0))])


def word_counts(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of a text's words, and the words' damped shares."""
    found, times = np.unique((hashes >> np.uint64(20)) & np.uint64(buckets - 1), return_counts=True)
    value = np.log1p(times)
    return found.astype(np.int32), (value / max(np.sqrt((value**2).sum()), 1e-9)).astype(np.float32)


def seeded_rows(ids: DataFrame, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` rows of ``ids``, the first by a seeded hash of the column id and then by all columns.

    Where there are many more, a cut by the hash comes first, so that each task
    passes on a few rows and not ``rows``; if it leaves too few (one id in very
    many rows), it isn't used.
    """
    luck = F.xxhash64(F.lit(seed), "id")
    share = max(1, ids.count() // (4 * rows))
    some = ids.where(F.pmod(F.shiftrightunsigned(luck, 20), F.lit(share)) == 0)
    if share > 1 and some.count() < rows:
        some = ids
    return some.orderBy(luck, *ids.columns).limit(rows)


def one_row_each(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of ``rows`` (id, text and others) for each of the ids that it has, however many rows share one.

    It is the one with the smallest hash of its text, chosen before the shuffle in each
    partition. ``ids`` are few: they are broadcast.
    """
    others = [c for c in rows.columns if c != "id"]
    least = F.min(F.struct(F.xxhash64("text").alias("luck"), *others)).alias("row")
    return rows.join(F.broadcast(ids.select("id").distinct()), "id").groupBy("id").agg(least).select("id", *[F.col(f"row.{c}") for c in others])


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", seed: int = 5) -> DataFrame:
    """At most ``rows`` labelled rows of documents (id, text, n_chars, label) that are not held out.

    Chosen by a seeded hash of the id among all labelled rows; a null label is no label.
    Of documents that share an id one is taken, so the bound holds for what is returned.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label is not null").where(~held_out(F.col("id")))
    chosen = freeze(seeded_rows(chosen, rows, seed), "labelled_ids")  # bounded by rows
    return one_row_each(source(docs, id_col), chosen).join(F.broadcast(chosen), "id")


def source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text as bytes, n_chars or null) of every row."""
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), chars.alias("n_chars"))


#: letters, digits and non-ASCII bytes
_LETTERS = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
#: bytes of the beginnings that are marks
BEGINNINGS = (3, 4, 5, 6, 7)


def word_marks(text: np.ndarray) -> np.ndarray:
    """Distinct hashes of a text's words, of their first 3 to 7 bytes, and of
    beginnings that at least two different words have."""
    if not len(text):
        return np.zeros(0, np.uint64)
    rows, at = [], 0
    while at < len(text):
        end = at + words.PIECE
        while end < len(text) and _LETTERS[text[end]]:  # to the end of a word
            gap = np.flatnonzero(~_LETTERS[text[end : end + words.PIECE]])
            end += int(gap[0]) if len(gap) else words.PIECE
        rows.append(_distinct_words(text[at:end]))
        at = end
    found = _distinct(np.concatenate(rows)) if len(rows) > 1 else rows[0]
    begun, times = np.unique(found[:, 1:], return_counts=True)
    several = words.mix(begun[(times > 1) & (begun > 0)] + np.uint64(1))
    return np.unique(np.concatenate([found[:, 0], begun[begun > 0], several]))


def _distinct(rows: np.ndarray) -> np.ndarray:
    return rows[np.unique(rows[:, 0], return_index=True)[1]]


def _distinct_words(data: np.ndarray) -> np.ndarray:
    """A row for each different word: its hash and those of its beginnings, 0 where it has no more bytes."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _LETTERS[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    c = words.rolling(data, lower=True)
    down = words.powers(len(data) + 1)[1]
    whole, first = np.unique(words.mix((c[end] - c[start]) * down[start]), return_index=True)
    start, end = start[first], end[first]
    out = np.zeros((len(whole), 1 + len(BEGINNINGS)), np.uint64)
    out[:, 0] = whole
    for i, width in enumerate(BEGINNINGS, 1):
        long = end - start > width
        out[long, i] = words.mix((c[start[long] + width] - c[start[long]]) * down[start[long]] + np.uint64(width))
    return out
