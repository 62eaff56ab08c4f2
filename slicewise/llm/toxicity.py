"""Toxicity by non-negative positive-unlabelled learning.

Known: texts confirmed as toxic, and texts about which nothing is known, of
which a share ``prior`` is toxic. With logistic loss l and a linear score g the
risk is ``prior * E_pos l(g) + max(0, E_unl l(-g) - prior * E_pos l(-g))``; where
the second part is below zero the step goes against it, as the estimator asks,
so that the classifier doesn't learn the unlabelled texts by heart. Each step
sees the whole bounded sample: on batches, texts with one telling mark only kept
scores near the threshold that depended on the draw.

Inputs are marks: hashed words, their first 3 to 7 bytes (compounds of any
language), and beginnings that at least two different words of the text share,
present or not. The marks are those most characteristic of the
confirmed texts, counted by Spark over the bounded training sample.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .factorisation import sigmoid
from .features import held_out, one_row_each, seeded_rows, source, word_marks
from .tables import freeze


@dataclass
class Classifier:
    marks: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def present(self, text: np.ndarray) -> np.ndarray:
        """Places in ``marks`` of those that the text has."""
        if not len(self.marks):
            return np.zeros(0, np.int64)
        found = word_marks(text)
        at = np.searchsorted(self.marks, found)
        at[at == len(self.marks)] = 0
        return at[self.marks[at] == found]

    def logits(self, texts: Iterable[np.ndarray]) -> np.ndarray:
        found = [self.present(text) for text in texts]
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        index = np.concatenate([*found, np.zeros(0, np.int64)])
        return self.bias + np.bincount(owner, weights=self.weights[index], minlength=len(found))


Texts = tuple[int, np.ndarray, np.ndarray]


def entries(texts: list[np.ndarray]) -> Texts:
    """How many texts there are, and the mark and the text of each of their entries."""
    return len(texts), np.concatenate(texts).astype(np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def mean_loss(theta: np.ndarray, texts: Texts, sign: float) -> tuple[float, np.ndarray]:
    """Mean logistic loss of ``sign * g`` and its gradient; the last of ``theta`` is the bias."""
    n, index, owner = texts
    g = theta[-1] + np.bincount(owner, weights=theta[index], minlength=n)
    slope = -sign * sigmoid(-sign * g) / n
    out = np.bincount(index, weights=slope[owner], minlength=len(theta))
    out[-1] = slope.sum()
    return float(np.logaddexp(0, -sign * g).mean()), out


def nn_risk(theta: np.ndarray, positive: Texts, unlabelled: Texts, prior: float, beta: float = 0.0, gamma: float = 1.0) -> tuple[float, np.ndarray]:
    """The non-negative risk, and the direction that a step goes against: its gradient, or where
    the part of the negative texts is below ``-beta``, ``-gamma`` times that part's gradient."""
    loss, up = mean_loss(theta, positive, 1.0)
    loss_p, down_p = mean_loss(theta, positive, -1.0)
    loss_u, down_u = mean_loss(theta, unlabelled, -1.0)
    negative = loss_u - prior * loss_p
    direction = prior * up + down_u - prior * down_p if negative >= -beta else -gamma * (down_u - prior * down_p)
    return prior * loss + max(0.0, negative), direction


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], n_marks: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3, beta: float = 0.0, gamma: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk; texts are arrays of mark places."""
    theta = np.zeros(n_marks + 1)
    theta[-1] = np.log(prior / (1 - prior))
    if not positive or not unlabelled:
        return theta[:-1], float(theta[-1])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    some, rest = entries(positive), entries(unlabelled)
    for step in range(1, steps + 1):
        _, grad = nn_risk(theta, some, rest, prior, beta, gamma)
        grad[:-1] += decay * theta[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _mark_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {0: [], 1: []}
        for text, positive in zip(words.texts(batch.column("text")), batch.column("positive").to_pylist(), strict=True):
            found[positive].append(word_marks(text))
        for positive, marks in found.items():
            if marks:
                hashes, times = np.unique(np.concatenate(marks), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(times, pa.int64()), pa.array(np.full(len(hashes), positive), pa.int32())], ["mark", "texts", "positive"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", positives: int = 3000, unlabelled: int = 9000, marks: int = 2000, prior: float | None = None, id_col: str = "doc_id", seed: int = 5) -> Classifier:
    """Learns from at most ``positives`` confirmed and ``unlabelled`` other texts.

    Held-out ids are in neither. The unlabelled texts are a seeded sample of all
    documents, toxic or not, whatever their labels say. Of documents that share an
    id one is taken, so the bounds hold for what is collected. ``prior`` is the share
    of toxic texts; by default that of the labelled rows that aren't held out.
    """
    open_labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label is not null").where(~held_out(F.col("id")))
    known = open_labels.agg(F.avg("label"), F.count("*")).first()
    if prior is None:
        prior = float(np.clip(known[0] if known[1] else 0.05, 0.005, 0.5))
    rows = source(docs, id_col).select("id", "text")
    confirmed = freeze(seeded_rows(open_labels.where("label = 1").select("id").distinct(), positives, seed), "toxicity_confirmed")  # bounded by positives
    sampled = freeze(seeded_rows(rows.select("id").where("id is not null").where(~held_out(F.col("id"))), unlabelled, seed), "toxicity_unlabelled")  # bounded by unlabelled
    wanted = [ids.select("id").distinct().withColumn("positive", F.lit(side)) for ids, side in ((confirmed, 1), (sampled, 0))]
    texts = one_row_each(rows, confirmed.unionByName(sampled))
    texts = freeze(texts.join(F.broadcast(wanted[0].unionByName(wanted[1])), "id"), "toxicity_sample")
    n_pos, n_unl = texts.agg(F.coalesce(F.sum("positive"), F.lit(0)), F.coalesce(F.sum(1 - F.col("positive")), F.lit(0))).first()
    counts = texts.mapInArrow(_mark_counts, "mark long, texts long, positive int").groupBy("mark").agg(F.sum(F.col("texts") * F.col("positive")).alias("p"), F.sum(F.col("texts") * (1 - F.col("positive"))).alias("u"))
    # how far the share among confirmed texts is above that among the others, in standard errors
    share_p, share_u = (F.col("p") + 0.5) / float(n_pos + 1), (F.col("u") + 0.5) / float(n_unl + 1)
    distance = (share_p - share_u) / F.sqrt(share_p / float(n_pos + 1) + share_u / float(n_unl + 1))
    best = counts.where("p >= 3").withColumn("distance", distance).where("distance > 2.5").orderBy(F.desc("distance"), "mark").limit(marks)
    chosen = np.sort(np.array([r[0] for r in best.select("mark").collect()], np.int64).view(np.uint64))
    empty = Classifier(chosen, np.zeros(len(chosen)), 0.0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [empty.present(text).astype(np.int32).tobytes() for text in words.texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(found, pa.binary())], ["positive", "at"])

    placed = texts.select("positive", "text").mapInArrow(place, "positive int, at binary").collect()  # bounded by the sample and marks
    placed.sort(key=lambda r: (r["positive"], bytes(r["at"])))
    groups = [[np.frombuffer(r["at"], np.int32) for r in placed if r["positive"] == side] for side in (1, 0)]
    weights, bias = train_nnpu(*groups, len(chosen), prior)
    return Classifier(chosen, weights, bias)


def score_toxicity(docs: DataFrame, model: Classifier, id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    The score is in 0 to 1, higher for texts likelier toxic. Null counts as empty;
    an empty text has no marks and gets the score of one; rows with a null id are
    scored and not held out; extra columns are ignored; an empty table gives an
    empty result.
    """
    rows = source(docs, id_col).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sigmoid(model.logits(words.texts(batch.column("text")))))], ["id", "score"])

    scored = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Classifier, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns kept; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.log(threshold / (1 - threshold))
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col)).fill_null("")
            yield batch.filter(pa.array(model.logits(words.texts(column)) < limit))

    return docs.mapInArrow(run, docs.schema)
