"""Quality by a factorisation machine.

The score of a text x is ``sigmoid(b + sum w_i x_i + sum over i<j of <v_i, v_j>
x_i x_j)`` over hashed words, structure statistics and metadata (the length the
table states). The pairwise part is computed in linear time as half of
``(sum v_i x_i)^2 - sum (v_i x_i)^2``. Learning is numpy on the driver, from a
bounded sample of labelled rows; scoring is Arrow batches in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .features import STATISTICS, held_out, labelled_sample, source, statistics, word_counts

WORD_BUCKETS = 1 << 12
FACTORS = 4


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # WORD_BUCKETS, then one for each statistic
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, text: np.ndarray, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        index, value, dense = raw_inputs(text, n_chars)
        return self.placed(index, value, dense)

    def placed(self, index: np.ndarray, value: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((dense - self.mean) / self.scale, -4, 4).astype(np.float32)
        return np.concatenate([index, WORD_BUCKETS + np.arange(len(z), dtype=np.int32)]), np.concatenate([value, z])

    def logit(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(self.logits([(index, value)])[0])

    def logits(self, inputs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The scores' logits of several texts; each has inputs, since the statistics always are."""
        if not inputs:
            return np.zeros(0)
        return self.bias + self.sums(*flattened(inputs))[0]

    def sums(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts whose inputs lie end to end: linear plus pairwise part, and what the gradient needs."""
        vx = self.factors[index] * value[:, None]
        whole = np.add.reduceat(vx, starts)
        pairs = 0.5 * (whole**2 - np.add.reduceat(vx**2, starts)).sum(axis=1)
        return np.add.reduceat(self.weights[index] * value, starts) + pairs, whole, vx


def raw_inputs(text: np.ndarray, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes = words.word_hashes(text)
    index, value = word_counts(hashes, WORD_BUCKETS)
    return index, value, statistics(text, hashes, n_chars)


def flattened(inputs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs of several texts end to end, and where each text begins."""
    sizes = [len(i) for i, _ in inputs]
    return np.concatenate([i for i, _ in inputs]), np.concatenate([v for _, v in inputs]).astype(np.float64), np.cumsum([0, *sizes[:-1]])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def loss_gradient(machine: Machine, inputs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Mean logistic loss of some texts, its gradient by weight and factors of each input, and by the bias."""
    index, value, starts = flattened(inputs)
    owner = np.repeat(np.arange(len(inputs)), np.diff([*starts, len(index)]))
    score, sums, vx = machine.sums(index, value, starts)
    logits = machine.bias + score
    error = (sigmoid(logits) - y) / len(inputs)
    pull = error[owner] * value
    steps = [pull, *((pull[:, None] * (sums[owner] - vx)).T)]
    grad = np.stack([np.bincount(index, weights=s, minlength=len(machine.weights)) for s in steps], axis=1)
    return float(np.logaddexp(0, np.where(y > 0, -logits, logits)).mean()), grad, float(error.sum())


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = 12, least_steps: int = 800, rate: float = 0.05, decay: float = 1e-4, seed: int = 3) -> Machine:
    """Adagrad on the logistic loss. Without both labels the score is the labels' mean."""
    size = WORD_BUCKETS + len(STATISTICS)
    rng = np.random.default_rng(seed)
    y = np.array([r[3] for r in rows], np.float64)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    dense = np.array([r[2] for r in rows]).reshape(-1, len(STATISTICS))
    mean, scale = (dense.mean(axis=0), dense.std(axis=0) + 1e-3) if len(rows) else (np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)), mean, scale)
    if len(set(y)) < 2:
        machine.factors[:] = 0
        return machine
    inputs = [machine.placed(*r[:3]) for r in rows]
    squares = np.full((size, 1 + FACTORS), 1e-3)
    bias_squares = 1e-3
    for _ in range(max(epochs, least_steps * 128 // len(rows))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            batch = order[at : at + 128]
            _, grad, bias_grad = loss_gradient(machine, [inputs[i] for i in batch], y[batch])
            grad += decay * np.concatenate([machine.weights[:, None], machine.factors], axis=1)
            squares += grad**2
            step = rate * grad / np.sqrt(squares)
            machine.weights -= step[:, 0]
            machine.factors -= step[:, 1:]
            bias_squares += bias_grad**2
            machine.bias -= rate * bias_grad / np.sqrt(bias_squares)
    return machine


def _collect_inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [raw_inputs(text, n) for text, n in zip(words.texts(batch.column("text")), batch.column("n_chars").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array([x[0].tobytes() for x in found], pa.binary()), pa.array([x[1].tobytes() for x in found], pa.binary()), pa.array([x[2].tobytes() for x in found], pa.binary())], ["label", "index", "value", "dense"]
        )


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", train_rows: int = 8000, id_col: str = "doc_id") -> Machine:
    """Learns from at most ``train_rows`` labelled rows, held-out ids excepted.

    A row's inputs are at most WORD_BUCKETS numbers however long its text is.
    """
    sample = labelled_sample(docs, labels, label_col, train_rows, id_col).select("label", "text", "n_chars")
    rows = sample.mapInArrow(_collect_inputs, "label int, index binary, value binary, dense binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["index"]), bytes(r["value"])))  # the order tasks end in doesn't matter
    return train([(np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"], np.float32), np.frombuffer(r["dense"]), r["label"]) for r in rows])


def score_quality(docs: DataFrame, machine: Machine, id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    The score is the probability of label 1, in 0 to 1. Null counts as empty;
    an empty text is scored by its statistics; rows with a null id are scored and
    are not held out; extra columns are ignored; an empty table gives an empty
    result.
    """
    rows = source(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = machine.logits([machine.inputs(text, n) for text, n in zip(words.texts(batch.column("text")), batch.column("n_chars").to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sigmoid(logits))], ["id", "score"])

    scored = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
