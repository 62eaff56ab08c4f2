import hashlib
import random
import re
from collections import Counter

import numpy as np
import odd
import pytest
from slicewise.llm import substrings
from slicewise.llm.substrings import anchors, remove_shared_passages


def brute(texts, width=35):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts]
    times = Counter(tuple(w[s : s + width]) for _, w in split for s in range(len(w) - width + 1))
    out = []
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - width + 1):
            if times[tuple(w[s : s + width])] > 1:
                gone[s : s + width] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_odd_documents(spark):
    out = remove_shared_passages(odd.docs(spark))
    assert rows(out) == brute([(r[0], r[1]) for r in odd.rows()])
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in out.collect())


def passages(seed: int, n: int) -> list[tuple]:
    """Passages of 33 to 80 words in many documents, in different surroundings, cut by edits, overlapping, within one document."""
    rng = random.Random(seed)
    shared = [odd.prose(1000 * seed + k, rng.choice([33, 34, 35, 36, 50, 80])).split() for k in range(8)]
    texts = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(1, 4)):
            part = list(rng.choice(shared))
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "edited"
            cut = rng.choice([0, 0, 1, 5])
            words += odd.prose(rng.randrange(10**6), rng.choice([0, 1, 7, 20])).split() + part[cut:]
        texts.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    return texts + [(n, "a " * 90), (n + 1, "a " * 34), (n + 2, "b " * 35), (n + 3, "x y " * 40), (n + 4, " ".join(shared[0] * 2))]


@pytest.mark.parametrize("piece", [substrings.PIECE, 41])
def test_passages_of_every_kind(spark, monkeypatch, piece):
    monkeypatch.setattr(substrings, "PIECE", piece)
    texts = passages(piece % 97, 70)
    texts += texts[:6] + [(900, texts[0][1]), (901, texts[0][1].replace(" ", "\n")), (None, texts[3][1]), (902, texts[4][1].upper())]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # equal windows meet in a batch and beyond it
    try:
        assert rows(remove_shared_passages(df)) == brute(texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ids_of_their_own_need_no_copy(spark, monkeypatch):
    labels, real = [], substrings.freeze
    monkeypatch.setattr(substrings, "freeze", lambda df, label: (labels.append(label), real(df, label))[1])
    texts = passages(3, 12)
    assert rows(remove_shared_passages(spark.createDataFrame(texts, "doc_id int, text string"))) == brute(texts)
    assert "passages_rows" not in labels
    named = [(f"d{i}", t) for i, t in texts]
    assert rows(remove_shared_passages(spark.createDataFrame(named, "doc_id string, text string"))) == brute(named)
    assert "passages_rows" in labels


def test_every_window_has_the_anchor_of_its_words():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 40, 400).astype(np.uint64)
    place, _, first = anchors(hashes)
    end = np.append(first[1:], len(hashes) - 34)
    own = np.repeat(place, end - first)
    assert len(own) == len(hashes) - 34 and first[0] == 0
    alone = [int(anchors(hashes[s : s + 35])[0][0]) + s for s in range(len(own))]
    assert own.tolist() == alone
    assert len(anchors(hashes[:34])[0]) == 0


def test_empty(spark):
    out = remove_shared_passages(odd.empty(spark))
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"] and out.count() == 0
