import re

import numpy as np
import odd
from slicewise.llm import words
from slicewise.llm.components import components
from slicewise.llm.near_dedup import near_dedup, signature


def shingles(text):
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else {tuple(found)} if found else set()


def grouped(texts, threshold=75):
    sets = [shingles(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= threshold * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(texts)), key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_odd_documents(spark):
    out = near_dedup(odd.docs(spark)).cache()
    assert rows(out) == grouped([(r[0], r[1]) for r in odd.rows()])
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_copies_around_the_threshold(spark):
    """Copies with edits of their own, linked to the text they came from, to each other, or to nothing."""
    texts = [(i, odd.edited(odd.prose(i // 40, 150), i, (i % 40) / 250)) for i in range(160)]
    texts += [(200 + i, odd.edited(odd.prose(0, 150), 500 + i, 0.03)) for i in range(10)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert rows(near_dedup(df)) == grouped(texts)


def test_empty(spark):
    assert near_dedup(odd.empty(spark)).count() == 0


def test_components(spark):
    edges = [(9, 4), (4, 9), (4, 2), (7, 7), (5, 6), (6, 8), (8, 11), (11, 13)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {2: 2, 4: 2, 9: 2, 5: 5, 6: 5, 8: 5, 11: 5, 13: 5}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(0)
    both, own = words.mix(rng.integers(0, 2**62, 600).astype(np.uint64)), words.mix(rng.integers(0, 2**62, 400).astype(np.uint64))
    a, b = np.concatenate([both, own[:200]]), np.concatenate([both, own[200:]])
    assert abs((signature(a) == signature(b)).mean() - 0.6) < 0.12
    assert (signature(a) == signature(a[::-1])).all()


def test_word_hashes_by_piece(monkeypatch):
    text = np.frombuffer(odd.prose(3, 3000).encode(), np.uint8)
    whole = words.word_hashes(text)
    monkeypatch.setattr(words, "PIECE", 64)
    assert (words.word_hashes(text) == whole).all() and len(whole) == 3000
    long = np.frombuffer(b"a" * 1000 + b" b", np.uint8)
    assert len(words.word_hashes(long)) == 2


def test_a_worker_that_begins_with_an_empty_text(monkeypatch):
    monkeypatch.setattr(words, "_powers", {})
    assert len(words.word_hashes(np.zeros(0, np.uint8))) == 0
    assert [len(p) for p in words.powers(0)] == [0, 0] and [len(p) for p in words.powers(5)] == [5, 5]
