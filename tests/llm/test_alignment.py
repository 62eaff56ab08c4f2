import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import odd
import pytest
from slicewise.llm import alignment
from slicewise.llm.alignment import FOLDER, align, byte_of_character, tokenizers, units_of


def whole(text):
    """(A ids and ends, B ids and ends) of a text encoded in one go, or None."""
    encode_a, bytes_a, encode_b, bytes_b = tokenizers(FOLDER)
    if not text:
        return None
    out = []
    for ids, vocabulary in ((encode_a([" " + text])[0], bytes_a), (encode_b([text])[0], bytes_b)):
        tokens = [bytes(vocabulary.joined(np.array([i]))) for i in ids]
        if b"".join(tokens) != (" " + text).encode():
            return None
        out.append(list(zip(ids, np.cumsum([len(t) for t in tokens]).tolist())))
    return out


def brute(texts):
    links, head = [], []
    for i, text in texts:
        both = whole(text)
        if not both:
            links.append([])
            head.append((i, 0, 0, 0, ""))
            continue
        a, b = both
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(t) for t, e in side if low < e <= cut) for side in (a, b)))
            low = cut
        by_end = defaultdict(list)
        for t, e in b:
            by_end[e].append(t)
        links.append([(t, u) for t, e in a for u in by_end[e]])
        head.append((i, len(a), len(b), len(cuts), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    n = Counter(x for own in links for x in own)
    most = Counter()
    for (_, b), c in n.items():
        most[b] = max(most[b], c)
    return sorted(((*h[:4], len(own), sum(n[x] == most[x[1]] for x in own), sum(n[x] for x in own), h[4]) for h, own in zip(head, links)), key=str), n


def rows(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


def strange(seed: int, n: int) -> list[tuple]:
    """Texts with every kind of space, special tokens' strings, combining marks, digits, long words and other scripts."""
    rng = random.Random(seed)
    parts = ["the", "The", " ", "  ", "\n", " \n", "\t", "don't", "'s", " 's", "1234", "ﬁne", "é", "é", "漢字", "😀👩‍👩‍👧", "<|endoftext|>", "</s>", "<0x41>", "<unk>", "\x00", "\xa0", "　", "\x1c", "\x85", "​", "...", "!!", "anti" * 9, "🏳️‍🌈", "Ω", "\r\n", "_", "a", "house "]
    return [(i, "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 30)))) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"HOT_PAIRS": 40, "UNITS": 50, "PIECE": 300, "PAIRS": 30}, {"HOT_PAIRS": 0}])
def test_against_texts_encoded_whole(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(alignment, name, value)
    texts = strange(len(sizes), 150) + [(500 + i, odd.prose(i, 30) + ("▁" if i % 5 == 0 else "")) for i in range(20)]
    docs, pairs = align(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), keep_groups=True)
    want, n = brute(texts)
    assert rows(docs) == want
    assert {(r.a, r.b): r.n for r in pairs.collect()} == n
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 if r.groups else not r.groups_sha256 for r in docs.collect())
    assert sum(r[1] == 0 for r in want) >= 4


def test_odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, null and shared ids, clashing columns."""
    docs, _ = align(odd.docs(spark))
    assert rows(docs) == brute([(r[0], r[1]) for r in odd.rows()])[0]


def test_units_are_whole():
    assert units_of("a b  c d ") == ["a", "b  c", "d "]
    assert units_of(" a\n b") == [" a\n b"]
    assert len(byte_of_character()) == 256 and sorted(byte_of_character().values()) == list(range(256))


def test_empty(spark):
    docs, pairs = align(odd.empty(spark))
    assert docs.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    assert docs.count() == 0 and pairs.count() == 0
