import random
from collections import Counter

import numpy as np
import odd
from slicewise.llm import decontamination
from slicewise.llm.decontamination import Index, Item, find_leaks, least_share, overlap, split_item
from slicewise.llm.licenses import tokens
from slicewise.llm.tables import read

SF = "/root/testdata/sf0.01"


def index_of(texts, threshold=0.6):
    items = [Item(i, *split_item(t.encode())) for i, t in texts]
    held = Counter(w for x in items for w in set(x.words))
    sizes = [len(x.words) for x in items]
    return Index(items, held, len(items), sum(sizes) / len(sizes), max(sizes), threshold)


def test_search_finds_all_above_threshold():
    rng = random.Random(4)
    index = index_of([(i, odd.prose(i, rng.randrange(8, 60))) for i in range(120)], 0.35)
    for seed in range(80):
        found = tokens((odd.prose(1000 + seed, 60) + " " + (odd.prose(seed, 60) if seed % 2 else "")).encode())
        ids = np.array([index.terms.get(w, -1) for w in found])
        live = index.live(ids)
        for k in range(index.passages(len(found))):
            end = len(found) if k == index.passages(len(found)) - 1 else (k + 2) * index.stride
            terms = sorted(set(ids[k * index.stride : end].tolist()) - {-1})
            scores = Counter()
            for t in terms:
                for o, x in zip(index.ordinals[t], index.impacts[t]):
                    scores[o] += x
            want = {o for o, x in scores.items() if x >= 0.35 - 1e-9}
            assert {o for o, _ in index.search(terms)} == want
            assert {o for o, _ in index.search(terms, live.get(k, set()))} == want
            # the blocks looked at are those whose maxima reach the threshold, by all blocks' sums
            reach = Counter()
            for t in terms:
                reach.update(index.block_max[t])
            assert {b for b, x in reach.items() if x >= 0.35} <= live.get(k, set()) <= {b for b, x in reach.items() if x >= 0.35 - 2e-4}


def leaks(docs, items, least=0.75, threshold=0.6):
    """Pairs of which a passage scores enough and the text holds enough of the item's shingles."""
    out = set()
    index = index_of([(j, u or "") for j, u in items], threshold)
    for i, t in docs:
        found = tokens((t or "").encode())
        ids = [index.terms.get(w, -1) for w in found]
        for k in range(index.passages(len(found))):
            end = len(found) if k == index.passages(len(found)) - 1 else (k + 2) * index.stride
            scores = Counter()
            for x in set(ids[k * index.stride : end]) - {-1}:
                scores.update(dict(zip(index.ordinals[x], index.impacts[x])))
            for o, score in scores.items():
                item = index.items[o]
                long = 2 * len(item.question) >= len(item.words)
                if score >= threshold - 1e-9 and max(overlap(item.question, found) if long else 0, overlap(item.words, found)) >= least:
                    out.add((i, item.item_id))
    return out


def test_against_brute_force(spark):
    docs, items = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    want = leaks(docs.select("doc_id", "text").collect(), items.collect())
    assert len(want) > 20
    for words in (2_000_000, 300):  # one part of the index, and several
        got = find_leaks(docs, items, part_words=words).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert all(0.6 <= r.score <= 1 + 1e-9 for r in got)


def test_long_items_leave_short_ones_alone(spark, monkeypatch):
    """An item of many thousand words has an index of its own; all are found as by brute force, in one pass or several."""
    items = [(i, odd.prose(i, 20 + i)) for i in range(30)] + [(100, odd.prose(100, 9000)), (101, odd.prose(101, 300))]
    docs = [(i, odd.prose(500 + i, 200) + " " + odd.prose(i, 20 + i) + " " + odd.prose(600 + i, 100)) for i in range(0, 30, 3)]
    docs += [(200, odd.prose(7, 40) + " " + odd.prose(100, 9000)), (201, odd.prose(101, 300)[:1200]), (202, odd.prose(101, 300) + " x " * 50), (203, odd.prose(900, 3000))]
    want = set()
    for i, t in docs:
        for j, u in items:
            question, answer = split_item(u.encode())
            asked = overlap(question, tokens(t.encode())) if 2 * len(question) >= len(question + answer) else 0
            if max(asked, overlap(question + answer, tokens(t.encode()))) >= 0.75:
                want.add((i, j))
    frames = [spark.createDataFrame(x, f"{name} long, text string") for name, x in (("doc_id", docs), ("item_id", items))]
    alive = []
    real = decontamination._index_parts
    monkeypatch.setattr(decontamination, "_index_parts", lambda *x: (alive.append([i.stride for i in indexes]) or indexes for indexes in real(*x)))
    for part_words, passes in ((2_000_000, 1), (9000, 2), (500, 5)):
        alive.clear()
        got = {(r.doc_id, r.item_id) for r in find_leaks(*frames, part_words=part_words).collect()}
        assert got == want and len(want) == 13
        assert len(alive) == passes and {s for strides in alive for s in strides} == {49, 300, 9000}


def test_odd_documents(spark):
    passage = odd.prose(40, 50)
    rows = odd.rows() + [(50, odd.prose(41, 300) + "\n" + passage.upper() + "! " + odd.prose(42, 20), *odd.rows()[0][2:])] * 2
    docs = spark.createDataFrame(rows, odd.SCHEMA)
    items = spark.createDataFrame([(1, passage, 0), (2, None, 0), (3, "", 0), (None, odd.prose(9, 30), 0), (4, "one two three", 0)], "item_id int, text string, id int")
    got = sorted((str(r.doc_id), str(r.item_id)) for r in find_leaks(docs, items).collect())
    assert got == sorted([("50", "1"), ("50", "1"), ("-3", "None"), ("8", "4"), ("9", "4"), ("10", "4")])
    assert find_leaks(odd.empty(spark), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0


def test_split_item():
    assert split_item(b"What is it? A thing.") == ([b"what", b"is", b"it"], [b"a", b"thing"])
    assert split_item(b"a b c d e f g h") == ([b"a", b"b", b"c", b"d", b"e", b"f"], [b"g", b"h"])
    assert split_item(b"") == ([], [])


def test_questions_alone(spark):
    """Each verbatim question counts without its answer unless it says too little, as does the part of it that verification accepts."""
    items = [r for r in read(spark, SF, "benchmark").collect()]
    split = {r.item_id: split_item(r.text.encode()) for r in items}
    said = {i: b" ".join(q).decode() for i, (q, _) in split.items()}
    filler = " ".join(f"zz{i}" for i in range(100))
    docs = [(i, f"{filler} {q} {filler}") for i, q in said.items()]
    for i, (q, _) in split.items():  # the last or first words are gone, as many as verification allows
        most = next(k for k in range(len(q), -1, -1) if overlap(q, q[: len(q) - k]) >= 0.75)
        docs += [(1000 + i, f"{filler} {b' '.join(q[: len(q) - most]).decode()} {filler}"), (2000 + i, f"{filler} {b' '.join(q[most:]).decode()} {filler}")]
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items)).collect()}
    told = {i for i, (q, a) in split.items() if 2 * len(q) >= len(q + a) or len(q) >= 5}
    assert len(told) >= 35 and sum(2 * len(q) < len(q + a) for i, (q, a) in split.items() if i in told) >= 5
    for base in (0, 1000, 2000):
        assert {(base + i, i) for i in told} <= got
    assert not {(i, i) for i in set(split) - told} & got


def test_verification_alone_decides(spark):
    docs, items = read(spark, SF, "documents").collect(), read(spark, SF, "benchmark").collect()
    index = index_of([(r.item_id, r.text or "") for r in items])
    want = set()
    for r in docs:
        found = tokens((r.text or "").encode())
        held = {tuple(found[i : i + 5]) for i in range(len(found) - 4)}
        for o, item in enumerate(index.items):
            shingles = {tuple(item.words[i : i + 5]) for i in range(len(item.words) - 4)}
            if len(item.words) < 5 and overlap(item.words, found) >= 0.75 or shingles and len(shingles & held) / len(shingles) >= 0.75:
                want.add((r.doc_id, item.item_id))
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs), spark.createDataFrame(items)).collect()}
    assert got == want


def test_least_share_is_a_bound(monkeypatch):
    rng = random.Random(8)
    for _ in range(150):
        found = [rng.choice("abcdefghijklmn"[: rng.randrange(1, 15)]).encode() for _ in range(rng.randrange(1, 13))]
        impacts = {w: rng.random() ** 3 + 1e-3 for w in found}
        bound = least_share(found, impacts, 0.75)
        exact = 1.0
        for mask in range(1 << len(impacts)):
            gone = {w for k, w in enumerate(impacts) if mask >> k & 1}
            if overlap(found, [b"" if w in gone else w for w in found]) >= 0.75:
                exact = min(exact, 1 - sum(impacts[w] for w in gone) / sum(impacts.values()))
        assert bound <= exact + 1e-9
        if len(impacts) == len(found):
            assert bound >= exact - 1e-9
        with monkeypatch.context() as m:
            m.setattr(decontamination, "SHARE_WORK", -1)
            assert least_share(found, impacts, 0.75) <= bound + 1e-9
