import hashlib
from collections import Counter

import numpy as np
import odd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from slicewise.llm import suffix_dedup
from slicewise.llm.suffix_dedup import RunWriter, Suffixes, anchors, block_rows, merge_runs, merge_spans, padded, read_block, remove_repeats, rows_of


def brute(texts):
    seen, out = set(), []
    for i, t in texts:
        b = (t or "").encode()
        covered = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                covered[s : s + 100] = True
            else:
                seen.add(b[s : s + 100])
        left = bytes(np.frombuffer(b, np.uint8)[~covered])
        spans = int((np.diff(np.concatenate(([0], covered.astype(int)))) == 1).sum())
        out.append((i, len(b), int(covered.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_odd_documents(spark):
    out = remove_repeats(odd.docs(spark)).cache()
    texts = sorted(((r[0], r[1]) for r in odd.rows()), key=lambda x: -(10**9) if x[0] is None else x[0])
    assert rows(out) == brute(texts)
    for r in out.collect():
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_repeats_of_every_kind(spark, monkeypatch):
    """Passages that overlap, repeat within a document, are cut by edits or are all one letter."""
    passages = [odd.prose(i, 40) for i in range(4)]
    texts = [(i, odd.prose(100 + i, 15) + passages[i % 4] + odd.prose(200 + i, 10) + passages[(i + 1) % 4][: 60 + 11 * i]) for i in range(16)]
    texts += [(20, "a" * 450), (21, "a" * 99), (22, passages[0][5:] + passages[0][5:]), (23, odd.edited(passages[1] * 3, 1, 0.08)), (24, passages[2][:99]), (25, passages[2][:100]), (26, "ab" * 200), (27, odd.prose(100, 15))]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert rows(remove_repeats(df)) == brute(texts)


@pytest.mark.parametrize("sizes", [{"CHUNK": 7, "BLOCK": 3}, {"CHUNK": 50, "BLOCK": 5, "SAMPLES": 2}, {"CHUNK": 30, "BLOCK": 4, "FAN_IN": 2}])
def test_starts_that_very_many_have(spark, monkeypatch, sizes):
    """A passage and lines of 60 to 99 bytes in every document: starts cut by splitters and by chunks, and merges of groups of runs."""
    for name, value in sizes.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    passage, lines = odd.prose(1, 30), [odd.prose(2 + n, 30)[:n] for n in (60, 80, 99)]
    texts = [(i, "".join(odd.prose(100 * i + k, 6) + x for k, x in enumerate([passage, *lines])) + ("" if i % 3 else odd.prose(7, 20))) for i in range(60)]
    texts += [(70, passage + lines[2] + passage), (71, lines[1] + lines[1]), (72, "a" * 300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    found = []
    real = suffix_dedup.splitters_of
    monkeypatch.setattr(suffix_dedup, "splitters_of", lambda *x: (found.append(real(*x)), found[-1])[1])
    try:
        assert rows(remove_repeats(df, tasks=9)) == brute(texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found[0]) == 8


def test_a_passage_of_all_documents(spark, monkeypatch):
    """What the runs settle of a common passage goes past the merge; its rows are bounded and evenly dealt, and so are block rows."""
    monkeypatch.setattr(suffix_dedup, "SETTLED", 64)
    passage, real, largest = odd.prose(1, 60), suffix_dedup.sorted_runs, {}
    for n in (100, 400):
        made = []
        monkeypatch.setattr(suffix_dedup, "sorted_runs", lambda *x, made=made: (made.append(real(*x)), made[-1])[1])
        texts = [(i, odd.prose(1000 + i, 2) + passage + odd.prose(5000 + i, 2)) for i in range(n)]
        df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
        assert rows(remove_repeats(df, tasks=4)) == brute(texts)
        sizes = made[0].selectExpr("part", "done IS NOT NULL AS settled", "length(doc) + length(tails) + length(lefts) AS block", "length(done) AS done").collect()
        ranges = max(r.part for r in sizes if not r.settled) + 1
        settled = Counter()
        for r in sizes:
            assert r.settled == (r.part >= ranges) and (not r.settled or r.done <= 64 * 24)
            if r.settled:
                settled[r.part] += r.done
        assert len(settled) == ranges and max(settled.values()) < 2 * sum(settled.values()) / ranges
        assert max(r.block or 0 for r in sizes) <= suffix_dedup.BLOCK * (100 + 68 + 8)  # a suffix, what is to its left, its document
        largest[n] = sum(settled.values())
    assert largest[400] > 3 * largest[100]


def test_fewer_samples_than_ranges(spark, monkeypatch):
    """Each entry of a small sample cuts; nothing collapses into one range."""
    made, real = [], suffix_dedup.splitters_of
    monkeypatch.setattr(suffix_dedup, "splitters_of", lambda *x: (made.append(real(*x)), made[-1])[1])
    texts = [(i, odd.prose(i, 5) + odd.prose(77, 30)) for i in range(5)]
    assert rows(remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), tasks=64)) == brute(texts)
    assert 1 < len(made[0]) < 63

def test_as_many_ranges_at_any_size(spark, monkeypatch):
    """The number of runs and ranges follows the cluster, and runs get longer with the input."""
    length = {}
    real = suffix_dedup.sorted_runs
    for n in (40, 160):
        texts = [(i, odd.prose(i // 2, 60) + odd.prose(1000 + i, 9)) for i in range(n)]
        made = []
        monkeypatch.setattr(suffix_dedup, "sorted_runs", lambda *x, made=made: (made.append(real(*x)), made[-1])[1])
        df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
        assert rows(remove_repeats(df)) == brute(texts)
        blocks = made[0].where("done IS NULL").select("part", "run", F.length("length").alias("n")).collect()
        runs = Counter()
        for b in blocks:
            runs[b.part, b.run] += b.n
        assert len({b.run for b in blocks}) <= 16 and len({b.part for b in blocks}) == 16
        length[n] = sum(runs.values()) / len(runs)
    assert length[160] > 2 * length[40]


def test_shared_ids(spark):
    """Rows that share an id are ordered by their texts' hash; of rows repeated in full one stays."""
    passage = odd.prose(1, 40)
    pairs = [(i % 4, odd.prose(50 + i, 9) + passage) for i in range(12)] + [(2, passage), (2, passage), (9, passage)]
    pairs.sort(key=lambda x: (x[0], hashlib.sha256(x[1].encode()).digest()))
    assert rows(remove_repeats(spark.createDataFrame(pairs, "doc_id long, text string").repartition(5))) == brute(pairs)


def test_empty(spark):
    assert remove_repeats(odd.empty(spark)).count() == 0


def coded(runs: list[list[bytes]], width: int = 12) -> list:
    """Blocks of each run, in the order in which a merge asks for them."""
    out = []
    for number, run in enumerate(runs):
        suffixes, writer = sorted(run), RunWriter(number)
        if not suffixes:
            continue
        length = np.array([len(s) for s in suffixes])
        shared = np.array([0] + [shared_bytes(a, b) for a, b in zip(suffixes, suffixes[1:])])
        none, place = np.zeros((len(suffixes), 0), np.uint8), np.arange(len(suffixes))
        some = Suffixes(shared, padded(np.frombuffer(b"".join(suffixes), np.uint8), length, width), length, none, np.zeros(len(suffixes), int), place + 100 * number, place)
        out += [*writer.put(0, some), *writer.flush()]
    out.sort(key=lambda r: (r["forecast"] is not None, r["forecast"] or b"", r["place_in_run"]))
    return [read_block(row, 32) for _, rows in rows_of([block_rows(out)]) for row in rows]


def shared_bytes(a: bytes, b: bytes) -> int:
    return next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=1, max_size=12).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=12), max_size=7), st.integers(1, 5))
def test_loser_tree(runs, block):
    """The merge gives all suffixes in order, with what neighbours share and where they are from."""
    before, suffix_dedup.BLOCK = suffix_dedup.BLOCK, block
    try:
        got = list(merge_runs(iter(coded(runs))))
    finally:
        suffix_dedup.BLOCK = before
    assert [s for *_, s in got] == sorted(s for run in runs for s in run)
    assert all(h == shared_bytes(a, b) for (*_, a), (_, _, h, b) in zip(got, got[1:]))
    assert all(sorted(runs[b.doc[i] // 100])[b.doc[i] % 100] == s for b, i, _, s in got)


def test_anchors_depend_on_the_window_alone(monkeypatch):
    a, b, same = (odd.prose(i, 60).encode() for i in (1, 2, 3))
    found = []
    for text in (a + same, b + same):
        place, _ = anchors(np.frombuffer(text, np.uint8))
        start = len(text) - len(same)
        found.append([p - start for p in place if p >= start + 69])
        monkeypatch.setattr(suffix_dedup, "PIECE", 37)  # and not on how the text is cut up
        assert anchors(np.frombuffer(text, np.uint8))[0].tolist() == place.tolist()
        monkeypatch.undo()
    assert found[0] == found[1] and found[0]
    assert len(anchors(np.frombuffer(b"x" * 99, np.uint8))[0]) == 0


def test_merge_spans():
    assert merge_spans(np.array([5, 0, 2, 20]), np.array([9, 3, 5, 21])) == [(0, 9), (20, 21)]
