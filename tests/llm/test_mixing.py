import re

import odd
import pytest
from slicewise.llm import mixing
from slicewise.llm.mixing import mix, mixed_rows


def filled(sizes, weights, share, most):
    """Targets by clamping and dealing the excess again, one round after the other."""
    wanted = min(share * sum(sizes.values()), sum(most * sizes[s] for s in sizes if weights[s] > 0))
    free, target = {s for s in sizes if weights[s] > 0}, dict.fromkeys(sizes, 0.0)
    while free:
        rest = wanted - sum(target[s] for s in sizes if s not in free)
        level = rest / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level >= most * sizes[s]}
        for s in over or free:
            target[s] = most * sizes[s] if over else weights[s] * level
        free -= over or free
    return target


def test_targets_and_words(spark):
    got = mix(odd.docs(spark)).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((x[0], words(x[1])) for x in odd.rows()), key=str)
    sizes = {}
    for x in odd.rows():
        sizes[x[3]] = sizes.get(x[3], 0) + words(x[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size <= 2 * r.size
    assert sorted(map(str, mix(odd.docs(spark, 5)).collect())) == sorted(map(str, got))  # whatever the partitions


def test_words_near_target(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('s', id % 4) AS source", "repeat('word ', int(20 + pmod(hash(id), 300))) AS text")
    out = mix(docs, weights=(3, 1, 2)).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in out:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 400


@pytest.mark.parametrize("docs_in_bucket,level_bits", [(10**6, 16), (50, 16), (3, 2), (1, 1)])
def test_the_sample_is_the_first_by_luck(spark, monkeypatch, docs_in_bucket, level_bits):
    """However many levels find its end, the sample is what comes first in the order of the seeded hash."""
    monkeypatch.setattr(mixing, "BUCKET_DOCS", docs_in_bucket)
    monkeypatch.setattr(mixing, "LEVEL_BITS", level_bits)
    docs = spark.range(900).selectExpr("id AS doc_id", "if(id % 3 = 0, null, concat('s', id % 2)) AS source", "repeat('word ', int(pmod(hash(id), 30))) AS text")
    placed = mixing._placed(mixing._sized(docs.withColumnRenamed("doc_id", "id"), False).selectExpr("*", "cast(null as long) AS mix_number"), 11).collect()
    got = {r.doc_id: r for r in mix(docs, weights=(3, 1, 2), share=0.9).collect()}
    for source in ("s0", "s1", None):
        own = sorted((r for r in placed if r.mix_source == source), key=lambda r: (r.mix_luck, r.mix_id))
        target, size = got[own[0].mix_id].target, sum(r.mix_size for r in own)
        whole, at = int(target / size + 1e-12), 0
        for r in own:
            at += r.mix_size
            assert got[r.mix_id].copies == whole + (at - r.mix_size / 2 < target - whole * size)


@pytest.mark.parametrize("rows", ["no ids and one text", "one id and texts of one size"])
def test_rows_that_share_an_id_meet_the_target(spark, rows):
    """Rows that nothing but their place tells apart are taken one by one, not all or none."""
    kinds = {"no ids and one text": ("cast(null as long)", "'one two three four five'"), "one id and texts of one size": ("7", "concat('one two three four ', id)")}
    number, text = kinds[rows]
    docs = spark.range(0, 3000, 1, 7).selectExpr(f"{number} AS doc_id", "concat('s', id % 3) AS source", f"{text} AS text", "id AS n")
    got = mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 5
    out = mixed_rows(docs)
    assert out.columns == docs.columns and {r.source: r["count"] * 5 for r in out.groupBy("source").count().collect()} == {r.source: r["sum(taken)"] for r in got}
    assert out.groupBy("n").count().agg({"count": "max"}).first()[0] <= 2
    again = sorted(map(str, mix(docs.repartition(3)).collect()))
    assert again == sorted(map(str, mix(docs).collect()))


def test_weights_in_turn(spark):
    """In code point order, whatever partitions hold the sources."""
    names = [f"s{i}" for i in range(500)] + ["", "ß", "Z", "漢", "\U0001F600", "\uffee", None]
    frame = spark.createDataFrame([(n,) for n in names], "source string").repartition(9)
    order = sorted(names, key=lambda s: (s is None, s or ""))
    got = {r.source: r.weight for r in mixing.repeating_weights(frame, (3, 1, 2)).collect()}
    assert got == {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}


def test_given_weights_and_rows(spark):
    weights = spark.createDataFrame([("s1", 1.0), (None, 2.0)], "source string, weight double")
    docs = odd.docs(spark)
    copies = {}
    for r in mix(docs, weights, share=0.7).collect():
        copies[r.doc_id, r.source] = copies.get((r.doc_id, r.source), 0) + r.copies
        assert r.source in ("s1", None) or r.taken == 0
    out = mixed_rows(docs, weights, share=0.7)
    assert out.columns == docs.columns
    assert {k: n for k, n in copies.items() if n} == {(r.doc_id, r.source): r["count"] for r in out.groupBy("doc_id", "source").count().collect()}


def test_empty(spark):
    assert mix(odd.empty(spark)).count() == 0 and mixed_rows(odd.empty(spark)).count() == 0
