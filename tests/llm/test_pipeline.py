from collections import Counter

import corpus_pipeline
import odd
import pytest
from slicewise.llm.decontamination import find_leaks
from slicewise.llm.mixing import mix
from slicewise.llm.near_dedup import near_dedup
from slicewise.llm.tables import freeze, read, without_ids
from slicewise.llm.toxicity import fit_toxicity, score_toxicity
from test_near_dedup import grouped

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output."""
    docs, out = read(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        after = freeze(stage(spark, docs, SF), "stage")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(spark, stages):
    wanted = read(spark, SF, "documents").columns
    assert all(after.columns == wanted for _, after in stages[:-1])
    assert stages[-1][1].columns == [*wanted, "shard", "slot"]


def test_toxicity(spark, stages):
    before, after = stages[0]
    toxic = score_toxicity(before, fit_toxicity(before, read(spark, SF, "labels"))).where("predicted = 1")
    assert ids(after) == sorted(set(ids(before)) - set(ids(toxic)))


def test_near_duplicates(stages):
    before, after = stages[1]
    texts = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    assert ids(after) == sorted(i for i, _, component in grouped(texts) if i == component)
    assert len(set(r[2] for r in grouped([(r.doc_id, r.text) for r in after.collect()]))) == after.count()
    assert near_dedup(after).where("not kept").count() == 0


def test_decontamination(spark, stages):
    before, after = stages[2]
    leaked = set(ids(find_leaks(before, read(spark, SF, "benchmark"))))
    assert ids(after) == sorted(set(ids(before)) - leaked)
    assert find_leaks(after, read(spark, SF, "benchmark")).count() == 0


def test_mixing(stages):
    before, after = stages[3]
    assert Counter(ids(after)) == Counter({r.doc_id: r.copies for r in mix(before).collect() if r.copies})


def test_sharding(stages):
    before, after = stages[4]
    assert ids(after) == ids(before)
    sizes = Counter(r.shard for r in after.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1


def odd_tables(spark, folder, docs, labels=True):
    docs.write.parquet(f"{folder}/documents.parquet")
    rows = [(i, i % 2, i % 2) for i in range(1, 18)] + [(1, None, None), (None, 1, 1)]
    spark.createDataFrame(rows if labels else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, odd.prose(1, 120)), (2, None), (3, ""), (None, odd.prose(7, 40))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_documents(spark, tmp_path):
    """Null and shared ids, null and empty texts, repeated rows and clashing columns go through every stage, row by row."""
    sf_dir = odd_tables(spark, tmp_path / "odd", odd.docs(spark), labels=False)
    docs = read(spark, sf_dir, "documents")
    stage = dict(corpus_pipeline.STAGES)
    assert Counter(map(str, stage["toxicity"](spark, docs, sf_dir).collect())) == Counter(map(str, docs.collect()))  # no labels: nothing is known to be toxic
    kept = stage["near_dedup"](spark, docs, sf_dir).collect()
    sets = [grouped([(0, r.text)])[0][1] for r in kept]
    assert sum(n == 0 for n in sets) == 3 and len(kept) < docs.count()  # texts without words all stay
    # of each group, of repeated rows and of rows with a null id one row stays: none that is left is linked with another
    assert len({r[2] for r in grouped([(i, r.text) for i, r in enumerate(kept)])}) == len(kept)
    assert {r.doc_id for r in kept} >= {1, 5, 6, 7, 8, 16, -3, None}
    clean = stage["decontamination"](spark, docs, sf_dir).collect()
    leaked = {odd.prose(7, 40), odd.rows()[0][1], odd.rows()[2][1], odd.rows()[3][1], odd.rows()[12][1]}
    assert {r.text for r in docs.collect()} - {r.text for r in clean} == leaked  # also where the id is null or shared
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert out.count() > 0


def test_rows_that_share_an_id_are_told_apart(spark, tmp_path):
    long = [odd.prose(i, 60) for i in range(4)]
    rows = [(1, long[0]), (1, long[1]), (None, long[1]), (None, long[2]), (2, long[0]), (2, odd.prose(1, 120)), (3, long[3]), (3, long[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sf_dir = odd_tables(spark, tmp_path / "shared", docs)
    docs = read(spark, sf_dir, "documents")
    got = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, long[0]), (1, long[1]), (None, long[2]), (2, odd.prose(1, 120)), (3, long[3])], key=str)
    got = corpus_pipeline.decontamination(spark, docs, sf_dir).collect()
    assert Counter(map(tuple, got)) == Counter(r for r in rows if r[1] != odd.prose(1, 120))


@pytest.mark.parametrize("labels", [True, False])
def test_empty_tables(spark, tmp_path, labels):
    out = corpus_pipeline.run(spark, odd_tables(spark, tmp_path / "none", odd.empty(spark), labels))
    assert out.count() == 0 and out.columns[-2:] == ["shard", "slot"]


def test_without_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (1, "d")], "doc_id long, text string")
    gone = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    assert sorted(r.text for r in without_ids(docs, gone).collect()) == ["b", "c"]
