import hashlib
from collections import Counter

import odd
import pytest
from slicewise.llm import exact_dedup as exact_dedup_module
from slicewise.llm.exact_dedup import exact_dedup


@pytest.mark.parametrize("options", [{}, {"filter_mb": 0, "bits_per_text": 32768}])  # the second cuts the filter into a slice for each block
def test_against_a_dictionary(spark, options):
    got = exact_dedup(odd.docs(spark), **options).collect()
    texts = [(r[0], r[1] or "") for r in odd.rows()]
    size = Counter(t for _, t in texts)
    keep = {t: max((i for i, u in texts if u == t and i is not None), default=None) for t in size}
    want = sorted(((i, keep[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in texts), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == len(size)  # one row of each text, also of rows repeated in full
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_one_filter_at_a_time(spark, monkeypatch):
    """Each slice's filter is gone before the next one is built, and none is in the result's plan."""
    events, real = [], exact_dedup_module.freeze_parts

    def watched(parts, label):
        def told():
            for part in parts:
                plan = part._jdf.queryExecution().executedPlan().toString()
                events.append(plan.count("BroadcastExchange"))
                yield part

        return real(told(), label)

    monkeypatch.setattr(exact_dedup_module, "freeze_parts", watched)
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id % 2900) AS text")
    out = exact_dedup(docs, filter_mb=0, bits_per_text=64)
    assert len(events) == 6 and set(events) == {1}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "filter_block" not in plan and "words" not in plan
    assert out.where("not kept").count() == 100


def test_as_many_files_with_many_slices(spark, monkeypatch):
    """The narrow table has a file for each task, and what was probed as many as its rows ask for, whatever the number of slices."""
    found, real, real_parts = {}, exact_dedup_module.freeze, exact_dedup_module.freeze_parts

    def counted(df, label, of):
        found.setdefault(of, {}).setdefault(label, 0)
        found[of][label] += len(df.inputFiles())
        return df

    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id % 19000) AS text").repartition(16)
    for of, options in (("one", {}), ("many", {"filter_mb": 0, "bits_per_text": 50})):
        monkeypatch.setattr(exact_dedup_module, "freeze", lambda df, label, of=of: counted(real(df, label), label, of))
        monkeypatch.setattr(exact_dedup_module, "freeze_parts", lambda parts, label, of=of: counted(real_parts(parts, label), label, of))
        assert exact_dedup(docs, **options).where("not kept").count() == 1000
    assert found["many"]["exact_dedup"] == found["one"]["exact_dedup"] == 16
    assert found["many"]["exact_dedup_probed"] <= 31 + 20_000 / exact_dedup_module.FILE_ROWS
    assert found["many"]["exact_dedup_filter"] <= 31 * 4


@pytest.mark.parametrize("rows", [1 << 20, 300])
def test_filter_against_all_places(rows, monkeypatch):
    """Places from many tasks, merged in two levels, are those that occur twice."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    rng = np.random.default_rng(rows)
    monkeypatch.setattr(exact_dedup_module, "BUILD_ROWS", rows)
    block, bits = rng.integers(0, 3, 3000), rng.integers(-(1 << 62), 1 << 62, 3000)
    bits[2000:2500] = bits[:500]
    block[2000:2500] = block[:500]
    monkeypatch.setattr(exact_dedup_module.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    parts = [exact_dedup_module._build(iter([pa.record_batch({"block": block[i : i + 250], "bits": bits[i : i + 250]})])) for i in range(0, 3000, 250)]
    sent = pd.concat([b.to_pandas() for part in parts for b in part])
    merged = pd.concat([exact_dedup_module._merge(g) for _, g in sent.groupby(["block", sent.index % 4])])
    for b, group in merged.groupby("block"):
        places = np.concatenate(exact_dedup_module._places(bits[block == b].view(np.uint64)))
        want = np.unique(places, return_counts=True)
        plane = np.unpackbits(exact_dedup_module._filter(group)["words"].iloc[0].view(np.uint8), bitorder="little")
        assert np.flatnonzero(plane).tolist() == want[0][want[1] > 1].tolist()


def test_empty(spark):
    out = exact_dedup(odd.empty(spark))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and out.count() == 0
