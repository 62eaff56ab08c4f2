from collections import Counter
from itertools import permutations

import odd
from pyspark.sql import functions as F
from slicewise.llm import sharding
from slicewise.llm.sharding import communication_matrix, shard


def test_exact_sizes_and_gapless_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 40)
    out = shard(spark.range(5000).repartition(7), 24).collect()
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(24):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    assert sorted(r.id for r in out) == list(range(5000))
    # the order within a shard says nothing of the rows
    first = [r.id for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert 0.3 < sum(a < b for a, b in zip(first, first[1:])) / 5000 < 0.7


def test_matrix_sums_and_fan_out(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FAN_OUT", 3)  # several levels
    rows = [(p, 37 * p % 50) for p in range(20)] + [(40, 500)]
    total = sum(n for _, n in rows)
    sizes = [total // 6 + (s < total % 6) for s in range(6)]
    got = {r.part: list(r.counts) for r in communication_matrix(spark.createDataFrame(rows, "part int, rows long"), sizes, 3).collect()}
    assert all(sum(got[p]) == n for p, n in rows if n)
    assert [sum(v[s] for v in got.values()) for s in range(6)] == sizes


def test_hypergeometric_law(spark):
    """Mean and variance of many draws."""
    g, t, n = 30, 100, 20
    u = (F.col("id") + 0.5) / 20000
    draws = spark.range(20000).select(sharding._hypergeometric(F.lit(g), F.lit(t), F.lit(n), u).alias("k"))
    mean, var, low, high = draws.agg(F.avg("k"), F.var_pop("k"), F.min("k"), F.max("k")).first()
    assert abs(mean - n * g / t) < 0.01 and abs(var - n * 0.3 * 0.7 * 80 / 99) < 0.02 and low >= 0 and high <= 20
    # support edges
    edge = spark.range(50).select(sharding._hypergeometric(F.lit(9), F.lit(10), F.lit(9), (F.col("id") + 0.5) / 50).alias("k"))
    assert {r.k for r in edge.collect()} == {8, 9}


def test_odd_documents(spark):
    docs = odd.docs(spark)
    out = shard(docs, 4)
    assert out.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    rest = [c for c in docs.columns if c not in ("shard", "slot")]
    assert sorted(map(str, out.select(rest).collect())) == sorted(map(str, docs.select(rest).collect()))
    assert sorted(Counter(r.shard for r in out.collect()).values()) == [5, 5, 6, 6]
    assert shard(odd.empty(spark), 4).count() == 0
    few = shard(spark.range(2), 5).collect()
    assert sorted(r.slot for r in few) == [0, 0]


def test_law_of_the_matrix(spark, monkeypatch):
    """Against every way of dealing 2, 1 and 3 rows of three partitions to shards of 3, 2 and 1: the joint law of the matrix, drawn in one level and in two."""
    rows, sizes = [0, 0, 1, 2, 2, 2], [0, 0, 0, 1, 1, 2]
    want = Counter()
    for dealt in permutations(range(6)):
        matrix = [[0] * 3 for _ in range(3)]
        for row, at in enumerate(dealt):
            matrix[rows[row]][sizes[at]] += 1
        want[str(matrix)] += 1 / 720
    table = spark.createDataFrame([(0, 2), (1, 1), (2, 3)], "part int, rows long")
    counts = F.array(*[F.lit(x).cast("long") for x in (3, 2, 1)])
    for family in (["2,1,3"], ["3,3", "2,1"]):
        draws = spark.range(40000).withColumn("v", counts)
        first = F.array(*[F.lit(int(x)).cast("long") for x in family[0].split(",")])
        draws = draws.withColumn("m", sharding._split(F.col("v"), first, F.lit(1), F.col("id")))
        if len(family) > 1:
            second = F.array(*[F.lit(int(x)).cast("long") for x in family[1].split(",")])
            draws = draws.withColumn("m", F.concat(sharding._split(F.col("m")[0], second, F.lit(2), F.col("id")), F.slice("m", 2, 1)))
        got = {str([list(v) for v in r.m]): r["count"] / 40000 for r in draws.groupBy("m").count().collect()}
        assert set(got) == set(want)
        chi = sum(40000 * (got[m] - p) ** 2 / p for m, p in want.items())
        assert chi < len(want) + 5 * (2 * len(want)) ** 0.5
    seen = communication_matrix(table, [3, 2, 1], 5).collect()
    assert str([list(r.counts) for r in sorted(seen, key=lambda r: r.part)]) in want


def test_law_of_places(spark):
    """Each of three rows in two partitions lands on each place equally often over the seeds, and so does each pair of rows."""
    found, pairs = Counter(), Counter()
    df = spark.range(3).repartition(2).cache()
    df.count()
    n = 24
    for seed in range(n):
        order = [r.id for r in sorted(shard(df, 2, seed).collect(), key=lambda r: (r.shard, r.slot))]
        found.update(enumerate(order))
        pairs[tuple(order)] += 1
    assert sum((found[i, j] - n / 3) ** 2 / (n / 3) for i in range(3) for j in range(3)) < 4 + 5 * 8**0.5
    assert sum((pairs[x] - n / 6) ** 2 / (n / 6) for x in permutations(range(3))) < 5 + 5 * 10**0.5


def test_buckets_follow_bytes(spark, monkeypatch):
    """Long rows make more buckets; the result is as exact."""
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 2000)
    df = spark.range(300).selectExpr("id", "if(id = 5, null, repeat('x', int(id))) AS text", "array(id) AS list")
    assert df.select(F.sum(sharding.row_bytes(df))).first()[0] == sum(range(300)) - 5 + 300 * 16
    written, real = {}, sharding.freeze
    monkeypatch.setattr(sharding, "freeze", lambda df, label: written.setdefault(label, real(df, label)))
    out = shard(df, 4)
    # 49 645 bytes over 4 shards of at most 2000 a bucket
    assert {r.bucket for r in written["shard_buckets"].collect()} == set(range(7))
    rows = out.collect()
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(75))


def test_native_plan(spark):
    plan = shard(spark.range(100), 3)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
