import random

import pytest
from slicewise.operators import subset
from slicewise.operators.reach import NODE, TO, reached_from
from slicewise.operators.seen import Seen
from slicewise.operators.subset import Extraction, SubsetSpec, Way, extract, rows_by
from slicewise.scratch import freeze
from slicewise.sources.catalog import Catalog, table_of


def nodes(spark, values):
    return spark.createDataFrame([(0, v, "") for v in values], "tag int, num long, text string")


def pairs_of(spark, pointers):
    return spark.createDataFrame([(0, a, "", 0, b, "") for a, b in pointers], ", ".join(f"{c} {t}" for c, t in zip((*NODE, *TO), ["int", "long", "string"] * 2)))


def brute(start, pointers, ahead):
    seen, todo = set(start), list(start)
    step = {}
    for a, b in pointers:
        step.setdefault(a if ahead else b, []).append(b if ahead else a)
    while todo:
        for x in step.get(todo.pop(), []):
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return seen


@pytest.mark.parametrize("ahead", [True, False])
def test_circles_and_trees(spark, ahead):
    """Random parents, so that there are trees, circles, nodes that point to themselves and, in the end, several parents."""
    rng = random.Random(ahead)
    pointers = [(i, rng.randrange(60)) for i in range(60) if rng.random() < 0.9] + [(3, 5), (3, 9)]
    start = rng.sample(range(70), 4)
    got = reached_from(nodes(spark, start), pairs_of(spark, pointers), ahead).collect()
    assert sorted(r.num for r in got) == sorted(brute(start, pointers, ahead))


def test_rounds_are_logarithmic_and_exchanges_constant(spark):
    rounds = []

    def told(*plans):
        rounds.append([p._jdf.queryExecution().executedPlan().toString().count("Exchange ") for p in plans])

    chain = spark.range(1, 500).selectExpr("0 AS tag", "id AS num", "'' AS text", "0 AS to_tag", "id - 1 AS to_num", "'' AS to_text")
    assert reached_from(nodes(spark, [100]), chain, False, told).count() == 400
    assert len(rounds) <= 11 and len({tuple(r) for r in rounds}) <= 2 and max(map(sum, rounds)) <= 7


def chain_catalog(spark, n, bad=None):
    rows = spark.range(0, n, 1, 4).selectExpr("cast(id AS int) AS node", "if(id = 0, null, id - 1) AS parent", f"id <> {bad if bad is not None else -1} AS good")
    return Catalog(spark, [table_of("chain", rows, ["node"], [(["parent"], "chain", ["node"])])])


@pytest.mark.parametrize("bad", [None, 1700])
def test_a_chain_of_2000(spark, monkeypatch, bad):
    rounds = []
    real = subset.reached_from
    monkeypatch.setattr(subset, "reached_from", lambda start, pairs, ahead: real(start, pairs, ahead, lambda *plans: rounds.append(ahead)))
    cut = extract(chain_catalog(spark, 2000, bad), SubsetSpec(root="chain WHERE node = 5", filters=["chain=good"] if bad else []))
    assert sorted(r.node for r in cut.tables["public.chain"].collect()) == list(range(bad or 2000))
    assert rounds.count(False) <= 13 and rounds.count(True) <= 4


def test_doubled_and_stepwise_agree(spark, monkeypatch):
    """Two tables in a circle, keys of two columns and of different integer types, nulls, repeated rows, filters."""
    rng = random.Random(4)
    crews = [(i % 3, i, rng.choice([None, *range(12)]), rng.random() < 0.8) for i in range(12)] + [(0, 3, 4, True)] * 2
    sailors = [(i, rng.choice([None, 0, 1, 2]), rng.randrange(12), rng.random() < 0.9) for i in range(12)]
    crew = spark.createDataFrame(crews, "area int, id int, first long, open boolean")
    sailor = spark.createDataFrame(sailors, "id int, area short, crew int, open boolean")
    c = Catalog(spark, [table_of("crew", crew, [], [(["first"], "sailor", ["id"])]), table_of("sailor", sailor, ["id"], [(["area", "crew"], "crew", ["area", "id"])])])
    results = []
    for double in (True, False):
        if not double:
            monkeypatch.setattr(Extraction, "_can_double", lambda self, edges, downwards: False)
        for root in ("crew WHERE id < 2", "sailor WHERE id IN (3, 4)"):
            for filters in ([], ["sailor=open", "crew=open"]):
                cut = extract(c, SubsetSpec(root=root, filters=filters))
                results.append({n: sorted(map(str, df.collect())) for n, df in cut.tables.items()})
    assert results[:4] == results[4:] and any(len(r["public.crew"]) > 3 for r in results)


def test_several_keys_in_a_cycle_go_step_by_step(spark):
    rows = spark.createDataFrame([(i, i - 1 if i else None, i // 2 if i else None) for i in range(9)], "id int, boss int, mentor int")
    c = Catalog(spark, [table_of("staff", rows, ["id"], [(["boss"], "staff", ["id"]), (["mentor"], "staff", ["id"])])])
    x = Extraction(c, SubsetSpec(root="staff WHERE id = 6"))
    assert not x._can_double(c.constraints(), True)
    assert sorted(r.id for r in x.run().tables["public.staff"].collect()) == list(range(9))


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange ")


class FirstRound(Exception):
    pass


@pytest.mark.parametrize("ahead", [True, False])
def test_large_jumps_are_not_gathered_on_the_driver(spark, ahead):
    """300 000 keys that follow one another are a small file, and a large hash table."""

    def told(*plans):
        raise FirstRound(*map(broadcasts, plans))

    chain = spark.range(1, 300_001).selectExpr("0 AS tag", "id AS num", "'' AS text", "0 AS to_tag", "id - 1 AS to_num", "'' AS to_text")
    with pytest.raises(FirstRound) as first:
        reached_from(chain.select(*NODE), chain, ahead, told)
    assert first.value.args == (0, 0)


def test_large_keys_are_not_gathered_on_the_driver(spark):
    """Small ones are still sent."""
    rows = spark.range(10).selectExpr("id", "id + 1 AS other")
    large, small = (freeze(spark.range(n), "keys") for n in (300_000, 5))
    for keys, sent in ((large, 0), (small, 1)):
        one = rows_by(rows, [Way(keys, (("id", "id"),))])
        both = rows_by(rows, [Way(keys, (("id", "id"),), "other > 2"), Way(keys, (("other", "id"),))])
        assert broadcasts(one) == sent and broadcasts(both) == 2 * sent
        assert one.count() == both.count() == (10 if not sent else 5)
        have = Extraction(Catalog(spark, [table_of("t", rows, ["id"])]), SubsetSpec(root="t"))
        missing = have.missing("public.t", rows, keys)
        assert broadcasts(missing) == sent and missing.count() == (0 if not sent else 5)


def test_keys_of_a_cycle_are_not_gathered_on_the_driver(spark):
    with Seen(spark, ["id"]) as seen:
        seen.add(spark.range(5))
        new = seen.new(spark.range(8))
        assert broadcasts(new) == 0 and sorted(r.id for r in new.collect()) == [5, 6, 7]
