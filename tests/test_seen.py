import random
from decimal import Decimal

import pytest
from slicewise.operators import subset
from slicewise.operators.seen import Seen
from slicewise.operators.subset import SubsetError, extract
from slicewise.sources.catalog import Catalog, table_of

KINDS = "a int, b string, c double, d decimal(9,2)"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def tables_left(spark):
    return [t.name for t in spark.catalog.listTables() if t.name.startswith("slicewise_seen")]


@pytest.mark.parametrize("columns", [["a"], ["a", "b"], ["a", "b", "c", "d"]])
def test_new_rows_against_sets(spark, columns):
    """Nulls, zeros of both signs and texts that look like others joined; files of a bucket are merged on the way."""
    rng = random.Random(len(columns))
    one = lambda: (rng.choice([None, 1, 2, 3, -4]), rng.choice([None, "", "null", "1:x", "x"]), rng.choice([None, 0.0, -0.0, 2.5]), rng.choice([None, Decimal("1.00"), Decimal("1.10")]))
    key = lambda r: tuple(r[c] for c in columns)
    done = set()
    with Seen(spark, columns, compact_after=2) as seen:
        for _ in range(5):
            rows = spark.createDataFrame([one() for _ in range(12)], KINDS).collect()
            df = spark.createDataFrame(rows, KINDS)
            new = seen.new(df)
            assert new.columns == df.columns
            assert sorted(map(repr, new.collect())) == sorted(repr(r) for r in rows if key(r) not in done)
            seen.add(df)
            done |= {key(r) for r in rows}
        assert seen._parts <= 3
    assert not tables_left(spark)


def test_what_was_found_stays_where_it_is(spark):
    """A round shuffles what it finds, and no more exchanges than the first one."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with Seen(spark, ["id"], compact_after=3) as seen:
            counts = []
            for i in range(6):
                rows = spark.range(i * 50, i * 50 + 100)
                new = seen.new(rows)
                if i:
                    counts.append(exchanges(new))
                    assert new.count() == 50
                seen.add(new)
            assert counts == [1] * 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def net(spark, rows):
    df = spark.createDataFrame(rows, "id int, first int, second int")
    return Catalog(spark, [table_of("net", df, ["id"], [(["first"], "net", ["id"]), (["second"], "net", ["id"])])])


def test_rows_with_two_parents(spark):
    """Random nets with circles, against sets in Python."""
    rng = random.Random(5)
    rows = [(i, *(rng.choice([None, rng.randrange(25)]) for _ in range(2))) for i in range(25)]
    down, grown = {3}, True
    while grown:
        more = {i for i, a, b in rows if a in down or b in down} - down
        down, grown = down | more, bool(more)
    want, todo = set(down), list(down)
    while todo:
        for parent in rows[todo.pop()][1:]:
            if parent is not None and parent not in want:
                want.add(parent)
                todo.append(parent)
    cut = extract(net(spark, rows), root="net WHERE id = 3")
    assert sorted(r.id for r in cut.tables["public.net"].collect()) == sorted(want)
    assert not tables_left(spark)


def test_tables_are_dropped_where_rounds_run_out(spark):
    chain = net(spark, [(i, i - 1 if i else None, None) for i in range(6)])
    with pytest.raises(SubsetError, match="no fixpoint"):
        _ = extract(chain, root="net WHERE id = 0", max_rounds=2).tables["public.net"]
    assert not tables_left(spark)


def test_roots_leave_no_views(spark):
    names = lambda: {t.name for t in spark.catalog.listTables() if t.isTemporary}
    before = names()
    assert extract(net(spark, [(1, None, None), (2, 1, None)]), subset.SubsetSpec(root="net n WHERE n.id = 2")).tables["public.net"].count() == 2
    assert names() == before
