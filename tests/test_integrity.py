import re
from datetime import datetime
from decimal import Decimal
from uuid import uuid4

from harbour import harbour
from slicewise import queries
from slicewise.operators.integrity import check, format_check, format_cleanup_sql, orphan_counts, orphans, repaired, total_orphans
from slicewise.plans.suggest_fks import format_ddl, format_suggestions, name_forms, stem, suggest, type_family, validate
from slicewise.queries import QUERIES
from slicewise.sources.catalog import Catalog, table_of

LOST = {"voyages": [(98, 777, "lost"), (99, 777, "lost")], "berth_checks": [(9, 8080, "lost")], "pilots": [(9, 62, 31, "lost")]}


def test_clean(spark):
    results = check(harbour(spark))
    assert total_orphans(results) == 0 and "14 key(s) checked, 0 broken\n" in format_check(results)
    assert "There are none" in format_cleanup_sql(results)


def test_orphans(spark):
    c = harbour(spark, **LOST)
    results = check(c, samples=1)
    bad = {r.constraint.child: (r.count, r.samples) for r in results if r.count}
    assert bad == {"public.voyages": (2, [(98, 777)]), "public.berth_checks": (1, [(9, 8080)]), "public.pilots": (1, [(9, 62, 31)])}
    text = format_check(results)
    assert "14 key(s) checked, 3 broken: 4 row(s) without a parent in public.berth_checks, public.pilots, public.voyages" in text
    assert "captain_id -> public.captains.id [voyages_captain_id_fkey]: 2 without a parent\n    e.g. id = 98, captain_id = 777" in text
    assert 'DELETE FROM "public"."voyages" AS c' in format_cleanup_sql(results)
    assert orphan_counts(c, ["captains"]).first()["orphan_count"] == 0
    fk = next(fk for fk in c.constraints() if fk.child == "public.voyages")
    assert repaired(c, fk).count() == 4


def test_suggestions(spark):
    c = harbour(spark, passages=[(62, 5005, "lost")])
    found = {(s.child, s.column): s for s in validate(c, suggest(c))}
    hit = found["public.passages", "voyage_id"]
    assert (hit.parent, hit.parent_column, hit.orphans) == ("public.voyages", "id", 1)
    assert found["public.passages", "area_id"].parent is None
    assert ("public.captains", "port_id") not in found
    text = format_suggestions(list(found.values()), show_unmatched=True)
    assert "voyage_id -> public.voyages.id: 1 row(s) fit no parent" in text and "1 key(s) suggested, 0 of them hold; 1 column(s) left over" in text
    assert "NOT VALID" in format_ddl(found.values())
    assert "voyage_id -> public.voyages.id: not looked at" in format_suggestions(suggest(c)) and "1 key(s) suggested\n" in format_suggestions(suggest(c))


def test_names():
    assert stem("customer_id") == "customer" and stem("id") is None and stem("_id") is None and stem("User_ID") == "user"
    assert name_forms("category") == ["category", "categorys", "categories"]
    assert name_forms("box")[-1] == "boxes" and name_forms("user") == ["user", "users"]
    assert type_family("int4") == type_family("bigint") and type_family("varchar(20)") == "varchar"


def scans(df) -> list[str]:
    """The tables that a plan scans, as often as it does."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"FileScan parquet.*?/(\w+)\.parquet", plan)


def test_each_table_is_scanned_once_for_all_its_keys(spark):
    star = queries.star(spark, "/root/testdata/sf0.001")
    for df in (orphan_counts(star), QUERIES["orphans_by_fk_restricted"](spark, "/root/testdata/sf0.001")):
        assert sorted(scans(df)) == sorted(queries.STAR)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan


def test_keys_of_every_type(spark):
    """Values are compared as Spark compares them, across types, and zeros, zones, nulls and separators make no difference."""
    rows = [
        (1, 1.0, Decimal("1.50"), "a:1", "b", b"\xff\x00", datetime(2024, 1, 1, 5), True, 0.0, [1, 2]),
        (2, 2.5, Decimal("2.00"), "a", ":1b", b"\xff", datetime(2024, 1, 1, 6), False, -0.0, [12]),
        (None, None, None, None, "x", None, None, None, None, None),
    ]
    child = spark.createDataFrame(rows, "i int, f float, d decimal(10,2), s string, t string, b binary, m timestamp, o boolean, z double, a array<int>")
    parents = [
        (1, 1.0, Decimal("1.500"), "a:1", "b", b"\xff\x00", datetime(2024, 1, 1, 5), True, -0.0, [1, 2]),
        (7, 2.25, Decimal("2.001"), "a:", "1b", b"\xfe", datetime(2024, 1, 1, 7), True, 5.0, [1]),
    ]
    parent = spark.createDataFrame(parents, "i long, f double, d decimal(12,3), s string, t string, b binary, m timestamp, o boolean, z double, a array<int>")
    columns = [["i"], ["f"], ["d"], ["s", "t"], ["b"], ["m"], ["o"], ["z"], ["a"], ["i", "s"], ["t", "m"]]
    c = Catalog(spark, [table_of("p", parent), table_of("c", child, [], [(x, "p", x, f"k{n:02d}") for n, x in enumerate(columns)])])
    want = [sum(1 for r in orphans(child, parent, x, x).collect()) for x in columns]
    assert [r.count for r in check(c)] == want == [1, 1, 1, 1, 1, 1, 1, 0, 1, 1, 1]


def test_counts_and_samples_are_two_jobs_for_any_number_of_keys(spark):
    def jobs(c, samples):
        group = f"check-{uuid4()}"
        spark.sparkContext.setJobGroup(group, "")
        try:
            results = check(c, samples=samples)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        tracker = spark.sparkContext.statusTracker()
        return results, len(tracker.getJobIdsForGroup(group))

    lost = LOST | {"captains": [(90 + i, 1000 - i, None, "lost") for i in range(9)], "cargo_marks": [(9, 91, 9, "lost"), (10, 777, 4, "lost"), (11, 777, 777, "lost")]}
    few, n_few = jobs(harbour(spark, **LOST), 2)
    many, n_many = jobs(harbour(spark, **lost), 2)
    found = {(r.constraint.child.removeprefix("public."), r.constraint.child_cols): (r.count, r.samples) for r in many if r.count}
    assert found["captains", ("port_id",)] == (9, [(90, 1000), (91, 999)])
    assert found["cargo_marks", ("cargo_id",)] == (2, [(10, 777), (11, 777)])
    assert found["cargo_marks", ("port_id", "cargo_id")] == (3, [(9, 9, 91), (10, 4, 777)])
    assert len(found) == 6 and sum(r.count > 0 for r in few) == 3
    assert n_many <= n_few + 6  # adaptive stages of the same two actions, not an action for each key
