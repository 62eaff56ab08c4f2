import re

import pytest

from harbour import counts, harbour
from slicewise.operators import subset
from slicewise.operators.load import dangling
from slicewise.operators.masking import MaskError
from slicewise.operators.subset import SubsetError, SubsetSpec, extract
from slicewise.queries import ROOT, star
from slicewise.sources.catalog import Catalog, table_of

BRINE = "ports WHERE id = 4"
OF_BRINE = {"ports": 1, "captains": 3, "voyages": 3, "arrivals": 1, "tides": 2, "berths": 2, "berth_checks": 3, "gauges": 4, "cargo": 3, "cargo_marks": 2}
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("options", [{}, {"table_level": True}, {"materialize": True}, {"first_fk_only": True}])
def test_what_belongs_to_a_port(spark, options):
    cut = extract(harbour(spark), root=BRINE, **options)
    assert counts(cut) == OF_BRINE  # gauges has no key and one row twice: both stay
    assert [r["port_id"] for r in cut.tables["public.captains"].collect()] == [4, 4, 4]
    assert dangling(cut).where("orphan_count > 0").count() == 0
    assert set(cut.untouched) == {f"public.{t}" for t in ("zones", "crews", "sailors", "passages", "pilots")}


def test_parents_come_first(spark):
    order = list(extract(harbour(spark), root=BRINE).tables)
    assert order.index("public.ports") < order.index("public.captains") < order.index("public.voyages")


@pytest.mark.parametrize("zone,want", [(1, 4), (3, 3), (4, 3), (2, 2)])
def test_self_reference(spark, zone, want):
    assert counts(extract(harbour(spark), root=f"zones WHERE id = {zone}")) == {"zones": want}


def test_self_reference_with_a_filter(spark):
    """It holds on the steps down, not for the root or the rows above."""
    got = extract(harbour(spark), root="zones WHERE id = 3", filters=["zones=label = 'none'"]).tables["public.zones"]
    assert sorted(r["id"] for r in got.collect()) == [1, 3]


def test_cycle(spark):
    cut = extract(harbour(spark), root="crews WHERE id = 5")
    assert counts(cut) == {"crews": 1, "sailors": 2}
    assert any("circular" in w for w in cut.warnings)


def test_composite_key(spark):
    assert counts(extract(harbour(spark), root="passages WHERE area_id = 60")) == {"passages": 2, "pilots": 3}
    # a null in a key part matches nothing
    assert counts(extract(harbour(spark), root="passages WHERE area_id = 61")) == {"passages": 1}


def test_seed_seals_its_tables(spark):
    got = counts(extract(harbour(spark), seed="port_id=4"))
    assert (got["cargo"], got["cargo_marks"], got["ports"]) == (3, 2, 1)


def test_up_rows_do_not_expand(spark):
    """A voyage of the other port brings its captain, not what is below that port."""
    c = harbour(spark, captains=[(25, 4, "d@brine.example", "Mate")], voyages=[(35, 24, "of Kai"), (36, 25, "own")])
    assert counts(extract(c, root="voyages WHERE id = 36")) == {"voyages": 1, "captains": 1, "ports": 1}


def test_controls(spark):
    c = harbour(spark)
    assert counts(extract(c, root=BRINE, filters=["berths=label = 'east quay'"]))["berths"] == 1
    assert "berth_checks" not in counts(extract(c, root=BRINE, depth=1))
    assert counts(extract(c, root=BRINE, depth=2))["berth_checks"] == 3
    limited = extract(c, root=BRINE, limit=1)
    assert counts(limited)["captains"] == 1 and "public.captains" in limited.truncated
    without = extract(c, root="captains WHERE id = 21", exclude=["ports", "cargo"])
    assert set(counts(without)) == {"captains", "voyages"} and any("ports" in w for w in without.warnings)
    assert counts(extract(c, root=BRINE, include=["zones"]))["zones"] == 4


@pytest.mark.parametrize("options", [{}, {"limit": 2, "filters": ["captains=title <> 'Mate'"]}])
def test_hops(spark, options):
    """A depth beyond the longest way is no depth; each less leaves out the tables that far away."""
    c = harbour(spark)
    whole = counts(extract(c, root=BRINE, **options))
    assert counts(extract(c, root=BRINE, depth=5, **options)) == whole
    far = {"voyages", "berth_checks", "cargo_marks"}
    near = {t: n for t, n in whole.items() if t not in far}
    assert {t: n for t, n in counts(extract(c, root=BRINE, depth=1, **options)).items() if t != "cargo_marks" or n} == near | ({"cargo_marks": whole["cargo_marks"]} if "cargo_marks" in near else {})


def test_hops_down_a_tree(spark):
    c = harbour(spark, zones=[(5, 4, "rock"), (6, 5, "tip")])
    assert [counts(extract(c, root="zones WHERE id = 1", depth=d))["zones"] for d in (1, 2, 3, 4, 9)] == [3, 4, 5, 6, 6]


def test_filters_do_not_hold_upwards(spark):
    got = counts(extract(harbour(spark), root="berth_checks WHERE id = 1", filters=["berths=label = 'none'"]))
    assert got["berths"] == 1


def test_root_tails(spark):
    c = harbour(spark)
    assert counts(extract(c, root="captains ORDER BY id DESC LIMIT 1"))["captains"] == 1
    assert counts(extract(c, root="ports ORDER BY rand() LIMIT 1"))["ports"] == 1


@pytest.mark.parametrize("tail", ['WHERE "id" = 21', "WHERE id::text = '21'", "WHERE captains.id::numeric(10,2) = 21", "WHERE \"title\"::varchar(20) = 'Master' AND cast(port_id AS text) = '4'", "WHERE (email || '::text')::text = 'ada@brine.example::text'", 'c WHERE c."id" = 21'])
def test_root_tails_of_postgresql(spark, tail):
    assert [r["id"] for r in extract(harbour(spark), root=f"captains {tail}").tables["public.captains"].collect()] == [21]


@pytest.mark.parametrize("options", [{}, {"root": "captains", "seed": "id=1"}, {"root": "captains WHERE id = 99"}, {"seed": "nothing=1"}, {"seed": "id"}, {"root": "captains", "exclude": ["captains"]}, {"root": "captains", "include": ["cargo"], "exclude": ["cargo"]}, {"root": "captains", "exclude": ["nowhere"]}])
def test_refused(spark, options):
    with pytest.raises(SubsetError):
        extract(harbour(spark), SubsetSpec(**options))


def test_masks(spark):
    c = harbour(spark)
    cut = extract(c, root=BRINE, masks=["ports.gate_code='no'", "ports.gate_code='hidden'", "captains.email='captain_' || \"id\"::text || '@x'"])
    assert [tuple(r) for r in cut.tables["public.ports"].collect()] == [(4, "Brine", "hidden")]
    assert sorted(r["email"] for r in cut.tables["public.captains"].collect()) == ["captain_21@x", "captain_22@x", "captain_23@x"]
    for bad in ("captains.port_id=1", "captains.nothing=1", "email='x'", "captains.email="):
        with pytest.raises(MaskError):
            extract(c, root="captains", masks=[bad])


def test_rows_exist_in_the_source(spark):
    c = harbour(spark)
    cut = extract(c, root=BRINE)
    for name, df in cut.tables.items():
        assert df.exceptAll(c.df(name)).count() == 0


# ---- plans


def scans(monkeypatch, take, *columns):
    """How often the plans of a call read tables (by a column that no key has), those of their key tables included."""
    plans = []
    with monkeypatch.context() as m:
        real = subset.freeze
        m.setattr(subset, "freeze", lambda df, *rest: (plans.append(df), real(df, *rest))[1])
        plans.append(take())
    text = "".join(p._jdf.queryExecution().optimizedPlan().toString() for p in plans)
    return [len(re.findall(rf"Relation \[[^\]]*\b{c}#", text)) for c in columns]


def test_a_table_is_read_for_its_keys_and_its_rows(spark, monkeypatch):
    assert scans(monkeypatch, lambda: extract(star(spark, SF), SubsetSpec(root=ROOT)).row_counts(), "l_quantity") == [2]
    # and once where it is asked for alone
    assert scans(monkeypatch, lambda: extract(star(spark, SF), SubsetSpec(root=ROOT)).tables["public.lineitem"], "l_quantity") == [1]


def test_scans_are_linear_in_the_depth(spark, monkeypatch, tmp_path):
    """Each hop more reads a table once more."""
    spark.range(200).selectExpr("id", "id div 2 AS above", "concat('n', id) AS label").write.parquet(str(tmp_path / "tree"))
    c = Catalog(spark, [table_of("tree", spark.read.parquet(str(tmp_path / "tree")), ["id"], [(["above"], "tree", ["id"])])])
    found = [scans(monkeypatch, lambda d=d: extract(c, SubsetSpec(root="tree WHERE id = 1", depth=d)).row_counts(), "label")[0] for d in (1, 2, 3, 6)]
    assert [x - found[0] for x in found] == [0, 1, 2, 5]  # beside the rounds of the way up
    # of the star's tables none is read more than once for a hop, for the keys of its rows down, for those of all, and for the rows
    for d in (1, 2, 3, 4):
        take = lambda d=d: extract(star(spark, SF), SubsetSpec(root="region WHERE r_name = 'ASIA'", depth=d)).row_counts()
        assert max(scans(monkeypatch, take, "n_name", "c_acctbal", "s_acctbal", "o_totalprice", "l_quantity", "p_size")) <= d + 3


def test_tables_without_any_key(spark):
    c = Catalog(spark, [table_of("plain", spark.range(3).toDF("x"))])
    assert counts(extract(c, root="plain", depth=2)) == {"plain": 3} == counts(extract(c, root="plain"))
