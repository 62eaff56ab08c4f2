import pytest

from harbour import harbour
from slicewise.plans.graph import cycles, format_inspect, format_roots, load_order, reachable, root_candidates
from slicewise.sources.catalog import Catalog, Column, ForeignKey, Table, UnknownTable, partition_roots, qualify, split_name, without_partitions


def schema(**tables):
    """name=(columns, [(column, parent)])"""
    made = []
    for name, (columns, keys) in tables.items():
        full = f"public.{name}"
        fks = tuple(ForeignKey(f"{name}_{c}", full, f"public.{p}", (c,), ("id",)) for c, p in keys)
        made.append(Table(full, tuple(Column(c, "bigint") for c in columns.split()), ("id",), fks))
    return Catalog(None, made)


#: a port's ships, their voyages, the legs of those, and remarks on legs by crew members
FLEET = dict(
    ports=("id name", []),
    crew=("id port_id", [("port_id", "ports")]),
    voyages=("id port_id captain_id", [("port_id", "ports"), ("captain_id", "crew")]),
    legs=("id voyage_id pilot_id", [("voyage_id", "voyages"), ("pilot_id", "crew")]),
    remarks=("id leg_id by_id", [("leg_id", "legs"), ("by_id", "crew")]),
    flags=("id", []),
)


def test_root_scores():
    """Ten for each child, three for each table within reach, five off for each key of its own."""
    found = root_candidates(schema(**FLEET))
    assert {c.table: c.score for c in found} == {"public.crew": 4 * 10 + 4 * 3 - 5 - 10, "public.ports": 2 * 10 + 4 * 3, "public.voyages": 10 + 4 * 3 - 10, "public.legs": 10 + 4 * 3 - 10}
    assert found[0].reason == "3 children, 4 reachable, 1 outgoing FKs"
    assert "public.crew" in format_roots(found)
    assert "nothing to start from" in format_roots([])


def test_reachable():
    c = schema(ports=("id", []), ships=("id port_id", [("port_id", "ports")]), logs=("id ship_id", [("ship_id", "ships")]), flags=("id", []))
    assert reachable(c, "ships") == ["public.logs", "public.ports", "public.ships"]
    assert reachable(c, "logs", 1) == ["public.logs", "public.ships"]
    with pytest.raises(UnknownTable):
        reachable(c, "nothing")


def test_order_and_cycles(spark):
    c = harbour(spark)
    told = []
    order = load_order(c, c.names(), told.append)
    assert told == [["public.crews", "public.sailors"]]
    assert order.index("public.ports") < order.index("public.captains") < order.index("public.voyages")
    assert {"public.crews", "public.sailors"} in cycles(c, c.names())
    assert "FK -> public.ports.id" in format_inspect(c, ["captains"]) and "NOT NULL" in format_inspect(c, ["captains"])


def test_names_and_partitions():
    assert split_name("a.b.c") == ("a", "b.c") and qualify("t") == "public.t" and qualify("t", "s") == "s.t"
    assert partition_roots({"p2": "p1", "p1": "root"}) == {"p2": "root", "p1": "root"}
    child = Table("public.c", (Column("a", "int"),), (), (ForeignKey("f", "public.c", "public.part", ("a",), ("id",)),))
    kept = without_partitions([child, Table("public.part", (Column("id", "int"),))], {"public.part": "public.root"})
    assert [t.name for t in kept] == ["public.c"] and kept[0].foreign_keys[0].parent == "public.root"
    with pytest.raises(ValueError):
        Catalog(None, [Table("public.c", (Column("a", "int"),), (), (ForeignKey("f", "public.c", "public.x", ("zz",), ("id",)),))])
