"""Ports and what belongs to them: every kind of key there is, in small tables."""

from slicewise.sources.catalog import Catalog, table_of

PORT = [(["port_id"], "ports", ["id"])]

# table: (columns, primary key, foreign keys, rows)
TABLES = {
    "ports": ("id int, name string, gate_code string", ["id"], [], [(4, "Brine", "g-7714"), (9, "Quill", "g-0082")]),
    # below a port, and a step further
    "captains": ("id int, port_id int, email string, title string", ["id"], PORT, [(21, 4, "ada@brine.example", "Master"), (22, 4, "ivo@brine.example", "Mate"), (23, 4, "lou@brine.example", "Pilot"), (24, 9, "kai@quill.example", "Master")]),
    "voyages": ("id int, captain_id int, label string", ["id"], [(["captain_id"], "captains", ["id"])], [(31, 21, "north"), (32, 21, "round the cape"), (33, 23, "ferry"), (34, 24, "survey")]),
    "berths": ("id int, port_id int, label string", ["id"], PORT, [(81, 4, "east quay"), (82, 4, "west quay"), (83, 9, "pier")]),
    "berth_checks": ("id int, berth_id int, remark string", ["id"], [(["berth_id"], "berths", ["id"])], [(1, 81, "dry"), (2, 81, "swept"), (3, 82, "leaks"), (4, 83, "dry")]),
    "tides": ("id int, port_id int, reading string", ["id"], PORT, [(11, 4, "ebb"), (12, 4, "flood"), (13, 9, "ebb"), (14, 9, "slack")]),
    # numbers its rows itself
    "arrivals": ("id int, port_id int, note string", ["id"], PORT, [(71, 4, "moored")]),
    # no key, and one row twice
    "gauges": ("id int, port_id int, depth int", [], PORT, [(1, 4, 12), (2, 4, 15), (3, 4, 9), (3, 4, 9), (4, 9, 30)]),
    # a tree
    "zones": ("id int, within_id int, label string", ["id"], [(["within_id"], "zones", ["id"])], [(1, None, "sea"), (2, 1, "bay"), (3, 1, "strait"), (4, 3, "shoal")]),
    # a cycle
    "crews": ("id int, label string, first_sailor_id int", ["id"], [(["first_sailor_id"], "sailors", ["id"])], [(5, "deck", 51)]),
    "sailors": ("id int, crew_id int, label string", ["id"], [(["crew_id"], "crews", ["id"])], [(51, 5, "bosun"), (52, 5, "cook")]),
    # a key of two columns, and a column that names voyages undeclared
    "passages": ("area_id int, voyage_id int, label string", ["area_id", "voyage_id"], [], [(60, 31, "outer"), (60, 32, "inner"), (61, 33, "outer")]),
    "pilots": ("id int, area_id int, voyage_id int, keeper string", ["id"], [(["area_id", "voyage_id"], "passages", ["area_id", "voyage_id"])], [(1, 60, 31, "Wren"), (2, 60, 32, "Wren"), (3, 60, 32, "Finch"), (4, 61, None, "Gull")]),
    # two keys to one parent
    "cargo": ("id int, port_id int, label string", ["id"], PORT, [(91, 4, "timber"), (92, 4, "salt"), (93, 4, "wool"), (94, 9, "ore")]),
    "cargo_marks": ("id int, cargo_id int, port_id int, remark string", ["id"], [(["cargo_id"], "cargo", ["id"]), (["port_id", "cargo_id"], "cargo", ["port_id", "id"])], [(1, 91, 4, "wet"), (2, 93, 4, "fragile"), (3, 94, 9, "heavy")]),
}


def harbour(spark, **extra_rows) -> Catalog:
    tables = []
    for name, (columns, key, foreign, rows) in TABLES.items():
        df = spark.createDataFrame(rows + extra_rows.get(name, []), columns)
        tables.append(table_of(name, df, key, foreign, identity=["id"] if name == "arrivals" else [], types={"email": "character varying(255)"} if name == "captains" else None))
    return Catalog(spark, tables)


def counts(cut) -> dict[str, int]:
    return {r["table_name"].removeprefix("public."): r["row_count"] for r in cut.row_counts().collect()}
