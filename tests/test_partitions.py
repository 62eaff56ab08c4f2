import pytest
from slicewise.operators.integrity import check
from slicewise.operators.subset import SubsetSpec, extract
from slicewise.sources.catalog import from_yaml
from slicewise.sources.partitions import PartitionError, leaves

REGISTRY = """
tables:
  days: {primary_key: [id]}
  visits:
    primary_key: [id]
    foreign_keys: [{columns: [day], table: days, references: [id]}, {columns: [place], table: places, references: [name]}]
    partitions:
      by: range
      column: day
      of:
        early: {to: 10}
        middle:
          from: 10
          to: 20
          partitions:
            by: list
            column: place
            of: {north: {values: [oslo, null]}, south: {values: [rome, bari]}, elsewhere: {default: true, path: other.parquet}}
        late: {from: 20, to: 30, partitions: {by: hash, column: id, of: {late_0: {}, late_1: {}}}}
  places: {primary_key: [name]}
"""
ROWS = [(i, i % 30, ["oslo", None, "rome", "bari", "nice"][i % 5]) for i in range(120)]


def place_of(i, day, place):
    if day < 10:
        return "early"
    if day >= 20:
        return f"late_{i % 2}"
    return "north" if place in ("oslo", None) else "south" if place in ("rome", "bari") else "other"


@pytest.fixture
def partitioned(spark, tmp_path):
    for name in ("early", "north", "south", "other", "late_0", "late_1"):
        own = [r for r in ROWS if place_of(*r) == name]
        spark.createDataFrame(own, "id int, day int, place string").write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.createDataFrame([(d,) for d in range(30)], "id int").write.parquet(str(tmp_path / "days.parquet"))
    spark.createDataFrame([(p,) for p in ("oslo", "rome", "bari", "nice")], "name string").write.parquet(str(tmp_path / "places.parquet"))
    (tmp_path / "catalog.yaml").write_text(REGISTRY)
    return from_yaml(spark, tmp_path / "catalog.yaml")


def found(cut):
    df = cut.tables["public.visits"]
    return sorted((r.id for r in df.collect())), {f.rsplit("/", 2)[-2] for f in df.inputFiles() if "/days" not in f and "/places" not in f and "slicewise" not in f}


@pytest.mark.parametrize(("root", "wanted", "files"), [
    ("days WHERE id < 3", lambda r: r[1] < 3, {"early.parquet"}),
    ("days WHERE id IN (9, 10)", lambda r: r[1] in (9, 10), {"early.parquet", "north.parquet", "south.parquet", "other.parquet"}),
    ("days WHERE id >= 25", lambda r: r[1] >= 25, {"late_0.parquet", "late_1.parquet"}),
    ("places WHERE name = 'rome'", lambda r: r[2] == "rome", {"early.parquet", "south.parquet", "other.parquet", "late_0.parquet", "late_1.parquet"}),
    ("days", lambda r: True, {f"{n}.parquet" for n in ("early", "north", "south", "other", "late_0", "late_1")}),
])
def test_leaves_without_keys_are_not_read(partitioned, root, wanted, files):
    """Range, list, hash and default parts, two deep; all rows come, each once, from no more files than can hold them."""
    ids, read = found(extract(partitioned, SubsetSpec(root=root)))
    assert ids == [r[0] for r in ROWS if wanted(r)]
    assert read == files


def test_a_partitioned_table_is_one_table(partitioned):
    assert partitioned.names() == ["public.days", "public.places", "public.visits"]
    assert partitioned.df("visits").count() == len(ROWS)
    assert [r.count for r in check(partitioned)] == [0, 0]
    up = extract(partitioned, SubsetSpec(root="visits WHERE day = 12"))
    assert [r.id for r in up.tables["public.days"].collect()] == [12]


@pytest.mark.parametrize("tree", [{}, {"by": "range"}, {"by": "other", "column": "x", "of": {"a": {}}}, {"by": "list", "column": "x", "of": {"a": {}}}])
def test_what_is_no_tree(tree):
    with pytest.raises(PartitionError):
        leaves(tree, "/base")
