import inspect
import json
import random

import pytest
from slicewise.operators.subset import Slice
from slicewise.sources import document, slices
from slicewise.sources.catalog import Catalog, table_of
from slicewise.sources.document import compose, lex

SAID = ["plain", "a]b[c", '"', "\\", '\\"]', "{", "}}", "line\nbreak", "[1, 2]", "", "é漢😀", "\\\\", "],[", "\t ", None]


def test_ranges_are_functions_that_compose():
    """However a document is cut at its brackets, the composed functions tell the whole's."""
    text = json.dumps({"meta": {"a": [1, "]"]}, "rows": [[s, i] for i, s in enumerate(SAID)]})
    pieces = text.split("]")
    for inside in (False, True):
        whole = lex(text, inside)
        for cut in range(1, len(pieces)):
            parts = ["]".join(pieces[:cut]), "]" + "]".join(pieces[cut:])]
            one, two = [(lex(p, False), lex(p, True)) for p in parts]
            assert compose(one, two)[inside] == whole
    assert lex(text, False) == (False, 0)


def catalog_of(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice(SAID), rng.choice([None, 9007199254740993 + i]), [rng.choice(SAID[:11]) for _ in range(rng.randrange(3))], "x" * (3000 if i == n // 2 else 1)) for i in range(n)]
    t = spark.createDataFrame(rows, "id int, said string, big long, words array<string>, long string").repartition(4)
    empty = spark.createDataFrame([], "id int, said string")
    other = spark.createDataFrame([(k, "]") for k in range(40)], "id int, said string")
    return Catalog(spark, [table_of("a_empty", empty, ["id"]), table_of("t", t, ["id"]), table_of("u", other, ["id"]), table_of("z_empty", empty, ["id"])])


def rows(df):
    return sorted(map(str, df.collect()))


def as_document(c, names):
    """The document as others write it: rows of all tables, empty ones too."""
    return {"meta": {"extracted_at": "now", "root": "t"}, "table_order": names, "tables": {n: {"columns": c.df(n).columns, "identity_columns": False, "rows": [[v if not isinstance(v, list) else "{" + ",".join('"' + str(x).replace("\\", "\\\\").replace('"', '\\"') + '"' if x is not None else "NULL" for x in v) + "}" for v in r] for r in c.df(n).collect()]} for n in names}}


@pytest.mark.parametrize("form", [None, 2, "one line"])
@pytest.mark.parametrize("size", ["1b", "37b", "700b", "64m"])
def test_documents_cut_anywhere(spark, tmp_path, form, size):
    """Ranges that end within rows, texts and escapes, rows over several ranges, empty tables; with and without lines."""
    c = catalog_of(spark, 30)
    path = tmp_path / "d.json"
    path.write_text(json.dumps(as_document(c, ["public.a_empty", "public.t", "public.z_empty", "public.u"]), indent=form if form != "one line" else None, ensure_ascii=form == 2), encoding="utf-8")
    if size == "1b" and form is not None:
        pytest.skip("as many ranges as bytes are tried once")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b" if size == "1b" else size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        pieces = spark.read.option("lineSep", "]").text(str(path)).rdd.getNumPartitions()
        back = slices.read_document(c, str(path))
        for name in ("public.a_empty", "public.t", "public.z_empty", "public.u"):
            assert rows(back.tables[name]) == rows(c.df(name))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert pieces > 3 or size == "64m"


@pytest.mark.parametrize("one_file", [True, False])
def test_round_trip(spark, tmp_path, monkeypatch, one_file):
    if not one_file:
        monkeypatch.setattr(document, "ONE_FILE", 10)
    c = catalog_of(spark, 25)
    cut = Slice(c, {n: c.df(n) for n in ("public.t", "public.u")}, "t")
    path = tmp_path / "d.json"
    slices.write_document(cut, str(path))
    slices.write_document(cut, str(path))  # in place of what was there
    assert path.is_file() == one_file
    text = path.read_text() if one_file else "".join(p.read_text() for p in sorted(path.glob("part-*")))
    assert len(json.loads(text)["tables"]["public.t"]["rows"]) == 25
    back = slices.read_document(c, str(path))
    assert {n: rows(df) for n, df in back.tables.items()} == {n: rows(df) for n, df in cut.tables.items()}


def test_nothing_goes_through_the_driver_row_by_row():
    source = inspect.getsource(slices) + inspect.getsource(document)
    assert "toLocalIterator" not in source and "multiLine" not in source


def test_what_is_no_document(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"meta": {"a": "open}}')
    with pytest.raises(ValueError, match="no whole JSON document"):
        document.read_rows(spark, str(tmp_path / "x.json"))
