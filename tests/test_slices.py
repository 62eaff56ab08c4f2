import datetime
import decimal
import json

import pytest
from pyspark.sql import functions as F

from harbour import harbour
from slicewise.functions.rendering import array_text, copy_lines, inet_text, interval_text, parsed, rendered, sql_literal
from slicewise.operators.subset import Slice, extract
from slicewise.sources import slices
from slicewise.sources.catalog import Catalog, table_of


@pytest.fixture
def cut(spark):
    return extract(harbour(spark), root="ports WHERE id = 4", masks=["ports.gate_code='hidden'"])


def same(a: Slice, b: Slice) -> None:
    assert list(a.filled) == list(b.tables)
    for name in b.tables:
        assert sorted(map(str, a.tables[name].collect())) == sorted(map(str, b.tables[name].collect()))


def test_parquet_round_trip(spark, cut, tmp_path):
    slices.write_parquet(cut, str(tmp_path / "s"))
    back = slices.read_slice(cut.catalog, str(tmp_path / "s"))
    same(cut, back)
    assert back.masks == cut.masks and back.untouched == cut.untouched


def test_lines_round_trip(spark, cut, tmp_path):
    slices.write_lines(cut, str(tmp_path / "s"))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "s" / "public.ports")).collect()]
    assert lines == [{"id": 4, "name": "Brine", "gate_code": "hidden"}]
    same(cut, slices.read_slice(cut.catalog, str(tmp_path / "s")))


def test_document_round_trip(spark, cut, tmp_path):
    path = str(tmp_path / "s.json")
    slices.write_document(cut, path)
    document = json.loads(open(path, encoding="utf-8").read())
    assert document["tables"]["public.arrivals"]["identity_columns"] is True
    assert document["meta"]["masks_applied"] == cut.masks
    same(cut, slices.read_document(cut.catalog, path))


# one value of each type, as Python has it and as the text forms state it
KINDS = {
    "id": ("long", 9007199254740993, 9007199254740993),
    "price": ("decimal(10,2)", decimal.Decimal("1.10"), "1.10"),
    "at": ("timestamp_ntz", datetime.datetime(2024, 3, 10, 2, 30, 5, 678000), "2024-03-10T02:30:05.678000Z"),
    "raw": ("binary", bytearray(b"\x01\xff"), "\\x01ff"),
    "odd": ("double", float("nan"), None),
    "names": ("array<string>", ["a,b", 'q"x', "NULL", "", None, "x\\y", "plain"], '{"a,b","q\\"x","NULL","",NULL,"x\\\\y",plain}'),
    "numbers": ("array<bigint>", [1, None], "{1,NULL}"),
    "days": ("array<date>", [datetime.date(2024, 1, 2)], "{2024-01-02}"),
    "span": ("interval day to second", -datetime.timedelta(hours=1, minutes=2, microseconds=500), "-01:02:00.0005"),
    "pair": ("struct<a: int, b: string>", (1, "x"), '{"a":1,"b":"x"}'),
}


@pytest.mark.parametrize("form", ["document", "lines"])
def test_types_round_trip(spark, tmp_path, form):
    df = spark.createDataFrame([tuple(v for _, v, _ in KINDS.values())], ", ".join(f"{n} {k}" for n, (k, _, _) in KINDS.items()))
    c = Catalog(spark, [table_of("t", df, ["id"])])
    cut, path = extract(c, root="t"), str(tmp_path / "t.json")
    text = slices.rendered_rows(cut, "public.t").first().asDict()
    assert text == {n: t for n, (_, _, t) in KINDS.items()}
    if form == "document":
        slices.write_document(cut, path)
    else:
        slices.write_lines(cut, path)
    back = (slices.read_document if form == "document" else slices.read_slice)(c, path).tables["public.t"]
    assert back.dtypes == df.dtypes
    assert back.drop("odd").first() == df.drop("odd").first() and back.first().odd is None


@pytest.fixture
def in_zone(spark):
    def use(zone):
        spark.conf.set("spark.sql.session.timeZone", zone)

    yield use
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "UTC"])
def test_moments_in_any_session_zone(spark, in_zone, zone, tmp_path):
    """Also at times that the session's zone skips or has twice."""
    in_zone(zone)
    stated = ["1970-01-01T00:00:00.000000Z", "2024-03-10T02:30:00.250000Z", "2024-11-03T05:30:00.000000Z", "2024-11-03T06:30:00.000000Z"]
    df = spark.createDataFrame([(s,) for s in stated], "s string").select(parsed(F.col("s"), "timestamp").alias("zoned"), parsed(F.col("s"), "timestamp_ntz").alias("plain"))
    assert df.dtypes == [("zoned", "timestamp"), ("plain", "timestamp_ntz")]
    got = df.select(rendered(F.col("zoned"), "timestamp"), rendered(F.col("plain"), "timestamp_ntz"), sql_literal(F.col("zoned"), "timestamp"), sql_literal(F.col("plain"), "timestamp_ntz")).collect()
    for s, row in zip(stated, got, strict=True):
        clock = s[:-1].replace("T", " ")
        assert tuple(row) == (s, s, f"'{clock}+00'", f"'{clock}'")
    c = Catalog(spark, [table_of("t", df)])
    slices.write_document(extract(c, root="t"), str(tmp_path / "t.json"))
    same(extract(c, root="t"), slices.read_document(c, str(tmp_path / "t.json")))


def test_sql(spark, cut, tmp_path):
    path = str(tmp_path / "q")
    slices.write_sql(cut, path, transaction=True, on_conflict_do_nothing=True)
    steps = sorted(p.name for p in (tmp_path / "q").iterdir() if p.name.startswith("step="))
    assert steps[0] == "step=0000_begin" and steps[-1] == "step=9999_commit" and len(steps) == len(cut.filled) + 2
    text = spark.read.text(path).where("step LIKE '%arrivals'").collect()
    assert [r["value"] for r in text] == ['INSERT INTO "public"."arrivals" ("id", "port_id", "note") OVERRIDING SYSTEM VALUE VALUES (71, 4, \'moored\') ON CONFLICT DO NOTHING;']
    order = [s.split("_", 1)[1] for s in steps[1:-1]]
    assert order == list(cut.filled)


def test_sql_of_a_smaller_slice_leaves_nothing_of_the_larger(spark, cut, tmp_path):
    path = str(tmp_path / "q")
    slices.write_sql(cut, path, transaction=True)
    slices.write_sql(extract(cut.catalog, root="zones WHERE id = 1"), path, mode="overwrite")
    assert sorted(p.name for p in (tmp_path / "q").iterdir() if p.name.startswith("step=")) == ["step=0000_begin", "step=0001_public.zones"]


@pytest.mark.parametrize("value,kind,want", [(None, "int", "NULL"), (True, "boolean", "TRUE"), (5, "int", "5"), (1.5, "double", "1.5"), (3.0, "double", "3"), (float("nan"), "double", "'NaN'"), ("it's", "string", "'it''s'"), ("\\x41", "string", "'\\x41'"), (bytearray(b"\x41"), "binary", "'\\x41'::bytea"), ([1, None], "array<int>", "'{1,NULL}'"), (["it's", "a,b"], "array<string>", "'{it''s,\"a,b\"}'"), (datetime.date(2024, 1, 2), "date", "'2024-01-02'"), (datetime.timedelta(days=1, seconds=2), "interval day to second", "'1 day 00:00:02'")])
def test_literals(spark, value, kind, want):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    assert df.select(sql_literal(F.col("x"), df.dtypes[0][1])).first()[0] == want


@pytest.mark.parametrize("months,days,micros,want", [(0, 0, 0, "00:00:00"), (14, 0, 0, "14 mons"), (1, 1, 0, "1 mon 1 day"), (-1, 2, 3_661_500_000, "-1 mon 2 days 01:01:01.5"), (0, 0, -60_000_000, "-00:01:00"), (None, 0, 0, None)])
def test_intervals(spark, months, days, micros, want):
    df = spark.createDataFrame([(months, days, micros)], "m int, d int, u long")
    assert df.select(interval_text(F.col("m"), F.col("d"), F.col("u"))).first()[0] == want


@pytest.mark.parametrize("value,want", [("INTERVAL '14' MONTH", "14 mons"), ("INTERVAL '-1-2' YEAR TO MONTH", "-14 mons"), ("INTERVAL '-1 02:03:04.5' DAY TO SECOND", "-1 day -02:03:04.5"), ("INTERVAL '5' HOUR", "05:00:00"), ("make_interval(1, 2, 0, 3, 4, 5, 6.5)", "14 mons 3 days 04:05:06.5"), ("CAST(NULL AS INTERVAL MONTH)", None), ("INTERVAL '0' DAY", "00:00:00")])
def test_interval_columns(spark, value, want):
    """Through every way that values are written, and back."""
    df = spark.sql(f"SELECT {value} AS x")
    kind = df.dtypes[0][1]
    assert df.select(rendered(F.col("x"), kind)).first()[0] == want
    assert df.select(sql_literal(F.col("x"), kind)).first()[0] == ("NULL" if want is None else f"'{want}'")
    assert copy_lines(df).first()[0] == (want or "\\N")
    back = df.select(parsed(rendered(F.col("x"), kind), kind).alias("x"))
    assert back.dtypes == df.dtypes and back.select(rendered(F.col("x"), kind)).first()[0] == want


def test_copy_and_inet(spark):
    df = spark.createDataFrame([("a\tb\\c\nd", None)], "x string, y int")
    assert copy_lines(df).first()[0] == "a\\tb\\\\c\\nd\t\\N"
    hosts = spark.createDataFrame([("10.0.0.1/32",), ("10.0.0.0/8",), ("::1/128",)], "x string")
    assert [r[0] for r in hosts.select(inet_text(F.col("x"))).collect()] == ["10.0.0.1", "10.0.0.0/8", "::1"]
    assert spark.range(1).select(rendered(F.lit("10.0.0.1/32"), "string", "inet")).first()[0] == "10.0.0.1"


def test_arrays_in_arrays(spark):
    df = spark.createDataFrame([([[1, 2], None, []],)], "x array<array<int>>")
    assert df.select(array_text(F.col("x"), "array<array<int>>")).first()[0] == "{{1,2},NULL,{}}"


def test_arrays_in_arrays_round_trip(spark):
    """Two and three deep, of texts with quotes, commas, braces and backslashes, of empty texts and arrays, the word NULL and nulls at each depth."""
    said = ["plain", 'say "hi"', "a,b", "{x}", "back\\slash", "", "NULL", "null", " ", None, "}{", '","']
    deep = [[said, []], None, [[None], ["é漢"], said[::-1]], []]
    rows = [(1, [said, [], None, ["x"]], deep, [[1, None], [], [-3]]), (2, [], [[]], [[]]), (3, None, None, None)]
    df = spark.createDataFrame(rows, "id int, two array<array<string>>, three array<array<array<string>>>, numbers array<array<int>>").repartition(2)
    text = df.select("id", *[rendered(F.col(c), t).alias(c) for c, t in df.dtypes[1:]])
    back = text.select("id", *[parsed(F.col(c), t).alias(c) for c, t in df.dtypes[1:]])
    assert back.dtypes == df.dtypes
    assert sorted(back.collect()) == sorted(df.collect())
