"""The JSON document of a slice, written and read in parallel.

``{meta, table_order, tables: {name: {columns, rows: [[..], ..], identity_columns}}}``. Tasks write it as parts, which are
the document when laid end to end; a small one is laid into one file at once.

It is read in byte ranges, cut by Spark at ``]``, whatever its lines. Where a range begins, a text may be open, and brackets are. Each
range is a function of that: from whether it begins within a text to whether it ends so and by how much it is deeper then.
These functions are composed over the ranges, so each range's own beginning is known before rows are cut in a second pass.
A row is an array at depth five; what is outside of rows is small and tells which of them are whose.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import freeze

#: bytes of a document that is laid into one file
ONE_FILE = 64 << 20
ROW_DEPTH = 5
_BODY = r'[^"\\]*(?:\\.[^"\\]*)*'
_STRING, _END, _TOKEN = (re.compile(x, re.S) for x in (f'"{_BODY}"', f'{_BODY}"', f'"{_BODY}"|"|[\\[\\]{{}}]'))


# ---- writing


def write_parts(spark: SparkSession, lines: list[DataFrame], path: str) -> None:
    """Writes tables of lines (column value) end to end: in the order of the tables, of their partitions and rows."""
    jvm, whole = spark._jvm, lines[0]
    for more in lines[1:]:
        whole = whole.unionByName(more)
    whole.write.mode("overwrite").text(path)
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system, conf = folder.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jsc.hadoopConfiguration()
    if system.getContentSummary(folder).getLength() > ONE_FILE:
        return
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.draft")
    out = system.create(draft, True)
    try:
        for status in sorted(system.listStatus(folder), key=lambda s: s.getPath().getName()):
            if status.getPath().getName().startswith("part-"):
                part = system.open(status.getPath())
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                part.close()
    finally:
        out.close()
    system.delete(folder, True)
    system.rename(draft, folder)


def row_lines(rows: DataFrame) -> DataFrame:
    """A line for each row, as a JSON array of its values, with a comma before all but the first."""
    listed = F.concat(F.lit("["), F.concat_ws(", ", *[_json(F.col(f"`{c}`"), t) for c, t in rows.dtypes]), F.lit("]"))
    numbered = freeze(rows.select(listed.alias("value"), F.monotonically_increasing_id().alias("number")), "document_rows")
    first = numbered.agg(F.min("number")).first()[0]
    # sorted, since a table isn't read in the order in which it was written
    return numbered.orderBy("number").select(F.concat(F.when(F.col("number") == first, "").otherwise(","), "value").alias("value"))


def _json(column: F.Column, kind: str) -> F.Column:
    """A value as JSON text; a text is written by way of an array of one."""
    text = column.cast("string")
    if kind == "string":
        listed = F.to_json(F.array(column))
        text = F.substring(listed, F.lit(2), F.length(listed) - 2)
    return F.coalesce(text, F.lit("null"))


# ---- reading


def lex(text: str, inside: bool) -> tuple[bool, int]:
    """Whether a text literal is open after ``text``, and how much deeper it is then."""
    if inside:
        m = _END.match(text)
        if not m:
            return True, 0
        text = text[m.end() :]
    rest, quote, _ = _STRING.sub("", text).partition('"')
    return bool(quote), rest.count("[") + rest.count("{") - rest.count("]") - rest.count("}")


def compose(first: tuple, then: tuple) -> tuple:
    """Two ranges, one after the other: for each way to begin (not within a text, within one) how it ends and how much deeper it is."""
    return tuple((then[inside][0], depth + then[inside][1]) for inside, depth in first)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    """(file, where its range begins, text), with the brackets at which pieces were cut."""
    last = None
    for batch in batches:
        file, start, piece = (batch.column(c).to_pylist() for c in ("file", "start", "value"))
        low = 0
        for i in range(1, len(piece) + 1):
            if i == len(piece) or (file[i], start[i]) != (file[low], start[low]):
                here = file[low], start[low]
                cut = "" if here != last and not start[low] else "]"  # the first piece of a file follows no bracket
                yield *here, cut + "]".join(piece[low:i])
                last, low = here, i


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each range as a function, as (file, start, open0, deeper0, open1, deeper1)."""
    found: dict[tuple, tuple] = {}
    for file, start, text in _texts(batches):
        own = lex(text, False), lex(text, True)
        found[file, start] = compose(found[file, start], own) if (file, start) in found else own
    rows = [(f, s, *own[0], *own[1]) for (f, s), own in found.items()]
    names, kinds = ["file", "start", "open0", "deeper0", "open1", "deeper1"], [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


class _Cutter:
    """Cuts a range, whose beginning is known, into rows, parts of rows at its ends, and what is between tables."""

    def __init__(self, number: int, inside: bool, depth: int) -> None:
        self.at, self.inside, self.depth = number << 33, inside, depth
        self.row: list[str] | None = [] if depth >= ROW_DEPTH else None
        self.begun = False  # whether the open row began in this range, or any before it
        self.first = True  # whether no row has begun in this range
        self.between: list[str] = []
        self.out: list[tuple] = []

    def _put(self, kind: str, text: str) -> None:
        self.out.append((self.at, kind, text))
        self.at += 1

    def _outside(self) -> None:
        """What is between rows, but for commas; and a mark where a row begins behind it, or is the first of the range."""
        text, self.between = "".join(self.between), []
        said = bool(text.strip(" \t\r\n,"))
        if said:
            self._put("outside", text)
        if self.depth >= ROW_DEPTH and (said or self.first):
            self._put("mark", "")

    def feed(self, text: str) -> None:
        at = low = 0
        if self.inside:
            m = _END.match(text)
            at = m.end() if m else len(text)
            self.inside = not m
        for m in _TOKEN.finditer(text, at):
            c = m[0]
            if c == '"':  # a text that goes on behind this
                self.inside = True
                break
            if c in "[{":
                self.depth += 1
                if self.depth == ROW_DEPTH:
                    self.between.append(text[low : m.start()])
                    self._outside()
                    low, self.row, self.begun, self.first = m.start(), [], True, False
            elif c in "]}":
                self.depth -= 1
                if self.depth == ROW_DEPTH - 1:
                    self._put("row" if self.begun else "end", "".join([*self.row, text[low : m.end()]]))
                    low, self.row = m.end(), None
        (self.between if self.row is None else self.row).append(text[low:])

    def close(self) -> None:
        if self.row is not None:
            self._put("begin" if self.begun else "middle", "".join(self.row))
        else:
            self._outside()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, kind, text) of the pieces of ranges, whose beginnings (number, open, depth) are beside them."""
    cutter, known = None, None

    def rows() -> pa.RecordBatch:
        out, cutter.out = cutter.out, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string()))], ["at", "kind", "text"])

    for batch in batches:
        begins = {(f, s): (n, o, d) for f, s, n, o, d in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "number", "open", "depth")), strict=True)}
        for file, start, text in _texts_of(batch, known):
            if (file, start) != known:
                if cutter:
                    cutter.close()
                    yield rows()
                known, cutter = (file, start), _Cutter(*begins[file, start])
            cutter.feed(text)
        if cutter:
            yield rows()
    if cutter:
        cutter.close()
        yield rows()


def _texts_of(batch: pa.RecordBatch, known: tuple | None) -> Iterator[tuple[str, int, str]]:
    """The texts of one batch; its first range goes on if it is the one known."""
    for i, (file, start, text) in enumerate(_texts(iter([batch]))):
        yield file, start, "]" + text if not i and (file, start) == known and not start else text


def read_rows(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The document without its rows, in which ``rows`` is a list of the first one's place if there are any; and (at, text) of all rows in order."""
    pieces = spark.read.option("lineSep", "]").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    ranges = sorted(pieces.mapInArrow(_functions, "file string, start long, open0 boolean, deeper0 long, open1 boolean, deeper1 long").collect())  # a row for each range of many MB
    begins, inside, depth = [], False, 0
    for number, r in enumerate(ranges):
        begins.append((r["file"], r["start"], number, inside, depth))
        inside, deeper = (r["open1"], r["deeper1"]) if inside else (r["open0"], r["deeper0"])
        depth += deeper
    if inside or depth or not ranges:
        raise ValueError(f"{path} is no whole JSON document")
    known = F.broadcast(spark.createDataFrame(begins, "file string, start long, number int, open boolean, depth int"))  # as many rows as ranges
    cut = freeze(pieces.join(known, ["file", "start"]).mapInArrow(_cut, "at long, kind string, text string"), "document_cut")
    text = ""
    for r in cut.where("kind IN ('outside', 'mark')").orderBy("at").collect():  # what isn't rows: names of tables and columns, and a mark for each range and table
        if r["kind"] == "outside":
            text += r["text"]
        elif text.rstrip().endswith("["):
            text += str(r["at"] + 1)
    # rows that go on from range to range: at most two pieces of a range
    parts = cut.where("kind IN ('begin', 'middle', 'end')")
    number = F.sum(F.when(F.col("kind") == "begin", 1).otherwise(0)).over(Window.orderBy("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "text")))
    whole = parts.withColumn("row", number).groupBy("row").agg(F.min("at").alias("at"), F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text")).drop("row")
    return json.loads(text), cut.where("kind = 'row'").select("at", "text").unionByName(whole)
