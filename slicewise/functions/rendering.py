"""Values as text: for JSON slices, for SQL literals and for COPY files; and back.

All are column expressions, so rows are rendered where they are. Moments are
written in UTC, whatever the session's zone is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quoting import quote_columns, quote_table


def uuid_text(binary: Column) -> Column:
    """16 bytes as lower-case 8-4-4-4-12."""
    return F.regexp_replace(F.lower(F.hex(binary)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def utc_clock(moment: Column, spark_type: str = "timestamp") -> Column:
    """A moment as date and time in UTC; a value without zone stays as it is."""
    if spark_type != "timestamp":
        return moment
    return F.timestamp_add("MICROSECOND", F.unix_micros(moment), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))


def clock_text(moment: Column, spark_type: str, between: str = " ", micros: bool = True) -> Column:
    """Date and time of a moment in UTC; by a cast, since ``date_format`` reads a value without zone in the session's."""
    text = utc_clock(moment, spark_type).cast("string")
    whole = F.concat(F.substring(text, 1, 10), F.lit(between), F.substring(text, 12, 8))
    return F.concat(whole, F.lit("."), F.rpad(F.substring(text, 21, 6), 6, "0")) if micros else whole


def rfc3339_seconds(timestamp: Column, spark_type: str = "timestamp_ntz") -> Column:
    """Seconds precision, fractions dropped."""
    return F.concat(clock_text(timestamp, spark_type, "T", False), F.lit("Z"))


def bytea_text(binary: Column) -> Column:
    return F.concat(F.lit("\\x"), F.lower(F.hex(binary)))


def inet_text(text: Column) -> Column:
    """The mask of a single host is left out."""
    return F.regexp_replace(text, r"^([^:]*)/32$|^(.*:.*)/128$", "$1$2")


def interval_text(months: Column, days: Column, micros: Column) -> Column:
    """``N mons M days HH:MM:SS[.ffffff]``; ``00:00:00`` for nothing; a sign on the time part only."""
    size = F.abs(micros)
    clock = F.format_string("%02d:%02d:%02d", F.floor(size / 3_600_000_000).cast("long"), F.floor(size % 3_600_000_000 / 60_000_000).cast("long"), F.floor(size % 60_000_000 / 1_000_000).cast("long"))
    fraction = F.when(size % 1_000_000 != 0, F.regexp_replace(F.format_string(".%06d", (size % 1_000_000).cast("long")), "0+$", "")).otherwise("")
    time = F.when(micros != 0, F.concat(F.when(micros < 0, F.lit("-")).otherwise(""), clock, fraction))

    def part(n: Column, unit: str) -> Column:
        return F.when(n != 0, F.concat(n.cast("string"), F.when(F.abs(n) == 1, F.lit(f" {unit}")).otherwise(f" {unit}s")))

    whole = F.concat_ws(" ", part(months, "mon"), part(days, "day"), time)
    return F.when(months.isNull() | days.isNull() | micros.isNull(), F.lit(None)).otherwise(F.when(whole == "", "00:00:00").otherwise(whole))


def interval_value(column: Column, spark_type: str) -> Column:
    """A column of an interval type as ``interval_text``."""
    none = F.lit(0)
    part = lambda whole, unit: F.extract(F.lit(unit), whole)
    if spark_type == "interval" or "year" in spark_type or "month" in spark_type:
        whole = column if spark_type == "interval" else column.cast("interval year to month")
        months = part(whole, "YEARS") * 12 + part(whole, "MONTHS")
    else:
        months = F.when(column.isNotNull(), none)
    if spark_type == "interval" or not ("year" in spark_type or "month" in spark_type):
        whole = column if spark_type == "interval" else column.cast("interval day to second")
        days = part(whole, "DAYS").cast("int")
        micros = ((part(whole, "HOURS") * 60 + part(whole, "MINUTES")).cast("long") * 60_000_000) + (part(whole, "SECONDS") * 1_000_000).cast("long")
    else:
        days, micros = none, none
    return interval_text(months.cast("int"), days, micros.cast("long"))


def array_text(column: Column, spark_type: str, logical: str = "") -> Column:
    """An array as ``{a,"b, c",NULL}``: elements that could be read as something else are quoted."""
    element = spark_type[len("array<") : -1]

    def one(x: Column) -> Column:
        text = rendered(x, element, logical).cast("string")
        if not element.startswith("array"):
            odd = text.rlike(r'[{}",\\\s]') | (text == "") | (F.upper(text) == "NULL")
            escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
            text = F.when(odd, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(text)
        return F.coalesce(text, F.lit("NULL"))

    return F.when(column.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(column, one), ","), F.lit("}")))


def rendered(column: Column, spark_type: str, logical: str = "", seconds_only: bool = False) -> Column:
    """A value as the JSON form of a slice states it: numbers and booleans stay, the rest is text."""
    if spark_type in ("tinyint", "smallint", "int", "bigint", "boolean", "string"):
        return inet_text(column) if logical in ("inet", "cidr") else column
    if spark_type in ("float", "double"):
        odd = F.isnan(column) | (F.abs(column) == float("inf"))
        return F.when(odd, F.lit(None)).otherwise(column)  # JSON has no such numbers
    if spark_type.startswith("decimal") or spark_type == "date":
        return column.cast("string")
    if spark_type.startswith("timestamp"):
        return F.concat(clock_text(column, spark_type, "T", not seconds_only), F.lit("Z"))
    if spark_type.startswith("interval"):
        return interval_value(column, spark_type)
    if spark_type == "binary":
        return uuid_text(column) if logical == "uuid" else bytea_text(column)
    if spark_type.startswith("array"):
        return array_text(column, spark_type)
    if spark_type.startswith(("map", "struct")):
        return F.to_json(column)
    return column.cast("string")


def inner_arrays(text: Column) -> Column:
    """The elements of an array of arrays, as text: what is between the commas one brace deep.

    A state (depth, the element so far, the elements) goes over the text's tokens, which are quoted
    texts, braces, commas and what is between them; so braces and commas in quotes are no structure.
    """
    tokens = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*"|[{},]|[^{},"]+'), F.lit(0))
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(0).alias("depth"), none.alias("open"), F.array().cast("array<string>").alias("done"))

    def step(state: Column, token: Column) -> Column:
        deeper = F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        depth = state["depth"] + deeper
        outer = ((state["depth"] == 0) & (token == "{")) | ((state["depth"] == 1) & (token == "}"))  # the braces of the whole
        ends = (state["depth"] == 1) & ((token == ",") | (token == "}"))
        grown = F.concat(F.coalesce(state["open"], F.lit("")), token)
        done = F.when(ends & state["open"].isNotNull(), F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        return F.struct(depth.alias("depth"), F.when(ends | outer, none).otherwise(grown).alias("open"), done.alias("done"))

    return F.aggregate(tokens, start, step, lambda state: state["done"])


def parsed(text: Column, spark_type: str) -> Column:
    """What ``rendered`` states, as a value of its type again."""
    if spark_type == "binary":
        uuid = F.replace(text, F.lit("-"), F.lit(""))
        return F.unhex(F.when(text.startswith("\\x"), F.substring(text, 3, 1 << 30)).otherwise(uuid))
    if spark_type == "timestamp_ntz":
        return F.regexp_replace(text, "Z$", "").cast(spark_type)
    if spark_type.startswith("interval"):
        unit = lambda name: F.coalesce(F.regexp_extract(text, rf"(-?\d+) {name}s?\b", 1).try_cast("int"), F.lit(0))
        if "year" in spark_type or "month" in spark_type:
            return F.when(text.isNotNull(), F.make_ym_interval(F.lit(0), unit("mon")).cast(spark_type))
        sign = F.when(text.rlike(r"(^| )-\d+:"), -1).otherwise(1)
        clock = lambda i, kind: F.coalesce(F.regexp_extract(text, r"(\d+):(\d+):(\d+(?:\.\d+)?)", i).try_cast(kind), F.lit(0).cast(kind)) * sign
        if spark_type == "interval":
            return F.when(text.isNotNull(), F.make_interval(F.lit(0), unit("mon"), F.lit(0), unit("day"), clock(1, "int"), clock(2, "int"), clock(3, "decimal(18,6)")))
        return F.when(text.isNotNull(), F.make_dt_interval(unit("day"), clock(1, "int"), clock(2, "int"), clock(3, "decimal(18,6)")).cast(spark_type))
    if spark_type.startswith(("map", "struct")):
        return F.from_json(text, spark_type)
    if spark_type.startswith("array<"):
        element = spark_type[len("array<") : -1]
        quoted = lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1")
        value = lambda x: F.when(x.startswith('"'), quoted(x)).when(F.upper(x) != "NULL", x)
        if element.startswith("array"):
            return F.when(text.isNotNull(), F.transform(inner_arrays(text), lambda x: parsed(F.when(F.upper(x) != "NULL", x), element)))
        parts = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*"|[^,{}]+'), F.lit(0))
        return F.when(text.isNotNull(), F.transform(parts, lambda x: parsed(value(x), element)))
    return text.cast(spark_type)


def quote_literal(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def sql_literal(column: Column, spark_type: str) -> Column:
    """A PostgreSQL literal: NULL, TRUE/FALSE, plain numbers, quoted text."""
    if spark_type == "boolean":
        text = F.when(column, "TRUE").otherwise("FALSE")
    elif spark_type in ("tinyint", "smallint", "int", "bigint") or spark_type.startswith("decimal"):
        text = column.cast("string")
    elif spark_type in ("float", "double"):
        plain = F.regexp_replace(column.cast("string"), r"\.0$", "")
        odd = F.isnan(column) | (F.abs(column) == float("inf"))
        text = F.when(odd, quote_literal(column.cast("string"))).otherwise(plain)
    elif spark_type == "binary":
        text = F.concat(quote_literal(bytea_text(column)), F.lit("::bytea"))
    elif spark_type.startswith("timestamp"):
        zone = "+00" if spark_type == "timestamp" else ""
        text = quote_literal(F.concat(clock_text(column, spark_type), F.lit(zone)))
    else:
        text = quote_literal(rendered(column, spark_type).cast("string"))
    return F.when(column.isNull(), "NULL").otherwise(text)


def insert_statements(df: DataFrame, table: str, identity: bool = False, on_conflict_do_nothing: bool = False) -> DataFrame:
    """One INSERT statement per row, column ``value``."""
    head = f"INSERT INTO {quote_table(table)} ({quote_columns(df.columns)}){' OVERRIDING SYSTEM VALUE' if identity else ''} VALUES ("
    tail = ")" + (" ON CONFLICT DO NOTHING" if on_conflict_do_nothing else "") + ";"
    literals = [sql_literal(F.col(f"`{c}`"), t) for c, t in df.dtypes]
    return df.select(F.concat(F.lit(head), F.concat_ws(", ", *literals), F.lit(tail)).alias("value"))


def escape_copy(text: Column) -> Column:
    """Backslash, tab, line feed and carriage return as COPY text wants them."""
    out = text
    for plain, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def copy_lines(df: DataFrame) -> DataFrame:
    """One line of a COPY text file per row, column ``value``; null is ``\\N``."""
    fields = [F.coalesce(escape_copy(rendered(F.col(f"`{c}`"), t).cast("string")), F.lit("\\N")) for c, t in df.dtypes]
    return df.select(F.concat_ws("\t", *fields).alias("value"))
