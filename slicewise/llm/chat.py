"""Formatting conversations with a compiled template, and reading them back.

Turns of one conversation meet by a shuffle on its id and are streamed in turn
order; a task holds one conversation at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .templates import compile_template, unescape

#: marks turns as <|role|>text<|end|>; inside texts and roles a backslash goes
#: before each backslash, "<" and (in roles) "|", so no text can hold a mark
TEMPLATE = """{% for message in messages -%}
<|{{ message.role | escape("<|") }}|>
{%- if message.role == "assistant" %}{% generation %}{{ message.text | escape("<") }}{% endgeneration %}
{%- else %}{{ message.text | escape("<") }}{% endif %}<|end|>
{% endfor %}"""

TURN = re.compile(r"<\|((?:\\.|[^\\<|])*)\|>((?:\\.|[^\\<])*)<\|end\|>\n", re.S)


def format_conversations(turns: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, formatted, spans (start and end, in code points).

    ``spans`` are what the template's generation blocks wrote. Turns are ordered
    by turn, then role and text, nulls first; a null text or role is empty;
    repeated rows are separate turns; a null id is a conversation of its own.
    Extra columns are ignored; an empty table gives an empty result.
    """
    rows = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").drop("turn")
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        ids, formatted, spans = [], [], []
        current: list[dict[str, str]] = []
        last = None

        def finish() -> None:
            text, found = render(messages=current)
            ids.append(last)
            formatted.append(text)
            spans.append([{"start": a, "end": b} for a, b in found])

        def flush(schema: pa.DataType) -> pa.RecordBatch:
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            out = pa.RecordBatch.from_arrays([pa.array(ids, schema), pa.array(formatted, pa.string()), pa.array(spans, span)], ["conv", "formatted", "spans"])
            for x in (ids, formatted, spans):
                x.clear()
            return out

        schema = None
        for batch in batches:
            schema = batch.schema.field("conv").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                if current and conv != last:
                    finish()
                    current.clear()
                last = conv
                current.append({"role": role, "text": text})
            yield flush(schema)
        if current:
            finish()
            yield flush(schema)

    out = rows.mapInArrow(run, f"conv {kind}, formatted string, spans array<struct<start: long, end: long>>")
    return out.select(F.col("conv").alias(id_col), "formatted", "spans")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text in the standard template."""
    out, at = [], 0
    while at < len(formatted):
        turn = TURN.match(formatted, at)
        if not turn:
            raise ValueError(f"not a formatted conversation from {at}")
        out.append((unescape(turn[1]), unescape(turn[2])))
        at = turn.end()
    return out


def digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Counts and hashes of what ``read_back`` and the spans give."""
    rows = formatted.select(F.col(id_col).alias("conv"), "formatted", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[x["start"] : x["end"]]) for x in spans)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                for column, value in zip(found, (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    column.append(value)
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *(pa.array(x, t) for x, t in zip(found, types, strict=True))], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = rows.schema["conv"].dataType.simpleString()
    out = rows.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("conv", id_col)
