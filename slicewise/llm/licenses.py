"""License scans: exact set-similarity search of text blocks against templates.

A block is a run of consecutive words, whatever the line feeds between them, of at
most SPAN times a template's words. It matches the template when it holds at least
``threshold`` of its distinct tokens. Tokens are ordered by how many documents of the
whole corpus hold them, rarest first. A template of n tokens of which c are needed
can only match a block that shares one of its n - c + 1 first tokens (prefix filter);
the text needs c tokens of the template at all (length filter); and around a place
of a shared token a block in which it is the first has only tokens that follow it in
the order, of which the neighbourhood must hold enough (positional filter). In what
is left every run is counted exactly, so that no block is lost, and a notice wrapped
over lines or between comment marks is found like one on a line of its own, while
words scattered over a long line are none.

Only the templates, their vocabulary and its counts travel: their size depends
on the templates, not on the corpus. Besides blocks, places where the words of
a phrase stand consecutively are found.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .tables import text_or_empty

# fixed values: phrases and notices, with the labels they stand for
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc0-1.0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "mit",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
]

#: words that a block may take for each of its template's
SPAN = 1.5

#: A-Z to a-z; what separates words, line feeds included, to a space
_TO_WORDS = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words in order: runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased."""
    return text.translate(_TO_WORDS).split()


@dataclass
class Template:
    label: str
    tokens: list[bytes]  # in global order
    needed: int
    span: int = 0  # words that a block may take


def order_templates(templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float) -> tuple[list[Template], dict[bytes, int]]:
    """Templates with tokens in the global order, and each token's place in it."""
    lists = [(label, tokens(text.encode())) for label, text in templates]
    vocabulary = sorted({x for _, found in lists for x in found}, key=lambda x: (counts.get(x, 0), x))
    rank = {x: i for i, x in enumerate(vocabulary)}
    return [Template(label, sorted(set(found), key=rank.get), max(1, math.ceil(threshold * len(set(found)) - 1e-9)), math.floor(SPAN * len(found))) for label, found in lists if found], rank


class Matcher:
    def __init__(self, templates: list[Template], rank: dict[bytes, int], phrases: dict[str, str]) -> None:
        self.templates, self.rank = templates, rank
        self.prefixes = [t.tokens[: len(t.tokens) - t.needed + 1] for t in templates]
        self.phrases = [(tokens(phrase.encode()), label) for phrase, label in phrases.items()]
        self.triggers = frozenset().union(*self.prefixes) | {phrase[0] for phrase, _ in self.phrases}

    def places(self, found: list[bytes]) -> list[dict]:
        out = []
        for phrase, label in self.phrases:
            at = -1
            while True:
                try:
                    at = found.index(phrase[0], at + 1)
                except ValueError:
                    break
                if found[at : at + len(phrase)] == phrase:
                    out.append({"label": label, "start": at})
        return out

    def blocks(self, found: list[bytes]) -> list[dict]:
        """The runs of at most ``span`` words that hold a template. Of runs that overlap the
        fullest counts, then the first; it starts at the last place from which it holds as much."""
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, word in enumerate(found):
            if word in self.rank:
                places[word].append(i)
        out = []
        for template, prefix in zip(self.templates, self.prefixes, strict=True):
            # a run can't hold more than the whole text
            if sum(x in places for x in template.tokens) < template.needed or not any(x in places for x in prefix):
                continue
            held = sorted((i, order) for order, x in enumerate(template.tokens) for i in places.get(x, ()))
            mine = []
            for low, high in self._near(held, template):
                mine += self._fullest([i for i, _ in held[low:high]], [order for _, order in held[low:high]], template)
            out += sorted(mine, key=lambda x: x["start"])
        return out

    def _near(self, held: list[tuple[int, int]], template: Template) -> list[tuple[int, int]]:
        """Stretches of (place, order) around prefix tokens with enough tokens that aren't before
        them in the order. A run that matches lies within that of the first of its tokens."""
        out: list[tuple[int, int]] = []
        low = high = 0
        last = len(template.tokens) - template.needed
        for place, order in held:
            if order > last:
                continue
            while held[low][0] <= place - template.span:
                low += 1
            while high < len(held) and held[high][0] < place + template.span:
                high += 1
            if len({x for _, x in held[low:high] if x >= order}) >= template.needed:
                out.append((out.pop()[0] if out and out[-1][1] >= low else low, high))
        return out

    def _fullest(self, at: list[int], held: list[int], template: Template) -> list[dict]:
        full = self._run_sizes(held, at, template.span)
        taken, out = bytearray(len(at)), []
        for a in sorted((a for a in range(len(at)) if full[a] >= template.needed), key=lambda a: (-full[a], a)):
            end = self._run_end(held, a, full[a])
            if any(taken[a : end + 1]):
                continue
            taken[a : end + 1] = b"\x01" * (end + 1 - a)
            rest, start = Counter(held[a : end + 1]), a
            while rest[held[start]] > 1:  # a word that comes again isn't needed at the beginning
                rest[held[start]] -= 1
                start += 1
            out.append({"label": template.label, "start": at[start], "containment": full[a] / len(template.tokens)})
        return out

    @staticmethod
    def _run_sizes(held: list[int], at: list[int], span: int) -> list[int]:
        """For each place how many different tokens the run of ``span`` words from it on holds."""
        out, inside, end = [], Counter(), 0
        for a in range(len(at)):
            while end < len(at) and at[end] < at[a] + span:
                inside[held[end]] += 1
                end += 1
            out.append(len(inside))
            inside[held[a]] -= 1
            if not inside[held[a]]:
                del inside[held[a]]
        return out

    @staticmethod
    def _run_end(held: list[int], a: int, size: int) -> int:
        """The first place by which the run from ``a`` on holds ``size`` different tokens."""
        seen: set[int] = set()
        for end in range(a, len(held)):
            seen.add(held[end])
            if len(seen) == size:
                break
        return end


def _counts(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in words.texts(batch.column("text")):
                seen.update(vocabulary.intersection(tokens(text.tobytes())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "docs"])

    return run


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, places, blocks.

    ``places`` are (label, start) of the phrases; ``blocks`` are (label, start,
    containment) of the runs of consecutive words that hold a template, line feeds or
    not; starts are counted in words from 0. A text may hold several templates, and one
    several times; where blocks of one template overlap the fullest counts, then the
    first. Null and empty texts have no words; repeated rows are scanned like
    others; extra columns are ignored; an empty table gives an empty result. Long
    texts are matched whole.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    vocabulary = frozenset().union(*(tokens(text.encode()) for _, text in templates))
    counted = source.select("text").mapInArrow(_counts(vocabulary), "token binary, docs long")
    # one row per template token at most
    counts = {bytes(r[0]): r[1] for r in counted.groupBy("token").agg(F.sum("docs")).collect()}
    ordered, rank = order_templates(templates, counts, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(ordered, rank, phrases)
        place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
        block = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("containment", pa.float64())]))
        for batch in batches:
            sizes, places, blocks = [], [], []
            for text in words.texts(batch.column("text")):
                found = tokens(text.tobytes())
                sizes.append(len(found))
                hit = not matcher.triggers.isdisjoint(found)
                places.append(matcher.places(found) if hit else [])
                blocks.append(matcher.blocks(found) if hit else [])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(places, place), pa.array(blocks, block)], ["id", "n_words", "places", "blocks"])

    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, n_words long, places array<struct<label: string, start: long>>, blocks array<struct<label: string, start: long, containment: double>>")
    return out.withColumnRenamed("id", id_col)


def oracle_sql(threshold: float = 0.8) -> str:
    """DuckDB SQL for the digest of ``scan_licenses`` over documents."""
    quoted = lambda values: ", ".join(f"'{v}'" for v in values)
    known, held = [], []
    for number, (label, text) in enumerate(TEMPLATES):
        spoken = tokens(text.encode())
        own = sorted({t.decode() for t in spoken})
        known.append(f"({number}, '{label}', {len(own)}, {max(1, math.ceil(threshold * len(own) - 1e-9))}, {math.floor(SPAN * len(spoken))})")
        held += [f"({number}, '{x}')" for x in own]
    spoken = [f"('{label}', [{quoted(phrase.split())}])" for phrase, label in PHRASES.items()]
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
        WITH templates(number, label, size, needed, span) AS (VALUES {", ".join(known)}),
        tokens(number, token) AS (VALUES {", ".join(held)}),
        phrases(label, spoken) AS (VALUES {", ".join(spoken)}),
        worded AS (SELECT doc_id, regexp_extract_all({lower}, {word}) AS ws FROM documents),
        places AS (
            SELECT doc_id, label, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1 : i + len(spoken)] = spoken)) AS start
            FROM worded, phrases
        ),
        base AS (
            SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS found
            FROM places GROUP BY doc_id
        ),
        words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM worded),
        hits AS (SELECT doc_id, number, token, place FROM words JOIN tokens ON word = token),
        enough AS (
            SELECT doc_id, number, any_value(span) AS span, any_value(needed) AS needed, any_value(size) AS size, any_value(label) AS label
            FROM hits JOIN templates USING (number) GROUP BY doc_id, number HAVING count(DISTINCT token) >= any_value(needed)
        ),
        runs AS (
            SELECT a.doc_id, a.number, a.place, e.label, e.size, e.needed, count(DISTINCT b.token) AS held
            FROM enough e JOIN hits a USING (doc_id, number)
            JOIN hits b ON b.doc_id = a.doc_id AND b.number = a.number AND b.place >= a.place AND b.place < a.place + e.span
            GROUP BY ALL
        ),
        matched AS (SELECT doc_id, list(DISTINCT label) AS found, max(held / size) AS share FROM runs WHERE held >= needed GROUP BY doc_id)
        SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(array_to_string(list_sort(b.found), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(coalesce(b.found, []) || coalesce(m.found, []))), ','), '') AS labels,
               CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(m.share, 0) END AS DOUBLE) AS score
        FROM worded w LEFT JOIN base b USING (doc_id) LEFT JOIN matched m USING (doc_id)
    """
