import random
import textwrap

import duckdb
import odd
import pytest
from slicewise.llm.licenses import TEMPLATES, Matcher, oracle_sql, order_templates, scan_licenses, tokens
from slicewise.llm.queries import op9_license_scan


def test_matcher_finds_every_block():
    """Against every run of consecutive words, for rare and common tokens and several thresholds."""
    rng = random.Random(5)
    for threshold in (0.5, 0.8, 1.0):
        templates = [(f"t{i}", " ".join(rng.choices(odd.WORDS, k=rng.randrange(2, 12)))) for i in range(12)]
        counts = {w.encode(): rng.randrange(9) for w in odd.WORDS}
        ordered, rank = order_templates(templates, counts, threshold)
        matcher = Matcher(ordered, rank, {})
        for _ in range(300):
            found = tokens(" ".join(rng.choices([*odd.WORDS, "other", "words"], k=rng.randrange(60))).encode())
            got = matcher.blocks(found)
            for t in ordered:
                sizes = {i: len(set(found[i : i + t.span]) & set(t.tokens)) for i in range(len(found)) if found[i] in t.tokens}
                want = [i for i, n in sizes.items() if n >= t.needed]
                mine = [b for b in got if b["label"] == t.label]
                assert bool(want) == bool(mine)
                if want:
                    assert max(b["containment"] for b in mine) == max(sizes.values()) / len(t.tokens)
                    assert all(len(set(found[b["start"] : b["start"] + t.span]) & set(t.tokens)) >= b["containment"] * len(t.tokens) - 1e-9 for b in mine)
                    # every run that matches overlaps one that is given, whose start may have moved on to its last first word
                    assert all(any(abs(i - b["start"]) < 2 * t.span for b in mine) for i in want)


def test_documents(spark):
    texts = [(1, "Hello\nLicensed under the Apache License, Version 2.0.\nbye"), (2, "cc by, CC-BY ccby"), (3, "all rights\nreserved and the general\npublic license"), (4, None), (5, ""), (6, "Released%%% under!! the MIT, License"), (7, "ALL RIGHTS RESERVED"), (7, "ALL RIGHTS RESERVED"), (None, "größe cc by"), (8, "x " * 30000 + "cc by")]
    df = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, id int, places int")
    got = {(r.doc_id, r.n_words): r for r in scan_licenses(df).collect()}
    assert [b.label for b in got[1, 10].blocks] == ["apache-2.0"] and got[1, 10].blocks[0].start == 1 and got[1, 10].blocks[0].containment == 1.0
    assert [(p.label, p.start) for p in got[2, 5].places] == [("cc-by", 0), ("cc-by", 2)]
    assert sorted((p.label, p.start) for p in got[3, 8].places) == [("gpl", 5), ("reserved", 0)]
    assert got[4, 0].places == [] and got[5, 0].blocks == []
    assert [b.label for b in got[6, 5].blocks] == ["mit"]
    assert got[7, 3].places[0].label == "reserved" and scan_licenses(df).count() == len(texts)
    assert got[None, 2].places == []  # a no-break space isn't a separator
    assert got[8, 30002].places[0].start == 30000
    assert scan_licenses(odd.empty(spark)).count() == 0


def test_templates_match_themselves():
    matcher = Matcher(*order_templates(TEMPLATES, {}, 0.8), {})
    for label, text in TEMPLATES:
        # a block starts at the last place from which it holds as much
        assert any(b["label"] == label and b["containment"] == 1.0 for b in matcher.blocks(tokens(text.encode())))


def test_wrapped_notices(spark):
    """Every template is found however its lines are broken; scattered words are no notice."""
    rows = [(width * 100 + i, "intro words\n" + "\n".join(f" * {x}" for x in textwrap.wrap(text, width, break_long_words=False)) + "\nmore") for width in (12, 30, 60) for i, (_, text) in enumerate(TEMPLATES)]
    rows += [(1, "it was released " + "word " * 9 + "under a tree, the " + "word " * 9 + "license"), (2, None), (3, ""), (4, "\n".join([TEMPLATES[1][1]] * 3))]
    got = {r.doc_id: [(b.label, b.start, b.containment) for b in r.blocks] for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for width in (12, 30, 60):
        for i, (label, _) in enumerate(TEMPLATES):
            assert any(b[0] == label and b[1] >= 2 and b[2] == 1.0 for b in got[width * 100 + i])
            assert i > 10 or (label, 2, 1.0) in got[width * 100 + i]  # the short ones have no word twice at the beginning
    assert got[1] == got[2] == got[3] == []
    assert got[4] == [("mit", 0, 1.0), ("mit", 5, 1.0), ("mit", 10, 1.0)]


def test_query_against_its_sql(spark, tmp_path):
    """Wrapped and partial notices, and long lines with scattered words, through the query and its SQL."""
    rng = random.Random(7)
    texts = []
    for i in range(120):
        label, notice = TEMPLATES[i % len(TEMPLATES)]
        kept = " ".join(w for w in notice.split() if rng.random() > (0, 0.1, 0.25)[i % 3])
        texts.append((i, odd.prose(i, 20) + "\n" + "\n".join("# " + x for x in textwrap.wrap(kept, rng.choice([15, 40, 200]))) + "\n" + odd.prose(i + 500, 5)))
    texts += [(200, "released " * 3 + "and " * 30 + "under the license"), (201, None), (202, ""), (203, "CC-BY all rights\nreserved"), (204, "the " * 3000 + TEMPLATES[1][1])]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(oracle_sql()).fetchall())
    got = sorted(tuple(r) for r in op9_license_scan(spark, str(tmp_path)).collect())
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert [r[7] for r in got] == pytest.approx([r[7] for r in want])
    assert sum(bool(r[6]) for r in got) > 70 and got[120][6] == ""
