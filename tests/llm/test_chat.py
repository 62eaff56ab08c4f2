import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from slicewise.llm.chat import TEMPLATE, digest, format_conversations, read_back
from slicewise.llm.queries import ORACLE_SQL, op10_chat_format
from slicewise.llm.templates import Const, Show, TemplateError, compile_template, escape, fold, parse, unescape

RENDER = compile_template(TEMPLATE)
texts = st.text(st.sampled_from("ab\\<|>#\n {}%é漢") | st.characters(codec="utf-8"), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a|b", "<x>", ""]), texts), min_size=1, max_size=5))
def test_round_trip(turns):
    text, spans = RENDER(messages=[{"role": r, "text": t} for r, t in turns])
    assert read_back(text) == turns
    assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@given(texts)
def test_escape(text):
    assert unescape(escape(text, "<|")) == text


@pytest.mark.parametrize(
    "template,want",
    [
        ("{{ 1 + 2 * 3 }}", "7"), ("{{ 'a' ~ 1 ~ true ~ none }}", "a1true"), ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", "1a,2b"),
        ("{% if n > 5 %}big{% elif n == 5 %}five{% else %}small{% endif %}", "five"), ("{% set y = n + 1 %}{{ y }}", "6"), ("a {{- 'b' -}} c", "abc"), ("{# no #}x", "x"),
        ("{{ d.k }}{{ d['k'] }}{{ d.none_here }}{{ xs[0] }}{{ xs[9] }}", "vva"), ("{{ 'x' if 'a' in xs else 'y' }}", "x"),
        ("{{ '  Ab ' | trim | upper | replace('A', 'c') | lower }}", "cb"), ("{{ xs | join('-') }}{{ xs | length }}{{ 'ab' | capitalize }}", "a-b2Ab"), ("{{ 0 or 'z' }}{{ 1 and 'w' }}{{ -n }}{{ 7 % 4 }}", "zw-53"),
    ],
)
def test_language(template, want):
    assert compile_template(template)(n=5, xs=["a", "b"], d={"k": "v"})[0] == want


@pytest.mark.parametrize("bad", ["{{ x.y( ) }}", "{{ x | nothing }}", "{% for x %}{% endfor %}", "{% if a %}", "{% exec 'x' %}", "{{ a b }}", "{{ }}", "{{ 'a' + 1 }}", "{% endif %}", "{{ import }} {% import os %}"])
def test_refused(bad):
    with pytest.raises(TemplateError):
        compile_template(bad)(a=1)


def test_sandbox():
    assert compile_template("{{ x.__class__ }}{{ x.upper }}{{ d.items }}")(x="text", d={})[0] == ""


def test_folding():
    assert fold(parse('a{% if 1 + 1 == 2 %}{{ "x" | upper }}{% else %}b{% endif %}{% if false and y %}c{% endif %}d')) == [Show(Const("aXd"))]


def test_conversations(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 2, "assistant", "c"), (1, 0, "system", "s<|end|>"), (1, 1, "user", None), (-7, 0, "user", said), (-7, 1, "assistant", said), (None, 0, None, "lost"), (3, None, "assistant", ""), (3, 1, "assistant", "x"), (3, 1, "assistant", "x"), (4, 0, "user", "y" * 300_000)]
    df = spark.createDataFrame([(*r, "z", "w") for r in rows], "conv_id long, turn long, role string, text string, conv string, formatted string").repartition(3)
    cut = format_conversations(df)
    assert cut.columns == ["conv_id", "formatted", "spans"]
    got = {r.conv_id: r for r in digest(cut).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("system\ns<|end|>\nuser\n\nassistant\nc\n") and (got[1].loss_chars, got[1].loss_sha256) == (1, sha("c"))
    assert got[-7].loss_sha256 == sha(said) and got[-7].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n")
    assert got[None].turns_sha256 == sha("\nlost\n") and got[3].n_turns == 3 and got[3].loss_sha256 == sha("xx") and got[4].n_turns == 1
    assert digest(format_conversations(df.limit(0))).count() == 0


def test_query_against_its_sql(spark, tmp_path):
    """Null turns, roles and texts, repeated turns and marks inside texts, through the query and its SQL."""
    rows = [(1, None, "assistant", "first"), (1, 0, None, "s"), (1, 1, "user", None), (1, 1, "assistant", "a<|end|>\\b"), (1, 1, "assistant", "a<|end|>\\b"), (2, None, None, None), (3, 5, "assistant", ""), (4, 2, "user", "größe 漢字 |<"), (4, 1, "a|b", "x\n")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op10_chat_format"]).fetchall())
    assert sorted(tuple(r) for r in op10_chat_format(spark, str(tmp_path)).collect()) == want and len(want) == 5
