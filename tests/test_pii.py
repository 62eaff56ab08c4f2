import pytest
import yaml

from slicewise.functions.dialect import to_spark
from slicewise.plans.pii import Confidence, analyze, format_analysis, has_noise_suffix, mask_for, name_matches, policy_yaml
from slicewise.sources.catalog import Catalog, Column, ForeignKey, Table


def one(name, *columns, key=("id",), foreign=()):
    return Table(f"public.{name}", tuple(Column(*c) for c in columns), key, foreign)


@pytest.mark.parametrize("column,names,want", [("email", "email", True), ("user_email", "email", True), ("emailed_at", "email", False), ("first_name", "firstname", True), ("shipping_first_name", "firstname", False), ("Email", "email", True)])
def test_names(column, names, want):
    assert name_matches(column, [names]) is want


def test_noise():
    assert has_noise_suffix("email_subject") and not has_noise_suffix("subject") and not has_noise_suffix("user_email")


def test_matches():
    fk = ForeignKey("f", "public.users", "public.phones", ("phone",), ("id",))
    users = one("users", ("id", "bigint"), ("email", "character varying(255)"), ("phone", "text"), ("salary", "text"), ("income", "numeric(10,2)"), ("mobile", "boolean"), ("email_template", "text"), ("dob", "date"), foreign=(fk,))
    c = Catalog(None, [users, one("phones", ("id", "bigint"))])
    got = {m.column: (m.category, m.confidence.name) for m in analyze(c)}
    assert got == {"email": ("Email", "HIGH"), "salary": ("Salary", "LOW"), "income": ("Salary", "HIGH"), "dob": ("Date of Birth", "HIGH")}
    assert {m.column for m in analyze(c, min_confidence=Confidence.parse("medium"))} == {"email", "income", "dob"}
    text = format_analysis(c, analyze(c), 2)
    assert "4 sensitive column(s) in 1 of 2 table(s)" in text and "salary (text): Salary, low confidence; mask 50000 +" in text
    policy = yaml.safe_load(policy_yaml(c, analyze(c)))
    assert policy["databases"]["default"]["columns"]["users.email"]["tags"] == ["pii"]
    assert format_analysis(c, [], 2) == "0 sensitive column(s) in 0 of 2 table(s)\n"


def test_masks_use_the_key(spark):
    two = one("t", ("a", "integer"), ("b", "text"), ("phone", "text"), key=("a", "b"))
    expr = analyze(Catalog(None, [two]))[0].mask
    got = spark.sql(f"SELECT {expr} AS m FROM (SELECT 1 AS a, 'x' AS b)").first()["m"]
    assert got.startswith("+1555") and len(got) == 12
    assert mask_for("{pk} {pki}", one("n", ("x", "text"), key=())) == "'0' 0"
    with pytest.raises(ValueError):
        Confidence.parse("sure")


@pytest.mark.parametrize("postgres,want", [("'a::text' || id::text", "a::text7"), ("\"id\" || 'x''y'", "7x'y"), ("LPAD((id % 10)::text, 3, '0')", "007"), ("('1990-01-01'::date + (id % 10))::text", "1990-01-08"), ("(ABS(hashtext(id::text)) >= 0)::text", "true"), ("'a\\b'", "a\\b"), ("'abs(hashtext(x))' || id::varchar(9)", "abs(hashtext(x))7"), ("cast(id AS text) || ' AS text)'", "7 AS text)"), ("(id::numeric(6,2))::text", "7.00"), ("(id::double precision / 2)::text", "3.5"), ("('2024-01-02 03:04:05'::timestamp without time zone)::text", "2024-01-02 03:04:05"), ("('2024-01-02 03:04:05Z'::timestamptz)::text", "2024-01-02 03:04:05"), ("'{\"a\": 1}'::jsonb::text", '{"a": 1}'), ("(1 + hashtext('x') - hashtext('x'))::text", "1"), ("(id::numeric * 10000000000000000000000)::text", None)])
def test_dialect(spark, postgres, want):
    got = spark.sql(f"SELECT {to_spark(postgres)} AS x FROM (SELECT 7 AS id)").first()["x"]
    assert got == want if want is not None else float(got) == 7e22
