"""Columns that look like personal data, by name and type, with masks for them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from enum import IntEnum

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..functions.quoting import backtick
from ..sources.catalog import Catalog, Column, Table, short, split_name
from .graph import load_order


class Confidence(IntEnum):
    LOW = 30
    MED = 60
    HIGH = 90

    @classmethod
    def parse(cls, text: str) -> Confidence:
        names = {"low": cls.LOW, "medium": cls.MED, "med": cls.MED, "high": cls.HIGH}
        if text.lower() not in names:
            raise ValueError(f"confidence is low, medium or high, not {text!r}")
        return names[text.lower()]


TEXT = ("character varying", "varchar", "text", "char", "citext")
NUMERIC = ("integer", "bigint", "smallint", "numeric", "double precision", "real")
DATES = ("date", "timestamp")
INTEGERS = ("integer", "bigint", "smallint")

# fixed values: category, column names, types, mask; {pk} is the primary key as text, {pki} as a number
RULES = [
    ("Email", "email emailaddress", TEXT, "'user_' || {pk} || '@test.com'"),
    ("Phone", "phone mobile telephone cell", TEXT, "'+1555' || lpad(cast({pki} % 10000000 as string), 7, '0')"),
    ("First Name", "firstname fname given forename givenname jmeno prenom vorname voornaam", TEXT, "'First' || {pk}"),
    ("Last Name", "lastname lname surname familyname vorname nachname prijmeni", TEXT, "'Last' || {pk}"),
    ("Full Name", "fullname displayname", TEXT, "'User ' || {pk}"),
    ("Username", "username loginname screenname", TEXT, "'user' || {pk}"),
    ("Password", "password passwd pwd passhash pwhash", TEXT, "'$2a$10$abcdefghijklmnopqrstuuABCDEFGHIJKLMNOPQRSTUVWX'"),
    ("Date of Birth", "dob birthdate dateofbirth birthday geburtsdatum date_naissance datum_narozeni", DATES, "date_add(DATE'1990-01-01', cast({pki} % 10000 as int))"),
    ("Address", "address street addr address1 address2 adresse strasse adresa ulice", TEXT, "{pk} || ' Test Street'"),
    ("City", "city town municipality stadt ville mesto", TEXT, "'TestCity'"),
    ("State", "state province region land", TEXT, "'TS'"),
    ("Zip Code", "zip postal postcode zipcode psc plz", TEXT, "lpad(cast({pki} % 100000 as string), 5, '0')"),
    ("Country", "country countrycode zeme land", TEXT, "'US'"),
    ("Latitude", "lat latitude", NUMERIC, "37.0 + ({pki} % 100) * 0.01"),
    ("Longitude", "lon lng longitude", NUMERIC, "-122.0 + ({pki} % 100) * 0.01"),
    ("Credit Card", "creditcard ccnumber cardnumber pan", TEXT, "'4532000000' || lpad(cast({pki} % 10000 as string), 4, '0')"),
    ("CVV", "cvv cvc cardcode", TEXT, "lpad(cast({pki} % 1000 as string), 3, '0')"),
    ("Bank Account", "accountnumber bankaccount iban kontonummer kontonr cislouctu", TEXT, "'XXXX' || lpad(cast({pki} % 10000 as string), 4, '0')"),
    ("Routing Number", "routing routingnumber sortcode", TEXT, "'021000021'"),
    ("Salary", "salary compensation wage income gehalt plat", NUMERIC, "50000 + ({pki} % 100) * 1000"),
    ("API Key", "apikey apisecret secretkey accesskey clientsecret privatekey signingkey encryptionkey webhooksecret appsecret appkey", TEXT, "'sk_test_' || lpad(cast({pki} as string), 24, '0')"),
    ("Access Token", "token accesstoken authtoken apitoken refreshtoken bearertoken", TEXT, "'tok_test_' || lpad(cast({pki} as string), 24, '0')"),
]
# fixed values: last words that mean a column is about the thing, not the thing
NOISE = "type template subject body format policy hint log error config url prefix method provider source reason description mode level regex pattern rule setting option preference"


def name_matches(column: str, names: Iterable[str]) -> bool:
    """One word of the column, or all of it without underscores, is among the names."""
    lower = column.lower()
    return bool({*lower.split("_"), lower.replace("_", "")} & set(names))


def has_noise_suffix(column: str) -> bool:
    words = column.lower().split("_")
    return len(words) > 1 and words[-1] in NOISE.split()


def type_matches(logical: str, types: Iterable[str]) -> bool:
    return logical.lower().startswith(tuple(types))


def mask_for(template: str, table: Table) -> str:
    """A rule's mask for a table, in Spark SQL."""
    pk = table.primary_key
    if not pk:
        return template.replace("{pki}", "0").replace("{pk}", "'0'")
    text = " || '_' || ".join(f"cast({backtick(c)} as string)" for c in pk)
    if len(pk) == 1 and type_matches(table.column(pk[0]).type, INTEGERS):
        number = backtick(pk[0])
    else:
        number = f"abs(cast(hash({text}) as bigint))"
    return template.replace("{pki}", number).replace("{pk}", text)


@dataclass(frozen=True)
class Match:
    table: str
    column: str
    type: str
    category: str
    confidence: Confidence
    mask: str


def match_column(table: Table, column: Column) -> Match | None:
    """The best rule for a column, the first of equals."""
    best = None
    for category, names, types, mask in RULES:
        if not name_matches(column.name, names.split()) or has_noise_suffix(column.name):
            continue
        if type_matches(column.type, types):
            confidence = Confidence.HIGH
        elif type_matches(column.type, TEXT):
            confidence = Confidence.LOW
        else:
            continue
        if best is None or confidence > best.confidence:
            best = Match(table.name, column.name, column.type, category, confidence, mask_for(mask, table))
    return best


def analyze(catalog: Catalog, tables: Iterable[str] | None = None, min_confidence: Confidence = Confidence.LOW) -> list[Match]:
    """Matches of the tables, keys and generated columns left out."""
    out = []
    for name in catalog.names() if tables is None else tables:
        table = catalog.table(name)
        for column in table.columns:
            if column.name in table.key_columns or column.generated:
                continue
            found = match_column(table, column)
            if found and found.confidence >= min_confidence:
                out.append(found)
    return out


def matches_df(spark: SparkSession, matches: Iterable[Match]) -> DataFrame:
    rows = [(m.table, m.column, m.type, m.category, m.confidence.name, m.mask) for m in matches]
    return spark.createDataFrame(rows, "table_name string, column_name string, column_type string, category string, confidence string, mask string")


def mask_specs(matches: Iterable[Match]) -> list[str]:
    """The matches as masks for a slice."""
    return [f"{m.table}.{m.column}={m.mask}" for m in matches]


def _by_table(catalog: Catalog, matches: list[Match]) -> dict[str, list[Match]]:
    return {t: [m for m in matches if m.table == t] for t in load_order(catalog, {m.table for m in matches})}


def format_analysis(catalog: Catalog, matches: list[Match], scanned: int) -> str:
    """What was found, table by table with parents first, and what it comes to."""
    parts = []
    for table, found in _by_table(catalog, matches).items():
        wide = max(len(m.column) for m in found)
        parts += [f"{table}\n", *(f"  {m.column:<{wide}} ({m.type}): {m.category}, {m.confidence.name.lower()} confidence; mask {m.mask}\n" for m in found), "\n"]
    return "".join(parts) + f"{len(matches)} sensitive column(s) in {len({m.table for m in matches})} of {scanned} table(s)\n"


def policy_yaml(catalog: Catalog, matches: list[Match], database: str = "default") -> str:
    """A masks file with the matches, all tagged pii."""
    columns = {}
    for table, found in _by_table(catalog, matches).items():
        name = short(table) if split_name(table)[0] == "public" else table
        columns |= {f"{name}.{m.column}": {"expr": m.mask, "tags": ["pii"]} for m in found}
    policy = {"version": 1, "databases": {database: {"columns": columns, "policies": {"pii": {"include_tags": ["pii"]}}}}}
    return yaml.safe_dump(policy, sort_keys=False, allow_unicode=True, width=1000)
