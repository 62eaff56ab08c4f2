import pytest
from pyspark.sql import functions as F

from harbour import harbour
from slicewise import cli
from slicewise.cli import elapsed, main, open_target
from slicewise.operators.integrity import check
from slicewise.operators.load import JdbcTarget, LoadError, ParquetTarget, RegistryTarget, apply, next_sequence_values
from slicewise.operators.subset import Slice, SubsetSpec, extract
from slicewise.sources import jdbc
from slicewise.sources.catalog import from_yaml
from slicewise.sources.versions import Versions, loaded

BRINE = "ports WHERE id = 4"
REGISTRY = """
tables:
  ports: {primary_key: [id]}
  captains: {primary_key: [id], foreign_keys: [{columns: [port_id], table: ports, references: [id]}]}
  voyages: {primary_key: [id], foreign_keys: [{columns: [captain_id], table: captains, references: [id]}]}
"""


@pytest.fixture
def registry(spark, tmp_path, monkeypatch):
    """A folder with a registry, in which one voyage has no captain."""
    monkeypatch.delenv("DATABASE_URL", raising=False)
    monkeypatch.chdir(tmp_path)
    folder = tmp_path / "base"
    c = harbour(spark, voyages=[(99, 9999, "lost")])
    for name in ("ports", "captains", "voyages"):
        c.df(name).write.parquet(str(folder / f"{name}.parquet"))
    (folder / "catalog.yaml").write_text(REGISTRY)
    return str(folder)


def test_load(spark, tmp_path):
    cut = extract(harbour(spark), root=BRINE)
    target = ParquetTarget(str(tmp_path / "db"))
    assert apply(cut, target, dry_run=True, force=True).rows["public.captains"] == 3
    assert not (tmp_path / "db").exists()
    result = apply(cut, target, sync_sequences=True)
    assert result.next_values["public.captains"] == 23 and not result.sequences_set
    apply(cut, target, force=True)
    assert loaded(spark, str(tmp_path / "db"))["public.captains"].count() == 3
    broken = Slice(cut.catalog, {t: df for t, df in cut.tables.items()} | {"public.ports": cut.tables["public.ports"].limit(0)}, "x")
    with pytest.raises(LoadError):
        apply(broken, target)


def test_sequence_of_an_empty_table(spark):
    c = harbour(spark)
    assert next_sequence_values(c, {"public.captains": c.df("captains").limit(0)}).first()["last_value"] == 1


class Recorder:
    """A target that notes what it is told."""

    def __init__(self):
        self.told = []

    def stage(self, name, df):
        self.told.append(("stage", name))
        return df

    def publish(self, order, replace, sequences):
        self.told.append(("publish", replace, *order, *sequences))
        return True

    def discard(self):
        self.told.append(("discard",))


def test_order_of_a_load(spark):
    """Parents are staged first, and only what is staged and right is published."""
    cut, target = extract(harbour(spark), root="voyages WHERE id = 31"), Recorder()
    result = apply(cut, target, force=True, sync_sequences=True)
    names = ["public.ports", "public.captains", "public.voyages"]
    assert target.told[:3] == [("stage", name) for name in names] and target.told[4:] == [("discard",)]
    assert target.told[3][:5] == ("publish", True, *names)
    assert sorted(target.told[3][5:]) == [("public.captains", "id", 21), ("public.ports", "id", 4), ("public.voyages", "id", 31)]
    assert result.sequences_set
    target.told.clear()
    apply(cut, target, force=True, dry_run=True, sync_sequences=True)
    assert target.told == []
    broken = Slice(cut.catalog, {t: df for t, df in cut.tables.items()} | {"public.ports": cut.tables["public.ports"].where("id <> 4")}, "x")
    with pytest.raises(LoadError, match="without parent"):
        apply(broken, target)
    assert [x[0] for x in target.told] == ["stage", "stage", "discard"]


def fails_at(target, name):
    """The target, but staging that table stops."""
    real = target.stage

    def stage(table, df):
        if table == name:
            df = df.withColumn("label", F.raise_error(F.lit("stopped")).cast("string"))
        return real(table, df)

    target.stage = stage
    return target


@pytest.mark.parametrize("where", ["folder", "registry"])
def test_a_load_that_stops_leaves_all_files_as_they_were(spark, registry, tmp_path, where):
    folder = str(tmp_path / "db") if where == "folder" else registry

    def target():
        return ParquetTarget(folder) if where == "folder" else RegistryTarget(from_yaml(spark, f"{folder}/catalog.yaml"))

    def seen():
        tables = loaded(spark, folder) if where == "folder" else {n: c.df(n) for c in [from_yaml(spark, f"{folder}/catalog.yaml")] for n in c.names()}
        return {n: sorted(map(tuple, df.collect())) for n, df in tables.items()}

    cut = extract(harbour(spark), SubsetSpec(root="captains WHERE id < 23", exclude=["berths", "tides", "arrivals", "gauges", "cargo"]))
    other = extract(harbour(spark), SubsetSpec(root="captains WHERE id > 22", exclude=["berths", "tides", "arrivals", "gauges", "cargo"]))
    apply(cut, target(), force=True)
    before = seen()
    assert before["public.voyages"] == [(31, 21, "north"), (32, 21, "round the cape")]
    with pytest.raises(Exception, match="stopped"):
        apply(other, fails_at(target(), "public.voyages"), force=True)
    assert seen() == before
    assert Versions(spark, folder).vacuum() == []  # nothing is left of it
    late = target()
    late.stage("public.ports", other.tables["public.ports"])
    apply(other, target(), force=True)
    after = seen()
    assert after["public.voyages"] == [(33, 23, "ferry"), (34, 24, "survey")]
    with pytest.raises(LoadError, match="loaded since"):  # two loads at a time: the first to publish wins
        late.publish(["public.ports"], True, [])
    late.discard()
    assert len(Versions(spark, folder).vacuum()) == 1 and seen() == after
    apply(cut, target(), verify=False)  # added to what is there
    assert len(seen()["public.voyages"]) == 4


def test_a_catalog_reads_files_of_one_moment(spark, registry):
    """A file that is added between two uses of a table isn't seen, nor is a load; a new catalog sees both."""
    c = from_yaml(spark, f"{registry}/catalog.yaml")
    c.pin()
    spark.createDataFrame([(77, 9999, "added")], "id int, captain_id int, label string").write.mode("append").parquet(f"{registry}/voyages.parquet")
    assert c.df("voyages").where("id = 77").count() == 0 and check(c)[1].count == 1
    again = from_yaml(spark, f"{registry}/catalog.yaml")
    assert again.df("voyages").where("id = 77").count() == 1 and check(again)[1].count == 2
    apply(extract(c, SubsetSpec(root="captains WHERE id = 24")), RegistryTarget(again), force=True)
    assert c.df("captains").count() == 4 and again.df("captains").count() == 1


# ---- a database: the one that Spark brings along


@pytest.fixture
def database(spark, request):
    """Tables with keys in a database in memory, filled by a load."""
    url = f"jdbc:derby:memory:load{request.node.name[:20].replace('[', '').replace(']', '')};create=true"
    target = JdbcTarget(url, spark=spark)
    target.run([
        'CREATE SCHEMA "public"',
        'CREATE TABLE "public"."ports" ("id" INT PRIMARY KEY, "name" VARCHAR(40), "gate_code" VARCHAR(40))',
        'CREATE TABLE "public"."captains" ("id" INT PRIMARY KEY, "port_id" INT NOT NULL REFERENCES "public"."ports" ("id"), "email" VARCHAR(80), "title" VARCHAR(40))',
        'CREATE TABLE "public"."voyages" ("id" INT PRIMARY KEY, "captain_id" INT NOT NULL REFERENCES "public"."captains" ("id"), "label" VARCHAR(20) CHECK ("label" <> \'survey\'))',
    ])
    only = ["berths", "tides", "arrivals", "gauges", "cargo"]
    apply(extract(harbour(spark), SubsetSpec(root="captains WHERE id < 23", exclude=only)), JdbcTarget(url))

    def rows():
        return {t: sorted(map(tuple, spark.read.format("jdbc").options(url=url, dbtable=f'"public"."{t}"').load().collect())) for t in ("ports", "captains", "voyages")}

    def tables():
        return spark.read.format("jdbc").options(url=url, query="SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'").load().count()

    return url, rows, tables, only


def test_a_database_is_loaded_in_one_transaction(spark, database):
    url, rows, tables, only = database
    before = rows()
    assert before["captains"] == [(21, 4, "ada@brine.example", "Master"), (22, 4, "ivo@brine.example", "Mate")] and len(before["voyages"]) == 2
    bad = extract(harbour(spark), SubsetSpec(root="captains WHERE id > 22", exclude=only))
    with pytest.raises(LoadError, match="refused"):  # the third table's check fails when the first two are replaced already
        apply(bad, JdbcTarget(url), force=True)
    assert rows() == before and tables() == 3
    with pytest.raises(LoadError, match="refused"):  # keys that are there already
        apply(extract(harbour(spark), SubsetSpec(root="captains WHERE id < 24", exclude=only)), JdbcTarget(url))
    assert rows() == before and tables() == 3
    good = extract(harbour(spark), SubsetSpec(root="captains WHERE id = 23", exclude=only))
    result = apply(good, JdbcTarget(url), force=True, sync_sequences=True)
    assert result.rows == {"public.ports": 1, "public.captains": 1, "public.voyages": 1} and not result.sequences_set
    assert rows() == {"ports": [(4, "Brine", "g-7714")], "captains": [(23, 4, "lou@brine.example", "Pilot")], "voyages": [(33, 23, "ferry")]}
    assert tables() == 3


def test_postgresql_statements():
    """Children are emptied with their parents in one statement, in the transaction that fills them."""
    target = JdbcTarget("jdbc:postgresql://h/db", {"user": "u"}, disable_triggers=True, identity={"public.b"})
    target.staged = {"public.a": "public.a_stage", "public.b": "public.b_stage"}
    target.columns = {"public.a": ["id", "x"], "public.b": ["id"]}
    assert target.statements(["public.a", "public.b"], True, [("public.a", "id", 7)]) == [
        "SET LOCAL session_replication_role = replica",
        'TRUNCATE "public"."b", "public"."a" CASCADE',
        'INSERT INTO "public"."a" ("id", "x") SELECT "id", "x" FROM "public"."a_stage"',
        'INSERT INTO "public"."b" ("id") OVERRIDING SYSTEM VALUE SELECT "id" FROM "public"."b_stage"',
        "SELECT setval(pg_get_serial_sequence('\"public\".\"a\"', 'id'), 7)",
    ]
    assert target.statements(["public.a"], False, [])[1:] == ['INSERT INTO "public"."a" ("id", "x") SELECT "id", "x" FROM "public"."a_stage"']


def test_targets(spark, registry):
    c = from_yaml(spark, f"{registry}/catalog.yaml")
    assert isinstance(open_target("", c, registry), RegistryTarget)
    assert isinstance(open_target(registry, c, registry), RegistryTarget)
    assert isinstance(open_target(f"{registry}/catalog.yaml", c, "elsewhere"), RegistryTarget)
    assert open_target("/some/folder", c, registry) == ParquetTarget("/some/folder")
    assert open_target("", c, "jdbc:postgresql://h/db").url == open_target("jdbc:postgresql://h/db", c, registry).url == "jdbc:postgresql://h/db"
    for where, disable in (("/some/folder", True), ("jdbc:sqlite:x", True)):
        with pytest.raises(LoadError, match="riggers"):
            open_target(where, c, registry, disable)
    for empty in ("", "  ", "/"):
        with pytest.raises(LoadError, match="no folder"):
            ParquetTarget(empty)
    with pytest.raises(LoadError):
        JdbcTarget("")


def called(spark, capsys, *args):
    code = main(list(args), spark)
    return code, *capsys.readouterr()


def test_cli(spark, registry, tmp_path, capsys):
    def run(command, *args):
        code, out, _ = called(spark, capsys, command, "--connection", registry, *args)
        return code, out

    code, out = run("check")
    assert code == 1 and "1 without a parent" in out
    assert run("check", "--root", "ports", "--depth", "1")[0] == 0
    assert "public.ports" in run("suggest-roots", "--top", "1")[1]
    assert "Email" in run("analyze")[1] and "captains.email" in run("analyze", "--yaml")[1]
    assert "FK -> public.captains.id" in run("inspect")[1]
    assert "no key suggested" in run("suggest-fks")[1]
    assert "public.voyages: 2 rows" in run("extract", "--root", "captains WHERE id IN (21, 22)", "--dry-run")[1]
    for form, name in (("parquet", "s"), ("jsonl", "l"), ("json", "s.json"), ("sql", "q")):
        assert run("extract", "--root", "captains WHERE id = 21", "-o", str(tmp_path / name), "--format", form, "--mask", "captains.email='x'")[0] == 0
    for source in ("s", "l", "s.json"):
        assert "public.captains: 1 rows" in run("apply", str(tmp_path / source), "--target", str(tmp_path / "db"), "--force")[1]
        assert loaded(spark, str(tmp_path / "db"))["public.captains"].first()["email"] == "x"


@pytest.mark.parametrize("by", ["flag", "environment", "profile", "file"])
def test_a_load_is_seen_by_its_connection(spark, registry, tmp_path, capsys, monkeypatch, by):
    """Without a target the tables of the connection are written, where the registry says they are."""
    connection = f"{registry}/catalog.yaml" if by == "file" else registry
    if by == "environment":
        monkeypatch.setenv("DATABASE_URL", registry)
    if by == "profile":
        (tmp_path / ".slicewise.yaml").write_text(f"connection: {registry}\n")
    flag = ["--connection", connection] if by in ("flag", "file") else []
    assert called(spark, capsys, "extract", *flag, "--root", "captains WHERE id = 21", "-o", str(tmp_path / "s"), "--mask", "captains.email='masked'")[0] == 0
    code, out, _ = called(spark, capsys, "apply", *flag, str(tmp_path / "s"), "--force")
    assert code == 0 and "public.captains: 1 rows" in out
    again = from_yaml(spark, f"{registry}/catalog.yaml")
    assert [tuple(r) for r in again.df("captains").collect()] == [(21, 4, "masked", "Master")]
    assert called(spark, capsys, "check", *flag)[0] == 0  # the voyage without a captain is gone
    assert sorted(p.name for p in (tmp_path / "base").iterdir() if not p.name.startswith(".")) == ["captains.parquet", "catalog.yaml", "ports.parquet", "voyages.parquet"]


def test_refusals_end_with_a_code(spark, registry, tmp_path, capsys):
    called(spark, capsys, "extract", "--connection", registry, "--root", "captains WHERE id = 21", "-o", str(tmp_path / "s"))
    code, _, err = called(spark, capsys, "apply", "--connection", registry, str(tmp_path / "s"), "--disable-triggers")
    assert code == 1 and "triggers" in err
    assert called(spark, capsys, "check")[0] == 2  # no connection


def test_verbose_says_how_long_it_took(spark, registry, capsys):
    _, _, err = called(spark, capsys, "check", "--connection", registry, "--verbose")
    assert "catalog: " in err and "2 constraint(s): " in err and "check: " in err
    assert called(spark, capsys, "check", "--connection", registry)[2] == ""
    assert [elapsed(x) for x in (0.25, 3.14, 75)] == ["250 ms", "3.1 s", "1 min 15 s"]


def test_schema_and_timeout_reach_jdbc(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(jdbc, "catalog", lambda spark, url, properties=None, partitions=32, default_schema="public", one_moment=False: seen.update(url=url, properties=properties, schema=default_schema, one_moment=one_moment))
    cli.open_catalog(spark, "jdbc:postgresql://h/db", "sales", 30, True)
    assert seen == {"url": "jdbc:postgresql://h/db", "properties": {"queryTimeout": "30"}, "schema": "sales", "one_moment": True}


def test_jdbc_catalog(spark, monkeypatch):
    """Keys, columns and partitions as the database's catalog states them."""
    answers = {
        jdbc.COLUMNS: [("public", "a", "id", 1, "bigint", False, False, False, None), ("public", "b", "id", 1, "integer", False, False, True, None), ("public", "b", "a_id", 2, "bigint", True, False, False, "0"), ("public", "b_1", "id", 1, "integer", False, False, False, None)],
        jdbc.CONSTRAINTS: [("public", "a", "a_pk", "p", None, None, "id", ""), ("public", "b", "b_fk", "f", "public", "a", "a_id", "id"), ("public", "b", "b_u", "u", None, None, "a_id", "")],
        jdbc.PARTITIONS: [("public.b_1", "public.b")],
    }
    shapes = {
        jdbc.COLUMNS: "schema_name string, table_name string, column_name string, place int, type string, nullable boolean, generated boolean, identity boolean, default_value string",
        jdbc.CONSTRAINTS: "schema_name string, table_name string, name string, kind string, parent_schema string, parent_table string, columns string, parent_columns string",
        jdbc.PARTITIONS: "child string, parent string",
    }
    monkeypatch.setattr(jdbc, "read_sql", lambda spark, url, sql, properties: spark.createDataFrame(answers[sql], shapes[sql]))
    c = jdbc.catalog(spark, "jdbc:postgresql://h/db", default_schema="public")
    assert c.names() == ["public.a", "public.b"] and c.table("a").primary_key == ("id",)
    fk = c.constraints()[0]
    assert (fk.child, fk.parent, fk.child_cols, fk.parent_cols) == ("public.b", "public.a", ("a_id",), ("id",))
    assert c.table("b").column("a_id").unique and c.table("b").has_identity and not c.table("a").column("id").nullable


class FakeConnection:
    """A connection that notes what it is told, and knows a snapshot's name."""

    def __init__(self):
        self.told = []

    def setAutoCommit(self, on):  # noqa: N802
        self.told.append(f"autocommit {on}")

    def createStatement(self):  # noqa: N802
        return self

    def execute(self, text):
        self.told.append(text)

    def executeQuery(self, text):  # noqa: N802
        self.told.append(text)
        return self

    def next(self):
        return True

    def getString(self, place):  # noqa: N802
        return "00000003-1B-1"

    def close(self):
        self.told.append("close")


def test_readers_adopt_the_snapshot_of_the_driver(spark, monkeypatch):
    connection, asked = FakeConnection(), []
    monkeypatch.setattr(jdbc, "connect", lambda spark, url, properties: connection)
    shapes = {jdbc.COLUMNS: "schema_name string, table_name string, column_name string, place int, type string, nullable boolean, generated boolean, identity boolean, default_value string", jdbc.CONSTRAINTS: "schema_name string, table_name string, name string, kind string, parent_schema string, parent_table string, columns string, parent_columns string", jdbc.PARTITIONS: "child string, parent string"}
    rows = {jdbc.COLUMNS: [("public", "a", "id", 1, "bigint", False, False, False, None)]}
    monkeypatch.setattr(jdbc, "read_sql", lambda spark, url, sql, properties: (asked.append(properties), spark.createDataFrame(rows.get(sql, []), shapes[sql]))[1])
    monkeypatch.setattr(jdbc, "read_table", lambda spark, url, name, key, properties, partitions: (asked.append(properties), spark.range(1))[1])
    c = jdbc.catalog(spark, "jdbc:postgresql://h/db", one_moment=True)
    c.df("a")
    assert connection.told[:3] == ["autocommit False", "SET TRANSACTION ISOLATION LEVEL REPEATABLE READ, READ ONLY", "SELECT pg_export_snapshot()"]
    assert len(asked) == 4 and all(x["sessionInitStatement"].endswith("SET TRANSACTION SNAPSHOT '00000003-1B-1'") and x["fetchsize"] == "10000" for x in asked)
    c.close()
    c.close()
    assert connection.told[-1] == "close" and connection.told.count("close") == 2  # its statement, and once the connection
    jdbc.catalog(spark, "jdbc:postgresql://h/db").close()
    assert "sessionInitStatement" not in asked[-1]


def test_readers_run_their_session_statement(spark, database):
    """What Spark's readers are given is run, by each of them, before they read."""
    url, *_ = database
    read = lambda statement: spark.read.format("jdbc").options(url=url, dbtable='"public"."ports"', fetchsize="10000", sessionInitStatement=statement).load().count()
    assert read("SET SCHEMA \"public\"") == 1
    with pytest.raises(Exception, match="nowhere"):
        read("SET SCHEMA \"nowhere\"")
