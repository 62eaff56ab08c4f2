"""Registered queries of the slicing operators, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.rendering import copy_lines, insert_statements, interval_text, rendered, rfc3339_seconds, sql_literal, uuid_text
from .operators.integrity import all_orphan_samples, orphan_counts, orphan_samples, orphans, repaired
from .operators.load import ParquetTarget, apply, dangling, next_sequence_values
from .operators.masking import apply_masks
from .operators.subset import Slice, SubsetSpec, extract
from .plans.graph import load_order, reachable, root_candidates_df
from .plans.pii import analyze, mask_specs, matches_df
from .plans.suggest_fks import discover, pairs_by_type, suggest, suggestions_df, validate
from .sources.catalog import Catalog, Column, Table, short, table_of
from .scratch import freeze, new_path
from .sources.partitions import leaves
from .sources.testdata import catalog
from .sources.versions import loaded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
LINE_SQL = ", ".join(LINE)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def star(spark: SparkSession, sf_dir: str) -> Catalog:
    return catalog(spark, sf_dir, STAR)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- integrity

_FKS = [
    ("customer", "c_nationkey", "nation", "n_nationkey"), ("events", "user_id", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("nation", "n_regionkey", "region", "r_regionkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
]
_NO_PARENT = "{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} WHERE {pc} = {c})"


@query(
    "orphans_by_fk",
    " UNION ALL ".join(
        f"SELECT 'public.{t}' AS child_table, '{t}_{c}_fkey' AS constraint_name, '{c}' AS child_columns, 'public.{p}' AS parent_table, '{pc}' AS parent_columns, "
        f"count(*) AS orphan_count FROM {t} WHERE {_NO_PARENT.format(c=c, p=p, pc=pc)}"
        for t, c, p, pc in _FKS
    ),
)
def orphans_by_fk(spark, sf_dir):
    return orphan_counts(star(spark, sf_dir))


# tables of which only some rows are there, so that every key but one has orphans
_SOME = {"region": "r_name <> 'ASIA'", "nation": "n_regionkey <> 1", "customer": "c_acctbal > 0", "supplier": "s_acctbal > 1000", "part": "p_size < 25", "orders": "o_orderstatus = 'F'", "lineitem": "l_quantity > 10", "events": "user_id IS NOT NULL"}


@query(
    "orphans_by_fk_restricted",
    f"WITH {', '.join(f'some_{t} AS (SELECT * FROM {t} WHERE {w})' for t, w in _SOME.items())} "
    + " UNION ALL ".join(
        f"SELECT 'public.{t}' AS child_table, '{t}_{c}_fkey' AS constraint_name, count(*) AS orphan_count FROM some_{t} WHERE {_NO_PARENT.format(c=c, p=f'some_{p}', pc=pc)}"
        for t, c, p, pc in _FKS
    ),
)
def orphans_by_fk_restricted(spark, sf_dir):
    return orphan_counts(_some(spark, sf_dir)).select("child_table", "constraint_name", "orphan_count")


def _some(spark, sf_dir):
    whole = star(spark, sf_dir)
    return Catalog(spark, [replace(t, load=lambda s, n=n: whole.df(n).where(_SOME[short(n)])) for n, t in whole.tables.items()])


_SHOWN = {"customer": ["c_custkey", "c_nationkey"], "events": ["event_id", "user_id"], "nation": ["n_nationkey", "n_regionkey"], "orders": ["o_orderkey", "o_custkey"], "supplier": ["s_suppkey", "s_nationkey"]}


def _samples_sql(t: str, c: str, p: str, pc: str) -> str:
    shown = _SHOWN.get(t, [c])
    text = " || ',' || ".join(f"'\"{x}\":' || {x}" for x in shown)
    return (
        f"SELECT 'public.{t}' AS child_table, '{t}_{c}_fkey' AS constraint_name, CAST(place AS INT) AS place, '{{' || {text} || '}}' AS sample "
        f"FROM (SELECT *, row_number() OVER (ORDER BY {', '.join(shown)}) AS place FROM some_{t} WHERE {_NO_PARENT.format(c=c, p=f'some_{p}', pc=pc)}) WHERE place <= 4"
    )


@query("orphan_samples_all", f"WITH {', '.join(f'some_{t} AS (SELECT * FROM {t} WHERE {w})' for t, w in _SOME.items())} " + " UNION ALL ".join(_samples_sql(*fk) for fk in _FKS))
def orphan_samples_all(spark, sf_dir):
    """The first orphans of every key of a catalog at once."""
    return all_orphan_samples(_some(spark, sf_dir), samples=4)


@query("orphans_partial_parent", f"SELECT {LINE_SQL} FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def orphans_partial_parent(spark, sf_dir):
    finished = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return orphans(table(spark, sf_dir, "lineitem"), finished, ["l_orderkey"], ["o_orderkey"]).select(*LINE)


@query(
    "orphans_composite",
    f"SELECT {LINE_SQL} FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_quantity > 25 AND b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey)",
)
def orphans_composite(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    pairs = lines.where("l_quantity > 25").select("l_partkey", "l_suppkey").distinct()
    return orphans(lines, pairs, ["l_partkey", "l_suppkey"], ["l_partkey", "l_suppkey"]).select(*LINE)


@query(
    "orphans_null_exempt",
    "SELECT count(*) AS orphan_count FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS a, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS b FROM orders) o "
    "WHERE a IS NOT NULL AND b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT o_custkey AS x, o_orderstatus AS y FROM orders WHERE o_totalprice > 200000) p WHERE x = a AND y = b)",
)
def orphans_null_exempt(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    child = orders.select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("a"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("b"))
    parent = orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("x"), F.col("o_orderstatus").alias("y"))
    return orphans(child, parent, ["a", "b"], ["x", "y"]).agg(F.count("*").alias("orphan_count"))


def _segment_catalog(spark, sf_dir):
    """Orders and the customers of one segment, so that there are orphans."""
    customer = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return Catalog(spark, [table_of("customer", customer, ["c_custkey"]), table_of("orders", table(spark, sf_dir, "orders"), ["o_orderkey"], [(["o_custkey"], "customer", ["c_custkey"])])])


_BUILDING = "EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')"


@query("orphan_samples", f"SELECT o_orderkey, o_custkey FROM orders WHERE NOT {_BUILDING} ORDER BY 1, 2 LIMIT 5")
def orphan_sample_rows(spark, sf_dir):
    c = _segment_catalog(spark, sf_dir)
    return orphan_samples(c, c.constraints()[0], 5)


@query("repaired_children", f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE {_BUILDING}")
def repaired_children(spark, sf_dir):
    c = _segment_catalog(spark, sf_dir)
    return repaired(c, c.constraints()[0]).select("o_orderkey", "o_custkey", "o_totalprice")


# ---- subsets

_C = "c_mktsegment = 'BUILDING'"
ROOT = f"customer WHERE {_C}"
_O = f"o_custkey IN (SELECT c_custkey FROM customer WHERE {_C})"
_L = f"l_orderkey IN (SELECT o_orderkey FROM orders WHERE {_O})"
_E = f"user_id IN (SELECT c_custkey FROM customer WHERE {_C})"
_S = f"s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE {_L})"
_P = f"p_partkey IN (SELECT l_partkey FROM lineitem WHERE {_L})"
_N = f"(n_nationkey IN (SELECT c_nationkey FROM customer WHERE {_C}) OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE {_S}))"
_R = f"r_regionkey IN (SELECT n_regionkey FROM nation WHERE {_N})"
_COUNTS = {"customer": _C, "orders": _O, "lineitem": _L, "events": _E, "supplier": _S, "part": _P, "nation": _N, "region": _R}


def _sliced(spark, sf_dir, name, **options):
    return extract(star(spark, sf_dir), SubsetSpec(**({"root": ROOT} | options))).tables[f"public.{name}"]


@query("subset_rowcounts", " UNION ALL ".join(f"SELECT 'public.{t}' AS table_name, count(*) AS row_count FROM {t} WHERE {w}" for t, w in _COUNTS.items()))
def subset_rowcounts(spark, sf_dir):
    return extract(star(spark, sf_dir), SubsetSpec(root=ROOT)).row_counts()


@query("subset_root", f"SELECT * FROM customer WHERE {_C}")
def subset_root(spark, sf_dir):
    return _sliced(spark, sf_dir, "customer")


@query("subset_children_orders", f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE {_O}")
def subset_children_orders(spark, sf_dir):
    return _sliced(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query("subset_grandchildren_lineitem", f"SELECT {LINE_SQL} FROM lineitem WHERE {_L}")
def subset_grandchildren_lineitem(spark, sf_dir):
    return _sliced(spark, sf_dir, "lineitem").select(*LINE)


@query("subset_parents_part", f"SELECT * FROM part WHERE {_P}")
def subset_parents_part(spark, sf_dir):
    return _sliced(spark, sf_dir, "part")


@query("subset_parents_nation", f"SELECT * FROM nation WHERE {_N}")
def subset_parents_nation(spark, sf_dir):
    return _sliced(spark, sf_dir, "nation")


_TWO_EDGES = "(l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3))"


@query("subset_multi_edge", f"SELECT {LINE_SQL} FROM lineitem WHERE {_TWO_EDGES}")
def subset_multi_edge(spark, sf_dir):
    """A child below two included tables, which are views of part and supplier."""
    part = table(spark, sf_dir, "part").where("p_size = 7")
    supplier = table(spark, sf_dir, "supplier").where("s_nationkey = 3")
    lines = table_of("lineitem", table(spark, sf_dir, "lineitem"), [], [(["l_partkey"], "part", ["p_partkey"]), (["l_suppkey"], "supplier", ["s_suppkey"])])
    c = Catalog(spark, [table_of("part", part, ["p_partkey"]), table_of("supplier", supplier, ["s_suppkey"]), lines])
    return extract(c, SubsetSpec(root="part", include=["supplier"])).tables["public.lineitem"].select(*LINE)


@query("subset_filtered_children", f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE {_O} AND o_orderstatus = 'F'")
def subset_filtered_children(spark, sf_dir):
    return _sliced(spark, sf_dir, "orders", filters=["orders=o_orderstatus = 'F'"]).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("subset_limited_children", f"SELECT o_orderkey, o_custkey FROM orders WHERE {_O} ORDER BY o_orderkey LIMIT 50")
def subset_limited_children(spark, sf_dir):
    return _sliced(spark, sf_dir, "orders", limit=50).select("o_orderkey", "o_custkey")


@query("subset_depth1", " UNION ALL ".join(f"SELECT 'public.{t}' AS table_name, count(*) AS row_count FROM {t} WHERE {w}" for t, w in (("customer", _C), ("orders", _O), ("events", _E), ("nation", f"n_nationkey IN (SELECT c_nationkey FROM customer WHERE {_C})"), ("region", f"r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE {_C}))"))))
def subset_depth1(spark, sf_dir):
    return extract(star(spark, sf_dir), SubsetSpec(root=ROOT, depth=1)).row_counts()


_REGION = "region WHERE r_name = 'ASIA'"
_HOPS = (
    "WITH r AS (SELECT * FROM region WHERE r_name = 'ASIA'), n AS (SELECT * FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM r)), "
    "c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)), s AS (SELECT * FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n))"
)


@query("subset_depth2", _HOPS + " UNION ALL ".join(f" SELECT 'public.{t}' AS table_name, count(*) AS row_count FROM {a}" for t, a in (("region", "r"), ("nation", "n"), ("customer", "c"), ("supplier", "s"))))
def subset_depth2(spark, sf_dir):
    return extract(star(spark, sf_dir), SubsetSpec(root=_REGION, depth=2)).row_counts()


@query(
    "subset_depth3",
    _HOPS + ", l AS (SELECT * FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM s)), e AS (SELECT * FROM events WHERE user_id IN (SELECT c_custkey FROM c)), "
    "o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c) OR o_orderkey IN (SELECT l_orderkey FROM l)), p AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM l)), "
    "cc AS (SELECT * FROM customer WHERE c_custkey IN (SELECT c_custkey FROM c) OR c_custkey IN (SELECT o_custkey FROM o)), "
    "nn AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT n_nationkey FROM n) OR n_nationkey IN (SELECT c_nationkey FROM cc)), "
    "rr AS (SELECT * FROM region WHERE r_regionkey IN (SELECT r_regionkey FROM r) OR r_regionkey IN (SELECT n_regionkey FROM nn))"
    + " UNION ALL ".join(f" SELECT 'public.{t}' AS table_name, count(*) AS row_count FROM {a}" for t, a in (("region", "rr"), ("nation", "nn"), ("customer", "cc"), ("supplier", "s"), ("orders", "o"), ("lineitem", "l"), ("events", "e"), ("part", "p"))),
)
def subset_depth3(spark, sf_dir):
    return extract(star(spark, sf_dir), SubsetSpec(root=_REGION, depth=3)).row_counts()


_PG_TAIL = "WHERE \"c_mktsegment\"::text ILIKE 'build%' AND customer.c_acctbal::numeric(12,2) > 100 AND cast(c_nationkey AS text) <> '7'"


@query("subset_root_dialect", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer {_PG_TAIL})")
def subset_root_dialect(spark, sf_dir):
    """A root clause as PostgreSQL writes it."""
    return _sliced(spark, sf_dir, "orders", root=f"customer {_PG_TAIL}").select("o_orderkey", "o_custkey")


_OPERATORS = r"WHERE c_mktsegment ~ '^(BUILD|AUTO)' AND c_name !~* '#0*1$' AND c_nationkey = ANY(ARRAY[1, 3, 5, 7, 9, 11]) AND c_mktsegment SIMILAR TO '%(ING|BILE)' AND c_acctbal ^ 2 > 10000 AND c_name <> E'Customer\x23000000002'"


@query(
    "subset_root_operators",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE (c_mktsegment LIKE 'BUILD%' OR c_mktsegment LIKE 'AUTO%') AND NOT regexp_matches(c_name, '#0*1$') "
    "AND c_nationkey IN (1, 3, 5, 7, 9, 11) AND (c_mktsegment LIKE '%ING' OR c_mktsegment LIKE '%BILE') AND c_acctbal * c_acctbal > 10000 AND c_name <> 'Customer#000000002')",
)
def subset_root_operators(spark, sf_dir):
    """A root clause with operators that only PostgreSQL has."""
    return _sliced(spark, sf_dir, "orders", root=f"customer {_OPERATORS}").select("o_orderkey", "o_custkey")


_RICHEST = "WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 100"


@query("subset_root_order_limit", f"SELECT {LINE_SQL} FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer {_RICHEST}))")
def subset_root_order_limit(spark, sf_dir):
    return _sliced(spark, sf_dir, "lineitem", root=f"customer {_RICHEST}").select(*LINE)


@query("subset_exclude", " UNION ALL ".join(f"SELECT 'public.{t}' AS table_name, count(*) AS row_count FROM {t} WHERE {w}" for t, w in _COUNTS.items() if t not in ("events", "part")))
def subset_exclude(spark, sf_dir):
    return extract(star(spark, sf_dir), SubsetSpec(root=ROOT, exclude=["events", "part"])).row_counts()


@query("subset_include", "SELECT * FROM part")
def subset_include(spark, sf_dir):
    return _sliced(spark, sf_dir, "part", include=["part"], expand_includes=False)


@query("subset_seed", "SELECT 'public.customer' AS table_name, count(*) AS row_count FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'public.orders', count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'public.lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def subset_seed(spark, sf_dir):
    c = star(spark, sf_dir)
    return extract(c, SubsetSpec(seed="o_orderstatus=P", exclude=["nation", "region", "supplier", "part"])).row_counts()


@query(
    "self_ref_closure",
    "WITH RECURSIVE tree AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey > 0 THEN o_orderkey // 10 END AS parent FROM orders), "
    "found AS (SELECT node, parent FROM tree WHERE node = 7 UNION SELECT t.node, t.parent FROM tree t JOIN found f ON t.parent = f.node), "
    "above AS (SELECT node, parent FROM found UNION SELECT t.node, t.parent FROM tree t JOIN above a ON t.node = a.parent) SELECT * FROM above",
)
def self_ref_closure(spark, sf_dir):
    tree = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.when(F.col("o_orderkey") > 0, F.floor(F.col("o_orderkey") / 10)).cast("long").alias("parent"))
    c = Catalog(spark, [table_of("tree", tree, ["node"], [(["parent"], "tree", ["node"])])])
    return extract(c, SubsetSpec(root="tree WHERE node = 7")).tables["public.tree"]


@query(
    "self_ref_filtered",
    "WITH RECURSIVE tree AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey > 0 THEN o_orderkey // 10 END AS parent, o_orderstatus AS status FROM orders), "
    "found AS (SELECT * FROM tree WHERE node = 7 UNION SELECT t.* FROM tree t JOIN found f ON t.parent = f.node WHERE t.status <> 'O'), "
    "above AS (SELECT * FROM found UNION SELECT t.* FROM tree t JOIN above a ON t.node = a.parent) SELECT * FROM above",
)
def self_ref_filtered(spark, sf_dir):
    """A filter holds on the steps down a tree; those up are for integrity."""
    parent = F.when(F.col("o_orderkey") > 0, F.floor(F.col("o_orderkey") / 10)).cast("long")
    tree = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), parent.alias("parent"), F.col("o_orderstatus").alias("status"))
    c = Catalog(spark, [table_of("tree", tree, ["node"], [(["parent"], "tree", ["node"])])])
    return extract(c, SubsetSpec(root="tree WHERE node = 7", filters=["tree=status <> 'O'"])).tables["public.tree"]


_CHAIN = "WITH RECURSIVE chain AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS node, row_number() OVER (ORDER BY o_orderkey) - 1 AS parent, o_orderstatus AS status FROM (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))), "


@query(
    "deep_chain",
    _CHAIN + "found AS (SELECT * FROM chain WHERE node = 40 UNION ALL SELECT c.* FROM chain c JOIN found f ON c.parent = f.node), "
    "above AS (SELECT * FROM chain WHERE node = 40 UNION ALL SELECT c.* FROM chain c JOIN above a ON c.node = a.parent) SELECT node, parent, status FROM found UNION SELECT node, parent, status FROM above",
)
def deep_chain(spark, sf_dir):
    """A tree that is one path of some thousand rows: each order of a segment's customers is below the one before."""
    customer = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    own = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    ordered = freeze(own.select("o_orderkey", "o_orderstatus").orderBy("o_orderkey").withColumn("number", F.monotonically_increasing_id()), "chain")
    # the rows of a sorted partition are numbered on from those before it: only counts meet in one task
    part = F.shiftright("number", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = ordered.withColumn("part", part).join(F.broadcast(before), "part")
    node = F.col("before") + F.col("number").bitwiseAND((1 << 33) - 1) + 1
    chain = freeze(numbered.select(node.alias("node"), (node - 1).alias("parent"), F.col("o_orderstatus").alias("status")), "chain")
    c = Catalog(spark, [table_of("chain", chain, ["node"], [(["parent"], "chain", ["node"])])])
    return extract(c, SubsetSpec(root="chain WHERE node = 40")).tables["public.chain"]


@query(
    "two_parents_closure",
    "WITH RECURSIVE net AS (SELECT c_custkey AS id, c_name AS label, c_custkey // 7 AS first, c_custkey // 11 AS second, c_acctbal > 0 AS open FROM customer), "
    "found AS (SELECT id, first, second FROM net WHERE id BETWEEN 3 AND 5 UNION SELECT n.id, n.first, n.second FROM net n JOIN found f ON f.id = n.first OR f.id = n.second WHERE n.open), "
    "above AS (SELECT * FROM found UNION SELECT n.id, n.first, n.second FROM net n JOIN above a ON n.id = a.first OR n.id = a.second) "
    "SELECT id, label, first, second FROM net WHERE id IN (SELECT id FROM above)",
)
def two_parents_closure(spark, sf_dir):
    """A net in which every row has two parents, with a filter on the way down."""
    net = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS label", "c_custkey div 7 AS first", "c_custkey div 11 AS second", "c_acctbal > 0 AS open")
    c = Catalog(spark, [table_of("net", net, ["id"], [(["first"], "net", ["id"]), (["second"], "net", ["id"])])])
    return extract(c, SubsetSpec(root="net WHERE id BETWEEN 3 AND 5", filters=["net=open"])).tables["public.net"].drop("open")


@query(
    "cycle_closure",
    "WITH RECURSIVE emp AS (SELECT c_custkey AS id, c_custkey % 8 AS dept FROM customer), dep AS (SELECT DISTINCT c_custkey % 8 AS id, (c_custkey % 8) * 3 % 5 AS lead FROM customer), "
    "found(kind, id) AS (SELECT 'd', id FROM dep WHERE id = 1 UNION (SELECT 'e', e.id FROM emp e, found f WHERE f.kind = 'd' AND e.dept = f.id UNION SELECT 'd', d.id FROM dep d, found f WHERE f.kind = 'e' AND d.lead = f.id)), "
    "above(kind, id) AS (SELECT * FROM found UNION (SELECT 'd', e.dept FROM emp e, above a WHERE a.kind = 'e' AND e.id = a.id UNION SELECT 'e', d.lead FROM dep d, above a WHERE a.kind = 'd' AND d.id = a.id)) "
    "SELECT CASE kind WHEN 'd' THEN 'public.dep' ELSE 'public.emp' END AS table_name, count(*) AS row_count FROM above GROUP BY kind",
)
def cycle_closure(spark, sf_dir):
    """Departments with a lead among the employees, who each have a department."""
    customer = table(spark, sf_dir, "customer")
    emp = customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 8).alias("dept"))
    dep = customer.select((F.col("c_custkey") % 8).alias("id"), (F.col("c_custkey") % 8 * 3 % 5).alias("lead")).distinct()
    c = Catalog(spark, [table_of("emp", emp, ["id"], [(["dept"], "dep", ["id"])]), table_of("dep", dep, ["id"], [(["lead"], "emp", ["id"])])])
    cut = extract(c, SubsetSpec(root="dep WHERE id = 1"))
    return cut.row_counts()


@query(
    "subset_composite",
    f"SELECT {LINE_SQL} FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 40)",
)
def subset_composite(spark, sf_dir):
    """A key of two columns, from the pairs of part and supplier in use, of large parts."""
    lines, sizes = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), "p_size")
    pairs = lines.select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct().join(sizes, "p")
    c = Catalog(spark, [table_of("partsupp", pairs, ["p", "s"]), table_of("lineitem", lines, [], [(["l_partkey", "l_suppkey"], "partsupp", ["p", "s"])])])
    return extract(c, SubsetSpec(root="partsupp WHERE p_size > 40")).tables["public.lineitem"].select(*LINE)


@query("slice_has_no_orphans", " UNION ALL ".join(f"SELECT 'public.{t}' AS child_table, '{t}_{c}_fkey' AS constraint_name, CAST(0 AS BIGINT) AS orphan_count" for t, c, _, _ in _FKS))
def slice_has_no_orphans(spark, sf_dir):
    return dangling(extract(star(spark, sf_dir), SubsetSpec(root=ROOT)))


_LOST = {"orders": "o_orderstatus <> 'F'", "part": "p_size >= 25", "region": "r_name = 'EUROPE'"}
_ALIVE = {t: f"{w} AND NOT ({_LOST[t]})" if t in _LOST else w for t, w in _COUNTS.items()}


@query(
    "slice_with_orphans",
    " UNION ALL ".join(
        f"SELECT 'public.{t}' AS child_table, '{t}_{c}_fkey' AS constraint_name, count(*) AS orphan_count FROM {t} WHERE {_ALIVE[t]} AND {c} IS NOT NULL AND {c} NOT IN (SELECT {pc} FROM {p} WHERE {_ALIVE[p]})"
        for t, c, p, pc in _FKS
    ),
)
def slice_with_orphans(spark, sf_dir):
    """A slice that lost some of its parents."""
    cut = extract(star(spark, sf_dir), SubsetSpec(root=ROOT))
    tables = {n: df.where(f"NOT ({_LOST[short(n)]})") if short(n) in _LOST else df for n, df in cut.tables.items()}
    return dangling(Slice(cut.catalog, tables, cut.root))


@query(
    "partitioned_slice",
    f"SELECT {LINE_SQL} FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate < DATE '1995-06-01' AND o_orderkey % 1000 < 400)",
)
def partitioned_slice(spark, sf_dir):
    """Lines in parts by the order's number, some of them in parts again by quantity, below orders of a few of them."""
    lines, path = table(spark, sf_dir, "lineitem"), new_path(spark, "partitioned")
    part = F.when(F.col("l_orderkey") % 1000 < 400, "low").when(F.col("l_orderkey") % 1000 < 700, "middle").otherwise("high")
    keyed = lines.withColumn("slot", (F.col("l_orderkey") % 1000).cast("int")).withColumn("part", F.when((part == "low") & (F.col("l_quantity") > 25), "low_many").when(part == "low", "low_few").otherwise(part))
    keyed.write.partitionBy("part").parquet(path)
    at = lambda name: {"path": f"part={name}"}
    low = {"by": "range", "column": "l_quantity", "of": {"few": at("low_few") | {"to": 25.5}, "many": at("low_many") | {"from": 25.5}}}
    tree = {"by": "range", "column": "slot", "of": {"low": {"to": 400, "partitions": low}, "middle": at("middle") | {"from": 400, "to": 700}, "high": at("high") | {"default": True}}}
    parts = leaves(tree, path)
    whole = spark.read.parquet(*[leaf.path for leaf in parts])
    orders = table(spark, sf_dir, "orders").withColumn("slot", (F.col("o_orderkey") % 1000).cast("int"))
    child = replace(table_of("lineitem", whole, [], [(["l_orderkey", "slot"], "orders", ["o_orderkey", "slot"])]), parts=tuple(parts))
    c = Catalog(spark, [table_of("orders", orders, ["o_orderkey", "slot"]), child])
    return extract(c, SubsetSpec(root="orders WHERE o_orderdate < '1995-06-01'::date AND slot < 400")).tables["public.lineitem"].select(*LINE)


_AUTO = "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')"


@query("loaded_rows", f"SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, o_totalprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {_AUTO}")
def loaded_rows(spark, sf_dir):
    """A slice loaded in place of another one, and read back."""
    path, c = new_path(spark, "loaded"), star(spark, sf_dir)
    apply(extract(c, SubsetSpec(root=ROOT)), ParquetTarget(path))
    apply(extract(c, SubsetSpec(root="customer WHERE c_mktsegment = 'AUTOMOBILE'")), ParquetTarget(path), force=True)
    tables = loaded(spark, path)
    both = tables["public.lineitem"].join(tables["public.orders"], F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "o_totalprice")


@query("untouched_tables", "SELECT * FROM (VALUES ('public.benchmark'), ('public.conversations'), ('public.documents'), ('public.embeddings'), ('public.labels'), ('public.pages')) t(table_name)")
def untouched_tables(spark, sf_dir):
    cut = extract(catalog(spark, sf_dir), SubsetSpec(root=ROOT))
    return spark.createDataFrame([(t,) for t in cut.untouched], "table_name string")


# ---- masks


def _masked(name: str, source: str, columns: str, **masks: str) -> None:
    sql = {c: e for c, e in masks.items()}
    shown = ", ".join(f"{sql[c]} AS {c}" if c in sql else c for c in columns.split())
    query(name, f"SELECT {shown} FROM {source}")(lambda spark, sf_dir: apply_masks(table(spark, sf_dir, source), masks).select(*columns.split()))


_masked("mask_email", "customer", "c_custkey c_name", c_name="'user_' || c_custkey || '@test.com'")
_masked("mask_phone", "supplier", "s_suppkey s_name", s_name="'+1555' || lpad((s_suppkey % 10000000)::text, 7, '0')")
_masked("mask_salary", "customer", "c_custkey c_acctbal", c_acctbal="CAST(50000 + (c_custkey % 100) * 1000 AS DOUBLE)")
_masked("mask_lat", "supplier", "s_suppkey s_acctbal", s_acctbal="CAST(37.0 + (s_suppkey % 100) * 0.01 AS DOUBLE)")
_masked("mask_case_null", "orders", "o_orderkey o_orderpriority", o_orderpriority="CASE WHEN o_orderstatus = 'F' THEN 'it''s \"' || \"o_orderkey\" END")


@query("mask_dob", "SELECT c_custkey, DATE '1990-01-01' + CAST(c_custkey % 10000 AS INT) AS birth FROM customer")
def mask_dob(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", F.lit(None).cast("date").alias("birth"))
    return apply_masks(people, {"birth": "'1990-01-01'::date + (c_custkey % 10000)"})


def _hashtext_sql(key: str, text: str, source: str, size: int) -> str:
    """DuckDB SQL for (key, h) of texts of ``size`` bytes, 12 to 23: each step of the hash is a query over the one before."""
    word = lambda at: " + ".join(f"(ascii(substr({text}, {at + i + 1}, 1)) << {8 * i})" for i in range(4) if at + i < size) or "0"
    turn = lambda x, by: f"((({x} << {by}) | ({x} >> {32 - by})) & 4294967295)"
    start = (0x9E3779B9 + size + 3923095) & 0xFFFFFFFF
    out = f"SELECT {key}, {text}, " + ", ".join(f"(CAST({start} AS BIGINT) + {word(4 * i)}) & 4294967295 AS {x}" for i, x in enumerate("abc")) + f" FROM {source}"
    for (x, y, z), by in zip(["acb", "bac", "cba"] * 2, (4, 6, 8, 16, 19, 4)):
        out = f"SELECT {key}, {text}, xor(({x} - {y}) & 4294967295, {turn(y, by)}) AS {x}, ({y} + {z}) & 4294967295 AS {y}, {z} FROM ({out})"
    out = f"SELECT {key}, {text}, " + ", ".join(f"({x} + {f'(({word(12 + 4 * i)}) << 8)' if x == 'c' else word(12 + 4 * i)}) & 4294967295 AS {x}" for i, x in enumerate("abc")) + f" FROM ({out})"
    for (x, y, z), by in zip(["cba", "acb", "bac"] * 2 + ["cba"], (14, 11, 25, 16, 4, 14, 24)):
        out = f"SELECT {key}, {text}, (xor({x}, {y}) - {turn(y, by)}) & 4294967295 AS {x}, {y}, {z} FROM ({out})"
    return f"SELECT {key}, CASE WHEN c > 2147483647 THEN c - 4294967296 ELSE c END AS h FROM ({out})"


@query("mask_hashtext", f"SELECT c_custkey, 'user_' || abs(h) % 1000000 || '@x.example' AS c_name, CAST(h AS BIGINT) AS h FROM ({_hashtext_sql('c_custkey', 'c_name', 'customer', 18)})")
def mask_hashtext(spark, sf_dir):
    """A mask by the database's own hash of a text."""
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(0).cast("long").alias("h"))
    return apply_masks(people, {"c_name": "'user_' || abs(hashtext(c_name)) % 1000000 || '@x.example'", "h": "hashtext(c_name)"})


@query("mask_detected", "SELECT c_custkey AS id, 'user_' || c_custkey || '@test.com' AS email, '+1555' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0') AS home_phone, CAST(50000 + (c_custkey % 100) * 1000 AS DOUBLE) AS salary, c_mktsegment AS segment FROM customer")
def mask_detected(spark, sf_dir):
    """Masks that the detection itself suggests, applied in a slice."""
    people = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS email", "c_name AS home_phone", "c_acctbal AS salary", "c_mktsegment AS segment")
    c = Catalog(spark, [table_of("people", people, ["id"])])
    return extract(c, SubsetSpec(root="people", masks=mask_specs(analyze(c)))).tables["public.people"]


@query("generated_column_drop", "SELECT n_nationkey, n_regionkey FROM nation")
def generated_column_drop(spark, sf_dir):
    c = Catalog(spark, [table_of("nation", table(spark, sf_dir, "nation"), ["n_nationkey"], generated=["n_name"])])
    return extract(c, SubsetSpec(root="nation")).tables["public.nation"]


@query("next_sequence_values", " UNION ALL ".join(f"SELECT 'public.{t}' AS table_name, '{k}' AS column_name, CAST(coalesce(max({k}), 1) AS BIGINT) AS last_value FROM {t}" for t, k in (("customer", "c_custkey"), ("events", "event_id"), ("nation", "n_nationkey"), ("orders", "o_orderkey"), ("part", "p_partkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey"))))
def sequence_values(spark, sf_dir):
    c = star(spark, sf_dir)
    return next_sequence_values(c, {t: c.df(t) for t in c.names()})


# ---- the key graph


def _values(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(map(str, rows))}) t({columns})"


@query("topological_order", "SELECT table_name, CAST(place AS BIGINT) AS place FROM (VALUES ('public.part', 0), ('public.region', 1), ('public.nation', 2), ('public.customer', 3), ('public.events', 4), ('public.orders', 5), ('public.supplier', 6), ('public.lineitem', 7)) t(table_name, place)")
def topological_order(spark, sf_dir):
    c = star(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(load_order(c, c.names()))), "place long, table_name string")


_SCORES = [("customer", 36, 2, 7, 1), ("nation", 36, 2, 7, 1), ("part", 31, 1, 7, 0), ("region", 31, 1, 7, 0), ("orders", 26, 1, 7, 1), ("supplier", 26, 1, 7, 1), ("documents", 13, 1, 1, 0)]


@query("root_scores", _values("table_name, score, child_count, reachable, outgoing_fks", [(f"public.{t}", *x) for t, *x in _SCORES]))
def root_scores(spark, sf_dir):
    return root_candidates_df(spark, catalog(spark, sf_dir)).drop("reason")


@query("reachable_tables", _values("table_name", [f"('public.{t}')" for t in ("customer", "events", "lineitem", "nation", "orders", "part", "supplier")]))
def reachable_tables(spark, sf_dir):
    return spark.createDataFrame([(t,) for t in reachable(star(spark, sf_dir), "orders", 2)], "table_name string")


def _pii_catalog() -> Catalog:
    configs = Table("public.configs", tuple(Column(n, "text") if n != "id" else Column(n, "bigint") for n in ("id", "api_key", "secret_key", "access_token", "token", "api_version")), ("id",))
    notes = Table("public.notifications", (Column("id", "integer"), Column("email_subject", "text"), Column("user_email", "text"), Column("salary", "text"), Column("phone", "boolean")), ("id",))
    return Catalog(None, [configs, notes])


@query("pii_columns", _values("table_name, column_name, category, confidence", [("public.configs", "api_key", "API Key", "HIGH"), ("public.configs", "secret_key", "API Key", "HIGH"), ("public.configs", "access_token", "Access Token", "HIGH"), ("public.configs", "token", "Access Token", "HIGH"), ("public.notifications", "user_email", "Email", "HIGH"), ("public.notifications", "salary", "Salary", "LOW")]))
def pii_columns(spark, sf_dir):
    return matches_df(spark, analyze(_pii_catalog())).select("table_name", "column_name", "category", "confidence")


@query("fk_candidates", "SELECT 'public.events' AS child_table, 'user_id' AS child_column, 'public.users' AS parent_table, 'id' AS parent_column, true AS checked, count(*) AS orphan_count FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def fk_candidates(spark, sf_dir):
    users = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), "c_name")
    c = Catalog(spark, [table_of("users", users, ["id"]), table_of("events", table(spark, sf_dir, "events"), ["event_id"])])
    return suggestions_df(spark, validate(c, suggest(c)))


_NAMED = {
    "customers": ("customer", {"id": "c_custkey", "nation_id": "c_nationkey"}, "c_acctbal > 0"),
    "nations": ("nation", {"id": "n_nationkey", "region_id": "n_regionkey"}, "n_regionkey <> 1"),
    "region": ("region", {"id": "r_regionkey"}, "r_name <> 'ASIA'"),
    "parts": ("part", {"id": "p_partkey"}, "p_size < 25"),
    "orders": ("orders", {"id": "o_orderkey", "customer_id": "o_custkey", "clerk_id": "o_orderkey"}, "o_orderstatus = 'F'"),
    "lines": ("lineitem", {"order_id": "l_orderkey", "part_id": "l_partkey", "vendor_id": "l_suppkey"}, "l_quantity > 10"),
}
_FITS = [("customers", "nation_id", "nations"), ("lines", "order_id", "orders"), ("lines", "part_id", "parts"), ("lines", "vendor_id", None), ("nations", "region_id", "region"), ("orders", "clerk_id", None), ("orders", "customer_id", "customers")]
_NAMED_SQL = ", ".join(f"named_{n} AS (SELECT {', '.join(f'{own} AS {c}' for c, own in columns.items())} FROM {t} WHERE {w})" for n, (t, columns, w) in _NAMED.items())


@query(
    "fk_candidates_many",
    f"WITH {_NAMED_SQL} "
    + " UNION ALL ".join(
        f"SELECT 'public.{t}' AS child_table, '{c}' AS child_column, 'public.{p}' AS parent_table, 'id' AS parent_column, true AS checked, count(*) AS orphan_count FROM named_{t} WHERE {c} NOT IN (SELECT id FROM named_{p})"
        if p
        else f"SELECT 'public.{t}', '{c}', NULL, NULL, false, CAST(0 AS BIGINT)"
        for t, c, p in _FITS
    ),
)
def fk_candidates_many(spark, sf_dir):
    """Singular and plural names, columns that name no table, and parents that lack rows; one job looks at all."""
    tables = []
    for name, (source, columns, condition) in _NAMED.items():
        df = table(spark, sf_dir, source).where(condition).select(*[F.col(own).alias(c) for c, own in columns.items()])
        tables.append(table_of(name, df, ["id"] if "id" in columns else []))
    c = Catalog(spark, tables)
    return suggestions_df(spark, validate(c, suggest(c)))


_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}
_WHOLE = {"nation": ["n_regionkey"], "customer": ["c_nationkey"], "supplier": ["s_nationkey"], "part": ["p_size"], "orders": ["o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "events": ["user_id"]}


@query(
    "fk_candidates_by_values",
    " UNION ALL ".join(
        f"SELECT 'public.{t}' AS child_table, '{c}' AS child_column, 'public.{p}' AS parent_table, '{k}' AS parent_column, (SELECT count({c}) > 0 AND count(*) FILTER (WHERE {c} NOT IN (SELECT {k} FROM {p})) = 0 FROM {t}) AS holds"
        for t, columns in _WHOLE.items()
        for c in columns
        for p, k in _KEYS.items()
    ),
)
def fk_candidates_by_values(spark, sf_dir):
    """Every column with every key of its type: sketches of all columns refute most pairs, the others are probed."""
    bare = Catalog(spark, [table_of(n, table(spark, sf_dir, n), [_KEYS[n]] if n in _KEYS else []) for n in STAR])
    held = {replace(s, checked=False) for s in discover(bare)}
    rows = [(s.child, s.column, s.parent, s.parent_column, s in held) for s in pairs_by_type(bare)]
    return spark.createDataFrame(rows, "child_table string, child_column string, parent_table string, parent_column string, holds boolean")


# ---- values as text


@query("sql_literals", "SELECT c_custkey, '''' || replace(c_name || '''s', '''', '''''') || '''' AS quoted, CASE WHEN c_acctbal > 0 THEN 'TRUE' ELSE 'FALSE' END AS flag, CASE WHEN c_custkey % 2 = 0 THEN 'NULL' ELSE CAST(c_custkey AS VARCHAR) END AS number, '''' || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '1 day ' ELSE '2 days ' END || '01:02:0' || c_custkey % 10 || '.5''' AS span, CASE c_custkey % 15 WHEN 0 THEN '''00:00:00''' WHEN 1 THEN '''1 mon''' ELSE '''' || c_custkey % 15 || ' mons''' END AS months FROM customer")
def sql_literals(spark, sf_dir):
    values = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit("'s")).alias("quoted"), (F.col("c_acctbal") > 0).alias("flag"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_custkey")).alias("number"), F.expr("make_dt_interval(int(c_custkey % 3), 1, 2, c_custkey % 10 + 0.5)").alias("span"), F.expr("make_ym_interval(0, int(c_custkey % 15))").alias("months"))
    return values.select("c_custkey", *(sql_literal(F.col(c), t).alias(c) for c, t in values.dtypes[1:]))


@query("array_text", "SELECT c_custkey, '{\"' || c_name || ', x\",' || c_mktsegment || ',NULL,\"\",\"null\",\"say \\\"hi\\\" \\\\\"}' AS names, '{' || CAST(c_acctbal AS DECIMAL(12,2)) || ',NULL}' AS numbers, '{{' || c_custkey || ',' || c_nationkey || '},{' || c_nationkey || '}}' AS nested FROM customer")
def array_texts(spark, sf_dir):
    """Arrays as text, of elements with commas, quotes and backslashes, of empty text and of the word NULL."""
    said = 'say "hi" \\'
    arrays = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.array(F.concat("c_name", F.lit(", x")), "c_mktsegment", F.lit(None), F.lit(""), F.lit("null"), F.lit(said)).alias("names"),
        F.array(F.col("c_acctbal").cast("decimal(12,2)"), F.lit(None)).alias("numbers"),
        F.array(F.array("c_custkey", "c_nationkey"), F.array("c_nationkey")).alias("nested"),
    )
    return arrays.select("c_custkey", *(rendered(F.col(c), t).alias(c) for c, t in arrays.dtypes[1:]))


@query("timestamp_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS plain, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS zoned, strftime(ts, '''%Y-%m-%d %H:%M:%S.%f''') AS plain_literal, strftime(ts, '''%Y-%m-%d %H:%M:%S.%f+00''') AS zoned_literal FROM events")
def timestamp_text(spark, sf_dir):
    """Moments with and without zone, the same in any session's zone."""
    moment = F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', plain))")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("plain")).withColumn("zoned", moment)
    kinds = dict(events.dtypes)
    return events.select("event_id", *(rendered(F.col(c), kinds[c]).alias(c) for c in ("plain", "zoned")), *(sql_literal(F.col(c), kinds[c]).alias(f"{c}_literal") for c in ("plain", "zoned")))


@query("insert_script", "SELECT 'INSERT INTO \"public\".\"nation\" (\"n_nationkey\", \"n_name\", \"n_regionkey\") VALUES (' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''', ' || n_regionkey || ') ON CONFLICT DO NOTHING;' AS value FROM nation")
def insert_script(spark, sf_dir):
    return insert_statements(table(spark, sf_dir, "nation"), "public.nation", on_conflict_do_nothing=True)


@query("copy_script", "SELECT p_partkey || chr(9) || replace(replace(p_name, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't') || chr(9) || CASE WHEN p_size > 25 THEN chr(92) || 'N' ELSE CAST(p_size AS VARCHAR) END AS value FROM part")
def copy_script(spark, sf_dir):
    return copy_lines(table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") <= 25, F.col("p_size")).alias("size")))


@query("uuid_format", "SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT c_custkey, md5(c_name) AS h FROM customer)")
def uuid_format(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", uuid_text(F.unhex(F.md5("c_name"))).alias("uuid"))


@query("rfc3339", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def rfc3339(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", rfc3339_seconds(F.col("ts")).alias("at"))


@query(
    "interval_format",
    "SELECT p_partkey, CASE WHEN m = 0 THEN '' WHEN m = 1 THEN '1 mon ' ELSE m || ' mons ' END || CASE WHEN d = 0 THEN '' WHEN d = 1 THEN '1 day ' ELSE d || ' days ' END || lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS text "
    "FROM (SELECT p_partkey, p_size % 15 AS m, p_partkey % 4 AS d, p_partkey * 37 % 80000 + 1 AS s FROM part)",
)
def interval_format(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", interval_text(F.col("p_size") % 15, F.col("p_partkey") % 4, (F.col("p_partkey") * 37 % 80000 + 1) * 1_000_000).alias("text"))
