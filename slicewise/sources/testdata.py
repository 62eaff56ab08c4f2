"""The registry of the synthetic star-schema tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .catalog import Catalog, table_of

# fixed values: primary keys, and foreign keys as (columns, parent, parent columns)
PRIMARY_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "lineitem": [], "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"],
    "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"],
}
FOREIGN_KEYS = {
    "nation": [(["n_regionkey"], "region", ["r_regionkey"])],
    "customer": [(["c_nationkey"], "nation", ["n_nationkey"])],
    "supplier": [(["s_nationkey"], "nation", ["n_nationkey"])],
    "orders": [(["o_custkey"], "customer", ["c_custkey"])],
    "lineitem": [(["l_orderkey"], "orders", ["o_orderkey"]), (["l_partkey"], "part", ["p_partkey"]), (["l_suppkey"], "supplier", ["s_suppkey"])],
    "events": [(["user_id"], "customer", ["c_custkey"])],
    "labels": [(["doc_id"], "documents", ["doc_id"])],
}


def catalog(spark: SparkSession, sf_dir: str, tables: list[str] | None = None) -> Catalog:
    names = tables or list(PRIMARY_KEYS)
    return Catalog(spark, [table_of(n, spark.read.parquet(f"{sf_dir}/{n}.parquet"), PRIMARY_KEYS[n], [fk for fk in FOREIGN_KEYS.get(n, []) if fk[1] in names]) for n in names])
