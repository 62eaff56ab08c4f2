"""Reading inputs, and cutting lineage with tables in the cluster's shared folder.

Every operator follows the same rules for odd input: the columns it works on
are selected into names of its own first, so extra columns never clash with
internal ones; a null text counts as empty; an empty table gives an empty
result with the documented columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import freeze, freeze_parts  # noqa: F401  the operators' way to cut lineage


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


#: bytes of ids that may be broadcast
BROADCAST_BYTES = 64 << 20


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not among ``ids``; a null id always stays.

    The ids are broadcast if they are known to be few, and joined by a shuffle otherwise.
    """
    ids = freeze(ids.select(id_col).where(F.col(id_col).isNotNull()).distinct(), "dropped_ids")
    return docs.join(F.broadcast(ids) if ids.count() * 32 <= BROADCAST_BYTES else ids, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def with_row_key(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with a column that tells its rows apart and orders them as the ids do, nulls last; and its name.

    Where no id is null or repeated that is the id. Otherwise rows are numbered on a copy, so that
    the numbers stay: the key is then (whether the id is null, id, number).
    """
    name = "row_key"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    shared = docs.groupBy(id_col).count().where(f"count > 1 OR `{id_col}` IS NULL").limit(1).count()
    if not shared:
        return docs.withColumn(name, F.col(id_col)), name
    key = F.struct(F.isnull(id_col).alias("last"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("number"))
    return freeze(docs.withColumn(name, key), "numbered_rows"), name


def with_text_key(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a column that tells texts apart, null counting as empty; and its name."""
    name = "text_key"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.withColumn(name, F.sha2(text_or_empty(text_col).cast("binary"), 256)), name
