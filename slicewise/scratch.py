"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: used only where the session names no folder and all runs on one machine, as in tests
LOCAL_SHARED_DIR = "/tmp/checkpoints"
#: memory that a written table may take where it is gathered on the driver and sent to all tasks
BROADCAST_BYTES = 8 << 20


class NoSharedFolder(RuntimeError):
    """A cluster's session that names no folder which driver and executors share."""


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    A session with a local master may do without; on a cluster tables written to
    machine-local folders would lose rows, so that is refused.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named and context.master.split("[")[0] != "local":
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_SHARED_DIR).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_dir(spark)}/slicewise/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def freeze(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage so that a lost executor costs only the running stage, gives
    later joins a table of known size, and pins whatever was not deterministic.
    The folder follows the cluster's retention of ``spark.checkpoint.dir``.
    """
    path = new_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent_if_small(kept: DataFrame) -> DataFrame:
    """Rows that were written, as the side of a join that Spark may broadcast: beyond ``BROADCAST_BYTES`` the join is by a shuffle.

    Spark goes by the size of files, in which keys that follow one another take a small part of the memory that they
    take in a broadcast's hash table. So rows are counted, which reads the ends of files, and the lengths of texts added.
    """
    texts = [F.coalesce(F.sum(F.octet_length(F.col(f"`{f.name}`"))), F.lit(0)) for f in kept.schema if isinstance(f.dataType, (StringType, BinaryType))]
    rows, *lengths = kept.agg(F.count("*"), *texts).first()
    held = rows * (64 + 16 * len(kept.columns)) + 2 * sum(lengths)  # a key and a row each, and the table's own
    return kept.hint("merge") if held > BROADCAST_BYTES else kept


def freeze_parts(parts: Iterable[DataFrame], label: str) -> DataFrame | None:
    """The union of parts with the same columns, each written before the next one is
    asked for, so that what only one part needs (a broadcast, an index) is gone by then."""
    paths, schema, spark = [], None, None
    for part in parts:
        spark, schema = part.sparkSession, part.schema
        paths.append(f"{paths[0].rsplit('/', 1)[0] if paths else new_path(spark, label)}/{len(paths):06d}")
        part.write.option("compression", "zstd").parquet(paths[-1])
        del part
    return spark.read.schema(schema).parquet(*paths) if paths else None
