"""The keys that a fixpoint has found so far, kept so that a round costs what it finds, not what there is.

They lie in a table bucketed by their hash in the shared folder. Each round appends its own; what is new among the rows found
next is told by a join that shuffles those rows to the buckets and leaves the table where it is. After some rounds the
files of a bucket are written as one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_path
from .keys import identity

COMPACT_AFTER = 16
KEY = "seen_key"  # one column, so that a join's keys are just what the table is bucketed by


class Seen:
    """Keys of one table: its rows' values of ``columns``, nulls being equal."""

    def __init__(self, spark: SparkSession, columns: Sequence[str], compact_after: int = COMPACT_AFTER) -> None:
        self._spark, self._columns, self._compact_after = spark, list(columns), compact_after
        self._buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._name, self._parts = "", 0

    def __enter__(self) -> Seen:
        return self

    def __exit__(self, *_: object) -> None:
        self._drop(self._name)

    def _drop(self, name: str) -> None:
        if name:
            self._spark.sql(f"DROP TABLE IF EXISTS {name}")  # its files follow the folder's retention

    def _append(self, keys: DataFrame, fresh: bool) -> None:
        if fresh:
            self._name, self._path = f"slicewise_seen_{uuid.uuid4().hex}", new_path(self._spark, "seen")
        keys.write.format("parquet").option("path", self._path).bucketBy(self._buckets, KEY).mode("append").saveAsTable(self._name)

    def add(self, rows: DataFrame) -> None:
        """Remember the rows' keys; ``rows`` is read once. A job that fails has added nothing."""
        keys = rows.select(identity(rows, self._columns).alias(KEY)).repartition(self._buckets, KEY).dropDuplicates()
        self._append(keys, fresh=not self._name)
        self._parts += 1
        if self._parts > self._compact_after:
            old = self._name
            self._append(self._spark.table(old), fresh=True)
            self._drop(old)
            self._parts = 1

    def new(self, rows: DataFrame) -> DataFrame:
        """The rows whose keys haven't been added, each as often as it is there."""
        if not self._name:
            return rows
        wide = rows.withColumn(KEY, identity(rows, self._columns))
        return wide.join(self._spark.table(self._name).hint("merge"), KEY, "left_anti").select(*[F.col(f"`{c}`") for c in rows.columns])
