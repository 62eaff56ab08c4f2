"""Tables of a folder that change together.

A folder's tables are where its pointer file says, ``{version, tables: {name: [folders]}}``; tables that it
doesn't name are where they always were. A change writes new tables to a folder of its own that nobody reads,
and is published by replacing the pointer, which a file system does at once or not at all. So a reader that
has read the pointer sees one state of all tables, and a change that stops half way is never seen.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER, FOLDER = ".current.json", ".versions"


class ChangedMeanwhile(RuntimeError):
    """Somebody else has published since a change began."""


class Versions:
    """The pointer of a folder, and what it pointed to when this was made."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.version, self.tables = self._read()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _system(self):
        return self._path(POINTER).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self) -> tuple[str, dict[str, list[str]]]:
        if not self._system().exists(self._path(POINTER)):
            return "", {}
        stream = self._system().open(self._path(POINTER))
        try:
            said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return said["version"], said["tables"]

    def folders(self, name: str) -> list[str]:
        """Where the pointer says that a table is; none if it doesn't name it."""
        return [f"{self.root}/{folder}" for folder in self.tables.get(name, [])]

    def begin(self) -> str:
        """The name of a new version."""
        return uuid.uuid4().hex

    def staged(self, version: str, name: str) -> str:
        """The folder of a table of a version that isn't published yet."""
        return f"{self.root}/{FOLDER}/{version}/{name}"

    def publish(self, version: str, tables: dict[str, list[str]]) -> None:
        """Points to these folders (all below the root), and for other tables to where they are; all at once."""
        if self._read()[0] != self.version:
            raise ChangedMeanwhile(f"{self.root} has been loaded since")
        inside = {name: [folder.removeprefix(f"{self.root}/") for folder in folders] for name, folders in tables.items()}
        said = json.dumps({"version": version, "tables": self.tables | inside})
        system, draft = self._system(), self._path(f"{FOLDER}/{version}/{POINTER}")
        out = system.create(draft, True)
        try:
            out.write(bytearray(said.encode()))
        finally:
            out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        hadoop = jvm.org.apache.hadoop.fs
        how = gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        hadoop.FileContext.getFileContext(self._path(POINTER).toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, self._path(POINTER), how)
        self.version, self.tables = version, self.tables | inside

    def discard(self, version: str) -> None:
        """Removes what a version that wasn't published has written."""
        self._system().delete(self._path(f"{FOLDER}/{version}"), True)

    def vacuum(self) -> list[str]:
        """Removes versions that the pointer names no folder of, and returns their names; nobody may be loading or reading them."""
        system, gone = self._system(), []
        if not system.exists(self._path(FOLDER)):
            return gone
        used = {folder.split("/")[1] for folders in self.tables.values() for folder in folders if folder.startswith(f"{FOLDER}/")}
        for status in system.listStatus(self._path(FOLDER)):
            name = status.getPath().getName()
            if name not in used:
                system.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)


def loaded(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables that were loaded into a folder, all of one state."""
    versions = Versions(spark, root)
    return {name: spark.read.parquet(*versions.folders(name)) for name in versions.tables}
