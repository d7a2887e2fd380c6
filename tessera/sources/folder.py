"""A folder on whatever store Spark writes, reached through Hadoop's file system: small JSON files, and sizes."""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Somebody else has committed first."""


class Folder:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.java = self.jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.system = self.java.Path(self.path).getFileSystem(self.conf)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def exists(self, name: str) -> bool:
        return self.system.exists(self.java.Path(self.at(name)))

    def names(self, below: str = "") -> list[str]:
        """Names in a folder, none if there is no such folder."""
        place = self.java.Path(self.at(below) if below else self.path)
        return sorted(s.getPath().getName() for s in self.system.listStatus(place)) if self.system.exists(place) else []

    def size(self, name: str) -> int:
        """Bytes of a file, or of all files below a folder."""
        return self.system.getContentSummary(self.java.Path(self.at(name))).getLength()

    def delete(self, name: str) -> None:
        self.system.delete(self.java.Path(self.at(name)), True)

    def move(self, name: str, to: str) -> None:
        if not self.system.rename(self.java.Path(self.at(name)), self.java.Path(self.at(to))):
            raise OSError(f"{self.at(name)} can't be moved to {self.at(to)}")

    def read(self, name: str) -> dict | None:
        path = self.java.Path(self.at(name))
        if not self.system.exists(path):
            return None
        stream = self.system.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _aside(self, name: str, content: dict):
        head, _, last = name.rpartition("/")
        path = self.java.Path(self.at(f"{head}/.{last}-{uuid.uuid4().hex}" if head else f".{last}-{uuid.uuid4().hex}"))
        stream = self.system.create(path, True)
        stream.write(bytearray(json.dumps(content, indent=2, sort_keys=True).encode()))
        stream.close()
        return path

    def _rename(self, path, name: str, how) -> None:
        gateway = self.spark.sparkContext._gateway
        options = gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = how
        self.java.FileContext.getFileContext(self.system.getUri(), self.conf).rename(path, self.java.Path(self.at(name)), options)

    def write(self, name: str, content: dict) -> None:
        """Replace a file in one step: a reader finds the old one or the new one."""
        self._rename(self._aside(name, content), name, self.java.Options.Rename.OVERWRITE)

    def create(self, name: str, content: dict) -> None:
        """Write a file that must not exist, whole or not at all; of several writers one wins, the others get Conflict.

        A local disk renames over an existing file, so there a hard link is made, which can't.
        """
        aside = self._aside(name, content)
        try:
            if self.system.getUri().getScheme() == "file":
                plain = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(plain(self.java.Path(self.at(name))), plain(aside))
                self.system.delete(aside, False)
            else:
                self._rename(aside, name, self.java.Options.Rename.NONE)
        except Py4JJavaError as error:
            self.system.delete(aside, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(name) from None
            raise

    def table(self, rows: DataFrame, name: str, **options) -> DataFrame:
        """``rows`` as a table of this folder, read back with their types."""
        rows.write.parquet(self.at(name), **options)
        return self.spark.read.schema(rows.schema).parquet(self.at(name))


class Versions:
    """A sequence of committed states in a folder, each a JSON file of its own number: compare-and-swap by creating the next one."""

    def __init__(self, folder: Folder, prefix: str = "version") -> None:
        self.folder, self.prefix = folder, prefix

    def latest(self) -> tuple[int, dict | None]:
        """(number, state) of the newest version; (0, None) if there is none."""
        found = [n for n in self.folder.names() if n.startswith(f"{self.prefix}-") and n.endswith(".json")]
        return (int(found[-1].removeprefix(f"{self.prefix}-").removesuffix(".json")), self.folder.read(found[-1])) if found else (0, None)

    def commit(self, after: int, state: dict) -> int:
        """Make ``state`` the version that follows ``after``; Conflict if another one does already."""
        self.folder.create(f"{self.prefix}-{after + 1:012d}.json", state)
        return after + 1

    def forget(self, keep: int = 2) -> None:
        """Delete all but the newest versions."""
        found = [n for n in self.folder.names() if n.startswith(f"{self.prefix}-") and n.endswith(".json")]
        for name in found[:-keep]:
            self.folder.delete(name)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of this application below the shared one that the cluster names; a temporary one only on a local master without it."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{context.applicationId}"
