"""Files of all workspaces in one scan: a data source that lists folder by folder, rules as columns, and a guarded read.

The driver lists upper folders until there are enough of them, and each is a partition that an executor walks; names that begin with
. or _ are listed as others are, and linked folders are not entered.  The folders have to be mounted alike on all machines.
"""

from __future__ import annotations

import json
import os
import re
import stat
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import paths as P

#: Folders that make partitions, where there are as many; files of an Arrow batch.
FOLDERS, BATCH = 64, 1000
#: Folders that are never walked.
IGNORED = (".git", "node_modules", "__pycache__")
TREE = "path string, canonical string, length bigint, modified double, symlink boolean"


class Place(InputPartition):
    def __init__(self, folder: str, deep: bool) -> None:
        self.folder, self.deep = folder, deep


class FileTree(DataSource):
    """Options: roots (a JSON list of folders), ignore (a JSON list of names)."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema: S.StructType) -> DataSourceReader:
        return TreeReader(json.loads(self.options["roots"]), json.loads(self.options.get("ignore", "[]")))


class TreeReader(DataSourceReader):
    def __init__(self, roots: Sequence[str], ignore: Sequence[str]) -> None:
        self.roots, self.ignore = roots, frozenset(ignore)

    def _folders(self, folder: str) -> list[str]:
        with os.scandir(folder) as found:
            return sorted(e.path for e in found if e.is_dir(follow_symlinks=False) and e.name not in self.ignore)

    def partitions(self) -> list[Place]:
        """Folders in order of depth, each with all below it; those that were opened to find more give their own files only."""
        waiting, opened = [r for r in dict.fromkeys(self.roots) if os.path.isdir(r)], []
        while waiting and len(waiting) < FOLDERS:
            below = [f for w in waiting for f in self._folders(w)]
            if not below:
                break
            opened, waiting = opened + waiting, below
        return [Place(f, False) for f in opened] + [Place(f, True) for f in waiting] or [Place("", False)]

    def read(self, partition: Place) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for folder, folders, names in os.walk(partition.folder) if partition.folder else ():
            folders[:] = sorted(f for f in folders if f not in self.ignore) if partition.deep else []
            for name in sorted(names):
                path = os.path.join(folder, name)
                try:
                    link = os.path.islink(path)
                    found = os.stat(path)
                except OSError:  # a link to nothing, or a file that went meanwhile
                    continue
                if stat.S_ISREG(found.st_mode):
                    rows.append((path, os.path.realpath(path) if link else path, found.st_size, found.st_mtime, link))
                if len(rows) >= BATCH:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "canonical", "length", "modified", "symlink"])


def glob_root(pattern: str) -> str:
    """The folder that an absolute glob can't leave: what stands before its first part with a sign."""
    parts = pattern.replace("\\", "/").split("/")
    first = next((i for i, p in enumerate(parts) if re.search(r"[*?\[]", p)), len(parts) - 1)
    return "/".join(parts[:first]) or "/"


def tree(spark: SparkSession, roots: Sequence[str], ignore: Sequence[str] = IGNORED) -> DataFrame:
    """TREE: all files below ``roots``, each once; missing folders are empty ones."""
    real = sorted({os.path.realpath(r) for r in roots})
    outer = [r for r in real if not any(r != o and (r + "/").startswith(o.rstrip("/") + "/") for o in real)]
    spark.dataSource.register(FileTree)
    return spark.read.format("file_tree").options(roots=json.dumps(outer), ignore=json.dumps(list(ignore))).load()


def workspace_files(spark: SparkSession, workspaces: Sequence[dict], *, policy: P.PathPolicy | None = None, ignore: Sequence[str] = IGNORED) -> DataFrame:
    """workspace_id, source_id, bucket, identity, path, length, modified, deny_reason of the files of all workspaces, in one scan.

    A workspace (id, root or none, sources) has sources (id, root, type, include, exclude); an include that is an absolute glob
    is matched with the whole path, and without a root of the source its stable folder is one.  Of a workspace's sources that take
    one file the later wins.  The identity is the path below the workspace's root, else below the source's, else the path.  A link is denied
    unless the policy allows links; what it leads to must lie below the source's root either way.
    """
    policy = policy or P.PathPolicy()
    taken, roots = [], []
    for w in workspaces:
        above, found = os.path.realpath(w["root"]).rstrip("/") + "/" if w.get("root") else None, None
        for s in w["sources"]:
            includes = s.get("include") or ["**/*"]
            root = os.path.realpath(s.get("root") or glob_root(includes[0])).rstrip("/") + "/"
            roots.append(root)
            rest = F.substring("path", len(root) + 1, 1_000_000)
            match = F.lit(False)
            for glob in includes:
                whole = glob.startswith("/")
                pattern = P.path_glob_pattern(os.path.realpath(glob_root(glob)) + glob[len(glob_root(glob)) :] if whole else glob)
                match = match | F.rlike(F.col("path") if whole else rest, F.lit(pattern))
            own = F.startswith("path", F.lit(root)) & match & ~P.excluded(rest, tuple(s.get("exclude") or ())) & ~P.ignored(rest, tuple(ignore))
            identity = rest if above is None else F.when(F.startswith("path", F.lit(above)), F.substring("path", len(above) + 1, 1_000_000)).otherwise(rest)
            outside = ~F.startswith("canonical", F.lit(root))
            denied = F.when(outside, "outside the roots").otherwise(P.deny_reason(F.col("path"), F.col("length"), policy))
            denied = denied if policy.allow_symlinks else F.when(F.col("symlink"), F.coalesce(F.when(outside, "outside the roots"), F.lit("symlink"))).otherwise(denied)
            item = F.when(own, F.struct(F.lit(w["id"]).alias("workspace_id"), F.lit(s["id"]).alias("source_id"), P.bucket_of(F.lit(s.get("type"))).alias("bucket"), identity.alias("identity"), denied.alias("deny_reason")))
            found = item if found is None else F.coalesce(item, found)
        if found is not None:
            taken.append(found)
    if not taken:
        return spark.createDataFrame([], "workspace_id string, source_id string, bucket string, identity string, path string, length bigint, modified double, deny_reason string")
    rows = tree(spark, roots, ignore).withColumn("s", F.explode(F.filter(F.array(*taken), lambda x: x.isNotNull())))
    return rows.select("s.workspace_id", "s.source_id", "s.bucket", "s.identity", "path", "length", "modified", "s.deny_reason")


def read_files(files: DataFrame, *, policy: P.PathPolicy | None = None) -> DataFrame:
    """``files`` (path, ...) with ``content``; null, and ``read_error`` says why, where the file has gone, has become a link or too large meanwhile."""
    policy = policy or P.PathPolicy()
    at, most, links = files.columns.index("path"), policy.max_bytes, policy.allow_symlinks
    schema = S.StructType([*files.schema.fields, S.StructField("content", S.BinaryType()), S.StructField("read_error", S.StringType())])

    def one(path: str) -> tuple[bytes | None, str | None]:
        try:
            handle = os.open(path, os.O_RDONLY | (0 if links else os.O_NOFOLLOW))
        except OSError as error:
            return None, "symlink" if not links and os.path.islink(path) else error.strerror
        with os.fdopen(handle, "rb") as f:
            found = f.read(most + 1)
        return (None, "too large") if len(found) > most else (found, None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 64):  # at most 64 files are in memory
                part = b.slice(start, 64)
                found = [one(p) for p in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.string())], names=schema.names)

    return files.mapInArrow(read, schema)
