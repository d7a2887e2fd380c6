"""Helpers that several operators share: cutting lineage, components, blocks of groups, byte views of text."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of bytes other than these: space, and tab to carriage return.
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: What holds while a table is written: its shuffle files go, and Python gets batches of so many bytes, however long texts are.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 22)}
#: Rows up to which a side is broadcast; beyond it a join shuffles.
BROADCAST_ROWS = 500_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set, as in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a Parquet table in the shared checkpoint folder: computed once, and safe when executors are lost.

    A table has a size of its own.  checkpoint() keeps the estimate of the plan that it cuts, and through
    the joins of a loop that estimate grows to numbers of millions of digits.  The shuffle files of the plan that is
    cut go as soon as the table stands; nothing reads them again.
    """
    spark = df.sparkSession
    place = f"{checkpoint_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WHILE_WRITING}
    try:
        for k, v in WHILE_WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(place)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(place)
    out.tessera_place = place
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of ``cut`` that nothing will read again, now that all that came from it is written."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.tessera_place)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already cut) with a broadcast hint if it has at most ``rows`` rows, else unchanged: Spark then shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b): the smallest node that can be reached; nodes without edges are absent.

    Alternating large-star and small-star steps.  Each step is an aggregation with partial minima and
    a join of two plain shuffles, so a hub's rows are split by skew joins; no neighbour list is built.
    """
    spark = edges.sparkSession
    at = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if at.isEmpty():
        return spark.createDataFrame([], f"node {edges.schema['a'].dataType.simpleString()}, component {edges.schema['a'].dataType.simpleString()}")
    before = None
    while True:
        both = at.union(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.union(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(low, "a")
        at = cut(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = at.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return cut(stars.union(at.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())


def in_blocks(rows: DataFrame, group: str, key: str, block: int) -> DataFrame:
    """``rows`` with columns i, j, own: a row once for each pair of blocks (i <= j) of its group that it belongs to.

    Blocks are dealt by a hash of ``key``; a group of at most ``block`` rows is one block.  Two rows of a
    group meet in exactly one (group, i, j), and no task holds more than two blocks.
    """
    sizes = cut(rows.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64(key, F.lit(17)), F.col("blocks")).cast("int")
    dealt = rows.join(sizes, group).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks")


def views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def groups_of(offsets: np.ndarray, limit: int):
    """(from, to) of consecutive texts of at most ``limit`` bytes together; a longer text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


class Forest:
    """Union-find over small integers; the root of a set is its least member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def runs(batches, keys: list[int]):
    """Consecutive rows with equal values in the (integer) columns ``keys``, as record batches, across batches.

    The rows must come sorted by those columns.
    """
    held: list[pa.RecordBatch] = []
    value = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for a, z in zip(starts[:-1], starts[1:], strict=True):
            now = tuple(c[a] for c in columns)
            if now != value and held:
                yield _one(held)
                held = []
            held.append(b.slice(a, z - a))
            value = now
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... within each group ``by``, in ascending ``order``, nulls first; equal rows in any order.

    Rows are dealt in ranges of (hash of the group, order), so a group of any size lies in as many ranges as it needs.  What lies in
    the ranges before is a mark, a row of its own, that stands before the others of its range in one running sum; no
    rows are joined, and no task holds more than a range.  Spark's sample of the ranges' bounds goes to the driver: some 300 short rows a
    partition.
    """
    part, before, mark = f"{name}_range", f"{name}_before", f"{name}_mark"
    group = [F.xxhash64(*by)] if by else []
    dealt = cut(rows.repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*by, part).agg(F.count("*").alias(mark)).withColumn(before, F.sum(mark).over(earlier))
    marks = counts.where(f"{before} > 0").select(*by, part, F.col(before).alias(mark))
    both = dealt.withColumn(mark, F.lit(None).cast("bigint")).unionByName(marks, allowMissingColumns=True)
    running = Window.partitionBy(*by, part).orderBy(F.col(mark).asc_nulls_last(), *order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.sum(F.coalesce(mark, F.lit(1))).over(running)).where(F.col(mark).isNull()).drop(mark, part)
