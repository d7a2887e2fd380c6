"""Jaccard join of documents' word shingles by chosen paths.

Every distinct shingle set is represented by ``COORDINATES`` minimum hashes.  A run walks a tree of
chosen paths: at each node the sets are split by a sampled shared token (the minimum under one of the
hashes, by which two sets of similarity s agree with probability s); a bucket of at most ``LEAF`` sets
is compared by brute force, a larger one is split again.  Runs are repeated for a document until its
chance of missing a partner at the threshold, the product over its runs of 1 - threshold ** depth, is at
most 1 - ``RECALL``; what is still too large at the deepest level is linked through its least member.

The runs only say which sets belong together.  Each group of sets that they connect is then compared
exactly, shingle by shingle, in blocks: this gives the number of links of every document and the
classes, and no list of pairs.  Equal sets are collapsed first, so copies cost nothing.

Returns for every row id_col, class_id (least id of the class, its own if it has no link) and n_links
(other rows with Jaccard similarity >= threshold).

Cases: null and empty texts, and texts without words, link with nothing; a text of fewer than five words
is one shingle; repeated rows are documents that link with each other; rows with a null id take part, and
class ids are of rows that have one; ties at the threshold are links; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, cut, in_blocks, runs, small, views
from .shingles import batches

THRESHOLD = Fraction(4, 5)
#: Parameters: minimum hashes of a set, sets of a brute-force bucket, deepest level, runs of the first round and of
#: further ones, target recall.
COORDINATES, LEAF, DEPTH, ROUND, FURTHER, RECALL = 64, 64, 6, 6, 18, 0.999
#: Sets of a block of the exact comparison.
BLOCK = 64
#: Shingle columns of one matrix product.
COLUMNS = 4096

_random = np.random.default_rng(20240229)
_XOR = _random.integers(0, 2**32, COORDINATES, dtype=np.uint32)
_TIMES = _random.integers(0, 2**31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum hashes of each (non-empty) shingle set."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, COORDINATES), np.uint32)
    for c in range(COORDINATES):
        out[:, c] = np.minimum.reduceat((short ^ _XOR[c]) * _TIMES[c], bounds[:-1])
    return out


def _sketch(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row_key, id, text -> row_key, id, d1, d2 (digest of the shingles), n, minima."""
    for b in stream:
        data, offsets = views(b.column(2))
        for a, z, found, bounds in batches(data, offsets):
            n = np.diff(bounds)
            d1, d2 = np.zeros(z - a, np.uint64), np.zeros(z - a, np.uint64)
            sketch = np.zeros((z - a, COORDINATES), np.uint32)
            some = np.flatnonzero(n)
            if len(some):
                tight = np.append(bounds[:-1][some], bounds[-1])
                d1[some] = np.add.reduceat(found, tight[:-1])
                d2[some] = np.add.reduceat((found ^ (found >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25), tight[:-1])
                sketch[some] = minima(found, tight)
            raw = pa.Array.from_buffers(pa.binary(COORDINATES * 4), z - a, [None, pa.py_buffer(sketch.tobytes())]).cast(pa.binary())
            part = b.slice(a, z - a)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(n, pa.int64()), raw], names=["row_key", "id", "d1", "d2", "n", "minima"]
            )


def coordinates(run: int) -> list[int]:
    """The hashes that a run splits by, level by level."""
    return np.random.default_rng(1000 + run).permutation(COORDINATES)[:DEPTH].tolist()


def _value(run, level: int, upto: int):
    """The minimum at a level of a run, as four bytes; ``run`` is a column from 0 below ``upto``."""
    places = F.array(*(F.lit(4 * coordinates(r)[level] + 1) for r in range(upto)))
    return F.substring(F.col("minima"), F.element_at(places, run + 1), F.lit(4))


def _similar(least: int):
    """Sets in one leaf -> (a, b): a forest of those that agree in at least ``least`` minima."""

    def inside(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(stream, [0]):
            node = rows.column(1).to_numpy()
            sketch = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint32).reshape(len(node), -1)
            forest, pairs = Forest(), []
            for i in range(1, len(node)):
                for j in np.flatnonzero((sketch[:i] == sketch[i]).sum(axis=1) >= least).tolist():
                    if forest.join(i, j):
                        pairs.append((node[i], node[j]))
            if pairs:
                a, b = np.array(pairs, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return inside


def candidates(sets: DataFrame, threshold: Fraction = THRESHOLD, *, recall: float = RECALL, leaf: int = LEAF, round_: int = ROUND) -> DataFrame:
    """(a, b): links between ``sets`` (node, minima) whose components hold every pair at the threshold, but for 1 - recall."""
    t = float(threshold)
    least = math.floor(COORDINATES * t - 5 * math.sqrt(COORDINATES * t * (1 - t)))
    open_, found, run, before = sets.select("node"), [], 0, None
    while True:
        upto = run + (FURTHER if run else round_)
        rows = open_.join(sets, "node").withColumn("run", F.explode(F.array(*map(F.lit, range(run, upto)))))
        rows = cut(rows.select("node", "run", F.xxhash64("run", _value(F.col("run"), 0, upto)).alias("key")))
        done: list[DataFrame] = []  # (node, key, m, miss): where each path of each run ended
        for level in range(DEPTH):
            shared = cut(rows.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("first")).where("m > 1"))
            dealt = cut(rows.join(shared, "key", "left").select("node", "run", "key", F.coalesce("m", F.lit(1)).alias("m"), "first"))
            large, last = F.col("m") > leaf, level + 1 == DEPTH
            ended = dealt if last else dealt.where(~large)
            done.append(ended.select("node", "key", "m", F.lit(math.log1p(-(t ** (level + 1)))).alias("miss")))
            if last:
                found.append(dealt.where(large & (F.col("node") != F.col("first"))).select(F.col("node").alias("a"), F.col("first").alias("b")))
            if last or shared.where(f"m > {leaf}").isEmpty():
                break
            rows = dealt.where(large).select("node", "run", "key").join(sets, "node")
            rows = cut(rows.select("node", "run", F.xxhash64("key", _value(F.col("run"), level + 1, upto)).alias("key")))
        ends = _union(done)
        parts = ends.where((F.col("m") > 1) & (F.col("m") <= leaf)).select("key", "node").join(sets, "node")
        parts = parts.select("key", "node", "minima").repartition("key").sortWithinPartitions("key", "node")
        found.append(cut(parts.mapInArrow(_similar(least), "a bigint, b bigint").distinct()))
        miss = ends.select("node", "miss") if before is None else ends.select("node", "miss").union(before)
        before = cut(miss.groupBy("node").agg(F.sum("miss").alias("miss")).where(F.col("miss") > math.log1p(-recall)))
        if before.isEmpty():
            return _union(found)
        open_, run = before.select("node"), upto


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.union(x)
    return out


def _exact(threshold: Fraction):
    """Blocks (grp, i, j, own, node, copies, set) -> (node, links, to): links of the pairs that meet here, and a forest."""
    num, den = threshold.numerator, threshold.denominator

    def inside(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(stream, [0, 1, 2]):
            node, which = np.unique(rows.column(4).to_numpy(), return_index=True)
            rows = rows.take(pa.array(which))
            own, copies = rows.column(3).to_numpy(), rows.column(5).to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in rows.column(6).to_pylist()]
            m, sizes = len(node), np.array([len(s) for s in sets])
            if m < 2:
                continue
            owner = np.repeat(np.arange(m), sizes)
            _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            dense = np.cumsum(times > 1) - 1
            keep = times[column] > 1
            owner, column = owner[keep], dense[column[keep]]
            order = np.argsort(column, kind="stable")
            owner, column = owner[order], column[order]
            both = np.zeros((m, m), np.float32)
            for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
                a, z = np.searchsorted(column, [at, at + COLUMNS])
                part = np.zeros((m, min(COLUMNS, int(column[-1]) + 1 - at)), np.float32)
                part[owner[a:z], column[a:z] - at] = 1
                both += part @ part.T
            shared = np.rint(both).astype(np.int64)
            union = sizes[:, None] + sizes[None, :] - shared
            linked = shared * den >= num * union
            np.fill_diagonal(linked, False)
            if rows.column(1)[0].as_py() != rows.column(2)[0].as_py():
                linked &= own[:, None] != own[None, :]
            links = linked @ copies
            forest = Forest()
            for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(linked))), strict=True):
                forest.join(a, b)
            to = node[[forest.root(x) for x in range(m)]]
            some = links > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(to[some])], names=["node", "links", "to"])

    return inside


def _sets(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """grp, node, copies, text -> grp, node, copies, set (sorted distinct shingles)."""
    for b in stream:
        data, offsets = views(b.column(3))
        for a, z, found, bounds in batches(data, offsets):
            part = b.slice(a, z - a)
            sets = [np.unique(found[bounds[i] : bounds[i + 1]]).tobytes() for i in range(z - a)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.binary())], names=["grp", "node", "copies", "set"])


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = THRESHOLD, recall: float = RECALL, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """id_col, class_id, n_links of every row of ``docs``, with row_key (a hash of id and text) and class_key (that of the class's first row)."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(id_col, text_col).alias("row_key"), F.col(id_col).alias("id"), text.alias("text"))
    sketched = cut(rows.mapInArrow(_sketch, f"row_key bigint, id {kind}, d1 bigint, d2 bigint, n bigint, minima binary"))
    least = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "row_key")).alias("least")
    classes = sketched.where("n > 0").groupBy("d1", "d2").agg(F.count("*").alias("copies"), least, F.first("minima").alias("minima"))
    classes = classes.select("d1", "d2", "copies", F.col("least.id").alias("id"), F.col("least.row_key").alias("row_key"), "minima", F.monotonically_increasing_id().alias("node"))
    classes = cut(classes)  # numbers that are written once are the same for all who read them
    groups = components(candidates(classes.select("node", "minima"), threshold, recall=recall, leaf=leaf))
    chosen = cut(groups.join(classes, "node").select("row_key", "node", "copies", F.col("component").alias("grp")))
    texts = rows.join(small(chosen), "row_key").select("grp", "node", "copies", "text")
    sets = texts.mapInArrow(_sets, "grp bigint, node bigint, copies bigint, set binary")
    members = cut(chosen.select("grp", "node"))
    blocks = in_blocks(members, "grp", "node", block).select("grp", "i", "j", "own", "node")
    met = blocks.join(sets.drop("grp"), "node").select("grp", "i", "j", "own", "node", "copies", "set")
    met = met.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    links = cut(met.mapInArrow(_exact(threshold), "node bigint, links bigint, to bigint"))
    parts = components(links.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")))
    first = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "row_key")).alias("first")
    whole = parts.join(classes.select("node", "id", "row_key"), "node").groupBy("component").agg(first)
    by_node = parts.join(cut(whole), "component").select("node", F.col("first.id").alias("class_id"), F.col("first.row_key").alias("class_key"))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.join(by_node, "node", "left").join(counted, "node", "left")
    known = cut(known.select("d1", "d2", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_key", "row_key").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    alone = sketched.where("n = 0").select("id", "row_key", F.col("id").alias("class_id"), F.col("row_key").alias("class_key"), F.lit(0).cast("bigint").alias("n_links"))
    joined = sketched.where("n > 0").select("id", "row_key", "d1", "d2").join(known, ["d1", "d2"]).select("id", "row_key", "class_id", "class_key", "n_links")
    return joined.union(alone).select(F.col("id").alias(id_col), "class_id", "n_links", "row_key", "class_key")
