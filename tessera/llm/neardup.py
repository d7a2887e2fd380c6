"""Near-duplicate vectors by NN-descent, within equal labels, at a cosine threshold.

Every vector has a list of its ``NEIGHBOURS`` best neighbours so far, whatever their cosine, so that the lists make a
graph that can be walked also where near-duplicates are rare.  A few random-projection trees fill the lists first:
vectors whose projections have the same signs are compared in small buckets.  Then rounds of NN-descent refine them:
around each vector its neighbours, and those that have it as a neighbour, are compared with each other if one of
those edges is new, and what beats the last entry of a list enters it.  A round's vectors travel in single precision;
it ends the descent if hardly any list changed.  A list whose entries all reach the threshold is saturated and may
hide others, so it is enlarged to all the vectors that its links reach, compared by brute force in blocks; this gives
exact numbers of links there.  Lists that aren't saturated hold all links of their vectors; a closing round compares
the ends of links that meet.  Links are the edges with cosine >= threshold in double precision.  Equal vectors are
collapsed first.

The recall of links is audited on a bounded sample of vectors against all rows, each vector with links counting alike;
below ``TARGET`` more trees are planted and the descent goes on, and the job fails if the last planting still misses it.

Returns a row per vector: id, n_links, component_id (least id reachable), kept (id = component_id).

Cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null
label or a null id, link with nothing; vectors of different lengths link with nothing; repeated rows
link with each other; of equal cosines the least number enters a list; a null id has component_id null and kept
false; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, cut, in_blocks, runs, small

THRESHOLD = 0.93
#: Parameters: length of a list, trees of a planting, vectors of a bucket, rounds of a descent and plantings.
NEIGHBOURS, TREES, BUCKET, ROUNDS, PLANTINGS = 16, 8, 96, 12, 6
#: Share of the lists' entries that a round must change for another; vectors of the audit; recall that it asks for.
STILL, AUDITED, TARGET = 0.001, 400, 0.98
BLOCK = 64
#: What single precision may take from a cosine.
SLACK = 1e-5
#: How far below the threshold a neighbour makes a vector one that the audit asks on purpose.
MARGIN = 0.05
log = logging.getLogger(__name__)


def _unit(raw: list[bytes], kind: type = np.float64) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)
    return v if kind == np.float32 else v / np.linalg.norm(v, axis=1, keepdims=True)


def _pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """space, node, copies, list of double -> the same with the vector as bytes of doubles, and of unit length in single precision."""
    for b in stream:
        raw = [np.asarray(x, np.float64) for x in b.column(3).to_pylist()]
        short = [(x / np.linalg.norm(x)).astype(np.float32).tobytes() for x in raw]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([x.tobytes() for x in raw], pa.binary()), pa.array(short, pa.binary())], names=["space", "node", "copies", "v", "u"])


def _codes(first: int, trees: int):
    """Adds the sign bits of each tree's projections: 60 bits a tree."""

    def inside(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in stream:
            raw = b.column(2).to_pylist()
            out = np.zeros((len(raw), trees), np.int64)
            sizes = np.array([len(x) for x in raw])
            for size in np.unique(sizes).tolist():
                if size not in planes:
                    planes[size] = np.random.default_rng(77).standard_normal((first + trees, 60, size // 4))[first:]
                at = np.flatnonzero(sizes == size)
                v = _unit([raw[i] for i in at], np.float32)
                for t in range(trees):
                    out[at, t] = ((v @ planes[size][t].T) > 0) @ (1 << np.arange(60, dtype=np.int64))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * trees, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, flat], names=["space", "node", "u", "codes"])

    return inside


def _nearest(k: int):
    """Buckets (key, part, node, u) -> (node, other, cos): each node's best k of the bucket."""

    def inside(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(stream, [0, 1]):
            if rows.num_rows < 2:
                continue
            node, v = rows.column(2).to_numpy(), _unit(rows.column(3).to_pylist(), np.float32)
            cos = v @ v.T
            np.fill_diagonal(cos, -2.0)
            best = np.argsort(-cos, axis=1, kind="stable")[:, : min(k, len(node) - 1)]
            a = np.repeat(np.arange(len(node)), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[best.ravel()]), pa.array(cos[a, best.ravel()])], names=["node", "other", "cos"])

    return inside


def planted(vectors: DataFrame, first: int, trees: int, bucket: int, k: int) -> DataFrame:
    """Edges (node, other, cos) inside the leaves of random-projection trees ``first`` and on."""
    sizes = cut(vectors.groupBy("space").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / bucket))).cast("int").alias("depth")))
    coded = vectors.select("space", "node", "u").mapInArrow(_codes(first, trees), "space bigint, node bigint, u binary, codes array<bigint>")
    rows = coded.join(small(sizes), "space").select("space", "depth", "node", "u", F.posexplode("codes").alias("tree", "code"))
    prefix = F.expr("code & (shiftleft(1L, least(depth, 60)) - 1)")
    rows = rows.select(F.xxhash64("space", "tree", prefix).alias("key"), "node", "u")
    counts = cut(rows.groupBy("key").agg(F.ceil(F.count("*") / (2 * bucket)).cast("int").alias("parts")))
    # a leaf that no plane splits is dealt in parts here; the descent joins them
    dealt = rows.join(counts, "key").withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
    met = dealt.select("key", "part", "node", "u").repartition("key", "part").sortWithinPartitions("key", "part", "node")
    return met.mapInArrow(_nearest(k), "node bigint, other bigint, cos float")


def _around(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a middle (mid, node, new, last, u) -> (node, other, cos) for what beats the last entry of a node's list."""
    for rows in runs(stream, [0]):
        node, first = np.unique(rows.column(1).to_numpy(), return_index=True)
        if len(node) < 2:
            continue
        # a node that is there twice is new if one of its edges is
        new = np.zeros(len(node), bool)
        np.logical_or.at(new, np.searchsorted(node, rows.column(1).to_numpy()), rows.column(2).to_numpy(zero_copy_only=False))
        rows = rows.take(pa.array(first))
        last, u = rows.column(3).to_numpy(), _unit(rows.column(4).to_pylist(), np.float32)
        cos = u @ u.T
        np.fill_diagonal(cos, -2.0)
        a, b = np.nonzero((cos > last[:, None]) & (new[:, None] | new[None, :]))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(cos[a, b])], names=["node", "other", "cos"])


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The lists: each node's best k of the edges (node, other, cos, new); of an edge that is known the old one counts."""
    once = edges.groupBy("node", "other").agg(F.max("cos").alias("cos"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("cos").desc(), "other"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def descend(vectors: DataFrame, lists: DataFrame, k: int, rounds: int = ROUNDS) -> DataFrame:
    """``lists`` (node, other, cos, new, rank) after rounds of neighbours-of-neighbours joins, until hardly any entry is new."""
    total = lists.count()
    for _ in range(rounds):
        if lists.where("new").count() <= STILL * total:
            break
        # those that have a node as a neighbour: as many as a list holds, in the order of a hash
        turn = F.row_number().over(Window.partitionBy("other").orderBy(F.xxhash64("node", "other"), "node"))
        back = lists.withColumn("turn", turn).where(F.col("turn") <= k).select(F.col("other").alias("mid"), F.col("node"), "new")
        members = lists.select(F.col("node").alias("mid"), F.col("other").alias("node"), "new").union(back)
        asked = lists.where("new").select(F.col("node").alias("mid")).union(lists.where("new").select("other")).distinct()
        last = lists.groupBy("node").agg(F.when(F.count("*") < k, F.lit(-2.0)).otherwise(F.min("cos")).cast("float").alias("last"))
        cards = vectors.select("node", "u").join(last, "node")
        met = members.join(asked, "mid", "left_semi").join(cards, "node").select("mid", "node", "new", "last", "u")
        found = met.repartition("mid").sortWithinPartitions("mid").mapInArrow(_around, "node bigint, other bigint, cos float")
        old = lists.select("node", "other", "cos", F.lit(False).alias("new"))
        lists = cut(_best(old.union(cut(found.distinct()).withColumn("new", F.lit(True))), k))
        total = max(total, 1)
    return lists


def _cosines(threshold: float):
    """(a, b, va, vb) -> (a, b) of those whose cosine in double precision reaches the threshold."""

    def inside(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            if b.num_rows:
                sizes = np.array([len(x) for x in b.column(2).to_pylist()])
                for size in np.unique(sizes).tolist():
                    part = b.take(pa.array(np.flatnonzero(sizes == size)))
                    cos = np.einsum("ij,ij->i", _unit(part.column(2).to_pylist()), _unit(part.column(3).to_pylist()))
                    keep = pa.array(np.flatnonzero(cos >= threshold))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep)], names=["a", "b"])

    return inside


def linked(vectors: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b), a < b, of ``pairs`` that are links."""
    v = vectors.select("node", "v")
    met = pairs.join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b").select("a", "b", "va", "vb")
    return met.mapInArrow(_cosines(threshold), "a bigint, b bigint")


def graph_links(vectors: DataFrame, lists: DataFrame, threshold: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(links (a, b), saturated nodes): the graph's edges at the threshold, closed where two links meet at a list that isn't saturated."""
    edges = lists.where(F.col("cos") >= threshold - SLACK)
    saturated = cut(edges.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("node"))
    pairs = edges.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    links = cut(linked(vectors, pairs, threshold))
    both = links.union(links.select("b", "a"))
    ends = both.join(saturated.withColumnRenamed("node", "a"), "a", "left_anti")  # fewer than k around each
    meet = ends.toDF("mid", "a").join(ends.toDF("mid", "b"), "mid").where("a < b").select("a", "b").distinct()
    more = cut(linked(vectors, meet.join(links, ["a", "b"], "left_anti"), threshold))
    return cut(links.union(more)), saturated


def audit(vectors: DataFrame, links: DataFrame, whole: DataFrame, threshold: float, sample: int = AUDITED, near: DataFrame | None = None) -> float:
    """Share of a vector's true links that the graph has, averaged over those of a bounded sample (by hash, against all rows) that have links.

    About ``sample`` of all vectors are asked, and as many of ``near`` (node), those that have a neighbour close to the threshold: where links
    are rare hardly any vector of the first sample has one.  How many linked vectors were seen goes to the log.
    ``whole`` (node, component) are the components that are compared by brute force: links inside them aren't missed.
    """
    n = vectors.count()
    take = vectors.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(max(1, n))) < sample).limit(2 * sample)
    take = take.select("space", "node", "v")
    if near is not None:
        some = near.where(F.pmod(F.xxhash64("node", F.lit(6)), F.lit(max(1, near.count()))) < sample)
        take = take.union(vectors.join(some, "node", "left_semi").select("space", "node", "v").limit(2 * sample))
    asked: dict[int, list[tuple[int, bytes]]] = {}
    for space, node, v in {r.node: r for r in take.collect()}.values():  # bounded by ``sample``
        asked.setdefault(space, []).append((node, bytes(v)))

    def inside(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = {s: (np.array([n for n, _ in q], np.int64), _unit([v for _, v in q])) for s, q in asked.items()}
        for b in stream:
            space, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            raw = b.column(2).to_pylist()
            for s in np.unique(space).tolist():
                if s in queries:
                    at = np.flatnonzero(space == s)
                    ids, q = queries[s]
                    x, y = np.nonzero((q @ _unit([raw[i] for i in at]).T) >= threshold)
                    keep = ids[x] != node[at[y]]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[x[keep]]), pa.array(node[at[y[keep]]])], names=["a", "b"])

    true = cut(vectors.select("space", "node", "v").mapInArrow(inside, "a bigint, b bigint"))
    known = links.union(links.select("b", "a")).withColumn("known", F.lit(True))
    judged = true.join(known, ["a", "b"], "left").join(whole.toDF("a", "ca"), "a", "left").join(whole.toDF("b", "cb"), "b", "left")
    hit = F.coalesce(F.col("known"), F.col("ca") == F.col("cb"), F.lit(False))
    share = judged.groupBy("a").agg((F.count_if(hit) / F.count("*")).alias("share"))
    seen, found = share.agg(F.count("*"), F.avg("share")).first()
    log.info("audit: recall %s over %d linked vectors of %d asked", found, seen, sum(map(len, asked.values())))
    return 1.0 if found is None else found


def _count(threshold: float):
    """Blocks (grp, i, j, own, node, copies, v) -> (node, links)."""

    def inside(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(stream, [0, 1, 2]):
            own, node, copies = (rows.column(c).to_numpy() for c in (3, 4, 5))
            v = _unit(rows.column(6).to_pylist())
            linked = (v @ v.T) >= threshold
            np.fill_diagonal(linked, False)
            if rows.column(1)[0].as_py() != rows.column(2)[0].as_py():
                linked &= own[:, None] != own[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array((linked @ copies).astype(np.int64))], names=["node", "links"])

    return inside


def near_duplicates(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS, target: float = TARGET, bucket: int = BUCKET, trees: int = TREES, rounds: int = ROUNDS) -> DataFrame:
    """id_col, n_links, component_id, kept of every row."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce((F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))
    seen = rows.select(F.col(id_col).alias("id"), valid.alias("valid"), F.when(valid, F.xxhash64(label_col, F.size(v))).alias("space"), F.when(valid, v).alias("v"))
    nodes = cut(seen.where("valid").groupBy("space", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    vectors = cut(nodes.select("space", "node", "copies", "v").mapInArrow(_pack, "space bigint, node bigint, copies bigint, v binary, u binary"))
    lists = None
    for planting in range(PLANTINGS):
        fresh = planted(vectors, planting * trees, trees, bucket, neighbours).withColumn("new", F.lit(True))
        known = fresh if lists is None else lists.select("node", "other", "cos", F.lit(False).alias("new")).union(fresh)
        lists = cut(_best(known, neighbours))
        lists = descend(vectors, lists, neighbours, rounds)
        links, saturated = graph_links(vectors, lists, threshold, neighbours)
        groups = components(links)
        full = groups.join(groups.join(saturated, "node").select("component").distinct(), "component", "left_semi")
        whole = cut(full.select("node", F.col("component").alias("grp")))
        near = cut(lists.where(F.col("cos") >= threshold - MARGIN).select("node").distinct())
        recall = audit(vectors, links, whole, threshold, near=near)
        if recall >= target:
            break
    else:
        raise RuntimeError(f"recall {recall:.3f} after {PLANTINGS} plantings, {target} asked for")
    members = groups.select("node", F.col("component").alias("grp"))
    blocks = in_blocks(whole, "grp", "node", BLOCK).select("grp", "i", "j", "own", "node")
    met = blocks.join(vectors, "node").select("grp", "i", "j", "own", "node", "copies", "v").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    counted = met.mapInArrow(_count(threshold), "node bigint, links bigint")
    # outside of the enlarged components the links of the graph count
    sparse = links.join(whole.select(F.col("node").alias("a")), "a", "left_anti")
    sparse = sparse.union(sparse.select("b", "a")).toDF("node", "other").join(vectors.select(F.col("node").alias("other"), "copies"), "other")
    counted = counted.union(sparse.select("node", F.col("copies").alias("links"))).groupBy("node").agg(F.sum("links").alias("links"))
    least = members.join(nodes.select("node", "id"), "node").groupBy("grp").agg(F.min("id").alias("component_id"))
    known = nodes.join(members, "node", "left").join(least, "grp", "left").join(counted, "node", "left")
    known = cut(known.select("space", "v", F.coalesce("component_id", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    joined = seen.where("valid").join(known, ["space", "v"]).select("id", "n_links", "component_id")
    alone = seen.where("NOT valid").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    return joined.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept)
