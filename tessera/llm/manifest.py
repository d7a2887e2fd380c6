"""A Merkle manifest of a table: a hash tree per group of rows, one tree over the groups' roots, and a proof for every row.

Leaves are hashed in the JVM and numbered within their group by key (``common.ranked``: ranges, so that a group may hold
any share of the rows).  ``FANOUT ** HEIGHT`` consecutive leaves are an aligned block, one row of a table: its digests are a contiguous
matrix of 64-byte rows, which is reshaped by the fanout and hashed row by row, level by level.  The blocks' roots are
the nodes of the next level, packed in the same way until each group has one root; the groups' roots, numbered in order of group,
go the same way to the root.  On the way down every node's siblings are found by index arithmetic in its block, and a
block's own siblings come by one join on (group, block) from the table above, which has a row for each block.

Cases: a null field is ``-``, so it differs from an empty one; a null group comes first, and null keys come first in their group;
rows of one key are ordered by leaf, so equal rows have neighbouring leaves and proofs of their own; texts of any length are hashed
whole; an empty table has no rows and no root; extra columns are ignored, and names can't clash, as rows are renamed at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked, views

FANOUT = 3
#: Levels of a block: 2,187 leaves, 140 KB of digests.
HEIGHT = 7


def leaf(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its length in bytes, a colon and its value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)).cast("binary"), 256)


def _sha(data: bytes | memoryview) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def levels(digests: np.ndarray, fanout: int, height: int, alone: bool) -> list[np.ndarray]:
    """The matrices (nodes x 64 bytes) of a block, from its leaves upwards: ``height`` steps, or until one node is left if the block is alone."""
    found = [np.ascontiguousarray(digests)]
    for _ in range(height):
        now = found[-1]
        if alone and len(now) == 1:
            break
        whole = len(now) // fanout
        runs = now[: whole * fanout].reshape(whole, fanout * 64)
        out = [_sha(run) for run in runs]
        if whole * fanout < len(now):
            out.append(_sha(now[whole * fanout :].reshape(-1)))
        found.append(np.frombuffer(b"".join(out), np.uint8).reshape(-1, 64))
    return found


def siblings(found: list[np.ndarray], fanout: int) -> list[list[list[bytes]]]:
    """For each leaf of a block, level by level, the digests of its run's others from left to right."""
    leaves = np.arange(len(found[0]))
    columns = []
    for k, matrix in enumerate(found[:-1]):
        node = leaves // fanout**k
        first, own = node // fanout * fanout, node % fanout
        others = np.arange(fanout - 1) + (np.arange(fanout - 1) >= own[:, None]) + first[:, None]  # every index of the run but the own
        named = np.concatenate([matrix.view("S64").reshape(-1), np.zeros(1, "S64")])  # the last one is empty
        columns.append(named[np.minimum(others, len(matrix))])
    return [[[x for x in c[i].tolist() if x] for c in columns] for i in leaves.tolist()]


def fold(digest: bytes, steps: Sequence[tuple[int, Sequence[bytes]]]) -> bytes:
    """The root that a digest gives with its siblings: at each step (own index in the run, the run's others)."""
    for own, others in steps:
        digest = _sha(b"".join([*others[:own], digest, *others[own:]]))
    return digest


def _parsed(steps: str, others: str) -> list[tuple[int, list[bytes]]]:
    """A path as steps: of each level a digit for the own index and one for the number of others."""
    out, at, raw = [], 0, others.encode()
    for own, n in zip(map(int, steps[::2]), map(int, steps[1::2]), strict=True):
        out.append((own, [raw[at + 64 * i : at + 64 * i + 64] for i in range(n)]))
        at += 64 * n
    return out


def _pack(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """grp, block, nodes (in order), root: one row per aligned block of ``nodes`` (grp, pos, digest and what else they carry)."""

    @F.arrow_udf("string")
    def root(digests: pa.Array, block: pa.Array) -> pa.Array:
        return pa.array([levels(m, fanout, height, b == 0 and len(m) < fanout**height)[-1].tobytes().decode() for m, b in zip(_matrices(digests), block.to_pylist(), strict=True)], pa.string())

    block = F.floor(F.col("pos") / fanout**height).alias("block")
    rest = [c for c in nodes.columns if c not in ("grp", "pos")]
    rows = nodes.groupBy("grp", block).agg(F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("nodes"))
    return cut(rows.withColumn("root", root(F.col("nodes.digest"), "block")))


def _matrices(digests: pa.Array) -> list[np.ndarray]:
    """Of a column of lists of digests, each list as a matrix of 64-byte rows over the column's own buffer."""
    data, at = views(digests.flatten())
    ends = np.concatenate([[0], np.cumsum(np.asarray(digests.value_lengths()))])
    flat = data[at[0] : at[-1]].reshape(-1, 64)
    return [flat[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]


def _climb(nodes: DataFrame, fanout: int, height: int) -> list[DataFrame]:
    """Tables of blocks from the leaves' to that in which each group has a single block."""
    found = [_pack(nodes, fanout, height)]
    while not found[-1].where("block > 0").isEmpty():
        found.append(_pack(found[-1].select("grp", F.col("block").alias("pos"), F.col("root").alias("digest")), fanout, height))
    return found


def _descend(tables: list[DataFrame], paths: DataFrame, fanout: int, height: int) -> DataFrame:
    """Paths (grp, block, steps, others) of the lowest table's blocks, out of those of the highest one's."""

    @F.arrow_udf("array<struct<steps: string, others: string>>")
    def down(digests: pa.Array, block: pa.Array, steps: pa.Array, others: pa.Array) -> pa.Array:
        out = []
        for m, b, s, o in zip(_matrices(digests), block.to_pylist(), steps.to_pylist(), others.to_pylist(), strict=True):
            own = siblings(levels(m, fanout, height, b == 0 and len(m) < fanout**height), fanout)
            out.append([{"steps": "".join(f"{i // fanout**k % fanout}{len(run)}" for k, run in enumerate(runs)) + s, "others": b"".join(x for run in runs for x in run).decode() + o} for i, runs in enumerate(own)])
        return pa.array(out, pa.list_(pa.struct([("steps", pa.string()), ("others", pa.string())])))

    for table in reversed(tables[1:]):
        joined = table.join(paths, ["grp", "block"]).withColumn("path", F.explode(F.arrays_zip("nodes", down(F.col("nodes.digest"), "block", "steps", "others").alias("found"))))
        paths = joined.select("grp", F.col("path.nodes.pos").alias("block"), "path.found.steps", "path.found.others", "subroot")
    return paths


def manifest(rows: DataFrame, *, key: str, group: str, fields: Sequence[str], tampered: dict[str, Column] | None = None, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """key, group, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    ``tampered`` gives what stands for some fields when a row's leaf is checked: folded_root is the root out of that leaf and
    the siblings of the manifest.
    """
    if not 2 <= fanout <= 9:
        raise ValueError("a path names an index by one digit")
    own = leaf([F.col(f) for f in fields])
    checked = leaf([(tampered or {}).get(f, F.col(f)) for f in fields])
    name = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = rows.select(F.col(key).alias("id"), name.alias("grp"), own.alias("digest"), checked.alias("checked"))
    leaves = cut(leaves.withColumn("checked", F.when(F.col("checked") != F.col("digest"), F.col("checked"))))  # texts are read and hashed once
    placed = ranked(leaves, ["grp"], ["id", "digest"], "pos").withColumn("pos", F.col("pos") - 1)
    below = _climb(placed, fanout, height)
    tops = below[-1].select("grp", F.col("root").alias("subroot"))
    numbered = cut(ranked(tops, [], ["grp"], "pos").withColumn("pos", F.col("pos") - 1))
    above = _climb(numbered.select(F.lit("").alias("grp"), "pos", F.col("subroot").alias("digest")), fanout, height)
    last = above[-1].select("root").first()
    nothing = [F.lit("").alias(c) for c in ("steps", "others", "subroot")]
    paths = _descend([numbered, *above], above[-1].select("grp", "block", *nothing), fanout, height).select(F.col("block").alias("pos"), "steps", "others")
    paths = numbered.join(paths, "pos").select("grp", F.lit(0).cast("bigint").alias("block"), "steps", "others", "subroot")
    paths = _descend(below, paths, fanout, height)

    @F.arrow_udf("array<struct<proof: string, folded: string>>")
    def proofs(digests: pa.Array, checked: pa.Array, block: pa.Array, steps: pa.Array, others: pa.Array) -> pa.Array:
        out = []
        for m, c, b, s, o in zip(_matrices(digests), checked.to_pylist(), block.to_pylist(), steps.to_pylist(), others.to_pylist(), strict=True):
            inside = siblings(levels(m, fanout, height, b == 0 and len(m) < fanout**height), fanout)
            beyond, rest, found = _parsed(s, o), o.encode(), []
            for i, runs in enumerate(inside):
                digest = c[i].encode() if c[i] is not None else m[i].tobytes()
                digest = fold(digest, [(i // fanout**k % fanout, run) for k, run in enumerate(runs)])
                found.append({"proof": _sha(b"".join(x for run in runs for x in run) + rest).decode(), "folded": fold(digest, beyond).decode()})
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("proof", pa.string()), ("folded", pa.string())])))

    blocks = below[0].join(paths, ["grp", "block"]).withColumn("root", F.lit(last and last["root"]).cast("string"))
    each = F.arrays_zip("nodes", proofs(F.col("nodes.digest"), F.col("nodes.checked"), "block", "steps", "others").alias("found"))
    found = blocks.select("grp", "subroot", "root", F.explode(each).alias("r"))
    return found.select(
        F.col("r.nodes.id").alias(key),
        F.when(F.col("grp") != "", F.substring("grp", 2, 2147483647)).alias(group),
        F.col("r.nodes.digest").alias("leaf"),
        "subroot",
        "root",
        F.col("r.found.proof").alias("proof_sha256"),
        F.col("r.found.folded").alias("folded_root"),
        (F.col("r.found.folded") == F.col("root")).alias("verified"),
    )
