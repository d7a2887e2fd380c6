"""A keyword index that is kept: segments of postings, with exact statistics under changes and deletes (see ``segments``).

In a segment postings lie in folders by the bucket of their stem, sorted by stem; a query addresses the folders of its
stems and no others, and Parquet's statistics skip what lies beside them there.  The number of buckets follows the segment's size.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.stem import known_stem, porter
from ..functions.text import parts, word_spots
from . import lexical
from .segments import Segmented

#: Points from which a segment has 1, 16 and 256 buckets.
BUCKETS = ((0, 1), (500, 16), (20_000, 256))
ENTRY = S.ArrayType(S.StructType([S.StructField("term", S.StringType()), S.StructField("stem", S.StringType()), S.StructField("at", S.ArrayType(S.IntegerType()))]))
POSTINGS = "point_id {}, workspace_id string, source_id string, doc_len int, term string, stem string, at array<int>"
#: The base of the hash of words, and its inverse.
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


@F.arrow_udf(ENTRY)
def entries(texts: pa.Array) -> pa.Array:
    """The distinct terms of each text with their stems and positions, in one pass by Arrow batches."""

    kind = pa.list_(pa.struct([("term", pa.string()), ("stem", pa.string()), ("at", pa.list_(pa.int32()))]))
    return pa.concat_arrays([pa.array([], kind), *(_entries(texts.slice(a, z - a).to_pylist(), kind) for a, z in parts(texts))])


def _entries(texts: list[str | None], kind: pa.DataType) -> pa.Array:
    """``entries`` of some texts, by sorting the numbers of their words; each distinct word is a Python object once."""
    points, first, end, own = word_spots(texts)
    words, which = _distinct(points, first, end)
    doc = np.repeat(np.arange(len(texts)), np.diff(own))
    _, begin, group, times = np.unique(doc * max(1, len(words)) + which, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(begin)  # by text, and in a text by the first place
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    spots = np.argsort(place[group], kind="stable")
    at = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(times[order])]), pa.int32()), pa.array((spots - own[doc[spots]]).astype(np.int32)))
    named = pa.array(which[begin[order]], pa.int64())
    columns = [pa.array(words, pa.string()).take(named), pa.array([known_stem(w) for w in words], pa.string()).take(named), at]
    rows = pa.StructArray.from_arrays(columns, fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(begin[order], own), pa.int32()), rows).cast(kind)


def _distinct(points: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct words, and which of them each word is. Words of one hash are compared; if any differ, Python tells them apart."""
    size = end - first
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_mixed(points.astype(np.uint64)) * _powers(len(points), _STEP), out=sums[1:])
    code = _mixed((sums[end] - sums[first]) * _powers(len(points) + 1, _BACK)[first]) ^ size.astype(np.uint64)
    _, chosen, which = np.unique(code, return_index=True, return_inverse=True)
    every = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    like = chosen[which]
    if (size == size[like]).all() and (points[every + np.repeat(first, size)] == points[every + np.repeat(first[like], size)]).all():
        return [points[a:z].tobytes().decode("utf-32-le") for a, z in zip(first[chosen].tolist(), end[chosen].tolist(), strict=True)], which
    known: dict[str, int] = {}
    which = [known.setdefault(points[a:z].tobytes().decode("utf-32-le"), len(known)) for a, z in zip(first.tolist(), end.tolist(), strict=True)]
    return list(known), np.array(which, np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(n: int, base: int) -> np.ndarray:
    """The first n powers modulo 2**64."""
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


class KeywordIndex(Segmented):
    measure = "doc_len"

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, *, generation: str | None = None) -> dict:
        """Write points (point_id, workspace_id, source_id, content) and delete others (point_id); returns the new state.

        Of several rows of one point that with the greatest content is taken.
        """
        if upserts is None:
            kind = deletes.schema["point_id"].dataType.simpleString()
            upserts = self.spark.createDataFrame([], f"point_id {kind}, workspace_id string, source_id string, content string")
        one = upserts.groupBy("point_id").agg(F.max(F.struct("content", "workspace_id", "source_id")).alias("r"))
        found = one.select("point_id", "r.workspace_id", "r.source_id", entries("r.content").alias("entries"))
        return self.change(found.withColumn("doc_len", F.aggregate("entries", F.lit(0), lambda n, e: n + F.size(e["at"]))), deletes, generation)

    def write_segment(self, staged: DataFrame, name: str, points: int) -> dict:
        """Postings by bucket; Spark splits a bucket with very many rows and packs small ones."""
        buckets = next(b for least, b in reversed(BUCKETS) if points >= least)
        rows = staged.select("point_id", "workspace_id", "source_id", "doc_len", F.inline("entries"))
        bucket = F.pmod(F.crc32(F.col("stem").cast("binary")), F.lit(buckets)).cast("int")
        dealt = rows.withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "stem", "point_id")
        dealt.write.partitionBy("bucket").parquet(self.folder.at(f"{name}/postings"))
        self.keep(staged, f"{name}/rows")
        return {"modulus": buckets, "bytes": self.sizes(f"{name}/postings", "bucket")}

    def held(self, state: dict) -> DataFrame:
        parts = [self.spark.read.parquet(self.folder.at(f"{s['name']}/rows")).withColumn("seq", F.lit(s["seq"])) for s in state["segments"]]
        return self.union(parts, "")

    def _folders(self, segment: dict, stems: list[str]) -> list[str]:
        wanted = {str(zlib.crc32(s.encode()) % segment["modulus"]) for s in stems}
        return [b for b in segment["bytes"] if b in wanted]

    def _read(self, state: dict, stems: list[str]) -> DataFrame:
        """Postings of some stems, with the seq of their segment."""
        schema, parts = POSTINGS.format(state["key"]), []
        for s in state["segments"]:
            if places := [self.folder.at(f"{s['name']}/postings/bucket={b}") for b in self._folders(s, stems)]:
                parts.append(self.spark.read.schema(schema).parquet(*places).where(F.col("stem").isin(stems)).withColumn("seq", F.lit(s["seq"])))
        return self.union(parts, f"{schema}, seq int")

    def cost(self, query: str, *, stemmed: bool = True) -> tuple[int, int]:
        """(bytes of the folders that a query reads, bytes of all postings)."""
        state, stems = self.state(), self._stems(lexical.parse_query(query, stemmed=stemmed), stemmed)
        return sum(s["bytes"][b] for s in state["segments"] for b in self._folders(s, stems)), sum(n for s in state["segments"] for n in s["bytes"].values())

    @staticmethod
    def _stems(phrases: list[list[str]], stemmed: bool) -> list[str]:
        return sorted({t if stemmed else porter(t) for p in phrases for t in p})

    def search(self, query: str, limit: int, *, workspace_id: str, source_id: str | None = None, stemmed: bool = True) -> DataFrame:
        """(point_id, bm25, score): what ``lexical.keyword_search`` finds in the live points, from the postings of the query's terms alone."""
        phrases, state = lexical.parse_query(query, stemmed=stemmed), self.state()
        if not phrases or not state["total"]:
            return self.spark.createDataFrame([], f"point_id {state['key']}, bm25 double, score double")
        held = self.live(self._read(state, self._stems(phrases, stemmed)), state)
        if not stemmed:
            held = held.where(F.col("term").isin(sorted({t for p in phrases for t in p})))
        found = held.select("point_id", "workspace_id", "source_id", "doc_len", F.col("stem" if stemmed else "term").alias("term"), F.explode("at").alias("pos"))
        totals = self.spark.range(1).select(F.lit(state["points"]).alias("n_docs"), F.lit(state["total"] / state["points"]).alias("avg_len"))
        return lexical._ranked(lexical._by_doc(found, phrases), totals, phrases, limit, workspace_id, source_id)
