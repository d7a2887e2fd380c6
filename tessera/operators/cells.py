"""A vector index that is kept: inverted cells, probed by query, with exact scores of what is probed (see ``segments``).

Unit vectors are dealt to cells by their nearest centroid; centroids are fitted by Lloyd steps, each a pass of Arrow batches with partial
sums by cell.  The fit reads all vectors, or where there are more than FIT of them a sample of about that many, chosen by a hash; every vector is indexed.
A segment holds its vectors in folders by cell, so a query reads the folders of the cells whose centroids are nearest to it; with
``exact`` it reads all cells and finds what a scan finds.  ``tune`` measures the recall of sampled vectors as queries against all rows and
doubles the number of probes until it is reached.

Vectors that are null, zero, of another length, or hold nulls or numbers that aren't finite have no cosine and are no hits; they are not indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import matrix, unit
from .search import BLOCK, SLICE, best, nearest_in_blocks, top_k
from .segments import Segmented

#: Most cells of an index; vectors that a fit reads at most (about); Lloyd steps.
CELLS, FIT, STEPS = 4096, 2_000_000, 8
#: Queries of a recall measurement, and neighbours of each.
ASKED, NEIGHBOURS = 200, 10
VECTORS = "point_id {}, workspace_id string, vector array<double>, cell int, size int"


def _nearest(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each vector, nearest first, ties by number."""
    n = min(n, len(centroids))
    out = np.zeros((len(vectors), n), np.int64)
    for at in range(0, len(vectors), SLICE):
        near = np.round(vectors[at : at + SLICE] @ centroids.T, 12)
        if n == 1:
            out[at : at + SLICE, 0] = near.argmax(axis=1)
            continue
        some = np.nonzero(best(near, n))[1].reshape(-1, n)
        order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
        out[at : at + SLICE] = np.take_along_axis(some, order, axis=1)
    return out


class VectorIndex(Segmented):
    measure = "size"

    # fitting

    def fit(self, points: DataFrame, cells: int | None = None) -> int:
        """Fit centroids to ``points`` (embedding) and keep them; returns their number.  The index must be empty."""
        if self.state()["segments"]:
            raise ValueError("cells are fitted before the first points are written")
        rows = points.select(unit(F.col("embedding")).alias("vector")).where("vector IS NOT NULL")
        width = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
        if width is None:
            raise ValueError("there is no vector to fit cells to")
        n, size = width["count"], width["n"]
        rows = rows.where(F.size("vector") == size).withColumn("order", F.xxhash64("vector"))
        if n > FIT:
            rows = rows.where(F.pmod(F.col("order"), F.lit(1_000_000)) < int(1_000_000 * FIT / n))
        aside = "fit"
        self.folder.delete(aside)
        try:
            rows = self.folder.table(rows, aside)
            k = cells or max(1, min(CELLS, round(math.sqrt(n))))
            first = rows.groupBy("order").agg(F.first("vector").alias("vector")).orderBy("order").limit(k).collect()  # k distinct vectors
            centroids = np.array([r.vector for r in first])
            for _ in range(STEPS):
                centroids, moved = self._step(rows, centroids)
                if moved < 1e-4:
                    break
        finally:
            self.folder.delete(aside)
        table = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, vector array<double>")
        self.folder.delete("centroids")
        table.coalesce(1).write.parquet(self.folder.at("centroids"))
        self.folder.write("fit.json", {"cells": len(centroids), "size": size, "probes": max(1, len(centroids) // 16)})
        return len(centroids)

    @staticmethod
    def _step(rows: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, float]:
        """One Lloyd step: sums of the vectors of each cell, by partial sums of batches and tasks."""

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros_like(centroids)
            for b in batches:
                vectors = matrix(b.column(0))
                if len(vectors):
                    np.add.at(sums, _nearest(vectors, centroids, 1)[:, 0], vectors)
            there = np.flatnonzero(sums.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(list(sums[there]), pa.list_(pa.float64()))], names=["cell", "sum"])

        def total(table: pa.Table) -> pa.Table:
            return pa.table({"cell": table["cell"].slice(0, 1), "sum": pa.array([matrix(table["sum"].combine_chunks()).sum(axis=0)], pa.list_(pa.float64()))})

        kind = "cell int, sum array<double>"
        found = rows.select("vector").mapInArrow(partial, kind).groupBy("cell").applyInArrow(total, kind).collect()  # a row per cell
        new = centroids.copy()
        for r in found:
            length = np.linalg.norm(r["sum"])
            if length > 0:
                new[r["cell"]] = np.array(r["sum"]) / length
        return new, float(np.abs(new - centroids).max())

    def _fitted(self) -> dict:
        found = self.folder.read("fit.json")
        if found is None:
            raise ValueError("the index has no cells: fit comes first")
        return found

    def centroids(self) -> np.ndarray:
        return np.array([r.vector for r in self.spark.read.parquet(self.folder.at("centroids")).orderBy("cell").collect()])

    # writing

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, *, generation: str | None = None) -> dict:
        """Write points (point_id, workspace_id, embedding) and delete others (point_id); returns the new state.

        Of several rows of one point that with the greatest vector is taken.  A point written without a direction is deleted.
        """
        size, centroids = self._fitted()["size"], self.centroids()
        if upserts is None:
            kind = deletes.schema["point_id"].dataType.simpleString()
            upserts = self.spark.createDataFrame([], f"point_id {kind}, workspace_id string, embedding array<double>")
        one = upserts.withColumn("vector", unit(F.col("embedding"))).groupBy("point_id").agg(F.max(F.struct("vector", "workspace_id")).alias("r")).select("point_id", "r.*")
        fine = F.col("vector").isNotNull() & (F.size("vector") == size)
        without = one.where(F.coalesce(~fine, F.lit(True))).select("point_id")
        deletes = without if deletes is None else deletes.select("point_id").union(without)

        @F.arrow_udf("int")
        def cell(vectors: pa.Array) -> pa.Array:
            return pa.array(_nearest(matrix(vectors), centroids, 1)[:, 0] if len(vectors) else [], pa.int32())

        rows = one.where(fine).withColumn("cell", cell("vector")).withColumn("size", F.lit(1))
        return self.change(rows.select("point_id", "workspace_id", "vector", "cell", "size"), deletes, generation)

    def write_segment(self, staged: DataFrame, name: str, points: int) -> dict:
        """Vectors by cell; Spark splits a cell with very many vectors and packs small ones."""
        dealt = staged.select("point_id", "workspace_id", "vector", "size", F.col("cell").alias("c"), "cell").hint("rebalance", "c")
        dealt.write.partitionBy("c").parquet(self.folder.at(f"{name}/cells"))
        return {"bytes": self.sizes(f"{name}/cells", "c")}

    def held(self, state: dict) -> DataFrame:
        return self._cells(state, None)

    def _cells(self, state: dict, cells: list[int] | None) -> DataFrame:
        """Vectors of some cells or all, with the seq of their segment."""
        schema, parts = VECTORS.format(state["key"]), []
        for s in state["segments"]:
            if places := [self.folder.at(f"{s['name']}/cells/c={c}") for c in s["bytes"] if cells is None or int(c) in set(cells)]:
                parts.append(self.spark.read.schema(schema).parquet(*places).withColumn("seq", F.lit(s["seq"])))
        return self.union(parts, f"{schema}, seq int")

    # reading

    def _probed(self, query: list[float], probes: int | None) -> list[int]:
        fitted = self._fitted()
        vector = np.array(query, float)
        if len(vector) != fitted["size"] or not np.isfinite(vector).all() or not vector.any():
            return []
        return _nearest(vector[None] / np.linalg.norm(vector), self.centroids(), probes or fitted["probes"])[0].tolist()

    def cost(self, query: list[float], *, probes: int | None = None) -> tuple[int, int]:
        """(bytes of the cells that a query reads, bytes of all)."""
        state, cells = self.state(), set(map(str, self._probed(query, probes)))
        each = [(c, n) for s in state["segments"] for c, n in s["bytes"].items()]
        return sum(n for c, n in each if c in cells), sum(n for _, n in each)

    def search(self, query: list[float], k: int, *, workspace_id: str | None = None, threshold: float | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(point_id, raw) of the nearest points, best first, ties by key: in the probed cells, or with ``exact`` in all."""
        state = self.state()
        rows = self.live(self._cells(state, None if exact else self._probed(query, probes)), state)
        if workspace_id is not None:
            rows = rows.where(F.col("workspace_id") == workspace_id)
        return top_k(rows.withColumnRenamed("vector", "embedding"), query, k, threshold=threshold).select("point_id", "raw")

    def search_all(self, queries: DataFrame, k: int, *, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(query_id, rank, point_id, raw) for many queries (query_id, query_vector), each in its own probed cells.

        Queries meet runs of cells of about ``BLOCK`` vectors, with ``exact`` all vectors, both sides dealt in blocks: a cell that
        holds very much is compared by many tasks, small ones together, and each block gives at most k rows for a query.
        """
        state, fitted, centroids = self.state(), self._fitted(), self.centroids()
        many = probes or fitted["probes"]
        run = max(1, BLOCK * len(centroids) // max(1, state["points"]))

        @F.arrow_udf("array<int>")
        def nearest(vectors: pa.Array) -> pa.Array:
            return pa.array(list(_nearest(matrix(vectors), centroids, many).astype(np.int32)) if len(vectors) else [], pa.list_(pa.int32()))

        asked = queries.select("query_id", unit(F.col("query_vector")).alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") == fitted["size"]))
        rows = self.live(self._cells(state, None), state).select("cell", F.col("point_id").alias("key"), "vector")
        if exact:
            asked, rows = (x.withColumn("run", F.lit(0)) for x in (asked, rows.drop("cell")))
        else:
            of = lambda c: F.floor(c / F.lit(run)).cast("int")
            asked = asked.withColumn("cells", nearest("vector")).withColumn("run", F.explode(F.array_distinct(F.transform("cells", of))))
            asked = asked.withColumn("cells", F.filter("cells", lambda c: of(c) == F.col("run")))
            rows = rows.withColumn("run", of(F.col("cell")))
        met = nearest_in_blocks(asked, rows, k, ["run"], BLOCK)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("raw").desc(), "key"))
        return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias("point_id"), "raw")

    def recall(self, probes: int | None = None, *, k: int = NEIGHBOURS, asked: int = ASKED) -> float:
        """The share of the k nearest points that are found, for about ``asked`` indexed vectors, chosen by a hash of their key, against all rows."""
        return self._recall(probes, k, self._truth(k, asked)) if self.state()["points"] else 1.0

    def _truth(self, k: int, asked: int) -> tuple[DataFrame, DataFrame]:
        """(queries, the worst of the k nearest points of each and their number), written, as each measurement reads them."""
        state, number = self.state(), self.versions.latest()[0]
        share = min(1.0, 1.2 * asked / state["points"])
        rows = self.live(self._cells(state, None), state).select(F.col("point_id").alias("query_id"), F.col("vector").alias("query_vector"))
        chosen = self.folder.table(rows.where(F.pmod(F.xxhash64("query_id"), F.lit(1_000_000)) < int(1_000_000 * share)), f"asked-{number}", mode="overwrite")
        want = self.search_all(chosen, k, exact=True)
        return chosen, self.folder.table(want.groupBy("query_id").agg(F.min("raw").alias("least"), F.count("*").alias("n")), f"worst-{number}", mode="overwrite")

    def _recall(self, probes: int | None, k: int, truth: tuple[DataFrame, DataFrame]) -> float:
        chosen, worst = truth
        # a point that ties with the last one counts as found
        found = self.search_all(chosen, k, probes=probes).join(worst, "query_id").where("raw >= least").count()
        return found / max(1, worst.agg(F.sum("n")).first()[0] or 1)

    def tune(self, target: float = 0.95, *, k: int = NEIGHBOURS, asked: int = ASKED) -> tuple[int, float]:
        """(probes, recall): the least of 1, 2, 4, ... probes that reach the target; searches use it from now on."""
        fitted, probes = self._fitted(), 1
        truth = self._truth(k, asked) if self.state()["points"] else None
        while True:
            probes = min(probes, fitted["cells"])
            got = self._recall(probes, k, truth) if truth else 1.0
            if got >= target or probes == fitted["cells"]:
                self.folder.write("fit.json", dict(fitted, probes=probes, recall=got))
                return probes, got
            probes *= 2
