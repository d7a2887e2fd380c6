"""What kept indexes share: segments, tombstones, versions, exact totals of live points, merges.

A change adds a segment with the points that it writes, and a tombstone table for the points that it writes or deletes; a tombstone
hides a point in all segments before it.  A version, one JSON file made by create-if-absent, names segments and tombstones, the totals of live
points, and the generation of the index that it belongs to; readers of an older version aren't disturbed.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folder import Conflict, Folder, Versions

#: Segments that are kept apart; attempts to commit.
SEGMENTS, ATTEMPTS = 8, 5


class Segmented:
    """A kept index; subclasses say what a segment of points holds beside their keys and ``measure``."""

    #: A column of numbers whose total over live points is known.
    measure: str

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)
        self.versions = Versions(self.folder)

    def state(self) -> dict:
        return self.versions.latest()[1] or {"segments": [], "tombs": [], "seq": 0, "points": 0, "total": 0, "generation": None, "key": "string"}

    @property
    def generation(self) -> str | None:
        """The generation of the index whose points these are."""
        return self.state()["generation"]

    def write_segment(self, staged: DataFrame, name: str, points: int) -> dict:
        """Write what a segment holds of the rows that ``staged`` has; returns what the version keeps of it, ``bytes`` by folder among it."""
        raise NotImplementedError

    def held(self, state: dict) -> DataFrame:
        """The rows of a state's segments as they were staged, with ``seq``."""
        raise NotImplementedError

    def _segment(self, staged: DataFrame, seq: int) -> dict:
        name = f"segment-{seq:08d}-{uuid.uuid4().hex}"
        kept = self.folder.table(staged.select("point_id", self.measure), f"{name}/points")
        points, total = kept.agg(F.count("*"), F.coalesce(F.sum(self.measure), F.lit(0))).first()
        return {"name": name, "seq": seq, "points": points, "total": total, **self.write_segment(staged, name, points)}

    def union(self, parts: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def keep(self, staged: DataFrame, place: str) -> None:
        """Make ``staged`` the table ``place``, as the last thing that is done with it: what a change has staged is moved, not written again."""
        if aside := getattr(staged, "tessera_aside", None):
            self.folder.move(aside, place)
        else:
            staged.write.parquet(self.folder.at(place))

    def sizes(self, place: str, column: str) -> dict[str, int]:
        """Bytes of each folder column=value."""
        found = [n for n in self.folder.names(place) if n.startswith(f"{column}=")]
        return {n.removeprefix(f"{column}="): self.folder.size(f"{place}/{n}") for n in found}

    def _keys(self, state: dict) -> DataFrame:
        parts = [self.spark.read.parquet(self.folder.at(f"{s['name']}/points")).withColumn("seq", F.lit(s["seq"])) for s in state["segments"]]
        return self.union(parts, f"point_id {state['key']}, {self.measure} int, seq int")

    def live(self, rows: DataFrame, state: dict) -> DataFrame:
        """``rows`` (point_id, seq, ...) without those that a later tombstone hides."""
        first = min((s["seq"] for s in state["segments"]), default=0)
        hides = [t for t in state["tombs"] if t["seq"] > first]
        if not hides:
            return rows
        parts = [self.spark.read.parquet(self.folder.at(t["name"])).withColumn("over", F.lit(t["seq"])) for t in hides]
        last = reduce(DataFrame.unionByName, parts).groupBy(F.col("point_id").alias("gone")).agg(F.max("over").alias("over"))
        return rows.join(last, (F.col("point_id") == F.col("gone")) & (F.col("seq") < F.col("over")), "left_anti")

    def change(self, rows: DataFrame, deletes: DataFrame | None, generation: str | None) -> dict:
        """Write ``rows``, one for each point, and delete others (point_id); returns the new state.

        A point of both is written.  Rows are computed once; what has to be known of the points that they replace is asked
        again if another writer commits first.
        """
        aside = f"staged-{uuid.uuid4().hex}"
        try:
            staged = self.folder.table(rows, aside)
            staged.tessera_aside = aside
            gone = staged.select("point_id")
            gone = gone if deletes is None else gone.union(deletes.select("point_id"))
            mark = f"tombs-{uuid.uuid4().hex}"
            tombs = self.folder.table(gone.distinct(), mark)
            made = None
            for _ in range(ATTEMPTS):
                number, _found = self.versions.latest()
                state = self.state()
                seq = state["seq"] + 1
                if made is None and not staged.isEmpty():
                    made = self._segment(staged, seq)
                before = self.live(self._keys(state).join(tombs, "point_id", "left_semi"), state)
                less, total = before.agg(F.count("*"), F.coalesce(F.sum(self.measure), F.lit(0))).first()
                new = dict(state, seq=seq, key=rows.schema["point_id"].dataType.simpleString(), generation=generation or state["generation"])
                new["segments"] = state["segments"] + ([dict(made, seq=seq)] if made else [])
                new["tombs"] = state["tombs"] + ([{"name": mark, "seq": seq}] if less else [])
                new["points"] = state["points"] - less + (made["points"] if made else 0)
                new["total"] = state["total"] - total + (made["total"] if made else 0)
                try:
                    self.versions.commit(number, new)
                    break
                except Conflict:
                    continue
            else:
                raise Conflict("other writers were faster every time")
        finally:
            self.folder.delete(aside)
        return self.merge() if len(new["segments"]) > SEGMENTS else new

    def merge(self, whole: bool = False) -> dict:
        """Make one segment of the newest ones, up to one that is larger than all after it, or of all; hidden points go for good."""
        number, state = self.versions.latest()
        segments = state["segments"] if state else []
        first, total = len(segments) - 1, segments[-1]["points"] if segments else 0
        while first > 0 and (whole or first == len(segments) - 1 or segments[first - 1]["points"] <= total):
            first -= 1
            total += segments[first]["points"]
        chosen = segments[max(first, 0) :]
        if len(chosen) < 2 and not (whole and chosen and state["tombs"]):
            return self.state()
        part = dict(state, segments=chosen)
        made = self._segment(self.live(self.held(part), part).drop("seq"), chosen[-1]["seq"])
        new = dict(state, segments=segments[:first] + ([made] if made["points"] else []))
        oldest = min((s["seq"] for s in new["segments"]), default=state["seq"])
        new["tombs"] = [t for t in state["tombs"] if t["seq"] > oldest]
        self.versions.commit(number, new)
        return new

    def vacuum(self) -> None:
        """Delete what neither of the two newest versions names."""
        self.versions.forget()
        kept = {x["name"] for n in self.folder.names() if n.startswith("version-") for k in ("segments", "tombs") for x in self.folder.read(n)[k]}
        for name in self.folder.names():
            if name.startswith(("segment-", "tombs-", "staged-")) and name not in kept:
                self.folder.delete(name)
