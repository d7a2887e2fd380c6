"""Index maintenance: inventory, registry, upserts, generations and their manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import PAYLOAD_SCHEMA_VERSION
from ..sources.folder import Folder

KEY = ["workspace_id", "source_id", "document_id"]


def inventory(observed: DataFrame, registry: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """KEY, content_hash (observed), old_hash, old_revision, old_status, kind: new, changed, unchanged or deleted.

    A tombstone that is seen again is new; a row left in ``writing`` is changed.  Live rows that aren't
    observed are deleted, only those among ``requested`` (KEY) if that is given.
    """
    seen = observed.select(*KEY, "content_hash", F.lit(True).alias("seen"))
    live = registry.select(*KEY, F.col("content_hash").alias("old_hash"), F.col("revision").alias("old_revision"), F.when(F.col("status") == "ready", "active").otherwise(F.col("status")).alias("old_status"))
    both = seen.join(live, KEY, "full_outer")
    kind = (
        F.when(F.col("seen") & (F.col("old_status").isNull() | (F.col("old_status") == "deleted")), "new")
        .when(F.col("seen") & (F.col("content_hash") == F.col("old_hash")) & (F.col("old_status") == "active"), "unchanged")
        .when(F.col("seen"), "changed")
        .when(F.col("old_status") != "deleted", "deleted")
    )
    out = both.withColumn("kind", kind).where("kind IS NOT NULL").drop("seen")
    if requested is not None:
        out = out.join(requested.select(*KEY).distinct().withColumn("asked", F.lit(True)), KEY, "left").where("kind <> 'deleted' OR asked").drop("asked")
    return out


def next_revision() -> Column:
    """The revision that a row of ``inventory`` gets if its document is written: 1 for new ones, the same again for one left in ``writing``."""
    again = F.col("old_status") == "writing"
    return F.when(F.col("kind") == "new", 1).when(F.col("kind") == "changed", F.coalesce("old_revision", F.lit(0)) + F.when(again, 0).otherwise(1))


def merge_registry(registry: DataFrame, diff: DataFrame, observed_at: float) -> DataFrame:
    """The next registry (KEY, content_hash, revision, status, observed_at): one full outer join, written as a new snapshot."""
    change = diff.select(*KEY, F.col("content_hash").alias("new_hash"), "kind", "old_revision", "old_status")
    both = registry.join(change, KEY, "full_outer")
    revision = F.coalesce(next_revision(), "revision", "old_revision")
    return both.select(
        *KEY,
        F.coalesce("new_hash", "content_hash").alias("content_hash"),
        revision.cast("int").alias("revision"),
        F.when(F.col("kind") == "deleted", "deleted").when(F.col("kind").isNotNull(), "active").otherwise(F.col("status")).alias("status"),
        F.when(F.col("kind").isNotNull(), F.lit(float(observed_at))).otherwise(F.col("observed_at")).alias("observed_at"),
    )


def upsert(points: DataFrame, batch: DataFrame, *, order: str = "position", key: str = "point_id") -> DataFrame:
    """``points`` with ``batch`` written over them; of rows with one key the last in ``order`` wins."""
    columns = points.columns
    last = batch.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select("r.*")
    return points.join(last.select(key), key, "left_anti").unionByName(last.select(columns))


def retire(points: DataFrame, keep: DataFrame, documents: DataFrame, *, key: str = "point_id") -> DataFrame:
    """``points`` without those of ``documents`` (KEY) that aren't in ``keep`` (key)."""
    touched = points.join(documents.select(*KEY).distinct(), KEY, "left_semi")
    gone = touched.join(keep.select(key), key, "left_anti").select(key)
    return points.join(gone, key, "left_anti")


def delete_documents(points: DataFrame, documents: DataFrame, on: list[str] | None = None) -> DataFrame:
    """``points`` without documents, files or workspaces, by the columns ``on``."""
    on = on or KEY
    return points.join(documents.select(*on).distinct(), on, "left_anti")


@dataclass(frozen=True)
class Manifest:
    embedding_model: str
    vector_size: int
    collection: str
    payload_schema_version: int = PAYLOAD_SCHEMA_VERSION
    chunker_version: int = 1
    indexing_version: int = 1


def incompatible(stored: Manifest | None, wanted: Manifest) -> list[str]:
    """The fields that forbid an incremental update."""
    if stored is None:
        return ["missing manifest"]
    a, b = asdict(stored), asdict(wanted)
    return [f for f in a if a[f] != b[f] or (f.endswith("_version") and a[f] == 0)]


#: Buckets of documents in a workspace: what a change of one document rewrites.
BUCKETS = 64


class Generations:
    """Index generations under a folder: written aside, checked, then made live by replacing a pointer.

    A generation is a map from (workspace, bucket of its documents) to the folder that holds those points, so one that changes a few
    documents writes the folders of their buckets and refers to all others.  What no generation in use refers to goes by ``vacuum``.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.files, self.buckets = spark, Folder(spark, folder), buckets
        self.folder = self.files.path

    def pointer(self) -> dict:
        return self.files.read("pointer.json") or {"generation": None, "previous": None}

    def place(self, rows: DataFrame) -> Column:
        """workspace in hexadecimal / bucket: where the points of a document lie; a table without documents has one bucket a workspace."""
        workspace = F.hex(F.coalesce(F.col("workspace_id").cast("string"), F.lit("")).cast("binary"))
        document = [c for c in KEY[1:] if c in rows.columns]
        bucket = F.pmod(F.xxhash64(*document), F.lit(self.buckets)) if document else F.lit(0)
        return F.concat(workspace, F.lit("/"), bucket.cast("string"))

    def stage(self, index: DataFrame, manifest: Manifest, *, base: str | None = None, touched: Sequence[str] = ()) -> str:
        """Write a generation that isn't live; an empty one is refused.

        With ``base`` it has the folders of that generation, but for the ``touched`` places, whose rows ``index`` gives anew.
        """
        name, write = f"generation-{uuid.uuid4().hex}", f"data/{uuid.uuid4().hex}"
        where = F.split(F.col("_place"), "/")
        dealt = index.withColumn("_place", self.place(index)).withColumns({"_w": where[0], "_b": where[1]}).drop("_place")
        dealt.hint("rebalance", "_w", "_b").write.partitionBy("_w", "_b").parquet(self.files.at(write))
        folders = {k: v for k, v in (self._state(base)["folders"] if base else {}).items() if k not in set(touched)}
        for w in (n for n in self.files.names(write) if n.startswith("_w=")):
            for b in (n for n in self.files.names(f"{write}/{w}") if n.startswith("_b=")):
                folders[f"{w.removeprefix('_w=').replace('__HIVE_DEFAULT_PARTITION__', '')}/{b.removeprefix('_b=')}"] = f"{write}/{w}/{b}"
        if not folders:
            raise ValueError("a generation without rows is not made live")
        self.files.write(f"{name}.json", {"manifest": asdict(manifest), "schema": json.loads(index.schema.json()), "folders": folders})
        return name

    def _state(self, name: str) -> dict:
        found = self.files.read(f"{name}.json")
        if found is None:
            raise ValueError(f"there is no generation {name}")
        return found

    def folders(self, name: str) -> dict[str, str]:
        return self._state(name)["folders"]

    def generation(self, name: str, places: Iterable[str] | None = None, workspaces: Iterable[str] | None = None) -> DataFrame:
        """A generation with the types that it was written with; of some places or workspaces only, nothing else is listed or read."""
        state = self._state(name)
        schema = StructType.fromJson(state["schema"])
        wanted = set(places) if places is not None else None
        named = {str(w).encode().hex().upper() for w in workspaces} if workspaces is not None else None
        chosen = [self.files.at(d) for k, d in state["folders"].items() if (wanted is None or k in wanted) and (named is None or k.partition("/")[0] in named)]
        return self.spark.read.schema(schema).parquet(*chosen) if chosen else self.spark.createDataFrame([], schema)

    def activate(self, name: str) -> None:
        now = self.pointer()
        self.files.write("pointer.json", {"generation": name, "previous": now["generation"]})

    def rollback(self) -> str:
        now = self.pointer()
        if not now["previous"]:
            raise ValueError("there is no previous generation")
        self.files.write("pointer.json", {"generation": now["previous"], "previous": None})
        return now["previous"]

    def manifest(self) -> Manifest | None:
        name = self.pointer()["generation"]
        return Manifest(**self._state(name)["manifest"]) if name else None

    def live(self, workspaces: Iterable[str] | None = None) -> DataFrame:
        name = self.pointer()["generation"]
        if not name:
            raise ValueError("no generation is live")
        return self.generation(name, workspaces=workspaces)

    def vacuum(self) -> list[str]:
        """Delete generations other than the live and the previous one, and the data that these two don't refer to; returns what went."""
        kept = {g for g in self.pointer().values() if g}
        used = {d.split("/")[1] + "/" + "/".join(d.split("/")[2:]) for g in kept for d in self.folders(g).values()}
        gone = [n for n in self.files.names() if n.startswith("generation-") and n.removesuffix(".json") not in kept]
        for write in self.files.names("data"):
            places = [f"{write}/{w}/{b}" for w in self.files.names(f"data/{write}") if w.startswith("_w=") for b in self.files.names(f"data/{write}/{w}") if b.startswith("_b=")]
            unused = [p for p in places if p not in used]
            gone += [f"data/{write}"] if len(unused) == len(places) else [f"data/{p}" for p in unused]
        for name in gone:
            self.files.delete(name)
        return gone

    def write_status(self, status: dict) -> None:
        self.files.write("status.json", status)

    def status(self) -> dict | None:
        return self.files.read("status.json")
