"""Index runs: a full one, an incremental one that replaces documents, and the scope of the jobs that start them.

A run writes a generation aside, reads it back, and moves the pointer only if what it was given is there.  So a run that
fails at any point leaves the live index and the registry as they were, for all of its documents at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.embedding import CLAMP, DOCUMENTS, embed, embed_new
from . import maintain
from .keywords import KeywordIndex
from .maintain import KEY, Generations, Manifest

Embedder = Callable[[list[str]], list[list[float]]]


def revised(rebuilt: DataFrame, diff: DataFrame) -> DataFrame:
    """The rows of ``rebuilt`` (KEY, ...) that belong to new and changed documents, with the revision that these get."""
    targets = diff.where("kind IN ('new', 'changed')").select(*KEY, maintain.next_revision().cast("int").alias("revision"))
    return rebuilt.drop("revision").join(targets, KEY)


def replace_documents(points: DataFrame, fresh: DataFrame, *, key: str = "point_id", order: str = "chunk_index") -> DataFrame:
    """``points`` with all points of the documents in ``fresh`` replaced by those; of rows with one key the last in ``order`` wins.

    A document without rows in ``fresh`` keeps its points.
    """
    return maintain.upsert(maintain.delete_documents(points, fresh), fresh, order=order, key=key)


def unverified(points: DataFrame, fresh: DataFrame) -> DataFrame:
    """(KEY, revision, n_chunks, n_points) of the documents of ``fresh`` with fewer points at their revision than chunks."""
    by = [*KEY, "revision"]
    wanted = fresh.groupBy(by).agg(F.count("*").alias("n_chunks"))
    there = points.groupBy(by).agg(F.count("*").alias("n_points"))
    return wanted.join(there, by, "left").fillna(0, ["n_points"]).where("n_points < n_chunks")


def update(
    store: Generations, registry: DataFrame, observed: DataFrame, rebuilt: DataFrame, manifest: Manifest, now: float, requested: DataFrame | None = None,
    *, embedder: Embedder | None = None, keywords: KeywordIndex | None = None, key: str = "point_id", order: str = "chunk_index",
) -> DataFrame:
    """Write new and changed documents, check them, drop deleted ones, make the result live; returns the next registry.

    ``rebuilt`` has the columns of the index, without ``embedding`` where an ``embedder`` is given; rows of new and changed documents
    alone are taken, once, and each of their texts is embedded once.  Only the buckets of documents that changed are
    rewritten.  A changed document that yields no chunks has no points afterwards.  ``keywords`` follows with the same points.
    """
    if problems := maintain.incompatible(store.manifest(), manifest):
        raise ValueError(f"a full run is needed: {', '.join(problems)}")
    base, aside = store.pointer()["generation"], f"run-{uuid.uuid4().hex}"
    diff = maintain.inventory(observed, registry, requested)
    try:
        changes = store.files.table(diff.where("kind <> 'unchanged'"), f"{aside}/changes")
        chunks = store.files.table(revised(rebuilt, changes), f"{aside}/chunks")
        places = changes.select(store.place(changes).alias("place")).distinct()
        touched = [r.place for r in places.collect()]  # at most a row per workspace and bucket
        if touched:
            old = store.generation(base, touched)
            last = chunks.groupBy(key).agg(F.max_by(F.struct(*chunks.columns), order).alias("r")).select("r.*")
            fresh = last
            if embedder:  # a text that a changed document had before keeps its vector
                sent = F.sha2(F.substring(F.concat(F.lit(DOCUMENTS), F.coalesce("content", F.lit(""))), 1, CLAMP).cast("binary"), 256)
                known = old.join(changes.select(*KEY), KEY, "left_semi").groupBy(sent.alias("text_hash")).agg(F.first("embedding").alias("embedding"))
                fresh, _ = embed_new(last, known, embedder, lambda rows: store.files.table(rows, f"{aside}/vectors"))
            name = store.stage(maintain.delete_documents(old, changes).unionByName(fresh.select(*old.columns)), manifest, base=base, touched=touched)
            written = store.generation(name, touched)
            missing = unverified(written, chunks).orderBy(KEY).first()
            if missing is not None:
                raise ValueError(f"{missing.document_id} has {missing.n_points} of {missing.n_chunks} points at revision {missing.revision}")
            if keywords is not None:
                new = written.join(changes.select(*KEY), KEY, "left_semi")
                gone = old.join(changes.select(*KEY), KEY, "left_semi").select(F.col(key).alias("point_id"))
                keywords.apply(new.withColumn("point_id", F.col(key)), gone, generation=name)
            store.activate(name)
        after = maintain.merge_registry(registry, diff, now)
    finally:
        store.files.delete(aside)
    return after


def run(store: Generations, chunks: DataFrame, embedder: Embedder, model: str, now: float, *, workspace_id: str | None = None) -> dict:
    """Embed all ``chunks`` into a new generation and make it live; returns the status, which the folder keeps as well.

    With ``workspace_id`` the chunks of that workspace replace its own; the other workspaces' files are referred to as they are.
    """
    size = len(embedder(["health check"])[0])
    if workspace_id is not None:
        chunks = chunks.where(F.col("workspace_id") == workspace_id)
    if chunks.isEmpty():
        raise ValueError("no chunks: check the sources of the workspaces")
    manifest = Manifest(model, size, store.folder.rsplit("/", 1)[-1])
    previous = store.pointer()["generation"]
    rows, base, touched = embed(chunks, embedder), None, []
    if workspace_id is not None and previous:
        if problems := maintain.incompatible(store.manifest(), manifest):
            raise ValueError(f"the other workspaces would not match: {', '.join(problems)}")
        own = workspace_id.encode().hex().upper()
        base, touched = previous, [p for p in store.folders(previous) if p.partition("/")[0] == own]
        rows = rows.select(*store.generation(previous, ()).columns)
    name = store.stage(rows, manifest, base=base, touched=touched)
    written = store.generation(name)
    store.activate(name)
    ids = [r.workspace_id for r in written.select("workspace_id").distinct().orderBy("workspace_id").collect()]
    status = {
        "index_mode": "full" if workspace_id is None else "workspace", "workspace_ids": ids if workspace_id is None else [workspace_id], "chunk_count": written.count(),
        "vector_size": size, "embedding_model": model, "active_collection": name, "previous_collection": previous, "indexed_at": now,
    }
    store.write_status(status)
    return status


def scope(workspace_id: str | None, registered: Sequence[str], files: Sequence[str] = ()) -> tuple[str, str]:
    """(workspace, mode) of a job: the only workspace or all of them (*) unless one is named; files need one workspace."""
    if workspace_id is None:
        workspace_id = registered[0] if len(registered) == 1 else "*"
    elif workspace_id != "*" and workspace_id not in registered:
        raise ValueError(f"unknown workspace: {workspace_id}")
    if files and workspace_id == "*":
        raise ValueError("a partial run needs a workspace")
    return workspace_id, "partial" if files else "full"
