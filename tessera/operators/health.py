"""What an index is like and what is wrong with it: status with hints, and nine checks of an installation."""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PAYLOAD_SCHEMA_VERSION
from ..sources import files as sources
from ..sources import tree
from .maintain import Generations

#: Modules that the library needs, and least version of Python.
MODULES, PYTHON = ("pyspark", "pyarrow", "numpy", "pandas"), (3, 11)
OK, WARN, FAIL = "ok", "warn", "fail"


def git_head(folder: str) -> str | None:
    """The commit that a working copy is at, read from its files; None if there is none."""
    base = os.path.join(folder, ".git")
    try:
        if os.path.isfile(base):  # a linked working copy names its folder
            with open(base, encoding="utf-8") as f:
                base = os.path.join(folder, f.read().strip().removeprefix("gitdir: "))
        with open(os.path.join(base, "HEAD"), encoding="utf-8") as f:
            head = f.read().strip()
        if not head.startswith("ref: "):
            return head or None
        name = head.removeprefix("ref: ")
        common = base
        if os.path.exists(shared := os.path.join(base, "commondir")):
            with open(shared, encoding="utf-8") as f:
                common = os.path.join(base, f.read().strip())
        for place in (base, common):
            if os.path.exists(path := os.path.join(place, name)):
                with open(path, encoding="utf-8") as f:
                    return f.read().strip() or None
        with open(os.path.join(common, "packed-refs"), encoding="utf-8") as f:
            return next((x.split()[0] for x in f if x.strip().endswith(f" {name}")), None)
    except OSError:
        return None


def points_by(points: DataFrame) -> DataFrame:
    """(workspace_id, source_id, type, points, documents): counts of points and documents on each level, null where a level is summed up."""
    kept = points.select("workspace_id", F.coalesce("source_id", F.lit("")).alias("source_id"), F.coalesce("type", F.lit("")).alias("type"), "document_id")
    return kept.rollup("workspace_id", "source_id", "type").agg(F.count("*").alias("points"), F.countDistinct("workspace_id", "source_id", "document_id").alias("documents"))


def files_by_bucket(files: DataFrame) -> DataFrame:
    """(workspace_id, bucket, files) of the readable files of workspaces."""
    readable = files.where("deny_reason IS NULL") if "deny_reason" in files.columns else files
    return readable.groupBy("workspace_id", F.coalesce("bucket", F.lit("unknown")).alias("bucket")).agg(F.count("*").alias("files"))


def status(store: Generations, *, model: str | None = None, head: str | None = None, workspace_id: str | None = None) -> dict:
    """Points, lifecycle, last success and hints: another model than the index's, another commit, an index of another layout, nothing indexed."""
    known, live = store.status(), store.pointer()["generation"]
    points = store.live([workspace_id] if workspace_id else None).count() if live else 0
    manifest = store.manifest()
    error = (known or {}).get("error") or ""
    mode = (known or {}).get("index_mode")
    state = "not_indexed" if known is None else "error" if error else "partial" if mode == "partial" else "ready" if points else "not_indexed"
    hints = []
    if not points:
        hints.append("nothing is indexed: run a full index")
    if manifest and model and manifest.embedding_model != model:
        hints.append(f"the index was made with {manifest.embedding_model!r}, not {model!r}: a full run is needed")
    if manifest and manifest.payload_schema_version != PAYLOAD_SCHEMA_VERSION:
        hints.append(f"points have layout {manifest.payload_schema_version}, not {PAYLOAD_SCHEMA_VERSION}: a full run is needed")
    indexed = (known or {}).get("git_sha")
    if indexed and head and indexed != head:
        hints.append(f"indexed at commit {indexed[:8]}, the working copy is at {head[:8]}")
    return {
        "workspace_id": workspace_id, "points_count": points, "generation": live, "lifecycle": state, "error_count": int(state == "error"),
        "last_success_at": (known or {}).get("indexed_at"), "embedding_model": manifest.embedding_model if manifest else None, "hints": hints,
    }


def doctor(spark: SparkSession, store: Generations, *, manifests: Sequence[dict], workspaces: Sequence[dict], model: str, collection: str | None = None, embedder: object | None = None, head: str | None = None) -> DataFrame:
    """(position, check, status, detail): Python, modules, configuration, manifests, store, embedder, index manifest, index, sources.

    ``embedder`` is asked for its health where it has one; without it that check is skipped.
    """
    rows: list[tuple[str, str, str]] = []

    def add(check: str, state: str, detail: str) -> None:
        rows.append((check, state, detail))

    found = sys.version_info[:3]
    add("python", OK if found >= PYTHON else FAIL, ".".join(map(str, found)))
    missing = [m for m in MODULES if importlib.util.find_spec(m) is None]
    add("imports", FAIL if missing else OK, f"missing: {', '.join(missing)}" if missing else ", ".join(MODULES))
    add("config", OK, f"folder={store.folder} model={model}")
    try:
        ids = [r.workspace_id for r in sources.workspaces(spark, list(manifests)).orderBy("workspace_id").collect()]
        add("manifests", OK if ids else FAIL, f"{len(ids)} workspaces: {', '.join(ids)}" if ids else "there is no workspace manifest")
    except (ValueError, KeyError) as error:
        add("manifests", FAIL, str(error))
    live = None
    try:
        live = store.pointer()["generation"]
        add("store", OK if live else WARN, f"generation {live} is live" if live else "no generation is live: run a full index")
        if live:
            store.folders(live)
    except Exception as error:
        rows[-1:] = [("store", FAIL, str(error))]
    if embedder is None:
        add("embedding", OK, f"skipped (model={model})")
    else:
        fine, said = embedder.health()
        add("embedding", OK if fine else FAIL, said)
    try:
        manifest = store.manifest() if live else None
        if manifest is None:
            add("index_manifest", WARN, "missing: a full run makes it")
        else:
            notes = [f"payload_schema_version={manifest.payload_schema_version}", f"model={manifest.embedding_model!r}"]
            wrong = [f"expected payload_schema_version={PAYLOAD_SCHEMA_VERSION}"] if manifest.payload_schema_version != PAYLOAD_SCHEMA_VERSION else []
            wrong += [f"config model={model!r}"] if manifest.embedding_model != model else []
            wrong += [f"manifest collection={manifest.collection!r}"] if collection and manifest.collection != collection else []
            add("index_manifest", WARN if wrong else OK, "; ".join(notes + wrong))
        now = status(store, model=model, head=head)
        add("index", WARN if now["hints"] else OK, "; ".join([f"points={now['points_count']}", *now["hints"]]))
    except Exception as error:
        add("index", WARN, f"status unavailable: {error}")
    counts: dict[str, dict[str, int]] = {w["id"]: {} for w in workspaces}
    for r in files_by_bucket(tree.workspace_files(spark, workspaces)).collect():  # a row per workspace and bucket
        counts[r.workspace_id][r.bucket] = r.files
    parts = [f"{w}: {sum(c.values())} files ({', '.join(f'{b}={n}' for b, n in sorted(c.items()))})" if c else f"{w}: 0 files" for w, c in counts.items()]
    add("sources", OK if counts and all(counts.values()) else WARN, "; ".join(parts) or "no workspaces")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position int, check string, status string, detail string")
