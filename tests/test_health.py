"""Status with hints, the nine checks, counts by level, and the commit of a working copy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import health, indexing, maintain

SHA = "0123456789abcdef0123456789abcdef01234567"


class Embedder:
    def __init__(self, fine):
        self.fine = fine

    def health(self):
        return self.fine, "ok dim=2" if self.fine else "refused"


def _store(spark, path):
    store = maintain.Generations(spark, str(path))
    rows = spark.createDataFrame([("w", "s", "d", 0, "one"), ("w", "s", "d", 1, "two"), ("v", "s", "e", 0, "three")], "workspace_id string, source_id string, document_id string, chunk_index int, content string")
    indexing.run(store, rows.withColumn("point_id", F.concat_ws("/", "workspace_id", "document_id", "chunk_index")), lambda texts: [[1.0, 2.0] for _ in texts], "m", 5.0)
    return store


def test_the_nine_checks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("x")
    manifest = {"schema_version": 1, "id": "w", "roots": [{"id": "r"}]}
    places = [{"id": "w", "sources": [{"id": "r", "root": str(tmp_path / "in")}]}, {"id": "empty", "sources": [{"id": "r", "root": str(tmp_path / "none")}]}]
    empty = maintain.Generations(spark, str(tmp_path / "empty"))
    ask = lambda store, **o: {r.check: (r.status, r.detail) for r in health.doctor(spark, store, **({"manifests": [manifest], "workspaces": places[:1], "model": "m"} | o)).orderBy("position").collect()}
    first = ask(empty, manifests=[], workspaces=places, embedder=Embedder(False))
    assert list(first) == ["python", "imports", "config", "manifests", "store", "embedding", "index_manifest", "index", "sources"]
    assert {k: v[0] for k, v in first.items()} == {"python": "ok", "imports": "ok", "config": "ok", "manifests": "fail", "store": "warn", "embedding": "fail", "index_manifest": "warn", "index": "warn", "sources": "warn"}
    assert first["sources"][1].endswith("empty: 0 files") and "1 files" in first["sources"][1]
    store = _store(spark, tmp_path / "index")
    fine = ask(store, embedder=Embedder(True))
    assert {v[0] for v in fine.values()} == {"ok"} and fine["index"][1] == "points=3" and fine["embedding"][1] == "ok dim=2"
    other = ask(store, model="new", collection="c", manifests=[manifest | {"schema_version": 3}])
    assert other["index_manifest"][0] == other["index"][0] == "warn" and "'new'" in other["index_manifest"][1] and other["manifests"][0] == "fail" and other["embedding"][1].startswith("skipped")


def test_status_has_hints(spark, tmp_path):
    store = _store(spark, tmp_path / "index")
    now = health.status(store, model="m", head=SHA)
    assert (now["points_count"], now["lifecycle"], now["last_success_at"], now["hints"]) == (3, "ready", 5.0, []) and health.status(store, workspace_id="v")["points_count"] == 1
    store.write_status(store.status() | {"git_sha": "f" * 40, "error": "no disk"})
    later = health.status(store, model="x", head=SHA)
    assert later["lifecycle"] == "error" and later["error_count"] == 1 and len(later["hints"]) == 2 and "ffffffff" in later["hints"][1]
    assert health.status(maintain.Generations(spark, str(tmp_path / "none")))["lifecycle"] == "not_indexed"


def test_points_on_each_level(spark):
    rows = spark.createDataFrame([("w", "s", "code", "a"), ("w", "s", "code", "a"), ("w", "t", "code", "a"), ("v", None, None, "b")], "workspace_id string, source_id string, type string, document_id string")
    got = {(r.workspace_id, r.source_id, r.type): (r.points, r.documents) for r in health.points_by(rows).collect()}
    assert got == {(None, None, None): (4, 3), ("w", None, None): (3, 2), ("w", "s", None): (2, 1), ("w", "s", "code"): (2, 1), ("w", "t", None): (1, 1), ("w", "t", "code"): (1, 1), ("v", None, None): (1, 1), ("v", "", None): (1, 1), ("v", "", ""): (1, 1)}


def test_the_commit_of_a_working_copy(tmp_path):
    git = tmp_path / ".git"
    assert health.git_head(str(tmp_path)) is None
    git.mkdir()
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    assert health.git_head(str(tmp_path)) is None
    (git / "packed-refs").write_text(f"# pack-refs\n{SHA} refs/heads/main\n")
    assert health.git_head(str(tmp_path)) == SHA
    (git / "refs/heads").mkdir(parents=True)
    (git / "refs/heads/main").write_text("a" * 40 + "\n")
    assert health.git_head(str(tmp_path)) == "a" * 40
    (git / "HEAD").write_text(SHA + "\n")
    assert health.git_head(str(tmp_path)) == SHA
