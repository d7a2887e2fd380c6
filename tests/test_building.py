"""From files on a disk to points, an index, and a search."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import paths as P
from tessera.functions.vectors import hash_vector
from tessera.operators import building, indexing, keywords, maintain, search
from tessera.plans import stored

SPACE = uuid.UUID("a4e2e5e0-6b8a-4f3d-9c1e-2d7f8a9b0c3e")
FILES = {
    "docs/guide.md": "# Guide\nREQ-1 booking\n\n## More\ntext of KR-2\n",
    "apps/web/a.ts": "import x from 'y'\n\nexport function book() { return 'REQ-3' }\n",
    "apps/web/tests/a.py": "def test():\n    pass\n",
    "apps/other.json": "{}",
    "apps/empty.ts": " \n",
    "lis/policy.md": "---\nid: LIS-9\ndoc_type: policy\ntags:\n  - a\nstatus: draft\n---\n# Rule\nbody\n",
    "lis/hollow.md": "---\nid: LIS-8\n---\n \n",
}


def _workspaces(root):
    own = {"root": str(root)}
    return [
        {"id": "w", **own, "sources": [{"id": "all", "type": "technical_docs", "include": ["docs/**/*.md"], **own}, {"id": "code", "type": "source_code", "include": ["apps/**/*"], **own}, {"id": "lis", "type": "lis_documents", "include": ["lis/*.md"], **own}]},
        {"id": "v", **own, "sources": [{"id": "docs", "type": "technical_docs", "include": ["docs/**/*.md"], **own}]},
    ]


def _written(root):
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_points_of_all_workspaces(spark, tmp_path):
    _written(tmp_path)
    kinds = dict(P.BUCKET_BY_TYPE)
    given = _workspaces(tmp_path)
    for w in given:
        for s in w["sources"]:
            s["type"] = next(k for k, v in kinds.items() if v == {"technical_docs": "knowledge", "source_code": "code", "lis_documents": "lis"}[s["type"]])
    texts = building.workspace_texts(spark, given)
    rows = building.build_chunks(texts).collect()
    got = {(r.workspace_id, r.source_id, r.document_id, r.chunk_index): r for r in rows}
    assert set(got) == {("w", "all", "docs/guide.md", 0), ("w", "all", "docs/guide.md", 1), ("v", "docs", "docs/guide.md", 0), ("v", "docs", "docs/guide.md", 1), ("w", "code", "apps/web/a.ts", 0), ("w", "code", "apps/web/tests/a.py", 0), ("w", "code", "apps/other.json", 0), ("w", "lis", "lis/policy.md", 0)}
    one = got["w", "code", "apps/web/a.ts", 0]
    assert (one.type, one.app, one.language, one.symbol, one.chunk_key, one.imports, one.requirement_ids, one.start_line) == ("code", "web", "typescript", "book", "function:book", ["y"], ["REQ-3"], 3)
    assert one.point_id == str(uuid.uuid5(SPACE, "w|code|apps/web/a.ts|function:book|0"))
    lis = got["w", "lis", "lis/policy.md", 0]
    assert (lis.type, lis.governance.document_id, lis.doc_type, lis.status, lis.title, lis.content, lis.start_line) == ("lis", "LIS-9", "policy", "draft", None, "# Rule\nbody", 1)
    assert lis.content_hash == hashlib.sha256(FILES["lis/policy.md"].encode()).hexdigest()
    more = got["v", "docs", "docs/guide.md", 1]
    assert (more.section, more.requirement_ids, more.chunk_key, more.point_id) == ("More", ["KR-2"], "section:More|1", str(uuid.uuid5(SPACE, "v|docs|docs/guide.md|section:More|1|1")))
    assert got["w", "code", "apps/web/tests/a.py", 0].type == "test" and len({r.point_id for r in rows}) == len(rows)
    few = building.build_chunks(texts, Config(sources="knowledge"))
    assert {r.document_id for r in few.collect()} == {"docs/guide.md"}


def test_files_are_indexed_changed_and_found(spark, tmp_path):
    _written(tmp_path / "in")
    root = tmp_path / "in"
    given = [{"id": "w", "root": str(root), "sources": [{"id": "all", "root": str(root), "include": ["docs/**/*.md"]}]}]
    embedder = lambda texts: [hash_vector(t, "") for t in texts]
    store, kept = maintain.Generations(spark, str(tmp_path / "index")), keywords.KeywordIndex(spark, str(tmp_path / "keywords"))
    texts = building.workspace_texts(spark, given)
    points = building.build_chunks(texts).withColumn("revision", F.lit(1)).drop("governance")
    status = indexing.run(store, points, embedder, "hash", 1.0)
    kept.apply(store.live(), generation=status["active_collection"])
    registry = maintain.merge_registry(spark.createDataFrame([], "workspace_id string, source_id string, document_id string, content_hash string, revision int, status string, observed_at double"), maintain.inventory(building.observed(texts), spark.createDataFrame([], "workspace_id string, source_id string, document_id string, content_hash string, revision int, status string")), 1.0)
    registry = spark.createDataFrame(registry.collect(), registry.schema)
    (root / "docs/guide.md").write_text("# Guide\nREQ-1 cancelled\n")
    texts = building.workspace_texts(spark, given)
    indexing.update(store, registry, building.observed(texts), building.build_chunks(texts).drop("governance"), store.manifest(), 2.0, embedder=embedder, keywords=kept)
    live = store.live()
    assert [(r.content, r.revision) for r in live.collect()] == [("# Guide\nREQ-1 cancelled", 2)] and kept.generation == store.pointer()["generation"]
    hit = search.search(live, "cancelled", hash_vector("x", ""), search.Filters("w"), "keyword", keywords=kept).first()
    assert hit.file == "docs/guide.md" and hit.section == "Guide" and hit.requirement_ids == ["REQ-1"] and hit.revision == 2
    assert search.search(live, "booking", hash_vector("x", ""), search.Filters("w"), "keyword", keywords=kept).count() == 0


def test_chunks_of_the_table(spark, data):
    rows = stored.build_chunks(spark, data).collect()
    assert len({r.point_id for r in rows}) == len(rows) > 200
    assert all(r.status == "draft" for r in rows if r.type == "lis") and all(r.status is None for r in rows if r.type != "lis")
    assert all(r.point_id == str(uuid.uuid5(SPACE, "|".join([r.workspace_id, r.source_id, r.document_id, r.chunk_key, str(r.chunk_index)]))) and len(r.content) <= 1200 for r in rows)
