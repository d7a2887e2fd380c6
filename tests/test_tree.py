"""Files of several workspaces in one scan, links and guards; frontmatter with lists and nesting."""

from __future__ import annotations

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions.paths import PathPolicy
from tessera.sources import files, frontmatter, tree


@pytest.fixture
def places(tmp_path):
    for name, text in {
        "repo/docs/ok.md": "# ok", "repo/docs/.env": "X=1", "repo/docs/.hidden/_deep/a.md": "h", "repo/docs/_draft.md": "d", "repo/node_modules/x/a.md": "n", "repo/src/a.py": "x = 1", "repo/src/b.exe": "b",
        "outside.md": "# outside", "lis/a.md": "# a", "lis/sub/b.md": "# b", "lis/sub/c.txt": "c",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    os.symlink(tmp_path / "outside.md", tmp_path / "repo/docs/out.md")
    os.symlink(tmp_path / "repo/docs/ok.md", tmp_path / "repo/docs/in.md")
    os.symlink(tmp_path / "nowhere", tmp_path / "repo/docs/dead.md")
    os.symlink(tmp_path / "lis", tmp_path / "repo/docs/linked")
    return tmp_path


def found(df):
    return {(r.workspace_id, r.source_id, r.identity): r.deny_reason for r in df.collect()}


def test_secrets_links_and_outside_files_are_denied(spark, places):
    one = [{"id": "w", "sources": [{"id": "docs", "root": str(places / "repo"), "type": "technical_docs", "include": ["docs/**/*.md", "docs/.env"]}]}]
    got = {k[2]: v for k, v in found(tree.workspace_files(spark, one)).items()}
    assert got == {"docs/ok.md": None, "docs/.env": "secret", "docs/.hidden/_deep/a.md": None, "docs/_draft.md": None, "docs/out.md": "outside the roots", "docs/in.md": "symlink"}
    lax = {k[2]: v for k, v in found(tree.workspace_files(spark, one, policy=PathPolicy(allow_symlinks=True))).items()}
    assert lax["docs/in.md"] is None and lax["docs/out.md"] == "outside the roots"


def test_all_workspaces_by_one_scan_with_absolute_globs(spark, places):
    lis = f"{places}/lis/**/*.md"
    given = [
        {"id": "a", "root": str(places / "repo"), "sources": [{"id": "all", "root": str(places / "repo")}, {"id": "code", "root": str(places / "repo/src"), "type": "source_code", "include": ["**/*.py"]}]},
        {"id": "b", "root": str(places / "repo"), "sources": [{"id": "lis", "type": "lis", "include": [lis]}]},
        {"id": "c", "sources": [{"id": "none", "root": str(places / "missing")}]},
    ]
    files = tree.workspace_files(spark, given)
    got = found(files.where("source_id <> 'all'"))
    assert got == {("a", "code", "src/a.py"): None, ("b", "lis", "a.md"): None, ("b", "lis", "sub/b.md"): None}
    assert not [k for k in found(files) if "node_modules" in k[2] or k[1] == "all" and k[2] == "src/a.py"]
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1
    assert tree.glob_root(lis) == f"{places}/lis" and tree.glob_root("/a/b.md") == "/a" and tree.glob_root("/*.md") == "/"
    assert tree.workspace_files(spark, []).count() == 0


def test_folders_are_partitions_and_no_file_is_lost(spark, tmp_path, monkeypatch):
    want = set()
    for i in range(30):
        for j in range(3):
            path = tmp_path / f"d{i}" / f"e{j}" / "f.md"
            path.parent.mkdir(parents=True)
            path.write_text("x")
            want.add(str(path))
        (tmp_path / f"d{i}" / "top.md").write_text("y")
        want.add(str(tmp_path / f"d{i}" / "top.md"))
    files = tree.tree(spark, [str(tmp_path), str(tmp_path / "d1")])
    assert files.rdd.getNumPartitions() > 64
    paths = [r.path for r in files.select("path").collect()]
    assert len(paths) == len(want) and set(paths) == want


def test_contents_are_read_with_guards(spark, places):
    one = [{"id": "w", "sources": [{"id": "docs", "root": str(places / "repo"), "include": ["docs/*.md", "src/*"]}]}]
    files = tree.workspace_files(spark, one).where("deny_reason IS NULL").select("identity", "path")
    listed = spark.createDataFrame(files.collect(), files.schema)  # listed before what follows happens
    (places / "repo/docs/ok.md").unlink()
    os.symlink(places / "outside.md", places / "repo/docs/ok.md")
    (places / "repo/src/a.py").unlink()
    (places / "repo/docs/_draft.md").write_text("z" * 50)
    got = {r.identity: (r.content and bytes(r.content), r.read_error) for r in tree.read_files(listed, policy=PathPolicy(max_bytes=20)).collect()}
    assert got == {"docs/ok.md": (None, "symlink"), "src/a.py": (None, "No such file or directory"), "docs/_draft.md": (None, "too large")}
    assert [bytes(r.content) for r in tree.read_files(listed.where("identity = 'docs/_draft.md'")).collect()] == [b"z" * 50]


BLOCKS = [
    "id: LIS-1\ntitle: 'A ''quoted'' title'\nstatus:\n",
    "tags: [a, 'b c', \"d\\n\", 3]\nowner: {name: X, ids: [1, 2]}\n",
    "tags:\n  - a\n  - b: 1\n    c: two\n  -\n    - deep\n    - er\nlast: true\n",
    "reviewers:\n- one\n- two\nnext: ~\n",
    "a:\n  b:\n    c: 1.5\n    d: -3\n  e: null\n# comment\nf: x # not this\ng: 'x # this'\n",
    "text: |\n  line one\n    indented\n\n  last\nfold: >-\n  a\n  b\n\n  c\nend: 1\n",
    "url: http://x.y/z?a=b#c\n\"quoted key\": v\n",
    "- just\n- a list\n",
    "",
]


@pytest.mark.parametrize("block", BLOCKS)
def test_blocks_mean_what_yaml_says(block):
    yaml = pytest.importorskip("yaml")
    assert frontmatter.parse(block) == (yaml.safe_load(block) or {})


@pytest.mark.parametrize("block", ["a: b: c\n", "a: [1, 2\n", "a: &x 1\n", "a:\n    b: 1\n  c: 2\n", "key\nother: 1\n", 'a: "open\n'])
def test_malformed_blocks_leave_the_text_as_it_is(block):
    text = f"---\n{block}---\nbody\n"
    assert frontmatter.split(text) == ({}, text)


def test_predicates_on_lists_and_nesting(spark):
    text = "---\nid: ' LIS-7 '\ntitle: 12\ntags:\n  - alpha\n  - beta\nowner:\n  team: core\nstatus: ''\n---\nbody\n"
    rows = spark.createDataFrame([("a", text), ("b", "# none\n"), ("c", "---\n- list\n---\nx"), ("d", None), ("e", "---\nopen: 1\n")], "k string, t string")
    got = rows.select("k", frontmatter.frontmatter(F.col("t")).alias("f")).select("k", "f.body", frontmatter.governance_fields(F.col("f.meta")).alias("g"), frontmatter.has(F.col("f.meta"), "$.tags", "beta").alias("beta"), F.try_variant_get("f.meta", "$.owner.team", "string").alias("team"))
    found = {r.k: (r.body, r.g.document_id, r.g.title, r.g.status, r.beta, r.team) for r in got.collect()}
    assert found["a"] == ("body\n", "LIS-7", "12", None, True, "core")
    assert {k: v for k, v in found.items() if k != "a"} == {"b": ("# none\n", None, None, None, False, None), "c": ("---\n- list\n---\nx", None, None, None, False, None), "d": (None, None, None, None, False, None), "e": ("---\nopen: 1\n", None, None, None, False, None)}


def test_documents_that_are_no_text(spark):
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>två</w:t></w:r></w:p></w:body></w:document>')
    rows = spark.createDataFrame([("/r/a.DOCX", packed.getvalue()), ("/r/b.md", "# é\xff".encode("latin-1"))], "path string, content binary")
    got = {r.path: (r.text, r.adapter, r.media_type) for r in files.extract(rows).collect()}
    assert got["/r/a.DOCX"] == ("one line\ntvå", "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
    assert got["/r/b.md"] == ("# \ufffd\ufffd", "markdown", "text/markdown")


def test_pdf_needs_its_reader():
    try:
        import pypdf  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="pypdf"):
            files.pdf_text(b"%PDF")


def test_workspace_manifests(spark):
    one = {"schema_version": 1, "id": "w", "tags": ["t"], "roots": [{"id": "r", "path": "src", "include": ["**/*.py"]}], "relationships": [{"target": "v", "type": "depends_on"}]}
    row = files.workspaces(spark, [one, {"schema_version": 1, "id": "v", "roots": [{"id": "r"}]}]).where("workspace_id = 'w'").first()
    assert row.sources[0].id == "r" and row.sources[0].include == ["**/*.py"] and row.relationships[0].target == "v" and row.tags == ["t"]
    for bad in ([one, one], [one | {"more": 1}], [one | {"schema_version": 2}], [one | {"roots": []}], [one | {"roots": [{"id": "a"}, {"id": "a"}]}]):
        with pytest.raises(ValueError):
            files.workspaces(spark, bad)
