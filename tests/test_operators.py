"""Order-dependent folds against Python models, and rules on their own cases."""

from __future__ import annotations

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.config import AppRule, Config, check_limit, enabled_buckets
from tessera.functions import identity as I
from tessera.functions import paths as P
from tessera.functions import text as T
from tessera.functions.stem import porter
from tessera.functions.vectors import hash_embedding, hash_vector
from tessera.operators import chunking, composite, graph, indexing, jobs, lexical, maintain, metrics, search
from tessera.sources import embedding
from tessera.sources import files as sources


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(values[n], (str, type(None))) else 'array<string>'}" for n in names))
    return row.select(column.alias("x")).first().x


def windows(text, size, overlap):
    return chunking._cut(text, size, overlap)


def pack(paragraphs, size, overlap, markdown):
    out, current = [], ""
    for p in paragraphs:
        if len(p) > size:
            out += [current.strip()] * bool(current.strip()) + windows(p, size, overlap)
            current = ""
            continue
        joined = f"{current}\n\n{p}".strip() if current else p
        if len(joined) > size and current:
            out.append(current.strip())
            tail = current[-overlap:] if overlap > 0 and (not markdown or len(current) > overlap) else ""
            current = f"{tail}\n\n{p}".strip() if tail else p
            if len(current) > size:
                out += windows(current, size, overlap)
                current = ""
        else:
            current = joined
    out += [current.strip()] * bool(current.strip())
    return [x for c in out for x in (windows(c, size, overlap) if len(c) > size else [c])]


def texts():
    r = random.Random(9)
    for _ in range(60):
        yield "\n\n".join("".join(r.choice("ab é\n") for _ in range(r.randrange(0, 70))) for _ in range(r.randrange(0, 8)))


@pytest.mark.parametrize(("size", "overlap"), [(40, 10), (40, 0), (20, 25)])
def test_packing(spark, size, overlap):
    cases = list(texts())
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    t = F.col("t")
    found = df.select("t", chunking.windows(t, size, overlap).alias("w"), chunking.pack(chunking.markdown_paragraphs(t), size, overlap).alias("m"), chunking.code_chunks(t, size, overlap).alias("c"))
    for r in found.collect():
        assert r.w == windows(r.t, size, overlap)
        assert r.m == pack([p.strip() for p in re.split(r"\n\s*\n", r.t) if p.strip()], size, overlap, True)
        body = r.t.strip()
        assert r.c == ([] if not body else [body] if len(body) <= size else pack([p for p in body.split("\n\n") if p.strip()], size, overlap, False))
        assert all(len(x) <= size for x in r.w + r.m + r.c)


def test_sections_and_lines(spark):
    text = "before\n# One\nbody\r\n## Two  \n\n#### not\nend\n#no\n"
    found = one(spark, chunking.sections(F.col("t")), t=text)
    assert [(s.section, s.body) for s in found] == [(None, "before"), ("One", "# One\nbody"), ("Two", "## Two  \n\n#### not\nend\n#no")]
    ranges = one(spark, chunking.line_ranges(F.col("t"), F.col("c")), t="a\nb\na\nc", c=["a\nb", "a", "nowhere", "a\nc"])
    assert [r and (r.start_line, r.end_line) for r in ranges] == [(1, 2), (3, 3), None, (3, 4)]


def test_python_chunks(spark):
    code = '"""Doc."""\nimport os\nfrom a import b\n\nclass G:\n    x = 1\n\n    def hello(self):\n        return 1\n\ndef top():\n    pass\n'
    df = spark.createDataFrame([("a", code), ("b", "def (:\n"), ("c", None)], "document_id string, content string")
    rows = chunking.python_chunks(df).collect()
    assert [(r.symbol, r.symbol_kind, r.chunk_key) for r in rows if r.document_id == "a"] == [("<module>", "module", "module:docstring"), ("G", "class", "class:G"), ("G.hello", "method", "method:G.hello"), ("top", "function", "function:top")]
    assert [r.chunk_key for r in rows if r.document_id == "b"] == ["size:0"]


def test_identity(spark):
    import uuid

    name = "ws|s|docs/é.md|chunk:0|0"
    space = uuid.UUID("a4e2e5e0-6b8a-4f3d-9c1e-2d7f8a9b0c3e")
    assert one(spark, I.uuid5(F.col("n")), n=name) == str(uuid.uuid5(space, name))
    assert one(spark, I.document_id(F.col("n")), n=" ././.devdoc\\a.md\n") == ".devdoc/a.md"


def test_paths(spark):
    config = Config(documentation_prefixes=("docs",), apps=(AppRule("apps/", "apps"), AppRule("apps/web/api/", "api")))
    kind = lambda p, b=None: tuple(one(spark, P.classify(F.col("p"), F.lit(b).cast("string"), config), p=p))
    assert kind("apps/web/api/x.tsx") == ("code", "api", "typescript", "apps/web/api/x.tsx")
    assert kind("./apps/tests/x.py") == ("test", "apps", "python", "apps/tests/x.py")
    assert kind("docs/a") == ("documentation", "global", "markdown", "docs/a")
    assert kind("x/README.md")[0] == "documentation" and kind("x.md", "lis")[0] == "lis"
    reason = lambda p, n=1: one(spark, P.deny_reason(F.col("p"), F.lit(n), None, ("/r",)), p=p)
    assert [reason("/r/a.md"), reason("/r/.env"), reason("/r/a.exe"), reason("/q/a.md"), reason("/r/LICENSE"), reason("/r/a.md", 2_000_001)] == [None, "secret", "suffix not allowed", "outside the roots", None, "too large"]
    assert composite.is_path("a/b") and composite.is_path("x.py") and not composite.is_path("how is a/b made")


def test_text(spark):
    assert one(spark, T.requirement_ids(F.col("t")), t="REQ-2, req-10 KR-1 PUS-99 REQ-2") == ["KR-1", "REQ-10", "REQ-2", "US-99"]
    assert one(spark, T.redact(F.col("t")), t="api_key: x Bearer ab.c") == "[REDACTED] [REDACTED]"
    assert one(spark, T.overlap("cart a ART", F.col("t"), F.lit("f")), t="cart") == 1.0
    assert one(spark, T.overlap(F.col("q"), F.col("t"), F.lit("docs/x")), t="body", q="docs/ zzz") == 0.5
    assert T.weights(0, 0) == (1.0, 0.0) and T.weights(-1, 2) == (0.0, 1.0)
    a, b = one(spark, hash_embedding(F.col("t"), "d:"), t="é"), hash_vector("é", "d:")
    assert all(abs(x - y) < 1e-12 for x, y in zip(a, b, strict=True))


def test_keyword_search_agrees_with_sqlite(spark):
    words = ["Booking", "bookings", "booked", "service", "services", "naïve", "relational", "hopping", "xyzzy", "caresses", "ponies", "REQ-3", "happily"]
    r = random.Random(3)
    docs = [(str(i), "w", "s", " ".join(r.choice(words) for _ in range(r.randrange(1, 25)))) for i in range(40)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, body, tokenize = 'porter unicode61')")
    db.executemany("INSERT INTO t VALUES (?, ?)", [(d[0], d[3]) for d in docs])
    df = spark.createDataFrame(docs, "point_id string, workspace_id string, source_id string, content string").cache()
    for query in ("booking", "naive services", "req-3", "happy pony", "relate -- hop"):
        tokens = [t for t in re.findall(r"[a-z0-9_./-]+", query, re.I) if len(t) > 1 and re.search("[a-z0-9]", t, re.I)]
        want = dict(db.execute("SELECT id, bm25(t) FROM t WHERE t MATCH ?", [" AND ".join(f'"{t}"' for t in tokens)]).fetchall())
        got = {r.point_id: r.bm25 for r in lexical.keyword_search(df, query, 50, workspace_id="w").collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got), query
    assert lexical.keyword_search(df, "- .", 5, workspace_id="w").count() == 0
    assert [porter(w) for w in ("sky", "generalizations", "feed", "agreed", "falling", "rational")] == ["sky", "gener", "feed", "agre", "fall", "ration"]


def test_places_of_terms_are_those_of_the_words(spark, monkeypatch):
    """Words by passes over code points are the words of the pattern, in parts too; stems begin as their words do."""
    texts = ["Ünïcode naïve e\u0301te\u0301 \u0301x", None, "", "ΟΔΟΣ οδος a_b  a-b", "İstanbul ²3 x\u0301\u0301y", "end", "begin the things thing's ponies", "日本 語 don't"]
    monkeypatch.setattr(T, "PART", 20)
    for some in (texts, texts[3:4], []):
        points, first, end, own = T.word_spots(some)
        found = [points[a:z].tobytes().decode("utf-32-le") for a, z in zip(first, end, strict=True)]
        assert [found[a:z] for a, z in zip(own, own[1:], strict=False)] == [T.word_list(t) for t in some]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.words(F.col("text")).alias("words")).collect()
    assert [r.words for r in rows] == [T.word_list(r.text) for r in rows]
    roots = ["rela", "hop", "gener", "sens", "anal", "trou", "cons", "bl", "visi", "tr", "agr", "fl", "yb", "s"]
    ends = ["ational", "tional", "enci", "anci", "izer", "bli", "alli", "entli", "eli", "ousli", "ization", "ation", "ator", "alism", "iveness", "fulness", "ousness", "aliti", "iviti", "biliti", "icate", "ative", "alize", "ical", "ness", "ement", "able", "ing", "ed", "y", "s", "ies", "sses", "bly", "bilities", "logies", "ly", "eed", "ions", ""]
    for w in {r + a + b for r in roots for a in ends for b in ends}:
        shared = max(1, len(porter(w)) - lexical.CHANGED)
        assert w[:shared] == porter(w)[:shared]


def test_scores_that_are_equal_in_six_decimals_are_ties(spark):
    """A word of most documents weighs so little that lengths show behind the sixth decimal only; the point decides."""
    texts = {"1": "the sun", "2": "the", "3": "the sun and the moon", "4": "the", "5": "moon"}
    docs = spark.createDataFrame([(k, "w", "s", t) for k, t in texts.items()], "point_id string, workspace_id string, source_id string, content string")
    found = lexical.keyword_search(docs, "the", 3, workspace_id="w", stemmed=False).collect()
    assert [r.point_id for r in found] == ["1", "2", "3"] and found[2].bm25 > found[0].bm25 > found[1].bm25
    assert all(r.score == 1 / (1 + abs(round(r.bm25, 6))) for r in found)


def test_nearest_of_a_group_meet_in_blocks(spark, monkeypatch):
    """Odd vectors have no neighbours, null groups meet nothing, and no row is made of each pair of a query and a row."""
    r = random.Random(8)
    rows = [(i, [float(r.randrange(-2, 3)) for _ in range(4 if i % 9 else 3)], None if i % 13 == 0 else f"g{i % 2}") for i in range(120)] + [(200, None, "g0"), (201, [None] * 4, "g0"), (202, [0.0] * 4, "g1")]
    table = spark.createDataFrame(rows, "key bigint, embedding array<double>, group string")
    asked = table.where("key % 10 = 0").select(F.col("key").alias("query_id"), F.col("embedding").alias("query_vector"), "group")
    size = lambda v: sum(x * x for x in v) ** 0.5
    fine = [(k, v, g) for k, v, g in rows if v and None not in v and size(v) and g]
    want = set()
    for q, v, g in fine:
        if q % 10 == 0:
            near = sorted((-round(sum(x * y for x, y in zip(v, w, strict=True)) / size(v) / size(w), 6), k) for k, w, h in fine if h == g and len(w) == len(v))
            want |= {(q, n, k, -c) for n, (c, k) in enumerate(near[:5], 1)}
    found = search.nearest_per_group(asked, table, 5, group="group")
    assert {tuple(x) for x in found.collect()} == want
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    assert all(x.raw >= 0.9 for x in search.nearest_per_group(asked, table, 5, group="group", threshold=0.9).collect())


def test_filters_and_limits():
    for bad in (search.Filters(), search.Filters("w", scope="global"), search.Filters("w", scope="source"), search.Filters("w", doc_type="novel")):
        with pytest.raises(ValueError):
            bad.check()
    for bad in (0, 51, True, "8"):
        with pytest.raises(ValueError):
            check_limit(bad)
    assert enabled_buckets(Config(sources="both", capabilities=("code", "lis"))) == {"code"}


def test_fusion_prefers_what_both_lists_have(spark):
    lists = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 2, "c")], "list_no int, rank int, point_id string")
    assert [r.point_id for r in search.fuse(lists).collect()] == ["b", "a", "c"]


def test_graph(spark):
    edges = spark.createDataFrame([("app", "shared", "depends_on", 0), ("app", "docs", "documents", 1), ("shared", "app", "references", 0), ("shared", "far", "tests", 1), ("docs", "secret", "tests", 0)], "src string, dst string, type string, position int")
    names = ("app", "shared", "docs", "far")
    found = {r.workspace_id: (r.depth, list(r.via)) for r in graph.expand(edges, "app", max_depth=2, allowlist=names).collect()}
    assert found == {"shared": (1, ["app"]), "docs": (1, ["app"]), "far": (2, ["app", "shared"])}


def test_rate_limit(spark):
    r = random.Random(8)
    rows = [(r.randrange(3), i, float(r.randrange(200))) for i in range(300)]
    df = spark.createDataFrame(rows, "client int, request_id bigint, ts double")
    got = {x.request_id: x.admitted for x in metrics.admitted(df, limit=5, seconds=20).collect()}
    for c in range(3):
        taken = []
        for _, i, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[2], x[1])):
            ok = sum(s > t - 20 for s in taken) < 5
            taken += [t] * ok
            assert got[i] == ok


def test_generations(spark, tmp_path):
    store = maintain.Generations(spark, str(tmp_path / "index"))
    rows = spark.createDataFrame([("w", 1)], "workspace_id string, n int")
    manifest = maintain.Manifest("model", 4, "c")
    with pytest.raises(ValueError):
        store.stage(rows.limit(0), manifest)
    first = store.stage(rows, manifest)
    store.activate(first)
    second = store.stage(rows.withColumn("n", F.lit(2)), manifest)
    assert [r.n for r in store.live().collect()] == [1]
    store.activate(second)
    assert [r.n for r in store.live().collect()] == [2] and store.manifest() == manifest
    assert store.rollback() == first and [r.n for r in store.live().collect()] == [1]
    assert maintain.incompatible(manifest, maintain.Manifest("other", 4, "c")) == ["embedding_model"]


def _corpus(spark, texts):
    """(observed, rebuilt): each document's words are its chunks; the vector holds a word's length."""
    rows = [("007", "s", d, t) for d, t in texts.items()]
    docs = spark.createDataFrame(rows, "workspace_id string, source_id string, document_id string, content string")
    words = docs.select(*maintain.KEY, F.posexplode(F.split("content", " ")).alias("chunk_index", "content")).where("content <> ''")
    words = words.withColumn("point_id", F.concat_ws("/", "document_id", F.col("chunk_index").cast("string"), "content"))
    return docs.select(*maintain.KEY, F.sha2("content", 256).alias("content_hash")), words


def test_index_runs(spark, tmp_path):
    lengths = lambda texts: [[float(len(t)), 1.0] for t in texts]  # noqa: E731  workers can't import this module
    store = maintain.Generations(spark, str(tmp_path / "index"))
    observed, words = _corpus(spark, {"a": "one two", "b": "three", "c": "four"})
    first = words.withColumn("revision", F.lit(1))
    with pytest.raises(ValueError, match="no chunks"):
        indexing.run(store, first.limit(0), lengths, "m", 1.0)
    status = indexing.run(store, first, lengths, "m", 1.0)
    assert status == store.status() and (status["chunk_count"], status["vector_size"], status["workspace_ids"]) == (4, 2, ["007"])
    registry = observed.withColumns({"revision": F.lit(1), "status": F.lit("active"), "observed_at": F.lit(1.0)})

    observed, words = _corpus(spark, {"a": "one six", "b": "three", "d": "five"})
    rebuilt = embedding.embed(words, lengths)
    manifest = store.manifest()
    with pytest.raises(ValueError, match="embedding_model"):
        indexing.update(store, registry, observed, rebuilt, maintain.Manifest("other", 2, manifest.collection), 2.0)
    twice = rebuilt.union(rebuilt.where("document_id = 'd'"))  # two chunks with one id are one point
    with pytest.raises(ValueError, match="d has 1 of 2 points at revision 1"):
        indexing.update(store, registry, observed, twice, manifest, 2.0)
    assert store.pointer()["generation"] == status["active_collection"] and store.live().count() == 4

    after = indexing.update(store, registry, observed, rebuilt, manifest, 2.0)
    assert {(r.document_id, r.revision, r.status) for r in after.collect()} == {("a", 2, "active"), ("b", 1, "active"), ("c", 1, "deleted"), ("d", 1, "active")}
    live = store.live()
    assert {(r.workspace_id, r.point_id, r.revision) for r in live.collect()} == {("007", "a/0/one", 2), ("007", "a/1/six", 2), ("007", "b/0/three", 1), ("007", "d/0/five", 1)}
    assert not live.where("embedding[0] <> length(content) + 2").count()

    other = first.withColumn("workspace_id", F.lit("8")).where("document_id = 'b'")
    assert indexing.run(store, other, lengths, "m", 3.0, workspace_id="8")["chunk_count"] == 5
    assert indexing.run(store, other.withColumn("content", F.lit("xx")), lengths, "m", 4.0, workspace_id="8")["chunk_count"] == 5
    assert {r.content for r in store.live().where("workspace_id = '8'").collect()} == {"xx"}


def test_job_scope():
    assert indexing.scope(None, ["w"]) == ("w", "full") and indexing.scope(None, ["v", "w"]) == ("*", "full")
    assert indexing.scope("w", ["v", "w"], ["a.py"]) == ("w", "partial")
    for given in ((None, ["v", "w"], ["a.py"]), ("x", ["w"], [])):
        with pytest.raises(ValueError):
            indexing.scope(*given)


def test_job_runs(spark):
    kind = "job_id bigint, workspace_id string, source_id string, status string, created_at double, updated_at double, lease_expires_at double, error string"
    rows = [(1, "w", "s", "queued", 2.0, 2.0, 99.0, ""), (2, "w", "s", "queued", 1.0, 1.0, 99.0, ""), (3, "v", "s", "queued", 1.0, 1.0, 99.0, ""), (4, "v", "s", "running", 1.0, 1.0, 99.0, ""), (5, "u", "s", "running", 1.0, 1.0, 5.0, ""), (6, "u", "s", "queued", 1.0, 1.0, None, "")]
    table = spark.createDataFrame(rows, kind)
    asked = table.select("job_id").union(table.select("job_id"))
    claimed = jobs.claim(table, asked, 10.0, 30.0)
    assert {r.job_id: r.status for r in claimed.collect()} == {1: "queued", 2: "running", 3: "queued", 4: "running", 5: "failed", 6: "running"}
    assert {r.job_id for r in claimed.where("claimed").collect()} == {2, 6}
    renewed = jobs.renew(claimed.drop("claimed"), asked, 20.0, 50.0)
    assert {r.job_id for r in renewed.where("lease_expires_at = 70").collect()} == {2, 4, 6}
    ended = jobs.finish(renewed, spark.createDataFrame([(2, None), (4, "bad")], "job_id bigint, error string"), 30.0)
    assert {(r.job_id, r.status, r.error, r.lease_expires_at) for r in ended.where("updated_at = 30").collect()} == {(2, "succeeded", "", None), (4, "failed", "bad", None)}


def test_files(spark, tmp_path):
    (tmp_path / "docs/sub").mkdir(parents=True)
    (tmp_path / "docs/a.md").write_bytes(b"---\nid: LIS-1\ntitle: 'T'\nstatus:\n---\nbody \xff\n")
    (tmp_path / "docs/sub/b.py").write_text("x = 1\n")
    (tmp_path / "docs/kubeconfig").write_text("k")
    given = [{"id": "all", "root": str(tmp_path / "docs"), "type": "technical_docs"}, {"id": "code", "root": str(tmp_path / "docs"), "type": "source_code", "include": ["**/*.py"]}]
    found = sources.discover(sources.scan(spark, str(tmp_path / "docs")), given)
    assert {(r.identity, r.source_id, r.bucket, r.deny_reason) for r in found.collect()} == {("a.md", "all", "knowledge", None), ("sub/b.py", "code", "code", None), ("kubeconfig", "all", "knowledge", "secret")}
    docs = sources.extract(found.where("deny_reason IS NULL"))
    text = docs.where("adapter = 'markdown'").select(sources.split_frontmatter(F.col("text")).alias("s")).select("s.body", sources.lis_fields(F.col("s.meta")).alias("l")).first()
    assert text.body == "body �\n" and text.l.document_id == "LIS-1" and text.l.title == "T" and text.l.status is None
    part = one(spark, sources.document_slice(F.col("t"), 2, 9), t="a\r\nb\nc")
    assert tuple(part) == ("b\nc", 2, 3, 3)


def test_embedding(spark):
    rows = spark.createDataFrame([("x",), (None,), ("yy",)], "content string")
    found = embedding.embed(rows, lambda batch: [[float(len(t))] for t in batch], batch=2)
    assert sorted((r.content or "", list(r.embedding)) for r in found.collect()) == [("", [2.0]), ("x", [3.0]), ("yy", [4.0])]
    now = [0.0]
    breaker = embedding.Breaker(failures=2, cool_down=30, clock=lambda: now[0])
    breaker.record(False), breaker.record(False)
    with pytest.raises(RuntimeError):
        breaker.check()
    now[0] = 31
    breaker.check()
    assert [embedding.endpoint(x) for x in ("http://h/v1/", "http://h", "http://h/embeddings")] == ["http://h/v1/embeddings"] * 2 + ["http://h/embeddings"]
    assert [embedding.endpoint(x, "Ollama") for x in ("http://h", "http://h/v1", "http://h/api/embed", "http://h/api/embeddings/")] == ["http://h/api/embeddings"] * 2 + ["http://h/api/embed", "http://h/api/embeddings"]
    with pytest.raises(ValueError):
        embedding.endpoint("http://h", "other")


@pytest.mark.parametrize("size", [4, 1536])
def test_top_k_skips_vectors_without_a_cosine(spark, size):
    r = random.Random(size)
    vectors = [[r.gauss(0, 1) for _ in range(size)] for _ in range(50)]
    rows = list(enumerate(vectors)) + [(90, [0.0] * size), (91, None), (92, [1.0]), (93, [None] * size), (94, [1.0] * (size + 1)), (95, [float("nan")] * size), (96, [float("inf")] + [1.0] * (size - 1))]
    df = spark.createDataFrame(rows, "point_id int, embedding array<double>")
    length = lambda v: sum(x * x for x in v) ** 0.5
    query = vectors[7]
    want = sorted(((-round(sum(x * y for x, y in zip(v, query, strict=True)) / length(v) / length(query), 6), i) for i, v in enumerate(vectors)))
    assert [(-x.raw, x.point_id) for x in search.top_k(df, query, 100).collect()] == want


def test_written_keyword_index_finds_what_a_scan_finds(spark, tmp_path):
    r = random.Random(5)
    words = ["Booking", "bookings", "booked", "service", "the", "the", "the", "Škola", "REQ-3", "happily"]
    docs = [(str(i), f"w{i % 2}", f"s{i % 3}", " ".join(r.choice(words) for _ in range(r.randrange(0, 20)))) for i in range(60)] + [("null", "w0", "s0", None), ("long", "w0", "s0", "the booking " * 20000)]
    kind = "point_id string, workspace_id string, source_id string, content string"
    df = spark.createDataFrame(docs, kind)
    place = str(tmp_path / "index")
    lexical.write_index(df, place)
    cases = [("the service", True, None), ("booking", False, "s0"), ("req-3 skola", True, "s0"), ("absent", True, None), ("- .", False, None)]
    for query, stemmed, source in cases:
        want = lexical.keyword_search(df, query, 20, workspace_id="w0", source_id=source, stemmed=stemmed).collect()
        assert lexical.search_index(spark, place, query, 20, workspace_id="w0", source_id=source, stemmed=stemmed).collect() == want, query
    lexical.write_index(spark.createDataFrame([], kind), str(tmp_path / "none"))
    lexical.write_index(spark.createDataFrame([("a", "w0", "s0", "- .")], kind), str(tmp_path / "wordless"))
    for empty in ("none", "wordless"):
        assert lexical.search_index(spark, str(tmp_path / empty), "booking", 5, workspace_id="w0").count() == 0
    plan = lexical.search_index(spark, place, "booking", 5, workspace_id="w0")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and re.search(r"PushedFilters: \[[^]]*stem", plan)


def test_marked_letters_are_found(spark):
    docs = spark.createDataFrame([("a", "w", "s", "Čas běží"), ("b", "w", "s", "skola"), ("c", "w", "s", "naïve Škola")], "point_id string, workspace_id string, source_id string, content string")
    find = lambda q: {r.point_id for r in lexical.keyword_search(docs, q, 9, workspace_id="w").collect()}
    assert find("cas") == find("čas") == {"a"} and find("škola") == find("skola") == {"b", "c"} and find("NAÏVE") == {"c"}


def test_search_verb(spark):
    rows = [("a", "w", "s", "documentation", "global", "docs/a.md", "booking a table", [1.0, 0.0]), ("b", "w", "s", "code", "web", "apps/web/b.ts", "table of bookings", [0.9, 0.1]), ("c", "w", "s", "lis", "global", "lis/c.md", "booking rules", [1.0, 0.0]), ("d", "v", "s", "code", "web", "d.ts", "booking", [1.0, 0.0])]
    index = spark.createDataFrame(rows, "point_id string, workspace_id string, source_id string, type string, app string, file string, content string, embedding array<double>")
    ask = lambda mode, f=search.Filters("w"), **o: [r.point_id for r in search.search(index, "booking", [1.0, 0.0], f, mode, **o).collect()]
    assert ask("semantic") == ["a", "b"] and ask("semantic", limit=1) == ["a"] and ask("semantic", search.Filters("w", app="WEB")) == ["b"]
    assert set(ask("keyword")) == {"a", "b", "c"} and set(ask("Hybrid")) == {"a", "b", "c"}
    found = search.search(index, "booking", [1.0, 0.0], search.Filters("w"), "keyword")
    assert tuple(found.columns) == ("point_id", "score", *search.HIT, "search_mode")
    for bad in ({"mode": "fuzzy"}, {"mode": "semantic", "limit": 0}, {"mode": "semantic", "f": search.Filters("w", app="nope")}, {"mode": "semantic", "f": search.Filters()}):
        with pytest.raises(ValueError):
            ask(**bad)


def test_python_files_are_cut_by_syntax(spark):
    docs = spark.createDataFrame([("code", "a.py", "import x\n\ndef f():\n    return 1\n\nclass G:\n    y = 2\n"), ("code", "b.py", "def (:\n"), ("code", "c.md", "# H\ntext"), ("code", "d.ts", None)], "type string, file string, content string")
    found = {(r.file, r.chunk_index, r.section, r.start_line) for r in chunking.explode_chunks(docs).collect()}
    assert found == {("a.py", 0, "f", 3), ("a.py", 1, "G", 6), ("b.py", 0, None, 1), ("c.md", 0, "H", 1)}


def test_ranks_without_one_task(spark):
    df = spark.createDataFrame([(x * x,) for x in range(100)], "k bigint").repartition(5)
    assert {(r.k, r["rank"]) for r in search.ranked_by(df, "k", 7).collect()} == {(x * x, 100 - x) for x in range(100)}


def test_streams(spark, tmp_path):
    from tessera.streaming import incremental

    columns = "workspace_id string, source_id string, document_id string, content_hash string, position int"
    spark.createDataFrame([("w", "s", "a", "1", 0), ("w", "s", "a", "2", 1), ("w", "s", "b", "1", 2)], columns).write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("w", "s", "b", "1", 3, "active", 0.0)], "workspace_id string, source_id string, document_id string, content_hash string, revision int, status string, observed_at double")
    seen = []
    stream = spark.readStream.schema(columns).parquet(str(tmp_path / "in"))
    incremental.incremental_index(stream, lambda: known, lambda rows, registry, n: seen.append((rows.collect(), registry.collect())), str(tmp_path / "check")).awaitTermination()
    (changed, registry), *_ = seen
    assert [(r.document_id, r.content_hash) for r in changed] == [("a", "2")]
    assert {(r.document_id, r.revision) for r in registry} == {("a", 1), ("b", 3)}


def test_jobs(spark):
    columns = "job_id bigint, workspace_id string, source_id string, idempotency_key string, mode string, status string, created_at double, updated_at double, lease_expires_at double, error string"
    table = spark.createDataFrame([(1, "w", "s", "a", "full", "running", 0.0, 0.0, 50.0, ""), (2, "w", "s", "b", "full", "running", 0.0, 0.0, 500.0, ""), (3, "w", "s", "c", "full", "failed", 0.0, 0.0, 5.0, "bad")], columns)
    asked = spark.createDataFrame([("w", "s", k, "full", 9) for k in "abcd"], "workspace_id string, source_id string, idempotency_key string, mode string, job_id bigint")
    found = {r.idempotency_key: (r.job_id, r.status, r.outcome, r.error) for r in jobs.submit(table, asked, 100.0).collect()}
    assert found == {"a": (1, "queued", "requeued", ""), "b": (2, "running", "joined", ""), "c": (3, "queued", "requeued", ""), "d": (9, "queued", "inserted", "")}
