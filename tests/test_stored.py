"""Kept indexes: copy-on-write generations, the keyword index, and commits that only one writer can make."""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tessera.operators import cells, indexing, keywords, lexical, maintain, search, segments
from tessera.sources.folder import Conflict, Folder, Versions

POINT = "point_id string, workspace_id string, source_id string, content string"


# folders and versions


def test_of_many_writers_one_commits(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "v"))
    versions = Versions(folder)
    folder.write("other.json", {})

    def attempt(i):
        try:
            return versions.commit(0, {"by": i})
        except Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [i for i, r in enumerate(pool.map(attempt, range(8))) if r == 1]
    assert len(won) == 1 and versions.latest() == (1, {"by": won[0]})
    assert versions.commit(1, {"by": 9}) == 2 and versions.latest() == (2, {"by": 9})
    assert not [n for n in folder.names() if n.startswith(".version")]


# generations


def _documents(spark, texts):
    rows = [(f"w{i % 3}", "s", d, t) for i, (d, t) in enumerate(texts.items())]
    docs = spark.createDataFrame(rows, "workspace_id string, source_id string, document_id string, content string")
    words = docs.select(*maintain.KEY, F.posexplode(F.split("content", " ")).alias("chunk_index", "content")).where("content <> ''")
    return docs.select(*maintain.KEY, F.sha2("content", 256).alias("content_hash")), words.withColumn("point_id", F.concat_ws("/", "document_id", F.col("chunk_index").cast("string")))


def _counting(path):
    """An embedder that notes the texts that it is given, across the workers' processes."""

    def embedder(texts):
        with open(path, "a") as f:
            f.write("".join(t + "\n" for t in texts))
        return [[float(len(t)), 1.0] for t in texts]

    return embedder


@pytest.fixture
def thousand(spark, tmp_path):
    texts = {f"d{i:03}": f"text of {i}" for i in range(1000)}
    store = maintain.Generations(spark, str(tmp_path / "index"))
    observed, words = _documents(spark, texts)
    indexing.run(store, words.withColumn("revision", F.lit(1)), lambda texts: [[float(len(t)), 1.0] for t in texts], "m", 1.0)
    registry = observed.withColumns({"revision": F.lit(1), "status": F.lit("active"), "observed_at": F.lit(1.0)})
    return store, texts, registry


def test_a_change_of_one_document_embeds_it_once_and_rewrites_one_bucket(spark, tmp_path, thousand):
    store, texts, registry = thousand
    first = store.pointer()["generation"]
    observed, words = _documents(spark, texts | {"d007": "quite another text"})
    log = tmp_path / "asked"
    kept = keywords.KeywordIndex(spark, str(tmp_path / "keywords"))
    kept.apply(store.live().select("point_id", "workspace_id", "source_id", "content"), generation=first)
    after = indexing.update(store, registry, observed, words, store.manifest(), 2.0, embedder=_counting(str(log)), keywords=kept)
    assert sorted(log.read_text().split("\n")[:-1]) == ["d:another", "d:quite"]  # the document had the word text before
    second = store.pointer()["generation"]
    before, now = store.folders(first), store.folders(second)
    assert before.keys() == now.keys() and len(before) > 100
    assert sum(before[k] != now[k] for k in before) == 1
    assert {(r.content, r.revision) for r in store.live().where("document_id = 'd007'").collect()} == {("quite", 2), ("another", 2), ("text", 2)}
    assert store.live().count() == 3000 and after.where("revision = 2").count() == 1
    assert kept.generation == second and {r.point_id for r in kept.search("quite another", 5, workspace_id="w1").collect()} == set()
    assert [r.point_id for r in kept.search("another", 5, workspace_id="w1").collect()] == ["d007/1"]
    assert store.rollback() == first and {r.content for r in store.live().where("document_id = 'd007'").collect()} == {"text", "of", "7"}
    assert store.live(workspaces=["w1"]).inputFiles() and all("_w=7731" in f for f in store.live(workspaces=["w1"]).inputFiles())


def test_emptied_and_deleted_documents_lose_their_points(spark, thousand):
    store, texts, registry = thousand
    observed, words = _documents(spark, {**{k: t for k, t in texts.items() if k != "d999"}, "d000": ""})
    indexing.update(store, registry, observed, words, store.manifest(), 2.0, embedder=lambda texts: [[0.0, 0.0] for _ in texts])
    assert store.live().count() == 3000 - 6 and not store.live().where("document_id IN ('d000', 'd999')").count()


def test_nothing_changed_nothing_written(spark, thousand):
    store, texts, registry = thousand
    observed, words = _documents(spark, texts)
    first = store.pointer()
    after = indexing.update(store, registry, observed, words, store.manifest(), 2.0, embedder=lambda texts: 1 / 0)
    assert store.pointer() == first and after.where("observed_at = 2").count() == 1000


def test_a_failed_update_leaves_everything_and_vacuum_clears_up(spark, thousand):
    store, texts, registry = thousand
    observed, words = _documents(spark, texts | {"d007": "x"})
    pointer = store.pointer()
    with pytest.raises(Exception, match="no service"):
        indexing.update(store, registry, observed, words, store.manifest(), 2.0, embedder=lambda texts: (_ for _ in ()).throw(OSError("no service")))
    assert store.pointer() == pointer and store.live().count() == 3000
    assert not [n for n in store.files.names() if n.startswith("run-")]
    for text in ("y", "z", "last"):
        observed, words = _documents(spark, texts | {"d007": text})
        after = indexing.update(store, registry, observed, words, store.manifest(), 3.0, embedder=lambda texts: [[0.0, 0.0] for _ in texts])
        registry = spark.createDataFrame(after.collect(), after.schema)
    assert store.vacuum() and store.live().count() == 2998 and store.vacuum() == []
    store.rollback()
    assert {r.content for r in store.live().where("document_id = 'd007'").collect()} == {"z"}


# keyword index

WORDS = ["Booking", "bookings", "booked", "service", "the", "the", "the", "Škola", "REQ-3", "happily", "x1"]
QUERIES = [("the service", True, None), ("booking", False, "s0"), ("req-3 skola", True, "s0"), ("absent", True, None), ("- .", False, None), ("the booking", True, None)]


def _same(spark, kept, points):
    table = spark.createDataFrame([(k, *p) for k, p in points.items()], POINT)
    state = kept.state()
    assert state["points"] == len(points)
    for text, stemmed, source in QUERIES:
        want = lexical.keyword_search(table, text, 20, workspace_id="w0", source_id=source, stemmed=stemmed).collect()
        assert kept.search(text, 20, workspace_id="w0", source_id=source, stemmed=stemmed).collect() == want, text


def test_upserts_deletes_and_merges_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SEGMENTS", 3)
    monkeypatch.setattr(keywords, "BUCKETS", ((0, 1), (20, 4), (60, 16)))
    r = random.Random(5)
    text = lambda: " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 20)))
    kept, points = keywords.KeywordIndex(spark, str(tmp_path / "k")), {}
    for step in range(7):
        new = {str(r.randrange(90)): (f"w{r.randrange(2)}", f"s{r.randrange(2)}", r.choice([text(), text(), text(), None])) for _ in range(80 if step == 0 else 12)}
        gone = [str(r.randrange(90)) for _ in range(6)] if step else []
        kept.apply(spark.createDataFrame([(k, *p) for k, p in new.items()], POINT), spark.createDataFrame([(k,) for k in gone], "point_id string"))
        points = {k: p for k, p in points.items() if k not in gone} | new
        _same(spark, kept, points)
    state = kept.state()
    assert 1 < len(state["segments"]) <= 4 and state["tombs"]
    kept.merge(whole=True)
    assert len(kept.state()["segments"]) == 1 and kept.state()["tombs"] == []
    _same(spark, kept, points)
    kept.vacuum()
    kept.vacuum()
    _same(spark, kept, points)
    kept.apply(deletes=spark.createDataFrame([(k,) for k in points], "point_id string"))
    assert kept.state()["points"] == 0 and kept.search("the", 5, workspace_id="w0").count() == 0


def test_two_writers_of_a_keyword_index(spark, tmp_path, monkeypatch):
    kept = keywords.KeywordIndex(spark, str(tmp_path / "k"))
    kept.apply(spark.createDataFrame([("a", "w0", "s0", "the booking"), ("b", "w0", "s0", "the service")], POINT))
    other, plain = keywords.KeywordIndex(spark, str(tmp_path / "k")), kept.versions.commit

    def late(after, state):
        monkeypatch.setattr(kept.versions, "commit", plain)
        other.apply(spark.createDataFrame([("a", "w0", "s0", "the the the")], POINT))  # commits between the look and the commit
        return plain(after, state)

    monkeypatch.setattr(kept.versions, "commit", late)
    kept.apply(spark.createDataFrame([("a", "w0", "s0", "service")], POINT))
    _same(spark, kept, {"a": ("w0", "s0", "service"), "b": ("w0", "s0", "the service")})


def test_a_query_reads_the_folders_of_its_terms(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("point_id"), F.lit("w0").alias("workspace_id"), F.lit("s0").alias("source_id"), F.concat_ws(" ", F.lit("the"), *(F.concat(F.lit(f"term{k}x"), (F.col("id") * 7 % (50 + k)).cast("string")) for k in range(20))).alias("content"))
    kept = keywords.KeywordIndex(spark, str(tmp_path / "k"))
    kept.apply(rows)
    read, total = kept.cost("term3x7 term9x11")
    assert 0 < read < total / 3
    found = kept.search("term3x7 term9x11", 5, workspace_id="w0")
    stems = {f.rsplit("/", 2)[1] for f in found.inputFiles()}
    assert len(stems) <= 2
    want = lexical.keyword_search(rows, "term3x7 term9x11", 5, workspace_id="w0").collect()
    assert found.collect() == want and kept.cost("- .") == (0, total)


def test_search_reads_the_kept_index(spark, tmp_path):
    rows = [("a", "w", "s", "documentation", "global", "docs/a.md", "booking a table", [1.0, 0.0]), ("b", "w", "s", "code", "web", "apps/web/b.ts", "table of bookings", [0.9, 0.1]), ("c", "w", "s", "lis", "global", "lis/c.md", "booking rules", [1.0, 0.0])]
    index = spark.createDataFrame(rows, "point_id string, workspace_id string, source_id string, type string, app string, file string, content string, embedding array<double>")
    kept = keywords.KeywordIndex(spark, str(tmp_path / "k"))
    kept.apply(index.select("point_id", "workspace_id", "source_id", "content"))
    for mode in ("keyword", "hybrid"):
        ask = lambda k: search.search(index, "booking", [1.0, 0.0], search.Filters("w"), mode, keywords=k).collect()  # noqa: B023, E731
        assert ask(kept) == ask(None) and len(ask(kept)) == 3
    kept.apply(deletes=index.where("point_id = 'a'").select("point_id"))
    assert {r.point_id for r in search.search(index, "booking", [1.0, 0.0], search.Filters("w"), "keyword", keywords=kept).collect()} == {"b", "c"}
    with pytest.raises(ValueError):
        search.hybrid(index, "booking", [1.0, 0.0], search.Filters("w"), strict_filters=True, keywords=kept)


# vector index


def _clusters(n, size, r):
    centres = [[r.gauss(0, 1) for _ in range(size)] for _ in range(12)]
    return [[x + r.gauss(0, 0.35) for x in centres[r.randrange(12)]] for _ in range(n)]


def _brute(vectors, queries, k):
    length = lambda v: math.sqrt(sum(x * x for x in v))
    out = set()
    for q, a in queries.items():
        best = sorted((-round(sum(x * y for x, y in zip(a, v, strict=True)) / length(a) / length(v), 6), i) for i, v in vectors.items())[:k]
        out |= {(q, n, i, -raw) for n, (raw, i) in enumerate(best, 1)}
    return out


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    r = random.Random(2)
    vectors = dict(enumerate(_clusters(1200, 8, r)))
    vectors |= {2000 + i: [3.0, 1.0] + [0.0] * 6 for i in range(300)}  # a crowd of equal vectors
    odd = {5000: [0.0] * 8, 5001: None, 5002: [1.0], 5003: [None] * 8, 5004: [float("nan")] * 8, 5005: [math.inf] + [0.0] * 7}
    table = spark.createDataFrame([(k, f"w{k % 2}", v) for k, v in (vectors | odd).items()], "point_id bigint, workspace_id string, embedding array<double>")
    kept = cells.VectorIndex(spark, str(tmp_path_factory.mktemp("v") / "index"))
    assert kept.fit(table, 16) == 16
    kept.apply(table)
    return kept, vectors, table


def test_all_cells_give_what_brute_force_gives(spark, indexed, monkeypatch):
    kept, vectors, table = indexed
    assert kept.state()["points"] == len(vectors)
    asked = {i: v for i, v in vectors.items() if i % 50 == 0}
    queries = spark.createDataFrame([(i, v) for i, v in asked.items()] + [(-1, [0.0] * 8), (-2, None)], "query_id bigint, query_vector array<double>")
    want = _brute(vectors, asked, 7)
    found = lambda **how: {tuple(r) for r in kept.search_all(queries, 7, **how).collect()}
    assert found(exact=True) == want
    monkeypatch.setattr(cells, "BLOCK", 90)
    assert found(exact=True) == want  # cells in many blocks
    one = kept.search(vectors[3], 7, exact=True)
    assert {(1, n, r.point_id, r.raw) for n, r in enumerate(one.collect(), 1)} == _brute(vectors, {1: vectors[3]}, 7)
    few = search.top_k(table.where("workspace_id = 'w1'"), vectors[3], 5, threshold=0.5)
    assert kept.search(vectors[3], 5, workspace_id="w1", threshold=0.5, exact=True).collect() == few.select("point_id", "raw").collect()


def test_few_cells_reach_the_recall(spark, indexed):
    kept, vectors, _ = indexed
    probes, recall = kept.tune(0.95)
    assert recall >= 0.95 and probes < 16
    read, total = kept.cost(vectors[3])
    assert read < 0.75 * total
    asked = {i: v for i, v in vectors.items() if i % 50 == 0}
    queries = spark.createDataFrame(list(asked.items()), "query_id bigint, query_vector array<double>")
    found = {(r.query_id, r.point_id) for r in kept.search_all(queries, 10).collect()}
    want = {(q, i) for q, _, i, _ in _brute(vectors, asked, 10)}
    assert len(found & want) >= 0.9 * len(want)
    assert {f.rsplit("/", 2)[1] for f in kept.search(vectors[3], 5).inputFiles()} == {f"c={c}" for c in kept._probed(vectors[3], None)}
    assert kept.search([0.0] * 8, 5).count() == 0 and kept.search([1.0], 5).count() == 0


def test_vectors_change_and_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SEGMENTS", 2)
    r = random.Random(4)
    kept, vectors = cells.VectorIndex(spark, str(tmp_path / "v")), dict(enumerate(_clusters(200, 4, r)))
    kind = "point_id int, workspace_id string, embedding array<double>"
    table = lambda some: spark.createDataFrame([(i, "w", v) for i, v in some.items()], kind)
    with pytest.raises(ValueError):
        kept.apply(table(vectors))
    kept.fit(table(vectors), 6)
    kept.apply(table(vectors))
    for step in range(4):
        new = {r.randrange(260): v for v in _clusters(15, 4, r)} | {step: [0.0] * 4}
        gone = [r.randrange(200) for _ in range(5)]
        kept.apply(table(new), spark.createDataFrame([(g,) for g in gone], "point_id int"))
        vectors = {i: v for i, v in ({i: v for i, v in vectors.items() if i not in gone} | new).items() if any(v)}
        asked = {7: [1.0, 0.5, -0.3, 0.2]}
        assert {(7, n, x.point_id, x.raw) for n, x in enumerate(kept.search(asked[7], 9, exact=True).collect(), 1)} == _brute(vectors, asked, 9)
        assert kept.state()["points"] == len(vectors)
    assert len(kept.state()["segments"]) <= 3
    with pytest.raises(ValueError):
        kept.fit(table(vectors))
