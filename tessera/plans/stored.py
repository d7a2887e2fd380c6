"""Queries of indexes that are kept in a folder, changed and then read; what they find is compared with plain SQL over the tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import building, health, indexing, maintain, search
from ..operators.cells import VectorIndex
from ..operators.keywords import KeywordIndex
from ..operators.maintain import Generations, Manifest
from ..sources.embedding import embed
from ..sources.folder import Folder, scratch
from .corpus import CHUNKS, chunks, index, query_vector, table
from .more import DIFF, _observed, _registry
from .queries import WORKSPACE, _bm25, _points, _rerank, query


def _kept(spark: SparkSession, sf: str, name: str, build: Callable[[str], None]) -> str:
    """The folder of an index that ``build`` fills once for an application and a table; later queries find it there."""
    folder = Folder(spark, scratch(spark, f"kept-{name}-{zlib.crc32(sf.encode()):08x}"))
    if folder.read("whole.json") is None:
        folder.delete("data")
        build(folder.at("data"))
        folder.write("whole.json", {"of": sf})
    return folder.at("data")


# Keyword index: points that were changed and deleted after the first segment.

CHANGED, DELETED = "doc_id % 7 = 0", "doc_id % 11 = 0"


def _keywords(spark: SparkSession, sf: str) -> KeywordIndex:
    def build(path: str) -> None:
        points, kept = _points(spark, sf), KeywordIndex(spark, path)
        kept.apply(points.withColumn("content", F.expr(f"CASE WHEN {CHANGED} THEN 'an earlier text, the anly' ELSE content END")))
        kept.apply(points.where(CHANGED), points.where(DELETED))

    return KeywordIndex(spark, _kept(spark, sf, "keywords", build))


def _without_deleted(sql: str) -> str:
    return sql.replace("FROM documents)", f"FROM documents WHERE NOT ({DELETED}) OR {CHANGED})")


@query(_without_deleted(_bm25([["the"], ["anly"]], 20)))
def keyword_indexed(spark, sf):
    found = _keywords(spark, sf).search("the anly", 20, workspace_id="ws1", stemmed=False)
    return found.select("point_id", F.round("bm25", 6).alias("bm25"), F.round("score", 4).alias("score"))


@query(f"""WITH near AS ({_without_deleted(_rerank('req-3 the tion', 72, 24, 'doc_id::VARCHAR', 'doc_id, raw'))}),
kw AS ({_without_deleted(_bm25([['req', '3'], ['the'], ['tion']], 24, 'ws0'))}),
a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, raw DESC, doc_id::VARCHAR) AS rank, 0 AS list_no FROM near UNION ALL SELECT point_id::BIGINT, row_number() OVER (ORDER BY bm25, point_id), 1 FROM kw),
f AS (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf, min(CASE WHEN list_no = 0 THEN rank ELSE rank + 1000 END) AS first FROM a GROUP BY doc_id)
SELECT doc_id, 'hybrid' AS search_mode, round(rrf, 9) AS score FROM f ORDER BY rrf DESC, first LIMIT 8""")
def search_hybrid_mode(spark, sf):
    """The verb ``search`` in its hybrid mode, whose keyword arm reads the kept index."""
    live = f"NOT ({DELETED}) OR {CHANGED}"
    rows = index(spark, sf).where(live).withColumn("point_id", F.col("doc_id").cast("string"))
    found = search.search(rows, "req-3 the tion", query_vector(spark, sf), WORKSPACE, "hybrid", limit=8, stemmed=False, keywords=_keywords(spark, sf), texts=_points(spark, sf).where(live))
    return found.select(F.col("point_id").cast("bigint").alias("doc_id"), "search_mode", F.round("score", 9).alias("score"))


# An incremental update of a generation that rewrites the buckets of changed documents alone.


@query(f"""WITH {DIFF} SELECT workspace_id || '/' || document_id || '#' || k AS point_id, (CASE WHEN kind = 'new' THEN 1 WHEN kind = 'changed' AND old_status <> 'writing' THEN old_revision + 1 ELSE old_revision END)::INTEGER AS revision, length(document_id)::DOUBLE AS size
FROM diff, (VALUES (0), (1), (2)) v(k) WHERE CASE WHEN kind IN ('new', 'changed') THEN k <> 1 ELSE kind = 'unchanged' AND k <> 2 END""")
def apply_inventory(spark, sf):
    registry, observed = _registry(spark, sf), _observed(spark, sf)
    some = lambda *k: F.explode(F.array(*map(F.lit, k))).alias("chunk_index")
    point = F.concat_ws("/", "workspace_id", F.concat("document_id", F.lit("#"), F.col("chunk_index").cast("string")))
    chunked = lambda rows, *k: rows.select(*maintain.KEY, *(c for c in ("revision",) if c in rows.columns), F.col("document_id").alias("content"), some(*k)).withColumn("point_id", point)
    embedder = lambda texts: [[float(len(t) - 2)] for t in texts]  # noqa: E731  the prefix of documents has two characters
    store, manifest = Generations(spark, scratch(spark, f"apply-{zlib.crc32(sf.encode()):08x}")), Manifest("length", 1, "c")
    store.activate(store.stage(embed(chunked(registry.where("status <> 'deleted'"), 0, 1), embedder), manifest))
    indexing.update(store, registry, observed, chunked(observed, 0, 2), manifest, 7.0, embedder=embedder)
    return store.live().select("point_id", "revision", F.col("embedding")[0].cast("double").alias("size"))


# Vector index: every row whose id is divisible by 50 asks for its nearest among all rows.

KNN = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, i.vec_id AS point_id, round(list_cosine_similarity(q.v, i.v), 6) AS raw FROM e q JOIN e i ON q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, point_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, point_id, raw FROM r WHERE rank <= 10"""


def _vectors(spark: SparkSession, sf: str) -> VectorIndex:
    def build(path: str) -> None:
        points, kept = table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("label").cast("string").alias("workspace_id"), "embedding"), VectorIndex(spark, path)
        kept.fit(points)
        kept.apply(points.withColumn("embedding", F.expr("CASE WHEN point_id % 7 = 0 THEN reverse(embedding) ELSE embedding END")))
        kept.apply(points.where("point_id % 7 = 0"))
        kept.tune()

    return VectorIndex(spark, _kept(spark, sf, "vectors", build))


def _knn(spark: SparkSession, sf: str, **how) -> DataFrame:
    queries = table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return _vectors(spark, sf).search_all(queries, 10, **how)


@query(KNN)
def knn_cells_exact(spark, sf):
    return _knn(spark, sf, exact=True)


@query()
def knn_cells(spark, sf):
    """The cells that ``tune`` found enough for a recall of 0.95; held against the exact query in a test."""
    return _knn(spark, sf)


# From texts to the rows of an index.


@query()
def build_chunks(spark, sf):
    """All documents as files of four workspaces, those of the type lis with frontmatter; held against a plain version in a test."""
    rows = chunks(spark, sf).withColumn("bucket", F.expr("CASE type WHEN 'documentation' THEN 'knowledge' WHEN 'lis' THEN 'lis' ELSE 'code' END"))
    front = F.concat(F.lit("---\nid: LIS-"), F.col("doc_id").cast("string"), F.lit("\ntags: [a, b]\nstatus: draft\n---\n"))
    text = F.when(F.col("type") == "lis", F.concat(front, F.col("content"))).otherwise(F.col("content"))
    return building.build_chunks(rows.select("workspace_id", "source_id", "bucket", F.col("file").alias("identity"), text.alias("text"))).drop("imports", "governance")


@query(f"""WITH {CHUNKS} SELECT workspace_id, source_id, type, count(*) AS points, count(DISTINCT workspace_id || '/' || source_id || '/' || file) AS documents
FROM chunks GROUP BY ROLLUP (workspace_id, source_id, type)""")
def points_by_level(spark, sf):
    return health.points_by(chunks(spark, sf).withColumn("document_id", F.col("file")))
