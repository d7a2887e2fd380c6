"""The driver's tables as a corpus: chunks with a workspace, type, file, requirement ids and a vector, by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import hash_embedding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with workspace_id, source_id, type, app, file, language, content, requirement_ids."""
    n = F.col("doc_id") % 5
    number = F.col("doc_id").cast("string")
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    source = F.col("source")
    content = text(F.col("text"), " REQ-", (F.col("doc_id") % 17).cast("string"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text("ws", (F.col("doc_id") % 4).cast("string")).alias("workspace_id"),
        source.alias("source_id"),
        F.when(n == 2, "code").when(n == 3, "test").when(n == 4, "lis").otherwise("documentation").alias("type"),
        F.when(n.isin(2, 3), "web").otherwise("global").alias("app"),
        F.when(n == 2, text("apps/web/", source, "/", number, ".ts"))
        .when(n == 3, text("apps/web/tests/", number, ".test.ts"))
        .when(n == 4, text("lis/", source, "/", number, ".md"))
        .otherwise(text("docs/", source, "/", number, ".md"))
        .alias("file"),
        F.col("lang").alias("language"),
        content.alias("content"),
        T.requirement_ids(content).alias("requirement_ids"),
    )


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunks`` with the vector ``doc_id % count(embeddings)``."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.count()
    rows = chunks(spark, sf_dir).withColumn("vec_id", F.col("doc_id") % n)
    return rows.join(vectors, "vec_id").drop("vec_id")


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunks`` with the vector of the deterministic embedder, for queries whose probes are texts."""
    return chunks(spark, sf_dir).withColumn("embedding", hash_embedding(F.col("content"), "d:"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


#: The same rules for DuckDB.
CHUNKS = """chunks AS (
  SELECT doc_id, 'ws' || (doc_id % 4) AS workspace_id, source AS source_id,
    CASE doc_id % 5 WHEN 2 THEN 'code' WHEN 3 THEN 'test' WHEN 4 THEN 'lis' ELSE 'documentation' END AS type,
    CASE WHEN doc_id % 5 IN (2, 3) THEN 'web' ELSE 'global' END AS app,
    CASE doc_id % 5 WHEN 2 THEN 'apps/web/' || source || '/' || doc_id || '.ts' WHEN 3 THEN 'apps/web/tests/' || doc_id || '.test.ts'
      WHEN 4 THEN 'lis/' || source || '/' || doc_id || '.md' ELSE 'docs/' || source || '/' || doc_id || '.md' END AS file,
    lang AS language, text || ' REQ-' || (doc_id % 17) AS content
  FROM documents)"""
INDEX = f"""{CHUNKS}, idx AS (
  SELECT c.*, round(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS raw
  FROM chunks c JOIN embeddings e ON e.vec_id = c.doc_id % (SELECT count(*) FROM embeddings))"""


def hash_sql(text: str) -> str:
    """The deterministic embedder in DuckDB, of unit length up to a factor."""
    return f"list_transform(range(32), lambda i: ('0x' || substr(sha256({text}), 2 * i + 1, 2))::INTEGER / 255.0::DOUBLE)"
