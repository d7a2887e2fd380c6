"""From files of all workspaces to the rows of the index: text, frontmatter, chunks with their payload, keys and ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PAYLOAD_SCHEMA_VERSION, Config, enabled_buckets
from ..functions import identity as I
from ..functions import paths as P
from ..functions import text as T
from ..sources import files as sources
from ..sources import frontmatter, tree
from .chunking import explode_chunks

#: Fields of governance documents.
GOVERNANCE = ("document_id", "doc_type", "process_area", "domain", "status", "title")


def build_chunks(files: DataFrame, config: Config | None = None) -> DataFrame:
    """The points of ``files`` (workspace_id, source_id, bucket, identity, text) without vectors, a row per chunk.

    Governance documents lose their frontmatter, whose fields every chunk of theirs carries; lines are those of what was cut.  Files of a bucket that isn't enabled are left out.
    Requirement ids are looked for in section and content.  A file without text beside white space has no chunks.  A point's id comes
    from workspace, source, document, chunk key and number; ``document_id`` is the file's identity, ``governance`` has the document's own.
    """
    config = config or Config()
    known = P.classify(F.col("identity"), F.col("bucket"), config)
    rows = files.select("workspace_id", F.coalesce("source_id", "bucket", F.lit("default")).alias("source_id"), "bucket", "identity", "text", known.alias("known")).select("*", "known.*")
    rows = rows.where(F.col("bucket").isNull() | F.col("bucket").isin(*enabled_buckets(config))).where(T.strip(F.coalesce("text", F.lit(""))) != "")
    # the parser runs on governance documents alone: of other rows it gets a null
    front = frontmatter.frontmatter(F.when(F.col("type") == "lis", F.col("text")))
    rows = rows.withColumn("front", front)
    rows = rows.withColumn("content", F.when(F.col("type") == "lis", F.col("front.body")).otherwise(F.col("text"))).withColumn("governance", F.when(F.col("type") == "lis", frontmatter.governance_fields(F.col("front.meta"))))
    rows = rows.withColumn("content_hash", I.content_hash(F.col("text"))).drop("front", "text", "known", "bucket")
    found = explode_chunks(rows, size=config.chunk_size, overlap=config.chunk_overlap)
    document = I.document_id(F.col("identity"))
    key = F.coalesce("chunk_key", I.chunk_key(F.col("symbol"), F.col("section"), F.col("chunk_index")))
    source = T.requirement_source(F.col("section"), F.col("content"))
    return found.select(
        I.point_id(F.col("workspace_id"), F.col("source_id"), document, key, F.col("chunk_index")).alias("point_id"),
        "workspace_id", "source_id", document.alias("document_id"), "type", "app", "file", "language", "section", "chunk_index", "content",
        T.requirement_ids(source).alias("requirement_ids"), "start_line", "end_line", "symbol", "symbol_kind", key.alias("chunk_key"), "imports", "governance",
        *(F.col(f"governance.{c}").alias(c) for c in GOVERNANCE[1:]), "content_hash", F.lit(PAYLOAD_SCHEMA_VERSION).alias("schema_version"),
    )


def workspace_texts(spark: SparkSession, workspaces: Sequence[dict], *, policy: P.PathPolicy | None = None) -> DataFrame:
    """workspace_id, source_id, bucket, identity, text of all readable files of the workspaces: one scan, each file read once."""
    files = tree.workspace_files(spark, workspaces, policy=policy).where("deny_reason IS NULL")
    kept = ["workspace_id", "source_id", "bucket", "identity"]
    once = tree.read_files(files.select("path").distinct(), policy=policy).where("content IS NOT NULL").drop("read_error")
    texts = sources.extract(once).select("path", "text")
    return files.select(*kept, "path").join(texts, "path").select(*kept, "text")


def observed(files: DataFrame) -> DataFrame:
    """The inventory of ``files`` (workspace_id, source_id, identity, text): KEY and the hash of the text."""
    document: Column = I.document_id(F.col("identity"))
    return files.select("workspace_id", "source_id", document.alias("document_id"), I.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
