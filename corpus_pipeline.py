"""A training corpus from ``documents``, in stages that each read what the one before wrote.

Language ID, Jaccard join of shingles, removal of long repeated strings, mixing of sources, byte-level BPE.
Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, mixing, ngram_join, suffixdedup
from tessera.llm.common import WORD_PATTERN, cut

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The name of a row's hash while a stage runs; no column of documents.
KEY = "_pipeline_row_key"

#: DuckDB can't express the minimum hashes, the suffix index nor the BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def _only(docs: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is among ``keys`` (row_key)."""
    return docs.withColumn(KEY, key).join(keys.withColumnRenamed("row_key", KEY).hint("shuffle_hash"), KEY, "left_semi").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is rejected go: no letters, none of the known languages, or too uncertain."""
    key = F.xxhash64("doc_id", "text", "lang", "source")
    found = langid.identify(docs.withColumn(KEY, key), key=KEY)
    return _only(docs, cut(found.where("accepted").select(F.col(KEY).alias("row_key")).distinct()), key)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies stays: that with the least id."""
    found = cut(ngram_join.join(docs).select("row_key", "class_key"))
    kept = _only(docs, found.where("row_key = class_key").select("row_key").distinct(), F.xxhash64("doc_id", "text"))
    repeated = found.groupBy("row_key").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes and passages of over 50 words that occur twice are cut out, every copy, as op3 does.

    A text that was repeated as a whole ends without a word, and its row goes; a row whose text had no word before
    stays, and a null text stays null. n_chars is that of the text that is left. Repeated rows match each other; texts
    of any length are read whole; an empty table gives no rows.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    kept, worded = f"{KEY}_kept", f"{KEY}_worded"
    named = docs.withColumn(worded, F.regexp_like("text", F.lit(WORD_PATTERN)))
    found = suffixdedup.deduplicate(named, keep=[*others, worded], texts=kept, passages=suffixdedup.PASSAGES, cut_passages=True)
    found = found.where(F.coalesce(~F.col(worded), F.lit(True)) | F.regexp_like(kept, F.lit(WORD_PATTERN)))
    text = F.when(F.col(worded).isNotNull(), F.col(kept)).alias("text")
    own = {"text": text, "n_chars": F.length(text).cast("bigint").alias("n_chars")}
    return found.select(*(own.get(c, F.col(c)) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it."""
    key = F.xxhash64("doc_id", "text", "source")
    taken = cut(mixing.mix(docs).groupBy("row_key").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows")))
    once = docs if taken.where("rows > 1").isEmpty() else docs.dropDuplicates(["doc_id", "text", "source"])
    chosen = taken.where("copies > 0").drop("rows")
    chosen = chosen.toDF(KEY, f"{KEY}_copies")
    joined = once.withColumn(KEY, key).join(chosen.hint("shuffle_hash"), KEY)
    return joined.withColumn(KEY, F.explode(F.array_repeat(F.lit(0), F.col(f"{KEY}_copies")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and what they decode to."""
    return bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mix_sources", mix_sources),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
