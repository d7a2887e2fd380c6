"""Filters, vector top-k, re-ranking, rank fusion and the search verbs."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..config import DISABLED_SCOPES, OVERFETCH, SCOPES, TOP_K, Config, check_app, check_limit, check_lis
from ..functions import paths as P
from ..functions import text as T
from ..functions.vectors import cosine_to, matrix, unit
from . import lexical
from .keywords import KeywordIndex

#: The columns of a hit.
HIT = ("workspace_id", "source_id", "document_id", "file", "type", "app", "language", "section", "start_line", "end_line", "content", "requirement_ids", "schema_version", "revision")
DIGITS = 6
#: Vectors of a block, and queries that a task compares with one at a time.
BLOCK, SLICE = 8192, 256
#: Queries of a batch without groups; types that a search asks for where none are named; modes.
QUERIES = 10_000
DEFAULT_TYPES = ("documentation", "code", "test")
MODES = ("semantic", "keyword", "hybrid")


@dataclass(frozen=True)
class Filters:
    """A conjunction over the stored fields; a workspace is mandatory."""

    workspace_id: str | None = None
    scope: str = "workspace"
    related_ids: tuple[str, ...] = ()
    source_id: str | None = None
    document_id: str | None = None
    language: str | None = None
    types: tuple[str, ...] = ()
    app: str | None = None
    requirement_id: str | None = None
    doc_type: str | None = None
    process_area: str | None = None
    domain: str | None = None
    status: str | None = None

    def check(self) -> None:
        if not (self.workspace_id or "").strip():
            raise ValueError("a search needs a workspace")
        if self.scope not in SCOPES:
            raise ValueError(f"unknown scope {self.scope!r}")
        if self.scope in DISABLED_SCOPES:
            raise ValueError(f"scope {self.scope!r} is disabled")
        if self.scope == "source" and not self.source_id:
            raise ValueError("scope 'source' needs a source")
        check_lis(self.doc_type, self.process_area, self.status)

    def condition(self) -> Column:
        self.check()
        if self.scope == "related":
            ids = dict.fromkeys([self.workspace_id, *self.related_ids])
            out = F.col("workspace_id").isin(*ids)
        else:
            out = F.col("workspace_id") == self.workspace_id
        if self.types:
            out = out & F.col("type").isin(*self.types)
        if self.requirement_id:
            out = out & F.array_contains("requirement_ids", self.requirement_id)
        for name in ("source_id", "document_id", "language", "app", "doc_type", "process_area", "domain", "status"):
            if getattr(self, name):
                out = out & (F.col(name) == getattr(self, name))
        return out


def under_prefix(prefix: str) -> Column:
    return F.startswith(F.replace(F.col("file"), F.lit("\\"), F.lit("/")), F.lit(prefix))


def top_k(index: DataFrame, query: list[float], k: int, *, threshold: float | None = None, key: str = "point_id") -> DataFrame:
    """The k nearest rows of ``index`` (already filtered), with ``raw``, the cosine; ties by key. One pass, a heap per task.

    Rows whose vector has no cosine (null, zero, of another length) are no hits.
    """
    scored = index.withColumn("raw", F.round(cosine_to(query, F.col("embedding")), DIGITS))
    scored = scored.where("raw IS NOT NULL" if threshold is None else F.col("raw") >= threshold)
    return scored.orderBy(F.col("raw").desc(), key).limit(k)


def rerank(hits: DataFrame, query: str, k: int, *, vector_weight: float, lexical_weight: float, key: str = "point_id") -> DataFrame:
    score = T.blend(F.col("raw"), T.overlap(query, F.col("content"), F.col("file")), vector_weight, lexical_weight)
    return hits.withColumn("score", F.round(score, DIGITS)).orderBy(F.col("score").desc(), F.col("raw").desc(), key).limit(k)


def semantic(index: DataFrame, query: str, vector: list[float], filters: Filters, config: Config | None = None, *, limit: int | None = None, threshold: float | None = None, path_prefix: str | None = None, pushdown_prefix: bool = False, key: str = "point_id", texts: DataFrame | None = None) -> DataFrame:
    """Filtered top candidates above the threshold, re-ranked by weighted overlap with the query's tokens.

    The prefix is applied to the candidates, as fewer than ``limit`` rows may then remain; with
    ``pushdown_prefix`` it is applied to the scan.

    ``texts`` are the rows of ``index`` without what had to be joined to them: the candidates are found by key and vector, and their
    texts come from there, so a join in ``index`` shuffles no texts. Rows of one key have one vector.
    """
    config = config or Config()
    s = config.search
    limit = limit or s.top_k
    prefix = P.clean_prefix(path_prefix)
    fetch = limit * OVERFETCH if prefix or s.lexical_weight > 0 else limit
    among = filters.condition()
    if prefix and pushdown_prefix:
        among = among & under_prefix(prefix)
    hits = top_k(index.where(among), vector, fetch, threshold=s.score_threshold if threshold is None else threshold, key=key)
    if texts is not None:
        hits = texts.where(among).join(F.broadcast(hits.select(key, "raw").distinct()), key).orderBy(F.col("raw").desc(), key).limit(fetch)
    if prefix and not pushdown_prefix:
        hits = hits.where(under_prefix(prefix))
    return rerank(hits, query, limit, vector_weight=s.vector_weight, lexical_weight=s.lexical_weight, key=key)


def search_knowledge(index: DataFrame, query: str, vector: list[float], filters: Filters, config: Config | None = None, **options) -> DataFrame:
    return semantic(index, query, vector, replace(filters, types=("documentation",)), config, **options)


def search_code(index: DataFrame, query: str, vector: list[float], filters: Filters, config: Config | None = None, **options) -> DataFrame:
    return semantic(index, query, vector, replace(filters, types=("code", "test")), config, **options)


def search_lis(index: DataFrame, query: str, vector: list[float], filters: Filters, config: Config | None = None, **options) -> DataFrame:
    return semantic(index, query, vector, replace(filters, types=("lis",)), config, **options)


def nearest_per_group(queries: DataFrame, index: DataFrame, k: int, *, group: str | None = None, threshold: float | None = None) -> DataFrame:
    """The k nearest rows of ``index`` (key, embedding) for every query (query_id, query_vector), as rank, raw.

    With ``group``, rows are compared only inside equal values of it; without one, at most ``QUERIES`` queries are taken.
    Vectors meet in blocks by matrix products, so a group of any size is compared by many tasks.
    """
    if not group and queries.limit(QUERIES + 1).count() > QUERIES:
        raise ValueError(f"more than {QUERIES} queries need a group")
    of = F.col("group") if group else F.lit(0)
    sides = (queries.select("query_id", unit(F.col("query_vector")).alias("vector"), of.alias("group")), index.select("key", unit(F.col("embedding")).alias("vector"), of.alias("group")))
    asked, rows = (x.where("vector IS NOT NULL").withColumn("size", F.size("vector")) for x in sides)
    met = nearest_in_blocks(asked, rows, k, ["group", "size"])
    if threshold is not None:
        met = met.where(F.col("raw") >= threshold)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("raw").desc(), "key"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "key", "raw")


def best(raw: np.ndarray, k: int) -> np.ndarray:
    """Which are the k greatest of each row: what is above the k-th, and of those that tie with it the first ones."""
    if raw.shape[1] <= k:
        return np.ones(raw.shape, bool)
    least = -np.partition(-raw, k - 1, axis=1)[:, k - 1 : k]
    above, tied = raw > least, raw == least
    return above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)))


def nearest_in_blocks(queries: DataFrame, rows: DataFrame, k: int, on: list[str], block: int = BLOCK) -> DataFrame:
    """(query_id, key, raw): of queries (query_id, vector, *on) and rows (key, vector, *on) with equal ``on``, all of unit vectors of one
    length, at most k rows for each query and block of rows, the k nearest among them.

    Both sides are dealt in blocks of about ``block``; a pair of blocks is a group, compared SLICE queries at a time.  Where queries
    have ``cells``, only rows whose ``cell`` is among them count.
    """
    dealt, among = [], "cells" in queries.columns
    for side, key in ((queries, "query_id"), (rows, "key")):
        blocks = side.groupBy(*on).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        dealt.append((side.join(F.broadcast(blocks), on).withColumn("own", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).drop("blocks"), blocks))
    (asked, q), (rows, p) = dealt
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asked = asked.join(F.broadcast(p), on).withColumn("_j", other).withColumnRenamed("own", "_i").drop("blocks")
    rows = rows.join(F.broadcast(q), on).withColumn("_i", other).withColumnRenamed("own", "_j").drop("blocks")
    kinds = [to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(rows.schema["key"].dataType), pa.float64()]
    names = ["query_id", "key", "raw"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table([pa.array([], t) for t in kinds], names=names)]
        if left.num_rows and right.num_rows:
            right = right.sort_by("key").combine_chunks()
            x, y = matrix(left["vector"].combine_chunks()), matrix(right["vector"].combine_chunks())
            for at in range(0, len(x), SLICE):
                part = left.slice(at, SLICE)
                raw = np.round(x[at : at + SLICE] @ y.T, DIGITS)
                if among:
                    cell, cells = right["cell"].to_numpy(), part["cells"].combine_chunks()
                    first = cell.min()
                    own = np.zeros((len(raw), cell.max() - first + 1), bool)
                    flat, row = cells.flatten().to_numpy() - first, np.repeat(np.arange(len(raw)), pc.list_value_length(cells).to_numpy())
                    there = (flat >= 0) & (flat < own.shape[1])
                    own[row[there], flat[there]] = True
                    raw[~own[:, cell - first]] = -np.inf
                a, b = np.nonzero(best(raw, k) & (raw > -np.inf))
                out.append(pa.table([part["query_id"].combine_chunks().take(pa.array(a)), right["key"].combine_chunks().take(pa.array(b)), pa.array(raw[a, b])], schema=out[0].schema))
        return pa.concat_tables(out)

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, key {rows.schema['key'].dataType.simpleString()}, raw double"
    by = (*on, "_i", "_j")
    return asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(meet, schema)


def ranked_by(rows: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """``rows`` with ``rank`` from 1 in descending order of the integer ``key``, without gathering them in one task.

    Ranks are taken inside equal ranges of the key; what comes before a range is a sum over one row for each.
    """
    ends = rows.agg(F.min(key).alias("low"), F.max(key).alias("high"))
    dealt = rows.join(F.broadcast(ends)).withColumn("bucket", F.floor((F.col("high") - F.col(key)) * buckets / (F.col("high") - F.col("low") + 1))).drop("low", "high")
    before = F.coalesce(F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("bucket").count().select("bucket", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col(key).desc()))
    return dealt.withColumn("rank", inside).join(F.broadcast(offsets), "bucket").withColumn("rank", F.col("rank") + F.col("before")).drop("bucket", "before")


def fuse(lists: DataFrame, k: int = 60, *, key: str = "point_id") -> DataFrame:
    """Reciprocal rank fusion of ranked lists (list_no, rank, key): rrf, ordered, ties by first appearance."""
    first = F.min(F.struct("list_no", "rank")).alias("first")
    out = lists.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), first)
    return out.select(key, F.round("rrf", 12).alias("rrf"), F.col("first.list_no").alias("first_list"), F.col("first.rank").alias("first_rank")).orderBy(F.col("rrf").desc(), "first_list", "first_rank")


def hybrid(index: DataFrame, query: str, vector: list[float], filters: Filters, config: Config | None = None, *, limit: int = TOP_K, path_prefix: str | None = None, stemmed: bool = True, strict_filters: bool = False, key: str = "point_id", keywords: KeywordIndex | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Semantic and keyword arms of three times the limit each, fused on the key.

    The keyword arm heeds workspace and source only, unless ``strict_filters``; it reads ``keywords`` where one is given.
    ``texts``: see ``semantic``; the keyword arm reads them too.
    """
    if strict_filters and keywords is not None:
        raise ValueError("a keyword index heeds workspace and source only")
    config = config or Config()
    check_limit(limit)
    arm = limit * OVERFETCH
    near = semantic(index, query, vector, filters, config, limit=arm, path_prefix=path_prefix, key=key, texts=texts)
    near = near.select(key, F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("raw").desc(), key)).alias("rank"), F.lit(0).alias("list_no"))
    docs = index if texts is None else texts
    docs = docs.where(filters.condition()) if strict_filters else docs
    terms = _by_words(docs, keywords, query, arm, filters, stemmed, key)
    terms = terms.select(F.col("point_id").alias(key), F.row_number().over(Window.orderBy(lexical.in_order("bm25"), "point_id")).alias("rank"), F.lit(1).alias("list_no"))
    # both windows run over at most three limits of rows
    return fuse(near.unionByName(terms), config.search.rrf_k, key=key).limit(limit)


def search(index: DataFrame, query: str, vector: list[float], filters: Filters, mode: str = "semantic", config: Config | None = None, *, limit: int = TOP_K, path_prefix: str | None = None, stemmed: bool = True, key: str = "point_id", keywords: KeywordIndex | None = None, texts: DataFrame | None = None) -> DataFrame:
    """The hits of one of ``MODES`` with key, score and the columns of a hit, best first.

    Without types the search is for documentation, code and tests, so governance documents are left out; the limit, the
    mode and the app are checked. The keyword mode heeds workspace and source only; with ``keywords``, the index of the same
    points, it reads the postings of the query's terms instead of all texts. ``texts``: see ``semantic``; they have the columns of a hit.
    """
    config = config or Config()
    if not (query or "").strip():
        raise ValueError("the query is empty")
    mode = (mode or "semantic").strip().lower()
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {MODES}")
    check_limit(limit)
    filters = replace(filters, types=filters.types or DEFAULT_TYPES, app=check_app(filters.app, config))
    filters.check()
    if mode == "semantic":
        found = semantic(index, query, vector, filters, config, limit=limit, path_prefix=path_prefix, key=key, texts=texts)
        return hits(found, mode, key).orderBy(F.col("score").desc(), key)
    if mode == "keyword":
        best = _by_words(index if texts is None else texts, keywords, query, limit, filters, stemmed, key)
        best = best.select(F.col("point_id").alias(key), "score")
    else:
        best = hybrid(index, query, vector, filters, config, limit=limit, path_prefix=path_prefix, stemmed=stemmed, key=key, keywords=keywords, texts=texts).select(key, F.col("rrf").alias("score"))
    found = (index if texts is None else texts).join(F.broadcast(best), key)  # at most ``limit`` rows
    return hits(found, mode, key).orderBy(F.col("score").desc(), key)


def _by_words(index: DataFrame, keywords: KeywordIndex | None, query: str, limit: int, filters: Filters, stemmed: bool, key: str) -> DataFrame:
    own = {"workspace_id": filters.workspace_id, "source_id": filters.source_id, "stemmed": stemmed}
    return keywords.search(query, limit, **own) if keywords is not None else lexical.keyword_search(index.withColumn("point_id", F.col(key)), query, limit, **own)


def hits(rows: DataFrame, mode: str, *own: str) -> DataFrame:
    """The fixed columns of a hit list, after the columns ``own``; what the index lacks is null."""
    kinds = {"requirement_ids": "array<string>", "start_line": "int", "end_line": "int", "schema_version": "int", "revision": "int"}
    have = [F.col(c) if c in rows.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in HIT]
    return rows.select(*own, "score", *have, F.lit(mode).alias("search_mode"))


def render(rows: DataFrame, *, key: str = "point_id") -> DataFrame:
    """One text for a hit list (at most a limit of rows): header fields, content, separators."""
    field = lambda c, label=None: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label or c}: "), F.col(c).cast("string")))
    optional = [field(c) for c in ("document_id", "doc_type", "process_area", "domain", "status", "title") if c in rows.columns]
    lines = [F.when(F.col("start_line").isNotNull() & F.col("end_line").isNotNull(), F.format_string("lines: %d-%d", "start_line", "end_line"))] if "start_line" in rows.columns else []
    section = [field("section")] if "section" in rows.columns else []
    ids = [F.when(F.size("requirement_ids") > 0, F.concat(F.lit("requirement_ids: "), F.array_join("requirement_ids", ",")))] if "requirement_ids" in rows.columns else []
    known = lambda c: F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c), F.lit("?")))
    header = F.concat_ws(" | ", known("file"), known("type"), known("app"), *section, *lines, *ids, *optional, F.concat(F.lit("score: "), F.format_string("%.3f", "score")))
    block = F.concat(F.lit("["), header, F.lit("]\n"), F.coalesce("content", F.lit("")))
    blocks = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"), block.alias("b")))), lambda x: x["b"])
    text = rows.agg(blocks.alias("blocks"))
    return text.select(F.when(F.size("blocks") > 0, F.array_join("blocks", "\n\n---\n\n")).otherwise("No relevant results found.").alias("text"))
