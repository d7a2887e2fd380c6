"""Composite queries over an index: context packs, requirement traces, impact of a change, gaps.

Each reads the index once: sections are ranked by windows in one scan, and probes meet the index in one
join instead of one search each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import OVERFETCH, Config
from ..functions import paths as P
from ..functions import text as T
from ..functions.vectors import cosine, cosine_to
from .search import DIGITS, Filters, under_prefix

Embed = Callable[[Column], Column]
#: Limits of the composite queries.
PROBES, RELATED, SHOWN, SNIPPET, PROBE_CHARS = 8, 3, 15, 160, 240


def sectioned(rows: DataFrame, query: str, vector: list[float], section: Column, limits: dict[str, int], config: Config, *, threshold: float, key: str = "point_id") -> DataFrame:
    """The best rows of each section (null: none), re-ranked, with section_name, rank, score: one scan and one window per step."""
    s = config.search
    rows = rows.withColumn("section_name", section).where(F.col("section_name").isNotNull())
    rows = rows.withColumn("raw", F.round(cosine_to(query=vector, v=F.col("embedding")), DIGITS)).where(F.col("raw") >= threshold)
    table = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))
    limit = F.element_at(table, F.col("section_name"))
    fetch = limit * (OVERFETCH if s.lexical_weight > 0 else 1)
    near = F.row_number().over(Window.partitionBy("section_name").orderBy(F.col("raw").desc(), key))
    rows = rows.withColumn("near", near).where(F.col("near") <= fetch)
    score = F.round(T.blend(F.col("raw"), T.overlap(query, F.col("content"), F.col("file")), s.vector_weight, s.lexical_weight), DIGITS)
    rows = rows.withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("section_name").orderBy(F.col("score").desc(), F.col("raw").desc(), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def context_pack(index: DataFrame, query: str, vector: list[float], filters: Filters, config: Config | None = None, *, docs: int = 5, code: int = 8, lis: int = 5, app: str | None = None) -> DataFrame:
    """Documentation, code (with tests) and governance hits for one question, each with its own limit."""
    config = config or Config()
    kinds = F.when(F.col("type") == "documentation", "documentation").when(F.col("type").isin("code", "test") & (F.lit(app is None) | (F.col("app") == (app or ""))), "code").when(F.col("type") == "lis", "lis")
    return sectioned(index.where(filters.condition()), query, vector, kinds, {"documentation": docs, "code": code, "lis": lis}, config, threshold=config.search.score_threshold)


def ranked_files(hits: DataFrame) -> DataFrame:
    """(file, best_score) of a hit list, best first."""
    return hits.groupBy("file").agg(F.max("score").alias("best_score")).orderBy(F.col("best_score").desc(), "file")


def missing(hits: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """Gap flags: (section_name, hits, is_gap) for each section that was asked for."""
    asked = hits.sparkSession.createDataFrame([(s,) for s in sections], "section_name string")
    counted = hits.groupBy("section_name").agg(F.count("*").alias("hits"))
    out = asked.join(counted, "section_name", "left").select("section_name", F.coalesce("hits", F.lit(0)).alias("hits"))
    return out.withColumn("is_gap", F.col("hits") == 0)


def requirement_links(index: DataFrame, *, key: str = "point_id") -> DataFrame:
    """(requirement_id, key, workspace_id, type, file): the exploded table that an exact lookup reads."""
    return index.select(F.explode("requirement_ids").alias("requirement_id"), key, "workspace_id", "type", "app", "file")


def trace_requirement(index: DataFrame, requirement: str, workspace_id: str, config: Config | None = None, *, vector: list[float] | None = None, app: str | None = None, k: int = 8, key: str = "point_id") -> DataFrame:
    """Documentation and code of a requirement: an exact lookup for ids (score 1.0), two searches for other text."""
    config = config or Config()
    wanted = T.normalise_requirement(requirement)
    if not wanted:
        raise ValueError("a requirement can't be empty")
    side = F.when(F.col("type") == "documentation", "documentation").when(F.col("type").isin("code", "test") & (F.lit(app is None) | (F.col("app") == (app or ""))), "code")
    rows = index.where(F.col("workspace_id") == workspace_id)
    if not T.is_requirement_id(requirement):
        if vector is None:
            raise ValueError("a search by text needs the text's vector")
        return sectioned(rows, wanted, vector, side, {"documentation": k, "code": k}, config, threshold=config.search.score_threshold, key=key)
    rows = rows.where(F.array_contains("requirement_ids", wanted)).withColumn("section_name", side).where(F.col("section_name").isNotNull())
    rank = F.row_number().over(Window.partitionBy("section_name").orderBy(key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", F.lit(1.0))


def impact_of_change(index: DataFrame, change: str, vector: list[float], filters: Filters, config: Config | None = None, *, path_prefix: str | None = None, app: str | None = None, k: int = 8) -> DataFrame:
    """Code, tests and documentation near a change; a path narrows code and tests to its directory."""
    config = config or Config()
    change = change.strip()
    if not change:
        raise ValueError("a change can't be empty")
    inside = P.clean_prefix(path_prefix)
    near = inside
    if is_path(change):
        change = P.clean_prefix(change)
        near = near or (change.rsplit("/", 1)[0] + "/" if "/" in change else "")
    here = lambda prefix: under_prefix(prefix) if prefix else F.lit(True)
    mine = F.lit(app is None) | (F.col("app") == (app or ""))
    side = F.when((F.col("type") == "code") & here(near) & mine, "code").when((F.col("type") == "test") & here(near) & mine, "test").when((F.col("type") == "documentation") & here(inside), "documentation")
    return sectioned(index.where(filters.condition()), change, vector, side, {"code": k, "test": k, "documentation": k}, config, threshold=config.search.score_threshold)


def is_path(value: str) -> bool:
    """``looks_like_path`` when planning."""
    text = value.strip()
    file = text.replace("\\", "/")
    file = file[2:] if file.startswith("./") else file
    return bool(text) and "\n" not in text and len(text) <= 260 and (file.endswith(P.PATH_SUFFIXES) or ("/" in file and " " not in file))


def doc_probes(hits: DataFrame) -> DataFrame:
    """(position, label, probe) of ranked documentation hits: their requirement ids, then section or snippet, first seen once."""
    none = F.lit(None).cast("string")
    by_id = F.transform("requirement_ids", lambda r: F.struct(F.concat(F.lit("id:"), r).alias("key"), r.alias("label"), r.alias("probe")))
    words = T.snippet(F.coalesce("content", F.lit("")), SNIPPET)
    section = F.col("section") if "section" in hits.columns else none
    rest = F.when(F.coalesce(section, F.lit("")) != "", F.struct(F.concat(F.lit("section:"), section).alias("key"), F.concat("file", F.lit(" § "), section).alias("label"), section.alias("probe"))).when(
        words != "", F.struct(F.concat(F.lit("file:"), "file", F.lit(":"), F.substring(words, 1, 40)).alias("key"), F.col("file").alias("label"), words.alias("probe"))
    )
    listed = hits.select("rank", F.posexplode(F.filter(F.concat(by_id, F.array(rest)), lambda p: p.isNotNull())).alias("at", "p")).select("rank", "at", "p.*")
    first = listed.groupBy("key").agg(F.min(F.struct("rank", "at", "label", "probe")).alias("f")).select("f.*")
    # hits stop giving probes once there are enough; the hit that reaches the number gives all of its own
    before = F.coalesce(F.sum("n").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_hit = first.groupBy("rank").agg(F.count("*").alias("n")).withColumn("before", before)
    kept = first.join(F.broadcast(per_hit.where(F.col("before") < PROBES).select("rank")), "rank")  # a row per hit, at most a limit
    return kept.select(F.row_number().over(Window.orderBy("rank", "at")).alias("position"), "label", "probe")


def find_gaps(index: DataFrame, area: str, vector: list[float], filters: Filters, embed: Embed, config: Config | None = None, *, app: str | None = None, k: int = 10, key: str = "point_id") -> DataFrame:
    """(side, position, label, best_score) of hits of one side whose best match on the other is below the threshold.

    All probes of both sides meet the index in one join; the probes are at most some ten rows.
    """
    config = config or Config()
    s = config.search
    rows = index.where(filters.condition())
    mine = F.lit(app is None) | (F.col("app") == (app or ""))
    side = F.when(F.col("type") == "documentation", "documentation").when(F.col("type").isin("code", "test") & mine, "code")
    found = sectioned(rows, area, vector, side, {"documentation": k, "code": k}, config, threshold=s.score_threshold, key=key)
    docs = doc_probes(found.where("section_name = 'documentation'")).withColumn("side", F.lit("documentation"))
    code = found.where(f"section_name = 'code' AND rank <= {PROBES}")
    section = F.col("section") if "section" in code.columns else F.lit(None).cast("string")
    text = F.coalesce(F.when(section != "", section), F.when(F.col("content") != "", F.col("content")), F.col("file"))
    code = code.select(F.col("rank").alias("position"), F.col("file").alias("label"), F.substring(text, 1, PROBE_CHARS).alias("probe"), F.lit("code").alias("side"))
    probes = docs.select("side", "position", "label", "probe").unionByName(code)
    probes = probes.withColumn("probe_vector", embed(F.col("probe"))).alias("p")
    other = F.when(F.col("p.side") == "documentation", F.col("i.target") == "code").otherwise(F.col("i.target") == "documentation")
    targets = rows.withColumn("target", side).where(F.col("target").isNotNull()).select(key, "target", "content", "file", "embedding").alias("i")
    met = targets.join(F.broadcast(probes), other).withColumn("raw", F.round(cosine(F.col("i.embedding"), F.col("p.probe_vector")), DIGITS)).where(F.col("raw") >= s.score_threshold)
    near = F.row_number().over(Window.partitionBy("p.side", "p.position").orderBy(F.col("raw").desc(), F.col(f"i.{key}")))
    met = met.withColumn("near", near).where(F.col("near") <= RELATED * OVERFETCH)
    score = F.round(T.blend(F.col("raw"), T.overlap(F.col("p.probe"), F.col("i.content"), F.col("i.file")), s.vector_weight, s.lexical_weight), DIGITS)
    best = met.groupBy("p.side", "p.position").agg(F.max(score).alias("best_score"))
    out = probes.join(best, ["side", "position"], "left").select("side", "position", "label", F.coalesce("best_score", F.lit(0.0)).alias("best_score"))
    rank = F.row_number().over(Window.partitionBy("side").orderBy("position"))
    return out.where(F.col("best_score") < s.score_threshold).withColumn("n", rank).where(F.col("n") <= SHOWN).drop("n")


