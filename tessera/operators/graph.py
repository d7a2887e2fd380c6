"""Workspaces: relationship expansion, validation, path resolution, access, listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Types of relationships.
TYPES = ("depends_on", "references", "implements", "documents", "tests", "shares_contract_with")


def allowed(column: str, allowlist: tuple[str, ...] | None) -> Column:
    """Access: no allowlist, an empty one or one with * allows all."""
    return F.lit(True) if not allowlist or "*" in allowlist else F.col(column).isin(*allowlist)


def expand(edges: DataFrame, start: str, *, max_depth: int = 1, allowlist: tuple[str, ...] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Workspaces that outbound edges (src, dst, type, position) reach: workspace_id, depth, via, relationship_type.

    Breadth first: a workspace is reached once, on its first path in the order of edges; traversal doesn't
    pass through what isn't allowed.  One join per depth, over the frontier only.
    """
    edges = edges.where(allowed("dst", allowlist))
    if known is not None:
        edges = edges.join(known.select(F.col("workspace_id").alias("dst")), "dst", "left_semi")
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(start, [], [])], "workspace_id string, via array<string>, at array<int>")
    reached = frontier.select("workspace_id", F.lit(0).alias("depth"), "via", F.lit(None).cast("string").alias("relationship_type"), "at")
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, F.col("workspace_id") == F.col("src")).select(
            F.col("dst").alias("workspace_id"), F.lit(depth).alias("depth"), F.concat("via", F.array("src")).alias("via"), F.col("type").alias("relationship_type"), F.concat("at", F.array(F.col("position").cast("int"))).alias("at")
        )
        step = step.join(reached.select("workspace_id"), "workspace_id", "left_anti")
        first = F.row_number().over(Window.partitionBy("workspace_id").orderBy("at"))
        step = step.withColumn("first", first).where("first = 1").drop("first")
        reached = reached.unionByName(step)
        frontier = step.select("workspace_id", "via", "at")
    return reached.where("depth > 0").select("workspace_id", "depth", "via", "relationship_type")


def violations(edges: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(src, dst, type, problem) of edges with an unknown type or target, of a workspace to itself, or twice."""
    bad = edges.withColumn("problem", F.when(~F.col("type").isin(*TYPES), "unknown type").when(F.col("src") == F.col("dst"), "self")).where("problem IS NOT NULL")
    lost = edges.join(workspaces.select(F.col("workspace_id").alias("dst")), "dst", "left_anti").withColumn("problem", F.lit("unknown target"))
    twice = edges.groupBy("src", "dst", "type").agg(F.count("*").alias("n")).where("n > 1").withColumn("problem", F.lit("duplicate"))
    names = ["src", "dst", "type", "problem"]
    return bad.select(names).union(lost.select(names)).union(twice.select(names))


def resolve(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """For paths (path) and source roots (workspace_id, source_id, root, position): the deepest root that holds each path.

    Gives path, workspace_id, source_id, root, depth and ambiguous (whether workspaces share the deepest
    root); paths without a root have nulls.  A path's ancestors are joined by equality, not by comparing
    every path with every root.
    """
    clean = F.regexp_replace("root", "/+$", "")
    parts = F.split("path", "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    wide = paths.select("path", F.posexplode(upto).alias("at", "ancestor")).withColumn("depth", F.col("at") + 1)
    met = wide.join(roots.withColumn("ancestor", clean), "ancestor")
    rank = F.rank().over(Window.partitionBy("path").orderBy(F.col("depth").desc()))
    best = met.withColumn("rank", rank).where("rank = 1")
    first = F.min(F.struct("position", "workspace_id", "source_id", "root")).alias("f")
    found = best.groupBy("path").agg(first, F.max("depth").alias("depth"), (F.countDistinct("workspace_id") > 1).alias("ambiguous"))
    return paths.join(found, "path", "left").select("path", "f.workspace_id", "f.source_id", "f.root", "depth", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def list_workspaces(workspaces: DataFrame, *, tags: tuple[str, ...] = (), text: str | None = None, allowlist: tuple[str, ...] | None = None) -> DataFrame:
    """Workspaces (workspace_id, name, description, tags) with all tags, and the text in id, name or description; by id."""
    rows = workspaces.where(allowed("workspace_id", allowlist))
    if tags:
        low = F.transform("tags", F.lower)
        rows = rows.where(F.size(F.array_except(F.array(*(F.lit(t.lower()) for t in tags)), low)) == 0)
    if text and text.strip():
        words = F.lower(F.concat_ws(" ", "workspace_id", "name", "description"))
        rows = rows.where(F.contains(words, F.lit(text.strip().lower())))
    return rows.orderBy("workspace_id")


def list_sources(workspaces: DataFrame, *, allowlist: tuple[str, ...] | None = None) -> DataFrame:
    """(workspace_id, source fields) from nested sources."""
    return workspaces.where(allowed("workspace_id", allowlist)).select("workspace_id", F.posexplode("sources").alias("position", "s")).select("workspace_id", "position", "s.*")


def authorised(rows: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows whose workspace is granted (workspace_id)."""
    return rows.join(grants.select("workspace_id").distinct(), "workspace_id", "left_semi")
