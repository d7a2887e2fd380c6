"""Hybrid search at size: what its joins shuffle."""

from __future__ import annotations

from tessera.operators import search
from tessera.plans import queries


def _shuffled(node) -> set[str]:
    """Names of the columns that a plan's exchanges carry by hash."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return _shuffled(node.initialPlan())
    found = {node.output().apply(i).name() for i in range(node.output().size())} if name == "Exchange" and "hashpartitioning" in node.simpleString(200) else set()
    return found.union(*(_shuffled(node.children().apply(i)) for i in range(node.children().size())))


def test_hybrid_search_shuffles_no_texts(spark, data):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = _shuffled(queries.QUERIES["hybrid_search"](spark, data)._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "embedding" in found and not found & {"text", "content"}


def test_texts_apart_give_the_same_hits(spark):
    rows = [(str(i % 40), "w", "s", f"f{i}", "code", f"alpha {'beta' * (i % 3)} {i}", [float(i % 40 % 7), 1.0]) for i in range(45)]  # five keys twice
    index = spark.createDataFrame(rows, "point_id string, workspace_id string, source_id string, file string, type string, content string, embedding array<double>")
    for how in ({}, {"path_prefix": "f1"}, {"path_prefix": "f1", "pushdown_prefix": True}):
        own = lambda **more: [tuple(r) for r in search.semantic(index, "alpha betabeta", [1.0, 1.0], search.Filters("w"), limit=20, **how, **more).select("raw", "score", "file").collect()]  # noqa: B023, E731
        assert own() and [r[:2] for r in own(texts=index.drop("embedding"))] == [r[:2] for r in own()]
    once = index.where("int(substr(file, 2)) < 40")
    hybrid = lambda **more: [tuple(r) for r in search.hybrid(once, "alpha", [1.0, 1.0], search.Filters("w"), **more).collect()]
    assert hybrid() and hybrid(texts=once.drop("embedding")) == hybrid()
