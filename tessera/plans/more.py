"""The catalogue, continued: composite queries, maintenance, graphs, jobs, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Config, SearchConfig
from ..functions import paths as P
from ..functions import text as T
from ..functions.vectors import hash_embedding, hash_vector
from ..operators import composite, graph, indexing, jobs, maintain, metrics, search
from ..operators.search import Filters
from ..streaming import incremental
from .corpus import CHUNKS, INDEX, chunks, hash_sql, hashed, index, query_vector, table
from .queries import QUESTION, REQUIREMENTS, query

HASHED = f"{CHUNKS}, idx AS (SELECT *, {{requirements}} AS requirement_ids, {hash_sql(repr('d:') + ' || content')} AS embedding FROM chunks)".replace("{requirements}", REQUIREMENTS)


def _overlap(question: str) -> str:
    wanted = T.query_tokens(question)
    return "(" + " + ".join(f"contains(lower(content || ' ' || file), '{t}')::INTEGER" for t in wanted) + f") / {len(wanted)}.0::DOUBLE"


def _sections(question: str, case: str, limits: dict[str, int], where: str, base: str, columns: str) -> str:
    limit = "CASE section_name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in limits.items()) + " END"
    return f"""{base}, n AS (SELECT *, {case} AS section_name FROM idx WHERE {where}),
near AS (SELECT *, row_number() OVER (PARTITION BY section_name ORDER BY raw DESC, doc_id) AS near FROM n WHERE section_name IS NOT NULL AND raw >= 0.2),
scored AS (SELECT *, round(0.7 * raw + 0.3 * ({_overlap(question)}), 6) AS score FROM near WHERE near <= 3 * ({limit})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY section_name ORDER BY score DESC, raw DESC, doc_id) AS rank FROM scored),
pack AS (SELECT {columns} FROM ranked WHERE rank <= {limit})"""


PACK = "CASE WHEN type = 'documentation' THEN 'documentation' WHEN type IN ('code', 'test') THEN 'code' WHEN type = 'lis' THEN 'lis' END"
PACKED = _sections(QUESTION, PACK, {"documentation": 5, "code": 8, "lis": 5}, "workspace_id = 'ws0'", f"WITH {INDEX}", "section_name, rank, doc_id, file, score")


def _pack(spark, sf):
    return composite.context_pack(index(spark, sf).withColumn("point_id", F.col("doc_id")), QUESTION, query_vector(spark, sf), Filters(workspace_id="ws0"))


@query(PACKED + " SELECT section_name, rank, doc_id, file, score FROM pack")
def context_pack(spark, sf):
    return _pack(spark, sf).select("section_name", F.col("rank").cast("bigint").alias("rank"), "doc_id", "file", "score")


@query(PACKED + " SELECT file, max(score) AS best_score FROM pack GROUP BY file")
def ranked_files(spark, sf):
    return composite.ranked_files(_pack(spark, sf))


@query(PACKED + " SELECT s.section_name, count(p.doc_id) AS hits, count(p.doc_id) = 0 AS is_gap FROM (VALUES ('documentation'), ('code'), ('lis'), ('other')) s(section_name) LEFT JOIN pack p USING (section_name) GROUP BY 1")
def missing_sections(spark, sf):
    return composite.missing(_pack(spark, sf), ("documentation", "code", "lis", "other"))


@query(f"""WITH {CHUNKS}, n AS (SELECT doc_id, file, CASE WHEN type = 'documentation' THEN 'documentation' ELSE 'code' END AS section_name FROM chunks
WHERE workspace_id = 'ws1' AND type <> 'lis' AND list_contains({REQUIREMENTS}, 'REQ-3')),
r AS (SELECT *, row_number() OVER (PARTITION BY section_name ORDER BY doc_id) AS rank FROM n) SELECT section_name, rank, doc_id, file, 1.0::DOUBLE AS score FROM r WHERE rank <= 8""")
def trace_requirement(spark, sf):
    found = composite.trace_requirement(chunks(spark, sf), "req-3", "ws1", key="doc_id")
    return found.select("section_name", F.col("rank").cast("bigint").alias("rank"), "doc_id", "file", "score")


CHANGE = "apps/web/src1/7.ts"


@query(_sections(CHANGE, "CASE WHEN type = 'code' AND starts_with(file, 'apps/web/src1/') THEN 'code' WHEN type = 'test' AND starts_with(file, 'apps/web/src1/') THEN 'test' WHEN type = 'documentation' THEN 'documentation' END", {"code": 8, "test": 8, "documentation": 8}, "workspace_id = 'ws2'", f"WITH {INDEX}", "section_name, rank, doc_id, score") + " SELECT * FROM pack")
def impact_of_change(spark, sf):
    rows = index(spark, sf).withColumn("point_id", F.col("doc_id"))
    found = composite.impact_of_change(rows, "./" + CHANGE, query_vector(spark, sf), Filters(workspace_id="ws2"))
    return found.select("section_name", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score")


AREA = "the tion"
GAP_CONFIG = Config(search=SearchConfig(score_threshold=0.75))
_AREA_VECTOR = hash_sql("'q:" + AREA + "'")
GAPS = f"""WITH {HASHED.replace('idx AS', 'base AS')}, idx AS (SELECT *, round(list_cosine_similarity(embedding, {_AREA_VECTOR}), 6) AS raw FROM base), n AS (SELECT *, CASE WHEN type = 'documentation' THEN 'documentation' WHEN type IN ('code', 'test') THEN 'code' END AS section_name FROM idx WHERE workspace_id = 'ws0'),
near AS (SELECT *, row_number() OVER (PARTITION BY section_name ORDER BY raw DESC, doc_id) AS near FROM n WHERE section_name IS NOT NULL AND raw >= 0.75),
scored AS (SELECT *, round(0.7 * raw + 0.3 * ({_overlap(AREA)}), 6) AS score FROM near WHERE near <= 30),
hits AS (SELECT *, row_number() OVER (PARTITION BY section_name ORDER BY score DESC, raw DESC, doc_id) AS rank FROM scored),
docs AS (SELECT rank, 1 AS ord, 'id:' || r AS key, r AS label, r AS probe FROM (SELECT rank, unnest(requirement_ids) AS r FROM hits WHERE section_name = 'documentation' AND rank <= 10)
  UNION ALL SELECT rank, 2, 'file:' || file || ':' || substr(s, 1, 40), file, s FROM (SELECT rank, file, trim(regexp_replace(substr(content, 1, 160), '\\s+', ' ', 'g')) AS s FROM hits WHERE section_name = 'documentation' AND rank <= 10)),
uniq AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank, ord) = 1),
per AS (SELECT rank, count(*) AS c FROM uniq GROUP BY rank), cum AS (SELECT rank, coalesce(sum(c) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per),
probes AS (SELECT 'documentation' AS side, row_number() OVER (ORDER BY u.rank, u.ord) AS position, label, probe FROM uniq u JOIN cum ON cum.rank = u.rank AND before < 8
  UNION ALL SELECT 'code', rank, file, substr(content, 1, 240) FROM hits WHERE section_name = 'code' AND rank <= 8),
pv AS (SELECT *, {hash_sql("'q:' || probe")} AS v, list_distinct(list_transform(list_filter(regexp_extract_all(probe, '(?i)[a-z0-9_./-]+'), lambda t: length(t) > 1), lambda t: lower(t))) AS toks FROM probes),
met AS (SELECT p.side, p.position, p.toks, i.content, i.file, i.doc_id, round(list_cosine_similarity(i.embedding, p.v), 6) AS raw FROM pv p JOIN n i ON (CASE WHEN p.side = 'documentation' THEN i.section_name = 'code' ELSE i.section_name = 'documentation' END)),
top AS (SELECT * FROM met WHERE raw >= 0.75 QUALIFY row_number() OVER (PARTITION BY side, position ORDER BY raw DESC, doc_id) <= 9),
best AS (SELECT side, position, max(round(0.7 * raw + 0.3 * (CASE WHEN len(toks) > 0 THEN len(list_filter(toks, lambda t: contains(lower(content || ' ' || file), t))) / len(toks)::DOUBLE ELSE 0 END), 6)) AS best_score FROM top GROUP BY side, position)
SELECT p.side, p.position, p.label, coalesce(b.best_score, 0) AS best_score FROM probes p LEFT JOIN best b USING (side, position) WHERE coalesce(b.best_score, 0) < 0.7"""


@query(GAPS.replace("< 0.7", "< 0.75"))
def find_gaps(spark, sf):
    found = composite.find_gaps(hashed(spark, sf), AREA, hash_vector(AREA, "q:"), Filters(workspace_id="ws0"), lambda c: hash_embedding(c, "q:"), GAP_CONFIG, key="doc_id")
    return found.select("side", F.col("position").cast("bigint").alias("position"), "label", "best_score")


@query(f"WITH {CHUNKS} SELECT CASE WHEN count(*) = 0 THEN 'No relevant results found.' ELSE string_agg('[file: ' || file || ' | type: ' || type || ' | app: ' || app || ' | score: 1.000]' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id) END AS text FROM (SELECT * FROM chunks ORDER BY doc_id LIMIT 5)")
def format_hits(spark, sf):
    rows = chunks(spark, sf).orderBy("doc_id").limit(5).withColumn("score", F.lit(1.0)).drop("requirement_ids")
    return search.render(rows, key="doc_id")


@query(f"WITH {CHUNKS} SELECT doc_id::VARCHAR AS document_id, 'semantic' AS search_mode, file, 1.0::DOUBLE AS score FROM chunks WHERE workspace_id = 'ws3'")
def hit_projection(spark, sf):
    rows = chunks(spark, sf).where(Filters(workspace_id="ws3").condition()).withColumns({"document_id": F.col("doc_id").cast("string"), "score": F.lit(1.0)})
    return search.hits(rows, "semantic").select("document_id", "search_mode", "file", "score")


@query(f"WITH {CHUNKS} SELECT doc_id FROM chunks WHERE workspace_id = 'ws2' AND file LIKE 'docs/src1%' ORDER BY doc_id LIMIT 256")
def document_scroll(spark, sf):
    return chunks(spark, sf).where((F.col("workspace_id") == "ws2") & search.under_prefix("docs/src1")).select("doc_id").orderBy("doc_id").limit(256)


# Maintenance.

OBSERVED = f"{CHUNKS}, o AS (SELECT workspace_id, source_id, file AS document_id, sha256(content) AS content_hash, doc_id FROM chunks)"
REGISTRY = f"""{OBSERVED}, top AS (SELECT max(doc_id) AS m FROM documents), reg AS (SELECT workspace_id, source_id, document_id, CASE WHEN doc_id % 10 = 1 THEN 'old' ELSE content_hash END AS content_hash, (doc_id % 3 + 1)::INTEGER AS revision,
CASE WHEN doc_id % 10 = 2 THEN 'writing' WHEN doc_id % 10 = 3 THEN 'deleted' ELSE 'active' END AS status FROM o WHERE doc_id % 10 <> 0
UNION ALL SELECT 'ws' || (i % 4), 'src0', 'docs/src0/' || (m + 1 + i) || '.md', 'gone', 1, CASE WHEN i = 4 THEN 'deleted' ELSE 'active' END FROM top, range(5) r(i))"""
DIFF = f"""{REGISTRY}, diff AS (SELECT coalesce(o.workspace_id, g.workspace_id) AS workspace_id, coalesce(o.source_id, g.source_id) AS source_id, coalesce(o.document_id, g.document_id) AS document_id, o.content_hash AS new_hash, g.content_hash AS old_hash, g.revision AS old_revision, g.status AS old_status,
CASE WHEN o.document_id IS NOT NULL AND (g.status IS NULL OR g.status = 'deleted') THEN 'new' WHEN o.content_hash = g.content_hash AND g.status = 'active' THEN 'unchanged' WHEN o.document_id IS NOT NULL THEN 'changed' WHEN g.status <> 'deleted' THEN 'deleted' END AS kind
FROM o FULL OUTER JOIN reg g ON o.workspace_id = g.workspace_id AND o.source_id = g.source_id AND o.document_id = g.document_id)"""


def _observed(spark, sf):
    return chunks(spark, sf).select("workspace_id", "source_id", F.col("file").alias("document_id"), F.sha2("content", 256).alias("content_hash"), "doc_id")


def _registry(spark, sf):
    rows, n = _observed(spark, sf), F.col("doc_id") % 10
    known = rows.where(n != 0).select(*maintain.KEY, F.when(n == 1, "old").otherwise(F.col("content_hash")).alias("content_hash"), (F.col("doc_id") % 3 + 1).cast("int").alias("revision"), F.when(n == 2, "writing").when(n == 3, "deleted").otherwise("active").alias("status"))
    top = table(spark, sf, "documents").agg(F.max("doc_id").alias("m"))
    i = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")
    gone = top.select("m", i).select(F.concat(F.lit("ws"), (F.col("i") % 4).cast("string")).alias("workspace_id"), F.lit("src0").alias("source_id"), F.concat(F.lit("docs/src0/"), (F.col("m") + 1 + F.col("i")).cast("string"), F.lit(".md")).alias("document_id"), F.lit("gone").alias("content_hash"), F.lit(1).alias("revision"), F.when(F.col("i") == 4, "deleted").otherwise("active").alias("status"))
    return known.unionByName(gone).withColumn("observed_at", F.lit(0.0))


@query(f"WITH {DIFF} SELECT workspace_id, source_id, document_id, kind FROM diff WHERE kind IS NOT NULL")
def inventory_diff(spark, sf):
    return maintain.inventory(_observed(spark, sf), _registry(spark, sf)).select(*maintain.KEY, "kind")


@query(f"WITH {DIFF} SELECT kind, count(*) AS n FROM diff WHERE kind IS NOT NULL GROUP BY kind")
def inventory_counts(spark, sf):
    return maintain.inventory(_observed(spark, sf), _registry(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {DIFF} SELECT workspace_id, source_id, document_id, kind FROM diff WHERE kind IS NOT NULL AND (kind <> 'deleted' OR workspace_id = 'ws1')")
def inventory_scoped(spark, sf):
    registry = _registry(spark, sf)
    return maintain.inventory(_observed(spark, sf), registry, registry.where("workspace_id = 'ws1'")).select(*maintain.KEY, "kind")


@query(f"""WITH {DIFF} SELECT workspace_id, source_id, document_id, coalesce(new_hash, old_hash) AS content_hash,
(CASE WHEN kind = 'new' THEN 1 WHEN kind = 'changed' AND old_status <> 'writing' THEN old_revision + 1 ELSE old_revision END)::INTEGER AS revision,
CASE WHEN kind = 'deleted' THEN 'deleted' WHEN kind IS NOT NULL THEN 'active' ELSE old_status END AS status, CASE WHEN kind IS NOT NULL THEN 7.0 ELSE 0.0 END::DOUBLE AS observed_at FROM diff""")
def registry_merge(spark, sf):
    registry = _registry(spark, sf)
    return maintain.merge_registry(registry, maintain.inventory(_observed(spark, sf), registry), 7.0)


@query(f"""WITH {DIFF} SELECT c.doc_id * 10 + k AS point_id, (CASE WHEN kind = 'new' THEN 1 WHEN kind = 'changed' AND old_status <> 'writing' THEN old_revision + 1 ELSE old_revision END)::INTEGER AS revision
FROM diff d JOIN chunks c ON c.workspace_id = d.workspace_id AND c.source_id = d.source_id AND c.file = d.document_id, (VALUES (0), (1), (2)) v(k) WHERE CASE WHEN kind IN ('new', 'changed') THEN k <> 1 ELSE k <> 2 END""")
def replace_documents(spark, sf):
    registry, observed = _registry(spark, sf), _observed(spark, sf)
    some = lambda *k: F.explode(F.array(*map(F.lit, k))).alias("chunk_index")
    rebuilt = observed.select(*maintain.KEY, "doc_id", some(0, 2)).withColumn("point_id", F.col("doc_id") * 10 + F.col("chunk_index"))
    before = registry.select(*maintain.KEY, "revision").join(observed, maintain.KEY).select(*maintain.KEY, "doc_id", "revision", some(0, 1))
    points = before.withColumn("point_id", F.col("doc_id") * 10 + F.col("chunk_index"))
    fresh = indexing.revised(rebuilt, maintain.inventory(observed, registry))
    return indexing.replace_documents(points, fresh).select("point_id", "revision")


@query("SELECT doc_id AS point_id, lang, CASE WHEN doc_id % 4 = 0 THEN n_chars + 2 WHEN doc_id % 2 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents")
def upsert_last_wins(spark, sf):
    points = table(spark, sf, "documents").select(F.col("doc_id").alias("point_id"), "lang", "n_chars")
    one = points.where("point_id % 2 = 0").withColumns({"n_chars": F.col("n_chars") + 1, "position": F.lit(1)})
    two = points.where("point_id % 4 = 0").withColumns({"n_chars": F.col("n_chars") + 2, "position": F.lit(2)})
    return maintain.upsert(points, one.unionByName(two))


@query("SELECT doc_id AS point_id FROM documents WHERE NOT (source = 'src1' AND doc_id % 4 = 1 AND doc_id % 3 <> 0)")
def retire_orphans(spark, sf):
    points = chunks(spark, sf).select(F.col("doc_id").alias("point_id"), "workspace_id", "source_id", F.col("file").alias("document_id"))
    documents = points.where("source_id = 'src1' AND workspace_id = 'ws1'")
    return maintain.retire(points, points.where("point_id % 3 = 0"), documents).select("point_id")


@query(f"WITH {CHUNKS} SELECT doc_id AS point_id FROM chunks WHERE NOT (type = 'lis' AND workspace_id = 'ws0')")
def delete_documents(spark, sf):
    rows = chunks(spark, sf)
    return maintain.delete_documents(rows, rows.where("type = 'lis' AND workspace_id = 'ws0'"), ["workspace_id", "file"]).select(F.col("doc_id").alias("point_id"))


@query()
def manifest_check(spark, sf):
    old, new = maintain.Manifest("a", 64, "c"), maintain.Manifest("b", 32, "c")
    return spark.createDataFrame([(f,) for f in maintain.incompatible(old, new)], "field string")


# Graphs and workspaces.

EDGES = "e AS (SELECT 'n' || n_nationkey AS src, 'n' || ((n_nationkey * 7 + 1) % 25) AS dst, (['depends_on', 'references', 'implements', 'documents', 'tests', 'shares_contract_with'])[n_nationkey % 6 + 1] AS type, 0 AS position FROM nation UNION ALL SELECT 'n' || n_nationkey, 'n' || ((n_nationkey + 3) % 25), 'references', 1 FROM nation WHERE n_nationkey % 2 = 0)"


def _edges(spark, sf):
    k = F.col("n_nationkey")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    nation = table(spark, sf, "nation")
    one = nation.select(name(k).alias("src"), name((k * 7 + 1) % 25).alias("dst"), F.element_at(F.array(*map(F.lit, graph.TYPES)), (k % 6 + 1).cast("int")).alias("type"), F.lit(0).alias("position"))
    return one.unionByName(nation.where(k % 2 == 0).select(name(k).alias("src"), name((k + 3) % 25).alias("dst"), F.lit("references").alias("type"), F.lit(1).alias("position")))


@query(f"""WITH RECURSIVE {EDGES}, r(workspace_id, depth) AS (SELECT 'n0', 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.workspace_id AND e.dst <> 'n13' WHERE r.depth < 3)
SELECT workspace_id, min(depth)::BIGINT AS depth FROM r GROUP BY workspace_id HAVING min(depth) > 0""")
def related_workspaces(spark, sf):
    names = tuple(f"n{i}" for i in range(25) if i != 13)
    return graph.expand(_edges(spark, sf), "n0", max_depth=3, allowlist=names).select("workspace_id", F.col("depth").cast("bigint").alias("depth"))


@query(f"""WITH {EDGES}, x AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE src = 'n2' UNION ALL SELECT 'n1', 'n1', 'tests', 5 UNION ALL SELECT 'n1', 'lost', 'tests', 6 UNION ALL SELECT 'n1', 'n2', 'likes', 7)
SELECT src, dst, type, CASE WHEN type = 'likes' THEN 'unknown type' ELSE 'self' END AS problem FROM x WHERE type = 'likes' OR src = dst
UNION ALL SELECT src, dst, type, 'unknown target' FROM x WHERE dst NOT IN (SELECT 'n' || n_nationkey FROM nation) UNION ALL SELECT src, dst, type, 'duplicate' FROM x GROUP BY src, dst, type HAVING count(*) > 1""")
def relationship_violations(spark, sf):
    edges = _edges(spark, sf)
    extra = spark.createDataFrame([("n1", "n1", "tests", 5), ("n1", "lost", "tests", 6), ("n1", "n2", "likes", 7)], "src string, dst string, type string, position int")
    names = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("workspace_id"))
    return graph.violations(edges.union(edges.where("src = 'n2'")).union(extra), names)


RESOLVE = """p AS (SELECT DISTINCT '/' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages),
host AS (SELECT DISTINCT regexp_extract(path, '^/([^/]+)', 1) AS h FROM p),
roots AS (SELECT 'w' || (length(h) % 3) AS workspace_id, 's1' AS source_id, '/' || h AS root FROM host WHERE length(h) % 4 <> 0 UNION ALL SELECT 'deep', 's2', '/' || h || '/en' FROM host UNION ALL SELECT 'twin', 's3', '/' || h || '/en' FROM host WHERE length(h) % 2 = 0),
m AS (SELECT p.path, r.*, len(string_split(root, '/')) AS depth FROM p JOIN roots r ON p.path = r.root OR starts_with(p.path, r.root || '/')),
b AS (SELECT * FROM m QUALIFY rank() OVER (PARTITION BY path ORDER BY depth DESC) = 1),
f AS (SELECT path, min(workspace_id) AS workspace_id, max(depth)::BIGINT AS depth, count(DISTINCT workspace_id) > 1 AS ambiguous FROM b GROUP BY path)"""


def _resolved(spark, sf):
    path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""))
    paths = table(spark, sf, "pages").select(path.alias("path")).distinct()
    hosts = paths.select(F.regexp_extract("path", "^/([^/]+)", 1).alias("h")).distinct()
    size, zero = F.length("h"), F.lit(0).alias("position")
    root = lambda w, s, tail: (w.alias("workspace_id"), F.lit(s).alias("source_id"), F.concat(F.lit("/"), "h", F.lit(tail)).alias("root"), zero)
    roots = hosts.where(size % 4 != 0).select(*root(F.concat(F.lit("w"), (size % 3).cast("string")), "s1", "")).union(hosts.select(*root(F.lit("deep"), "s2", "/en"))).union(hosts.where(size % 2 == 0).select(*root(F.lit("twin"), "s3", "/en")))
    return graph.resolve(paths, roots)


@query(f"WITH {RESOLVE} SELECT p.path, f.workspace_id, f.depth FROM p LEFT JOIN f USING (path)")
def resolve_longest_prefix(spark, sf):
    return _resolved(spark, sf).select("path", "workspace_id", F.col("depth").cast("bigint").alias("depth"))


@query(f"WITH {RESOLVE} SELECT path FROM f WHERE ambiguous")
def resolve_ambiguous(spark, sf):
    return _resolved(spark, sf).where("ambiguous").select("path")


@query(f"WITH {CHUNKS} SELECT doc_id FROM chunks WHERE workspace_id IN ('ws1', 'ws3')")
def acl_semijoin(spark, sf):
    grants = spark.createDataFrame([("ws1",), ("ws3",), ("ws3",)], "workspace_id string")
    return graph.authorised(chunks(spark, sf), grants).select("doc_id")


@query("SELECT 'n' || n_nationkey AS workspace_id, n_name AS name FROM nation WHERE n_regionkey IN (1, 3) AND contains(lower('n' || n_nationkey || ' ' || n_name || ' '), 'n')")
def workspace_list_filter(spark, sf):
    region = F.when(F.col("n_regionkey").isin(1, 3), F.array(F.lit("Green"), F.lit("blue"))).otherwise(F.array(F.lit("green")))
    rows = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("workspace_id"), F.col("n_name").alias("name"), F.lit("").alias("description"), region.alias("tags"))
    return graph.list_workspaces(rows, tags=("BLUE",), text=" N ").select("workspace_id", "name")


@query("SELECT type AS bucket, workspace_id, count(*) AS files FROM (SELECT CASE doc_id % 5 WHEN 2 THEN 'code' WHEN 3 THEN 'code' WHEN 4 THEN 'lis' ELSE 'knowledge' END AS type, 'ws' || (doc_id % 4) AS workspace_id FROM documents) GROUP BY ALL")
def doctor_file_counts(spark, sf):
    bucket = F.when(F.col("type").isin("code", "test"), "code").when(F.col("type") == "lis", "lis").otherwise("knowledge")
    return chunks(spark, sf).groupBy(bucket.alias("bucket"), "workspace_id").agg(F.count("*").alias("files"))


# Jobs and metrics.

JOBS = """j AS (SELECT event_id AS job_id, 'w' || (user_id % 20) AS workspace_id, 's' || (event_id % 3) AS source_id, CASE WHEN event_id % 2 = 0 THEN 'gui-' ELSE 'k-' END || (event_id % 500) AS idempotency_key, 'full' AS mode,
(['queued', 'running', 'succeeded', 'failed', 'cancelled'])[event_id % 5 + 1] AS status, event_id::DOUBLE AS created_at, (event_id + user_id % 100)::DOUBLE AS updated_at, (event_id + 300)::DOUBLE AS lease_expires_at, CASE WHEN event_id % 5 = 3 THEN 'bad' ELSE '' END AS error FROM events)"""
NOW = 900.0


def _jobs(spark, sf):
    n, u = F.col("event_id"), F.col("user_id")
    text = lambda a, c: F.concat(F.lit(a), c.cast("string"))
    status = F.element_at(F.array(*map(F.lit, (*jobs.LIVE, *jobs.TERMINAL))), (n % 5 + 1).cast("int"))
    return table(spark, sf, "events").select(
        n.alias("job_id"), text("w", u % 20).alias("workspace_id"), text("s", n % 3).alias("source_id"), F.concat(F.when(n % 2 == 0, "gui-").otherwise("k-"), (n % 500).cast("string")).alias("idempotency_key"), F.lit("full").alias("mode"),
        status.alias("status"), n.cast("double").alias("created_at"), (n + u % 100).cast("double").alias("updated_at"), (n + 300).cast("double").alias("lease_expires_at"), F.when(n % 5 == 3, "bad").otherwise("").alias("error"),
    )


@query(f"WITH {JOBS} SELECT workspace_id, max(updated_at) AS last_success_at FROM j WHERE status = 'succeeded' GROUP BY workspace_id")
def job_last_success(spark, sf):
    return jobs.last_success(_jobs(spark, sf).withColumn("result_ids", F.array().cast("array<string>")))


@query(f"WITH {JOBS} SELECT status, error, count(*) AS n FROM (SELECT CASE WHEN status IN ('queued', 'running') AND lease_expires_at <= {NOW} THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('queued', 'running') AND lease_expires_at <= {NOW} THEN 'lease expired' ELSE error END AS error FROM j) GROUP BY ALL")
def job_expire(spark, sf):
    return jobs.expire(_jobs(spark, sf), NOW).groupBy("status", "error").agg(F.count("*").alias("n"))


@query(f"WITH {JOBS} SELECT workspace_id, source_id, job_id FROM j WHERE status IN ('queued', 'running') AND lease_expires_at > {NOW} QUALIFY row_number() OVER (PARTITION BY workspace_id, source_id ORDER BY created_at, job_id) = 1")
def job_active_lease(spark, sf):
    return jobs.active(_jobs(spark, sf), NOW).select("workspace_id", "source_id", "job_id")


@query(f"""WITH {JOBS}, x AS (SELECT *, CASE WHEN status IN ('queued', 'running') AND lease_expires_at <= {NOW} THEN 'failed' ELSE status END AS st FROM j), r AS (SELECT DISTINCT workspace_id, source_id, idempotency_key FROM j WHERE job_id % 7 = 0 UNION SELECT 'fresh', 's0', 'k-new')
SELECT workspace_id, source_id, idempotency_key, coalesce(x.job_id, -1) AS job_id, CASE WHEN x.job_id IS NULL THEN 'inserted' WHEN x.st IN ('queued', 'running') THEN 'joined' ELSE 'requeued' END AS outcome FROM r LEFT JOIN x USING (workspace_id, source_id, idempotency_key)""")
def job_dedupe(spark, sf):
    rows = _jobs(spark, sf)
    asked = rows.where("job_id % 7 = 0").select(*jobs.SCOPE).union(spark.createDataFrame([("fresh", "s0", "k-new")], "a string, b string, c string")).distinct()
    found = jobs.submit(rows, asked.withColumns({"mode": F.lit("full"), "job_id": F.lit(-1).cast("bigint")}), NOW)
    return found.where("outcome IS NOT NULL").select(*jobs.SCOPE, "job_id", "outcome")


@query(f"""WITH {JOBS}, x AS (SELECT *, CASE WHEN status IN ('queued', 'running') AND lease_expires_at <= {NOW} THEN 'failed' ELSE status END AS st FROM j),
f AS (SELECT workspace_id, source_id, min({{'c': created_at, 'i': job_id}}) FILTER (WHERE st = 'queued' AND job_id % 2 = 0) AS first, bool_or(st = 'running') AS busy FROM x GROUP BY ALL)
SELECT job_id, CASE WHEN first.i = job_id AND NOT busy THEN 'running' ELSE st END AS status, CASE WHEN first.i = job_id AND NOT busy THEN {NOW} + 300 ELSE lease_expires_at END::DOUBLE AS lease_expires_at, coalesce(first.i = job_id AND NOT busy, false) AS claimed
FROM x JOIN f USING (workspace_id, source_id)""")
def job_claim(spark, sf):
    rows = _jobs(spark, sf)
    return jobs.claim(rows, rows.where("job_id % 2 = 0"), NOW).select("job_id", "status", "lease_expires_at", "claimed")


@query(f"WITH {JOBS} SELECT job_id, workspace_id, status, updated_at, CASE WHEN starts_with(idempotency_key, 'gui-') AND status IN ('succeeded', 'failed', 'cancelled') THEN updated_at - created_at END AS duration_seconds, nullif(error, '') AS error FROM j ORDER BY updated_at DESC, job_id LIMIT 100")
def job_history(spark, sf):
    return jobs.history(_jobs(spark, sf))


@query("""SELECT 'latency{kind="' || event_type || '",user="' || (user_id % 5) || '"}' AS metric, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1""")
def metrics_aggregate(spark, sf):
    labels = F.create_map(F.lit("user"), (F.col("user_id") % 5).cast("string"), F.lit("kind"), F.col("event_type"))
    rows = table(spark, sf, "events").select(F.lit("latency").alias("name"), labels.alias("labels"), "value")
    return metrics.aggregate(rows).withColumn("total", F.round("total", 4))


@query("SELECT event_id AS request_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS arrived FROM events")
def rate_limit_arrivals(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), F.col("event_id").alias("ts"))
    return metrics.arrivals(rows, 500).select("request_id", "arrived")


@query()
def rate_limit_admitted(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), F.col("event_id").alias("ts"))
    return metrics.admitted(rows, limit=3, seconds=500)


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'not_indexed' WHEN event_id % 4 = 0 THEN 'error' WHEN event_type = 'click' THEN 'partial' WHEN user_id % 2 > 0 THEN 'ready' ELSE 'not_indexed' END AS lifecycle FROM events")
def index_status(spark, sf):
    n = F.col("event_id")
    found = metrics.lifecycle(F.when(n % 4 == 0, "failed"), F.when(F.col("event_type") == "click", "partial").otherwise("full"), F.col("user_id") % 2, n % 9 != 0)
    return table(spark, sf, "events").select("event_id", found.alias("lifecycle"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN true ELSE false END AS is_path, CASE WHEN doc_id % 3 = 0 THEN 'src/' ELSE '' END AS parent FROM documents")
def path_like_changes(spark, sf):
    n = F.col("doc_id")
    value = F.when(n % 3 == 0, F.concat(F.lit("./src/"), n.cast("string"))).when(n % 3 == 1, F.concat(n.cast("string"), F.lit(".py"))).otherwise("how does it / work")
    rows = table(spark, sf, "documents").select("doc_id", value.alias("v"))
    return rows.select("doc_id", P.looks_like_path(F.col("v")).alias("is_path"), F.when(P.looks_like_path(F.col("v")), P.parent_prefix(F.col("v"))).otherwise("").alias("parent"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_latency(spark, sf):
    return incremental.latency(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", F.round("total", 4).alias("total"), "n")


