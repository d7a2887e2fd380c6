"""The queries of this subpackage, each an operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, counts, digests, langid, manifest, mixing, neardup, ngram_join, snapdiff, suffixdedup, tokenfiles, warc

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents")).drop("row_key", "class_key")


def mixing_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op2 SQL can say: sizes and targets, out of the whole mix."""
    return mixing_entropy_balance(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("taken") <= 3 * F.col("size")).alias("within"))


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.deduplicate(_table(spark, sf_dir, "documents"), passages=suffixdedup.PASSAGES)


def chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("r")).select("r.*")
    found = chat.format_conversations(rows.unionByName(extra))
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.withColumn("loss", chat.masked_text(F.col("formatted"))).select(
        "conv_id",
        F.size("parsed").cast("bigint").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return found.withColumn("log_prob", F.round("log_prob", 4))


def warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return warc.read_archives(warc.write_archives(pages), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op8 on web pages, with their own evidence: markup language, address suffix, host; the model is that of documents."""
    model = langid.fit(_table(spark, sf_dir, "documents"), "text", "lang")
    pages = langid.page_columns(_table(spark, sf_dir, "pages"))
    return langid.identify(pages, key="page_id", declared="declared", host="host", suffix="suffix", model=model)


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.fingerprints(_table(spark, sf_dir, "documents"))


def fingerprint_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op9 SQL can say: lengths and edited texts, out of the whole result."""
    return document_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def later_snapshot(docs: DataFrame) -> DataFrame:
    """A snapshot after ``docs``: by crc32 of the decimal doc_id modulo 10, rows go, change, take another key or are copied."""
    kind = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(-1))
    copied = F.when(F.col("kind") == 5, F.array(F.lit(False), F.lit(True))).when(F.col("kind") != 0, F.array(F.lit(False)))
    rows = docs.withColumn("kind", kind).withColumn("copied", F.explode(copied))
    return rows.select(
        F.when(F.col("copied") | F.col("kind").isin(3, 4), -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(F.col("kind") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("kind") == 2, F.col("lang")).when(F.col("kind") != 4, F.col("source")).alias("source"),
    )


def snapshot_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return snapdiff.difference(docs, later_snapshot(docs), key="doc_id", columns=("text", "lang", "source"))


def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(WORD_VOCABULARY), encoding="utf-8") as f:
        model = f.read()
    return tokenfiles.read_ids(tokenfiles.write_ids(_table(spark, sf_dir, "documents"), model, end=2, compact=True))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(struck, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = manifest.manifest(docs, key="doc_id", group="source", fields=("doc_id", "source", "lang", "n_chars", "text"), tampered={"text": text})
    return found.drop("source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": ngram_jaccard_join,
        "op2_mixing_entropy_balance": mixing_entropy_balance,
        "mixing_targets": mixing_targets,
        "op3_suffix_array_dedup": suffix_array_dedup,
        "op4_chat_round_trip": chat_round_trip,
        "op5_byte_bpe": byte_bpe,
        "op6_token_counts": token_counts,
        "op7_warc_normaliser": warc_normaliser,
        "op8_language_id": language_id,
        "language_of_pages": language_of_pages,
        "op9_document_fingerprints": document_fingerprints,
        "fingerprint_texts": fingerprint_texts,
        "op10_embedding_near_dedup": embedding_near_dedup,
        "op11_snapshot_difference": snapshot_difference,
        "op12_token_id_files": token_id_files,
        "op13_merkle_manifest": merkle_manifest,
    }


WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, least(doc_id, (SELECT min(b) FROM r WHERE r.a = doc_id)) AS class_id, (SELECT count(*) FROM l WHERE l.a = doc_id) AS n_links FROM documents"""
TARGETS = f"""WITH RECURSIVE d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
f(level, fixed, step) AS (SELECT (SELECT sum(source_size) FROM s) / (SELECT sum(weight) FROM s), -1, 0
UNION ALL SELECT ((SELECT sum(source_size) FROM s) - coalesce(3 * sum(source_size) FILTER (weight * level > 3.0 * source_size), 0)) / sum(weight) FILTER (weight * level <= 3.0 * source_size), count(*) FILTER (weight * level > 3.0 * source_size)::INTEGER, step + 1 FROM f, s WHERE step < 50 GROUP BY level, fixed, step HAVING count(*) FILTER (weight * level > 3.0 * source_size) <> fixed)
SELECT doc_id, size::BIGINT AS size, source_size, round(least(weight * (SELECT max_by(level, step) FROM f), 3.0 * source_size), 6) AS target, true AS within FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source"""
ARCHIVED = """SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first, strlen(coalesce(html, '')) >= 100 AND page_id > min(page_id) OVER (PARTITION BY coalesce(html, '')) AS again FROM pages)"""
EDITED = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS following FROM documents WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 3) || substr(following, 1, length(t) // 3)) AS edited_sha256 FROM d"""
LINKED = """WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, least(vec_id, (SELECT min(b) FROM r WHERE r.a = vec_id)) AS component_id FROM e)
SELECT *, vec_id = component_id AS kept FROM c"""

#: crc32 of a decimal number, bit by bit: the list holds a character, then a sign for each of its bits.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length({0}::VARCHAR) + 1), lambda i: [ord(substr({0}::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""
DIFFERENCE = f"""WITH d AS (SELECT doc_id AS k, text AS t, lang AS l, source AS s, coalesce({CRC32.format("doc_id")} % 10, -1) AS m FROM documents),
n AS (SELECT CASE WHEN m IN (3, 4) THEN -1 - k ELSE k END AS k, CASE WHEN m = 1 THEN coalesce(t, '') || '+' ELSE t END AS t, CASE m WHEN 2 THEN s ELSE l END AS l, CASE m WHEN 2 THEN l WHEN 4 THEN NULL ELSE s END AS s FROM d WHERE m <> 0
UNION ALL SELECT -1 - k, t, l, s FROM d WHERE m = 5),
p AS (SELECT o.k AS ok, n.k AS nk, o.t AS ot, o.l AS ol, o.s AS os, n.t AS nt, n.l AS nl, n.s AS ns FROM d o FULL JOIN n ON o.k IS NOT DISTINCT FROM n.k),
g AS (SELECT ok AS k, ot AS t, ol AS l, os AS s, row_number() OVER (PARTITION BY ot, ol, os ORDER BY ok) AS r FROM p WHERE nk IS NULL),
h AS (SELECT nk AS k, nt AS t, nl AS l, ns AS s, row_number() OVER (PARTITION BY nt, nl, ns ORDER BY nk) AS r FROM p WHERE ok IS NULL),
m AS (SELECT g.k AS ok, h.k AS nk, g.t AS ot, g.l AS ol, g.s AS os, h.t AS nt, h.l AS nl, h.s AS ns FROM g FULL JOIN h ON g.r = h.r AND g.t IS NOT DISTINCT FROM h.t AND g.l IS NOT DISTINCT FROM h.l AND g.s IS NOT DISTINCT FROM h.s),
a AS (SELECT *, false AS moved FROM p WHERE ok IS NOT NULL AND nk IS NOT NULL UNION ALL SELECT *, true FROM m),
c AS (SELECT *, CASE WHEN ok IS NULL OR nk IS NULL THEN '' ELSE concat_ws(',', CASE WHEN ot IS DISTINCT FROM nt THEN 'text' END, CASE WHEN ol IS DISTINCT FROM nl THEN 'lang' END, CASE WHEN os IS DISTINCT FROM ns THEN 'source' END) END AS changed FROM a)
SELECT coalesce(nk, ok) AS key, ok AS old_key, CASE WHEN nk IS NULL THEN 'delete' WHEN ok IS NULL THEN 'insert' WHEN moved THEN 'rekey' WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed,
CASE WHEN nk IS NOT NULL THEN sha256(coalesce(nt, '~') || chr(10) || coalesce(nl, '~') || chr(10) || coalesce(ns, '~')) END AS row_sha256 FROM c"""


def _merkle() -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    up = lambda at, keys: f"UNION ALL SELECT {keys} lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {at} WHERE n > 1 GROUP BY {keys} lvl, pos // 3, n"
    swapped = "sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.h ELSE t.h END, '' ORDER BY t.pos))"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf("text")} AS leaf, CASE WHEN {CRC32.format("doc_id")} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS held FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
t(g, lvl, pos, n, h) AS (SELECT g, 0, pos, n, leaf FROM l {up("t", "g,")}),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, pos, n, h) AS (SELECT 0, pos, n, subroot FROM s {up("u", "")}),
f(doc_id, g, lvl, pos, n, h) AS (SELECT doc_id, g, 0, pos, n, held FROM l
UNION ALL SELECT f.doc_id, f.g, f.lvl + 1, f.pos // 3, (f.n + 2) // 3, {swapped} FROM f JOIN t ON t.g = f.g AND t.lvl = f.lvl AND t.pos // 3 = f.pos // 3 WHERE f.n > 1 GROUP BY f.doc_id, f.g, f.lvl, f.pos, f.n),
v(doc_id, g, lvl, pos, n, h) AS (SELECT f.doc_id, f.g, 0, s.pos, s.n, f.h FROM f JOIN s ON f.g = s.g WHERE f.n = 1
UNION ALL SELECT f.doc_id, f.g, f.lvl + 1, f.pos // 3, (f.n + 2) // 3, {swapped} FROM v f JOIN u t ON t.lvl = f.lvl AND t.pos // 3 = f.pos // 3 WHERE f.n > 1 GROUP BY f.doc_id, f.g, f.lvl, f.pos, f.n),
p AS (SELECT f.doc_id, 0 AS tree, t.lvl, t.pos, t.h FROM f JOIN t ON t.g = f.g AND t.lvl = f.lvl AND t.pos // 3 = f.pos // 3 AND t.pos <> f.pos
UNION ALL SELECT v.doc_id, 1, u.lvl, u.pos, u.h FROM v JOIN u ON u.lvl = v.lvl AND u.pos // 3 = v.pos // 3 AND u.pos <> v.pos),
q AS (SELECT doc_id, string_agg(h, '' ORDER BY tree, lvl, pos) AS others FROM p GROUP BY doc_id)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(coalesce(q.others, '')) AS proof_sha256, v.h AS folded_root, v.h = r.h AS verified
FROM l JOIN s ON l.g = s.g JOIN (SELECT h FROM u WHERE n = 1) r ON true JOIN v ON v.doc_id = l.doc_id AND v.n = 1 LEFT JOIN q ON q.doc_id = l.doc_id"""


def _formatted() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    signs = {chat.ESCAPE: "0", **chat.CONTROLS}

    def escaped(c: str) -> str:
        for sign, letter in signs.items():
            c = f"replace({c}, {quoted(sign)}, {quoted(chat.ESCAPE + letter)})"
        return c

    def length(safe: bool) -> str:
        t, r = (escaped("t"), escaped("r")) if safe else ("t", "r")
        return f"sum(CASE r WHEN 'user' THEN 15 + length({t}) WHEN 'assistant' THEN 10 + length({t}) ELSE 18 + length({r}) + length({t}) END)"

    odd = " OR ".join(f"contains({c}, {quoted(s)})" for c in "tr" for s in signs)
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
UNION ALL SELECT -1, i, (['user', 'assistant'])[i + 1], '</s>[INST] ok [/INST]' FROM range(2) x(i))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
CASE WHEN bool_or({odd}) THEN {len(chat.ESCAPED)} + {length(True)} ELSE {len(chat.PLAIN)} + {length(False)} END::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": JACCARD,
        "mixing_targets": TARGETS,
        "op4_chat_round_trip": _formatted(),
        "op7_warc_normaliser": ARCHIVED,
        "fingerprint_texts": EDITED,
        "op10_embedding_near_dedup": LINKED,
        "op11_snapshot_difference": DIFFERENCE,
        "op13_merkle_manifest": _merkle(),
    }
