"""Files as documents: discovery under sources, policy, adapters, frontmatter, manifests."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import identity as I
from ..functions import paths as P
from ..functions.text import strip

#: Adapters in registry order, media types and languages by suffix.
MARKDOWN_SUFFIXES = (".md", ".markdown")
FILE_LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".json": "json", ".yaml": "yaml", ".yml": "yaml"}
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
FRONTMATTER = r"(?s)\A---[ \t]*\r?\n(.*?\r?\n)?---[ \t]*(?:\r?\n|\z)"
LIS_FIELDS = ("doc_type", "process_area", "domain", "status", "title")

RELATIONSHIP = S.StructType([S.StructField(n, S.StringType()) for n in ("target", "type", "description")])
SOURCE = S.StructType([S.StructField(n, S.StringType()) for n in ("id", "path", "type", "adapter", "description")] + [S.StructField(n, S.ArrayType(S.StringType())) for n in ("include", "exclude")])
WORKSPACE = S.StructType(
    [S.StructField("workspace_id", S.StringType())]
    + [S.StructField(n, S.StringType()) for n in ("name", "description")]
    + [S.StructField(n, S.ArrayType(S.StringType())) for n in ("technologies", "tags", "instructions")]
    + [S.StructField("sources", S.ArrayType(SOURCE)), S.StructField("relationships", S.ArrayType(RELATIONSHIP))]
)


def workspaces(spark: SparkSession, manifests: list[dict]) -> DataFrame:
    """Workspace manifests (parsed YAML or JSON) as a table; unknown fields, versions and repeated ids are refused."""
    known = {"schema_version", "id", "name", "description", "technologies", "tags", "instructions", "roots", "relationships"}
    rows, seen = [], set()
    for m in manifests:
        if unknown := set(m) - known:
            raise ValueError(f"unknown fields in a manifest: {sorted(unknown)}")
        if m.get("schema_version") != 1:
            raise ValueError("a manifest needs schema_version 1")
        roots = m.get("roots") or []
        if not roots or len({r["id"] for r in roots}) != len(roots):
            raise ValueError("a manifest needs roots, each with an id of its own")
        if m["id"] in seen:
            raise ValueError(f"workspace {m['id']!r} is there twice")
        seen.add(m["id"])
        sources = [tuple(r.get(n) for n in ("id", "path", "type", "adapter", "description", "include", "exclude")) for r in roots]
        relations = [tuple(r.get(n) for n in ("target", "type", "description")) for r in m.get("relationships") or []]
        rows.append((m["id"], m.get("name"), m.get("description"), *(m.get(n) or [] for n in ("technologies", "tags", "instructions")), sources, relations))
    return spark.createDataFrame(rows, WORKSPACE)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder: path (absolute), length, content; content is only read for rows that stay.

    Spark's listing skips names that begin with . or _; such a folder is a root of its own to be scanned.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", "^[a-z]+:/+", "/").alias("path"), "length", "content")


def discover(files: DataFrame, sources: list[dict], *, policy: P.PathPolicy | None = None, ignore: tuple[str, ...] = (".git", "node_modules", "__pycache__")) -> DataFrame:
    """``files`` that a source takes: source_id, bucket, identity (path below the root), deny_reason.

    A source (id, root, type, include, exclude) includes all by default; of sources that take one file the
    later wins.  Rules are compiled when planning, so this is a projection and one aggregation of paths.
    """
    taken = None
    for position, s in enumerate(sources):
        root = s["root"].rstrip("/") + "/"
        inside = F.startswith("path", F.lit(root))
        rest = F.substring("path", len(root) + 1, 1_000_000)
        includes = s.get("include") or ["**/*"]
        match = F.lit(False)
        for glob in includes:
            match = match | F.rlike(rest, F.lit(P.path_glob_pattern(glob)))
        own = inside & match & ~P.excluded(rest, tuple(s.get("exclude") or ())) & ~P.ignored(rest, ignore)
        item = F.when(own, F.struct(F.lit(position).alias("position"), F.lit(s["id"]).alias("source_id"), P.bucket_of(F.lit(s.get("type"))).alias("bucket"), rest.alias("identity")))
        taken = item if taken is None else F.coalesce(item, taken)
    rows = files.withColumn("s", taken).where("s IS NOT NULL")
    reason = P.deny_reason(F.col("path"), F.col("length"), policy, tuple(s["root"] for s in sources))
    return rows.withColumn("deny_reason", reason).select("*", "s.source_id", "s.bucket", "s.identity").drop("s")


def read_text(content: Column) -> Column:
    """UTF-8 with U+FFFD for what is malformed."""
    return F.expr("make_valid_utf8(cast(content AS STRING))") if content is None else F.call_function("make_valid_utf8", content.cast("string"))


def adapter(path: Column, preferred: Column | None = None) -> Column:
    """The adapter of a path: the preferred one if it takes the suffix, else the first that does, else the file adapter."""
    ext = P.suffix(path)
    usual = F.when(ext.isin(*MARKDOWN_SUFFIXES), "markdown").when(ext == ".pdf", "pdf").when(ext == ".docx", "docx").otherwise("filesystem")
    if preferred is None:
        return usual
    takes = (preferred.isin("filesystem", "external_mirror")) | (preferred == usual)
    return F.when(takes, preferred).otherwise(usual)


def extract(files: DataFrame, *, preferred: str | None = None) -> DataFrame:
    """document_id, path, text, media_type, language, adapter, metadata of files (path, content).

    Text is decoded in the JVM; only PDF and DOCX rows go through Python.
    """
    name = adapter(F.col("path"), F.lit(preferred) if preferred else None)
    languages = F.create_map(*(F.lit(x) for kv in FILE_LANGUAGES.items() for x in kv))
    rows = files.withColumn("adapter", name)
    plain = rows.where("adapter NOT IN ('pdf', 'docx')").withColumn("text", read_text(F.col("content"))).withColumn("metadata", F.when(F.col("adapter") == "external_mirror", F.create_map(F.lit("mirror"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>")))
    packed = rows.where("adapter IN ('pdf', 'docx')").select("path", "content", "adapter").mapInArrow(_documents, "path string, adapter string, text string, metadata map<string,string>")
    both = plain.select("path", "adapter", "text", "metadata").unionByName(packed)
    mark = P.suffix(F.col("path")).isin(*MARKDOWN_SUFFIXES)
    media = F.when(F.col("adapter") == "pdf", "application/pdf").when(F.col("adapter") == "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document").when(mark, "text/markdown").otherwise("text/plain")
    language = F.when(mark, "markdown").otherwise(F.element_at(languages, P.suffix(F.col("path"))))
    return both.select(I.document_id(F.col("path")).alias("document_id"), "path", "text", media.alias("media_type"), language.alias("language"), "adapter", "metadata")


def _documents(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in stream:
        texts, notes = [], []
        for raw, kind in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            text, note = (pdf_text if kind == "pdf" else docx_text)(raw)
            texts.append(text)
            notes.append(list(note.items()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(texts, pa.string()), pa.array(notes, pa.map_(pa.string(), pa.string()))], names=["path", "adapter", "text", "metadata"])


def docx_text(raw: bytes) -> tuple[str, dict[str, str]]:
    """Non-empty paragraphs, a line each; a DOCX is a zip of XML."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        tree = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ["".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in tree.iter(f"{WORD}p")]
    return "\n".join(x for x in lines if x.strip()), {}


def pdf_text(raw: bytes) -> tuple[str, dict[str, str]]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs pypdf") from e
    pages = PdfReader(io.BytesIO(raw)).pages
    return "\n".join(p.extract_text() or "" for p in pages), {"pages": str(len(pages))}


def split_frontmatter(text: Column) -> Column:
    """struct(meta, body): the block between leading --- lines as a map of its plain ``key: value`` lines; none, and the whole text, without one."""
    block = F.regexp_extract(text, FRONTMATTER, 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: F.rlike(x, F.lit(r"^[A-Za-z_][\w-]*:(?:\s|$)")))
    quote = lambda v: F.regexp_replace(v, r"""^(["'])(.*)\1$""", "$2")
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([^:]+):", 1).alias("key"), quote(strip(F.regexp_extract(x, r"^[^:]+:(.*)$", 1))).alias("value")))
    has = F.rlike(text, F.lit(FRONTMATTER))
    unique = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])))
    meta = F.when(has, unique).otherwise(F.create_map().cast("map<string,string>"))
    return F.struct(meta.alias("meta"), F.when(has, F.regexp_replace(text, FRONTMATTER, "")).otherwise(text).alias("body"))


def lis_fields(meta: Column) -> Column:
    """struct(document_id, doc_type, ...) of a frontmatter map; empty values are null."""
    value = lambda k: F.nullif(strip(F.element_at(meta, k)), F.lit(""))
    return F.struct(F.coalesce(value("id"), value("document_id")).alias("document_id"), *(value(k).alias(k) for k in LIS_FIELDS))


def document_slice(text: Column, start: int | None = None, end: int | None = None, *, feeds: bool = False) -> Column:
    """struct(content, start_line, end_line, total_lines): an inclusive range of lines, clamped, with their ends.

    With ``feeds`` a line feed alone parts lines: what follows the last one is a line too, and contents end without one of their own.
    """
    lines = F.split(text, "\n") if feeds else F.filter(F.split(text, r"(?<=\n)|(?<=\r)(?!\n)"), lambda x: x != "")
    total = F.size(lines)
    first = F.least(F.greatest(F.lit(start or 1), F.lit(1)), total + 1)
    last = F.least(F.greatest(F.lit(end) if end is not None else total, F.lit(0)), total)
    body = F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n" if feeds else "")
    some = total > 0
    return F.struct(body.alias("content"), F.when(some, first).alias("start_line"), F.when(some, last).alias("end_line"), total.alias("total_lines"))
