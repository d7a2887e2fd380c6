"""Chunking: windows, paragraph packing, headings, line ranges, Python syntax.

What a chunk is depends on all that came before it in its document, and higher-order functions fold that one
interpreted expression after another.  So these columns are Arrow functions, one pass over each batch without a
shuffle; sizes count code points.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK_OVERLAP, CHUNK_SIZE
from ..functions.text import by_parts
from .scripts import declarations

HEADING = r"(#{1,3})\s+(.+)$"
TEXTS = "array<string>"


def _each(kind: str, arrow: pa.DataType, one: Callable) -> Callable[..., Column]:
    """A column function that reads its columns by Arrow batches: one call of ``one`` for each row, a part of the batch at a time, one pass, no shuffle."""

    @F.arrow_udf(kind)
    def single(x: pa.Array) -> pa.Array:
        return by_parts(one, arrow, x)

    @F.arrow_udf(kind)
    def double(x: pa.Array, y: pa.Array) -> pa.Array:
        return by_parts(one, arrow, x, y)

    return lambda *columns: (single if len(columns) == 1 else double)(*columns)


def windows(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Pieces of at most ``size``, each ``size - overlap`` after the one before, stripped; empty ones are dropped."""
    return _each(TEXTS, pa.list_(pa.string()), lambda t: _cut(t or "", size, overlap))(text)


def _pack(paragraphs: list[str], size: int, overlap: int, markdown: bool) -> list[str]:
    """Chunks of consecutive paragraphs: from each begin the window goes as far as the sums of lengths allow, and is written at its end."""
    ends = [p.rstrip() for p in paragraphs]
    reach = list(accumulate((2 + len(p) for p in ends), initial=0))  # what paragraphs add to a window that has begun
    too_long = [i for i, p in enumerate(paragraphs) if len(p) > size] + [len(paragraphs)]
    out: list[str] = []
    begin, lead = 0, ""
    while begin < len(paragraphs):
        head = f"{lead}\n\n{paragraphs[begin]}".strip() if lead else paragraphs[begin]
        lead, end = "", begin + 1
        if len(head) > size:
            out += _cut(head, size, overlap)
            begin = end
            continue
        fits = bisect_right(reach, reach[end] + size - len(head.lstrip())) - 1
        end = max(end, min(fits, too_long[bisect_left(too_long, end)]))
        window = "\n\n".join([head.lstrip(), *ends[begin + 1 : end]]) if end > begin + 1 else head
        out.append(window.strip())
        if end < len(paragraphs) and len(paragraphs[end]) <= size and overlap > 0 and (not markdown or len(window) > overlap):
            lead = window[-overlap:]
        begin = end
    return [x for x in out if x]


def pack(paragraphs: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, *, markdown: bool = True) -> Column:
    """Paragraphs packed greedily into chunks of at most ``size``; a new chunk begins with the tail of the last."""
    return _each(TEXTS, pa.list_(pa.string()), lambda p: None if p is None else _pack(p, size, overlap, markdown))(paragraphs)


def _markdown_paragraphs(text: str) -> list[str]:
    return [p for x in re.split(r"\n\s*\n", text) if (p := x.strip())]


def markdown_paragraphs(text: Column) -> Column:
    return _each(TEXTS, pa.list_(pa.string()), lambda t: None if t is None else _markdown_paragraphs(t))(text)


def _code(text: str, size: int, overlap: int) -> list[str]:
    body = text.strip()
    if len(body) <= size:
        return [body] if body else []
    return _pack([p for p in body.split("\n\n") if p.strip()], size, overlap, False)


def code_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks of code without a parser: the whole text if it fits, else packed paragraphs."""
    return _each(TEXTS, pa.list_(pa.string()), lambda t: _code(t or "", size, overlap))(text)


def _sections(text: str) -> list[tuple[str | None, str]]:
    out: list[tuple[str | None, list[str]]] = [(None, [])]
    for line in text.splitlines():
        if head := re.match(HEADING, line):
            out.append((head[2].strip(), [line]))
        else:
            out[-1][1].append(line)
    return [(name, body) for name, lines in out if (body := "\n".join(lines).strip())]


def sections(text: Column) -> Column:
    """array(struct(section, body)): each heading of one to three signs begins a section that holds its line."""
    kind = pa.list_(pa.struct([("section", pa.string()), ("body", pa.string())]))
    return _each("array<struct<section:string,body:string>>", kind, lambda t: [{"section": s, "body": b} for s, b in _sections(t or "")])(text)


def _markdown(text: str, size: int, overlap: int) -> list[dict]:
    return [{"section": s, "content": c} for s, body in _sections(text) for c in ([body] if len(body) <= size else _pack(_markdown_paragraphs(body), size, overlap, True))]


def markdown_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """array(struct(section, content)) by headings, then paragraphs."""
    kind = pa.list_(pa.struct([("section", pa.string()), ("content", pa.string())]))
    return _each("array<struct<section:string,content:string>>", kind, lambda t: _markdown(t or "", size, overlap))(text)


def _lines(text: str | None, contents: list[str | None] | None) -> list[dict | None] | None:
    if contents is None:
        return None
    out: list[dict | None] = []
    cursor = 0
    for c in contents:
        at = -1
        if text is not None and c:
            at = text.find(c, cursor)
            at = text.find(c) if at < 0 else at
        if at < 0:
            out.append(None)
            continue
        first = text.count("\n", 0, at) + 1
        out.append({"start_line": first, "end_line": first + c.count("\n")})
        cursor = at + max(1, len(c) // 4)
    return out


def line_ranges(text: Column, contents: Column) -> Column:
    """array(struct(start_line, end_line)) of contents that occur verbatim, searched from a cursor on, else from the beginning."""
    kind = pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32())]))
    return _each("array<struct<start_line:int,end_line:int>>", kind, _lines)(text, contents)


UNIT = pa.struct([("content", pa.string()), ("section", pa.string()), ("symbol", pa.string()), ("symbol_kind", pa.string()), ("chunk_key", pa.string()), ("imports", pa.list_(pa.string()))])
UNITS = "array<struct<content:string,section:string,symbol:string,symbol_kind:string,chunk_key:string,imports:array<string>>>"
#: Languages that are cut by their syntax, by suffix.
SYNTAX = {".py": "python", ".js": "script", ".jsx": "script", ".ts": "script", ".tsx": "script"}


def explode_chunks(docs: DataFrame, *, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """A row per chunk of ``docs`` (type, file, language, content, ...), with section, chunk_index, lines, and what is known of a symbol.

    Documentation, governance documents and .md files go by headings, Python, JavaScript and TypeScript files by their
    syntax, other code by paragraphs, as do files without a symbol or that don't parse.  Chunks of code have a chunk_key that stays
    when white space or other symbols change.
    """
    file = F.lower("file")
    as_markdown = F.col("type").isin("documentation", "lis") | F.endswith(file, F.lit(".md"))
    ways = F.create_map(*(F.lit(x) for kv in SYNTAX.items() for x in kv))
    way = F.when(as_markdown, "markdown").otherwise(F.coalesce(F.element_at(ways, F.regexp_extract(file, r"\.[^./]*$", 0)), F.lit("code")))

    def split(text: str | None, way: str) -> list[dict]:
        if way == "markdown":
            return _markdown(text or "", size, overlap)
        return source_units(text or "", way, size, overlap)

    found = docs.withColumn("chunks", _each(UNITS, pa.list_(UNIT), split)(F.col("content"), way))
    found = found.withColumn("lines", line_ranges(F.col("content"), F.transform("chunks", lambda c: c["content"])))
    kept = [c for c in docs.columns if c != "content"]
    found = found.select(*kept, F.posexplode(F.arrays_zip("chunks", "lines")).alias("chunk_index", "c"))
    known = [F.col(f"c.chunks.{n}").alias(n) for n in ("symbol", "symbol_kind", "chunk_key", "imports")]
    return found.select(*kept, "chunk_index", F.col("c.chunks.section").alias("section"), F.col("c.chunks.content").alias("content"), F.col("c.lines.start_line").alias("start_line"), F.col("c.lines.end_line").alias("end_line"), *known)


def source_units(text: str, way: str, size: int, overlap: int) -> list[dict]:
    """Chunks of a source file: its symbols, or packed paragraphs with a key of their number."""
    units = python_units(text, size, overlap) if way == "python" else script_units(text, size, overlap) if way == "script" else None
    return units or [{"section": None, "content": c, "symbol": None, "symbol_kind": None, "chunk_key": f"size:{i}", "imports": []} for i, c in enumerate(_code(text, size, overlap))]


def script_units(text: str, size: int, overlap: int) -> list[dict]:
    """Top-level functions and classes of a JavaScript or TypeScript file; none where there are none."""
    found, imports = declarations(text)
    return [u for kind, name, source in found for u in _unit(source, name, kind, f"{kind}:{name}", imports, size, overlap)]


def _unit(content: str, symbol: str, kind: str, key: str, imports: list[str], size: int, overlap: int, section: str | None = None) -> list[dict]:
    """The chunks of one symbol, numbered if it takes several."""
    pieces = _cut(content, size, overlap)
    named = {"section": section or symbol, "symbol": symbol, "symbol_kind": kind, "imports": imports}
    return [{"content": p, "chunk_key": f"{key}#{i}" if len(pieces) > 1 else key, **named} for i, p in enumerate(pieces)]


def _cut(text: str, size: int, overlap: int) -> list[str]:
    body = text.strip()
    if len(body) <= size:
        return [body] if body else []
    step = max(1, size - max(0, overlap))
    count = -(-(len(body) - size) // step) + 1
    return [p for i in range(count) if (p := body[i * step : i * step + size].strip())]


def python_units(text: str, size: int, overlap: int) -> list[dict] | None:
    """Symbols of a Python file; None if it doesn't parse or has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return None
    lines = text.splitlines(keepends=True)
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    imports = [n for x in tree.body for n in ([a.name for a in x.names] if isinstance(x, ast.Import) else [x.module or ""] if isinstance(x, ast.ImportFrom) else [])]
    found: list[dict] = []

    def add(content: str, symbol: str, kind: str, key: str, section: str | None = None) -> None:
        found.extend(_unit(content, symbol, kind, key, imports, size, overlap, section))

    def source(first: int, last: int) -> str:
        return "".join(lines[first - 1 : last])

    if doc := ast.get_docstring(tree):
        add(doc, "<module>", "module", "module:docstring", "module:docstring")
    for node in tree.body:
        if isinstance(node, functions):
            add(source(node.lineno, node.end_lineno), node.name, "function", f"function:{node.name}")
        elif isinstance(node, ast.ClassDef):
            last = node.lineno
            for child in node.body:
                if isinstance(child, (*functions, ast.ClassDef)):
                    break
                last = child.end_lineno or child.lineno
            add(source(node.lineno, last), node.name, "class", f"class:{node.name}")
            for child in node.body:
                if isinstance(child, functions):
                    name = f"{node.name}.{child.name}"
                    add(source(child.lineno, child.end_lineno), name, "method", f"method:{name}")
    return found or None


def source_chunks(docs: DataFrame, way: str, *, key: str = "document_id", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """key, chunk_index, content, section, symbol, symbol_kind, chunk_key, imports of sources (key, content) of one language: python, script or code."""
    units = _each(UNITS, pa.list_(UNIT), lambda t: source_units(t or "", way, size, overlap))(F.col("content"))
    return docs.select(key, F.posexplode(units).alias("chunk_index", "u")).select(key, "chunk_index", "u.*")


def python_chunks(docs: DataFrame, *, key: str = "document_id", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    return source_chunks(docs, "python", key=key, size=size, overlap=overlap)


def script_chunks(docs: DataFrame, *, key: str = "document_id", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    return source_chunks(docs, "script", key=key, size=size, overlap=overlap)
