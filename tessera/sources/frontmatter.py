"""Frontmatter with nested lists and mappings, as a variant; for the block style of YAML that such blocks are written in.

Mappings and lists by indentation, flow lists and mappings on one line, quoted and plain scalars, folded and literal blocks, comments.
What isn't of this style (anchors, tags, several documents) makes the block no frontmatter, as malformed YAML does.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.text import by_parts

#: What plain scalars mean.
WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
NUMBER = re.compile(r"[-+]?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+][0-9]+)?")
KEY = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\s#&*!|>'"%@`{\[,?-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+(.*))?$""")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " "}


class Malformed(ValueError):
    pass


def _unquoted(text: str) -> str:
    if text[0] == "'":
        return text[1:-1].replace("''", "'")
    return re.sub(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES.get(m[3], m[3]), text[1:-1])


def _bare(line: str) -> str:
    """A line without a comment: a # after white space or at the begin, outside quotes."""
    for m in re.finditer(r""""(?:\\.|[^"\\])*"|(?<![^\s\[{,:])'(?:''|[^'])*'|(?:^|\s)#.*$""", line):
        if m[0].lstrip().startswith("#"):
            return line[: m.start()].rstrip()
    return line.rstrip()


def scalar(text: str) -> object:
    """A flow list or mapping, a quoted string, or a plain scalar."""
    value, rest = _flow(text.strip(), "") if text.strip()[:1] in ("[", "{") else (_plain(text.strip()), "")
    if rest.strip():
        raise Malformed(text)
    return value


def _plain(text: str) -> object:
    if text[:1] in ("'", '"'):
        if not re.fullmatch(r""""(?:\\.|[^"\\])*"|'(?:''|[^'])*'""", text):
            raise Malformed(text)
        return _unquoted(text)
    if text[:1] in ("&", "*", "!", "%", "@", "`"):
        raise Malformed(text)
    if text in WORDS:
        return WORDS[text]
    if NUMBER.fullmatch(text):
        return float(text) if re.search("[.eE]", text) else int(text)
    if re.search(r":(\s|$)", text):
        raise Malformed(text)
    return text


def _flow(text: str, ends: str) -> tuple[object, str]:
    """(value, rest) of a flow value that ``ends`` may end."""
    text = text.lstrip()
    if text[:1] in ("[", "{"):
        closing, out, text = {"[": "]", "{": "}"}[text[0]], [], text[1:]
        while not text.lstrip().startswith(closing):
            item, text = _flow(text, f",{closing}" + (":" if closing == "}" else ""))
            if closing == "}":
                if not text.startswith(":"):
                    raise Malformed(text)
                value, text = _flow(text[1:], ",}")
                item = (str(item), value)
            out.append(item)
            text = text.lstrip()
            if text.startswith(","):
                text = text[1:]
            elif not text.startswith(closing):
                raise Malformed(text)
        return (out if closing == "]" else dict(out)), text.lstrip()[1:]
    if text[:1] in ("'", '"'):
        m = re.match(r""""(?:\\.|[^"\\])*"|'(?:''|[^'])*'""", text)
        if not m:
            raise Malformed(text)
        return _unquoted(m[0]), text[m.end() :].lstrip()
    stop = next((i for i, c in enumerate(text) if c in ends and (c != ":" or text[i + 1 : i + 2] in ("", " ", ",", "}"))), None)
    if stop is None:
        raise Malformed(text)
    return _plain(text[:stop].strip()), text[stop:]


def parse(block: str) -> object:
    """The value of a block, by a stack of what is open: (indentation, container)."""
    raw = [x.expandtabs() if x.strip() else "" for x in block.splitlines()]
    lines = [(len(b) - len(b.lstrip()), b.strip(), i) for i, x in enumerate(raw) if (b := _bare(x)).strip()]
    if not lines:
        return {}
    at = 0

    def value_of(text: str, indent: int) -> object:
        """What stands after a key or a dash: a scalar, a block scalar, or what is indented below."""
        nonlocal at
        if re.fullmatch(r"[|>][-+]?", text):
            first = lines[at - 1][2] + 1
            last = next((i for i in range(first, len(raw)) if raw[i].strip() and len(raw[i]) - len(raw[i].lstrip()) <= indent), len(raw))
            while at < len(lines) and lines[at][2] < last:
                at += 1
            body = raw[first:last]
            margin = min((len(x) - len(x.lstrip()) for x in body if x.strip()), default=0)
            body = [x[margin:] for x in body]
            text_of = "\n".join(body).rstrip("\n") if text[0] == "|" else re.sub(r"\n+", lambda m: " " if len(m[0]) == 1 else m[0][1:], "\n".join(body).strip("\n"))
            return text_of + ("" if text.endswith("-") or not text_of else "\n")
        if text:
            return scalar(text)
        below = at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("- ") and not lines[at - 1][1].startswith("-"))
        return node(lines[at][0]) if below else None

    def node(indent: int) -> object:
        nonlocal at
        many = lines[at][1] == "-" or lines[at][1].startswith("- ")
        out: list | dict = [] if many else {}
        while at < len(lines) and lines[at][0] == indent:
            text, number = lines[at][1], lines[at][2]
            if many != (text == "-" or text.startswith("- ")):
                break
            if many:
                rest = text[1:].lstrip()
                inner = indent + len(text) - len(rest)
                if KEY.match(rest) and rest[:1] not in ("[", "{") or rest.startswith("- "):
                    lines[at] = (inner, rest, number)  # a mapping or list that begins on the dash's line
                    out.append(node(inner))
                else:
                    at += 1
                    out.append(value_of(rest, indent))
                continue
            found = KEY.match(text)
            if not found:
                if not out and len(lines) == 1:
                    at += 1
                    return scalar(text)
                raise Malformed(text)
            key = _unquoted(found[1]) if found[1][0] in "'\"" else found[1]
            if key in out:
                out.pop(key)
            at += 1
            out[key] = value_of((found[2] or "").strip(), indent)
        if at < len(lines) and lines[at][0] > indent:
            raise Malformed(lines[at][1])
        return out

    whole = node(lines[0][0])
    if at < len(lines):
        raise Malformed(lines[at][1])
    return whole


def split(text: str | None) -> tuple[dict, str | None]:
    """(mapping, body): a leading block between --- lines that is a mapping, else nothing and the whole text."""
    lines = (text or "").splitlines(keepends=True)
    if not lines or lines[0].strip() != "---" or not text.startswith("---"):
        return {}, text
    end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)
    if end is None:
        return {}, text
    try:
        found = parse("".join(lines[1:end]))
    except (Malformed, RecursionError):
        return {}, text
    return (found, "".join(lines[end + 1 :])) if isinstance(found, dict) else ({}, text)


@F.arrow_udf(S.StructType([S.StructField("meta", S.StringType()), S.StructField("body", S.StringType())]))
def _split(texts: pa.Array) -> pa.Array:
    def one(text: str | None) -> dict:
        meta, body = split(text)
        return {"meta": json.dumps(meta, ensure_ascii=False), "body": body}

    return by_parts(one, pa.struct([("meta", pa.string()), ("body", pa.string())]), texts)


def frontmatter(text: Column) -> Column:
    """struct(meta variant, body): ask meta with ``variant_get`` or ``try_variant_get`` and a path."""
    found = _split(text)
    return F.struct(F.parse_json(found["meta"]).alias("meta"), found["body"].alias("body"))


def has(meta: Column, path: str, value: str) -> Column:
    """Whether a list or a scalar of the frontmatter holds a string."""
    many = F.try_variant_get(meta, path, "array<string>")
    return F.coalesce(F.array_contains(many, value), F.try_variant_get(meta, path, "string") == value, F.lit(False))


def governance_fields(meta: Column) -> Column:
    """struct(document_id, doc_type, process_area, domain, status, title): trimmed strings, null where empty."""
    value = lambda k: F.nullif(F.trim(F.try_variant_get(meta, f"$.{k}", "string")), F.lit(""))
    return F.struct(F.coalesce(value("id"), value("document_id")).alias("document_id"), *(value(k).alias(k) for k in ("doc_type", "process_area", "domain", "status", "title")))
