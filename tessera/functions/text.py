"""Text functions as columns: tokens, overlap, blending, requirement ids, redaction."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: The query tokenizer, requirement ids, credentials that are redacted.
TOKEN = r"(?i)[a-z0-9_./-]+"
REQUIREMENT_IDS = (r"REQ-\d+", r"KR-\d+", r"US-\d+")
SECRETS = (r"(?i)(api[_-]?key|token|password|secret)\s*[:=]\s*\S+", r"(?i)bearer\s+[a-z0-9._\-]+", r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
#: Bytes of rows that are Python objects at a time.
PART = 1 << 20
#: White space as Python's strip() sees it, as a class for Java's patterns.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"
#: Line ends as Python's splitlines() sees them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def _folding() -> tuple[str, str]:
    """Small letters with marks and their plain forms, by the rule of decomposition; then the marks themselves, which go."""
    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)) if unicodedata.decomposition(chr(c)) and chr(c).lower() == chr(c)]
    plain = {x: "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)) for x in letters}
    plain = {x: p for x, p in plain.items() if len(p) == 1 and p.isalpha() and p != x}
    return "".join(plain) + "".join(map(chr, range(0x300, 0x370))), "".join(plain.values())


#: The folding of keyword search, for documents and queries alike.
MARKED, PLAIN = _folding()


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside a lambda an outer expression is computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def query_tokens(query: str) -> list[str]:
    """Distinct lower-case tokens of more than one character, at plan time."""
    return sorted({t.lower() for t in re.findall(TOKEN, query or "", re.ASCII) if len(t) > 1})


def tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, lambda t: F.length(t) > 1), F.lower))


def overlap(query: str | Column, content: Column, file: Column) -> Column:
    """Share of the query's tokens that occur as substrings of content and file, in lower case."""
    text = F.lower(F.concat(F.coalesce(content, F.lit("")), F.lit(" "), F.coalesce(file, F.lit(""))))
    if isinstance(query, str):
        wanted = query_tokens(query)
        if not wanted:
            return F.lit(0.0)
        hits = sum((F.contains(text, F.lit(t)).cast("int") for t in wanted), F.lit(0))
        return hits / F.lit(float(len(wanted)))
    share = lambda text, wanted: F.when(F.size(wanted) > 0, F.size(F.filter(wanted, lambda t: F.contains(text, t))) / F.size(wanted)).otherwise(0.0)
    return let(text, lambda x: let(tokens(query), lambda wanted: share(x, wanted)))


def weights(vector: float, lexical: float) -> tuple[float, float]:
    v, w = max(0.0, float(vector)), max(0.0, float(lexical))
    return (v / (v + w), w / (v + w)) if v + w > 0 else (1.0, 0.0)


def blend(score: Column, lexical: Column, vector_weight: float, lexical_weight: float) -> Column:
    v, w = weights(vector_weight, lexical_weight)
    return F.lit(v) * score + F.lit(w) * lexical


def requirement_ids(text: Column, patterns: tuple[str, ...] = REQUIREMENT_IDS) -> Column:
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?i){p}"), F.lit(0)) for p in patterns]
    return F.array_sort(F.array_distinct(F.transform(F.concat(*found), F.upper)))


def is_requirement_id(value: str, patterns: tuple[str, ...] = REQUIREMENT_IDS) -> bool:
    return any(re.fullmatch(p, value.strip(), re.IGNORECASE) for p in patterns)


def normalise_requirement(value: str) -> str:
    value = value.strip()
    return value.upper() if is_requirement_id(value) else value


def requirement_source(section: Column, content: Column) -> Column:
    """What ids are looked for in: the section, if any, and the content."""
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(section, F.lit("\n"), content)).otherwise(content)


def redact(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def snippet(content: Column, chars: int = 160) -> Column:
    return strip(F.regexp_replace(F.substring(content, 1, chars), f"{SPACE}+", " "))


def fold(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), MARKED, PLAIN)


_FOLD = {ord(m): PLAIN[i] if i < len(PLAIN) else None for i, m in enumerate(MARKED)}
_WORD = re.compile(r"[^\W_]+")


def fold_query(text: str) -> str:
    """``fold`` of one text."""
    return text.lower() if text.isascii() else text.lower().translate(_FOLD)


def word_list(text: str | None) -> list[str]:
    """``words`` of one text."""
    return _WORD.findall(fold_query(text or ""))


def parts(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows of a batch that hold some PART bytes, or one row."""
    ends, at = np.zeros(len(columns[0]), np.int64), 0
    for c in columns:
        flat = pa.types.is_string(c.type) or pa.types.is_large_string(c.type)
        size = pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False) if flat else np.full(len(c), c.nbytes // max(1, len(c)))
        ends += np.cumsum(size, dtype=np.int64)
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, side="right")))
        yield at, to
        at = to


def by_parts(one: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``one`` of each row of a batch; Python's objects are there for a part at a time, what they become lies in Arrow."""
    rows = lambda a, z: zip(*(c.slice(a, z - a).to_pylist() for c in columns), strict=True)
    return pa.concat_arrays([pa.array([], kind), *(pa.array([one(*row) for row in rows(a, z)], kind) for a, z in parts(*columns))])


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: 1 in words, 0 between them, 2 for marks that go; and what it folds to."""
    kind, plain = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    kind[np.frombuffer("".join(_WORD.findall(every)).encode("utf-32-le"), np.uint32)] = 1
    for c, p in _FOLD.items():
        kind[c], plain[c] = (2, c) if p is None else (1, ord(p))
    return kind, plain


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def word_spots(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``word_list`` of many texts by a few passes: (folded code points, first of each word, end of each word, first word of each text)."""
    if not _tables:
        _tables.append(_kinds())
    kinds, plain = _tables[0]
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))])
    kind = kinds[points]
    if len(gone := np.flatnonzero(kind == 2)):
        kept = kind != 2
        points, kind, bounds = points[kept], kind[kept], bounds - np.searchsorted(gone, bounds)
    edge = np.zeros(len(points) + 1, bool)
    edge[bounds] = True
    inside = np.concatenate([[False], kind == 1, [False]])
    first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return plain[points], first, end, np.searchsorted(first, bounds)


@F.arrow_udf(S.ArrayType(S.StringType()))
def _words(texts: pa.Array) -> pa.Array:
    out = [pa.array([], pa.list_(pa.string()))]
    for a, z in parts(texts):
        points, first, end, own = word_spots(texts.slice(a, z - a).to_pylist())
        step = np.zeros(len(points) + 1, np.int8)
        step[first] = 1
        step[end] -= 1
        chars = points[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
        width = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        offsets = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(end - first)])].astype(np.int32)
        found = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(chars.tobytes().decode("utf-32-le").encode())])
        out.append(pa.ListArray.from_arrays(pa.array(own, pa.int32()), found))
    return pa.concat_arrays(out)


def words(text: Column) -> Column:
    """Terms of keyword search in order: runs of letters and numbers of the folded text, by Arrow batches."""
    return _words(text)


def metric_key(name: Column, labels: Column) -> Column:
    """name{k="v",...} with sorted labels, from a map."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return F.when(F.size(labels) > 0, F.concat(name, F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(name)
