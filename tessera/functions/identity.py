"""Identity of documents and chunks: normal paths, chunk keys, hashes and name-based UUIDs, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Fixed value: the namespace of point ids.
NAMESPACE = "a4e2e5e06b8a4f3d9c1e2d7f8a9b0c3e"


def document_id(path: Column) -> Column:
    """Forward slashes, no white space around, no leading ./ (repeated)."""
    return F.regexp_replace(strip(F.replace(path, F.lit("\\"), F.lit("/"))), r"^(\./)+", "")


def chunk_key(symbol: Column, section: Column, index: Column) -> Column:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    n = index.cast("string")
    return F.when(has(symbol), F.concat(F.lit("symbol:"), symbol)).when(has(section), F.concat(F.lit("section:"), section, F.lit("|"), n)).otherwise(F.concat(F.lit("chunk:"), n))


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """RFC 4122 version 5: SHA-1 of namespace and name, with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 8))
    part = lambda a, n: F.substring(digest, a, n)
    dash = F.lit("-")
    return F.concat(part(1, 8), dash, part(9, 4), dash, F.lit("5"), part(14, 3), dash, variant, part(18, 3), dash, part(21, 12))


def point_id(workspace: Column, source: Column, document: Column, key: Column, index: Column) -> Column:
    return uuid5(F.concat_ws("|", workspace, source, document, key, index.cast("string")))


def scope_key(workspace: Column, source: Column, mode: Column, files: Column) -> Column:
    """The idempotency key of a job: its scope and sorted files."""
    return F.sha2(F.concat_ws("|", workspace, source, mode, F.array_join(F.array_sort(files), ",")), 256)
