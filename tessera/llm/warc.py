"""WARC archives: written, normalised to one gzip member per record with an offset index, and read back.

Writing takes three steps per partition.  Records go into one monolithic gzip stream; the normaliser
inflates that stream once, front to back, finds each record by its Content-Length, and rewrites it as a
gzip member of its own; a sidecar index says where each member begins.  Reading takes the sidecar's rows
and opens the archives at those offsets.

Of records with equal payloads of at least ``least`` bytes the one with the smallest id is a response,
the others revisit it and carry no payload.  Equality is by SHA-256; a digest's smallest id comes from an
aggregation with partial minima.

Cases: a null html is an empty payload; null urls are written as empty; rows of one id and equal payload
are each a response if theirs is the smallest id; a null id is never referred to, and its record is a
response; an empty table writes no archive; extra columns are ignored.  Archives go to the shared
checkpoint folder, each under its task attempt's name; the sidecar names those of the attempts that
succeeded, so a task that runs again leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut

#: Payloads below this many bytes are never revisited.
LEAST = 100
BLOCK = 1 << 20
END = b"\r\n\r\n"


def open_store(uri: str):
    """(file system, path) of a folder, by whatever scheme the cluster uses."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


NULL = "<urn:null>"
#: Signs that may stand in an address; a url with white space or control characters is quoted whole, and marked so.
ADDRESS = ":/?#[]@!$&'()*+,;=-._~"


def name_of(page: str | None) -> str:
    return NULL if page is None else f"<urn:page:{quote(page, safe='')}>"


def page_of(name: str | None) -> str | None:
    return None if name in (None, NULL) else unquote(name[len("<urn:page:") : -1])


def record(page: str | None, url: str, payload: bytes | None, digest: str, size: int, refers: str | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    kind = "response" if refers is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name_of(page)}",
        *([f"WARC-Target-URI: {quote(url, safe=ADDRESS)}", "X-Target-URI-Quoted: yes"] if re.search(r"[\s\x00-\x1f\x7f]", url) else [f"WARC-Target-URI: {url}"]),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name_of(refers)}"]
    body = payload if refers is None else b""
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + END + body + END


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}


class Records:
    """Records out of inflated bytes that arrive piece by piece."""

    def __init__(self) -> None:
        self.rest = bytearray()
        self.need = 0

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.rest += data
        while len(self.rest) >= self.need:
            if (stop := self.rest.find(END)) < 0:
                self.need = len(self.rest) + 1
                return
            total = stop + 4 + int(fields(bytes(self.rest[:stop]))["content-length"]) + 4
            if len(self.rest) < total:
                self.need = total
                return
            yield bytes(self.rest[:total])
            del self.rest[:total]
            self.need = 0


def normalise(source, target, index) -> int:
    """Rewrite a monolithic gzip stream as one member per record; index rows go to ``index``. Returns the records."""
    stream, found, at, n = zlib.decompressobj(31), Records(), 0, 0
    while data := source.read(BLOCK):
        plain = stream.decompress(data)
        while stream.eof and stream.unused_data:
            left = stream.unused_data
            stream = zlib.decompressobj(31)
            plain += stream.decompress(left)
        for rec in found.feed(plain):
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = pack.compress(rec) + pack.flush()
            target.write(member)
            head = fields(rec[: rec.index(END)])
            index.write((json.dumps({"offset": at, "length": len(member), "id": head["warc-record-id"], "type": head["warc-type"]}) + "\n").encode())
            at, n = at + len(member), n + 1
    if found.rest:
        raise ValueError("the archive ends inside a record")
    return n


def write_archives(pages: DataFrame, folder: str | None = None, *, least: int = LEAST) -> DataFrame:
    """Write all pages; returns the sidecar: archive, offset, length, and page_id in the type that it has in ``pages``."""
    kind = pages.schema["page_id"].dataType.simpleString()
    base = folder or f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    first = cut(rows.where(f"size >= {least} AND page_id IS NOT NULL").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    refers = F.when((F.col("size") >= least) & (F.col("page_id") > F.col("first")), F.col("first").cast("string"))
    rows = rows.join(first, "digest", "left").select(
        F.col("page_id").cast("string").alias("page"), "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "digest", F.col("size").cast("bigint").alias("size"), refers.alias("refers")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(base)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        own = f"{path}/{name}"
        pack, n, out = zlib.compressobj(6, zlib.DEFLATED, 31), 0, None
        for b in batches:
            if b.num_rows and out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{own}.tmp")
            for page, url, payload, digest, size, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.write(pack.compress(record(page, url, payload, digest, size, refers)))
                n += 1
        if out is None:
            return
        out.write(pack.flush())
        out.close()
        with store.open_input_stream(f"{own}.tmp", compression=None) as whole, store.open_output_stream(f"{own}.gz.tmp", compression=None) as target, store.open_output_stream(f"{own}.cdx.tmp", compression=None) as index:
            if normalise(whole, target, index) != n:
                raise ValueError("the normaliser lost records")
        store.delete_file(f"{own}.tmp")
        with store.open_input_stream(f"{own}.cdx.tmp", compression=None) as f:
            lines = [json.loads(x) for x in f.read().splitlines()]
        store.move(f"{own}.gz.tmp", f"{path}/{name}.warc.gz")
        store.move(f"{own}.cdx.tmp", f"{path}/{name}.cdxj")
        yield pa.RecordBatch.from_arrays([pa.array([f"{base}/{name}.warc.gz"] * n, pa.string()), pa.array([x["offset"] for x in lines], pa.int64()), pa.array([x["length"] for x in lines], pa.int64()), pa.array([page_of(x["id"]) for x in lines], pa.string())], names=["archive", "offset", "length", "page_id"])

    sidecar = cut(rows.mapInArrow(write, "archive string, offset bigint, length bigint, page_id string"))
    return sidecar.withColumn("page_id", F.col("page_id").cast(kind))


def read_archives(sidecar: DataFrame, *, payloads: bool = True) -> DataFrame:
    """page_id, url, payload (if asked for), payload_bytes, payload_digest, record_type, refers_to of each indexed record.

    Digest and length are those of payloads that are read: a response's own, and for a revisit, which has none, those of
    the response that it refers to; the job fails where there is no such response with the digest that the revisit names.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        opened, name = None, None
        for b in batches:
            out = []
            for archive, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive != name:
                    if opened:
                        opened.close()
                    store, path = open_store(archive)
                    opened, name = store.open_input_file(path), archive
                rec = zlib.decompress(opened.read_at(length, offset), 31)
                stop = rec.index(END)
                head, body = fields(rec[:stop]), rec[stop + 4 : -4]
                url = head["warc-target-uri"]
                if head["warc-type"] == "response":
                    size, digest = len(body), hashlib.sha256(body).hexdigest()
                else:
                    size, digest, body = None, head["warc-payload-digest"].removeprefix("sha256:"), None
                out.append((page_of(head["warc-record-id"]), unquote(url) if "x-target-uri-quoted" in head else url, body if payloads else None, size, digest, head["warc-type"], page_of(head.get("warc-refers-to"))))
            if out:
                kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if opened:
            opened.close()

    kind = sidecar.schema["page_id"].dataType.simpleString()
    rows = sidecar.select("archive", "offset", "length").mapInArrow(
        read, "page_id string, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
    )
    rows = rows if payloads else cut(rows.drop("payload"))
    targets = rows.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("referred")).distinct()
    rows = rows.join(targets, ["refers_to", "payload_digest"], "left")
    size = F.coalesce("payload_bytes", "referred", F.raise_error(F.lit("a revisit refers to no response with its digest")).cast("bigint"))
    columns = ["page_id", "url", *(["payload"] if payloads else []), "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return rows.withColumns({"payload_bytes": size, "page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)}).select(*columns)
