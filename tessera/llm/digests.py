"""Canonical exact digests of documents, and of an edited text of each.

Canonical form: Unicode NFKC, case folded, NFKC again, runs of white space as one space, none at the
ends.  The fingerprint is the 128-bit xxhash of its UTF-8 bytes; inside equal buckets the bytes
themselves are compared, and where they differ the fingerprint gets a second, independent hash.

The edited text of a document needs the document that follows in descending id order.  Documents are
range partitioned by id, once; each partition reads its successors as it streams, and only the
first row of each partition and the last of the one before meet in a second, small step.

Cases: a null text is an empty one, and empty texts are equal; a null id sorts after all others; equal
ids are ordered by text; the last row is followed by the first, so a single row follows itself; an
empty table gives no rows; ids of any type that sorts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import cut, small

ROW, FIRST, LAST = 0, 1, 2
COLUMNS = "n_chars bigint, edited_sha256 string, hash string, hash2 string, edited_hash string, edited_hash2 string, near_edited double, near_next double"


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    form = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(unicodedata.normalize("NFKC", form).split())


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many, or all, of the next text's first."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def wide(form: str) -> tuple[str, str]:
    raw = form.encode("utf-8", "surrogatepass")
    return xxhash.xxh3_128_hexdigest(raw), xxhash.xxh3_128_hexdigest(raw, seed=0x5EED)


def measures(text: str, form: str, following: str, next_form: str, wide: Callable[[str], tuple[str, str]] = wide) -> tuple:
    changed = edited(text, following)
    changed_form = canonical(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return (len(text), sha, *wide(form), *wide(changed_form), float(form == changed_form), float(form == next_form))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int | None = None, wide: Callable[[str], tuple[str, str]] = wide) -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    ``wide`` gives a text's two hashes: that of its bucket, and the one added where the texts of a bucket differ.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    order = [F.col("id").desc_nulls_last(), F.col("key"), F.col("text")]
    ranged = rows.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("id", to_arrow_type(docs.schema[id_col].dataType)), ("key", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64())]
                       + [(c, pa.string()) for c in ("edited_sha256", "hash", "hash2", "edited_hash", "edited_hash2")] + [("near_edited", pa.float64()), ("near_next", pa.float64())])
    nothing = (None,) * 8
    step = 512

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for at in range(0, b.num_rows, step):
                yield from zip(*(c.to_pylist() for c in b.slice(at, step).columns), strict=True)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, out = TaskContext.get().partitionId(), None, []
        for key, text, mark in stream(batches):
            form = canonical(text)
            if held is None:
                out.append((FIRST, part, key, mark, text, *nothing))
            else:
                out.append((ROW, part, held[0], held[3], None, *measures(held[1], held[2], text, form, wide)))
            held = (key, text, form, mark)
            if len(out) >= step:
                yield batch(out)
                out = []
        if held is not None:
            out.append((LAST, part, held[0], held[3], held[1], *nothing))
        if out:
            yield batch(out)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by slot and kind: the first row of a partition, then the last of the one before."""
        first = None
        for mark, part, key, own, text, *_ in stream(batches):
            if mark == FIRST:
                first = text
            else:
                yield batch([(ROW, part, key, own, None, *measures(text, canonical(text), first, canonical(first), wide))])

    ddl = f"kind int, part int, id {kind}, key bigint, text string, {COLUMNS}"
    seen = cut(ranged.mapInArrow(inside, ddl))
    edges = seen.where(f"kind <> {ROW}")
    order = Window.orderBy("part")  # numbers of partitions, one row each
    before = edges.where(f"kind = {FIRST}").select("part").withColumn("slot", F.coalesce(F.lag("part").over(order), F.max("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    met = edges.join(F.broadcast(before), "part").withColumn("slot", F.when(F.col("kind") == FIRST, F.col("slot")).otherwise(F.col("part")))
    met = met.repartition("slot").sortWithinPartitions("slot", "kind").select(*[f.name for f in schema])
    found = seen.where(f"kind = {ROW}").union(met.mapInArrow(across, ddl))
    clash = _clashes(rows, cut(found.select("hash", "key")), broadcast_rows, wide)
    mark = lambda a, b: F.when(F.col("clash"), F.concat(a, F.lit("-"), b)).otherwise(F.col(a))
    if clash is None:
        found = found.withColumns({"fingerprint": F.col("hash"), "edited_fingerprint": F.col("edited_hash")})
    else:
        for name, c in (("fingerprint", "hash"), ("edited_fingerprint", "edited_hash")):
            found = found.join(clash.withColumnRenamed("hash", c), c, "left").withColumn(name, mark(c, f"{c}2")).drop("clash")
    return found.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _clashes(rows: DataFrame, hashes: DataFrame, broadcast_rows: int | None, wide: Callable[[str], tuple[str, str]] = wide) -> DataFrame | None:
    """(hash, clash = true) of buckets whose canonical bytes aren't all equal, None if there are none.

    Only texts in buckets of two or more are compared, by partial minima and maxima of the bytes, so a
    bucket of any size is compared where its rows are and no task gathers it.
    """
    shared = cut(hashes.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    keys = cut(hashes.join(shared, "hash").select("key").distinct())
    keys = small(keys) if broadcast_rows is None else small(keys, broadcast_rows)

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            form = [canonical(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([wide(f)[0] for f in form], pa.string()), pa.array(form, pa.string())], names=["hash", "form"])

    texts = rows.join(keys, "key", "left_semi").select("text").mapInArrow(forms, "hash string, form string")
    apart = cut(texts.groupBy("hash").agg(F.min("form").alias("low"), F.max("form").alias("high")).where("low <> high").select("hash", F.lit(True).alias("clash")))
    return None if apart.isEmpty() else apart
