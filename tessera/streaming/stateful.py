"""Streams that keep state: deletions out of complete listings, and leases that end without a row arriving."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.jobs import LIVE

PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts of a source's documents, each a state of its own; fixed for the life of a checkpoint.
PARTS = 64
SOURCE = ["workspace_id", "source_id"]
LISTING = "workspace_id string, source_id string, part int, listing bigint, document_id string, content_hash string, expected bigint"
CHANGES = "workspace_id string, source_id string, document_id string, content_hash string, kind string, listing bigint"


def listing(found: DataFrame, sources: DataFrame, number: int) -> DataFrame:
    """The rows of one complete listing, to be written where ``changes`` reads: each document, and per part of each source how many there are.

    ``found`` has SOURCE, document_id and content_hash; ``sources`` has SOURCE and names those that were listed, empty ones too.
    """
    part = F.pmod(F.xxhash64("document_id"), F.lit(PARTS)).cast("int").alias("part")
    rows = found.select(*SOURCE, part, F.lit(number).cast("bigint").alias("listing"), "document_id", "content_hash", F.lit(None).cast("bigint").alias("expected"))
    counts = rows.groupBy(*SOURCE, "part").agg(F.countDistinct("document_id").alias("n"))
    parts = sources.select(*SOURCE).distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    ends = parts.join(counts, [*SOURCE, "part"], "left")
    none = F.lit(None).cast("string")
    return rows.unionByName(ends.select(*SOURCE, "part", F.lit(number).cast("bigint").alias("listing"), none.alias("document_id"), none.alias("content_hash"), F.coalesce("n", F.lit(0)).alias("expected")))


class Listings(StatefulProcessor):
    """Of one part of a source: the documents that are there, and listings that are not complete yet.

    A listing counts when as many documents have arrived as its end says, in whatever order and however often; documents that it
    doesn't hold are then deleted.  Rows of listings older than the last complete one are ignored.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.there = handle.getMapState("there", "document_id string", "content_hash string, listing bigint")
        self.open = handle.getMapState("open", "listing bigint", "expected bigint, arrived bigint")
        self.done = handle.getValueState("done", "listing bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, out, opened = (self.done.get()[0] if self.done.exists() else -1), [], {}
        for number, document, content_hash, expected in (r for f in rows for r in f[["listing", "document_id", "content_hash", "expected"]].itertuples(index=False)):
            number = int(number)
            if number <= last:
                continue
            if number not in opened:
                opened[number] = list(self.open.getValue((number,))) if self.open.containsKey((number,)) else [-1, 0]
            if pd.isna(document):
                opened[number][0] = int(expected)
                continue
            content_hash = None if pd.isna(content_hash) else content_hash
            old = self.there.getValue((document,)) if self.there.containsKey((document,)) else None
            if old is not None and old[1] > number:  # a newer listing has been here; this one still counts it
                seen = False
            else:
                seen = old is not None and old[1] == number
                if old is None or (not seen and old[0] != content_hash):
                    out.append((document, content_hash, "new" if old is None else "changed", number))
                self.there.updateValue((document,), (content_hash, number))
            opened[number][1] += not seen
        for number in sorted(opened):
            expected, arrived = opened[number]
            if arrived != expected:
                self.open.updateValue((number,), (expected, arrived))
                continue
            last = number
            gone = [d for (d,), (_, seen) in list(self.there.iterator()) if seen < number]
            for document in gone:
                self.there.removeKey((document,))
                out.append((document, None, "deleted", number))
            for (old,) in [k for k, _ in list(self.open.iterator())]:
                if old <= number:
                    self.open.removeKey((old,))
            self.done.update((number,))
        if out:
            made = pd.DataFrame(out, columns=["document_id", "content_hash", "kind", "listing"])
            made.insert(0, "workspace_id", key[0])
            made.insert(1, "source_id", key[1])
            yield made

    def close(self) -> None:
        pass


def changes(listings: DataFrame) -> DataFrame:
    """SOURCE, document_id, content_hash, kind (new, changed, deleted), listing out of a stream of LISTING rows.

    State is kept by source and part, so a source of any size is many tasks' work.
    """
    return listings.groupBy(*SOURCE, "part").transformWithStateInPandas(Listings(), CHANGES, "Update", "None")


class Leases(StatefulProcessor):
    """The lease of one job, and a timer at its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "updated_at double, expires_at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.lease.get() if self.lease.exists() else None
        newest = max((r for f in rows for r in f[["updated_at", "status", "lease_expires_at"]].itertuples(index=False)), key=lambda r: r[0])
        if known is not None and newest[0] < known[0]:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if newest[1] in LIVE and not pd.isna(newest[2]):
            self.lease.update((float(newest[0]), float(newest[2])))
            self.handle.registerTimer(max(int(newest[2] * 1000), timerValues.getCurrentProcessingTimeInMs() + 1))
        else:
            self.lease.clear()
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.lease.exists():
            expires = self.lease.get()[1]
            self.lease.clear()
            yield pd.DataFrame([(key[0], "failed", "lease expired", expires)], columns=["job_id", "status", "error", "lease_expires_at"])

    def close(self) -> None:
        pass


def expirations(events: DataFrame) -> DataFrame:
    """(job_id, status, error, lease_expires_at) of jobs whose lease ends, when it ends; of a stream of job rows (job_id, status, updated_at, lease_expires_at)."""
    return events.groupBy("job_id").transformWithStateInPandas(Leases(), "job_id string, status string, error string, lease_expires_at double", "Update", "ProcessingTime")


def publish(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Start a stateful stream that hands each batch with rows to ``each``, which must be idempotent by the batch's number, as a batch may run again."""
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        batch = lambda df, n: None if df.isEmpty() else each(df, n)
        return rows.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(PROVIDER, before) if before is not None else spark.conf.unset(PROVIDER)
