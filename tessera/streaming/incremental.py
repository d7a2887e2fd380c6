"""Structured Streaming: incremental indexing, windowed metrics, exact rate limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.maintain import KEY, inventory, merge_registry
from ..operators.metrics import RATE, WINDOW_SECONDS


def incremental_index(documents: DataFrame, registry: Callable[[], DataFrame], publish: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Feed a stream of observed documents (KEY, content_hash, position, ...) to the inventory, batch by batch.

    Of rows for one document in a batch the last wins.  ``publish(changed rows, next registry, batch id)``
    must be idempotent by batch id, as a batch may run again.  Deletions never come through a stream of
    files; they come from a full inventory.
    """

    def batch(rows: DataFrame, number: int) -> None:
        latest = rows.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in KEY]), "position").alias("r")).select(*KEY, "r.*")
        known = registry()
        diff = inventory(latest, known, latest)
        changed = latest.join(diff.where("kind IN ('new', 'changed')").select(*KEY), KEY, "left_semi")
        publish(changed, merge_registry(known, diff, float(number)), number)

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency(events: DataFrame, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sum and count of ``value`` by ``event_type`` and window of ``ts``, with a watermark for late rows."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.sum("value").alias("total"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "total", "n")


def admit(requests: DataFrame, *, limit: int = RATE, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(client, request_id, ts, admitted) of a stream of requests (ts in seconds); the state of a client is its admitted times in the window."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["ts", "request_id"])
        out = []
        for ts in rows["ts"]:
            recent = [t for t in recent if t > ts - seconds]
            out.append(len(recent) < limit)
            if out[-1]:
                recent.append(float(ts))
        state.update((recent,))
        state.setTimeoutDuration(2 * seconds * 1000)
        rows["admitted"] = out
        yield rows[["client", "request_id", "ts", "admitted"]]

    return requests.groupBy("client").applyInPandasWithState(
        fold, "client string, request_id bigint, ts double, admitted boolean", "recent array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
