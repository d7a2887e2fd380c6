"""Metrics, status and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import metric_key

#: Requests a minute, seconds of the window.
RATE, WINDOW_SECONDS = 120, 60


def aggregate(events: DataFrame) -> DataFrame:
    """(metric, total, n) of events (name, labels as a map, value)."""
    return events.groupBy(metric_key(F.col("name"), F.col("labels")).alias("metric")).agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def lifecycle(error: Column, mode: Column, points: Column, known: Column) -> Column:
    return F.when(~known, "not_indexed").when(F.coalesce(error, F.lit("")) != "", "error").when(mode == "partial", "partial").when(points > 0, "ready").otherwise("not_indexed")


def arrivals(requests: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``requests`` (client, ts in seconds) with the number of arrivals of the client in the seconds up to each."""
    w = Window.partitionBy("client").orderBy("ts").rangeBetween(-seconds, 0)
    return requests.withColumn("arrived", F.count("*").over(w))


def admitted(requests: DataFrame, limit: int = RATE, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``requests`` (client, request_id, ts) with admitted: only admitted requests count, so each depends on those before.

    A fold over a client's requests in order; its state is the admitted times inside the window, at most
    ``limit``.  Requests are folded in streams sorted by client, not gathered per client.
    """
    from collections import deque
    from collections.abc import Iterator

    import pyarrow as pa

    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}

    def fold(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, recent = None, deque()
        for b in stream:
            out = []
            for client, ts in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if client != now:
                    now, recent = client, deque()
                while recent and recent[0] <= ts - seconds:
                    recent.popleft()
                out.append(len(recent) < limit)
                if out[-1]:
                    recent.append(ts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=["client", "request_id", "ts", "admitted"])

    rows = requests.select("client", "request_id", "ts").repartition("client").sortWithinPartitions("client", "ts", "request_id")
    return rows.mapInArrow(fold, f"client {kinds['client']}, request_id {kinds['request_id']}, ts {kinds['ts']}, admitted boolean")
