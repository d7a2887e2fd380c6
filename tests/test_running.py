"""Job runners that compete, and streams that keep state across restarts."""

from __future__ import annotations

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import jobs, keywords
from tessera.operators.coordinator import Coordinator, Request
from tessera.streaming import incremental, stateful

# jobs


def test_identical_concurrent_requests_run_once(spark, tmp_path):
    calls, results = [], []

    def runner(request):
        calls.append(request.mode)
        time.sleep(0.5)
        return {"ok": True, "mode": request.mode}

    def worker():
        results.append(Coordinator(spark, str(tmp_path / "jobs"), runner).run(Request()))  # each has an object of its own, as other processes would

    threads = [threading.Thread(target=worker) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert calls == ["full"] and len(results) == 3 and len({r.job_id for r in results}) == 1
    assert all(r.status == "succeeded" and json.loads(r.result) == {"ok": True, "mode": "full"} for r in results)


def test_a_dead_runners_lease_ends_and_its_job_is_run_again(spark, tmp_path):
    now = [1000.0]
    dead = Coordinator(spark, str(tmp_path / "jobs"), lease=30, clock=lambda: now[0])
    request = Request("ws", "code", idempotency_key="same")
    job = dead.submit(request)
    assert job.status == "queued" and dead.submit(request).job_id == job.job_id
    token = dead.claim(job.job_id)
    assert token and dead.claim(job.job_id) is None and dead.job(job.job_id).status == "running"
    now[0] += 20
    assert dead.renew(job.job_id, token) and dead.expire() == 0
    now[0] += 31
    other = Coordinator(spark, str(tmp_path / "jobs"), lambda r: {"n": 1}, lease=30, clock=lambda: now[0])
    assert other.expire() == 1 and other.job(job.job_id).error == "lease expired"
    assert not dead.renew(job.job_id, token)
    done = other.run(request)
    assert done.job_id == job.job_id and done.status == "succeeded" and done.lease_expires_at is None
    dead._finish(job.job_id, token, "late", None)  # the dead one comes back: it holds nothing any more
    assert other.job(job.job_id).status == "succeeded"


def test_a_running_job_renews_its_lease_and_keeps_its_scope(spark, tmp_path):
    started, release = threading.Event(), threading.Event()

    def runner(request):
        started.set()
        assert release.wait(60)
        return {}

    first = Coordinator(spark, str(tmp_path / "jobs"), runner, lease=6)
    thread = threading.Thread(target=first.run, args=(Request("w", "s", idempotency_key="a"),))
    thread.start()
    assert started.wait(60)
    other = Coordinator(spark, str(tmp_path / "jobs"), lambda r: {}, lease=6)
    queued = other.submit(Request("w", "s", idempotency_key="b"))
    assert other.claim(queued.job_id) is None
    time.sleep(8)
    assert {r.idempotency_key: r.status for r in other.table().collect()}["a"] == "running" and jobs.active(other.table().where("idempotency_key = 'a'"), time.time()).count() == 1
    release.set()
    thread.join(60)
    assert {r.idempotency_key: r.status for r in other.table().collect()}["a"] == "succeeded"


def test_failures_are_kept_and_waiting_ends(spark, tmp_path):
    def runner(request):
        raise OSError("no disk")

    coordinator = Coordinator(spark, str(tmp_path / "jobs"), runner)
    with pytest.raises(OSError):
        coordinator.run(Request("w"))
    job = coordinator.table().first()
    assert (job.status, job.error) == ("failed", "no disk") and coordinator.wait(job.job_id).status == "failed"
    with pytest.raises(ValueError):
        coordinator.wait("unknown")
    with pytest.raises(TimeoutError):
        coordinator.wait(coordinator.submit(Request("v")).job_id, timeout=1)
    assert Request("a", files=("y", "x")).key == Request("a", files=("x", "y")).key != Request("a", files=("x",)).key


# streams


@pytest.fixture
def listings(spark, tmp_path, monkeypatch):
    """Writes listings, runs the stream until it has read them, and gives what it found; the stream starts anew each time."""
    monkeypatch.setattr(stateful, "PARTS", 4)
    place, sources = str(tmp_path / "listings"), spark.createDataFrame([("w", "s"), ("w", "empty")], "workspace_id string, source_id string")
    spark.createDataFrame([], stateful.LISTING).write.parquet(place)

    def write(number, files, keep=lambda df: df, source="s"):
        rows = spark.createDataFrame([("w", source, d, h) for d, h in files.items()], "workspace_id string, source_id string, document_id string, content_hash string")
        keep(stateful.listing(rows, sources, number)).coalesce(1).write.mode("append").parquet(place)

    def read():
        found = []
        stream = stateful.changes(spark.readStream.schema(stateful.LISTING).parquet(place))
        stateful.publish(stream, lambda df, n: found.extend((r.document_id, r.content_hash, r.kind) for r in df.collect()), str(tmp_path / "check")).awaitTermination()
        return sorted(found, key=str)

    return write, read


def test_a_file_that_vanishes_is_deleted_once_also_after_restarts(spark, listings):
    write, read = listings
    write(1, {"a": "1", "b": "1", "c": "1"})
    assert read() == [("a", "1", "new"), ("b", "1", "new"), ("c", "1", "new")]
    write(2, {"a": "1", "c": "2"})
    assert read() == [("b", None, "deleted"), ("c", "2", "changed")]
    write(3, {"a": "1", "c": "2"})
    assert read() == []
    write(4, {"a": "1", "b": "9", "c": "2"})
    assert read() == [("b", "9", "new")]


def test_a_listing_counts_when_it_is_whole(spark, listings):
    write, read = listings
    write(1, {"a": "1", "b": "1"})
    assert len(read()) == 2
    write(2, {"b": "2"}, keep=lambda df: df.where("expected IS NOT NULL"))  # its ends come first: a's part is whole, b's is not
    assert read() == [("a", None, "deleted")]
    write(2, {"b": "2"}, keep=lambda df: df.where("expected IS NULL").union(df.where("expected IS NULL")))
    assert read() == [("b", "2", "changed")]
    write(1, {"a": "1", "z": "1"})  # an old listing that comes late
    assert read() == []
    write(3, {})
    assert read() == [("b", None, "deleted")]


def test_deletions_of_a_stream_reach_the_keyword_index(spark, listings, tmp_path):
    write, read = listings
    kept = keywords.KeywordIndex(spark, str(tmp_path / "k"))
    kept.apply(spark.createDataFrame([(d, "w", "s", f"text {d}x") for d in "abc"], "point_id string, workspace_id string, source_id string, content string"))
    write(1, {"a": "1", "b": "1", "c": "1"})
    read()
    write(2, {"a": "1", "c": "1"})
    kept.apply(deletes=spark.createDataFrame([(d,) for d, _, kind in read() if kind == "deleted"], "point_id string"))
    assert {r.point_id for r in kept.search("text", 9, workspace_id="w").collect()} == {"a", "c"} and kept.state()["points"] == 2


def test_a_lease_ends_without_a_row_arriving(spark, tmp_path):
    kind, place, found = "job_id string, status string, updated_at double, lease_expires_at double", str(tmp_path / "events"), []
    now = time.time()
    rows = [("short", "running", now, now + 6), ("renewed", "running", now, now + 6), ("renewed", "running", now + 1, now + 500), ("ended", "running", now, now + 6), ("ended", "succeeded", now + 1, None)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(place)
    events = spark.readStream.schema(kind).parquet(place)
    running = stateful.publish(stateful.expirations(events), lambda df, n: found.extend(df.collect()), str(tmp_path / "check"), processingTime="1 second")
    try:
        until = time.time() + 60
        while not found and time.time() < until:
            time.sleep(0.5)
        time.sleep(3)
    finally:
        running.stop()
    assert [(r.job_id, r.status, r.error) for r in found] == [("short", "failed", "lease expired")]


def test_a_stream_of_requests_is_limited(spark, tmp_path):
    kind, place = "client string, request_id bigint, ts double", str(tmp_path / "requests")
    rows = [("a", i, float(i)) for i in range(10)] + [("b", 100, 0.0)] + [("a", 50, 20.0)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(place)
    found = []
    stream = incremental.admit(spark.readStream.schema(kind).parquet(place), limit=3, seconds=10)
    running = stream.writeStream.outputMode("append").foreachBatch(lambda df, n: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).start()
    until = time.time() + 60
    while len(found) < 12 and time.time() < until:  # a stream with time-outs has no last batch
        time.sleep(0.5)
    running.stop()
    assert {r.request_id for r in found if r.admitted} == {0, 1, 2, 50, 100} and len(found) == 12
