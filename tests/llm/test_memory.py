"""What a Python worker holds doesn't grow with the batch that Spark would send it by rows alone, nor with the texts beside one another."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.llm import shingles
from tessera.llm.common import cut, views


def test_batches_of_a_table_are_bounded_in_bytes(spark):
    rows = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('some words ', 400) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    found = cut(rows.mapInArrow(sizes, "rows bigint, bytes bigint")).collect()
    assert sum(r.rows for r in found) == 4000
    assert max(r.bytes for r in found) < 6 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_shingles_take_bounded_memory(monkeypatch):
    rng = np.random.default_rng(5)
    text = " ".join(map(str, rng.integers(0, 10**6, 500)))
    data, offsets = views(pa.array([f"{i} {text}" for i in range(1200)] + ["w" * (3 << 20), "", "a b"]))
    tracemalloc.start()
    own = 0
    found = []
    for _, _, s, bounds in shingles.batches(data, offsets[:1201]):
        own += s.nbytes
        found.append((s, np.diff(bounds)))
    peak = tracemalloc.get_traced_memory()[1] - own
    tracemalloc.stop()
    assert peak < 40 << 20
    whole, bounds = shingles.shingles(data, offsets)
    monkeypatch.setattr(shingles, "SLICE", 1 << 22)
    again, limits = shingles.shingles(data, offsets)
    assert (whole == again).all() and (bounds == limits).all()
    assert (np.concatenate([s for s, _ in found]) == again[: limits[1200]]).all() and (np.concatenate([n for _, n in found]) == np.diff(limits)[:1200]).all()
