"""Removal of long strings that occur more than once in a corpus, of bytes or of words.

A symbol is removed if a string of ``length`` symbols that covers it also starts anywhere else, in the same document
or in another.  Matches never cross documents.  A ``Measure`` says what a symbol is: a byte, or a word by its
64-bit hash whatever separates it from the next one.

1. Anchors.  In every string of ``length`` symbols the least hash of its ``anchor``-symbol strings marks an anchor,
   by the string's content alone, so equal strings have the same anchor at the same place.  Only anchors whose
   string occurs twice go on.  They deal the work out and decide nothing.
2. Contexts.  All strings that hold an anchor lie in its context.  Equal contexts are one row with a count.
3. Index.  The contexts of an anchor meet in one task.  There their run-length Burrows-Wheeler transform is built,
   with sampled run ends (``rindex``); the matching statistics, streamed over it, say which strings occur elsewhere.
   What is compared are the symbols themselves, those of the anchor too.
4. Marks.  The removed parts of a context hold for all documents that have it.

Every step is an aggregation with partial sums or a join of plain shuffles.  The strings of an anchor with more than
``hot`` distinct contexts are dealt in ``PARTS`` ranges.  What a range's strings share around the anchor is part of its
group, so contexts that differ there part, and a range's rows hold only the symbols beyond; equal ones become one row
with a count again.  Groups that are still larger are dealt again, down to single strings.  So no task holds more than
``hot`` different contexts of an anchor, and a passage that very many documents share costs a few rows for each
context, not one for each string.  (What a range's strings share, and equal rows, go by 64-bit hashes, within an anchor.)

Cases: a null text is an empty one; texts shorter than ``length`` keep all; texts of any length are read in
overlapping slices of bytes; repeated rows match each other; an empty table gives no rows; extra columns stay, also
those named like the operator's own.  Rows and contexts are told apart by 128 bits of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import SEPARATORS, cut, discard, groups_of, views
from .pretokens import mix, powers
from .rindex import RunIndex

#: Distinct contexts of a group (about 12 MB) beyond which its strings are dealt in ranges, and the ranges.
HOT = 16_384
PARTS = 4
#: Contexts of crowded anchors (of some 40 bytes each) up to which their places are broadcast, which saves a shuffle of the texts.
FEW = 500_000
#: Contexts of one index, at least; contexts that are cut out at a time; bytes of one pass over texts.
CHUNK, CUT, SLICE = 8192, 1024, 1 << 18
ROW_KEY = "struct<a:bigint,b:bigint>"
MARK = "unit tinyint, h bigint, ctx bigint, begin int, end int"
BYTES, WORDS = 0, 1
_TABLE = mix(np.arange(1, 257, dtype=np.uint64))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(SEPARATORS)] = True


@dataclass(frozen=True)
class Measure:
    """Strings of ``length`` symbols (bytes or words), found by anchors of ``anchor`` symbols."""

    unit: int
    length: int
    anchor: int

    @property
    def reach(self) -> int:
        return self.length - self.anchor

    @property
    def kind(self) -> type:
        return np.uint8 if self.unit == BYTES else np.uint64

    def check(self) -> None:
        if not 0 < self.anchor < self.length:
            raise ValueError("a string must be longer than its anchor")

    def least_bytes(self) -> int:
        return self.length if self.unit == BYTES else 2 * self.length - 1


#: Strings of 400 bytes, and passages of over 50 words.
STRINGS, PASSAGES = Measure(BYTES, 400, 64), Measure(WORDS, 51, 12)


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end) of each word of texts that lie side by side in ``data``."""
    begin, end = int(offsets[0]), int(offsets[-1])
    edge = np.zeros(end - begin + 1, bool)
    edge[offsets - begin] = True
    inside = ~_SEPARATOR[data[begin:end]]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first) + begin, np.flatnonzero(last) + 1 + begin


def _sums(values: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    hashed = _TABLE[values] if values.dtype == np.uint8 else values
    np.cumsum((mix(hashed ^ np.uint64(salt)) if salt else hashed) * up[: len(values)], out=out[1:])
    return out, down


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values."""
    n = len(x) - width + 1
    y = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    to, since = np.minimum.accumulate(y, axis=1).ravel(), np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[:n], to[width - 1 : width - 1 + n])


def anchors(values: np.ndarray, bounds: np.ndarray, measure: Measure, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, hash of the context) of the anchors of all strings that start in [low, high) of ``values``, inside texts.

    An anchor that also serves the start before ``low`` is left out: the slice before emits it. The starts that an anchor
    serves are consecutive, so no other anchor is shared.
    """
    n, width = len(values), measure.reach + 1
    empty = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if n < measure.length:
        return empty
    sums, down = _sums(values)
    x = mix((sums[measure.anchor :] - sums[: -measure.anchor]) * down[: n - measure.anchor + 1])
    bits = np.uint64(max(1, n.bit_length()))
    least = _least((x >> bits << bits) | np.arange(len(x), dtype=np.uint64), width)
    end = np.repeat(bounds[1:], np.diff(bounds))  # of the text at each symbol
    starts = np.arange(n - measure.length + 1)
    inside = (starts + measure.length <= end[: len(starts)]) & (starts >= low) & (starts < high)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    place = np.unique(least[inside] & mask).astype(np.int64)
    if low and low <= len(starts):
        place = place[place != int(least[low - 1] & mask)]
    text = np.searchsorted(bounds, place, side="right") - 1
    left, right = np.maximum(place - measure.reach, bounds[text]), np.minimum(place + measure.length, bounds[text + 1])
    around = mix((sums[right] - sums[left]) * down[left]) + mix((place - left).astype(np.uint64) * np.uint64(1 << 20) + (right - left).astype(np.uint64))
    return place, x[place] ^ np.uint64(measure.unit), around


def _slices(offsets: np.ndarray, length: int):
    """(first text, end, from byte, to byte, low, high): whole texts, or a slice of a long one with what lies around."""
    for a, z in groups_of(offsets, SLICE):
        begin, end = int(offsets[a]), int(offsets[z])
        if end - begin <= 2 * SLICE:
            yield a, z, begin, end, 0, end - begin
            continue
        for at in range(begin, end, SLICE):
            low = max(begin, at - length)
            yield a, z, low, min(end, at + SLICE + 2 * length), at - low, at - low + SLICE


def _anchors(measures: tuple[Measure, ...]):
    """row_key, text -> row_key, unit, pos, h, ctx."""

    def rows(b: pa.RecordBatch, measure: Measure):
        data, offsets = views(b.column(1))
        if measure.unit == WORDS:
            for a, z in groups_of(offsets, SLICE):
                values, bounds = shingles.words(data, offsets[a : z + 1])
                place, h, around = anchors(values, bounds, measure, 0, len(values))
                text = np.searchsorted(bounds, place, side="right") - 1
                yield text + a, place - bounds[text], h, around
            return
        for a, z, begin, end, low, high in _slices(offsets, measure.length):
            own = np.clip(offsets[a : z + 1], begin, end) - begin
            place, h, around = anchors(data[begin:end], own, measure, low, high)
            text = np.searchsorted(offsets[a : z + 1], place + begin, side="right") - 1 + a
            yield text, place + begin - offsets[text], h, around

    def inside(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for measure in measures:
                for text, pos, h, around in rows(b, measure):
                    unit = np.full(len(pos), measure.unit, np.int8)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array(unit), pa.array(pos), pa.array(h.view(np.int64)), pa.array(around.view(np.int64))], names=["row_key", "unit", "pos", "h", "ctx"])

    return inside


#: A context, or what of it belongs to the strings ``first`` to ``first + span`` of it (counted by their right symbols).
CONTEXT = "unit tinyint, g bigint, h bigint, ctx bigint, n bigint, first int, span int, n_left int, n_right int, left binary, right binary"
COLUMNS = [c.split()[0] for c in CONTEXT.split(", ")]


def _fixed(raw: np.ndarray) -> pa.Array:
    size = raw.shape[1] * raw.itemsize
    return pa.Array.from_buffers(pa.binary(size), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw).tobytes())]).cast(pa.binary()) if size else pa.array([b""] * len(raw), pa.binary())


def _matrix(t: pa.Table, column: str, measure: Measure) -> np.ndarray:
    raw = t.column(column).to_pylist()
    return np.frombuffer(b"".join(raw), measure.kind).reshape(len(raw), len(raw[0]) // np.dtype(measure.kind).itemsize if raw else 0)


def _contexts(measures: tuple[Measure, ...]):
    """text, places (pos, unit, h, ctx, n) -> a row for each context, with its symbols to the left of the anchor's end and to the right."""

    def one(measure: Measure, values: np.ndarray, low: np.ndarray, high: np.ndarray, p: np.ndarray, columns: list[np.ndarray]):
        for at in range(0, len(p), CUT):
            place, edge, stop = p[at : at + CUT], low[at : at + CUT], high[at : at + CUT]
            h, ctx, n = (c[at : at + CUT] for c in columns)
            middle = place + measure.anchor
            n_left, n_right = np.minimum(measure.length, middle - edge), np.minimum(measure.reach, stop - middle)
            left = values[np.maximum(middle[:, None] - 1 - np.arange(measure.length), 0)]
            right = values[np.minimum(middle[:, None] + np.arange(measure.reach), len(values) - 1)]
            left[np.arange(measure.length) >= n_left[:, None]] = 0
            right[np.arange(measure.reach) >= n_right[:, None]] = 0
            same = lambda x, kind: pa.array(np.full(len(place), x, kind))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [same(measure.unit, np.int8), pa.array(h), pa.array(h), pa.array(ctx), pa.array(n), same(0, np.int32), same(measure.reach, np.int32), pa.array(n_left.astype(np.int32)), pa.array(n_right.astype(np.int32)), _fixed(left), _fixed(right)], names=COLUMNS
            )

    def inside(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            data, offsets = views(b.column(0))
            lists = b.column(1)
            text = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            fields = lists.flatten()
            pos, unit, h, ctx, n = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            for measure in measures:
                for a, z in groups_of(offsets, SLICE):
                    at = np.flatnonzero((unit == measure.unit) & (text >= a) & (text < z))
                    if not len(at):
                        continue
                    if measure.unit == WORDS:
                        values, bounds = shingles.words(data, offsets[a : z + 1])
                    else:
                        values, bounds = data[int(offsets[a]) : int(offsets[z])], offsets[a : z + 1] - int(offsets[a])
                    own = text[at] - a
                    yield from one(measure, values, bounds[own], bounds[own + 1], bounds[own] + pos[at], [c[at] for c in (h, ctx, n)])

    return inside


def _by_kind(t: pa.Table) -> Iterator[tuple[int, int, pa.Table]]:
    """(unit, span, rows): rows of one shape, in their order."""
    unit, span = t.column("unit").to_numpy(), t.column("span").to_numpy()
    for u, s in sorted(set(zip(unit.tolist(), span.tolist(), strict=True))):
        yield u, s, t.filter(pa.array((unit == u) & (span == s))).combine_chunks()


def _deal(measures: tuple[Measure, ...]):
    """Rows of crowded groups -> their strings in ranges, each with the group of what its strings share, and a hash of what lies beyond."""
    by_unit = {m.unit: m for m in measures}

    def hashed(values: np.ndarray) -> np.ndarray:
        values = _TABLE[values] if values.dtype == np.uint8 else values
        return mix((values * powers(values.shape[1])[0]).sum(axis=1, dtype=np.uint64))

    def inside(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for at in range(0, b.num_rows, CUT):
                for u, span, t in _by_kind(pa.Table.from_batches([b.slice(at, CUT)])):
                    measure = by_unit[u]
                    left, right = _matrix(t, "left", measure), _matrix(t, "right", measure)
                    core = left.shape[1] - span  # the anchor, in rows that weren't dealt yet
                    n_left, n_right = t.column("n_left").to_numpy() - core, t.column("n_right").to_numpy()
                    left = left[:, core:]
                    step = -(-(span + 1) // PARTS)
                    for first in range(0, span + 1, step):
                        last = min(first + step - 1, span)
                        before, wide = span - last, last - first
                        some = np.flatnonzero((n_left >= before) & (n_right >= first))
                        x, y = left[some], right[some]
                        g = hashed(x[:, :before]) ^ mix(hashed(y[:, :first]) + np.uint64(first + 1) + t.column("g").to_numpy()[some].view(np.uint64))
                        taken = [t.column(c).combine_chunks().take(pa.array(some)) for c in ("unit", "h", "ctx", "n")]
                        number = lambda x: pa.array(np.asarray(x).astype(np.int32))
                        x, y = x[:, before : before + wide], y[:, first : first + wide]
                        room = np.minimum(n_left[some] - before, wide), np.minimum(n_right[some] - first, wide)
                        same = hashed(x) ^ mix(hashed(y) + (room[0] * (wide + 1) + room[1]).astype(np.uint64))
                        yield pa.RecordBatch.from_arrays(
                            [taken[0], pa.array(g.view(np.int64)), *taken[1:], number(t.column("first").to_numpy()[some] + first), number(np.full(len(some), wide)), number(room[0]), number(room[1]), _fixed(x), _fixed(y), pa.array(same.view(np.int64))],
                            names=[*COLUMNS, "same"],
                        )

    return inside


def _table(t: pa.Table, measure: Measure) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of contexts as small numbers from 1 on, 0 beyond the text."""
    raw = [_matrix(t, c, measure) for c in ("left", "right")]
    ok = [np.arange(x.shape[1]) < t.column(c).to_numpy()[:, None] for x, c in zip(raw, ("n_left", "n_right"), strict=True)]
    if measure.unit == BYTES:
        return tuple(np.where(k, x.astype(np.uint16) + np.uint16(1), np.uint16(0)) for x, k in zip(raw, ok, strict=True))
    _, dense = np.unique(np.concatenate([x.ravel() for x in raw]), return_inverse=True)
    dense = np.split(dense.ravel().astype(np.uint32) + np.uint32(1), [raw[0].size])
    return tuple(np.where(k, d.reshape(x.shape), np.uint32(0)) for x, d, k in zip(raw, dense, ok, strict=True))


def _index(measures: tuple[Measure, ...]):
    """Contexts sorted by (unit, h, g) -> (unit, h, ctx, begin, end) of the symbols to remove, from the anchor's place."""
    by_unit = {m.unit: m for m in measures}

    def ends(t: pa.Table) -> np.ndarray:
        keys = [t.column(c).to_numpy() for c in ("unit", "h", "g")]
        return np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1

    def ranges(t: pa.Table, unit: int) -> pa.RecordBatch:
        measure = by_unit[unit]
        group = np.zeros(t.num_rows, np.int64)
        group[ends(t)] = 1
        left, right = _table(t, measure)
        found = RunIndex(np.cumsum(group), left, right, t.column("n").to_numpy()).matches(left.shape[1])
        row = np.flatnonzero(found.any(axis=1))
        found = found[row]  # all strings of a context hold its anchor, so what they cover has no gap
        s, e = found.argmax(axis=1), found.shape[1] - found[:, ::-1].argmax(axis=1)
        first = t.column("first").to_numpy()[row] - measure.reach
        take = lambda c: t.column(c).combine_chunks().take(pa.array(row))
        return pa.RecordBatch.from_arrays([take("unit"), take("h"), take("ctx"), pa.array((first + s).astype(np.int32)), pa.array((first + e - 1 + measure.length).astype(np.int32))], names=["unit", "h", "ctx", "begin", "end"])

    def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for unit, _, part in _by_kind(t):
            yield ranges(part, unit)

    def inside(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in stream:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) >= CHUNK:
                t = pa.Table.from_batches(held).combine_chunks()
                last = int(ends(t).max(initial=0))  # the last group may go on
                if last:
                    yield from whole(t.slice(0, last))
                held = t.slice(last).to_batches()
        if held:
            yield from whole(pa.Table.from_batches(held).combine_chunks())

    return inside


def marks(keyed: DataFrame, measures: tuple[Measure, ...] = (STRINGS,), *, hot: int = HOT) -> DataFrame:
    """(row_key, unit, begin, end) of the symbols of ``keyed`` (row_key, text, ...) to remove."""
    for measure in measures:
        measure.check()
    texts = keyed.select("row_key", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") >= min(m.least_bytes() for m in measures))
    every = cut(texts.mapInArrow(_anchors(measures), f"row_key {ROW_KEY}, unit tinyint, pos bigint, h bigint, ctx bigint"))
    again = cut(every.groupBy("unit", "h").agg(F.count("*").alias("n")).where("n > 1").select("unit", "h"))
    seen = cut(every.join(again, ["unit", "h"]).select("row_key", "unit", "pos", "h", "ctx"))
    discard(every)
    first = F.min(F.struct("row_key", "pos")).alias("first")
    contexts = cut(seen.groupBy("unit", "h", "ctx").agg(F.count("*").alias("n"), first))
    crowded = cut(contexts.groupBy("unit", "h").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("unit", "h", F.lit(True).alias("hot")))
    many = not crowded.isEmpty()
    if many:
        contexts = contexts.join(crowded, ["unit", "h"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    contexts = contexts.withColumns({"row_key": F.col("first.row_key"), "pos": F.col("first.pos")})

    def cut_out(rows: DataFrame, few: bool) -> DataFrame:
        places = rows.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("pos", "unit", "h", "ctx", "n"))).alias("places"))
        return texts.join(F.broadcast(places) if few else places.hint("shuffle_hash"), "row_key").select("text", "places").mapInArrow(_contexts(measures), CONTEXT)

    def indexed(rows: DataFrame) -> DataFrame:
        return rows.repartition("unit", "h", "g").sortWithinPartitions("unit", "h", "g").mapInArrow(_index(measures), MARK)

    found = indexed(cut_out(contexts.where("NOT hot") if many else contexts, False))
    if many:
        hot_contexts = cut(contexts.where("hot"))
        rows = cut(cut_out(hot_contexts, hot_contexts.limit(FEW + 1).count() <= FEW))
        levels: list[tuple[DataFrame, DataFrame]] = []  # (which rows became which, marks of the latter)
        others = [F.first(c).alias(c) for c in ("first", "span", "n_left", "n_right", "left", "right")]
        while True:
            dealt = cut(rows.mapInArrow(_deal(measures), f"{CONTEXT}, same bigint").withColumn("own", F.xxhash64("g", "same")))
            once = cut(dealt.groupBy("unit", "h", "g", F.col("own").alias("ctx")).agg(F.sum("n").alias("n"), *others))
            # a string of a group with one row in all occurs nowhere else
            sizes = cut(once.groupBy("unit", "h", "g").agg((F.count("*") > hot).alias("crowd"), F.sum("n").alias("total")).where("total > 1"))
            rows = cut(once.join(sizes.select("unit", "h", "g", "crowd"), ["unit", "h", "g"]))
            levels.append((dealt.select("unit", "h", "ctx", "own"), cut(indexed(rows.where("NOT crowd").select(*COLUMNS)))))
            if sizes.where("crowd").isEmpty():
                break
            rows = rows.where("crowd").select(*COLUMNS)
        below = None
        for became, marked in reversed(levels):
            marked = marked if below is None else marked.union(below)
            below = marked.withColumnRenamed("ctx", "own").join(became, ["unit", "h", "own"]).select("unit", "h", "ctx", "begin", "end")
        found = found.union(below)
    found = cut(found.groupBy("unit", "h", "ctx").agg(F.min("begin").alias("begin"), F.max("end").alias("end")) if many else found)
    return seen.join(found, ["unit", "h", "ctx"]).select("row_key", "unit", (F.col("pos") + F.col("begin")).alias("begin"), (F.col("pos") + F.col("end")).alias("end"))


def _remove(columns: list[str], units: tuple[int, ...], texts: bool):
    """Documents with ``spans`` -> the same columns with n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes and, if asked for, kept."""

    def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(begin, end) of the maximal runs of what the spans cover of n bytes."""
        order = np.argsort(begin, kind="stable")
        begin, end = np.clip(begin[order], 0, n), np.maximum.accumulate(np.clip(end[order], 0, n))
        new = np.concatenate([[True], begin[1:] > end[:-1]]) if len(begin) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        runs = np.stack([begin[at], end[np.append(at[1:], len(begin)) - 1]], axis=1) if len(at) else np.zeros((0, 2), np.int64)
        return runs[runs[:, 1] > runs[:, 0]]

    def inside(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            data, offsets = views(b.column(columns.index("text")))
            lists = b.column(columns.index("spans"))
            fields, bounds = lists.flatten(), np.concatenate([[0], np.cumsum([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()])]).astype(np.int64)
            unit, begin, end = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            rows: list[tuple] = []
            for i in range(b.num_rows):
                raw, own = data[offsets[i] : offsets[i + 1]], slice(bounds[i], bounds[i + 1])
                u, x, y = unit[own], begin[own].astype(np.int64), end[own].astype(np.int64)
                words = u == WORDS
                if words.any():
                    first, last = word_places(raw, np.array([0, len(raw)]))
                    x, y = np.where(words, first[np.where(words, x, 0)], x), np.where(words, last[np.where(words, y, 1) - 1], y)
                passages = covered(len(raw), x[words], y[words])
                some = np.isin(u, units)
                gone = covered(len(raw), x[some], y[some])
                edges = np.concatenate([[0], gone.ravel(), [len(raw)]]).reshape(-1, 2)
                left = b"".join(raw[p:q].tobytes() for p, q in edges.tolist())
                rows.append((len(raw), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), hashlib.sha256(left).hexdigest(), len(passages), int((passages[:, 1] - passages[:, 0]).sum()), *([left.decode("utf-8", "ignore")] * texts)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()] + [pa.string()] * texts
            added = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            others = [(c, b.column(i)) for i, c in enumerate(columns) if c not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays([x for _, x in others] + added, names=[c for c, _ in others] + ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"] + ["kept"] * texts)

    return inside


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", keep: list[str] = (), strings: Measure = STRINGS, passages: Measure | None = None, cut_passages: bool = False, hot: int = HOT, texts: str | None = None) -> DataFrame:
    """id_col, the columns ``keep``, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (text).

    With ``passages`` also n_passages and passage_bytes: the runs of words that ``passages`` says occur elsewhere, and
    their bytes; with ``cut_passages`` those are removed as well.  With ``texts``, the name of a column, the text that
    stays instead of the figures, without characters of which a part was removed.
    """
    measures = (strings,) if passages is None else (strings, passages)
    held = list(dict.fromkeys([id_col, *keep]))
    row_key = F.struct(F.xxhash64(id_col, "text").alias("a"), F.xxhash64(F.lit(1), "text", id_col).alias("b")).alias("row_key")
    keyed = docs.select(row_key, *(F.col(c).alias(f"own_{c}") for c in held), "text")
    spans = marks(keyed, measures, hot=hot).groupBy("row_key").agg(F.collect_list(F.struct("unit", "begin", "end")).alias("spans"))
    columns = [*keyed.columns, "spans"]
    joined = keyed.join(spans.hint("shuffle_hash"), "row_key", "left").select(*columns)
    kinds = ", ".join(f"`own_{c}` {docs.schema[c].dataType.simpleString()}" for c in held)
    units = (strings.unit, passages.unit) if cut_passages and passages is not None else (strings.unit,)
    figures = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["n_passages", "passage_bytes"] * (passages is not None)
    out = joined.mapInArrow(_remove(columns, units, texts is not None), f"row_key {ROW_KEY}, {kinds}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, passage_bytes bigint" + ", kept string" * (texts is not None))
    return out.select(*(F.col(f"own_{c}").alias(c) for c in held), *(figures if texts is None else [F.col("kept").alias(texts)]))
