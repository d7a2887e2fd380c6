"""Vector functions as columns, and a deterministic embedder for tests and oracle queries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .text import by_parts


def _rows(v: pa.Array, some: np.ndarray, n: int) -> np.ndarray:
    return v.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(some), n)


@F.arrow_udf(S.DoubleType())
def _cosines(a: pa.Array, b: pa.Array) -> pa.Array:
    out = np.full(len(a), np.nan)
    sizes = [pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False) for x in (a, b)]
    for n in np.unique(sizes[0]).tolist():
        some = np.flatnonzero((sizes[0] == n) & (sizes[1] == n))
        if n > 0 and len(some):
            x, y = _rows(a, some, n), _rows(b, some, n)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[some] = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1)) / np.sqrt((y * y).sum(axis=1))
    return pa.array(out, mask=~np.isfinite(out))


def unit(vector: Column) -> Column:
    """The vector with length 1, null where it has no direction."""
    square = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))) & (square > 0) & (square < float("inf"))
    return F.when(fine, F.transform(vector, lambda x: x.cast("double") / F.sqrt(square)))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def cosine(a: Column, b: Column) -> Column:
    """By Arrow batches; null where a vector is null or zero, holds nulls, or the lengths differ."""
    return _cosines(a, b)


#: Elements up to which a cosine is written out as arithmetic; longer expressions cost more to plan and compile than they save.
WRITTEN_OUT = 64


def cosine_to(query: list[float], v: Column) -> Column:
    """Cosine to a vector that is known when planning; null for vectors that are null or zero, hold nulls, have another length, or numbers that aren't finite.

    Short vectors: plain arithmetic on elements, which code generation fuses with the scan.  Long ones: a matrix product
    for each Arrow batch.
    """
    q = [float(x) for x in query]
    size = math.sqrt(math.fsum(x * x for x in q)) or 1.0
    if len(q) > WRITTEN_OUT:
        return _by_batch(np.array(q) / size)(v)
    at = [F.get(v, F.lit(i)).cast("double") for i in range(len(q))]

    def balanced(terms: list[Column]) -> Column:  # a flat sum would nest as deep as the vector is long
        if len(terms) == 1:
            return terms[0]
        half = len(terms) // 2
        return balanced(terms[:half]) + balanced(terms[half:])

    along = balanced([x * F.lit(y / size) for x, y in zip(at, q, strict=True)])
    found = F.try_divide(along, F.sqrt(balanced([x * x for x in at])))
    return F.when(F.size(v) == len(q), F.nullif(found, F.lit(float("nan"))))


def _by_batch(unit: np.ndarray):
    n = len(unit)

    @F.arrow_udf("double")
    def along(v: pa.Array) -> pa.Array:
        out = np.full(len(v), np.nan)
        some = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(v), n), False).to_numpy(zero_copy_only=False))
        if len(some):
            rows = _rows(v, some, n)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[some] = rows @ unit / np.sqrt((rows * rows).sum(axis=1))
        return pa.array(out, mask=~np.isfinite(out))

    return along


def hash_embedding(text: Column, prefix: str) -> Column:
    """32 numbers from the SHA-256 of the prefixed text, of unit length, by Arrow batches."""

    @F.arrow_udf(S.ArrayType(S.DoubleType()))
    def embed(texts: pa.Array) -> pa.Array:
        return by_parts(lambda t: None if t is None else hash_vector(t, prefix), pa.list_(pa.float64()), texts)

    return embed(text)


def hash_vector(text: str, prefix: str) -> list[float]:
    """``hash_embedding`` of one text, when planning."""
    import hashlib

    raw = [b / 255 for b in hashlib.sha256((prefix + text).encode()).digest()]
    size = math.sqrt(math.fsum(x * x for x in raw))
    return [x / size for x in raw]
