"""Embedders: an HTTP client with a window of requests, retries and a circuit breaker; Arrow batches over any function; each text sent once."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Batch size, failures that open the breaker, seconds until it closes, characters of an input.
BATCH, FAILURES, COOL_DOWN, CLAMP = 32, 3, 30.0, 6000
#: Fixed value: what documents are prefixed with.
DOCUMENTS = "d:"


@dataclass
class Breaker:
    failures: int = FAILURES
    cool_down: float = COOL_DOWN
    clock: Callable[[], float] = time.monotonic
    count: int = 0
    opened: float | None = field(default=None)

    def check(self) -> None:
        if self.opened is not None:
            if self.clock() - self.opened < self.cool_down:
                raise RuntimeError("the embedding service is not asked while its circuit is open")
            self.opened, self.count = None, 0

    def record(self, ok: bool) -> None:
        self.count = 0 if ok else self.count + 1
        if self.count >= self.failures:
            self.opened = self.clock()


def endpoint(base: str, style: str = "openai") -> str:
    """The address of the embedding call below a base address, whatever part of it the base already has."""
    base, style = base.strip().rstrip("/"), (style or "openai").strip().lower()
    if style == "ollama":
        return base if base.endswith(("/api/embeddings", "/api/embed")) else f"{base.removesuffix('/v1')}/api/embeddings"
    if style != "openai":
        raise ValueError(f"unknown provider {style!r}; known: openai, ollama")
    if base.endswith("/embeddings"):
        return base
    return f"{base}/embeddings" if base.endswith("/v1") else f"{base}/v1/embeddings"


#: What is tried again: no connection, time out, too many requests, the service is overloaded.
PASSING = (408, 425, 429, 500, 502, 503, 504)


class Refused(RuntimeError):
    """The service answered, and asking again would not help."""


@dataclass
class HttpEmbedder:
    """Vectors from an OpenAI-compatible service or Ollama, in the order of the texts.

    Up to ``concurrency`` requests of ``batch`` texts are in flight; Ollama's /api/embeddings takes one text a request.  A request that fails
    for a passing reason is made again after ``wait`` seconds, twice as long each time; the breaker counts calls that failed for good.
    """

    base: str
    model: str
    style: str = "openai"
    timeout: float = 60.0
    breaker: Breaker = field(default_factory=Breaker)
    key: str = ""
    batch: int = BATCH
    concurrency: int = 4
    tries: int = 3
    wait: float = 0.5

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        self.breaker.check()
        address = endpoint(self.base, self.style)
        each = 1 if address.endswith("/api/embeddings") else max(1, self.batch)
        try:
            with ThreadPoolExecutor(max(1, self.concurrency)) as pool:
                found = [v for part in in_order(pool, lambda b: self._ask(address, b), (texts[a : a + each] for a in range(0, len(texts), each)), self.concurrency) for v in part]
        except Exception:
            self.breaker.record(False)
            raise
        self.breaker.record(True)
        return found

    def health(self) -> tuple[bool, str]:
        """Whether a text is embedded, and what is known of the service or what went wrong."""
        try:
            (vector,) = self(["health check"])
        except Exception as error:
            return False, str(error)
        return (True, f"ok dim={len(vector)} model={self.model} provider={self.style} concurrency={self.concurrency}") if vector else (False, "the service gave an empty vector")

    def _ask(self, address: str, texts: list[str]) -> list[list[float]]:
        single = address.endswith("/api/embeddings")
        body = {"model": self.model, "prompt": texts[0]} if single else {"model": self.model, "input": texts if len(texts) > 1 else texts[0]}
        for left in reversed(range(self.tries)):
            try:
                return vectors_of(self._post(address, body), len(texts))
            except Refused:
                raise
            except (OSError, ValueError) as error:
                if left == 0:
                    raise RuntimeError(f"{address}: {error}") from error
                time.sleep(self.wait * 2 ** (self.tries - 1 - left))
        raise AssertionError

    def _post(self, address: str, body: dict) -> dict:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(address, json.dumps(body).encode(), head)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as error:
            said = error.read()[:500].decode("utf-8", "replace")
            if error.code in PASSING:
                raise OSError(f"{error.code} {said}") from None
            raise Refused(f"{address} answered {error.code}: {said}") from None


def in_order(pool: ThreadPoolExecutor, work: Callable, items: Iterable, ahead: int) -> Iterator:
    """``work`` of each item, in the order of the items, with at most ``ahead`` of them begun and not given out."""
    begun: deque = deque()
    try:
        for item in items:
            begun.append(pool.submit(work, item))
            if len(begun) >= max(1, ahead):
                yield begun.popleft().result()
        while begun:
            yield begun.popleft().result()
    finally:
        for left in begun:
            left.cancel()


def vectors_of(found: object, expected: int) -> list[list[float]]:
    """The vectors of an answer, whichever of the services' shapes it has: data with indexes, embeddings, or one embedding."""
    if not isinstance(found, dict):
        raise Refused("the service's answer is no object")
    if found.get("data"):
        items = list(enumerate(found["data"]))
        if any("embedding" not in x for _, x in items):
            raise Refused("an item of the answer has no embedding")
        vectors = [x["embedding"] for _, x in sorted(items, key=lambda p: p[1].get("index", p[0]))]
    elif found.get("embeddings"):
        vectors = found["embeddings"]
    else:
        vectors = [found["embedding"]] if found.get("embedding") else []
    if len(vectors) != expected:
        raise Refused(f"the service gave {len(vectors)} vectors for {expected} texts")
    return vectors


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], *, text: str = "content", prefix: str = DOCUMENTS, batch: int = BATCH, clamp: int = CLAMP, ahead: int = 1) -> DataFrame:
    """``rows`` with ``embedding``, in the same row as its text, so vectors are never matched by position.

    ``ahead`` calls of the embedder, each with up to ``batch`` texts, are in flight in a task; vectors come in the order of the texts.
    """
    at = rows.columns.index(text)
    schema = S.StructType([*rows.schema.fields, S.StructField("embedding", S.ArrayType(S.FloatType()))])

    def inside(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ask(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = [(prefix + (t or ""))[:clamp] if clamp > 0 else prefix + (t or "") for t in part.column(at).to_pylist()]
            vectors = embedder(texts)
            if len(vectors) != len(texts):
                raise ValueError("the embedder gave another number of vectors than texts")
            found = pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float32()))
            return pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, "embedding"])

        parts = (b.slice(start, batch) for b in stream for start in range(0, b.num_rows, batch))
        with ThreadPoolExecutor(max(1, ahead)) as pool:
            yield from in_order(pool, ask, parts, ahead)

    return rows.mapInArrow(inside, schema)


def embed_new(rows: DataFrame, known: DataFrame, embedder: Callable[[list[str]], list[list[float]]], aside: Callable[[DataFrame], DataFrame], *, text: str = "content", **how) -> tuple[DataFrame, DataFrame]:
    """(rows with ``embedding``, the known vectors (text_hash, embedding) afterwards): each distinct text that isn't known is sent once.

    Texts are told apart by the SHA-256 of what is sent.  ``aside`` writes a table and reads it back, as vectors are asked for once and
    used twice; a text that very many rows have is one row of the small side of each join.
    """
    prefix, clamp = how.get("prefix", DOCUMENTS), how.get("clamp", CLAMP)
    sent = F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))
    keyed = rows.withColumn("text_hash", F.sha2((F.substring(sent, 1, clamp) if clamp > 0 else sent).cast("binary"), 256))
    new = keyed.join(known.select("text_hash"), "text_hash", "left_anti").groupBy("text_hash").agg(F.first(text).alias(text))
    made = aside(embed(new, embedder, text=text, **how).select("text_hash", "embedding"))
    after = known.select("text_hash", "embedding").unionByName(made)
    return keyed.join(after, "text_hash").select(*rows.columns, "embedding"), after
