"""Language identification by fusing evidence with Bayes' rule.

For each document, over the languages of the model and ``und`` (none of them):

    posterior ~ text likelihood * P(declared language | language) * P(address suffix | language) * prior of the host

* Text: a naive Bayes model of hashed byte trigrams, read over the whole text.  Its log likelihood is
  tempered to that of ``EVIDENCE`` trigrams, since neighbouring trigrams aren't independent.  ``und`` is
  the uniform distribution over trigrams, so only text unlike every language falls to it.
* Declared language and suffix: counts of (language by text alone, value) over all documents, smoothed.
* Host: soft counts by host, smoothed towards those of its suffix, those towards all documents.

The model is fitted on a bounded sample of labelled rows, about ``SAMPLE`` distinct texts per language, chosen by
a hash of the text; every label with at least ``LEAST_ROWS`` rows is a language, however many there are, and a
label with fewer is evidence only.  Every other count covers all documents.  A document is rejected if its language is
``und`` or its posterior is below ``LEAST``.

Cases: null and empty texts, and texts without a letter, have no language (``und``, posterior 1.0) and
are rejected; a null declared language, suffix or host is no evidence; ties go to the language first in
order; without any labelled row every document is ``und``; repeated rows are decided alike; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, groups_of, small, views

UNKNOWN = "und"
#: Parameters: labelled rows per language that the model is fitted on, and rows a label needs; a column with more labels
#: than ``LABELS`` doesn't hold languages, and the fit fails. Numbers that a broadcast table of hosts may hold.
SAMPLE, LEAST_ROWS, LABELS, NUMBERS = 500, 3, 4096, 4_000_000
BUCKETS = 1 << 16
#: Trigrams that a text's evidence counts as, at most; prior of ``und``; smoothing of hosts and suffixes; least posterior.
EVIDENCE, UNKNOWN_PRIOR, HOST_WEIGHT, VALUE_WEIGHT, LEAST = 64.0, 0.01, 20.0, 10.0, 0.5
SLICE = 1 << 20
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[ord("A") : ord("Z") + 1] += 32


def trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that begins at each byte (two fewer than bytes)."""
    low = _LOWER[data]
    code = low[:-2] | (low[1:-1] << np.uint32(8)) | (low[2:] << np.uint32(16))
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log probability of a bucket by language, the last column ``und``

    def likelihoods(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sums of log probabilities by text and language, trigrams by text)."""
        data, offsets = views(text)
        sums = np.zeros((len(text), self.table.shape[1]))
        n = np.maximum(np.diff(offsets) - 2, 0)
        for a, b in groups_of(offsets, SLICE):
            for i in range(a, b):  # a text at a time: whole texts, in slices that overlap by a trigram
                for at in range(offsets[i], offsets[i + 1] - 2, SLICE):
                    found = trigrams(data[at : min(at + SLICE + 2, offsets[i + 1])])
                    sums[i] += np.bincount(found, minlength=BUCKETS) @ self.table if len(found) > BUCKETS else self.table[found].sum(axis=0, dtype=float)
        return sums, n


def fit(docs: DataFrame, text_col: str, label_col: str, sample: int = SAMPLE) -> Model:
    """The trigram model of the labels in ``label_col``; its counts have a fixed size, languages by buckets."""
    labels = docs.where(F.col(label_col).isNotNull() & (F.length(text_col) > 0)).groupBy(label_col).agg(F.count("*").alias("n"))
    known = {r[0]: r["n"] for r in labels.where(f"n >= {LEAST_ROWS}").limit(LABELS + 1).collect()}
    if len(known) > LABELS:
        raise ValueError(f"{label_col} has more than {LABELS} labels")
    if not known:
        return Model([], np.full((BUCKETS, 1), -math.log(BUCKETS), np.float32))
    chance = F.create_map(*(F.lit(x) for k, n in known.items() for x in (k, sample / n)))
    drawn = F.pmod(F.xxhash64(text_col, F.lit(11)), F.lit(1 << 20)) < F.element_at(chance, F.col(label_col)) * (1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            data, offsets = views(b.column(1))
            for i, label in enumerate(b.column(0).to_pylist()):
                for at in range(offsets[i], offsets[i + 1] - 2, SLICE):
                    found = trigrams(data[at : min(at + SLICE + 2, offsets[i + 1])])
                    sums.setdefault(label, np.zeros(BUCKETS, np.int64))
                    sums[label] += np.bincount(found, minlength=BUCKETS)
        for label, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["label", "bucket", "n"])

    rows = docs.where(F.col(label_col).isin(*known) & drawn).select(F.col(label_col).cast("string"), text_col).distinct().mapInArrow(count, "label string, bucket int, n bigint")
    found = rows.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted({str(k) for k in known})
    counts = np.full((BUCKETS, len(languages)), 0.01)
    place = {x: i for i, x in enumerate(languages)}
    np.add.at(counts, (found["bucket"].to_numpy(), [place[x] for x in found["label"].to_pylist()]), found["n"].to_numpy())
    table = np.log(counts / counts.sum(axis=0))
    return Model(languages, np.column_stack([table, np.full(BUCKETS, -math.log(BUCKETS))]).astype(np.float32))


def identify(docs: DataFrame, *, key: str = "doc_id", text: str = "text", declared: str | None = "lang", host: str | None = "source", suffix: str | None = None, model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """key, language, posterior, declared, accepted and by_text (the language by text alone) of every row.

    The text is read once (twice with the fitting) and never shuffled; what is aggregated is the likelihoods.
    """
    model = model or fit(docs, text, declared, sample)
    names = [*model.languages, UNKNOWN]
    table = docs.sparkSession.sparkContext.broadcast((model.languages, model.table))
    column = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    letters = F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))
    rows = docs.select(F.col(key).alias("key"), column(declared).alias("declared"), column(host).alias("host"), column(suffix).alias("suffix"), letters.alias("letters"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*table.value)
        for b in batches:
            sums, n = own.likelihoods(b.column(5))
            temper = np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]
            scores = sums * temper
            flat = pa.array(scores.ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * scores.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], lists], names=["key", "declared", "host", "suffix", "letters", "text_score"])

    kind = docs.schema[key].dataType.simpleString()
    read = cut(rows.mapInArrow(score, f"key {kind}, declared string, host string, suffix string, letters boolean, text_score array<double>"))
    k = len(names)
    base = F.array(*[F.lit(math.log((1 - UNKNOWN_PRIOR) / max(k - 1, 1)))] * (k - 1), F.lit(math.log(UNKNOWN_PRIOR)))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    by_text = _softmax(plus(F.col("text_score"), base))
    read = read.withColumn("p", by_text)
    lettered = read.where("letters")
    sums = [F.sum(F.element_at("p", i + 1)) for i in range(k)]
    total = lettered.agg(*sums).first()
    total = np.array([x or 0.0 for x in total]) + 1.0 / k
    overall = (total / total.sum()).tolist()

    def smoothed(counts: Column, parent: Column, weight: float) -> Column:
        n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, parent, lambda c, p: (c + weight * p) / (n + weight))

    everyone = F.array(*map(F.lit, overall))
    counted = lambda *cols: cut(lettered.where(" AND ".join(f"{c} IS NOT NULL" for c in cols[-1:])).groupBy(*cols).agg(F.array(*sums).alias("c")))
    by_suffix = counted("suffix").withColumn("suffix_p", smoothed(F.col("c"), everyone, HOST_WEIGHT))
    by_host = counted("suffix", "host").withColumn("same", F.coalesce("suffix", F.lit("")))
    parents = by_suffix.select(F.col("suffix").alias("same"), "suffix_p")
    by_host = by_host.join(parents, "same", "left").withColumn("host_p", smoothed(F.col("c"), F.coalesce("suffix_p", everyone), HOST_WEIGHT))
    by_host = cut(by_host.select("same", "host", "host_p"))
    out = read.withColumn("same", F.coalesce("suffix", F.lit(""))).join(small(by_host, NUMBERS // k), ["same", "host"], "left")
    prior = F.transform(F.coalesce("host_p", everyone), lambda x: F.log(x))

    def given(value: str) -> DataFrame:
        """Log P(value | language) from soft counts; a value nobody has doesn't occur."""
        c = counted(value)
        n = c.count()
        share = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.log((F.get("c", i) + VALUE_WEIGHT / max(n, 1)) / (F.get(F.array(*map(F.lit, total.tolist())), i) + VALUE_WEIGHT)))
        return c.select(value, share.alias(f"{value}_score"))

    nothing = F.array(*[F.lit(0.0)] * k)
    for value in ("declared", "suffix"):
        out = out.join(small(cut(given(value)), NUMBERS // k), value, "left")
    fused = _softmax(plus(plus(plus(F.col("text_score"), prior), F.coalesce("declared_score", nothing)), F.coalesce("suffix_score", nothing)))
    best = F.array_max("fused")
    out = out.withColumn("fused", fused)
    named = F.element_at(F.array(*map(F.lit, names)), F.array_position("fused", best).cast("int"))
    out = out.withColumns({"language": F.when(F.col("letters"), named).otherwise(UNKNOWN), "posterior": F.when(F.col("letters"), best).otherwise(1.0)})
    accepted = (F.col("language") != UNKNOWN) & (F.col("posterior") >= LEAST)
    alone = F.when(F.col("letters"), F.element_at(F.array(*map(F.lit, names)), F.array_position("p", F.array_max("p")).cast("int"))).otherwise(UNKNOWN)
    return out.select(F.col("key").alias(key), "language", F.round("posterior", 6).alias("posterior"), "declared", accepted.alias("accepted"), alone.alias("by_text"))


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def page_columns(pages: DataFrame) -> DataFrame:
    """``pages`` with text (tags, scripts and styles removed), declared (the html's lang), host and suffix of the address."""
    html = F.coalesce(F.col("html"), F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return pages.withColumns(
        {
            "text": bare,
            "declared": F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([a-z]{2,3})", 1)), F.lit("")),
            "host": F.nullif(host, F.lit("")),
            "suffix": F.nullif(F.regexp_extract(host, r"([^.]+)$", 1), F.lit("")),
        }
    )
