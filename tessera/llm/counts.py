"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

The distinct pre-tokens of a batch are inserted into a trie, and each trie node gets its forward score
once: the best score of any segmentation of the prefix that it stands for, and the number of tokens in
it (of equal scores the fewest).  Pre-tokens share the work of their common prefixes; a terminal node
stores its pre-token's count, and a document's count is the sum over its pre-tokens.

The model is fitted on the corpus.  All pre-tokens of all texts are counted in a grouped aggregation; each distinct
one is segmented once under a first model, in which a token of rank r has a probability proportional to
1 / (r + 1) ** exponent; and the tokens of these segmentations, weighted by the pre-tokens' counts, give the
probabilities (n + ``SMOOTHING``) / (all + ``SMOOTHING`` * vocabulary).  What comes to the driver has the size of the
vocabulary.  Every byte is a token, so every text has a segmentation.

Cases: a null text is an empty one and has no tokens; very long pre-tokens take time in proportion to
their length; repeated rows are counted row by row; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens

#: Parameters of the model, and the words that a worker remembers (a bound of memory only).
EXPONENT, SMOOTHING = 1.0, 1.0
KNOWN_WORDS = 500_000


def scores(ranks: dict[bytes, int], exponent: float = EXPONENT) -> dict[bytes, float]:
    """Log probabilities by rank."""
    total = math.log(sum((r + 1) ** -exponent for r in ranks.values()))
    return {t: -exponent * math.log(r + 1) - total for t, r in ranks.items()}


def smoothed(ranks: dict[bytes, int], found: dict[int, int], smoothing: float = SMOOTHING) -> dict[bytes, float]:
    """Log probabilities by the counts of ranks."""
    total = math.log(sum(found.values()) + smoothing * len(ranks))
    return {t: math.log(found.get(r, 0) + smoothing) - total for t, r in ranks.items()}


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


class Counter:
    def __init__(self, log_probabilities: dict[bytes, float]) -> None:
        self.score = log_probabilities
        self.longest = max(map(len, log_probabilities))
        self.known: dict[str, tuple[int, float]] = {}

    def learn(self, words: list[str]) -> None:
        """Forward scores of all nodes of the words' trie, walked depth first.

        Sorted words visit a trie's nodes in that order, so the path from the root is a stack and only
        the nodes that a word does not share with the one before are new.
        """
        rows = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words)
        score, longest, path, best, count = self.score.get, self.longest, b"", [0.0], [0]
        for raw, word in rows:
            shared, most = 0, min(len(raw), len(path))
            if raw[:most] == path[:most]:
                shared = most
            else:
                while raw[shared] == path[shared]:
                    shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                top, n = -math.inf, 0
                for begin in range(max(0, end - longest), end):
                    s = score(raw[begin:end])
                    if s is not None:
                        s += best[begin]
                        if s > top or (s == top and count[begin] + 1 < n):
                            top, n = s, count[begin] + 1
                best.append(top)
                count.append(n)
            path = raw
            self.known[word] = (count[len(raw)], best[len(raw)])

    def pieces(self, word: str) -> list[bytes]:
        """The tokens of a word's best segmentation: of equal scores the fewest, then the longest last token."""
        raw, best = word.encode("utf-8", "surrogatepass"), [(0.0, 0, 0)]
        for end in range(1, len(raw) + 1):
            top = (-math.inf, 0, 0)
            for begin in range(max(0, end - self.longest), end):
                if (s := self.score.get(raw[begin:end])) is not None:
                    s, n = s + best[begin][0], best[begin][1] + 1
                    if s > top[0] or (s == top[0] and n < top[1]):
                        top = (s, n, begin)
            best.append(top)
        out, end = [], len(raw)
        while end:
            out.append(raw[best[end][2] : end])
            end = best[end][2]
        return out

    def documents(self, texts: list[str]) -> Iterator[tuple[int, int, float]]:
        """(pre-tokens, tokens, log probability) of each text."""
        for at, end, bounds, codes, words in pretokens.pieces(texts):
            new = [w for w in words if w not in self.known]
            if len(self.known) + len(new) > KNOWN_WORDS:
                self.known.clear()
                new = words
            self.learn(new)
            found = [self.known[w] for w in words]
            n = np.fromiter((f[0] for f in found), np.int64, len(found))[codes] if found else np.zeros(0, np.int64)
            s = np.fromiter((f[1] for f in found), float, len(found))[codes] if found else np.zeros(0)
            for i in range(end - at):
                a, b = bounds[i], bounds[i + 1]
                yield int(b - a), int(n[a:b].sum()), math.fsum(s[a:b].tolist())


_counters: dict[tuple, Counter] = {}


def _counter(raw: bytes, key: tuple, model) -> Counter:
    """The worker's counter of a model, made once."""
    if (hash(raw), *key) not in _counters:
        _counters.clear()
        _counters[hash(raw), *key] = Counter(model(read_ranks(raw)))
    return _counters[hash(raw), *key]


def fit(docs: DataFrame, path: str, *, text_col: str = "text", exponent: float = EXPONENT) -> dict[int, int]:
    """How often each rank occurs in the first model's segmentation of all texts."""
    with open(path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, _, codes, found in pretokens.pieces(b.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(np.bincount(codes, minlength=len(found)), pa.int64())], names=["word", "n"])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _counter(content.value, (exponent,), lambda ranks: scores(ranks, exponent))
        ranks, sums = read_ranks(content.value), {}
        for b in batches:
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for piece in own.pieces(word):
                    sums[ranks[piece]] = sums.get(ranks[piece], 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.int64())], names=["rank", "n"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = texts.mapInArrow(words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = counted.mapInArrow(cut_up, "rank int, n bigint").groupBy("rank").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(found["rank"].to_pylist(), found["n"].to_pylist(), strict=True))


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", exponent: float = EXPONENT) -> DataFrame:
    """id_col, n_pretokens, n_tokens, log_prob of every text, by the tokens in ``path`` under the model that is fitted on all texts."""
    found = fit(docs, path, text_col=text_col, exponent=exponent)
    with open(path, "rb") as f:  # the vocabulary has a fixed size, whatever the corpus has
        content = docs.sparkSession.sparkContext.broadcast((f.read(), found))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, known = content.value
        own = _counter(raw, (tuple(sorted(known.items())),), lambda ranks: smoothed(ranks, known))
        for batch in batches:
            rows = list(own.documents(batch.column(1).to_pylist()))
            a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=[id_col, "n_pretokens", "n_tokens", "log_prob"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    return rows.mapInArrow(count, f"{id_col} {kind}, n_pretokens bigint, n_tokens bigint, log_prob double")
