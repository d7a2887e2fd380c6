"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database per worker.

A batch of documents is cut into pre-tokens (see ``pretokens``); its distinct pre-tokens become
rows (word, position, token) that join the merge table.  Each step of the recursion contracts, in
every word that is not finished, the leftmost pair of minimum rank; a word leaves the recursion at
its fixpoint.  An ordered aggregation then gives the ids of each word, and another one, over the
join of those ids with the vocabulary, its decoded bytes.

Cases: a null text is an empty one; an empty text has no tokens, and both digests are that of the
empty string; repeated rows and clashing or extra columns don't matter, as rows are mapped one by
one.  A pre-token over ``long_word`` bytes would take as many recursion steps as it has bytes; it
is contracted by the same rule with a priority queue instead, so whole texts of any kind finish.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parts
from . import pretokens

#: Pre-tokens of more bytes are contracted with a priority queue.
LONG_WORD = 256
#: Words of one recursive query, and of a worker's memory of words; both bound memory only.
QUERY_WORDS = 40_000
KNOWN_WORDS = 400_000

#: Stands for "this pair doesn't merge"; above every rank.
NEVER = 2147483647
#: Token-position rows join the merge table once; a word's tokens and the ranks of its pairs are then the state of
#: the recursion, whose steps contract the leftmost pair of minimum rank and look up the two new pairs only.
ENCODE = f"""
WITH RECURSIVE pairs AS (
    SELECT s.word, s.pos, s.token, coalesce(m.merged, {NEVER}) AS rank
    FROM symbols s LEFT JOIN merges m ON m.a = s.token AND m.b = s.following
), steps AS (
    SELECT word, list(token ORDER BY pos) AS tokens, list(rank ORDER BY pos) AS ranks, list_min(list(rank)) AS least
    FROM pairs GROUP BY word
    UNION ALL
    SELECT c.word, c.before || [c.least] || c.after,
           c.ranks_before || CASE WHEN i = 1 THEN [] ELSE [coalesce(l.merged, {NEVER})] END || [coalesce(r.merged, {NEVER})] || c.ranks_after,
           least(coalesce(l.merged, {NEVER}), coalesce(r.merged, {NEVER}), coalesce(list_min(c.ranks_before), {NEVER}), coalesce(list_min(c.ranks_after), {NEVER}))
    FROM (
        SELECT word, least, tokens[1:i - 1] AS before, tokens[i + 2:] AS after, tokens[i - 1] AS left_of, tokens[i + 2] AS right_of,
               ranks[1:greatest(i - 2, 0)] AS ranks_before, ranks[i + 2:] AS ranks_after, i
        FROM (SELECT word, tokens, ranks, least, list_position(ranks, least) AS i FROM steps WHERE least < {NEVER})
    ) c
    LEFT JOIN merges l ON l.a = c.left_of AND l.b = c.least
    LEFT JOIN merges r ON r.a = c.least AND r.b = c.right_of
)
SELECT word, len(tokens) AS n, tokens, array_to_string(tokens, ',') AS ids FROM steps WHERE least = {NEVER}
"""
#: Ids back to bytes: the vocabulary's hexadecimal strings in the order of the ids.
DECODE = """
SELECT i.word, string_agg(v.hex, '' ORDER BY i.at) AS hex
FROM (SELECT word, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS at FROM encoded) i
JOIN vocabulary v USING (token) GROUP BY i.word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of base64 tokens and numbers."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def contract(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by a queue of (rank, position): what the recursion does, for long words."""
    n = len(word)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = bytearray(b"\1") * n
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = end[i]
        if not alive[i] or j >= n or not alive[j] or end[j] != stop:
            continue
        alive[j] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(queue, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(queue, (r, h, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


@dataclass
class Codec:
    """The merge table and the vocabulary in a DuckDB database of this process."""

    ranks: dict[bytes, int]
    long_word: int = LONG_WORD

    def __post_init__(self) -> None:
        import duckdb

        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        a, b, merged = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    a.append(left), b.append(right), merged.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.db.execute("SET preserve_insertion_order = false")
        self._table("merges", pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "merged": pa.array(merged, pa.int32())}))
        self._table("vocabulary", pa.table({"token": pa.array(list(self.bytes_of), pa.int32()), "hex": [x.hex() for x in self.bytes_of.values()]}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def learn(self, words: list[str]) -> None:
        """Encode and decode words that aren't known yet."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        queried = []
        for w, b in zip(words, raw, strict=True):
            if b in self.ranks:  # a pre-token that is a token: the library takes it whole
                self.known[w] = (1, str(self.ranks[b]), b)
            elif len(b) > self.long_word:
                ids = contract(b, self.ranks)
                self.known[w] = (len(ids), ",".join(map(str, ids)), b"".join(map(self.bytes_of.__getitem__, ids)))
            else:
                queried.append((w, b))
        for at in range(0, len(queried), QUERY_WORDS):
            part = queried[at : at + QUERY_WORDS]
            self._query([w for w, _ in part], [b for _, b in part])

    def _query(self, words: list[str], raw: list[bytes]) -> None:
        import numpy as np

        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        word = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        pos = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        token = np.asarray(self.single, np.int32)[np.frombuffer(b"".join(raw), np.uint8)]
        following = np.append(token[1:], -1)
        following[np.cumsum(sizes) - 1] = -1  # a word's last symbol has no pair
        self._table("symbols", pa.table({"word": word, "pos": pos.astype(np.int32), "token": token, "following": following.astype(np.int32)}))
        self.db.execute(f"CREATE OR REPLACE TABLE encoded AS {ENCODE}")
        rows = self.db.execute(f"SELECT word, n, ids, hex FROM encoded JOIN ({DECODE}) USING (word)").fetchall()
        self.known.update((words[i], (n, ids, bytes.fromhex(x))) for i, n, ids, x in rows)

    def documents(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """(number of ids, ids joined by commas, decoded bytes) of each text."""
        import numpy as np

        for at, end, bounds, codes, words in pretokens.pieces(texts):
            new = [w for w in words if w not in self.known]
            if len(self.known) + len(new) > KNOWN_WORDS:
                self.known.clear()
                new = words
            self.learn(new)
            found = [self.known[w] for w in words]
            counts = np.fromiter((f[0] for f in found), np.int64, len(found))
            ids, plain = np.empty(len(found), object), np.empty(len(found), object)
            ids[:], plain[:] = [f[1] for f in found], [f[2] for f in found]
            for i in range(end - at):
                c = codes[bounds[i] : bounds[i + 1]]
                yield int(counts[c].sum()), ",".join(ids[c].tolist()), b"".join(plain[c].tolist())


_codecs: dict[tuple[int, int], Codec] = {}


def codec(ranks: bytes, long_word: int) -> Codec:
    """This worker's codec for a rank file's content."""
    key = (hash(ranks), long_word)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, long_word)
    return _codecs[key]


def encode_decode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, long_word: int = LONG_WORD) -> DataFrame:
    """Encode every text by the ranks in ``path`` and decode the ids again.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids (array of int)
    and decoded (binary).  One pass without a shuffle.
    """
    spark: SparkSession = docs.sparkSession
    with open(path, "rb") as f:  # the vocabulary has a fixed size, whatever the corpus has
        content = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value, long_word)
        for batch in (b.slice(at, to - at) for b in batches for at, to in parts(b.column(1))):  # Python's texts of one part at a time
            n, a, b, ids, plain = [], [], [], [], []
            for count, joined, decoded in own.documents(batch.column(1).to_pylist()):
                n.append(count)
                a.append(hashlib.sha256(joined.encode()).hexdigest())
                b.append(hashlib.sha256(decoded).hexdigest())
                if keep_ids:
                    ids.append([int(x) for x in joined.split(",")] if joined else [])
                    plain.append(decoded)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(plain, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).mapInArrow(encode, schema)
