"""Token ids of documents in binary files: written in order of a key, and read back.

Documents are dealt in ranges of the key.  Each task encodes its texts with the tokenizers library, a distinct word once while it is
remembered, and writes files; all texts are whole.  Words are cut at ASCII white space, which no token of such a tokenizer spans, and, for
models that part their text by PATTERN, also where that is sure to do so.  A file has groups of blocks, each block with a CRC-32 of its
ids, and ends with an index of its documents.  With ``compact`` each block is coded alone by ``idcoder``, else those of a group are written
as a Zstandard frame of 16-bit ids, which takes much less time:

    magic | group ... | index (Arrow stream: id, n_tokens) | offset of the index, int64 | magic
    group: blocks, uint32 | for each block: ids, words, crc32, uint32 | words of all blocks, uint16 (a frame, after whether a byte follows it, is the words of a group's first block)

The files' manifest is a table of a row per file, from which the number of ids before each file comes; files of attempts that failed
are not in it.  Reading takes a task per file, a group at a time.

Cases: a null text is an empty one and has the end id only; null keys come first; rows of one key are in order of their text's hash, and
rows that are equal in both by chance, so that many of them lie in several files; an empty table writes no file; texts and single words of any length;
extra columns are ignored; ids must be below 65,536.  A block whose ids don't have its checksum fails the job.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from . import idcoder
from .common import SEPARATORS, checkpoint_dir, cut, groups_of, views
from .warc import open_store

#: Of files of frames, and of files of the range coder.
MAGIC, COMPACT = b"IDFRAME1", b"IDRANGE1"
#: Fixed value: the frames' compression.
FRAMES = pa.Codec("zstd", compression_level=1)
#: Ids after which a file is closed, at the end of a document.
FILE_IDS = 1 << 25
#: Words that a worker remembers (some 200 bytes each), and bytes of text that it encodes at once; both bound memory only.
WORDS, TEXT_BYTES = 1_500_000, 1 << 25
#: Pre-tokens of the models whose words are also cut at ASCII signs and digits; each ends in an id of a token with END.
PATTERN, END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"
#: Kinds of bytes: white space, letters (of ASCII, and of two bytes from C3 on), digits, signs, the apostrophe, all others.
SPACE, LETTER, DIGIT, SIGN, QUOTE, OTHER = range(6)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[33:127] = SIGN
KINDS[[*range(65, 91), *range(97, 123)]], KINDS[48:58], KINDS[ord("'")], KINDS[ord("|")] = LETTER, DIGIT, QUOTE, OTHER
KINDS[list(SEPARATORS)] = SPACE
#: Whether a word begins between two kinds, at 8 * the first + the second: after white space, and where a pre-token is sure to end
#: (not after an apostrophe, which may begin a contraction, nor inside of special tokens, which have letters between bars).
WORDS_ONLY = np.zeros(64, bool)
WORDS_ONLY[[8 * SPACE + k for k in range(1, 6)]] = True
FINE = WORDS_ONLY.copy()
FINE[[8 * a + b for a, bs in ((LETTER, (DIGIT, SIGN, QUOTE)), (DIGIT, (LETTER, DIGIT, SIGN)), (SIGN, (LETTER, DIGIT))) for b in bs]] = True
PLAIN = re.compile("[a-zß-öø-ÿ]+")  # no step of such a model changes or parts these
#: Plain words that are encoded as one text.
JOINED = 500


class Words:
    """The tokenizer of a worker and the ids of the words that it has met, kept from task to task."""

    held: tuple[int, Words] | None = None

    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(model)
        self.fine = _is_fine(json.loads(model))
        if self.fine:
            self.merging = Tokenizer(self.tokenizer.model)  # the same merges without the steps that leave plain words as they are
            self.merging.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a pre-token
            self.last[[i for t, i in vocabulary.items() if t.endswith(END)]] = True
        self.forget()

    @classmethod
    def of(cls, model: str) -> Words:
        key = zlib.crc32(model.encode())
        if cls.held is None or cls.held[0] != key:
            cls.held = (key, cls(model))
        return cls.held[1]

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.ends = array("H"), array("q", [0])

    def numbers(self, words: list[str]) -> np.ndarray:
        """Of distinct words, their numbers in ``ends``; those that are new are encoded."""
        new = [w for w in words if w not in self.number]
        if len(self.number) + len(new) > WORDS:
            self.forget()
            new = words
        if self.fine:
            plain, rest = [], []
            for w in new:
                (plain if PLAIN.fullmatch(w) else rest).append(w)
            new = rest
            for a in range(0, len(plain), 100 * JOINED):
                self._keep_joined(plain[a : a + 100 * JOINED])
        for a in range(0, len(new), 10_000):
            part = new[a : a + 10_000]
            self._keep(part, [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)])
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def _keep_joined(self, words: list[str]) -> None:
        texts = [" ".join(words[a : a + JOINED]) for a in range(0, len(words), JOINED)]
        ids = np.concatenate([np.array(e.ids, np.uint16) for e in self.merging.encode_batch_fast(texts, add_special_tokens=False)])
        stops = np.flatnonzero(self.last[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            raise ValueError("a plain word isn't one pre-token")
        self._add(words, ids, stops)

    def _keep(self, words: list[str], ids: list[np.ndarray]) -> None:
        self._add(words, np.concatenate(ids), np.cumsum([len(i) for i in ids]))

    def _add(self, words: list[str], ids: np.ndarray, stops: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.ends) - 1, len(self.ends) - 1 + len(words)), strict=True))
        self.ends.frombytes((stops + len(self.flat)).astype("q").tobytes())
        self.flat.frombytes(ids.tobytes())


def _is_fine(model: dict) -> bool:
    """Whether a model lowers its text and cuts it by PATTERN, so that words can be cut where that pattern does."""
    steps = [(n.get("type"), n.get("pattern"), n.get("content")) for n in (model.get("normalizer") or {}).get("normalizers", [])]
    cuts = [{k: c.get(k) for k in ("type", "pattern", "behavior", "invert", "add_prefix_space", "use_regex")} for c in (model.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    split = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True, "add_prefix_space": None, "use_regex": None}
    level = {"type": "ByteLevel", "pattern": None, "behavior": None, "invert": None, "add_prefix_space": False, "use_regex": False}
    bpe = model["model"]
    return (
        steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)] and cuts == [split, level]
        and bpe.get("type") == "BPE" and bpe.get("end_of_word_suffix") == END and not any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
        and all(re.fullmatch(r"<\|[a-z]+\|>", t["content"]) and not t["lstrip"] and not t["rstrip"] for t in model.get("added_tokens", []))
        and model.get("post_processor") is None and model.get("truncation") is None and model.get("padding") is None
    )


def _cut(data: np.ndarray, at: np.ndarray, fine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, their offsets, their places in ``data``); ``fine``: words are parted by FINE, and letters of words without other bytes are in lower case."""
    raw = bytearray(data)
    kinds = np.frombuffer(raw.translate(KINDS.tobytes()), np.uint8)
    if fine:
        two = np.flatnonzero(data == 0xC3)
        two = two[(data[two + 1] & 0xDF) != 0x97]  # not the signs of multiplication and division
        kinds[two] = kinds[two + 1] = LETTER
    pairs = kinds[1:] + (kinds[:-1] << 3)
    begin = np.empty(len(data), bool)
    begin[1:] = np.frombuffer(pairs.tobytes().translate((FINE if fine else WORDS_ONLY).tobytes().ljust(256)), bool)
    inside = kinds != SPACE
    first = at[:-1][at[:-1] < at[1:]]
    begin[first] = inside[first]
    starts = np.flatnonzero(begin)
    offsets = np.append(np.flatnonzero(begin[inside]), np.count_nonzero(inside))
    held = data[inside]
    if fine and len(starts):
        low = np.frombuffer(raw.lower(), np.uint8)  # of ASCII alone
        low[two + 1] += (data[two + 1] < 0x9F) * np.uint8(32)
        low = low[inside]
        odd = np.flatnonzero(kinds[inside] == OTHER)
        if len(odd):
            mixed = np.zeros(len(starts), bool)
            mixed[np.searchsorted(offsets, odd, side="right") - 1] = True
            low = np.where(np.repeat(mixed, np.diff(offsets)), held, low)
        held = low
    return held, offsets, starts


def ids_of(texts: pa.Array, model: str, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each text); ``end`` closes each text.  An id above 65,535 is an error."""
    known = Words.of(model)
    data, at = views(texts)
    data, at = data[at[0] : at[-1]], at - at[0]
    held, offsets, starts = _cut(data, at, known.fine)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)])
    coded = words.dictionary_encode()
    number = known.numbers(coded.dictionary.to_pylist())
    flat, ends = np.array(known.flat, np.uint16), np.array(known.ends, np.int64)
    first, lengths = ends[:-1][number], np.diff(ends)[number]
    code = coded.indices.to_numpy(zero_copy_only=False)
    stops = np.searchsorted(starts, at[1:])
    if end is not None:  # a word more for each text
        code, stops = np.insert(code, stops, len(first)), stops + np.arange(1, len(texts) + 1)
        first, lengths, flat = np.append(first, len(flat)), np.append(lengths, 1), np.append(flat, np.uint16(end))
    counts = lengths[code]
    into = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=into[1:])
    small = np.int32 if max(into[-1], len(flat)) < 1 << 31 else np.int64
    places = np.repeat((first[code] - into[:-1]).astype(small), counts)
    places += np.arange(into[-1], dtype=small)
    ids, bounds = flat[places], into[np.append(0, stops)]
    return ids, np.diff(bounds)


class Writer:
    """One file: ids are added in order, and written as groups of blocks."""

    def __init__(self, store, path: str, kind: pa.DataType, compact: bool = False) -> None:
        self.out, self.kind, self.magic = store.open_output_stream(path, compression=None), kind, COMPACT if compact else MAGIC
        self.out.write(self.magic)
        self.at, self.held, self.n, self.total, self.keys, self.counts = len(MAGIC), [], 0, 0, [], []

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        while self.n >= idcoder.BLOCK * idcoder.LANES:
            self._write(idcoder.BLOCK * idcoder.LANES)

    def _write(self, n: int) -> None:
        whole = np.concatenate(self.held)
        now, rest = whole[:n], whole[n:]
        self.held, self.n, self.total = [rest], len(rest), self.total + n
        lanes = -(-n // idcoder.BLOCK)
        if self.magic == COMPACT:
            words = idcoder.encode(np.concatenate([now, np.zeros(lanes * idcoder.BLOCK - n, np.uint16)]).reshape(lanes, idcoder.BLOCK))
        else:
            frame = FRAMES.compress(now.astype("<u2").tobytes(), asbytes=True)
            odd = len(frame) % 2
            words = [np.frombuffer(struct.pack("<H", odd) + frame + b"\0" * odd, "<u2"), *[np.zeros(0, np.uint16)] * (lanes - 1)]
        wide = now.astype("<u4")
        parts = (wide[a : a + idcoder.BLOCK] for a in range(0, n, idcoder.BLOCK))
        head = np.array([(len(part), len(w), zlib.crc32(part)) for part, w in zip(parts, words, strict=True)], "<u4")
        raw = struct.pack("<I", lanes) + head.tobytes() + np.concatenate(words).astype("<u2", copy=False).tobytes()
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> int:
        if self.n:
            self._write(self.n)
        sink = pa.BufferOutputStream()
        table = pa.table([pa.chunked_array(self.keys, self.kind), pa.chunked_array(self.counts, pa.int64())], names=["id", "n_tokens"])
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        self.out.write(sink.getvalue().to_pybytes() + struct.pack("<q", self.at) + self.magic)
        self.out.close()
        return self.total


def index_of(source) -> pa.Table:
    size = source.size()
    at, magic = struct.unpack("<q8s", source.read_at(16, size - 16))
    if magic not in (MAGIC, COMPACT):
        raise ValueError("this is no file of ids")
    return pa.ipc.open_stream(source.read_at(size - 16 - at, at)).read_all()


def groups(source) -> Iterator[np.ndarray]:
    """The ids (uint16) of one group after another; every block is held against its checksum."""
    size = source.size()
    stop, magic = struct.unpack("<q8s", source.read_at(16, size - 16))
    at = len(MAGIC)
    while at < stop:
        (lanes,) = struct.unpack("<I", source.read_at(4, at))
        head = np.frombuffer(source.read_at(12 * lanes, at + 4), "<u4").reshape(lanes, 3)
        total = int(head[:, 1].sum())
        flat = np.frombuffer(source.read_at(2 * total, at + 4 + 12 * lanes), "<u2")
        if magic == COMPACT:
            found = idcoder.decode(np.split(flat, np.cumsum(head[:, 1])[:-1]), idcoder.BLOCK)
        else:
            found = _unframed(flat, int(head[:, 0].sum()), lanes)
        for row, (n, _, crc) in zip(found.astype("<u4"), head.tolist(), strict=True):
            if zlib.crc32(row[:n]) != crc:
                raise ValueError("a block doesn't have its checksum")
        yield found.reshape(-1)[: int(head[:, 0].sum())]  # only the last block is short
        at += 4 + 12 * lanes + 2 * total


def _unframed(flat: np.ndarray, n: int, lanes: int) -> np.ndarray:
    out = np.zeros(lanes * idcoder.BLOCK, np.uint16)
    try:
        out[:n] = np.frombuffer(FRAMES.decompress(flat.tobytes()[2 : 2 * len(flat) - int(flat[0])], 2 * n, asbytes=True), "<u2")
    except (OSError, ValueError) as e:
        raise ValueError("a frame is damaged, so its blocks don't have their checksum") from e
    return out.reshape(lanes, idcoder.BLOCK)


def write_ids(docs: DataFrame, model: str, *, end: int | None, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, file_ids: int = FILE_IDS, compact: bool = False) -> DataFrame:
    """Write the ids of all texts; returns the manifest: file, part, number, n_ids, start (ids in the files before)."""
    base = folder or f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/ids-{uuid.uuid4().hex}"
    kind = to_arrow_type(docs.schema[id_col].dataType)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "chance": F.rand(1)})
    ordered = rows.repartitionByRange("id", "hash", "chance").sortWithinPartitions("id", "hash").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(base)
        context = TaskContext.get()
        part, own, found = context.partitionId(), None, []

        def close() -> None:
            store.move(f"{name}.tmp", name) if (n := own.close()) is not None else None
            found.append((f"{base}/{name.rpartition('/')[2]}", part, len(found), n))

        for b in batches:
            texts = b.column(1)
            for a, z in groups_of(views(texts)[1], TEXT_BYTES):
                ids, counts = ids_of(texts.slice(a, z - a), model, end)
                keys, at, done = b.column(0).slice(a, z - a), np.concatenate([[0], np.cumsum(counts)]), 0
                while done < len(counts):
                    if own is None:
                        store.create_dir(path, recursive=True)
                        name = f"{path}/part-{part:05d}-{context.taskAttemptId()}-{len(found):04d}.ids"
                        own = Writer(store, f"{name}.tmp", kind, compact)
                    fits = int(np.searchsorted(at, at[done] + file_ids - own.total - own.n, side="left"))
                    to = min(max(fits, done + 1), len(counts))
                    own.add(ids[at[done] : at[to]])
                    own.keys.append(keys.slice(done, to - done))
                    own.counts.append(pa.array(counts[done:to], pa.int64()))
                    done = to
                    if own.total + own.n >= file_ids:
                        close()
                        own = None
        if own is not None:
            close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["file", "part", "number", "n_ids"])

    files = cut(ordered.mapInArrow(write, "file string, part int, number int, n_ids bigint"))
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(manifest: DataFrame, id_type: str = "bigint", *, id_col: str = "doc_id", ids: bool = False) -> DataFrame:
    """id_col, start, n_tokens, ids_crc32 (and ids, if asked for) of every document, out of the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, path = open_store(file)
                with store.open_input_file(path) as source:
                    index = index_of(source)
                    counts = index.column("n_tokens").to_numpy()
                    stops = np.cumsum(counts)
                    crc, doc, at, kept = np.zeros(len(counts), np.int64), 0, 0, []
                    lists: list[list[np.ndarray]] = [[] for _ in counts] if ids else []
                    for group in groups(source):
                        wide = group.astype("<u4")
                        while doc < len(counts):
                            a, z = max(int(stops[doc] - counts[doc]), at) - at, min(int(stops[doc]) - at, len(wide))
                            crc[doc] = zlib.crc32(wide[a:z], int(crc[doc]))
                            if ids:
                                lists[doc].append(group[a:z])
                            if stops[doc] > at + len(wide):
                                break
                            doc += 1
                        at += len(wide)
                    if at != (stops[-1] if len(stops) else 0):
                        raise ValueError("the file doesn't hold as many ids as its index says")
                kept = [index.column("id").combine_chunks(), pa.array(start + stops - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())]
                if ids:
                    kept.append(pa.array([np.concatenate(x).astype(np.int32) if x else [] for x in lists], pa.list_(pa.int32())))
                names = [id_col, "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]
                for batch in pa.table(kept, names=names).to_batches(max_chunksize=4096):
                    yield batch

    columns = f"`{id_col}` {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    each = max(1, manifest.count())  # a number of its own, or tiny rows would be packed into one task
    return manifest.select("file", "start").repartition(each).mapInArrow(read, columns)
