"""Each operator against a plain version: on the small tables, and on odd rows."""

from __future__ import annotations

import collections
import gzip
import math
import random

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, common, counts, digests, langid, mixing, neardup, ngram_join, pretokens, queries, rindex, shingles, suffixdedup, warc

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key string, node int, size int, text_score int, h string"
rng = random.Random(5)
PASSAGE = "".join(rng.choice("abcdefghij \n") for _ in range(900))
LONG = " ".join(f"w{i}é" for i in range(30_000))


def odd_rows():
    plain = lambda i, t, source="s": (i, t, "en", source, None if t is None else len(t), "key", 1, 2, 3, "h")
    rows = [plain(1, None), plain(2, ""), plain(3, " \n\t"), plain(4, "one two"), plain(5, "one two"), plain(6, LONG), plain(7, LONG + " more"), plain(8, "x" * 700), plain(8, "x" * 700)]
    rows += [plain(9, "begin " + PASSAGE + " end"), plain(10, "other " + PASSAGE[:500]), plain(None, "one two"), plain(12, "same words here are five and more", None), plain(13, "\U0001f600 naïve Straße ﬁ ① ½ 'tis", "\U0001f600")]
    return [(*r[:2], None if r[0] == 4 else r[2], *r[3:]) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(data):
    return pd.read_parquet(f"{data}/documents.parquet")


def bag(df):
    return collections.Counter(map(tuple, df.collect()))


# 1: Jaccard join


def test_jaccard_join(spark, data, documents):
    rows = list(zip(documents.doc_id, documents.text, strict=True))
    found = queries.ngram_jaccard_join(spark, data)
    assert bag(found) == collections.Counter((k, *x) for (k, _), x in zip(rows, brute.jaccard(rows), strict=True))


def test_jaccard_join_odd_rows(odd, nothing):
    rows = [(r[0], r[1]) for r in odd_rows()]
    found = ngram_join.join(odd).drop("row_key", "class_key")
    assert bag(found) == collections.Counter((k, *x) for (k, _), x in zip(rows, brute.jaccard(rows), strict=True))
    assert ngram_join.join(nothing).count() == 0


def test_jaccard_join_of_a_large_group_with_a_common_passage(spark):
    """Buckets that stay large are split to the last level, and compared in blocks."""
    r = random.Random(1)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        w = list(base)
        w[r.randrange(60)] = f"x{r.random()}"
        texts.append(" ".join(w))
    common = " ".join(f"c{i}" for i in range(12))
    texts += [common + " " + " ".join(f"{r.random()}" for _ in range(30)) for _ in range(80)]
    rows = list(enumerate(texts))
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string"), leaf=8, block=16)
    got, want = bag(found.select("doc_id", "class_id", "n_links")), collections.Counter((k, *x) for (k, _), x in zip(rows, brute.jaccard(rows), strict=True))
    assert got == want


@given(st.lists(st.text(alphabet=" \t\nabcé\x0b\x0c\r ", max_size=60), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_shingles(texts):
    import pyarrow as pa

    data, offsets = common.views(pa.array(texts))
    found, bounds = shingles.shingles(data, offsets)
    known = {}
    for i, t in enumerate(texts):
        w = brute.words(t)
        want = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
        got = found[bounds[i] : bounds[i + 1]].tolist()
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert known.setdefault(b, a) == a
    assert len(set(known.values())) == len(known)


# 2: mixing


def mixed(rows, weights=(5, 2, 1), most=3):
    """Targets of rows (source, size)."""
    sizes = collections.Counter()
    for s, n in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, free = total - most * sum(sizes[s] for s in full), [s for s in order if s not in full]
        share = {s: w[s] * rest / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else share[s] for s in order}, sizes
        full |= over


def test_mixing(spark, data, documents):
    rows = [(s, len(brute.words(t))) for s, t in zip(documents.source, documents.text, strict=True)]
    want, sizes = mixed(rows)
    found = mixing.mix(spark.read.parquet(f"{data}/documents.parquet")).toPandas()
    assert collections.Counter(zip(found.source, found["size"], strict=True)) == collections.Counter(rows)
    assert all(math.isclose(t, want[s], rel_tol=1e-9) for s, t in zip(found.source, found.target, strict=True))
    assert all(n == sizes[s] for s, n in zip(found.source, found.source_size, strict=True))
    assert (found.taken <= 3 * found["size"]).all() and (found.taken == found.copies * found["size"]).all()
    taken = found.groupby("source").taken.sum()
    largest = found.groupby("source")["size"].max()
    assert all(abs(taken[s] - want[s]) <= max(0.02 * want[s], 0.5 * largest[s]) for s in taken.index)
    inside = found[(found.rate > 0) & (found.rate < 3)]
    for s, g in inside.groupby("source"):  # the rates solve the dual
        assert math.isclose((found[found.source == s].rate * found[found.source == s]["size"]).sum(), want[s], rel_tol=1e-5)
        tilt = np.log(g.rate) / g["size"]
        assert np.allclose(tilt, tilt.iloc[0], rtol=1e-6, atol=1e-12)
    again = mixing.mix(spark.read.parquet(f"{data}/documents.parquet").repartition(7))
    assert bag(again.select("doc_id", "taken")) == collections.Counter(zip(found.doc_id, found.taken, strict=True))


def test_mixing_odd_rows(odd, nothing):
    want, _ = mixed([(r[3], len(brute.words(r[1]))) for r in odd_rows()])
    found = mixing.mix(odd).toPandas()
    assert len(found) == len(odd_rows())
    assert all(math.isclose(t, want[None if pd.isna(s) else s], rel_tol=1e-9) for s, t in zip(found.source, found.target, strict=True))
    assert (found.taken[found["size"] == 0] == 0).all()
    assert mixing.mix(nothing).count() == 0


# 3: repeated strings


def test_repeated_strings(spark, data, documents):
    found = queries.suffix_array_dedup(spark, data)
    want = [(n, g, s, brute.sha(k)) for n, g, s, k in brute.removed(documents.text)]
    passages = [(len(p), sum(e - b for b, e in p)) for p in brute.passages(documents.text)]
    assert any(n and not w[1] for (n, _), w in zip(passages, want, strict=True))  # the words find more
    assert bag(found) == collections.Counter((i, *x, *p) for i, x, p in zip(documents.doc_id, want, passages, strict=True))


def test_without_the_index_nothing_is_removed(spark, data, monkeypatch):
    """The run-length index decides: what its statistics don't say is kept, whatever anchors and contexts there are."""
    monkeypatch.setattr(rindex.RunIndex, "statistics", lambda self: iter([(np.arange(len(self.group)), np.full(len(self.group), -1))]))
    rows = pd.read_parquet(f"{data}/documents.parquet")
    batch = pa.RecordBatch.from_arrays([pa.array([{"a": i, "b": i} for i in rows.doc_id]), pa.array(rows.text)], names=["row_key", "text"])
    seen = pa.Table.from_batches(suffixdedup._anchors((suffixdedup.STRINGS,))(iter([batch]))).to_pandas()
    seen["doc"] = [x["a"] for x in seen.row_key]
    places = seen.groupby("doc").apply(lambda g: [{"pos": p, "unit": 0, "h": h, "ctx": c, "n": 1} for p, h, c in zip(g.pos, g.h, g.ctx, strict=True)], include_groups=False)
    kind = pa.list_(pa.struct([("pos", pa.int64()), ("unit", pa.int8()), ("h", pa.int64()), ("ctx", pa.int64()), ("n", pa.int64())]))
    text = rows.set_index("doc_id").text
    asked = pa.RecordBatch.from_arrays([pa.array([text[i] for i in places.index]), pa.array(places.tolist(), kind)], names=["text", "places"])
    contexts = pa.Table.from_batches(suffixdedup._contexts((suffixdedup.STRINGS,))(iter([asked]))).sort_by([("unit", "ascending"), ("h", "ascending"), ("g", "ascending")])
    run = lambda: sum(b.num_rows for b in suffixdedup._index((suffixdedup.STRINGS,))(iter(contexts.combine_chunks().to_batches())))
    assert run() == 0
    monkeypatch.undo()
    assert run() > 0


@pytest.mark.parametrize("hot", [suffixdedup.HOT, 1])
def test_repeated_strings_odd_rows(odd, nothing, hot):
    rows = odd_rows()
    want = brute.removed([r[1] for r in rows])
    got = bag(suffixdedup.deduplicate(odd, keep=["row_key", "h"], hot=hot))
    assert got == collections.Counter((r[0], "key", "h", n, g, s, brute.sha(k)) for r, (n, g, s, k) in zip(rows, want, strict=True))
    got = bag(suffixdedup.deduplicate(odd, keep=["h"], texts="left", hot=hot))
    assert got == collections.Counter((r[0], "h", k.decode("utf-8", "ignore")) for r, (_, _, _, k) in zip(rows, want, strict=True))
    assert suffixdedup.deduplicate(nothing).count() == 0


@pytest.mark.parametrize("hot", [suffixdedup.HOT, 1])
@pytest.mark.parametrize("slice_", [suffixdedup.SLICE, 600])
def test_repeated_strings_at_random(spark, monkeypatch, hot, slice_):
    """Edits, shifted repeats, periods and short texts, with small strings so that all happens often; long texts in slices."""
    monkeypatch.setattr(suffixdedup, "SLICE", slice_)
    r = random.Random(hot)
    base = ["".join(r.choice("ab") for _ in range(400)) for _ in range(3)]
    texts = []
    for _ in range(60):
        t = r.choice(base)
        a = r.randrange(len(t))
        t = t[a:] + t[: r.randrange(len(t))]
        for _ in range(r.randrange(4)):
            p = r.randrange(len(t) + 1)
            t = t[:p] + r.choice("abc") + t[p:]
        texts.append(t[: r.randrange(100, 1200)])
    texts += ["ab" * 300, "é" * 200, "a" * 136, "a" * 135]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    measure = suffixdedup.Measure(suffixdedup.BYTES, 136, 64)
    # the slices are set in this process only, so the functions run here
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["row_key", "text"])
    here = pa.Table.from_batches(suffixdedup._anchors((measure,))(iter([batch]))).to_pandas().drop_duplicates()
    monkeypatch.setattr(suffixdedup, "SLICE", 1 << 20)
    whole = pa.Table.from_batches(suffixdedup._anchors((measure,))(iter([batch]))).to_pandas()
    assert set(map(tuple, here.values)) == set(map(tuple, whole.values))
    found = suffixdedup.deduplicate(df, strings=measure, hot=hot)
    want = [(n, g, s, brute.sha(k)) for n, g, s, k in brute.removed(texts, 136)]
    assert bag(found) == collections.Counter((i, *x) for i, x in enumerate(want))


@pytest.mark.parametrize("hot", [suffixdedup.HOT, 1])
def test_passages_at_random(spark, hot):
    r = random.Random(3)
    base = [[r.choice("ab") for _ in range(90)] for _ in range(3)]
    texts = []
    for _ in range(60):
        t = list(r.choice(base))
        a = r.randrange(len(t))
        t = t[a:] + t[: r.randrange(len(t))]
        for _ in range(r.randrange(4)):
            t.insert(r.randrange(len(t) + 1), r.choice("abc"))
        texts.append(r.choice(" \n\t").join(t[: r.randrange(20, 300)]) + r.choice(["", " \n", " é"]))
    texts += [" ".join("ab" * 60), " ".join("a" * 51), " ".join("a" * 50), "a" * 500, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = bag(suffixdedup.deduplicate(df, passages=suffixdedup.PASSAGES, hot=hot).select("doc_id", "n_passages", "passage_bytes"))
    want = [(len(p), sum(e - b for b, e in p)) for p in brute.passages(texts)]
    assert got == collections.Counter((i, *x) for i, x in enumerate(want)) and any(n for n, _ in want)


@pytest.mark.parametrize("hot", [suffixdedup.HOT, 1])
def test_repeated_strings_of_texts_of_several_slices(spark, hot):
    """What lies about the slices' borders counts once; only true repeats go, also across a border and of repeated rows."""
    size = suffixdedup.SLICE
    text = random.Random(7).randbytes(7 * size // 4).hex()  # 3.5 slices
    passage = text[size - 300 : size + 300]
    twin = random.Random(8).randbytes(5 * size // 4).hex()
    rows = [(1, text), (2, twin), (2, twin), (3, "-" * 50 + passage + "+" * 50)]
    found = suffixdedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"), hot=hot)
    part = text[: size - 300] + text[size + 300 :]
    want = [(1, len(text), 600, 1, brute.sha(part)), *[(2, len(twin), len(twin), 1, brute.sha(""))] * 2, (3, 700, 600, 1, brute.sha("-" * 50 + "+" * 50))]
    assert bag(found) == collections.Counter(want)


@given(st.integers(1, 7), st.integers(1, 3), st.integers(1, 25), st.randoms(use_true_random=False))
@settings(max_examples=150, deadline=None)
def test_run_index(reach, anchor, m, r):
    """Matches by streaming over the runs are those of counting all strings."""
    length = reach + anchor
    group = np.array(sorted(r.randrange(3) for _ in range(m)))
    left, right = (np.array([[r.randrange(1, 3) for _ in range(n)] for _ in range(m)], np.uint16) for n in (length, reach))
    for side in (left, right):
        for row in side[:: r.randrange(2, 5)]:
            row[r.randrange(len(row) + 1) :] = 0
    weight = np.array([1 + (r.random() < 0.2) for _ in range(m)])
    string = lambda i, t: (group[i], t, *left[i, : length - t], *right[i, :t])
    count = collections.Counter()
    for i in range(m):
        for t in range(reach + 1):
            count[string(i, t)] += weight[i]
    want = [[0 not in string(i, t)[2:] and count[string(i, t)] > 1 for t in range(reach + 1)] for i in range(m)]
    assert rindex.RunIndex(group, left, right, weight).matches(length).tolist() == want


# 4: chat


def conversation(rows):
    turns = "".join(f"{r}\n{t}\n" for r, t in rows)
    said = "".join(t for r, t in rows if r == "assistant")
    return len(rows), brute.sha(turns), len(said), brute.sha(said)


def test_chat(spark, data):
    rows = pd.read_parquet(f"{data}/conversations.parquet")
    want = {k: conversation(list(zip(g.role, g.text, strict=True))) for k, g in rows.sort_values(["conv_id", "turn"]).groupby("conv_id")}
    said = "</s>[INST] ok [/INST]"
    want[-1] = conversation([("user", said), ("assistant", said)])
    found = queries.chat_round_trip(spark, data)
    assert {r[0]: tuple(r[1:5]) for r in found.collect()} == want


TEXTS = ["", "plain", "</s>", "[INST] a [/INST]", "[OUT] x</s>", "␛", "␛a␛0", "<<SYS user>> x <</SYS>>", ">> ", " ", "\n", "<s esc>", "a\\b$1", " [/INST", "<", "é\U0001f600", "</s", "[", "x" * 50_000]


def test_chat_round_trips_any_text(spark):
    roles = ["user", "assistant", "system", "tool>> ", "", None, "[INST] "]
    rows = [(i, j, roles[(i + j) % 7], TEXTS[(i * 3 + j * j) % len(TEXTS)], "extra") for i in range(60) for j in range(4)]
    rows += [(None, 0, "user", None, "x"), (77, 1, "user", "b", "x"), (77, 1, "user", "a", "x"), (77, None, "assistant", None, "x"), (77, 1, "user", "a", "x")]
    found = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, turns string"))
    groups = collections.defaultdict(list)
    for c, j, r, t, _ in rows:
        groups[c].append((-1 if j is None else j, r or "", t or ""))
    seen = {r.conv_id: r for r in found.withColumn("loss", chat.masked_text(F.col("formatted"))).collect()}
    assert set(seen) == set(groups)
    for c, turns in groups.items():
        want = [(r, t) for _, r, t in sorted(turns)]
        assert [tuple(x) for x in seen[c].parsed] == want
        assert seen[c].loss == "".join(t for r, t in want if r == "assistant")
        odd = any(x in t or x in r for x in (*chat.CONTROLS, chat.ESCAPE) for r, t in want)
        assert seen[c].escaped == odd  # no control string of a text is left as it is
        body = seen[c].formatted.removeprefix(chat.ESCAPED if odd else chat.PLAIN)
        assert sum(body.count(x) for x in ("[INST]", "[OUT]", "<<SYS")) == len(want)
    assert any(r.escaped for r in seen.values()) and not all(r.escaped for r in seen.values())
    assert chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


# 5 and 6: tokens


@given(st.text(alphabet=st.sampled_from(list("aé1² \n\t'sdtlrvem!字　\x85")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_pretokens(text):
    (_, _, bounds, codes, found), *_ = list(pretokens.pieces([text, "x"]))
    assert [found[i] for i in codes[bounds[0] : bounds[1]]] == regex.findall(public_tokenizers.PATTERN, text)


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def encoded(encoding, key, text):
    ids = encoding.encode_ordinary(text or "")
    return key, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(text or "")


def test_byte_bpe(spark, data, documents, encoding):
    found = queries.byte_bpe(spark, data)
    assert bag(found) == collections.Counter(encoded(encoding, k, t) for k, t in zip(documents.doc_id, documents.text, strict=True))


def test_byte_bpe_odd_rows(odd, nothing, encoding):
    found = bpe.encode_decode(odd, PATH, keep_ids=True)
    assert bag(found.drop("ids", "decoded")) == collections.Counter(encoded(encoding, r[0], r[1]) for r in odd_rows())
    assert all(encoding.decode(r.ids) == bytes(r.decoded).decode() for r in found.collect())
    assert bpe.encode_decode(nothing, PATH).count() == 0


def test_long_words_by_queue_and_by_query_agree(encoding):
    ranks = bpe.read_ranks(PATH)
    r = random.Random(2)
    texts = ["".join(r.choice("anthe") for _ in range(n)) for n in (3, 50, 120)] + ["a" * 90]
    whole = ["".join(r.choice("anthe") for _ in range(5000)), "a" * 4000]
    by_query, by_queue = bpe.Codec(ranks, long_word=1000), bpe.Codec(ranks, long_word=1)
    for a, b, t in zip(by_query.documents(texts), by_queue.documents(texts), texts, strict=True):
        assert a == b and a[1] == ",".join(map(str, encoding.encode_ordinary(t)))
    for a, t in zip(by_queue.documents(whole), whole, strict=True):
        assert a[1] == ",".join(map(str, encoding.encode_ordinary(t)))


def by_unigram(ranks, texts):
    """[(pre-tokens, tokens, log probability)] under the model that is fitted on ``texts``, and how often each token occurs."""
    longest = max(map(len, ranks))

    def segment(word, scores):
        raw, table = word.encode(), [(0.0, 0, 0)]
        for end in range(1, len(raw) + 1):
            options = [(table[b][0] + scores[raw[b:end]], -(table[b][1] + 1), -b) for b in range(max(0, end - longest), end) if raw[b:end] in scores]
            x, n, b = max(options)
            table.append((x, -n, -b))
        return raw, table

    words = [regex.findall(public_tokenizers.PATTERN, t or "") for t in texts]
    first, found = counts.scores(ranks), collections.Counter()
    for word, n in collections.Counter(w for ws in words for w in ws).items():
        raw, table = segment(word, first)
        end = len(raw)
        while end:
            found[raw[table[end][2] : end]] += n
            end = table[end][2]
    total = math.log(sum(found.values()) + len(ranks))
    fitted, memory = {t: math.log(found[t] + 1) - total for t in ranks}, {}
    best = lambda w: memory.setdefault(w, segment(w, fitted)[1][-1]) if w not in memory else memory[w]
    return [(len(ws), sum(best(w)[1] for w in ws), sum(best(w)[0] for w in ws)) for ws in words], found


def test_token_counts(spark, odd, nothing, documents, data):
    ranks = bpe.read_ranks(PATH)
    for rows, found in (([(r[0], r[1]) for r in odd_rows()], counts.token_counts(odd, PATH)), (list(zip(documents.doc_id, documents.text, strict=True)), queries.token_counts(spark, data))):
        want, _ = by_unigram(ranks, [t for _, t in rows])
        key = lambda x: (x[0] is None, x[0] or 0, *x[1:3], round(x[3], 3))
        got = sorted(map(tuple, found.collect()), key=key)
        want = sorted(((k, *x) for (k, _), x in zip(rows, want, strict=True)), key=key)
        assert [x[:3] for x in got] == [x[:3] for x in want]
        assert all(math.isclose(x[3], y[3], rel_tol=1e-9, abs_tol=1e-3) for x, y in zip(got, want, strict=True))
    assert counts.token_counts(nothing, PATH).count() == 0


def test_the_fitted_model_is_better_than_ranks(spark, data, documents):
    """Texts that the model wasn't fitted on are more probable under it than under the law that it begins with."""
    ranks = bpe.read_ranks(PATH)
    half = spark.read.parquet(f"{data}/documents.parquet").where("doc_id % 2 = 0")
    fitted, law = (counts.Counter(m) for m in (counts.smoothed(ranks, counts.fit(half, PATH)), counts.scores(ranks)))
    held_out = documents.text[documents.doc_id % 2 == 1].tolist()
    assert sum(x[2] for x in fitted.documents(held_out)) > 0.9 * sum(x[2] for x in law.documents(held_out))


# 7: WARC


def test_warc(spark, data):
    pages = pd.read_parquet(f"{data}/pages.parquet")
    found = queries.warc_normaliser(spark, data)
    want = collections.Counter((i, len(h.encode()), brute.sha(h), "response", None) for i, h in zip(pages.page_id, pages.html, strict=True))
    assert bag(found) == want


def test_warc_revisits_and_files(spark, tmp_path):
    same, small = "y" * 120, "z" * 99
    rows = [(5, "http://a/\n1", same, 1), (3, None, same, 1), (9, "u", same, 1), (1, "u", small, 1), (2, "u", small, 1), (7, "u", None, 1), (8, "u", "", 1), (None, "u", same, 1), (11, "u", "é" * 50, 1), (10, "u", "é" * 50, 1), (12, "u", "WARC/1.1\r\n\r\n" * 300_000, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int").repartition(3)
    sidecar = warc.write_archives(pages, str(tmp_path / "archives"))
    found = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(sidecar).collect()}
    want = set()
    for i, _, h, _ in rows:
        h = h or ""
        raw = h.encode()
        first = min([r[0] for r in rows if (r[2] or "") == h and r[0] is not None])
        again = len(raw) >= 100 and i is not None and i > first
        want.add((i, len(raw), brute.sha(raw), "revisit" if again else "response", first if again else None))
    assert found == want
    for archive, group in sidecar.toPandas().groupby("archive"):  # one member per record, and whole when read as one stream
        raw = open(archive, "rb").read()
        members = [gzip.decompress(raw[o : o + n]) for o, n in zip(group.offset, group.length, strict=True)]
        assert gzip.decompress(raw) == b"".join(members)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    urls = {(r.page_id, r.url, None if r.payload is None else bytes(r.payload).decode()) for r in warc.read_archives(sidecar).collect()}
    assert urls == {(i, u or "", None if (i in (5, 9, 11)) else h or "") for i, u, h, _ in rows}


def test_warc_ids_of_any_type_and_broken_references(spark, tmp_path):
    same = "y" * 120
    rows = [("b <x>\n", "u", same), ("a/é", "u v", same), ("", "u", "s"), (None, "u", same), ("a/é", "u", same)]
    sidecar = warc.write_archives(spark.createDataFrame(rows, "page_id string, url string, html string"))
    found = {(r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(sidecar).collect()}
    assert found == {("b <x>\n", "revisit", "a/é"), ("a/é", "response", None), ("", "response", None), (None, "response", None)}
    lost = sidecar.where("page_id <> 'a/é'")  # the response that the revisit needs
    with pytest.raises(Exception, match="revisit refers to no response"):
        warc.read_archives(lost, payloads=False).collect()


# 8: language


def test_language_id_keeps_and_knows(spark, data, documents):
    found = queries.language_id(spark, data).toPandas().set_index("doc_id")
    assert found.accepted.all() and (found.language == documents.set_index("doc_id").lang).all()


def test_language_id_on_held_out_text(spark):
    """Without any declared language the text alone must do, on rows that the model was not fitted on."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    part = F.pmod(F.xxhash64("text", F.lit(99)), F.lit(2))
    model = langid.fit(docs.where(part == 0), "text", "lang", 200)
    found = langid.identify(docs.where(part == 1), declared=None, host=None, model=model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(found) > 300 and (found.language == found.lang).mean() > 0.97


def test_language_id_odd_rows(spark, odd, nothing, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs, "text", "lang")
    assert set(model.languages) <= {"de", "en", "es", "fr"}
    rows = {(r.doc_id, r.language, r.accepted) for r in langid.identify(odd, model=model).collect() if r.doc_id in (1, 2, 3)}
    assert rows == {(i, "und", False) for i in (1, 2, 3)}
    assert langid.identify(odd, model=model).count() == len(odd_rows())
    assert langid.identify(nothing).count() == 0
    few = odd.where("doc_id IN (6, 9)")
    assert {r.language for r in langid.identify(few).collect()} == {"und"}  # too few labels to fit on
    noise = spark.createDataFrame([(1, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300)), None, None)], "doc_id bigint, text string, lang string, source string")
    assert [r.accepted for r in langid.identify(noise, model=model).collect()] == [False]


def test_language_of_pages(spark, data):
    pages = langid.page_columns(spark.read.parquet(f"{data}/pages.parquet"))
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = langid.identify(pages, key="page_id", declared="declared", host="host", suffix="suffix", model=langid.fit(docs, "text", "lang"))
    truth = pages.select("page_id", F.regexp_extract("url", "/(de|en|es|fr)/", 1).alias("lang")).where("lang <> ''")
    assert found.join(truth, "page_id").agg(F.avg((F.col("lang") == F.col("language")).cast("int"))).first()[0] > 0.9


def test_posterior_is_that_of_bayes_rule(spark, data):
    """Against a plain version over all rows, on pages with evidence of all kinds."""
    docs, pages = spark.read.parquet(f"{data}/documents.parquet"), langid.page_columns(spark.read.parquet(f"{data}/pages.parquet"))
    model = langid.fit(docs, "text", "lang")
    found = {r.page_id: r for r in langid.identify(pages, key="page_id", declared="declared", host="host", suffix="suffix", model=model).collect()}
    rows = pages.select("page_id", "text", "declared", "host", "suffix").collect()
    sums, n = model.likelihoods(pa.array([r.text for r in rows]))
    scores = sums * np.minimum(1.0, langid.EVIDENCE / np.maximum(n, 1))[:, None]
    k = scores.shape[1]
    soft = lambda x: np.exp(x - x.max(axis=-1, keepdims=True)) / np.exp(x - x.max(axis=-1, keepdims=True)).sum(axis=-1, keepdims=True)
    alone = soft(scores + np.log([(1 - langid.UNKNOWN_PRIOR) / (k - 1)] * (k - 1) + [langid.UNKNOWN_PRIOR]))
    lettered = np.array([bool(regex.search(r"\p{L}", r.text)) for r in rows])
    total = alone[lettered].sum(axis=0) + 1 / k
    group = lambda key: {v: alone[[i for i, r in enumerate(rows) if lettered[i] and key(r) == v]].sum(axis=0) for v in {key(r) for r in rows}}
    smooth = lambda c, p: (c + langid.HOST_WEIGHT * p) / (c.sum() + langid.HOST_WEIGHT)
    overall, suffixes, hosts, declared = total / total.sum(), group(lambda r: r.suffix), group(lambda r: (r.suffix, r.host)), group(lambda r: r.declared)
    given = lambda by, v: np.log((by[v] + langid.VALUE_WEIGHT / max(len([x for x in by if x is not None]), 1)) / (total + langid.VALUE_WEIGHT)) if v is not None else 0.0
    names = [*model.languages, langid.UNKNOWN]
    for i, r in enumerate(rows):
        prior = smooth(hosts[r.suffix, r.host], smooth(suffixes[r.suffix], overall) if r.suffix is not None else overall) if r.host is not None else overall
        p = soft(scores[i] + np.log(prior) + given(declared, r.declared) + given(suffixes, r.suffix)) if lettered[i] else None
        assert found[r.page_id].posterior == pytest.approx(1.0 if p is None else p.max(), abs=2e-6)
        assert found[r.page_id].language == (langid.UNKNOWN if p is None else names[int(p.argmax())])


def test_evidence_decides_and_rejects(spark, data):
    """A text that says little follows its declared language and host; without any evidence it is rejected."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs, "text", "lang")
    rows = [(r.doc_id, r.text, r.lang, f"{r.lang}.org") for r in docs.where("length(text) > 200").limit(150).collect()]
    text = pa.array([t[:n] for _, t, _, _ in rows for n in range(3, 12)])
    sums, n = model.likelihoods(text)
    unsure = np.argsort(np.abs(np.diff(np.sort(sums[:, :-1], axis=1)[:, -2:], axis=1)).ravel())[:40]  # nearly as likely in two languages
    short = [text[int(i)].as_py() for i in unsure]
    odd = [(10_000 + i, t, lang, f"{lang}.org") for i, (t, lang) in enumerate(zip(short, ["de", "en", "es", "fr"] * 10, strict=True))]
    noise = [(20_000, "\u4e2d\u6587" * 100, None, None)]
    table = spark.createDataFrame(rows + odd + noise, "doc_id bigint, text string, lang string, host string")
    found = {r.doc_id: r for r in langid.identify(table, host="host", model=model).collect()}
    flipped = [r for r in found.values() if 10_000 <= r.doc_id < 20_000 and r.language != r.by_text]
    assert len(flipped) >= 5 and sum(r.language == r.declared for r in flipped) > len(flipped) / 2
    assert not found[20_000].accepted and found[20_000].language == langid.UNKNOWN


def test_every_label_with_enough_rows_is_a_language(spark):
    r = random.Random(1)
    rows = [(f"l{i:03d}", " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(20))) for i in range(70) for _ in range(3)]
    rows += [("rare", "some words")] * 2
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert langid.fit(docs, "text", "lang").languages == [f"l{i:03d}" for i in range(70)]


# 9: fingerprints


def expected_prints(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (key, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        yield key, len(text), brute.sha(changed), float(digests.canonical(text) == digests.canonical(changed)), float(digests.canonical(text) == digests.canonical(following))


def test_fingerprints(spark, data, documents):
    rows = list(zip(documents.doc_id, documents.text, strict=True))
    found = queries.document_fingerprints(spark, data).cache()
    assert bag(found.drop("fingerprint", "edited_fingerprint")) == collections.Counter(expected_prints(rows))
    prints = {r.doc_id: r.fingerprint for r in found.collect()}
    forms = {k: digests.canonical(t) for k, t in rows}
    assert len(set(prints.values())) == len(set(forms.values())) == len({(prints[k], forms[k]) for k in forms})


def test_fingerprints_odd_rows(spark, odd, nothing):
    rows = [(r[0], r[1] or "") for r in odd_rows()]
    found = digests.fingerprints(odd, broadcast_rows=0)
    assert bag(found.drop("fingerprint", "edited_fingerprint")) == collections.Counter(expected_prints(rows))
    assert digests.fingerprints(nothing).count() == 0
    one = digests.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")).first()
    assert one.edited_sha256 == brute.sha("abcdab") and one.near_next == 1.0


def test_fingerprints_tell_clashing_texts_apart(spark):
    """Where hashes are equal the bytes are compared: a first hash that is the length only, in ids of another type."""
    rows = [(1.5, "abc"), (2.5, "abd"), (3.5, "ABC "), (4.5, "x"), (None, "abc")]
    docs = spark.createDataFrame(rows, "doc_id double, text string")
    found = {r.doc_id: r for r in digests.fingerprints(docs, wide=lambda form: (str(len(form)), form[::-1])).collect()}
    assert {k: r.fingerprint for k, r in found.items()} == {1.5: "3-cba", 2.5: "3-dba", 3.5: "3-cba", 4.5: "1", None: "3-cba"}
    assert found[1.5].near_next == 1.0 and found[3.5].near_next == 0.0
    assert digests.canonical("A  ﬁ\n") == "a fi" and digests.canonical("ＳTRAẞE\u00a0½") == "strasse 1⁄2"


@pytest.mark.parametrize("kind", ["string", "date", "smallint"])
def test_fingerprints_of_ids_of_any_type(spark, kind):
    docs = spark.range(30).selectExpr(f"cast({'date_add(current_date(), cast(id as int))' if kind == 'date' else 'id'} as {kind}) AS doc_id", "concat('text ', id * 7919) AS text").repartition(7)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    want = {k: brute.sha(digests.edited(t, rows[(i + 1) % 30][1])) for i, (k, t) in enumerate(rows)}
    assert {r.doc_id: r.edited_sha256 for r in digests.fingerprints(docs).collect()} == want


# 10: vectors


def test_near_vectors(spark, data):
    rows = [(r.vec_id, list(map(float, r.embedding)), r.label) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    found = queries.embedding_near_dedup(spark, data)
    assert bag(found) == collections.Counter((r[0], *x) for r, x in zip(rows, brute.near_vectors(rows), strict=True))


def test_near_vectors_odd_rows_and_a_dense_group(spark):
    r = np.random.default_rng(3)
    centre = r.standard_normal(16)
    rows = [(i, (centre + 0.12 * r.standard_normal(16)).tolist(), 1) for i in range(200)]
    rows += [(200 + i, r.standard_normal(16).tolist(), i % 3) for i in range(200)]
    for i in range(60):
        v = r.standard_normal(16)
        rows += [(1000 + 2 * i, v.tolist(), 2), (1001 + 2 * i, (v + 0.05 * r.standard_normal(16)).tolist(), 2 if i % 2 else 1)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [None] + [1.0] * 15, 1), (2005, centre.tolist(), None), (None, centre.tolist(), 1), (2006, centre.tolist()[:8], 1), (2007, (centre * 7).tolist(), 1)]
    rows += [(3000, centre.tolist(), 5), (3001, centre.tolist(), 5), (3001, centre.tolist(), 5)]
    schema = "vec_id bigint, embedding array<double>, label int"
    found = neardup.near_duplicates(spark.createDataFrame(rows, schema).repartition(3), bucket=16)
    assert bag(found) == collections.Counter((x[0], *y) for x, y in zip(rows, brute.near_vectors(rows), strict=True))
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_near_vectors_among_the_tables_own(spark, data):
    """The table has no links, so some of its vectors get copies at all distances about the threshold."""
    r = np.random.default_rng(8)
    rows = [(x.vec_id, np.array(x.embedding, float), x.label) for x in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    for i, (_, v, label) in enumerate(rows[:40]):
        off = r.standard_normal(len(v))
        off -= (off @ v) / (v @ v) * v
        c = 0.9 + 0.0025 * i + 0.0003
        rows.append((10_000 + i, c * v / np.linalg.norm(v) + math.sqrt(1 - c * c) * off / np.linalg.norm(off), label))
    rows = [(k, v.tolist(), label) for k, v, label in rows]
    want = brute.near_vectors(rows)
    assert sum(n > 0 for n, *_ in want) >= 50
    found = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label bigint").repartition(3), bucket=8)
    assert bag(found) == collections.Counter((x[0], *y) for x, y in zip(rows, want, strict=True))


def test_the_descent_finds_what_the_trees_miss(spark):
    r = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, off = unit(r.standard_normal((1000, 64))), r.standard_normal((1000, 64))
    c = r.uniform(0.931, 0.95, 1000)[:, None]
    b = c * a + np.sqrt(1 - c**2) * unit(off - (off * a).sum(1, keepdims=True) * a)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([a, b]))], "vec_id bigint, embedding array<double>, label int").repartition(4)
    links = lambda rounds: neardup.near_duplicates(df, bucket=4, trees=4, rounds=rounds, target=0.0).where("n_links > 0").count()
    alone, descended = links(0), links(neardup.ROUNDS)
    assert alone < 0.9 * 2000 and descended >= 0.98 * 2000


def test_a_chain_is_not_compared_as_a_whole(spark, monkeypatch):
    """Lists that aren't saturated hold all links, so a component of short links needs no brute force."""
    step = math.acos(0.94)
    rows = [(i, [math.cos(step * i / 1.0), math.sin(step * i)] + [0.0] * 2, 1) for i in range(17)]
    monkeypatch.setattr(neardup, "in_blocks", lambda rows, *a: common.in_blocks(rows, *a) if rows.isEmpty() else pytest.fail("compared in blocks"))
    found = {x.vec_id: (x.n_links, x.component_id) for x in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    want = brute.near_vectors(rows)
    assert found == {i: x[:2] for i, x in enumerate(want)} and {n for n, _ in found.values()} <= {1, 2}


def test_isolated_pairs_are_found_beside_a_dense_group(spark):
    """Pairs at the threshold without other neighbours, in deep trees; a dense group has nearly all links."""
    r = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(r.standard_normal((400, 64)))
    off = r.standard_normal((400, 64))
    b = 0.931 * a + np.sqrt(1 - 0.931**2) * unit(off - (off * a).sum(1, keepdims=True) * a)
    dense = r.standard_normal(64) + 0.01 * r.standard_normal((60, 64))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([a, b, dense, r.standard_normal((3000, 64))]))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(4)
    found = {x.vec_id: x.n_links for x in neardup.near_duplicates(df, bucket=32).collect()}
    assert sum(found[i] == 1 for i in range(800)) >= 796
    assert all(found[i] == 59 for i in range(800, 860))


def test_audit_counts_vectors_alike(spark):
    """A group that has nearly all links doesn't hide pairs that were missed."""
    r = np.random.default_rng(6)
    group = r.standard_normal(16) + 0.01 * r.standard_normal((30, 16))
    pairs = np.repeat(r.standard_normal((30, 16)), 2, axis=0) + 0.001 * r.standard_normal((60, 16))
    rows = [(1, i, v.tobytes()) for i, v in enumerate(np.concatenate([group, pairs]))]
    vectors = spark.createDataFrame(rows, "space bigint, node bigint, v binary")
    whole = spark.createDataFrame([(i, 0) for i in range(30)], "node bigint, component bigint")
    links = spark.createDataFrame([(30, 31), (32, 33)], "a bigint, b bigint")
    assert neardup.audit(vectors, links.limit(0), whole, 0.97) == pytest.approx(30 / 90)
    assert neardup.audit(vectors, links, whole, 0.97) == pytest.approx(34 / 90)


def test_audit_sees_links_that_are_rare(spark):
    """Ten pairs among 5,000 vectors: a sample of 20 of all meets none, one of those with a near neighbour does."""
    own = np.random.default_rng(11)
    rows = own.normal(size=(5000, 16))
    rows[1:20:2] = rows[0:20:2] + 0.01
    vectors = spark.createDataFrame([(0, i, r.tobytes()) for i, r in enumerate(rows)], "space int, node bigint, v binary")
    empty = spark.createDataFrame([], "a bigint, b bigint")
    whole = spark.createDataFrame([], "node bigint, component bigint")
    near = spark.createDataFrame([(i,) for i in range(20)], "node bigint")
    assert neardup.audit(vectors, empty, whole, 0.95, 20) == 1.0
    assert neardup.audit(vectors, empty, whole, 0.95, 20, near) == 0.0


def test_a_missed_recall_fails(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PLANTINGS", 1)
    df = spark.createDataFrame([(i, [1.0, i / 1000], 1) for i in range(5)], "vec_id bigint, embedding array<double>, label int")
    with pytest.raises(RuntimeError):
        neardup.near_duplicates(df, target=1.1)


# SQL


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_against_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{data}/{table}.parquet')")
    want = con.sql(queries.oracle_sql()[name]).to_arrow_table()
    found = queries.queries()[name](spark, data).toArrow()
    assert sorted(found.column_names) == sorted(want.column_names)
    rows = lambda t: collections.Counter(tuple(round(r[c], 5) if isinstance(r[c], float) else r[c] for c in sorted(r)) for r in t.to_pylist())
    assert rows(found) == rows(want)


# shared helpers


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 600 + i) for i in range(50)]
    parts = brute.Sets(700)
    for a, b in edges:
        parts.join(a, b)
    found = common.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {tuple(x) for x in found.collect()} == {(x, parts.root(x)) for e in edges if e[0] != e[1] for x in e}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
