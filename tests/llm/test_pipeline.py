"""The pipeline's stages, each on its own input, against plain versions."""

from __future__ import annotations

import collections

import brute
import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe


def test_pipeline(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.toPandas()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_strings", "mix_sources", "encode"]
    assert corpus_pipeline.ORACLE_SQL is None
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.toPandas()
        if name != "encode":
            assert docs.columns == columns
        if name == "language_id":
            assert set(before.doc_id) == set(after.doc_id)  # all of these have a language
        elif name == "near_duplicates":
            rows = list(zip(before.doc_id, before.text, strict=True))
            assert sorted(after.doc_id) == sorted({c for c, _ in brute.jaccard(rows)})
        elif name == "repeated_strings":
            want = {i: k for i, k in zip(before.doc_id, brute.cleaned(before.text), strict=True) if k is not None}
            assert dict(zip(after.doc_id, after.text, strict=True)) == want
            assert (after.n_chars == after.text.str.len()).all()
        elif name == "mix_sources":
            copies = collections.Counter(after.doc_id)
            assert max(copies.values()) <= 3 and set(copies) <= set(before.doc_id)
            words = lambda t: sum(len(brute.words(x)) for x in t)
            assert abs(words(after.text) - words(before.text)) < 0.05 * words(before.text)
        else:
            path = public_tokenizers.path(corpus_pipeline.VOCABULARY)
            encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
            want = collections.Counter()
            for i, t in zip(before.doc_id, before.text, strict=True):
                ids = encoding.encode_ordinary(t)
                want[i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t)] += 1
            assert collections.Counter(map(tuple, docs.collect())) == want
        before = after
    whole = corpus_pipeline.run(spark, data)
    assert collections.Counter(map(tuple, whole.collect())) == collections.Counter(map(tuple, docs.collect()))


def test_stages_on_odd_rows(spark, data):
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (3, "a b c", "en", "s", 5, 1), (3, "a b c", "en", "s", 5, 1), (None, "a b c", "en", None, 5, 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key int"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, data)
        if name != "encode":
            assert found.columns == docs.columns
            assert {r.row_key for r in found.collect()} <= {1}
        if name == "near_duplicates":
            assert sorted((r.doc_id for r in found.collect()), key=str) == [1, 2, 3]
        assert stage(spark, docs.limit(0), data).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs.where(F.col("doc_id") < 3), data).count() == 0


def test_short_passages_of_over_50_words_are_cut(spark, data):
    """51 words of 254 bytes go, wherever they stand and whatever separates them; 50 words stay, as do words that only repeat apart."""
    words = lambda n, name: [f"{name}{i:03d}" for i in range(n)]
    long, short, apart = words(51, "w"), words(50, "v"), words(60, "u")
    texts = [
        " ".join(words(300, "a") + long + words(300, "b")),
        " ".join(long) + "\n" + " ".join(words(30, "c") + short),
        " ".join(words(70, "d")) + " " + "\t ".join(long[:30]) + "\n" + " ".join(long[30:]),
        " ".join(short + words(60, "e") + apart[:40]),
        " ".join(apart + words(90, "f")),
        " ".join(words(60, "g") + apart[20:]),
        None,
        "",
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema)
    found = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeated_strings(spark, docs.repartition(3), data).collect()}
    want = [" ".join(words(300, "a")) + "  " + " ".join(words(300, "b")), "\n" + " ".join(words(30, "c") + short), " ".join(words(70, "d")) + " ", *texts[3:8]]
    assert found == {i: (t, None if t is None else len(t)) for i, t in enumerate(want)}
    again = docs.where("doc_id = 1").union(docs.where("doc_id = 1").selectExpr("9L", "text", "lang", "source", "n_chars"))
    assert corpus_pipeline.repeated_strings(spark, again, data).count() == 0  # no word is left


def test_repeated_strings_are_those_of_400_bytes_or_51_words(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    table = docs.toPandas()
    want = {i: k for i, k in zip(table.doc_id, brute.cleaned(table.text), strict=True) if k is not None}
    assert {r.doc_id: r.text for r in corpus_pipeline.repeated_strings(spark, docs, data).collect()} == want


def test_stages_on_long_texts_and_clashing_columns(spark, data):
    """Extra columns named like the stages' internals come through, and a very long text whole."""
    long = " ".join(f"the word w{i}é is here" for i in range(60_000))
    rows = [(1, long, "en", "s", len(long)), (2, long + " more", "en", "s", 5), (3, "this is another text with some words of its own", "en", "s", 9)]
    names = ["row_key", "kept", "spans", "node", "size", "h", "copies", "rank", "unit", "n_removed"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} int" for n in names))
    wanted = {"language_id": None, "near_duplicates": {1, 3}, "mix_sources": None, "repeated_strings": {2, 3}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, data)
        assert found.columns == docs.columns
        found = found.collect()
        assert all(tuple(r[5:]) == tuple(range(len(names))) for r in found)
        assert wanted[name] is None or {r.doc_id for r in found} == wanted[name], name
        if name == "repeated_strings":
            assert {r.doc_id: r.text for r in found} == {2: " more", 3: rows[2][1]}
        elif name == "near_duplicates":
            assert {r.text for r in found} == {long, rows[2][1]}
    assert {(r.doc_id, r.n_tokens > 0) for r in corpus_pipeline.encode(spark, docs, data).collect()} == {(1, True), (2, True), (3, True)}
