"""Snapshot differences, files of token ids and Merkle manifests against plain versions."""

from __future__ import annotations

import collections
import hashlib
import json
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import common, idcoder, manifest, queries, snapdiff, tokenfiles

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, side int, rank int, grp string"


def odd_rows():
    made = lambda i, t, lang="en", source="s": (i, t, lang, source, None if t is None else len(t), "k", 7, 8, "g")
    rows = [made(1, None), made(2, ""), made(3, "a\nb"), made(4, "same"), made(5, "same"), made(6, "same"), made(7, "x" * 3_000_000), made(8, "é\U0001f600", None, None), made(None, "lost")]
    return [*rows, *(made(100 + i, "crowd", "en", "hot") for i in range(400))]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(data):
    return pd.read_parquet(f"{data}/documents.parquet")


def duck(data, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    return con.sql(sql)


def bag(rows):
    return collections.Counter(map(tuple, rows))


# the rank that both use


def test_rank_within_groups_that_span_ranges(spark):
    rows = [(g, k) for g, n in (("a", 3000), (None, 5), ("b", 1), ("c", 700)) for k in range(n)]
    random.Random(1).shuffle(rows)
    found = common.ranked(spark.createDataFrame(rows, "g string, k bigint"), ["g"], ["k"], "r").collect()
    assert len(found) == len(rows) and all(r.r == r.k + 1 for r in found)


def test_rank_of_a_whole_table_and_of_equal_rows(spark):
    found = common.ranked(spark.range(1000).select((F.col("id") % 2).alias("k")), [], ["k"], "r").collect()
    assert sorted(r.r for r in found) == list(range(1, 1001)) and all((r.r > 500) == (r.k == 1) for r in found)


# 11: snapshot difference


def content_hash(row):
    return hashlib.sha256("\n".join("~" if x is None else x for x in row).encode()).hexdigest()


def differences(earlier, later, columns=("text", "lang", "source")):
    """By loops, for keys that may repeat: equal rows of a key, then the rows of a key by content, then content by key."""
    order = lambda r: tuple((x is not None, hashlib.sha256((x or "").encode()).digest()) for x in r[1])
    small_first = lambda r: (r[0] is not None, r[0] or 0)
    old, new, pairs = [], list(later), []
    for r in earlier:
        if r in new:
            new.remove(r)
            pairs.append((r, r))
        else:
            old.append(r)
    for by, sort in ((lambda r: r[0], order), (lambda r: r[1], small_first)):
        groups = collections.defaultdict(lambda: ([], []))
        for i, rows in enumerate((old, new)):
            for r in rows:
                groups[by(r)][i].append(r)
        old, new = [], []
        for a, b in groups.values():
            a.sort(key=sort)
            b.sort(key=sort)
            n = min(len(a), len(b))
            pairs += zip(a[:n], b[:n], strict=True)
            old += a[n:]
            new += b[n:]
    out = [(r[0], r[0], "delete", "", None) for r in old] + [(r[0], None, "insert", "", content_hash(r[1])) for r in new]
    for a, b in pairs:
        changed = ",".join(c for c, x, y in zip(columns, a[1], b[1], strict=True) if x != y)
        out.append((b[0], a[0], "rekey" if a[0] != b[0] else "update" if changed else "same", changed, content_hash(b[1])))
    return out


def compared(spark, earlier, later):
    def table(rows):
        return spark.createDataFrame([(k, *c) for k, c in rows], "doc_id bigint, text string, lang string, source string")

    found = snapdiff.difference(table(earlier), table(later), key="doc_id", columns=("text", "lang", "source"))
    assert found.columns == ["key", "old_key", "op", "changed", "row_sha256"]
    assert bag(found.collect()) == bag(differences(earlier, later))


def test_difference_of_the_table(spark, data):
    found = queries.snapshot_difference(spark, data)
    assert bag(found.collect()) == bag(duck(data, queries.DIFFERENCE).fetchall())
    assert {r.op for r in found.select("op").distinct().collect()} == {"same", "update", "rekey", "insert", "delete"}


def test_difference_of_odd_rows_by_the_rules_of_the_query(spark, odd):
    later = queries.later_snapshot(odd.select("doc_id", "text", "lang", "source"))
    plain = lambda df: [(r.doc_id, (r.text, r.lang, r.source)) for r in df.collect()]
    found = snapdiff.difference(odd, later, key="doc_id", columns=("text", "lang", "source"))
    assert bag(found.collect()) == bag(differences(plain(odd), plain(later)))


def test_content_pairs_by_order_of_keys_across_a_crowd(spark):
    one = ("t", "l", None)
    compared(spark, [(i, one) for i in range(600)], [(-1 - i, one) for i in range(450)])
    compared(spark, [(1, one), (2, ("t", "l", "")), (3, ("t\nl", "x", "y"))], [(4, ("t", "l", "")), (5, ("t", "l\nx", "y"))])


@pytest.mark.parametrize("seed", range(3))
def test_keys_and_rows_that_repeat(spark, seed):
    own = random.Random(seed)
    row = lambda: (own.choice([None, 1, 2, 3]), (own.choice(["a", "b", "", None]), "l", own.choice(["s", None])))
    compared(spark, [row() for _ in range(40)], [row() for _ in range(30)])


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(snapdiff, "COPIES", 7)
    compared(spark, [(1, ("a", "b", "c"))] * 50, [(1, ("a", "b", "c"))] * 30 + [(2, ("a", "b", "c"))] * 5)


def test_difference_with_empty_snapshots(odd, nothing):
    run = lambda a, b: [r.op for r in snapdiff.difference(a, b, key="doc_id", columns=("text",)).collect()]
    assert set(run(odd, nothing)) == {"delete"} and set(run(nothing, odd)) == {"insert"} and run(nothing, nothing) == []


def test_difference_has_no_join(spark, data):
    plan = queries.snapshot_difference(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


# 13: Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grown(leaves, fanout=3):
    found = [leaves]
    while len(found[-1]) > 1:
        found.append([sha(*found[-1][i : i + fanout]) for i in range(0, len(found[-1]), fanout)])
    return found


def path_of(tree, i, fanout=3):
    out = []
    for level in tree[:-1]:
        first = i // fanout * fanout
        out.append((i % fanout, [x for j, x in enumerate(level[first : first + fanout], first) if j != i]))
        i //= fanout
    return out


def manifest_of(rows, fanout=3):
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) of rows (doc_id, source, lang, n_chars, text), texts without line feeds when checked."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), leaf_of((*r[:4], r[4] and r[4].replace("\n", ""))), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grown([x[2] for x in sorted(groups[s])], fanout) for s in names}
    top, out = grown([trees[s][-1][0] for s in names], fanout), []
    for k, s in enumerate(names):
        for i, (_, _, leaf, held, key) in enumerate(sorted(groups[s])):
            path = path_of(trees[s], i, fanout) + path_of(top, k, fanout)
            for own, others in path:
                held = sha(*others[:own], held, *others[own:])
            out.append((key, leaf, trees[s][-1][0], top[-1][0], sha(*(x for _, o in path for x in o)), held, held == top[-1][0]))
    return out


def built(rows, **options):
    tampered = {"text": F.translate("text", "\n", "")}
    return manifest.manifest(rows, key="doc_id", group="source", fields=("doc_id", "source", "lang", "n_chars", "text"), tampered=tampered, **options).drop("source")


def test_manifest_of_the_table(spark, data):
    assert bag(queries.merkle_manifest(spark, data).collect()) == bag(duck(data, queries._merkle()).fetchall())


@pytest.mark.parametrize(("fanout", "height"), [(3, 7), (3, 2), (2, 3), (5, 1)])
def test_manifest_of_odd_rows_in_blocks_of_any_height(odd, fanout, height):
    want = manifest_of([(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows()], fanout)
    assert bag(built(odd, fanout=fanout, height=height).collect()) == bag(want)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_groups_about_the_size_of_a_block(spark, n):
    rows = [(i, "t\n", "l", s, 2) for s in "ab" for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert bag(built(table, height=2).collect()) == bag(manifest_of([(r[0], r[3], r[2], r[4], r[1]) for r in rows]))


def test_many_groups_need_levels_of_their_own(spark):
    rows = [(i, "t", "l", None if i == 5 else f"s{i % 97}", 2) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = built(table, height=1).collect()
    assert bag(found) == bag(manifest_of([(r[0], r[3], r[2], r[4], r[1]) for r in rows])) and all(r.verified for r in found)


def test_manifest_of_no_rows_and_of_one(spark, nothing):
    assert built(nothing).collect() == []
    one = spark.createDataFrame([(1, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    row = built(one).first()
    assert row.root == row.subroot == row.leaf == leaf_of((1, None, None, None, None)) and row.proof_sha256 == sha("") and row.verified


# 12: token ids in binary files


VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def model():
    with open(VOCABULARY, encoding="utf-8") as f:
        return f.read()


def ids_of_texts(texts, end=2):
    """By the library, whole texts one by one."""
    plain = tokenizers.Tokenizer.from_file(VOCABULARY)
    return [[*plain.encode(t or "", add_special_tokens=False).ids, *([] if end is None else [end])] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def files_of(rows, end=2):
    """(doc_id, start, n_tokens, crc) of rows (doc_id, text), in order."""
    out, at = [], 0
    for (key, _), ids in zip(rows, ids_of_texts([t for _, t in rows], end), strict=True):
        out.append((key, at, len(ids), crc(ids)))
        at += len(ids)
    return out


@pytest.mark.parametrize("kind", ["random", "constant", "repeats", "counting", "zipf", "extremes"])
def test_blocks_come_back(kind):
    own = np.random.default_rng(3)
    shape = (37, 300)
    made = {
        "random": lambda: own.integers(0, 1 << 16, shape),
        "constant": lambda: np.full(shape, 65535),
        "repeats": lambda: np.tile(own.integers(0, 1 << 16, (37, 20)), (1, 15)),
        "counting": lambda: np.arange(37 * 300).reshape(shape),
        "zipf": lambda: np.minimum(own.zipf(1.2, shape), 65535),
        "extremes": lambda: own.choice([0, 255, 256, 65535, 49151, 49152], shape),
    }[kind]().astype(np.uint16)
    words = idcoder.encode(made)
    assert (idcoder.decode(words, 300) == made).all()
    bits = 16 * sum(map(len, words)) / made.size
    assert bits < {"random": 17.5, "constant": 0.8, "repeats": 5, "counting": 17.5, "zipf": 13, "extremes": 11.5}[kind]  # order 0 knows an id by its class alone


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535), min_size=9, max_size=9), min_size=1, max_size=6))
def test_any_blocks_come_back_and_each_one_alone(rows):
    made = np.array(rows, np.uint16)
    words = idcoder.encode(made)
    assert (idcoder.decode(words, 9) == made).all()
    assert all((idcoder.decode([w], 9)[0] == row).all() for w, row in zip(words, made, strict=True))


def test_a_carry_runs_through_many_digits():
    # digits of ones before a carry are rare by chance; many blocks of one skewed kind give some
    own = np.random.default_rng(8)
    made = np.where(own.random((3000, 60)) < 0.97, 7, own.integers(0, 1 << 16, (3000, 60))).astype(np.uint16)
    assert (idcoder.decode(idcoder.encode(made), 60) == made).all()


TEXTS = ["", None, "two words", " \t\n ", "don't  stop　now's ​", "ÀÉİ straße ΑΣ ΑΣ.", "é ́x", "x" * 5000, "<|endoftext|> a<|startoftext|>b", "\U0001f600" * 3 + "\x1c\x85 a b", "a\r\nb\x0bc\x0cd"]


def test_ids_are_those_of_the_library(model, documents):
    texts = [*TEXTS, *documents.text[:60]]
    ids, counts = tokenfiles.ids_of(pa.array(texts), model, 2)
    want = ids_of_texts(texts)
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    sliced, counts = tokenfiles.ids_of(pa.array(["head", *texts]).slice(1), model, None)
    assert sliced.tolist() == [i for w in ids_of_texts(texts, None) for i in w]


def test_words_that_are_forgotten_are_encoded_again(model, monkeypatch):
    monkeypatch.setattr(tokenfiles, "WORDS", 5)
    for texts in (["one two three", "four"], ["two five six seven"]):
        assert tokenfiles.ids_of(pa.array(texts), model, None)[0].tolist() == [i for w in ids_of_texts(texts, None) for i in w]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aSLÉé×÷ÿß'|<>.,-9²İΣſÅå한 \n\x1c\x85\u0301\u212b"), max_size=12) | st.sampled_from(["don't", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "x<|endoftext|>y.", "H\u0331", "A\u030a"]), min_size=1, max_size=8))
def test_words_cut_at_signs_have_the_ids_of_the_library(model, texts):
    ids, counts = tokenfiles.ids_of(pa.array(texts), model, 2)
    want = ids_of_texts(texts)
    assert tokenfiles.Words.of(model).fine and counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_a_model_with_other_steps_has_its_words_whole(model, monkeypatch):
    from tokenizers import Tokenizer

    other = json.loads(model)
    other["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[^\s]+"
    other = json.dumps(other)
    monkeypatch.setattr(tokenfiles.Words, "held", None)
    ids, _ = tokenfiles.ids_of(pa.array(["don't stop, now.É", None, "A1"]), other, None)
    assert not tokenfiles.Words.of(other).fine
    assert ids.tolist() == [i for t in ("don't stop, now.É", "A1") for i in Tokenizer.from_str(other).encode(t, add_special_tokens=False).ids]


def test_the_query_codes_its_ids_by_the_range_coder(spark, data, monkeypatch):
    made, write = [], tokenfiles.write_ids
    monkeypatch.setattr(tokenfiles, "write_ids", lambda *a, **k: made.append(write(*a, **k)) or made[-1])
    queries.token_id_files(spark, data)
    for row in made[0].collect():
        with open(row.file.removeprefix("file://"), "rb") as f:
            assert f.read(8) == tokenfiles.COMPACT


def test_files_of_the_table(spark, data, documents):
    found = queries.token_id_files(spark, data)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted(zip(documents.doc_id, documents.text, strict=True))
    assert bag(found.collect()) == bag(files_of([(int(k), t) for k, t in rows]))


def test_files_of_odd_rows(spark, model, monkeypatch, tmp_path):
    rows = [*enumerate(TEXTS), (3, "again"), (None, "no key"), *((50, "copy"),) * 40, (60, "w " * 30_000)]
    table = spark.createDataFrame([(k, t, 1, "f") for k, t in rows], "doc_id bigint, text string, start int, file string").repartition(3)
    written = tokenfiles.write_ids(table, model, end=2, file_ids=20, folder=f"file://{tmp_path}/ids")
    assert written.count() > 3
    found = sorted(tokenfiles.read_ids(written, ids=True).collect(), key=lambda r: r.start)
    assert [r.start for r in found] == [sum(x.n_tokens for x in found[:i]) for i in range(len(found))]
    assert [r.doc_id for r in found] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    assert bag((r.doc_id, tuple(r.ids)) for r in found) == bag((k, tuple(i)) for (k, _), i in zip(rows, ids_of_texts([t for _, t in rows]), strict=True))
    assert all(r.ids_crc32 == crc(r.ids) and r.n_tokens == len(r.ids) for r in found)


def test_files_are_frames_or_compact(spark, model, tmp_path, monkeypatch):
    """The range coder runs only where it is asked for; both kinds of files say the same."""
    table = spark.createDataFrame([*enumerate(TEXTS), (60, "w " * 30_000)], "doc_id bigint, text string").coalesce(1)
    ask = lambda **how: tokenfiles.read_ids(tokenfiles.write_ids(table, model, end=2, **how), ids=True)
    made = {c: ask(folder=str(tmp_path / f"ids{c}"), compact=c).collect() for c in (False, True)}
    assert bag((*r[:4], tuple(r.ids)) for r in made[False]) == bag((*r[:4], tuple(r.ids)) for r in made[True])
    for c, rows in made.items():
        for f in (tmp_path / f"ids{c}").glob("*.ids"):
            assert f.read_bytes()[:8] == (tokenfiles.COMPACT if c else tokenfiles.MAGIC)


def test_no_documents_no_files(nothing, model):
    written = tokenfiles.write_ids(nothing, model, end=2)
    assert written.collect() == [] and tokenfiles.read_ids(written).collect() == []


def test_a_damaged_block_is_noticed(spark, model, tmp_path):
    table = spark.createDataFrame([("k", "some words to be damaged " * 50)], "doc_id string, text string")
    written = tokenfiles.write_ids(table, model, end=2, folder=str(tmp_path / "ids"))
    assert [r.doc_id for r in tokenfiles.read_ids(written, "string").collect()] == ["k"]
    path = written.first().file
    with open(path, "r+b") as f:
        f.seek(len(tokenfiles.MAGIC) + 4 + 12 + 20)
        old = f.read(2)
        f.seek(-2, 1)
        f.write(bytes(x ^ 0x55 for x in old))
    with pytest.raises(Exception, match="checksum"):
        tokenfiles.read_ids(written, "string").collect()
