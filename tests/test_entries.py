"""Entries of the kept keyword index against a plain version."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.functions.stem import known_stem
from tessera.functions.text import word_list
from tessera.operators import keywords

TEXTS = [None, "", "..", "a b a, things REQ-3 a", "É́ é x_y 中文 １２ ß", *(f"words things {i % 3}" for i in range(50))]


def _plain(text):
    at: dict[str, list[int]] = {}
    for i, w in enumerate(word_list(text)):
        at.setdefault(w, []).append(i)
    return [{"term": w, "stem": known_stem(w), "at": p} for w, p in at.items()]


def test_entries_stem_a_word_of_many_texts_once(monkeypatch):
    asked = []
    monkeypatch.setattr(keywords, "known_stem", lambda w: asked.append(w) or known_stem(w))
    assert keywords.entries.func(pa.array(TEXTS)).to_pylist() == [_plain(t) for t in TEXTS]
    assert len(asked) == len(set(asked))
    assert keywords.entries.func(pa.array([], pa.string())).to_pylist() == []


def test_entries_where_hashes_clash(monkeypatch):
    monkeypatch.setattr(keywords, "_mixed", lambda x: np.zeros_like(x))
    assert keywords.entries.func(pa.array(TEXTS)).to_pylist() == [_plain(t) for t in TEXTS]


def test_staged_rows_are_moved_into_their_segment(spark, tmp_path, monkeypatch):
    moved = []
    monkeypatch.setattr(keywords.KeywordIndex, "keep", lambda self, staged, place, keep=keywords.KeywordIndex.keep: moved.append(staged.tessera_aside) or keep(self, staged, place))
    kept = keywords.KeywordIndex(spark, str(tmp_path / "k"))
    kept.apply(spark.createDataFrame([("1", "w", "s", "alpha beta"), ("2", "w", "s", "beta")], "point_id string, workspace_id string, source_id string, content string"))
    assert len(moved) == 1 and not kept.folder.exists(moved[0])
    assert {r.point_id for r in kept.held(kept.state()).collect()} == {"1", "2"}
    assert {r.point_id for r in kept.search("beta", 5, workspace_id="w").collect()} == {"1", "2"}
