import hashlib
import random
import re

import numpy as np
import pytest

from keyloom.llm import substrings


def brute(rows, width):
    """rows of (doc_id, text) in any order; returns n_words, n_removed, kept text for each."""
    words = [[w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (-(1 << 63) if rows[i][0] is None else rows[i][0], i))
    seen, gone = {}, [set() for _ in rows]
    for i in order:
        for s in range(len(words[i]) - width + 1):
            w = tuple(words[i][s : s + width])
            if w in seen and seen[w] != (rows[i], s):
                gone[i].update(range(s, s + width))
            seen.setdefault(w, (rows[i], s))
    return [(len(w), len(g), " ".join(x for k, x in enumerate(w) if k not in g)) for w, g in zip(words, gone, strict=True)]


@pytest.mark.parametrize("cells", [substrings.MIN_CELLS, 16])
def test_removal_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(substrings, "MIN_CELLS", cells)
    monkeypatch.setattr(substrings, "MAX_CELLS", max(cells, 16) if cells == 16 else substrings.MAX_CELLS)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "日本", "\x1c", "a b"]
    passage = " ".join(rng.choices(vocabulary, k=30))
    rows = [(None, passage), (3, passage), (3, passage), (4, None), (5, ""), (6, " \n\t"), (7, "x " * 60), (8, passage.upper()), (9, "one two three")]
    rows += [(10 + i, " ".join(rng.choices(vocabulary, k=rng.randrange(60))) + ("\n" + passage + "\r\n" if i % 3 else "") + " ".join(rng.choices(vocabulary, k=9))) for i in range(60)]
    rows += [(500, "many words of one long text " * 20_000), (501, "many words of one long text " * 3)]
    docs = spark.createDataFrame([(d, t, "keep") for d, t in rows], "doc_id long, text string, n_words string").repartition(5)
    out = substrings.remove(docs, width=8)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed"]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.text) for r in out.collect())
    assert got == sorted((d is not None, d or 0, *x) for (d, _), x in zip(rows, brute(rows, 8), strict=True))


def test_removal_keeps_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", 7), (2, "a b c", None)], "doc_id long, text string, odd int")
    out = substrings.remove(docs, width=2).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, "a b c", 7, 3, 0), (2, "", None, 3, 3)]
    assert substrings.remove(docs.limit(0), width=2).count() == 0


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    for top in (300, 70_000, 1 << 22):
        cells = np.unique(rng.integers(0, top, 200)).astype(np.uint64)
        assert (substrings.decoded(substrings.coded(cells)) == cells).all()
    assert len(substrings.decoded(substrings.coded(np.zeros(0, np.uint64)))) == 0


def test_hash_of_nothing_kept(spark):
    from keyloom.llm import queries

    rows = queries.op6_window_removal(spark, "/root/testdata/sf0.001").collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = [(d, n, g, hashlib.sha256(t.encode()).hexdigest()) for (d, _), (n, g, t) in zip(texts, brute(texts, 20), strict=True)]
    assert sorted(map(tuple, rows)) == sorted(want)
