import random
import re

import numpy as np

from keyloom.llm import queries, quality
from keyloom.llm.textbatch import TextBatch

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_figures_equal_brute_force():
    rng = random.Random(2)
    texts = ["", None, "\n\n \t", "é日 x\x1cy ##|", "a b\na b\n a b\na b", "one two three four five six seven eight " * 3, "w " * 40, "x" * 50_000, "a\r\nb\x0bc\x0cd"]
    texts += [" ".join(rng.choices("abcdé", k=rng.randrange(80))) + rng.choice(["\n", "", " \n a"]) for _ in range(200)]
    found = quality.figures(TextBatch([(t or "").encode() for t in texts]))
    got = list(zip(*(found[k].tolist() for k in quality.FIGURES), strict=True))
    assert got == [brute(t) for t in texts]


def test_query_equals_brute_force_and_separates_labels(spark):
    rows = {r.doc_id: r for r in queries.op5_quality_model(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r, (n, chars, symbols, lines, repeats) = rows[d.doc_id], brute(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert not (r.base_failed and r.kept)
    labels = [x for x in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if not rows[x.doc_id].base_failed]
    right = [rows[x.doc_id].kept == (x.quality == 1) for x in labels]
    assert np.mean(right) > 0.97


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 3 != 0"))
    rows = quality.scored(docs, model, columns=["doc_id"]).join(labels.where("doc_id % 3 = 0").withColumnRenamed("quality", "wanted"), "doc_id").where("NOT base_failed").collect()
    assert np.mean([(r.quality >= 0.5) == (r.wanted == 1) for r in rows]) > 0.95


def test_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "good words " * 5 + " ".join(map(str, range(30))), "x"), (2, None, "y"), (None, "a", "z")], "doc_id long, text string, kept string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(docs, empty) is None
    out = quality.scored(docs, None)
    assert out.columns.count("kept") == 1 and sorted(r.kept for r in out.collect()) == [False, False, True]
    assert quality.scored(docs.limit(0), None).count() == 0


def test_labels_of_absent_documents_use_up_no_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    got = quality.labelled(docs, labels, "quality", 5).collect()
    assert sorted(r.label for r in got) == [0] * 5 + [1] * 5 and all(r.label_id < 20 for r in got)
