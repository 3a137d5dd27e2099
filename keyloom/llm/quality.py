"""Operator 5: quality rules with a logistic model over hashed n-grams.

Base figures of each text: words (runs outside white space), code points in
words, signs of ``[#*$%&|<>]``, lines with a word that equal an earlier line, and
words in windows of ``REPEAT`` words that occur twice or more in the text.  A
text fails the base rules with fewer than ``MIN_WORDS`` words or with more than
``MAX_REPEATED`` percent of its words in repeated windows.

The model (word and code point n-grams) is trained on at most ``SAMPLE`` labelled
rows of each class and ``SAMPLE_BYTES`` of their text: those with the least hashes of
their ids, whole, passing over one that would go beyond the bytes.  One task fits
this sample; only the weights (4 MB, of fixed size) come to the driver.  The
probability is calibrated on rows that the model was not trained on.  Scoring runs
in Arrow batches over all rows; a text is kept if it passes the base rules and its
probability is at least ``THRESHOLD``.

Defined results: a null text has no words and fails; without labelled rows of
both classes the base rules alone decide; repeated rows are scored alike; labels
with null ids or values are not used, and of an id's several labels the least is;
an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import Logistic, fit
from .shared import in_batches, with_fields
from .textbatch import SPACE, TextBatch, batches, mixed, ranges, rolling, utf8

REPEAT, MIN_WORDS, MAX_REPEATED = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
SAMPLE, SAMPLE_BYTES, THRESHOLD = 1_000, 8 << 20, 0.5
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(SPACE)] = True


def repeated_words(batch: TextBatch, width: int) -> np.ndarray:
    """For each document the number of words in windows that occur twice or more in it."""
    at = batch.windows(width)
    if not len(at):
        return np.zeros(len(batch), np.int64)
    doc = batch.word_doc[at]
    h = mixed(rolling(batch.word_hashes, width, 0xC2B2AE3D27D4EB4F)[at]) ^ mixed(doc.astype(np.uint64), 5)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(batch.word_starts) + 1, np.int64)
    cover[at[twice]] += 1
    cover[at[twice] + width] -= 1
    return np.diff(np.append(0, np.cumsum(np.cumsum(cover)[:-1] > 0))[batch.first_word])


def figures(batch: TextBatch) -> dict[str, np.ndarray]:
    plain = [len(t) - len(t.translate(None, SYMBOLS)) for t in batch.texts]
    lines = []
    for t in batch.texts:
        some = [x for x in t.split(b"\n") if x.strip()] if t.count(b"\n") else []
        lines.append(len(some) - len(set(some)))
    counted = ~(_CONTINUES | _BLANK)[batch.buf]
    return {
        "n_words": batch.n_words,
        "word_chars": batch.sums(counted, batch.starts),
        "n_symbols": np.array(plain, np.int64),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": repeated_words(batch, REPEAT),
    }


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, most: int, where=None) -> DataFrame:
    """text and label of at most ``most`` documents of each label 0 and 1: those with the least hashes of their ids."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")  # labels of other documents use up no sample
    known = known.groupBy(F.col("doc_id").alias("label_id")).agg(F.min(label_col).alias("label"))
    if where is not None:
        known = known.where(where(F.col("label_id")))
    found = [known.where(F.col("label") == k).orderBy(F.xxhash64("label_id"), "label_id").limit(most) for k in (0, 1)]
    some = F.broadcast(found[0].unionByName(found[1]))  # at most 2 * most short rows
    joined = docs.select(F.col("doc_id").alias("label_id"), F.coalesce("text", F.lit("")).alias("text")).join(some, "label_id")
    return joined.groupBy("label_id").agg(F.min("text").alias("text"), F.min("label").cast("int").alias("label"))


def fitted(rows: DataFrame, fit: Callable[[list[bytes], np.ndarray], object], most_bytes: int):
    """What ``fit`` makes of the texts and labels of :func:`labelled` in one task, or None without both labels.

    Texts come in the order of their ids' hashes; of each label they have at most ``most_bytes``.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, label, used = [], [], {0: 0, 1: 0}
        for record in found:
            for a, b in ranges(record.column(0)):
                for text, y in zip(utf8(record.column(0).slice(a, b - a)), record.column(1).slice(a, b - a).to_pylist(), strict=True):
                    if used[y] + len(text) <= most_bytes:
                        used[y] += len(text)
                        texts.append(text)
                        label.append(y)
        if len(set(label)) == 2:
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(texts, np.array(label)))]}, schema=pa.schema([("model", pa.binary())]))

    dealt = rows.repartition(1).sortWithinPartitions(F.xxhash64("label_id", F.lit(9)), "label_id")  # the bounded sample
    model = in_batches(dealt.select("text", "label"), run, "model binary").collect()
    return pickle.loads(model[0]["model"]) if model else None


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Logistic | None:
    """A model of label 1, or None without labelled documents of both classes."""
    return fitted(labelled(docs, labels, label_col, sample), fit, sample_bytes)


def scored(docs: DataFrame, model: Logistic | None, text_col: str = "text", threshold: float = THRESHOLD, columns: list[str] | None = None) -> DataFrame:
    """The rows with the base figures, base_failed, quality (probability, null without a model) and kept.

    Of the input, ``columns`` are kept (all by default); those named like an added one are replaced.
    """
    added = [*FIGURES, "base_failed", "quality", "kept"]
    names = [c for c in (docs.columns if columns is None else columns) if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for record in found:
            for a, b, batch in batches(record.column(len(names))):
                own = figures(batch)
                failed = (own["n_words"] < MIN_WORDS) | (100 * own["n_repeat_words"] > MAX_REPEATED * own["n_words"])
                p = model.probability(batch) if model else np.ones(b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in record.columns[:-1]), *(pa.array(own[k]) for k in FIGURES), pa.array(failed), pa.array(p, mask=np.full(b - a, model is None)), pa.array(~failed & (p >= threshold))],
                    [*names, *added],
                )

    kept = docs.select(*(docs[f"`{c}`"] for c in names), docs[f"`{text_col}`"].alias("_keyloom_text"))
    figures_added = ", ".join(f"{k} long" for k in FIGURES)
    return in_batches(kept, run, with_fields(docs, names, f"{figures_added}, base_failed boolean, quality double, kept boolean"))
