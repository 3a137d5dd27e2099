"""Operator 7: language identification of mixed-language text.

1. The script of a word (that of its first letter, by code point ranges) narrows
   the candidates to the languages in which the training texts use that script.
2. A word's score for a language is the mean log probability of its byte trigrams
   (with a blank on both sides) and of the word itself, learned as smoothed
   counts with hashed features.
3. Viterbi finds the labelling of the words with the best total score, where each
   change of language costs ``SWITCH``; runs of one label are spans.

A document's language is the one whose spans hold most letters; its score is that
share, so a text in one language scores 1 and an even mixture of two 0.5.

Training reads about ``SAMPLE`` documents of each of the ``MAX_LANGUAGES`` most frequent
languages: those whose ids' hashes are below a share of all hashes that follows from
the language's number of rows.  Executors count features, Spark adds the counts up, and a
table of fixed size for each language comes to the driver.  Scoring is one pass;
documents are decoded side by side, one word of each at a time.

Defined results: a null text, or one without a letter (Unicode category L), is ``und``
with score 0; words without a letter take no part; without training rows everything is
``und``; ties go to the language that sorts first; very long texts are labelled
to the end; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, with_fields
from .textbatch import TextBatch, mixed, ranges, utf8

SAMPLE, MAX_LANGUAGES, SWITCH, BITS = 400, 256, 6.0, 17
UNKNOWN = "und"
#: Texts decoded side by side have about so many bytes.
DECODE_BYTES = 2 << 20
#: Scripts and the first and last code points of their ranges.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
_NAMES = [*SCRIPTS, "other"]


def _script_table() -> np.ndarray:
    table = np.full(0x30000, len(_NAMES) - 1, np.int8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            table[a : b + 1] = k
    return table


_SCRIPT = _script_table()


class Words:
    """The words with a letter of some texts, lower-cased: hashes, trigrams, letters and scripts."""

    def __init__(self, texts: list[str]):
        # words of letters: every other character becomes a blank, so a word is what stands between two
        self.batch = TextBatch([_letters_only(t).encode() for t in texts])
        b = self.batch
        self.doc = b.word_doc
        buf = np.concatenate([[32], b.buf, [32, 32]]).astype(np.uint64)
        mask = np.uint64((1 << BITS) - 1)
        grams = (buf[:-2] << np.uint64(16)) | (buf[1:-1] << np.uint64(8)) | buf[2:]
        self.grams = (mixed(grams, 3) & mask).astype(np.int32)
        self.whole = (mixed(b.word_hashes, 4) & mask).astype(np.int32)
        lead = (b.buf & 0xC0) != 0x80
        self.letters = self.sums(lead.astype(np.float64))
        first = b.buf[b.word_starts].astype(np.int64) if len(b.word_starts) else np.zeros(0, np.int64)
        self.script = np.zeros(len(first), np.int8)
        wide = np.flatnonzero(first >= 0x80)
        if len(wide):
            size = np.select([first[wide] >= 0xF0, first[wide] >= 0xE0], [4, 3], 2)
            code = first[wide] & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
            for k in range(1, 4):
                more = size > k
                code[more] = code[more] << 6 | (b.buf[b.word_starts[wide[more]] + k] & 0x3F)
            self.script[wide] = _SCRIPT[np.minimum(code, len(_SCRIPT) - 1)]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over each word of a value for each byte."""
        total = np.append(0, np.cumsum(values))
        return total[self.batch.word_ends] - total[self.batch.word_starts]


class _Letters(dict):
    def __missing__(self, code: int) -> int | str:
        c = chr(code)
        value = c if c.isalpha() or unicodedata.category(c)[0] == "M" else " "
        self[code] = value
        return value


_TABLE = _Letters()
#: Marks that follow no letter.
_LONE_MARKS = regex.compile(r"(?<![\p{L}\p{M}])\p{M}+")


def _letters_only(text: str) -> str:
    found = text.lower().translate(_TABLE)
    return found if found.isascii() else _LONE_MARKS.sub(" ", found)


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # [hash, language] log probabilities
    words: np.ndarray
    uses: np.ndarray  # [script, language] whether the language is written in it

    def scores(self, w: Words) -> np.ndarray:
        """[word, language] scores."""
        b = w.batch
        out = np.empty((len(b.word_starts), len(self.languages)), np.float32)
        count = (b.word_ends - b.word_starts).astype(np.float32)
        for k in range(len(self.languages)):
            total = np.append(0, np.cumsum(self.grams[:, k][w.grams], dtype=np.float64))
            # trigram i is centred on byte i of the texts, so a word's trigrams include the blanks beside it
            out[:, k] = (total[b.word_ends] - total[b.word_starts]) / count + self.words[:, k][w.whole] / 2
        allowed = self.uses[w.script]
        out[~allowed & allowed.any(axis=1)[:, None]] -= 50
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word; ``first`` has each document's first word, and the end."""
    n, k = scores.shape
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    starts, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    stay = np.empty((n, k), bool)  # whether the best way to a label came from the same label
    best = np.empty(n, np.int16)  # the best label so far, from which any change comes
    value = np.zeros((len(size), k), np.float32)
    alive = np.searchsorted(-size, -np.arange(longest), "left")
    for t in range(longest):
        m = alive[t]
        at = starts[:m] + t
        v = value[:m]
        if t:
            change = v.max(axis=1, keepdims=True) - switch
            keep = v >= change
            stay[at] = keep
            np.maximum(v, change, out=v)
        v += scores[at]
        v -= v.max(axis=1, keepdims=True)
        best[at] = v.argmax(axis=1)
    label = np.empty(n, np.int16)
    current = np.zeros(len(size), np.int16)
    for t in range(longest - 1, -1, -1):
        m = alive[t]
        at = starts[:m] + t
        last = size[:m] == t + 1
        current[:m] = np.where(last, best[at], current[:m])
        label[at] = current[:m]
        if t:
            moved = ~stay[at, current[:m]]
            current[:m] = np.where(moved, best[at - 1], current[:m])
    return label


def sampled(rows: DataFrame, sample: int) -> DataFrame:
    """Of rows (id, lang, text) about ``sample`` of each of the most frequent languages, by the hashes of their ids."""
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return rows.limit(0)
    share = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, min(1.0, sample / r.n))))
    return rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * F.element_at(share, F.col("lang")))


def train(docs: DataFrame, sample: int = SAMPLE, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from rows with a language and a text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    size = 1 << BITS
    edges = np.cumsum([0, size, size, len(_NAMES)])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in found:
            langs = np.array(record.column(0).to_pylist(), object)
            for a, b in ranges(record.column(1)):
                texts = [t.decode("utf-8", "replace") for t in utf8(record.column(1).slice(a, b - a))]
                for lang in dict.fromkeys(langs[a:b]):
                    w = Words([t for t, x in zip(texts, langs[a:b], strict=True) if x == lang])
                    inside = w.batch.buf != 32
                    slots, n = np.unique(np.concatenate([w.grams[: len(inside)][inside], w.whole + edges[1], w.script + edges[2]]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(slots.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "slot", "n"])

    counted = in_batches(sampled(rows, sample).select("lang", "text"), run, "lang string, slot int, n long")
    found = counted.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()  # at most MAX_LANGUAGES * edges[-1] rows
    names = sorted(set(found.column("lang").to_pylist()))
    table = np.zeros((edges[-1], len(names)))
    at = {x: i for i, x in enumerate(names)}
    table[found.column("slot").to_numpy(), [at[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()

    def logs(c: np.ndarray, smooth: float) -> np.ndarray:
        p = np.log((c + smooth) / (c.sum(axis=0) + smooth * size))
        return (p - p.mean(axis=1, keepdims=True) if names else p).astype(np.float32)

    script = table[edges[2] :]
    return Model(names, logs(table[:size], 0.5), logs(table[size : edges[2]], 0.1), script > 0.001 * script.sum(axis=0))


def labelled_spans(texts: list[str], model: Model, switch: float = SWITCH) -> tuple[Words, np.ndarray]:
    w = Words(texts)
    return w, viterbi(model.scores(w), w.batch.first_word, switch)


def predicted(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The rows' columns with lang_pred, score and spans: (language, first and last word of letters) of each run."""
    names = [c for c in (docs.columns if columns is None else columns) if c not in ("lang_pred", "score", "spans")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = max(1, len(model.languages))
        languages = np.array([*model.languages, UNKNOWN], object)
        for record in found:
            for a, b in ranges(record.column(len(names)), DECODE_BYTES):
                n = b - a
                texts = [t.decode("utf-8", "replace") for t in utf8(record.column(len(names)).slice(a, n))]
                lang, score = np.full(n, len(model.languages)), np.zeros(n)
                spans: list[list[dict]] = [[] for _ in range(n)]
                if model.languages:
                    w, label = labelled_spans(texts, model)
                    share = np.bincount(w.doc * k + label, w.letters, n * k).reshape(n, k)
                    some = share.sum(axis=1) > 0
                    lang[some] = share[some].argmax(axis=1)
                    score[some] = share[some].max(axis=1) / share[some].sum(axis=1)
                    edge = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1]))) if len(label) else np.zeros(0, int)
                    for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(label)], strict=True):
                        i, base = w.doc[s], w.batch.first_word[w.doc[s]]
                        spans[i].append({"lang": languages[label[s]], "first": int(s - base), "last": int(e - 1 - base)})
                kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, n) for c in record.columns[:-1]), pa.array(languages[lang], pa.string()), pa.array(score), pa.array(spans, kind)], [*names, "lang_pred", "score", "spans"])

    rows = docs.select(*(docs[f"`{c}`"] for c in names), docs[f"`{text_col}`"].alias("_keyloom_text"))
    return in_batches(rows, run, with_fields(docs, names, "lang_pred string, score double, spans array<struct<lang:string,first:int,last:int>>"))
