"""Operator 8: toxicity by a weighted finite-state grammar over clauses.

Tokens are lower-cased words of letters, commas and clause ends.  Each token has a
class: insult, harm (a verb of threats), target (the reader or a third person),
negation, report (a verb of speech), comma, clause end, or other.  Five deterministic
transducers read and rewrite that tape, one after another:

* negation:  an insult or harm within three tokens after a negation is weakened;
* report:    the same after a verb of speech, to the end of the clause;
* target:    an insult within four tokens after a target is a targeted insult;
* threat:    harm with a target within three tokens after it is a threat;
* insult:    lets through what matches, and nothing else.

Commas end the reach of all but reports.  :func:`compose` makes one machine of them;
each insult brings the weight of its lexicon entry.  So a word counts as what it is in
its clause: a document's figures are, for each outcome (plain, targeted, weakened,
threat, ...), the log of the weights that its clauses have of it, and their best clause and
number.  A logistic turns them into a score: it begins at fixed weights, which order the
outcomes, and is drawn back to them where the labelled rows say nothing.

Lexicon: a few fixed words, and stems (beginnings of 3 to 10 bytes, or whole words)
learned from at most ``SAMPLE`` documents of each label and ``SAMPLE_BYTES`` of their text: those
that cover the toxic documents greedily, most uncovered ones first, with high odds against
clean ones.  Near copies (Jaccard similarity of the stems ``COPY`` or more) count once there.
One task learns from this sample; the model comes to the driver.

Defined results: a null or empty text has the score of no match; without labelled
rows of both classes the fixed words and the fixed logistic are used; repeated rows
score alike; texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .ngrams import adam, sigmoid
from .quality import fitted, labelled
from .shared import in_batches, with_fields
from .simhash import band_keys
from .textbatch import TextBatch, ranges, slices, utf8

SAMPLE, SAMPLE_BYTES, THRESHOLD = 1_500, 6 << 20, 0.7
COPY = 0.8
OTHER, INSULT, HARM, TARGET, NEGATION, REPORT, COMMA, END, TARGETED, WEAK, WEAK_HARM, THREAT = range(12)

#: Words of each class.
WORDS = {
    INSULT: "idiot idiots moron morons imbecile stupid dumb scum trash filth loser losers pathetic worthless disgusting vermin clown bastard coward crétin abruti imbécile ordure minable dummkopf trottel abschaum widerlich idiota estúpido imbécil basura asqueroso",
    HARM: "kill murder hurt destroy crush beat stab shoot burn hang smash tuer frapper écraser töten schlagen vernichten matar golpear destruir",
    TARGET: "you your yours he she him her they them their these those everyone tu toi vous ton ta tes ils elles du dich dir euch ihr sie usted ustedes vosotros ellos ellas",
    NEGATION: "not never no none nobody without hardly isn aren don doesn didn won wouldn pas jamais aucun nicht kein keine nie no nunca tampoco",
    REPORT: "said says say called calls quoted quotes wrote writes told claims claimed accused reported dit disait écrit sagte sagt schrieb dijo dice escribió",
}
#: The ends of clauses, and the signs of a comma.
ENDS, COMMAS = ".!?;:\n…。！？；：؟؛।॥", ",、，،"
#: Weights of the outcomes in a clause, times the lexicon weight of an insult.
WEIGHTS = {INSULT: 1.0, TARGETED: 1.3, WEAK: 0.5, HARM: 0.2, WEAK_HARM: 0.05, THREAT: 1.5}
OUTCOMES = list(WEIGHTS)
#: Where the logistic begins: each outcome, best clause, number of clauses, bias.
PRIOR = np.array([1.5, 2.0, 0.4, 0.2, 0.0, 2.5, 1.0, 0.2, -2.0])
STEMS = range(3, 11)
WHOLE = 15


@dataclass
class Transducer:
    """step(state, symbol) -> (state, symbol)."""

    start: int
    step: Callable


def negation() -> Transducer:
    weak = {INSULT: WEAK, TARGETED: WEAK, HARM: WEAK_HARM}
    return Transducer(0, lambda s, x: (3, x) if x == NEGATION else (0, x) if x in (END, COMMA) else (max(0, s - 1), weak.get(x, x) if s else x))


def report() -> Transducer:
    weak = {INSULT: WEAK, TARGETED: WEAK, HARM: WEAK_HARM}
    return Transducer(0, lambda s, x: (1, x) if x == REPORT else (0, x) if x == END else (s, weak.get(x, x) if s else x))


def target() -> Transducer:
    return Transducer(0, lambda s, x: (4, x) if x == TARGET else (0, x) if x in (END, COMMA) else (max(0, s - 1), TARGETED if s and x == INSULT else x))


def threat() -> Transducer:
    return Transducer(0, lambda s, x: (3, x) if x == HARM else (0, x) if x in (END, COMMA) else (0, THREAT) if s and x == TARGET else (max(0, s - 1), x))


def insult() -> Transducer:
    return Transducer(0, lambda s, x: (0, x if x in WEIGHTS else OTHER))


def compose(*chain: Transducer) -> tuple[list[list[int]], list[list[int]]]:
    """One machine for the chain: for each of its states and each input class the next state and what comes out."""
    start = tuple(t.start for t in chain)
    number, states = {start: 0}, [start]
    move: list[list[int]] = []
    give: list[list[int]] = []
    for state in states:  # grows while it is read
        to, out = [], []
        for symbol in range(END + 1):
            after, x = [], symbol
            for t, s in zip(chain, state, strict=True):
                s, x = t.step(s, x)
                after.append(s)
            if tuple(after) not in number:
                number[tuple(after)] = len(states)
                states.append(tuple(after))
            to.append(number[tuple(after)])
            out.append(x)
        move.append(to)
        give.append(out)
    return move, give


GRAMMAR = compose(negation(), report(), target(), threat(), insult())


class _Signs(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = value = c if c.isalpha() or 0x300 <= code <= 0x36F else f" {ENDS[0]} " if c in ENDS else f" {COMMAS[0]} " if c in COMMAS else " "
        return value


_TABLE = _Signs()


def tokens(texts: list[str]) -> TextBatch:
    return TextBatch([t.lower().translate(_TABLE).encode() for t in texts])


def stems(batch: TextBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each kind of stem: kind, which words are long enough, their stems' hashes with the kind in the last bits."""
    size = batch.word_ends - batch.word_starts
    for kind in [*STEMS, WHOLE]:
        some = np.arange(len(size)) if kind == WHOLE else np.flatnonzero(size > kind)
        at = batch.word_starts[some]
        h = batch.word_hashes if kind == WHOLE else batch.span_hashes(at, at + kind)
        yield kind, some, (h & ~np.uint64(15)) | np.uint64(kind)


def whole(words: str) -> np.ndarray:
    return (TextBatch([words.encode()]).word_hashes & ~np.uint64(15)) | np.uint64(WHOLE)


@dataclass
class Model:
    """Sorted stems with their weights, and the logistic over a document's figures."""

    keys: np.ndarray
    weights: np.ndarray
    logistic: np.ndarray
    grammar: tuple[list[list[int]], list[list[int]]]

    def figures(self, batch: TextBatch) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """For each document its figures in the order of ``PRIOR``, and the clauses that match: first and last token, weight."""
        n = len(batch.word_starts)
        kind = np.zeros(n, np.int8)
        weight = np.zeros(n)
        hashes = (batch.word_hashes & ~np.uint64(15)) | np.uint64(WHOLE)
        for symbol, keys in _FIXED.items():
            kind[np.isin(hashes, keys)] = symbol
        for _, some, h in stems(batch):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            weight[some[hit]] = np.maximum(weight[some[hit]], self.weights[at[hit]])
        kind[weight > 0] = INSULT
        end = np.flatnonzero(kind == END)
        hits = np.flatnonzero((kind == INSULT) | (kind == HARM))
        first, last = batch.first_word[batch.word_doc[hits]], batch.first_word[batch.word_doc[hits] + 1]
        before = np.searchsorted(end, hits)
        a = np.maximum(first, np.append(-1, end)[before] + 1)
        b = np.minimum(last, np.append(end, n)[before])
        clauses: list[list[tuple[int, int, float]]] = [[] for _ in range(len(batch))]
        sums = np.zeros((len(batch), THREAT + 1))
        move, give = self.grammar
        for s, e in sorted(set(zip(a.tolist(), b.tolist(), strict=True))):
            state, total, doc = 0, 0.0, int(batch.word_doc[s])
            for x, w in zip(kind[s:e].tolist(), weight[s:e].tolist(), strict=True):
                out = give[state][x]
                if out:
                    w = w if x == INSULT else 1.0
                    sums[doc, out] += w
                    total += WEIGHTS[out] * w
                state = move[state][x]
            clauses[doc].append((s - int(batch.first_word[doc]), e - 1 - int(batch.first_word[doc]), total))
        best = [max((w for _, _, w in c), default=0.0) for c in clauses]
        many = [np.log1p(sum(w >= 0.5 for _, _, w in c)) for c in clauses]
        return np.column_stack([np.log1p(sums[:, OUTCOMES]), best, many]), clauses

    def score(self, figures: np.ndarray) -> np.ndarray:
        return sigmoid(figures @ self.logistic[:-1] + self.logistic[-1])


_FIXED = {k: whole(v) for k, v in WORDS.items() if k != INSULT} | {END: whole(ENDS[0]), COMMA: whole(COMMAS[0])}


def distinct(sets: list[np.ndarray], bands: list[np.ndarray], rows: np.ndarray) -> dict[int, np.ndarray]:
    """Of these rows the sets that are not empty, but for those that have the similarity ``COPY`` with one before that is kept.

    Sets of that similarity share one of their min-wise bands (:func:`.simhash.band_keys`) but for 3 in a million.
    """
    kept: dict[int, np.ndarray] = {}
    buckets: dict[int, list[int]] = {}
    for i in rows.tolist():
        if not len(sets[i]):
            continue
        for j in {j for key in bands[i].tolist() for j in buckets.get(key, ())}:
            few, many = sorted((len(sets[i]), len(sets[j])))
            if few >= COPY * many:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= COPY * (few + many - both):
                    break
        else:
            kept[i] = sets[i]
            for key in bands[i].tolist():
                buckets.setdefault(key, []).append(i)
    return kept


def lexicon(sets: list[np.ndarray], label: np.ndarray, bands: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Fixed insults, and the stems that cover the toxic documents."""
    known = dict.fromkeys(whole(WORDS[INSULT]).tolist(), 1.0)
    bands = [band_keys(s) for s in sets] if bands is None else bands
    toxic, clean = (distinct(sets, bands, np.flatnonzero(label == k)) for k in (1, 0))
    if toxic and clean:
        features, of = np.concatenate(list(toxic.values())), np.repeat(np.arange(len(toxic)), [len(s) for s in toxic.values()])
        keys, at, support = np.unique(features, return_inverse=True, return_counts=True)
        some = support >= 2
        keep = some[at]
        of, at = of[keep], (np.cumsum(some) - 1)[at[keep]]
        keys, support = keys[some], support[some]
        against = np.zeros(len(keys))
        for s in clean.values():
            x = np.searchsorted(keys, s)
            x = x[x < len(keys)]
            x = np.unique(x[np.isin(keys[x], s)]) if len(x) else x
            against[x] += 1
        odds = np.log((support + 0.5) / (len(toxic) + 1)) - np.log((against + 0.5) / (len(clean) + 1))
        usable = (odds > 2) & (against <= 0.01 * len(clean))
        order = np.argsort(at, kind="stable")
        docs_of = np.split(of[order], np.searchsorted(at[order], np.arange(1, len(keys))))
        for most, least in ((1, max(2, len(toxic) // 100)), (2, max(5, len(toxic) // 50))):
            covered = np.zeros(len(toxic), int)
            for k in np.flatnonzero(np.isin(keys, np.array([*known], np.uint64))):
                covered[docs_of[k]] += 1
            while True:
                open_docs = np.bincount(at[covered[of] < most], minlength=len(keys))
                gain = np.where(usable & (open_docs >= least), open_docs * odds, 0)
                for k in np.flatnonzero(np.isin(keys, np.array([*known], np.uint64))):
                    gain[k] = 0
                if not gain.any():
                    break
                ties = np.flatnonzero(gain >= gain.max() * (1 - 1e-9))
                k = ties[np.argmax(keys[ties] & np.uint64(15))]
                known[int(keys[k])] = float(np.clip(odds[k] / 4, 0.5, 1.5))
                covered[docs_of[k]] += 1
    order = sorted(known)
    return np.array(order, np.uint64), np.array([known[k] for k in order])


def stem_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The distinct stems of each text."""
    for a, b in slices([t.encode() for t in texts]):
        batch, sets = tokens(texts[a:b]), [[] for _ in range(b - a)]
        for _, some, h in stems(batch):
            edges = np.searchsorted(batch.word_doc[some], np.arange(b - a + 1))
            for i, found in enumerate(sets):
                found.append(np.unique(h[edges[i] : edges[i + 1]]))
        yield from map(np.concatenate, sets)


def weighed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The logistic for figures and labels, both labels weighing the same, drawn to ``PRIOR``."""
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def gradient(w):
        d = (sigmoid(x @ w[:-1] + w[-1]) - y) * weight
        return np.append(x.T @ d, d.sum()) + 2e-3 * np.append((w - PRIOR)[:-1], 0)

    return adam(gradient, PRIOR, 800, 0.05)


def fit(texts: list[bytes], label: np.ndarray, grammar=GRAMMAR) -> Model:
    """Learns stems from the texts, and the logistic with stems from three quarters of them, so that it sees unknown texts."""
    texts = [t.decode("utf-8", "replace") for t in texts]
    sets = list(stem_sets(texts))
    bands = [band_keys(s) for s in sets]
    learn = np.arange(len(texts)) % 4 != 3
    if len(set(label[learn])) < 2:
        learn[:] = True
    rows = np.flatnonzero(learn)
    part = Model(*lexicon([sets[i] for i in rows], label[rows], [bands[i] for i in rows]), PRIOR, grammar)
    x = np.concatenate([part.figures(tokens(texts[a:b]))[0] for a, b in slices([t.encode() for t in texts])])
    return Model(*lexicon(sets, label, bands), weighed(x, label.astype(float)), grammar)


def train(docs: DataFrame, labels: DataFrame, where=None, sample: int = SAMPLE, label_col: str = "toxic", sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of the labelled rows; that of the fixed words where they lack one of the labels."""
    return fitted(labelled(docs, labels, label_col, sample, where), fit, sample_bytes) or Model(*lexicon([], np.zeros(0, int)), PRIOR, GRAMMAR)


def scored(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The rows' columns with score, predicted and clauses: (first and last token, weight) of each match."""
    names = [c for c in (docs.columns if columns is None else columns) if c not in ("score", "predicted", "clauses")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("weight", pa.float64())]))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for record in found:
            for a, b in ranges(record.column(len(names))):
                texts = utf8(record.column(len(names)).slice(a, b - a))
                figures, clauses = model.figures(tokens([t.decode("utf-8", "replace") for t in texts]))
                p = model.score(figures)
                rows = [[{"first": s, "last": e, "weight": w} for s, e, w in c] for c in clauses]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in record.columns[:-1]), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(rows, kind)], [*names, "score", "predicted", "clauses"])

    rows = docs.select(*(docs[f"`{c}`"] for c in names), docs[f"`{text_col}`"].alias("_keyloom_text"))
    added = "score double, predicted int, clauses array<struct<first:int,last:int,weight:double>>"
    return in_batches(rows, run, with_fields(docs, names, added))
