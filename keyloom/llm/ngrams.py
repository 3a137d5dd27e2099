"""Hashed n-grams of a text batch, and a logistic model over their shares.

A feature's value is its share of the document's n-grams of its kind, so a
document's score is a mean of weights: it is computed with one lookup for each
n-gram and one running sum for each kind, without feature vectors.  Training goes
over a bounded sample in small steps and turns one step's texts into (sparse)
vectors at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .textbatch import TextBatch, mixed, slices

#: Kinds of n-grams: code points of text (with the white space between words), and words.
CHAR_ORDERS, WORD_ORDERS = (3, 5), (1, 2)
KINDS = len(CHAR_ORDERS) + len(WORD_ORDERS)
BITS = 18
#: Shares are small numbers; this brings them near 1 for training.
SCALE = 100.0
#: Passes over the sample, bytes of text in a step, and the step size.
ROUNDS, STEP_BYTES, RATE = 4, 1 << 16, 0.1


def hashed(batch: TextBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind: the features of all n-grams in order, and where each document's begin and end among them."""
    mask = np.uint64((1 << BITS) - 1)
    texts = [t.decode("utf-8", "replace") for t in batch.texts]
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")
    chars_at = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
    for n in CHAR_ORDERS:
        h = np.zeros(max(0, len(chars) - n + 1), np.uint64)
        for k in range(n):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += chars[k : k + len(h)]
        yield (mixed(h, n) & mask).astype(np.int32), *_ends(chars_at, n)
    words = batch.word_hashes
    for n in WORD_ORDERS:
        h = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            h = mixed(h ^ words[k : k + len(h)], 31 + n)
        yield (h & mask).astype(np.int32), *_ends(batch.first_word, n)


def _ends(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    last = max(0, int(at[-1]) - n + 1)
    begins = np.minimum(at[:-1], last)
    return begins, np.maximum(begins, np.minimum(at[1:] - n + 1, last))


@dataclass
class Logistic:
    """weights[kind][hash]; the probability is calibrated by slope and shift."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, batch: TextBatch) -> np.ndarray:
        total = np.full(len(batch), self.bias)
        for w, (h, a, b) in zip(self.weights, hashed(batch), strict=True):
            sums = np.zeros(len(h) + 1)
            np.cumsum(w[h], out=sums[1:])
            total += (sums[b] - sums[a]) * (SCALE / np.maximum(1, b - a))
        return total

    def probability(self, batch: TextBatch) -> np.ndarray:
        return sigmoid(self.slope * self.raw(batch) + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def adam(gradient, w: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def calibrate(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Platt scaling with smoothed targets."""
    n1, n0 = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = raw.std() + 1e-9

    def gradient(w):
        d = sigmoid(w[0] * raw / spread + w[1]) - target
        return np.array([(d * raw / spread).mean() + 1e-3 * w[0], d.mean()])

    w = adam(gradient, np.array([1.0, 0.0]), 800, 0.05)
    return float(w[0] / spread), float(w[1])


def _step(batch: TextBatch, target: np.ndarray, weight: np.ndarray, w: np.ndarray, seen: np.ndarray, bias: np.ndarray) -> None:
    """One step of AdaGrad for the texts of a batch; ``seen`` holds the sums of squares so far, ``bias`` the bias and its sum."""
    kinds = list(hashed(batch))
    z = np.full(len(batch), bias[0])
    shares = []
    for k, (h, a, b) in enumerate(kinds):
        doc = np.repeat(np.arange(len(batch)), b - a)
        at = h[np.repeat(a - np.append(0, np.cumsum(b - a)[:-1]), b - a) + np.arange(len(doc))]
        share = (SCALE / np.maximum(1, b - a))[doc]
        z += np.bincount(doc, w[k][at] * share, len(batch))
        shares.append((at, doc, share))
    d = (sigmoid(z) - target) * weight
    for k, (at, doc, share) in enumerate(shares):
        features, of = np.unique(at, return_inverse=True)
        g = np.bincount(of, share * d[doc], len(features))
        seen[k][features] += g * g
        w[k][features] -= RATE * g / (np.sqrt(seen[k][features]) + 1e-6)
    bias[1] += d.sum() ** 2
    bias[0] -= RATE * d.sum() / (np.sqrt(bias[1]) + 1e-6)


def fit(texts: list[bytes], label: np.ndarray) -> Logistic:
    """Trains on three quarters of the texts with both classes weighing the same, calibrates on the rest."""
    held = np.arange(len(label)) % 4 == 3
    if len(set(label[~held])) < 2 or len(set(label[held])) < 2:
        held[:] = False
    rows = np.flatnonzero(~held)
    own, y = [texts[i] for i in rows], label[rows].astype(float)
    weight = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum())
    w, seen, bias = np.zeros((KINDS, 1 << BITS), np.float32), np.zeros((KINDS, 1 << BITS), np.float32), np.zeros(2)
    for _ in range(ROUNDS):
        for a, b in slices(own, STEP_BYTES):
            _step(TextBatch(own[a:b]), y[a:b], weight[a:b], w, seen, bias)
    model = Logistic(w, float(bias[0]))
    check = np.flatnonzero(held) if held.any() else rows
    some = [texts[i] for i in check]
    raw = np.concatenate([model.raw(TextBatch(some[a:b])) for a, b in slices(some)])
    model.slope, model.shift = calibrate(raw, label[check].astype(float))
    return model
