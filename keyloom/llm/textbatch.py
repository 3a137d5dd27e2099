"""Words, hashes and windows of a batch of texts, computed with numpy.

Every text operator of this subpackage that looks at words goes through
:class:`TextBatch`.  A batch holds the UTF-8 bytes of some documents in one
buffer; words, word hashes and window hashes are arrays over that buffer, so a
task never keeps a Python object for each word.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; in UTF-8
those bytes never occur inside a longer character, so this equals the pattern
``[^\\x20\\x09-\\x0D]+`` over code points.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = b" \t\n\x0b\x0c\r"
#: A batch is cut when it reaches this many bytes; a longer text is a batch of its own.
BATCH_BYTES = 1 << 19
#: Spans of up to so many lanes of eight bytes are hashed from their bytes as numbers, longer ones by XXH64.
LANES = 3

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACE)] = False
_U64 = (1 << 64) - 1
#: The first k bytes of a lane.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base & _U64, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= BATCH_BYTES // 2:
            _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal outputs, all bits depend on all bits."""
    h = h + np.uint64((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & _U64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """sum(h[i + k] * base**k for k < width) modulo 2**64 for each start i (base odd)."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(base, len(h)), out=sums[1:])
    return (sums[width:] - sums[:-width]) * powers(pow(base, -1, 1 << 64), len(h) - width + 1)


class TextBatch:
    """Documents as one byte buffer; ``starts`` has their byte offsets and the end."""

    def __init__(self, texts: Sequence[bytes]):
        self.texts = texts
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.starts[1:])

    def __len__(self) -> int:
        return len(self.texts)

    @cached_property
    def _spans(self) -> tuple[np.ndarray, np.ndarray]:
        inside = _IS_WORD[self.buf]
        begins, ends = inside.copy(), inside.copy()
        cut = self.starts[1:-1]
        cut = cut[(cut > 0) & (cut < len(inside))]
        after = inside[:-1].copy()
        after[cut - 1] = False
        begins[1:] &= ~after
        before = inside[1:].copy()
        before[cut - 1] = False
        ends[:-1] &= ~before
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    @property
    def word_starts(self) -> np.ndarray:
        return self._spans[0]

    @property
    def word_ends(self) -> np.ndarray:
        return self._spans[1]

    @cached_property
    def first_word(self) -> np.ndarray:
        """For each document the index of its first word, then the number of all words."""
        return np.searchsorted(self.word_starts, self.starts)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first_word)

    @cached_property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words)

    def lanes(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[lane, span]: the first bytes of byte spans as numbers, zero behind their ends; and the spans' sizes."""
        size = ends - starts
        padded = np.concatenate([self.buf, np.zeros(8 * LANES + 8, np.uint8)])
        at_every_byte = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        out = np.zeros((LANES, len(starts)), np.uint64)
        for k in range(LANES):
            some = np.flatnonzero(size > 8 * k)
            out[k, some] = at_every_byte[starts[some] + 8 * k] & _MASK[np.minimum(size[some] - 8 * k, 8)]
        return out, size

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal spans have equal hashes wherever they are."""
        parts, size = self.lanes(starts, ends)
        return self._hashed(parts, size, starts)

    def _hashed(self, parts: np.ndarray, size: np.ndarray, starts: np.ndarray) -> np.ndarray:
        h = mixed(parts[0] ^ mixed(size.astype(np.uint64), 3), 1)
        for part in parts[1:]:
            some = np.flatnonzero(part)
            h[some] = mixed(h[some] ^ part[some], 1)
        data = None
        for i in np.flatnonzero(size > 8 * len(parts)).tolist():
            data = self.buf.tobytes() if data is None else data
            h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + size[i]], 42)
        return h

    @cached_property
    def word_lanes(self) -> tuple[np.ndarray, np.ndarray]:
        return self.lanes(self.word_starts, self.word_ends)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self._hashed(*self.word_lanes, self.word_starts)

    def windows(self, width: int) -> np.ndarray:
        """Indexes of the words at which a window of that many words of one document starts."""
        n = len(self.word_starts)
        if n < width:
            return np.zeros(0, np.int64)
        doc = self.word_doc
        return np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])

    def sums(self, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sums of values between consecutive starts."""
        total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
        np.cumsum(values, out=total[1:])
        return np.diff(total[starts])


def slices(texts: Sequence[bytes], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of at most about that many bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ranges(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string column with about that many bytes, a longer text by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def batches(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int, TextBatch]]:
    """The column in batches of bounded bytes: first row, end row, batch; only one batch's texts are Python objects."""
    for a, b in ranges(column, limit):
        yield a, b, TextBatch(utf8(column.slice(a, b - a)))
