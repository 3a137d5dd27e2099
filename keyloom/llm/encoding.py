"""Token ids of whole texts by the tokenizers library, with a store of words.

The vocabulary used here drops white space and its pre-tokenizer never joins
characters across white space, so a text's ids are the ids of its words in order.
A Python worker therefore sends each distinct word to the library once and keeps
its ids beside the word's bytes in sorted arrays; texts are put together from those
arrays.  A word is found by a hash, and taken only if its bytes are those of the
stored word.  Words of more than ``8 * LANES`` bytes, and those whose hash another
word has, go to the library each time; texts that may hold a special token go there
whole.  A tokenizer for which words and whole texts differ on a probe gets whole
texts only.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np

from .textbatch import LANES, TextBatch, slices

#: Bound of a worker's store, in words of about 50 bytes.
MAX_WORDS = 1_000_000
#: Texts are encoded in batches of about so many bytes; each inserts its new words into the whole store, so small ones cost more.
ENCODE_BYTES = 1 << 21
#: So many new words are one text for the library, which costs it less than as many texts.
JOINED = 32
_PROBE = "The café, über straße mañana!! x###  it's I'LL\n12,3 (a) 一二 Å naïve..."


class Encoder:
    """Encodes texts; use :meth:`of` to keep one with its store in each Python worker."""

    _kept: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype)
        plain = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip)]
        self.mark, self.mark_id = min(plain, default=(None, -1))
        self._forget()
        self.by_words = np.array_equal(self._texts([_PROBE.encode()])[0], self._direct([_PROBE])[0])

    @classmethod
    def of(cls, path: str, end_id: int) -> Encoder:
        if (path, end_id) not in cls._kept:
            cls._kept.clear()
            cls._kept[path, end_id] = cls(path, end_id)
        return cls._kept[path, end_id]

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted; word i has ids[begin[i]:][:size[i]] and the bytes lanes[:, i]
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.lanes = np.zeros((LANES, 0), np.uint64)
        self.ids = np.zeros(0, self.dtype)

    def _direct(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words, one after another, and how many each has.

        The library takes them in texts of ``JOINED`` words with a special token behind each, on
        both sides of which it works apart; where that token is not seen just once for each word,
        it takes the words one by one.
        """
        if self.mark:
            texts = [self.mark.join([*words[a : a + JOINED], ""]) for a in range(0, len(words), JOINED)]
            ids = np.concatenate(self._direct(texts))
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) == len(words) == sum(t.count(self.mark) for t in texts):
                return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1
        found = self._direct(words)
        return np.concatenate(found), np.array([len(x) for x in found])

    def _learn(self, hashes: np.ndarray, lanes: np.ndarray, words: list[str]) -> None:
        ids, size = self._apart(words)
        size = size.astype(np.int32)
        begin = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.hashes, hashes)  # both are sorted
        self.hashes, self.begin, self.size = (np.insert(x, at, y) for x, y in ((self.hashes, hashes), (self.begin, begin), (self.size, size)))
        self.lanes = np.insert(self.lanes, at, lanes, axis=1)

    def _words(self, batch: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and where those of each word of the batch begin among them and how many they are."""
        lanes, length = batch.word_lanes
        starts, ends, raw = batch.word_starts, batch.word_ends, batch.buf.tobytes()
        hashes, first, of = np.unique(batch.word_hashes, return_index=True, return_inverse=True)
        short = length[first] <= 8 * LANES
        at = np.searchsorted(self.hashes, hashes)
        known = np.append(self.hashes, np.uint64(0))[at] == hashes
        new = np.flatnonzero(short & (~known | (at == len(self.hashes))))
        if len(new):
            a, b = starts[first[new]].tolist(), ends[first[new]].tolist()
            self._learn(hashes[new], lanes[:, first[new]], [raw[x:y].decode() for x, y in zip(a, b, strict=True)])
            at = np.searchsorted(self.hashes, hashes)
        at = at[of]
        odd = length > 8 * LANES
        at[odd] = 0
        if len(self.hashes):
            odd |= (self.lanes[:, at] != lanes).any(axis=0)
            begin, size = self.begin[at], self.size[at].astype(np.int64)
        else:
            begin, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        ids, odd = self.ids, np.flatnonzero(odd)
        if len(odd):
            words = [raw[x:y].decode() for x, y in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)]
            place = {w: i for i, w in enumerate(dict.fromkeys(words))}
            found = self._direct(list(place))
            sizes = np.array([len(x) for x in found], np.int64)
            which = np.array([place[w] for w in words])
            begin[odd], size[odd] = (len(ids) + np.cumsum(sizes) - sizes)[which], sizes[which]
            ids = np.concatenate([ids, *found])
        return ids, begin, size

    def _texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of some texts, word by word."""
        batch = TextBatch(texts)
        if not len(batch.word_starts):
            return [np.zeros(0, self.dtype)] * len(texts)
        ids, begin, size = self._words(batch)
        ends = np.cumsum(size)
        source = np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]))
        return np.split(ids[source], np.append(0, ends)[batch.first_word[1:-1]])

    def encode(self, texts: Sequence[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text (UTF-8) and the end id, as little-endian integers of ``dtype``."""
        for a, b in slices(texts, ENCODE_BYTES):
            if len(self.hashes) > MAX_WORDS:
                self._forget()
            whole = [i for i in range(a, b) if not self.by_words or b"<|" in texts[i]]
            apart = set(whole)
            ids = self._texts([b"" if i in apart else texts[i] for i in range(a, b)])
            for i, x in zip(whole, self._direct([texts[i].decode() for i in whole]), strict=True):
                ids[i - a] = x
            for x in ids:
                yield np.concatenate([x, self.end])
