"""Operator 9: vector bin packing of examples into sequences.

A sequence has three limits at once: tokens, segments and loss-bearing tokens.
Each example is cut into full sequences as long as it is longer than one; the
pieces that are left go into bins by the dot-product heuristic: a bin takes the
piece with the largest dot product of its demand and the bin's free room, both
as shares of the limits, among the pieces that fit.  When none fits, a bin that
still has room for tokens takes the beginning of the longest piece, and the rest
of that piece stays in the pool; so a bin is left short only by its limits on
segments or loss.  A short sequence is cut at powers of two, from the largest
down, which need no padding.

Packing is done inside each partition of the input, over pools of ``POOL``
pieces: no shuffle, and memory for one pool only.  What a pool's last bin holds
goes back to the next pool.  A sequence's id is its partition and its number in
it, so ids never meet.

Defined results: a null text is empty and has its end id alone; repeated rows,
null ids and very long texts are packed like any others; an empty table gives no
rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import ENCODE_BYTES, Encoder
from .shared import in_batches
from .textbatch import ranges, utf8

POOL = 2048
SCHEMA = "doc_id long, start long, length long, doc_tokens long, loss_tokens long, sequence_id long, offset long, ids binary"


class Piece:
    """A run of ids of one example; ``free``: how many of its first ids bear no loss."""

    __slots__ = ("doc", "ids", "start", "total", "free")

    def __init__(self, doc, ids, start, total, free):
        self.doc, self.ids, self.start, self.total, self.free = doc, ids, start, total, free

    def __len__(self):
        return len(self.ids)

    @property
    def loss(self) -> int:
        return max(0, len(self.ids) - self.free)

    def split(self, n: int) -> tuple[Piece, Piece]:
        rest = Piece(self.doc, self.ids[n:], self.start + n, self.total, max(0, self.free - n))
        return Piece(self.doc, self.ids[:n], self.start, self.total, min(self.free, n)), rest


def fill(pieces: list[Piece], limits: tuple[int, int, int]) -> Iterator[tuple[list[Piece], bool]]:
    """Sequences of these pieces, and whether each is closed (the last may have room left)."""
    tokens, segments, most_loss = limits
    size = np.array([len(p) for p in pieces], np.int64)
    loss = np.array([p.loss for p in pieces], np.int64)
    pieces, left = list(pieces), len(pieces)
    while left:
        held: list[Piece] = []
        room, slots, spare = tokens, segments, most_loss
        while left and room and slots:
            fits = (size > 0) & (size <= room) & (loss <= spare)
            gain = size * (room / tokens**2) + slots / segments**2 + loss * (spare / most_loss**2)
            gain[~fits] = -1
            i = int(np.argmax(gain))
            if gain[i] >= 0:
                piece, size[i], loss[i] = pieces[i], 0, 0
                left -= 1
            else:
                i = int(np.argmax(size))
                n = min(room, pieces[i].free + spare, len(pieces[i]) - 1)
                if n <= 0:
                    break
                piece, pieces[i] = pieces[i].split(n)
                size[i], loss[i] = len(pieces[i]), pieces[i].loss
            held.append(piece)
            room, slots, spare = room - len(piece), slots - 1, spare - piece.loss
        yield held, not room or bool(left)


def powers_of_two(held: list[Piece], tokens: int) -> Iterator[list[Piece]]:
    """A short sequence as sequences whose lengths are powers of two, the largest first."""
    rest, total = list(held), sum(map(len, held))
    if total == tokens:
        yield rest
        return
    while total:
        room, out = 1 << (total.bit_length() - 1), []
        total -= room
        while room:
            piece = rest.pop(0)
            if len(piece) > room:
                piece, later = piece.split(room)
                rest.insert(0, later)
            out.append(piece)
            room -= len(piece)
        yield out


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    max_tokens: int = 4096,
    max_segments: int = 512,
    max_loss_tokens: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_chars_col: str | None = None,
) -> DataFrame:
    """Packs every id of every example; a row for each piece with its ids (unsigned 32-bit, little-endian).

    ``prompt_chars_col`` holds how many first characters of a text are a prompt;
    their ids, encoded apart from the rest, bear no loss.  Without it all ids do.
    """
    prompt = F.lit(0) if prompt_chars_col is None else F.coalesce(F.col(prompt_chars_col).cast("int"), F.lit(0))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.substring(text, F.lit(1), prompt).alias("prompt") if prompt_chars_col else F.lit("").alias("prompt"), F.substring(text, prompt + 1, F.length(text)).alias("text") if prompt_chars_col else text.alias("text"))
    limits = (max_tokens, max_segments, max_loss_tokens)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names = Encoder.of(tokenizer, end_id), [x.split()[0] for x in SCHEMA.split(", ")]
        number, out, size = TaskContext.get().partitionId() << 32, [], 0

        def rows_of(sequence: list[Piece]) -> None:
            nonlocal number, size
            at = 0
            for p in sequence:
                out.append((p.doc, p.start, len(p), p.total, p.loss, number, at, p.ids.astype("<u4").tobytes()))
                at += len(p)
            size += at
            number += 1

        def flush() -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*out, strict=True))
            batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], names)
            out.clear()
            size = 0
            return batch

        pool: list[Piece] = []
        for batch in (record.slice(a, b - a) for record in found for a, b in ranges(record.column(2), ENCODE_BYTES)):
            docs, prompts, texts = batch.column(0).to_pylist(), utf8(batch.column(1)), utf8(batch.column(2))
            heads = encoder.encode(prompts) if prompt_chars_col else None
            for doc, ids in zip(docs, encoder.encode(texts), strict=True):
                head = next(heads)[:-1] if heads else ids[:0]
                ids = np.concatenate([head, ids]) if len(head) else ids
                piece = Piece(doc, ids, 0, len(ids), len(head))
                while len(piece) >= max_tokens and max(0, max_tokens - piece.free) <= max_loss_tokens:
                    whole, piece = piece.split(max_tokens)
                    rows_of([whole])
                if len(piece):
                    pool.append(piece)
                if len(pool) >= POOL:
                    pieces, pool = pool, []
                    for held, closed in fill(pieces, limits):
                        if closed:
                            for x in powers_of_two(held, max_tokens):
                                rows_of(x)
                        else:
                            pool = held
                if size > 1 << 20:
                    yield flush()
        for held, _ in fill(pool, limits):
            for x in powers_of_two(held, max_tokens):
                rows_of(x)
        if out:
            yield flush()

    return in_batches(rows, run, SCHEMA)
