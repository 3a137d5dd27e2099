"""Operator 6: exact removal of repeated word windows, with a count-min prefilter.

A window is ``width`` consecutive words of one document.  A word goes if a window
that covers it also starts earlier: in a document that sorts before, or earlier
in the same one.  All windows are judged on the input.

1. Sketches.  Every partition counts its windows in ``DEPTH`` rows of cells.  A
   partition's sketch is sparse: the cells it touches, sorted and coded by their
   distances, in chunks of the cell range.  The chunks of all partitions meet in
   one task for each chunk, are added up there cell by cell, and leave a bitmap
   of the cells counted twice or more.  The bitmaps are a file in the shared
   folder; the number of cells follows the bytes of text up to ``MAX_CELLS``, so
   the file has a bound (``DEPTH * MAX_CELLS / 8`` bytes).  Beyond it the
   estimates get looser, not the result.
2. Exact counts.  A second pass over the texts hands on only the windows whose
   cells are all counted twice or more: an overestimate, so no repeated window is
   lost.  Each is its 96-bit hash and its place; a window hash's least place is
   its first occurrence.  A batch hands on one place for each of its hashes and a
   partition the least of those, so a window that occurs everywhere is one row for
   each partition.
3. Removal.  First occurrences go back to their documents.  A third pass finds
   the windows estimated repeated again and takes away those that are not the
   first: what is left of them covers the words to remove.

Defined results: a null text has no words; order is by doc_id (null first), then
by a hash of the text, then by place; equal rows (same id and text) are treated
alike, as one; a text shorter than a window stays; an empty table gives no rows.
Other columns are kept by ``remove`` as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import filesystem, in_batches, new_folder
from .textbatch import TextBatch, batches, mixed, rolling

DEPTH = 2
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 32
CHUNK = 1 << 22
NULL_ID = -(1 << 63)
#: A partition's sketch is handed on in parts of so many windows.
PART = 4 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def window_hashes(batch: TextBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts of a batch's windows (word indexes), and two independent 64-bit hashes of each."""
    at = batch.windows(width)
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    words = batch.word_hashes
    one, two = (mixed(rolling(mixed(words, i + 1), width, base)[at]) for i, base in enumerate(_BASES))
    return at, one, two


def cells_of(one: np.ndarray, cells: int, row: int) -> np.ndarray:
    """The cells of window hashes in one row of the sketch (32 bits are enough for MAX_CELLS)."""
    out = np.empty(len(one), np.uint32)
    for at in range(0, len(one), 1 << 16):
        out[at : at + (1 << 16)] = mixed(one[at : at + (1 << 16)], 7 + row) & np.uint64(cells - 1)
    return out


def coded(sorted_cells: np.ndarray) -> bytes:
    """Ascending distinct cells of a chunk by their distances: low bytes, Huffman-coded high bytes, long distances apart."""
    gaps = np.diff(sorted_cells.astype(np.int64), prepend=-1)
    long = gaps[gaps >= 255 << 8].astype("<u4")
    gaps = np.minimum(gaps, 255 << 8)
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    high = coder.compress((gaps >> 8).astype(np.uint8).tobytes()) + coder.flush()
    return np.array([len(gaps), len(long)], "<u4").tobytes() + long.tobytes() + (gaps & 255).astype(np.uint8).tobytes() + high


def decoded(data: bytes) -> np.ndarray:
    n, n_long = np.frombuffer(data, "<u4", 2).tolist()
    at = 8 + 4 * n_long
    gaps = np.frombuffer(data, np.uint8, n, at) + (np.frombuffer(zlib.decompress(data[at + n :], -15), np.uint8).astype(np.int64) << 8)
    gaps[gaps == 255 << 8] = np.frombuffer(data, "<u4", n_long, 8)
    return np.cumsum(gaps) - 1


def _sketch_rows(docs: DataFrame, width: int, cells: int) -> DataFrame:
    """row, chunk, once and again (cells met in a part of a partition; those met twice there)."""
    span = min(cells, CHUNK)

    def rows_of(hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for row in range(DEPTH):
            found = np.concatenate([cells_of(x, cells, row) for x in hashes])
            found.sort()
            first = np.append(True, found[1:] != found[:-1])
            single, twice = found[first], np.unique(found[~first])
            del found, first
            edges = np.arange(0, cells, span, dtype=np.uint32)
            a, b = (np.append(np.searchsorted(x, edges), len(x)) for x in (single, twice))
            kept = [k for k in range(len(edges)) if a[k] < a[k + 1]]
            low = [np.uint32(k * span) for k in kept]
            yield pa.RecordBatch.from_pydict(
                {"row": [row] * len(kept), "chunk": kept, "once": [coded(single[a[k] : a[k + 1]] - x) for k, x in zip(kept, low, strict=True)], "again": [coded(twice[b[k] : b[k + 1]] - x) for k, x in zip(kept, low, strict=True)]},
                schema=pa.schema([("row", pa.int32()), ("chunk", pa.int32()), ("once", pa.binary()), ("again", pa.binary())]),
            )

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for record in found:
            for _, _, batch in batches(record.column(0)):
                _, one, _ = window_hashes(batch, width)
                held.append(one)
                n += len(one)
                if n >= PART:
                    yield from rows_of(held)
                    held, n = [], 0
        if n:
            yield from rows_of(held)

    return in_batches(docs.select("text"), run, "row int, chunk int, once binary, again binary")


def repeated_cells(docs: DataFrame, width: int, cells: int) -> str:
    """Writes the bitmaps of cells counted twice or more; returns their folder."""
    path, span = new_folder(docs.sparkSession, "sketch"), min(cells, CHUNK)

    def merge(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, local = filesystem(path)
        key, counts = None, np.zeros(span, np.uint8)

        def put() -> None:
            attempt = f"{local}/.{key[0]}-{key[1]}.{TaskContext.get().taskAttemptId()}"
            with system.open_output_stream(attempt) as out:
                out.write(np.packbits(counts > 1, bitorder="little").tobytes())
            system.move(attempt, f"{local}/{key[0]}-{key[1]}")

        for record in found:
            for row, chunk, once, again in zip(*(c.to_pylist() for c in record.columns), strict=True):
                if key != (row, chunk):
                    if key is not None:
                        put()
                    key = (row, chunk)
                    counts[:] = 0
                at = decoded(once)
                counts[at] = np.minimum(counts[at] + 1, 2)
                counts[decoded(again)] = 2
        if key is not None:
            put()
            yield pa.RecordBatch.from_pydict({"done": [1]}, schema=pa.schema([("done", pa.int32())]))

    rows = _sketch_rows(docs, width, cells)
    in_batches(rows.repartition("row", "chunk").sortWithinPartitions("row", "chunk"), merge, "done int").agg(F.count("*")).collect()
    return path


class Repeated:
    """The bitmaps, as tasks read them: mapped where the folder is local, else read once for each Python worker."""

    _kept: dict[str, Repeated] = {}

    def __init__(self, path: str, cells: int):
        self.cells, self.shift = cells, np.uint64(min(cells, CHUNK).bit_length() - 1)
        system, local = filesystem(path)
        self.rows: list[list[np.ndarray | None]] = [[None] * (cells // min(cells, CHUNK)) for _ in range(DEPTH)]
        for info in system.get_file_info(_selector(local)):
            if not info.base_name.startswith("."):
                row, chunk = map(int, info.base_name.split("-"))
                if system.type_name == "local":
                    data = np.memmap(info.path, np.uint8, "r")
                else:
                    with system.open_input_file(info.path) as f:
                        data = np.frombuffer(f.read(), np.uint8)
                self.rows[row][chunk] = data

    @classmethod
    def of(cls, path: str, cells: int) -> Repeated:
        if path not in cls._kept:
            cls._kept.clear()
            cls._kept[path] = cls(path, cells)
        return cls._kept[path]

    def __call__(self, one: np.ndarray) -> np.ndarray:
        """Indexes of the windows whose cells are all counted twice or more."""
        left = np.arange(len(one))
        for number, row in enumerate(self.rows):
            cells = cells_of(one[left], self.cells, number).astype(np.uint64)
            order = np.argsort(cells)
            cells = cells[order]
            chunks = (cells >> self.shift).astype(np.int64)
            low = cells & np.uint64((1 << int(self.shift)) - 1)
            hit = np.zeros(len(cells), bool)
            edges = np.searchsorted(chunks, np.arange(len(row) + 1))
            for k in np.flatnonzero(np.diff(edges)):
                if row[k] is not None:
                    at = low[edges[k] : edges[k + 1]]
                    hit[edges[k] : edges[k + 1]] = row[k][(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
            left = np.sort(left[order[hit]])
        return left


def _selector(path: str):
    from pyarrow import fs

    return fs.FileSelector(path)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows with the columns that order them; places are ``(tie << 32) + first word``.

    The tie is a hash of the text where ids repeat, else 0.
    """
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"))
    unique = ids.groupBy("id").count().where("count > 1").isEmpty()
    tie = F.lit(0).cast("long") if unique else F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).bitwiseAND(0x7FFFFFFF)
    return docs.withColumns({"_keyloom_id": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), "_keyloom_tie": tie})


def first_places(keyed: DataFrame, text_col: str, width: int, path: str, cells: int) -> DataFrame:
    """_keyloom_id, _keyloom_tie, firsts: where windows estimated repeated occur first, for each document that has such."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = Repeated.of(path, cells)
        for record in found:
            ids, ties = record.column(0).to_numpy(), record.column(1).to_numpy()
            for a, b, batch in batches(record.column(2)):
                at, one, two = window_hashes(batch, width)
                some = repeated(one)
                doc = batch.word_doc[at[some]]
                place = (ties[a:b][doc] << 32) + (at[some] - batch.first_word[doc])
                one, two, doc = one[some].view(np.int64), (two[some] >> np.uint64(32)).astype(np.int64).astype(np.int32), ids[a:b][doc]
                order = np.lexsort((place, doc, two, one))
                one, two, doc, place = one[order], two[order], doc[order], place[order]
                first = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])) if len(one) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (one, two, doc, place)], ["one", "two", "doc", "place"])

    rows = in_batches(keyed.select("_keyloom_id", "_keyloom_tie", text_col), run, "one long, two int, doc long, place long")
    rank = F.row_number().over(Window.partitionBy("one", "two").orderBy("doc", "place"))
    firsts = rows.withColumn("rank", rank).where("rank = 1")
    places = F.collect_list(F.col("place").bitwiseAND(0xFFFFFFFF).cast("int"))
    return firsts.groupBy(F.col("doc").alias("_keyloom_id"), F.shiftright("place", 32).alias("_keyloom_tie")).agg(places.alias("_keyloom_firsts"))


def covered_words(batch: TextBatch, width: int, repeated: Repeated, firsts: list[np.ndarray | None]) -> np.ndarray:
    """Whether each word of the batch is in a window that also starts earlier."""
    at, one, _ = window_hashes(batch, width)
    hit = np.zeros(len(batch.word_starts) + 1, np.int64)
    hit[at[repeated(one)]] = 1
    for i, places in enumerate(firsts):
        if places is not None:
            hit[batch.first_word[i] + places] = 0
    # a window that is hit covers the words from its start on; windows never leave their document
    cover = hit.copy()
    cover[np.flatnonzero(hit) + width] -= 1
    return np.cumsum(cover)[:-1] > 0


def remove(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with the kept words, joined by one space, as their text; and n_words, n_removed (null text: empty).

    A column of the input that is called n_words or n_removed is replaced.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    cells = min(MAX_CELLS, max(MIN_CELLS, 1 << max(1, size - 1).bit_length()))
    keyed = _keyed(docs, id_col, text_col)
    path = repeated_cells(docs.select(F.col(text_col).alias("text")), width, cells)
    firsts = first_places(keyed, text_col, width, path, cells)
    joined = keyed.join(firsts, ["_keyloom_id", "_keyloom_tie"], "left")
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    joined = joined.select(*(joined[f"`{c}`"] for c in names), "_keyloom_firsts")
    text_at = names.index(text_col)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = Repeated.of(path, cells)
        for record in found:
            places = record.column(len(names))
            offsets, flat = places.offsets.to_numpy(), places.values.to_numpy()
            valid = places.is_valid().to_numpy(zero_copy_only=False)
            for a, b, batch in batches(record.column(text_at)):
                firsts = [flat[offsets[i] : offsets[i + 1]] if valid[i] else None for i in range(a, b)]
                gone = covered_words(batch, width, repeated, firsts)
                lost = np.diff(np.append(0, np.cumsum(gone))[batch.first_word])
                texts = []
                for i, text in enumerate(batch.texts):
                    words = text.split()
                    if lost[i]:
                        own = gone[batch.first_word[i] : batch.first_word[i + 1]]
                        words = [words[k] for k in np.flatnonzero(~own).tolist()]
                    texts.append(b" ".join(words))
                columns = [c.slice(a, b - a) for c in record.columns[:-1]]
                columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(batch.n_words), pa.array(lost)], [*names, "n_words", "n_removed"])

    schema = joined.select(*(joined[f"`{c}`"] for c in names), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed")).schema
    return in_batches(joined, run, schema)
