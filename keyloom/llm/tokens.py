"""Operator 1: token ids as flat binary files with 64-bit document offsets.

Format.  A folder holds, for each shard ``k``,

* ``k.ids``      the ids of the shard's documents, one after another, as unsigned
  little-endian integers (16 bits wide if the vocabulary allows, else 32);
* ``k.offsets``  ``n + 1`` unsigned 64-bit integers: where each document's ids
  begin in ``k.ids``, counted in ids, and the end;
* ``k.docs``     ``n`` signed 64-bit document ids;

and ``manifest.json``: id width, and for each shard its number of documents and
of ids and its base, the ids of all shards before it.  Shards are ranges of the
document order, so base plus offset is a document's place among all ids.

Documents are dealt into shards by range of (doc_id, hash of the text), so each
shard is sorted and so are the shards; one job writes them and returns one line
of counts for each shard, the prefix sums of those lines are the bases.  A
retried task writes the same bytes under a name of its own and renames the file.

Defined results: a null text is empty; a document without ids has its end id
alone; a null doc_id sorts first and is kept as the least 64-bit integer, which
reads back as null; repeated doc_ids are kept, in the order of their texts'
hashes; an empty table gives a manifest without shards.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import ENCODE_BYTES, Encoder
from .shared import filesystem, in_batches
from .textbatch import ranges, utf8

NULL_ID = -(1 << 63)
#: About so many bytes of ids are read, or handed to Spark, at once.
READ_BYTES = 4 << 20


def _put(system, path: str, name: str, parts: Iterator[bytes]) -> None:
    """Writes a file under a name of this task attempt, then gives it its own name."""
    attempt = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
    with system.open_output_stream(attempt) as out:
        for x in parts:
            out.write(x)
    system.move(attempt, f"{path}/{name}")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encodes every document into the files described above; returns the manifest.

    ``path`` is a new folder that the driver and all executors can write to.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), text.alias("text"))
    rows = rows.repartitionByRange("doc", F.xxhash64("text")).sortWithinPartitions("doc", F.xxhash64("text"))

    def shard(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, local = filesystem(path)
        encoder, k = Encoder.of(tokenizer, end_id), TaskContext.get().partitionId()
        ids, sizes = [], []

        def encoded() -> Iterator[bytes]:
            for batch in found:
                ids.append(batch.column(0).to_numpy())
                for a, b in ranges(batch.column(1), ENCODE_BYTES):
                    for x in encoder.encode(utf8(batch.column(1).slice(a, b - a))):
                        sizes.append(len(x))
                        yield x.tobytes()

        _put(system, local, f"{k}.ids", encoded())
        if not sizes:
            system.delete_file(f"{local}/{k}.ids")
            return
        offsets = np.zeros(len(sizes) + 1, "<u8")
        np.cumsum(sizes, out=offsets[1:])
        _put(system, local, f"{k}.offsets", iter([offsets.tobytes()]))
        _put(system, local, f"{k}.docs", iter([np.concatenate(ids).astype("<i8").tobytes()]))
        yield pa.RecordBatch.from_pydict({"shard": [k], "docs": [len(sizes)], "ids": [int(offsets[-1])], "width": [encoder.dtype.itemsize]})

    counts = sorted(in_batches(rows, shard, "shard long, docs long, ids long, width long").collect())  # a line for each partition
    base, shards = 0, []
    for k, n_docs, n_ids, _ in counts:
        shards.append({"shard": k, "docs": n_docs, "ids": n_ids, "base": base})
        base += n_ids
    manifest = {"width": max((x[3] for x in counts), default=4), "shards": shards}
    system, local = filesystem(path)
    with system.open_output_stream(f"{local}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(path: str) -> dict:
    system, local = filesystem(path)
    with system.open_input_stream(f"{local}/manifest.json") as f:
        return json.loads(f.read())


def mapped(path: str, name: str, kind: str, a: int, b: int) -> np.ndarray:
    """Numbers a to b of a file of the folder: memory-mapped where the file system is local, else read."""
    system, local = filesystem(f"{path}/{name}")
    if system.type_name == "local":
        return np.memmap(local, kind, "r")[a:b]
    size = np.dtype(kind).itemsize
    with system.open_input_file(local) as f:
        f.seek(a * size)
        return np.frombuffer(f.read((b - a) * size), kind)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as rows: doc_id, start (ids of all documents before), n_tokens, ids (unsigned 32-bit, little-endian); a task for each shard."""
    manifest = read_manifest(path)
    kind = f"<u{manifest['width']}"
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not manifest["shards"]:
        return spark.createDataFrame([], schema)
    shards = [(s["shard"], s["base"], s["docs"]) for s in manifest["shards"]]
    tasks = spark.createDataFrame(shards, "shard long, base long, docs long").repartition(len(shards))

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for shard, base, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                offsets, docs, a = mapped(path, f"{shard}.offsets", "<u8", 0, n + 1).astype(np.int64), mapped(path, f"{shard}.docs", "<i8", 0, n), 0
                while a < n:
                    end = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + READ_BYTES // 4, "right")) - 1))
                    at = offsets[a : end + 1]
                    values = pa.py_buffer(mapped(path, f"{shard}.ids", kind, int(at[0]), int(at[-1])).astype("<u4").tobytes())
                    ends = pa.py_buffer(((at - at[0]) * 4).astype("<i4").tobytes())
                    own = docs[a:end]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=own == NULL_ID), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.Array.from_buffers(pa.binary(), end - a, [None, ends, values])],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                    a = end

    return tasks.mapInArrow(read, schema)


def crc32_of(ids: Column) -> Column:
    return F.crc32(ids)
