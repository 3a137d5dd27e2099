"""Operator 2: largest inner products by score-aware quantisation and four-bit tables.

Fit.  A bounded sample gives, for each pair of dimensions, 16 centres (four bits).
The loss of a vector is weighted: the part of its residual along the vector, which
changes the largest inner products most, costs ``eta`` times the part across it.
Codes are chosen by coordinate descent over the pairs of dimensions and centres by
the weighted normal equations, in turn.

Index.  Every vector gets its codes, two to a byte, and a block.

Search.  Queries meet each block in cells of about ``BLOCK`` vectors and ``CHUNK``
queries.  A query's inner products with the centres are tables of 16; two make one
of 256 for a byte of codes, and the sum of lookups estimates all inner products of
the block.  The best of each block (``RERANK``, or one in ``RERANK_SHARE`` of a larger
block) are computed exactly, in double precision from the original vectors; where
others' estimates lie within the errors seen of the last of the best, as among
thousands of near copies, they are computed too.  The best of all blocks stay.

Every query meets every block, so what is shuffled is (queries x blocks + vectors x
chunks).  The sides of a cell grow with the tables, eightfold at most and within
``CELL_BYTES`` of doubles, and vectors of floats travel as floats.

Equal vectors are one point of the index with their least ids (one more than are
asked for), and equal queries are searched once, so a vector that holds a third of
all rows costs no more than another.

Defined results: vectors that are null, all zero, with null or non-finite
components, or of another length than most have, take no part, as queries or
candidates; nor do rows with a null id; repeated rows count once; ties go to the
smaller id; with fewer candidates than asked for all are returned; an empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, written

SAMPLE, BLOCK, CHUNK, RERANK, RERANK_SHARE = 8_192, 8_192, 4_096, 160, 51
#: What the vectors of one side of a cell take as doubles at most (about).
CELL_BYTES = 64 << 20
CENTRES, ROUNDS, THRESHOLD = 16, 8, 0.2


@dataclass
class Quantiser:
    centres: np.ndarray  # [pair, 16, 2]
    eta: float

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, 2 * len(self.centres) - x.shape[1])))

    def codes(self, x: np.ndarray, passes: int = 2, start: np.ndarray | None = None) -> np.ndarray:
        """The codes [vector, pair] that coordinate descent finds for the weighted loss."""
        x = self.padded(x.astype(np.float64))
        parts = x.reshape(len(x), -1, 2)
        unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(parts.shape)
        out = start
        if out is None:
            out = np.stack([((parts[:, m, None] - c) ** 2).sum(axis=2).argmin(axis=1) for m, c in enumerate(self.centres)], axis=1)
        along = sum(((parts[:, m] - c[out[:, m]]) * unit[:, m]).sum(axis=1) for m, c in enumerate(self.centres))
        for _ in range(passes):
            for m, c in enumerate(self.centres):
                rest = parts[:, m, None] - c
                own = (rest * unit[:, m, None]).sum(axis=2)
                others = along - own[np.arange(len(x)), out[:, m]]
                loss = (rest**2).sum(axis=2) + (self.eta - 1) * (others[:, None] + own) ** 2
                out[:, m] = loss.argmin(axis=1)
                along = others + own[np.arange(len(x)), out[:, m]]
        return out

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Two codes to a byte: [vector, half the pairs]."""
        c = self.codes(x).astype(np.uint8)
        if c.shape[1] % 2:
            c = np.pad(c, ((0, 0), (0, 1)))
        return c[:, ::2] | (c[:, 1::2] << 4)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """[query, byte of codes, 256]: sums of two tables of 16."""
        q = self.padded(q).reshape(len(q), -1, 2).astype(np.float32)
        small = np.einsum("qmd,mcd->qmc", q, self.centres.astype(np.float32))
        if small.shape[1] % 2:
            small = np.pad(small, ((0, 0), (0, 1), (0, 0)))
        return (small[:, 1::2, :, None] + small[:, ::2, None, :]).reshape(len(q), -1, 256)


def fit(sample: np.ndarray) -> Quantiser:
    dims = sample.shape[1]
    rng = np.random.default_rng(0)
    model = Quantiser(np.zeros(((dims + 1) // 2, CENTRES, 2)), max(1.0, (dims - 1) * THRESHOLD**2 / (1 - THRESHOLD**2)))
    x = model.padded(sample.astype(np.float64))
    parts = x.reshape(len(x), -1, 2)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(parts.shape)
    for m in range(len(model.centres)):  # ordinary k-means to begin with
        c = parts[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), m]
        for _ in range(ROUNDS):
            near = ((parts[:, m, None] - c) ** 2).sum(axis=2).argmin(axis=1)
            n = np.bincount(near, minlength=CENTRES)
            c = np.where(n[:, None] > 0, np.stack([np.bincount(near, parts[:, m, d], CENTRES) for d in (0, 1)], axis=1) / np.maximum(n, 1)[:, None], c)
        model.centres[m] = c
    codes = None
    for _ in range(3):  # then codes and centres in turn, for the weighted loss
        codes = model.codes(sample, 1, codes)
        along = sum(((parts[:, m] - c[codes[:, m]]) * unit[:, m]).sum(axis=1) for m, c in enumerate(model.centres))
        for m, c in enumerate(model.centres):
            u, p, k = unit[:, m], parts[:, m], codes[:, m]
            own = ((p - c[k]) * u).sum(axis=1)
            want = p + (model.eta - 1) * ((along - own) + (p * u).sum(axis=1))[:, None] * u
            left = np.zeros((CENTRES, 2, 2)) + 1e-9 * np.eye(2)
            right = np.zeros((CENTRES, 2)) + 1e-9 * c
            np.add.at(left, k, np.eye(2) + (model.eta - 1) * u[:, :, None] * u[:, None, :])
            np.add.at(right, k, want)
            model.centres[m] = np.linalg.solve(left, right[:, :, None])[:, :, 0]
            along += ((p - model.centres[m][k]) * u).sum(axis=1) - own
    return model


def cell_sides(points: int, asked: int, dims: int) -> tuple[int, int]:
    """About how many vectors and queries a cell has.

    Small tables are cut finely enough to keep many tasks busy, large ones coarsely,
    so that a vector is sent to fewer cells.
    """
    most = max(1, CELL_BYTES // (8 * max(1, dims)))
    return min(most, max(BLOCK, min(8 * BLOCK, points // 64))), min(most, max(CHUNK, min(8 * CHUNK, asked // 16)))


def _matrix(column: pa.ChunkedArray | pa.Array, kind=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def best_in_block(codes: np.ndarray, x: np.ndarray, ids: np.ndarray, q: np.ndarray, model: Quantiser, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of the block with the largest exact products among the estimated best, and those."""
    columns = [np.ascontiguousarray(codes[:, b]) for b in range(codes.shape[1])]
    first = max(RERANK, keep, len(x) // RERANK_SHARE)
    for at in range(0, len(q), 64):
        for query, table in zip(q[at : at + 64], model.tables(q[at : at + 64]), strict=True):
            some = np.arange(len(x))
            if len(x) > first:
                guess = table[0][columns[0]]
                for b in range(1, len(columns)):
                    guess += table[b][columns[b]]
                some = np.argpartition(guess, len(x) - first)[len(x) - first :]
            exact = x[some] @ query
            if len(x) > first:  # whatever may still be among the best, by the errors seen so far
                least = np.partition(exact, first - keep)[first - keep]
                more = np.flatnonzero(guess >= least - (exact - guess[some]).max())
                if len(more) > first:
                    some, exact = more, x[more] @ query
            order = np.lexsort((ids[some], -exact))[:keep]
            yield some[order], exact[order]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v of the rows that take part, once each; v has the components as they are, if floats, else as doubles."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["size"] if sizes else 0)).distinct()


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score; ``is_query`` tells by ``id`` which rows are queries."""
    rows = usable(vectors, id_col, vector_col)
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    least = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    points = written(least.groupBy("v").agg(F.min("id").alias("point"), F.sort_array(F.collect_list("id")).alias("ids")), "points")
    n = points.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not n:
        return vectors.sparkSession.createDataFrame([], out)
    sample = points.orderBy(F.xxhash64("point"), "point").limit(SAMPLE).select("v").toArrow()
    model = vectors.sparkSession.sparkContext.broadcast(fit(_matrix(sample.column("v"))))
    queries = rows.where(is_query).join(points.select("v", "point"), "v").select(F.col("id").alias("query_id"), "point")
    queries = cut(queries)
    n_asked = queries.select("point").distinct().count()
    block, chunk = cell_sides(n, n_asked, len(sample.column("v")[0]))
    blocks, chunks = -(-n // block), max(1, -(-n_asked // chunk))
    vector = points.schema["v"].dataType.simpleString()

    def encode(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            codes = model.value.packed(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["point", "v", "codes"])

    index = points.select("point", "v").mapInArrow(encode, f"point long, v {vector}, codes binary").withColumn("block", F.pmod(F.xxhash64("point"), F.lit(blocks)).cast("int"))
    asked = points.select("point", "v").join(queries.select("point").distinct(), "point", "left_semi")
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("point", F.lit(1)), F.lit(chunks)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))) if chunks > 1 else index.withColumn("chunk", F.lit(0))

    def scan(block: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query", "point", "score"]
        if not block.num_rows or not asked.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "point": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, x, q = block.column("point").to_numpy(), _matrix(block.column("v")), _matrix(asked.column("v"))
        codes = np.stack([np.frombuffer(c.as_buffer(), np.uint8) for c in block.column("codes")])
        at, score = zip(*best_in_block(codes, x, ids, q, model.value, k + 1), strict=True)
        query = np.repeat(asked.column("point").to_numpy(), [len(a) for a in at])
        return pa.table([query, ids[np.concatenate(at)], np.concatenate(score)], names)

    hits = cells.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(scan, "query long, point long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    members = hits.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    order = F.struct((-F.col("score")).alias("negative"), "vec_id")
    lists = members.groupBy("query").agg(F.sort_array(F.collect_list(order)).alias("found"))
    lists = lists.select("query", F.slice("found", 1, k + 1).alias("found"))
    joined = queries.join(lists, queries.point == lists.query)
    own = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    found = joined.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "hit"))
    return found.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.negative")).alias("score"))
