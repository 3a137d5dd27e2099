"""Operator 3: SimHash fingerprints and the groups of documents they link.

Fingerprints.  A-Z are lower-cased, words are runs outside white space, and each
run of ``shingle`` words (repeats included; all words if there are fewer) is
hashed by XXH64.  A bit of the fingerprint is set if it is set in over half the
hashes.  No word at all gives fingerprint zero.

Links.  Two fingerprints link if they differ in at most ``radius`` bits.  The
distinct fingerprints are searched with vantage-point trees in shards.  Their bits are cut
into ``radius + 1`` bands, of which two that link share one at least, so a fingerprint is
dealt, for each band, into the shard that a hash of its bits there names: ``radius + 1``
rows each, whatever the size of the table.  A shard with more than ``SPLIT`` rows, as of
fingerprints that share the bits of a band, is dealt into
blocks, and each pair of blocks is searched in a task, so no task grows with a shard.
There a tree splits the fingerprints (each side's border is sent across, one way, as one
direction finds each pair) until brute force is cheap.  All pairs
are found; a task hands on only a spanning forest of its links, so a dense group of
n fingerprints makes n rows for each of its blocks.
Components of the forests come from rounds of joins (:mod:`.components`).

Exact copies share a fingerprint and meet in a grouped count before the search,
so a group of copies of any size is one point.

Near copies by similarity.  At 64 bits, five-word shingle sets of Jaccard
similarity 0.8 differ in up to 14 bits, where the distances of unrelated
fingerprints (32 with deviation 4) leave triangle bounds nothing to prune.  So
``keep_one`` takes its links within ``radius`` from the trees, and those of
similarity 0.8 beyond it from min-wise bands, compared on the whole sets: first
each text with the least text of each of its buckets, then all pairs of texts that
share a bucket and are not yet connected, in groups of bounded size.

Defined results: null text and text without words link like any other
fingerprint zero; rows with a null doc_id get the component of their
fingerprint, which is null if no row of it has an id; repeated rows are kept;
an empty table gives no rows.  Other columns are kept by ``keep_one`` and
ignored by ``near_groups``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import cut, in_batches, written
from .textbatch import mixed, ranges, utf8

NULL_ID = -(1 << 63)
#: A shard takes about SHARD fingerprints, a leaf of its tree LEAF; a band has SHARDS shards at most.
SHARD, LEAF, SHARDS = 4_096, 256, 1 << 16
#: Rows that a block of a shard has at most (about); a task searches two.
SPLIT = 16_384
BANDS, ROWS = 24, 4
#: Texts, and hashes of their shingle sets, that a block of a group of candidates has at most (about).
BLOCK, BLOCK_HASHES = 1_024, 1 << 20


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of words, repeats included; of all words if there are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a : b - 1], 42) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Each bit is set if it is set in over half the hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


_ODD = mixed(np.arange(2 * BANDS * ROWS, dtype=np.uint64), 77) | np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS hashes, each of ROWS min-wise values: two sets of similarity s share one with probability 1 - (1 - s**ROWS)**BANDS."""
    if not len(hashes):
        return np.zeros(BANDS, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        some = hashes[at : at + 4096, None] * _ODD[: BANDS * ROWS] + _ODD[BANDS * ROWS :]
        np.minimum(least, some.min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys ^ column)
    return keys.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", bands: bool = False) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp (the fingerprint as a signed 64-bit integer), bands (keys, if asked for)."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for a, b in ranges(batch.column(1)):
                some = batch.slice(a, b - a)
                fps, keys = np.zeros(len(some), np.uint64), []
                for i, text in enumerate(utf8(some.column(1))):
                    hashes = shingle_hashes(text, shingle)
                    fps[i] = fingerprint(hashes)
                    keys.append(band_keys(hashes) if bands else [])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(fps.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "fp", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _text_key(text_col).alias("text_key"))
    return in_batches(rows, run, "doc_id long, text_key long, fp long, bands array<long>")


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def split_point(points: np.ndarray, radius: int, tries: int = 12) -> tuple[np.uint64, int] | None:
    """A vantage point and a distance that cut these points in two fair parts with few near the cut; None if nothing does."""
    best = None
    for vantage in points[np.linspace(0, len(points) - 1, tries).astype(int)]:
        counts = np.bincount(distance(points, vantage), minlength=66)
        inside = np.cumsum(counts)
        for cut_at in range(1, 65):
            share = inside[cut_at - 1] / len(points)
            if 0.25 <= share <= 0.75:
                border = counts[max(0, cut_at - radius) : cut_at].sum() / len(points) + abs(share - 0.5) / 4
                if best is None or border < best[0]:
                    best = border, vantage, cut_at
    return best and best[1:]


def build(points: np.ndarray, leaf: float, radius: int) -> list:
    """A tree as nested lists [vantage, distance, inner, outer]; a leaf is []."""
    found = split_point(points, radius) if len(points) > leaf else None
    if found is None:
        return []
    inside = distance(points, found[0]) < found[1]
    return [*found, build(points[inside], leaf, radius), build(points[~inside], leaf, radius)]


def dealt(tree: list, x: np.ndarray, radius: int, home: np.ndarray, guests: np.ndarray, first: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf its number, and which of x have it as home or are to be asked there."""
    if not len(home):
        return
    if not tree:
        yield first, home, guests
        return
    vantage, cut_at, inner, outer = tree
    d, g = distance(x[home], vantage), distance(x[guests], vantage).astype(int)
    across = home[(d < cut_at) & (d + radius >= cut_at)]
    yield from dealt(inner, x, radius, home[d < cut_at], guests[g - radius < cut_at], first)
    yield from dealt(outer, x, radius, home[d >= cut_at], np.concatenate([guests[g + radius >= cut_at], across]), first + leaves(inner))


def leaves(tree: list) -> int:
    return leaves(tree[2]) + leaves(tree[3]) if tree else 1


def forest(x: np.ndarray, homes: np.ndarray, guests: np.ndarray, radius: int) -> np.ndarray:
    """For each of x the least index it is linked to, over all links of homes with homes and guests."""
    root = np.arange(len(x))
    tree = build(x[homes], LEAF, radius)
    for _, own, asked in dealt(tree, x, radius, homes, guests):
        both = np.concatenate([own, asked])
        step = max(1, (1 << 22) // len(own))
        for at in range(0, len(both), step):
            some = both[at : at + step]
            i, j = np.nonzero(distance(x[some][:, None], x[own][None, :]) <= radius)
            a, b = some[i], own[j]
            a, b = a[a != b], b[a != b]
            while len(a):
                ra, rb = root[a], root[b]
                differ = ra != rb
                if not differ.any():
                    break
                a, b = a[differ], b[differ]
                np.minimum.at(root, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
                while (root[root] != root).any():
                    root = root[root]
    return root


def paired(rows: DataFrame, split: int) -> DataFrame:
    """The rows of each shard as tasks (shard, low, high) of two blocks at most, in which any two rows of a shard meet.

    A shard of up to ``split`` rows is one block and one task.  The counted shards are the leaves of the
    top tree, fewer than ``SAMPLE``, so they may be broadcast.
    """
    blocks = rows.groupBy("shard").agg(F.ceil(F.count("*") / split).cast("int").alias("blocks"))
    dealt_to = rows.join(F.broadcast(blocks), "shard").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(5)), "blocks").cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (x != F.col("own")) | (F.col("blocks") == 1))
    dealt_to = dealt_to.withColumn("other", F.explode(others))
    return dealt_to.select("shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "home")


def linked(points: DataFrame, radius: int, split: int = SPLIT) -> DataFrame:
    """Links (a, b) of distinct fingerprints (fp) whose components are those of all pairs within the radius."""
    shards = max(1, min(points.count() // SHARD, SHARDS))
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]

    def deal(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            x = batch.column(0).to_numpy().view(np.uint64)
            for band, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False) if shards > 1 else [(0, 64)]):
                bits = x >> np.uint64(low) & np.uint64((1 << (high - low)) - 1)
                shard = (mixed(bits, band) % np.uint64(shards)).astype(np.int64) + band * shards
                yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0), pa.array(np.ones(len(x), bool))], ["shard", "fp", "home"])

    def search(group: pa.Table) -> pa.Table:
        x, home = group.column("fp").to_numpy().view(np.uint64), group.column("home").to_numpy(zero_copy_only=False)
        root = forest(x, np.flatnonzero(home), np.flatnonzero(~home), radius)
        other = np.flatnonzero(root != np.arange(len(x)))
        return pa.table({"a": x[other].view(np.int64), "b": x[root[other]].view(np.int64)})

    rows = written(points.mapInArrow(deal, "shard long, fp long, home boolean"), "shards")
    return paired(rows, split).groupBy("shard", "low", "high").applyInArrow(search, "a long, b long")


def near_groups(docs: DataFrame, radius: int = 3, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) for each row."""
    rows = cut(fingerprints(docs, shingle, id_col, text_col).drop("bands"))
    points = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(linked(points.select("fp"), radius))
    member = points.join(roots, points.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = member.join(member.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return rows.join(named.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def banded(texts: DataFrame) -> DataFrame:
    """text_key and band for each bucket that a text is in."""
    return cut(texts.select("text_key", F.explode("bands").alias("band")).distinct())


def shingle_sets(docs: DataFrame, buckets: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """text_key, n, hashes (the shingle set) of the texts that share a bucket with another; of copies one comes to a task, so none grows with their number."""
    wanted = buckets.join(buckets.groupBy("band").count().where("count > 1"), "band", "left_semi").select("text_key").distinct()

    def sets(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for a, b in ranges(batch.column(1)):
                own = [np.unique(shingle_hashes(t, shingle)) for t in utf8(batch.column(1).slice(a, b - a))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["text_key", "n", "hashes"])

    single = docs.select(_text_key(text_col).alias("text_key"), F.col(text_col).alias("text")).dropDuplicates(["text_key"])
    return written(in_batches(single.join(wanted, "text_key", "left_semi"), sets, "text_key long, n long, hashes binary"), "shingles")


def similar(buckets: DataFrame, hashes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of text keys, of each text and the least text of each of its buckets, whose shingle sets have at least this Jaccard similarity."""
    least = buckets.groupBy("band").agg(F.min("text_key").alias("b"))
    pairs = cut(buckets.join(least, "band").where("text_key != b").select(F.col("text_key").alias("a"), "b").distinct())

    def compare(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = hashes.select("text_key", "hashes").toDF("a", "x"), hashes.select("text_key", "hashes").toDF("b", "y")
    return in_batches(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), compare, "a long, b long")


def joined_sets(sets: list[np.ndarray], root: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Indexes of pairs of left and right texts with this Jaccard similarity that connect what root leaves apart: a spanning forest of them."""
    size = np.array([len(x) for x in sets])
    flat, of = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), size)
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[number] > 1  # a hash of one text is in no intersection
    number, of = number[shared], of[shared]
    first = np.searchsorted(of, np.arange(len(sets) + 1))
    order = np.argsort(number, kind="stable")
    begin = np.searchsorted(number[order], np.arange(len(count) + 1))
    texts_of = of[order]
    root, is_right, links = np.unique(root, return_inverse=True)[1], np.zeros(len(sets), bool), []
    is_right[right] = True
    for i in left.tolist():
        if not (is_right & (root != root[i])).any():
            continue
        own = number[first[i] : first[i + 1]]
        long = begin[own + 1] - begin[own]
        at = np.arange(long.sum()) + np.repeat(begin[own] - np.cumsum(long) + long, long)
        both = np.bincount(texts_of[at], minlength=len(sets))
        for j in np.flatnonzero(is_right & (root != root[i]) & (both >= similarity * (size[i] + size - both))).tolist():
            if root[i] != root[j]:
                links.append((i, j))
                root[root == root[j]] = root[i]
    return links


def remaining(buckets: DataFrame, hashes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect, beyond roots, all texts that share a bucket and have this Jaccard similarity.

    Only buckets that roots leaves in several parts count.  Texts that such buckets connect make a
    group, or each bucket is one if they are too many for a block; a greater group is dealt into
    blocks, and each pair of blocks is compared in a task, so no task grows with the group.
    """
    tagged = buckets.join(roots, buckets.text_key == roots.node, "left").select("text_key", "band", F.coalesce("root", "text_key").alias("root"))
    parted = tagged.groupBy("band").agg(F.min("text_key").alias("least"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    rows = cut(tagged.join(parted.select("band", "least"), "band").join(hashes.select("text_key", "n"), "text_key"))
    near = components(rows.select(F.col("text_key").alias("a"), F.col("least").alias("b")))
    rows = rows.join(near.toDF("text_key", "cluster"), "text_key", "left").withColumn("cluster", F.coalesce("cluster", "text_key"))
    whole = rows.select("text_key", "root", "n", "cluster").distinct()
    fits = whole.groupBy("cluster").agg((F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_HASHES) <= 1).alias("fits"))
    rows = rows.join(fits, "cluster").select("text_key", "root", "n", F.when(F.col("fits"), F.struct(F.lit(0).alias("kind"), F.col("cluster").alias("key"))).otherwise(F.struct(F.lit(1).alias("kind"), F.col("band").alias("key"))).alias("unit")).distinct()
    rows = cut(rows)
    blocks = rows.groupBy("unit").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_HASHES)).cast("int").alias("blocks"))
    dealt_to = rows.join(blocks, "unit").withColumn("own", F.pmod(F.xxhash64("text_key", F.lit(5)), "blocks").cast("int"))
    dealt_to = dealt_to.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt_to = dealt_to.select("unit", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "text_key", "root")

    def search(group: pa.Table) -> pa.Table:
        key, own = group.column("text_key").to_numpy(), group.column("own").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("hashes")]
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        links = joined_sets(sets, group.column("root").to_numpy(), np.flatnonzero(own == low), np.flatnonzero(own == high), similarity)
        return pa.table({"a": pa.array([key[i] for i, _ in links], pa.int64()), "b": pa.array([key[j] for _, j in links], pa.int64())})

    return dealt_to.join(hashes.select("text_key", "hashes"), "text_key").groupBy("unit", "low", "high").applyInArrow(search, "a long, b long")


def keep_one(docs: DataFrame, radius: int = 3, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns, for one row of each group of near copies: that of the smallest doc_id, then of the least text hash.

    Texts are linked if their fingerprints are within the radius, or if their shingle sets have the
    similarity.  A row with a null doc_id stays only where its group has no id at all.
    """
    rows = cut(fingerprints(docs, shingle, id_col, text_col, bands=True))
    texts = rows.groupBy("text_key").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("least"), F.min("bands").alias("bands"))
    texts = cut(texts)
    points = texts.groupBy("fp").agg(F.min("text_key").alias("text_key"))
    near = linked(points.select("fp"), radius)
    near = near.join(points.toDF("a", "ka"), "a").join(points.toDF("b", "kb"), "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    same = texts.join(points.toDF("fp", "b"), "fp").where("text_key != b").select(F.col("text_key").alias("a"), "b")
    buckets = banded(texts)
    hashes = shingle_sets(docs, buckets, shingle, text_col)
    roots = components(near.union(same).union(similar(buckets, hashes, similarity)))
    roots = components(roots.toDF("a", "b").union(remaining(buckets, hashes, roots, similarity)))
    member = texts.join(roots, texts.text_key == roots.node, "left").select("text_key", "least", F.coalesce("root", "text_key").alias("root"))
    best = member.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "text_key")).alias("best"))
    best = best.select(F.coalesce("best.least", F.lit(NULL_ID)).alias("_keyloom_id"), F.col("best.text_key").alias("_keyloom_text"))
    keyed = docs.withColumns({"_keyloom_id": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), "_keyloom_text": _text_key(text_col)})
    kept = keyed.join(best, ["_keyloom_id", "_keyloom_text"], "left_semi")
    number = F.row_number().over(Window.partitionBy("_keyloom_id", "_keyloom_text").orderBy(F.lit(1)))
    return kept.withColumn("_keyloom_row", number).where("_keyloom_row = 1").select(*(kept[f"`{c}`"] for c in docs.columns))
