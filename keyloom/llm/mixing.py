"""Operator 4: mixing sources to target weights by Poisson replication.

A source's rate is the mean number of copies that brings its share of the output
to its weight: ``total * weight / rows``.  Each row's number of copies is the
inverse of the Poisson distribution with that rate at a number in [0, 1) hashed
from the seed and the row's id, so it depends on nothing else: reruns, retries and
other partitionings give the same copies.  Rows are repeated by their count and
dealt over all partitions by a hash of id, copy and the partition that the row comes
from, sorted by the hash of id and copy inside each: a global shuffle in which a hot
source, a much repeated row, or rows that share an id are spread evenly.

Weights name sources; sources without a weight share what is left in proportion
to their rows.  The table of rates has a row for each source; it is broadcast
only where its counted bytes are at most ``MAX_BROADCAST``, else joined by shuffle.

Defined results: a null source is a source of its own, without a weight; rows with
equal (also null) ids get equal counts, so where many rows share an id the output may
be far from the target; a weight of an absent source is given to no one else (the
output is that much smaller); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Bytes of the table of rates.
MAX_BROADCAST = 8 << 20


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def distribution(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, ... until its rest is below any number that ``uniform`` can miss."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    zero = F.struct((-rate).alias("log_p"), F.array(F.exp(-rate)).alias("sums"))

    def step(s: Column, k: Column) -> Column:
        log_p = s["log_p"] + F.log(rate / k)
        return F.struct(log_p.alias("log_p"), F.array_append(s["sums"], F.element_at(s["sums"], -1) + F.exp(log_p)).alias("sums"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most), zero, step)["sums"]).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, weights: dict[str, float], total: int | None = None, source_col: str = "source") -> DataFrame:
    """source, rows, rate for each source, over all rows."""
    counted = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("rows"))
    named = F.lit(None).cast("double")
    for source, weight in weights.items():
        named = F.when(F.col("source") == source, F.lit(float(weight))).otherwise(named)
    counted = cut(counted.withColumn("named", named))
    every, rest = counted.agg(F.sum("rows"), F.sum(F.when(F.col("named").isNull(), F.col("rows")))).first()
    left = max(0.0, 1.0 - sum(weights.values()))
    weight = F.coalesce("named", F.lit(left) * F.col("rows") / F.lit(float(rest or 1)))
    return counted.select("source", "rows", (F.lit(float(total or every or 0)) * weight / F.col("rows")).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float], total: int | None = None, seed: int = 0, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The rows, repeated and globally shuffled, with ``copy`` (from 0; a column of that name is replaced)."""
    names = [c for c in docs.columns if c != "copy"]
    rated = rates(docs, weights, total, source_col)
    table = rated.select(F.col("source").alias("_keyloom_source"), distribution(F.col("rate")).alias("_keyloom_sums"))
    size = F.sum(8 * (F.col("rate") + 12 * F.sqrt("rate") + 40) + F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)))
    if (rated.agg(size).first()[0] or 0) <= MAX_BROADCAST:
        table = F.broadcast(table)
    rows = docs.join(table, docs[f"`{source_col}`"].eqNullSafe(F.col("_keyloom_source")))
    u = uniform(docs[f"`{id_col}`"], seed)
    n = F.size(F.filter("_keyloom_sums", lambda x: x <= F.col("_keyloom_u")))
    rows = rows.withColumn("_keyloom_u", u).withColumn("_keyloom_n", n).where("_keyloom_n > 0")
    rows = rows.select(*(docs[f"`{c}`"] for c in names), F.explode(F.sequence(F.lit(0), F.col("_keyloom_n") - 1)).alias("copy"))
    rows = rows.withColumn("_keyloom_key", F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), "copy"))
    rows = rows.withColumn("_keyloom_part", F.xxhash64("_keyloom_key", F.spark_partition_id()))
    return rows.repartition("_keyloom_part").sortWithinPartitions("_keyloom_key").drop("_keyloom_key", "_keyloom_part")
