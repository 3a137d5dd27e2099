"""The queries of the operators of this subpackage, over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import languages, licenses, mixing, neighbours, packing, quality, simhash, substrings, tokens, toxicity
from .shared import new_folder, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
#: Target weights of the mixture: two sources by name, the others in proportion.
WEIGHTS, SEED = {"src0": 0.2, "src1": 0.1}, 17


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, TOKENIZER, END_ID)
    return tokens.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), radius=2, shingle=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, seed=SEED)


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    wanted = ["doc_id", *quality.FIGURES, "base_failed", "kept", "quality"]
    return quality.scored(docs, model, columns=["doc_id"]).select(*wanted)


def op6_window_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), width=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def _remainder(n: int, id_col: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string").cast("binary")) % n


def op7_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = languages.train(docs.where(_remainder(5) != 0))
    found = languages.predicted(docs.select("doc_id", "text"), model, columns=["doc_id"])
    return found.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op8_toxic_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), where=lambda doc_id: _remainder(3, doc_id) != 1)
    found = toxicity.scored(docs, model, columns=["doc_id"])
    return found.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", F.size("clauses").alias("n_clauses"))


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op10_license_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_inner_products,
        op3_simhash_groups,
        op4_poisson_mix,
        op5_quality_model,
        op6_window_removal,
        op7_language_spans,
        op8_toxic_clauses,
        op9_vector_packing,
        op10_license_spans,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_poisson_mix": f"""
        WITH s AS (SELECT source, count(*) AS n, CASE source WHEN 'src0' THEN {WEIGHTS['src0']} WHEN 'src1' THEN {WEIGHTS['src1']} END AS named FROM documents GROUP BY source),
        t AS (SELECT sum(n)::DOUBLE AS every, sum(n) FILTER (named IS NULL)::DOUBLE AS rest FROM s),
        r AS (SELECT source, every * coalesce(named, {1 - sum(WEIGHTS.values())} * n / rest) / n AS rate FROM s, t),
        p AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below
              FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) AS k FROM r)),
        u AS (SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
        c AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, (SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM u.source AND p.below <= u.u) AS n FROM u)
        SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n))::INTEGER AS copy FROM c WHERE n > 0
    """,
    "op6_window_removal": """
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        w AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS s, ws FROM d WHERE len(ws) >= 20),
        r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(ws[s:s + 19], ' ') ORDER BY doc_id, s) AS k FROM w),
        c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE k > 1),
        x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM x ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """,
}
