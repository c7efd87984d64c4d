"""One query for each training-data operator, over its whole table; `oracle` holds the SQL of those it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bit_sliced, byte_bpe, centroids, exact_packing, language, minhash, packing, periodic, pii, quality, sharding, token_files, warc
from .common import new_path, table
from .oracle import ORACLE as ORACLE


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_files.file_digest(spark, path)


def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(table(spark, sf_dir, "documents"))


def op4_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bit_sliced.quantised(table(spark, sf_dir, "embeddings"))
    return bit_sliced.top_k(rows, rows.filter("vec_id % 50 = 0"))


def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target, index = (new_path(spark, f"warc-{x}") for x in ("source", "members", "index"))
    warc.write_archives(table(spark, sf_dir, "pages"), source)
    warc.normalise(spark, source, target, index)
    return warc.read_records(spark, target, index)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_of(table(spark, sf_dir, "documents"))


def op9_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), 40)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, cuts=True)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.periodic_runs(table(spark, sf_dir, "documents"), rewritten=periodic.with_repeats))


def op12_drake_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centroids.quantised(table(spark, sf_dir, "embeddings"), 64)
    return centroids.with_digests(centroids.clustered(rows, k=40, rounds=5, dims=64))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files, op2_pii_boosting, op3_line_quality, op4_retrieval_packing, op5_bit_sliced_topk,
        op6_warc_normaliser, op7_minhash_dedup, op8_language_id, op9_stratified_sharding, op10_byte_bpe,
        op11_periodic_runs, op12_drake_clustering, op13_best_fit_packing,
    )
}
