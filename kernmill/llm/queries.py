"""The queries of this subpackage, as the entry module registers them: each
applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, media, mixing, packing, pii, simhash, token_counts, token_store, toxicity, url_filter
from .common import shared_path, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = packing.measured(table(spark, sf_dir, "documents"))
    return packing.pack(items, blocks=packing.blocks_of(items))


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mixed(docs).select("doc_id", "source", "stream", "block", "place", "slot")


def op2_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store(table(spark, sf_dir, "documents")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return token_store.digest(token_store.read(spark, path))


def op6_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_toxicity_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op9_ann_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op3_pfair_mixing": op3_pfair_mixing,
    "op2_media_jpeg": op2_media_jpeg,
    "op4_token_counts": op4_token_counts,
    "op5_token_store": op5_token_store,
    "op6_pii_anchors": op6_pii_anchors,
    "op7_toxicity_viterbi": op7_toxicity_viterbi,
    "op8_url_rules": op8_url_rules,
    "op9_ann_kmeans_tree": op9_ann_kmeans_tree,
    "op10_simhash_components": op10_simhash_components,
}
ORACLE_SQL: dict[str, str] = {
    "op3_pfair_mixing": mixing.oracle(),
    "op8_url_rules": url_filter.oracle(),
}
