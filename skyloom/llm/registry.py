"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ball_kmeans, bpe, chat, heap_lloyd, line_dedup, media, near_dedup, packing, phrase_index, quality_crf, quality_rules, site_tree, warc
from .common import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.clean_documents(table(spark, sf_dir, "documents"), figures=figures)


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("source")


def op4_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return media.encode_media(table(spark, sf_dir, "documents"), columns=columns)


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = quality_crf.held_out()
    scored = quality_crf.classify(docs, quality_crf.train(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The bundles are written, read back and, as the query returns their figures alone, deleted.
    with Scratch(spark) as scratch:
        bundles = warc.write_bundles(table(spark, sf_dir, "pages"))
        return scratch.kept(warc.read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-report")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.Similarity(shingle=4))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, pattern, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.ball_kmeans(table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, seed=3, scale=1024, dim=64)


def op12_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_lloyd.heap_codes(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096, dim=64)


def op13_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


def queries() -> dict[str, Query]:
    return {
        "op1_role_repair": op1_role_repair,
        "op2_quality_rules": op2_quality_rules,
        "op3_mixture_packing": op3_mixture_packing,
        "op4_site_style_tree": op4_site_style_tree,
        "op5_media_columns": op5_media_columns,
        "op6_quality_crf": op6_quality_crf,
        "op7_line_dedup": op7_line_dedup,
        "op8_warc_bundles": op8_warc_bundles,
        "op9_minhash_near_dedup": op9_minhash_near_dedup,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_ball_kmeans": op11_ball_kmeans,
        "op12_heap_lloyd": op12_heap_lloyd,
        "op13_phrase_index": op13_phrase_index,
    }


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {
        "op2_quality_rules": oracles.quality_rules_sql(),
        "op7_line_dedup": oracles.line_dedup_sql(),
        "op8_warc_bundles": oracles.warc_sql(),
        "op9_minhash_near_dedup": oracles.near_dedup_sql(),
        "op11_ball_kmeans": oracles.ball_kmeans_sql(),
        "op12_heap_lloyd": oracles.heap_lloyd_sql(),
        "op13_phrase_index": oracles.phrase_index_sql(),
    }
