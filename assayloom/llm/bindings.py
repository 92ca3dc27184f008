"""The queries of this subpackage, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from assayloom.llm import (
    byte_bpe,
    conversations,
    exact_dedup,
    images,
    language,
    licenses,
    main_text,
    packing,
    quality,
    resampling,
    simhash,
    tiered_packing,
    urls,
)
from assayloom.llm.common import byte_ranks, byte_vocabulary, table, word_vocabulary
from assayloom.session import spread_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op7_exact_dedup", exact_dedup.ORACLE_SQL)
def op7_exact_dedup(spark, folder):
    return exact_dedup.duplicate_groups(table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


@query("op3_simhash")
def op3_simhash(spark, folder):
    return simhash.near_duplicate_classes(table(spark, folder, "documents"))


@query("op8_language")
def op8_language(spark, folder):
    docs = table(spark, folder, "documents")
    return language.predict_language(docs, language.train_language_model(docs))


@query("op9_quality")
def op9_quality(spark, folder):
    docs = table(spark, folder, "documents")
    model = quality.train_rule_model(docs, table(spark, folder, "labels"))
    return quality.score_quality(docs, model)


@query("op4_packing")
def op4_packing(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"), word_vocabulary())


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)


@query("op6_byte_bpe")
def op6_byte_bpe(spark, folder):
    return byte_bpe.round_trip_digests(table(spark, folder, "documents"), byte_ranks())


@query("op10_url_filter")
def op10_url_filter(spark, folder):
    return urls.judge_urls(table(spark, folder, "pages"), table(spark, folder, "labels"))


@query("op2_main_text")
def op2_main_text(spark, folder):
    return main_text.extract_main_text(table(spark, folder, "pages"))


@query("op5_licenses", licenses.ORACLE_SQL)
def op5_licenses(spark, folder):
    return licenses.scan_licenses(table(spark, folder, "documents"))


@query("op1_image_copies")
def op1_image_copies(spark, folder):
    vectors = spread_rows(table(spark, folder, "embeddings").select("vec_id", "embedding"), "vec_id")
    return images.image_classes(images.vector_pictures(vectors))


@query("op11_conversation_repair", conversations.ORACLE_SQL)
def op11_conversation_repair(spark, folder):
    told = table(spark, folder, "conversations")
    return conversations.repair_digests(conversations.damaged(told), told)


@query("op12_resampling", resampling.ORACLE_SQL)
def op12_resampling(spark, folder):
    return resampling.resample(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), "item_id"
    )


@query("op13_tiered_packing")
def op13_tiered_packing(spark, folder):
    return tiered_packing.pack_tiers(table(spark, folder, "documents"), byte_vocabulary())
