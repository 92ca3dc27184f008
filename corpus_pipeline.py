"""From raw documents to packed token sequences, in stages that hand on Parquet tables.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``.

1. quality: documents that the rule ensemble scores below 0.3 go.
2. language: documents without a letter, or in no learned language with some certainty, go.
3. exact: of texts equal but for white space one stays.
4. near: of each SimHash component the document with the smallest doc_id stays.
5. pack: token sequences of at most 4,096 ids.

Defined cases, for every stage: null and empty texts are scored by 1, rejected by 2 (no letter), and
otherwise count as empty; a null doc_id is held out of training and takes part through its text; of
ties the smallest doc_id stays, and of rows equal in every respect one; rows that share a doc_id stay or
go together in 4 and on their own elsewhere; texts are read whole; extra columns pass through 1 to 4,
whatever their names; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayloom.llm import exact_dedup, language, packing, quality, simhash
from assayloom.llm.common import table, word_vocabulary
from assayloom.session import stored


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train_rule_model(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, language.train_language_model(docs))


def one_exact_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one_copy(docs)


def one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, word_vocabulary(), remembered=REMEMBERED_BYTES)


#: Bytes of known pieces that a Python worker of the pipeline keeps: the same workers serve all stages, and
#: what a stage leaves in them stays until they end.
REMEMBERED_BYTES = 24 << 20

STAGES = [
    ("quality", good_documents),
    ("language", known_languages),
    ("exact", one_exact_copy),
    ("near", one_near_copy),
    ("pack", packed),
]

#: Learned stages and the packing have no SQL form; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, applied to the ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
