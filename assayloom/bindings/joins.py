"""Stores, dimensions, groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.bindings import query, table
from assayloom.functions.text import content_key
from assayloom.operators.lookup import (
    align_labels,
    cached_lookup,
    dim_join_default,
    group_members,
    uncached_keys,
)


def _english_store(spark, folder):
    """A store that knows the English texts: key and one value."""
    english = table(spark, folder, "documents").where("lang = 'en'")
    return english.groupBy(content_key(F.col("text")).alias("key")).agg(
        F.max("n_chars").alias("stored_chars")
    )


_STORE_SQL = """store AS (SELECT md5(text) AS key, max(n_chars) AS stored_chars
                          FROM documents WHERE lang = 'en' GROUP BY 1)"""


@query(
    "uncached_keys",
    f"""WITH {_STORE_SQL} SELECT DISTINCT md5(text) AS key, length(text) AS n_chars
        FROM documents WHERE md5(text) NOT IN (SELECT key FROM store)""",
)
def _uncached_keys(spark, folder):
    missing = uncached_keys(
        table(spark, folder, "documents"), "text", _english_store(spark, folder)
    )
    return missing.select("key", F.length("text").cast("bigint").alias("n_chars"))


@query(
    "cached_lookup",
    f"""WITH {_STORE_SQL} SELECT d.doc_id, s.stored_chars, s.key IS NOT NULL AS hit
        FROM documents d LEFT JOIN store s ON s.key = md5(d.text)""",
)
def _cached_lookup(spark, folder):
    found = cached_lookup(
        table(spark, folder, "documents").select("doc_id", "text"), "text",
        _english_store(spark, folder), spread_by=["doc_id"],
    )
    return found.select("doc_id", "stored_chars", F.col("stored_chars").isNotNull().alias("hit"))


@query(
    "cached_keys_only",
    f"""WITH {_STORE_SQL} SELECT d.doc_id FROM documents d
        WHERE md5(d.text) IN (SELECT key FROM store)""",
)
def _cached_keys_only(spark, folder):
    return cached_lookup(
        table(spark, folder, "documents").select("doc_id", "text"), "text",
        _english_store(spark, folder), spread_by=["doc_id"], keys_only=True,
    ).select("doc_id")


@query(
    "align_labels",
    """SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
)
def _align_labels(spark, folder):
    return align_labels(
        table(spark, folder, "documents").select("doc_id", "n_chars"),
        table(spark, folder, "labels").select("doc_id", "quality"), "doc_id",
    )


@query(
    "group_members",
    """WITH g AS (SELECT source, CASE WHEN md5(source || '|42') < '33333333' THEN 'test'
                                      ELSE 'train' END AS split
                  FROM documents GROUP BY source)
       SELECT d.doc_id, d.source, g.split FROM documents d JOIN g ON g.source = d.source""",
)
def _group_members(spark, folder):
    from assayloom.operators.split import holdout_hash

    documents = table(spark, folder, "documents").select("doc_id", "source")
    groups = holdout_hash(documents.select("source").distinct(), "source")
    return group_members(groups, documents, "source", spread_by=["doc_id"]).select(
        "doc_id", "source", "split"
    )


@query(
    "dim_join_default",
    """SELECT l.l_orderkey, l.l_linenumber, coalesce(s.s_name, 'none') AS supplier,
              coalesce(s.s_acctbal, 0.0) AS balance
       FROM lineitem l LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s
         ON s.s_suppkey = l.l_suppkey""",
)
def _dim_join_default(spark, folder):
    solvent = table(spark, folder, "supplier").where("s_acctbal > 0")
    return dim_join_default(
        table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"),
        solvent, ("l_suppkey", "s_suppkey"),
        {"supplier": ("s_name", F.lit("none")), "balance": ("s_acctbal", F.lit(0.0))},
    ).drop("l_suppkey")
