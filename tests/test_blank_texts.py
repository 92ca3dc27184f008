"""Queries over document vectors beside their SQL, on texts that are blank or missing."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import check_sql  # noqa: E402
from assayloom import bindings  # noqa: E402

BLANKS = ["", " ", "   ", " \n\t\r\f", "\n", "\v", " "]


def compared(spark, folder, name, texts):
    rows = [(i, t, ("en", "fr")[i % 2], "web") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1) \
        .write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    con = check_sql.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return check_sql.compare(spark, con, folder, name, bindings.QUERIES[name], bindings.ORACLES[name])


@pytest.mark.parametrize("name", [
    "feature_names", "assemble_features", "wide_features", "feature_store_lookup", "feature_store_clear",
])
def test_blank_texts_count_as_in_sql(spark, folder, name):
    line = compared(spark, folder, name, ["one, two 3", "One two.\n[x]", *BLANKS, "one, two 3"])
    assert line.startswith("ok"), line


def test_every_name_counts_documents_without_a_text(spark, folder):
    line = compared(spark, folder, "feature_names", ["one", None, "", " ", None])
    assert line.startswith("ok"), line
