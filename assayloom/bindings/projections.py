"""Projections, filters and small transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.bindings import query, table
from assayloom.bindings.common import (
    CURATED_SQL,
    curated_events,
    event_activities,
    priced_lines,
)
from assayloom.functions.numeric import (
    binarise,
    coerce_double,
    default_on_error,
    finite_or_zero,
    format_fixed,
    neg_log10,
    rounded,
)
from assayloom.functions.text import bits_from_string, select_indices
from assayloom.operators.curate import (
    coerce_numeric,
    curate,
    derived_range,
    drop_nulls,
    keep_first,
    keep_valid,
    require_columns,
    stage_audit,
    value_range,
    with_neg_log,
)
from assayloom.operators.lookup import linear_score
from assayloom.operators.report import confidence_struct, score_status, with_residuals

# A text value that is missing for one event type and no number for another.
_MESSY_SQL = """CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' THEN props
                     WHEN event_type = 'view' THEN json_extract_string(props, '$.k')
                     ELSE CAST(value AS VARCHAR) END"""


def _messy_events(spark, folder):
    text = (
        F.when(F.col("event_type") == "signup", F.lit(None))
        .when(F.col("event_type") == "error", F.col("props"))
        .when(F.col("event_type") == "view", F.get_json_object("props", "$.k"))
        .otherwise(F.col("value").cast("string"))
    )
    return table(spark, folder, "events").select(
        F.col("event_id").alias("entity_id"), F.col("user_id").cast("string").alias("key_text"),
        text.alias("standard_value"),
    )


@query(
    "curate",
    f"""WITH {CURATED_SQL}
        SELECT target_id, entity_id, key_text, round(p_value, 6) + 0.0 AS p_value FROM curated""",
)
def _curate(spark, folder):
    return curated_events(spark, folder).withColumn("p_value", rounded(F.col("p_value")))


@query(
    "curate_older_variant",
    """SELECT event_id AS entity_id, CAST(user_id AS VARCHAR) AS key_text,
              round(-log10(value * 1e-9), 6) + 0.0 AS p_value
       FROM events WHERE value > 0 AND value < 1000000""",
)
def _curate_older(spark, folder):
    rows = curate(event_activities(spark, folder), bounds=None, dedup=False, valid=None)
    return rows.withColumn("p_value", rounded(F.col("p_value")))


@query("required_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _required_columns(spark, folder):
    return require_columns(
        table(spark, folder, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"]
    )


@query(
    "drop_nulls",
    """SELECT d.doc_id, l.quality, l.toxic FROM documents d
       LEFT JOIN labels l ON l.doc_id = d.doc_id
       WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL""",
)
def _drop_nulls(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id").join(
        table(spark, folder, "labels"), "doc_id", "left"
    )
    return drop_nulls(rows.select("doc_id", "quality", "toxic"))


@query(
    "coerce_numeric",
    f"""SELECT event_id AS entity_id, TRY_CAST({_MESSY_SQL} AS DOUBLE) AS standard_value
        FROM events WHERE TRY_CAST({_MESSY_SQL} AS DOUBLE) IS NOT NULL""",
)
def _coerce_numeric(spark, folder):
    return coerce_numeric(_messy_events(spark, folder), "standard_value").drop("key_text")


@query(
    "value_range",
    "SELECT event_id, value FROM events WHERE value > 0 AND value < 100",
)
def _value_range(spark, folder):
    return value_range(
        table(spark, folder, "events").select("event_id", "value"), "value", 0, 100
    )


@query(
    "neg_log10",
    """SELECT event_id,
              CASE WHEN value > 0 THEN round(-log10(value * 1e-9), 6) + 0.0 END AS p_value
       FROM events""",
)
def _neg_log10(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", rounded(neg_log10(F.col("value"))).alias("p_value")
    )


@query(
    "derived_range",
    """SELECT o_orderkey, round(-log10(o_totalprice * 1e-9), 6) + 0.0 AS p_value FROM orders
       WHERE o_totalprice > 0 AND -log10(o_totalprice * 1e-9) BETWEEN 3.5 AND 4.25""",
)
def _derived_range(spark, folder):
    rows = with_neg_log(table(spark, folder, "orders"), "o_totalprice")
    return derived_range(rows, "p_value", (3.5, 4.25)).select(
        "o_orderkey", rounded(F.col("p_value")).alias("p_value")
    )


@query(
    "dedup_keep_first",
    """SELECT doc_id, lang, md5(text) AS text_md5 FROM
         (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
       WHERE rn = 1""",
)
def _dedup_keep_first(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return keep_first(rows, ["text"], ["doc_id"]).select(
        "doc_id", "lang", F.md5("text").alias("text_md5")
    )


@query(
    "valid_rows",
    """SELECT doc_id, lang, n_chars FROM documents
       WHERE trim(text) <> '' AND regexp_matches(text, '[0-9]')""",
)
def _valid_rows(spark, folder):
    rows = keep_valid(
        table(spark, folder, "documents"),
        lambda t: (F.trim(t) != "") & t.rlike("[0-9]"), "text",
    )
    return rows.select("doc_id", "lang", "n_chars")


@query(
    "stage_audit",
    f"""WITH m AS (SELECT event_id, CAST(user_id AS VARCHAR) AS k, {_MESSY_SQL} AS raw,
                          TRY_CAST({_MESSY_SQL} AS DOUBLE) AS x FROM events),
        p AS (SELECT *, CASE WHEN x > 0 THEN -log10(x * 1e-9) END AS p FROM m),
        c AS (SELECT count(*) AS a0, count(raw) AS a1, count(x) AS a2,
                     count(*) FILTER (x > 0) AS a3,
                     count(*) FILTER (x > 0 AND x < 1000000) AS a4,
                     count(*) FILTER (x > 0 AND x < 1000000 AND p BETWEEN 0 AND 15) AS a5,
                     count(DISTINCT k) FILTER (x > 0 AND x < 1000000 AND p BETWEEN 0 AND 15) AS a6
              FROM p)
        SELECT 0 AS position, 'input' AS stage, a0 AS kept, CAST(0 AS BIGINT) AS removed FROM c
        UNION ALL SELECT 1, 'not_null', a1, a0 - a1 FROM c
        UNION ALL SELECT 2, 'numeric', a2, a1 - a2 FROM c
        UNION ALL SELECT 3, 'above_lower', a3, a2 - a3 FROM c
        UNION ALL SELECT 4, 'below_upper', a4, a3 - a4 FROM c
        UNION ALL SELECT 5, 'derived_range', a5, a4 - a5 FROM c
        UNION ALL SELECT 6, 'distinct_key', a6, a5 - a6 FROM c""",
)
def _stage_audit(spark, folder):
    return stage_audit(_messy_events(spark, folder))


@query(
    "finite_or_zero",
    """SELECT event_id, CASE WHEN event_type IN ('error', 'view', 'signup') THEN CAST(0 AS DOUBLE)
                             ELSE value END AS x FROM events""",
)
def _finite_or_zero(spark, folder):
    broken = (
        F.when(F.col("event_type") == "error", F.lit(float("nan")))
        .when(F.col("event_type") == "view", F.lit(float("-inf")))
        .when(F.col("event_type") != "signup", F.col("value"))
    )
    return table(spark, folder, "events").select("event_id", finite_or_zero(broken).alias("x"))


@query(
    "default_on_error",
    f"""SELECT event_id, coalesce(TRY_CAST({_MESSY_SQL} AS DOUBLE), 0) AS x FROM events""",
)
def _default_on_error(spark, folder):
    return _messy_events(spark, folder).select(
        F.col("entity_id").alias("event_id"),
        default_on_error(coerce_double(F.col("standard_value"))).alias("x"),
    )


@query(
    "select_indices",
    """SELECT vec_id, CAST(embedding[64] AS DOUBLE) AS a, CAST(embedding[1] AS DOUBLE) AS b,
              CAST(embedding[6] AS DOUBLE) AS c FROM embeddings""",
)
def _select_indices(spark, folder):
    rows = table(spark, folder, "embeddings").withColumn(
        "s", select_indices(F.col("embedding"), [63, 0, 5])
    )
    return rows.select(
        "vec_id", *[F.get("s", F.lit(i)).cast("double").alias(n) for i, n in enumerate("abc")]
    )


@query(
    "bits_from_string",
    """SELECT o_orderkey, list_sum(list_transform(string_split(bin(o_custkey), ''),
                lambda c: CAST(c AS BIGINT))) ::BIGINT AS ones,
              length(bin(o_custkey)) AS width FROM orders""",
)
def _bits_from_string(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", bits_from_string(F.bin("o_custkey")).alias("bits")
    )
    return rows.select(
        "o_orderkey",
        F.aggregate("bits", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("ones"),
        F.size("bits").cast("bigint").alias("width"),
    )


@query(
    "binarise",
    f"""WITH {CURATED_SQL} SELECT entity_id, CAST(p_value >= 7.0 AS INTEGER) AS active
        FROM curated""",
)
def _binarise(spark, folder):
    return curated_events(spark, folder).select(
        "entity_id", binarise(F.col("p_value")).alias("active")
    )


@query(
    "linear_score",
    """WITH c(target, logp, donors, acceptors, tpsa, weight, bias) AS (VALUES
         ('dat', 0.23::DOUBLE, -0.41::DOUBLE, -0.19::DOUBLE, -0.009::DOUBLE, -0.0007::DOUBLE, 7.15::DOUBLE),
         ('5ht2a', 0.12, -0.65, -0.33, -0.013, -0.0011, 7.60)),
       p AS (SELECT p_partkey, p_retailprice / 1000 AS x1, CAST(p_size % 5 AS DOUBLE) AS x2,
                    CAST(p_size % 7 AS DOUBLE) AS x3, CAST(p_size AS DOUBLE) AS x4,
                    p_retailprice / 10 AS x5,
                    CASE WHEN p_size <= 15 THEN 'DAT' WHEN p_size <= 30 THEN '5HT2a'
                         ELSE p_brand END AS t FROM part)
       SELECT p_partkey, round(coalesce(c.bias, 7.0) + coalesce(c.logp, 0.2) * x1
                + coalesce(c.donors, -0.5) * x2 + coalesce(c.acceptors, -0.3) * x3
                + coalesce(c.tpsa, -0.01) * x4 + coalesce(c.weight, -0.001) * x5, 6) + 0.0
              AS predicted
       FROM p LEFT JOIN c ON c.target = lower(p.t)""",
)
def _linear_score(spark, folder):
    size = F.col("p_size")
    parts = table(spark, folder, "part").select(
        "p_partkey",
        F.when(size <= 15, "DAT").when(size <= 30, "5HT2a").otherwise(F.col("p_brand")).alias("t"),
        (F.col("p_retailprice") / 1000).alias("x1"),
        (size % 5).cast("double").alias("x2"),
        (size % 7).cast("double").alias("x3"),
        size.cast("double").alias("x4"),
        (F.col("p_retailprice") / 10).alias("x5"),
    )
    terms = {"logp": "x1", "donors": "x2", "acceptors": "x3", "tpsa": "x4", "weight": "x5"}
    return linear_score(parts, "t", terms).select(
        "p_partkey", rounded(F.col("predicted")).alias("predicted")
    )


@query(
    "score_status",
    """SELECT event_id, CASE WHEN value > 0 THEN 'success' ELSE 'failed' END AS status
       FROM events""",
)
def _score_status(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", score_status(neg_log10(F.col("value"))).alias("status")
    )


@query(
    "confidence_struct",
    """SELECT l_orderkey, l_linenumber, p AS mean, CAST(0 AS DOUBLE) AS std, p AS min, p AS max
       FROM (SELECT l_orderkey, l_linenumber, l_quantity * 1500.0 AS p FROM lineitem)""",
)
def _confidence_struct(spark, folder):
    rows = priced_lines(spark, folder).withColumn("c", confidence_struct(F.col("predicted")))
    return rows.select("l_orderkey", "l_linenumber", "c.*")


@query(
    "residuals",
    """SELECT l_orderkey, l_linenumber,
              round(l_extendedprice - l_quantity * 1500.0, 2) + 0.0 AS residual FROM lineitem""",
)
def _residuals(spark, folder):
    rows = with_residuals(priced_lines(spark, folder), "y", "predicted")
    return rows.select(
        "l_orderkey", "l_linenumber", rounded(F.col("residual"), 2).alias("residual")
    )


@query(
    "format_number",
    """SELECT event_id, CASE WHEN value > 0 THEN printf('%.4f', -log10(value * 1e-9))
                             ELSE 'N/A' END AS shown FROM events""",
)
def _format_number(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", format_fixed(neg_log10(F.col("value"))).alias("shown")
    )
