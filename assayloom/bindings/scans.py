"""Sources and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.bindings import query, table
from assayloom.bindings.common import CURATED_SQL, curated_events, event_activities
from assayloom.functions.numeric import rounded
from assayloom.functions.text import WHITE
from assayloom.operators.curate import curate
from assayloom.operators.lookup import linear_score, reference_lookup, target_lookup
from assayloom.operators.report import score_status
from assayloom.session import fresh_path
from assayloom.sources.activity import activity_scan, list_explode, text_line_scan, text_lines
from assayloom.sources.output import read_predictions, save_json, save_predictions
from assayloom.sources.stores import load_or_refresh, read_curated, read_raw, save_curated, save_raw


@query(
    "activity_scan",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1""",
)
def _activity_scan(spark, folder):
    rows = activity_scan(
        table(spark, folder, "lineitem"), "R", "F", 1,
        columns=("l_returnflag", "l_linestatus", "l_linenumber"),
    )
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "curated_store_scan",
    f"""WITH {CURATED_SQL}
        SELECT target_id, entity_id, key_text, round(p_value, 6) + 0.0 AS p_value
        FROM curated WHERE target_id = 'purchase'""",
)
def _curated_store_scan(spark, folder):
    path = fresh_path(spark, "curated")
    save_curated(curated_events(spark, folder), path)
    return read_curated(spark, path, "purchase").select(
        F.col("target_id").cast("string"), "entity_id", "key_text",
        rounded(F.col("p_value")).alias("p_value"),
    )


@query(
    "raw_snapshot",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders""",
)
def _raw_snapshot(spark, folder):
    path = fresh_path(spark, "raw")
    raw = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )
    save_raw(raw, path)
    return read_raw(spark, path, raw.schema)


@query(
    "refresh_read",
    f"""WITH {CURATED_SQL}
        SELECT entity_id, key_text, round(p_value, 6) + 0.0 AS p_value
        FROM curated WHERE target_id = 'error'""",
)
def _refresh_read(spark, folder):
    path = fresh_path(spark, "refresh")
    activities = event_activities(spark, folder)
    rows = load_or_refresh(
        spark, path, "error",
        fetch=lambda t: activity_scan(activities, t),
        preprocess=curate,
    )
    return rows.select("entity_id", "key_text", rounded(F.col("p_value")).alias("p_value"))


@query(
    "text_line_scan",
    rf"""WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS a FROM documents),
         e AS (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS v FROM l),
         s AS (SELECT doc_id, line_no,
                      regexp_replace(v, '^{WHITE}+|{WHITE}+$', '', 'g') AS value FROM e)
         SELECT doc_id, line_no, md5(value) AS value_md5, length(value) AS n_chars
         FROM s WHERE value <> ''""",
)
def _text_line_scan(spark, folder):
    lines = text_line_scan(table(spark, folder, "documents"), "text", ("doc_id",))
    return lines.select(
        "doc_id", F.col("line_no").cast("bigint"), F.md5("value").alias("value_md5"),
        F.length("value").cast("bigint").alias("n_chars"),
    )


@query(
    "text_file_scan",
    rf"""WITH l AS (SELECT unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS v FROM documents),
         s AS (SELECT regexp_replace(v, '^{WHITE}+|{WHITE}+$', '', 'g') AS value FROM l)
         SELECT value, count(*) AS n_lines FROM s WHERE value <> '' GROUP BY value""",
)
def _text_file_scan(spark, folder):
    path = fresh_path(spark, "lines")
    table(spark, folder, "documents").select("text").write.text(path)
    return text_lines(spark, path).groupBy("value").agg(F.count("*").alias("n_lines"))


@query(
    "list_explode",
    rf"""WITH l AS (SELECT doc_id, string_split(text, ',') AS a FROM documents),
         e AS (SELECT doc_id, unnest(range(len(a))) AS item_no, unnest(a) AS v FROM l)
         SELECT doc_id, item_no, regexp_replace(v, '^{WHITE}+|{WHITE}+$', '', 'g') AS item FROM e""",
)
def _list_explode(spark, folder):
    items = list_explode(table(spark, folder, "documents"), "text", ("doc_id",))
    return items.select("doc_id", F.col("item_no").cast("bigint"), "item")


@query(
    "target_lookup",
    """SELECT c.c_custkey, coalesce(n.n_name, CAST(c.c_custkey AS VARCHAR)) AS target_name,
              coalesce(r.r_name, CAST(c.c_custkey AS VARCHAR)) AS target_description
       FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_custkey
       LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""",
)
def _target_lookup(spark, folder):
    # Customer numbers serve as target ids: only some of them are known targets.
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    targets = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("bigint").alias("target_id"),
        F.col("n_name").alias("name"), F.col("r_name").alias("description"),
    )
    customers = table(spark, folder, "customer").select("c_custkey")
    return target_lookup(customers, "c_custkey", targets)


@query(
    "reference_lookup",
    """SELECT n.n_nationkey AS target_id, s.s_name AS name, s.s_suppkey,
              round(s.s_acctbal * 0.5 + 7.0, 6) + 0.0 AS predicted
       FROM nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey""",
)
def _reference_lookup(spark, folder):
    targets = table(spark, folder, "nation").select(F.col("n_nationkey").alias("target_id"))
    references = table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("target_id"), F.col("s_name").alias("name"),
        "s_suppkey", "s_acctbal",
    )
    found = reference_lookup(targets, "target_id", references)
    return found.select(
        "target_id", "name", "s_suppkey",
        rounded(F.col("s_acctbal") * 0.5 + 7.0).alias("predicted"),
    )


def _scored_customers(spark, folder):
    scored = linear_score(
        table(spark, folder, "customer").select(
            F.col("c_name").alias("key_text"), F.col("c_mktsegment").alias("target"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 1000).alias("x"),
        ),
        "target", {"logp": "x"},
    )
    return scored.select(
        "key_text", rounded(F.col("predicted")).alias("predicted"),
        score_status(F.col("predicted")).alias("status"),
    )


_SCORED_SQL = """SELECT c_name AS key_text,
    CASE WHEN c_acctbal >= 0
         THEN round(CAST(7.0 AS DOUBLE) + CAST(0.2 AS DOUBLE) * (c_acctbal / 1000), 6) + 0.0
    END AS predicted,
    CASE WHEN c_acctbal >= 0 THEN 'success' ELSE 'failed' END AS status
  FROM customer"""


@query("prediction_csv", _SCORED_SQL)
def _prediction_csv(spark, folder):
    path = fresh_path(spark, "predictions")
    save_predictions(_scored_customers(spark, folder), path)
    return read_predictions(spark, path, multi_line=False)


@query("json_sink", _SCORED_SQL)
def _json_sink(spark, folder):
    path = fresh_path(spark, "json")
    rows = _scored_customers(spark, folder)
    save_json(rows.select(F.struct("*").alias("result")), path)
    stored = spark.read.schema("result struct<key_text:string,predicted:double,status:string>")
    return stored.json(path).select("result.*")
