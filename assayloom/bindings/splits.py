"""Holdouts, folds and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.bindings import query, table
from assayloom.bindings.aggregates import BIN_SQL
from assayloom.bindings.common import line_key
from assayloom.operators.split import (
    conditional_resample,
    equal_width_bin,
    group_split,
    holdout_exact,
    holdout_hash,
    kfold,
    kfold_hash,
    split_check,
    three_way_split,
    three_way_split_exact,
    undersample_bins,
    union_samples,
)


def _lines(spark, folder):
    return table(spark, folder, "lineitem").select(line_key().alias("k"))


_KEYED_SQL = "keyed AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS k FROM lineitem)"
_RANKED_SQL = f"""{_KEYED_SQL}, ranked AS (SELECT k, row_number() OVER (ORDER BY md5(k || '|42')) AS r,
                                                  count(*) OVER () AS n FROM keyed)"""


@query(
    "holdout_hash",
    f"""WITH {_KEYED_SQL} SELECT k, CASE WHEN md5(k || '|42') < '33333333' THEN 'test' ELSE 'train' END
        AS split FROM keyed""",
)
def _holdout_hash(spark, folder):
    return holdout_hash(_lines(spark, folder), "k")


@query(
    "holdout_exact",
    f"""WITH {_RANKED_SQL} SELECT k, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END
        AS split FROM ranked""",
)
def _holdout_exact(spark, folder):
    return holdout_exact(_lines(spark, folder), "k")


@query(
    "three_way_split",
    f"""WITH {_KEYED_SQL} SELECT k, CASE WHEN md5(k || '|42') < '33333333' THEN 'test'
          WHEN md5(k || '|43') < '33333333' THEN 'val' ELSE 'train' END AS split FROM keyed""",
)
def _three_way_split(spark, folder):
    return three_way_split(_lines(spark, folder), "k")


@query(
    "three_way_split_exact",
    f"""WITH {_RANKED_SQL}, c AS (SELECT k, r, ceil(n * 0.2::DOUBLE) AS t,
             ceil((n - ceil(n * 0.2::DOUBLE)) * 0.2::DOUBLE) AS v FROM ranked)
        SELECT k, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'val' ELSE 'train' END AS split
        FROM c""",
)
def _three_way_split_exact(spark, folder):
    return three_way_split_exact(_lines(spark, folder), "k")


@query(
    "group_split",
    """WITH g AS (SELECT source, row_number() OVER (ORDER BY md5(source || '|42')) AS r,
                         count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
       SELECT d.doc_id, d.source,
              CASE WHEN g.r <= ceil(g.n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split
       FROM documents d JOIN g ON g.source = d.source""",
)
def _group_split(spark, folder):
    return group_split(table(spark, folder, "documents").select("doc_id", "source"), "source")


@query(
    "group_split_by_user",
    """WITH g AS (SELECT user_id, row_number() OVER (ORDER BY md5(user_id || '|42')) AS r,
                         count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))
       SELECT e.event_id, CASE WHEN g.r <= ceil(g.n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split
       FROM events e JOIN g ON g.user_id = e.user_id""",
)
def _group_split_by_user(spark, folder):
    rows = table(spark, folder, "events").select(
        "event_id", F.col("user_id").cast("string").alias("user")
    )
    return group_split(rows, "user").drop("user")


@query(
    "kfold",
    f"""WITH {_RANKED_SQL} SELECT k, CAST(CASE WHEN r - 1 < (n // 3 + 1) * (n % 3)
             THEN (r - 1) // (n // 3 + 1) ELSE (r - 1 - n % 3) // (n // 3) END AS INTEGER) AS fold
        FROM ranked""",
)
def _kfold(spark, folder):
    return kfold(_lines(spark, folder), "k", 3)


@query(
    "kfold_hash",
    f"""WITH {_KEYED_SQL} SELECT k, CAST(CAST('0x' || substr(md5(k || '|42'), 1, 8) AS BIGINT) % 3
             AS INTEGER) AS fold FROM keyed""",
)
def _kfold_hash(spark, folder):
    return kfold_hash(_lines(spark, folder), "k", 3)


@query(
    "equal_width_bin",
    f"WITH {BIN_SQL} SELECT event_id, bin FROM binned",
)
def _equal_width_bin(spark, folder):
    return equal_width_bin(table(spark, folder, "events"), "value").select("event_id", "bin")


_UNDER_SQL = f"""{BIN_SQL},
  r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(event_id || '|42')) AS rn,
               count(*) OVER (PARTITION BY bin) AS n FROM binned),
  kept AS (SELECT event_id, value, bin FROM r WHERE rn <= (SELECT min(n) FROM r))"""


@query("undersample_bins", f"WITH {_UNDER_SQL} SELECT event_id, value, bin FROM kept")
def _undersample_bins(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "value")
    return undersample_bins(rows, "value", "event_id")


_QTY_SQL = """lim AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
  b AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS k, l_quantity,
          CAST(least(greatest(ceil((l_quantity - lo) / ((hi - lo) / 10)) - 1, 0), 9) AS INTEGER) AS bin
        FROM lineitem, lim),
  r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(k || '|42')) AS rn,
               count(*) OVER (PARTITION BY bin) AS n FROM b)"""


@query(
    "undersample_quantities",
    f"WITH {_QTY_SQL} SELECT k, bin FROM r WHERE rn <= (SELECT min(n) FROM r)",
)
def _undersample_quantities(spark, folder):
    rows = table(spark, folder, "lineitem").select(line_key().alias("k"), "l_quantity")
    return undersample_bins(rows, "l_quantity", "k").select("k", "bin")


@query(
    "union_samples",
    "SELECT event_id, value FROM events",
)
def _union_samples(spark, folder):
    events = table(spark, folder, "events")
    return union_samples(*[
        events.where(F.col("event_type") == t).select("event_id", "value")
        for t in ("click", "view", "error", "signup", "purchase")
    ])


@query(
    "split_check",
    """SELECT count(*) AS n_rows, count(*) AS n_placed, CAST(0 AS BIGINT) AS n_straddling
       FROM documents""",
)
def _split_check(spark, folder):
    rows = group_split(table(spark, folder, "documents").select("doc_id", "source"), "source")
    return split_check(rows, "source")


@query(
    "conditional_resample",
    """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS k,
              CASE WHEN md5((l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey) || '|42') < '33333333'
                   THEN 'test' ELSE 'train' END AS split FROM lineitem""",
)
def _conditional_resample(spark, folder):
    """A random split passes the test, so all rows stay."""
    rows = table(spark, folder, "lineitem").select(line_key().alias("k"), "l_extendedprice")
    kept, _ = conditional_resample(holdout_hash(rows, "k"), "l_extendedprice", "k")
    return kept.select("k", "split")


_SKEWED_SQL = """s AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS k, l_quantity,
                      CASE WHEN l_quantity <= 10 THEN 'test' ELSE 'train' END AS split FROM lineitem),
  lim AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM s WHERE split = 'train'),
  b AS (SELECT k, CAST(least(greatest(ceil((l_quantity - lo) / ((hi - lo) / 10)) - 1, 0), 9) AS INTEGER)
          AS bin FROM s, lim WHERE split = 'train'),
  r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(k || '|42')) AS rn,
               count(*) OVER (PARTITION BY bin) AS n FROM b)"""


@query(
    "conditional_resample_skewed",
    f"""WITH {_SKEWED_SQL} SELECT k, 'train' AS split FROM r WHERE rn <= (SELECT min(n) FROM r)
        UNION ALL SELECT k, split FROM s WHERE split = 'test'""",
)
def _conditional_resample_skewed(spark, folder):
    """A split by quantity fails the test, so the train rows are undersampled."""
    rows = table(spark, folder, "lineitem").select(
        line_key().alias("k"), "l_quantity",
        F.when(F.col("l_quantity") <= 10, "test").otherwise("train").alias("split"),
    )
    kept, _ = conditional_resample(rows, "l_quantity", "k")
    return kept.select("k", "split")
