"""Summaries, metrics, ordered statistics, rankings, history and plot tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.bindings import query, table
from assayloom.bindings.common import (
    CURATED_SQL,
    HISTORY_SQL,
    curated_events,
    event_history,
    line_key,
    priced_lines,
)
from assayloom.functions.numeric import neg_log10, rounded
from assayloom.operators.ordered import auc, ecdf, ks_two_sample, roc_curve
from assayloom.operators.report import (
    best_epoch,
    early_stop,
    kde_grid,
    learning_curve,
    rank_features,
    top_k,
)
from assayloom.operators.split import bin_counts, equal_width_bin, holdout_hash, kfold
from assayloom.operators.stats import (
    best_trial,
    correlation_columns,
    correlation_pairs,
    cv_mean,
    dataset_summary,
    distinct_keys,
    feature_long,
    feature_summary,
    group_sizes,
    mean_std_fit,
    prediction_summary,
    quantile_fit,
    regression_metrics,
    split_metrics,
    weighted_mean,
)


def _round_all(df, names, digits=6):
    return df.withColumns({n: rounded(F.col(n), digits) for n in names})


@query(
    "dataset_summary",
    f"""WITH {CURATED_SQL}
        SELECT target_id, count(*) AS n_samples, round(avg(p_value), 6) + 0.0 AS mean,
               round(stddev_samp(p_value), 6) + 0.0 AS std, round(min(p_value), 6) + 0.0 AS min,
               round(max(p_value), 6) + 0.0 AS max, count(DISTINCT key_text) AS unique_keys
        FROM curated GROUP BY target_id""",
)
def _dataset_summary(spark, folder):
    summary = dataset_summary(curated_events(spark, folder), "p_value", "key_text", ["target_id"])
    return _round_all(summary, ["mean", "std", "min", "max"])


_EMB_SQL = """long AS (SELECT vec_id, unnest(range(len(embedding))) AS pos,
                         CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


@query(
    "feature_summary",
    f"""WITH {_EMB_SQL} SELECT pos, count(*) AS n_samples, round(avg(x), 6) + 0.0 AS mean,
          round(stddev_pop(x), 6) + 0.0 AS std, min(x) AS min, max(x) AS max,
          (SELECT count(DISTINCT pos) FROM long) AS n_features FROM long GROUP BY pos""",
)
def _feature_summary(spark, folder):
    rows = feature_summary(table(spark, folder, "embeddings"), "embedding")
    return _round_all(rows, ["mean", "std"]).withColumn("pos", F.col("pos").cast("bigint"))


_METRICS_SQL = """count(*) AS n,
  round(sum((y - p) * (y - p)) / count(*), 2) + 0.0 AS mse,
  round(sqrt(sum((y - p) * (y - p)) / count(*)), 4) + 0.0 AS rmse,
  round(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 6) + 0.0 AS r2"""


def _metric_digits(rows):
    return rows.withColumns({
        "mse": rounded(F.col("mse"), 2), "rmse": rounded(F.col("rmse"), 4),
        "r2": rounded(F.col("r2")),
    })


@query(
    "regression_metrics",
    f"""SELECT {_METRICS_SQL} FROM
        (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem)""",
)
def _regression_metrics(spark, folder):
    return _metric_digits(regression_metrics(priced_lines(spark, folder), "y", "predicted"))


@query(
    "split_metrics",
    f"""SELECT split, {_METRICS_SQL}, 64 AS n_features FROM
        (SELECT CASE WHEN md5(vec_id || '|42') < '33333333' THEN 'test' ELSE 'train' END AS split,
                CAST(label AS DOUBLE) AS y, CAST(4.5 + embedding[1] AS DOUBLE) AS p FROM embeddings)
        GROUP BY split""",
)
def _split_metrics(spark, folder):
    rows = holdout_hash(table(spark, folder, "embeddings"), "vec_id").select(
        "split", "embedding", F.col("label").cast("double").alias("y"),
        (F.lit(4.5) + F.get("embedding", F.lit(0)).cast("double")).alias("p"),
    )
    return _metric_digits(split_metrics(rows, "y", "p", "embedding"))


@query(
    "prediction_summary",
    """SELECT count(p) AS successful, count(*) - count(p) AS failed,
              round(min(p), 6) + 0.0 AS min_predicted, round(max(p), 6) + 0.0 AS max_predicted
       FROM (SELECT CASE WHEN value > 0 THEN -log10(value * 1e-9) END AS p FROM events)""",
)
def _prediction_summary(spark, folder):
    rows = table(spark, folder, "events").select(neg_log10(F.col("value")).alias("p"))
    return _round_all(prediction_summary(rows, "p"), ["min_predicted", "max_predicted"])


BIN_SQL = """lim AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
binned AS (SELECT event_id, value,
             CAST(least(greatest(ceil((value - lo) / ((hi - lo) / 10)) - 1, 0), 9) AS INTEGER) AS bin
           FROM events, lim)"""


@query(
    "bin_counts",
    f"""WITH {BIN_SQL}, c AS (SELECT bin, count(*) AS n_rows FROM binned GROUP BY bin)
        SELECT bin, n_rows, (SELECT min(n_rows) FROM c) AS min_rows FROM c""",
)
def _bin_counts(spark, folder):
    return bin_counts(equal_width_bin(table(spark, folder, "events"), "value"))


@query(
    "correlation_pairs",
    f"""WITH {_EMB_SQL}
        SELECT a.pos AS i, b.pos AS j, round(abs(corr(a.x, b.x)), 6) + 0.0 AS abs_r
        FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.pos < b.pos GROUP BY a.pos, b.pos""",
)
def _correlation_pairs(spark, folder):
    pairs = correlation_pairs(table(spark, folder, "embeddings"), "embedding")
    return pairs.select(
        F.col("i").cast("bigint"), F.col("j").cast("bigint"), rounded(F.col("abs_r")).alias("abs_r")
    )


_PAIR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "correlation_columns",
    " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, round(abs(corr({_PAIR[i]}, {_PAIR[j]})), 6) + 0.0 AS abs_r "
        "FROM lineitem"
        for i in range(4) for j in range(i + 1, 4)
    ),
)
def _correlation_columns(spark, folder):
    pairs = correlation_columns(table(spark, folder, "lineitem"), _PAIR)
    return pairs.withColumn("abs_r", rounded(F.col("abs_r")))


@query("group_sizes", "SELECT source, count(*) AS n_members FROM documents GROUP BY source")
def _group_sizes(spark, folder):
    return group_sizes(table(spark, folder, "documents"), "source")


@query(
    "quantile_fit",
    """SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 4) + 0.0 AS q25,
              round(quantile_cont(l_extendedprice, 0.5), 4) + 0.0 AS q50,
              round(quantile_cont(l_extendedprice, 0.75), 4) + 0.0 AS q75
       FROM lineitem GROUP BY l_returnflag""",
)
def _quantile_fit(spark, folder):
    rows = quantile_fit(table(spark, folder, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return rows.select(
        "l_returnflag", "n",
        *[rounded(F.get("quantiles", F.lit(i)), 4).alias(n)
          for i, n in enumerate(("q25", "q50", "q75"))],
    )


@query(
    "feature_quantiles",
    f"""WITH {_EMB_SQL} SELECT pos, count(*) AS n, round(quantile_cont(x, 0.25), 6) + 0.0 AS q25,
              round(quantile_cont(x, 0.5), 6) + 0.0 AS q50,
              round(quantile_cont(x, 0.75), 6) + 0.0 AS q75 FROM long GROUP BY pos""",
)
def _feature_quantiles(spark, folder):
    rows = quantile_fit(feature_long(table(spark, folder, "embeddings"), "embedding"), "x", ["pos"])
    return rows.select(
        F.col("pos").cast("bigint"), "n",
        *[rounded(F.get("quantiles", F.lit(i))).alias(n)
          for i, n in enumerate(("q25", "q50", "q75"))],
    )


@query(
    "mean_std_fit",
    """SELECT count(*) AS n, round(avg(l_extendedprice), 4) + 0.0 AS mean,
              round(stddev_pop(l_extendedprice), 4) + 0.0 AS std FROM lineitem""",
)
def _mean_std_fit(spark, folder):
    rows = mean_std_fit(table(spark, folder, "lineitem"), "l_extendedprice")
    return _round_all(rows, ["mean", "std"], 4)


@query("weighted_mean", f"WITH {HISTORY_SQL} SELECT run, epoch, loss + 0.0 AS loss FROM history")
def _weighted_mean(spark, folder):
    return event_history(spark, folder)


@query(
    "weighted_mean_by_flag",
    """SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) + 0.0 AS loss
       FROM lineitem GROUP BY l_returnflag""",
)
def _weighted_mean_by_flag(spark, folder):
    rows = weighted_mean(
        table(spark, folder, "lineitem"), "l_discount", "l_quantity", ["l_returnflag"]
    )
    return _round_all(rows, ["loss"])


_FOLD_SQL = """lines AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS k, l_quantity AS x,
    l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5(k || '|42')) - 1 AS r,
                  count(*) OVER () AS n FROM lines),
folds AS (SELECT *, CAST(CASE WHEN r < (n // 3 + 1) * (n % 3) THEN r // (n // 3 + 1)
            ELSE (r - n % 3) // (n // 3) END AS INTEGER) AS fold FROM ranked)"""


def _folded_lines(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        line_key().alias("k"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * 1500.0).alias("p"),
    )
    return kfold(lines, "k", 3)


@query(
    "cv_mean",
    f"""WITH {_FOLD_SQL}, m AS (SELECT fold,
            1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) AS r2 FROM folds GROUP BY fold)
        SELECT count(*) AS n_folds, round(avg(r2), 6) + 0.0 AS mean_score FROM m""",
)
def _cv_mean(spark, folder):
    scores = regression_metrics(_folded_lines(spark, folder), "y", "p", ["fold"])
    return _round_all(cv_mean(scores), ["mean_score"])


# --- ordered statistics -------------------------------------------------------------

_HALVES_SQL = """halves AS (SELECT value, CASE WHEN md5(event_id || '|42') < '33333333'
                            THEN 'test' ELSE 'train' END AS split FROM events)"""
_ECDF_SQL = f"""{_HALVES_SQL},
  v AS (SELECT value, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b
        FROM halves GROUP BY value),
  f AS (SELECT value, a, b, CAST(sum(a) OVER w AS DOUBLE) / sum(a) OVER () AS cdf_a,
               CAST(sum(b) OVER w AS DOUBLE) / sum(b) OVER () AS cdf_b
        FROM v WINDOW w AS (ORDER BY value))"""
_HALVES = ("train", "test")


def _halves(spark, folder):
    return holdout_hash(table(spark, folder, "events").select("event_id", "value"), "event_id")


@query(
    "ecdf",
    f"""WITH {_ECDF_SQL} SELECT value, round(cdf_a, 9) + 0.0 AS cdf_a, round(cdf_b, 9) + 0.0 AS cdf_b,
           a AS n_a, b AS n_b FROM f""",
)
def _ecdf(spark, folder):
    return _round_all(ecdf(_halves(spark, folder), "value", "split", _HALVES), ["cdf_a", "cdf_b"], 9)


@query(
    "ks_two_sample",
    f"""WITH {_ECDF_SQL}, s AS (SELECT CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b,
                                       max(abs(cdf_a - cdf_b)) AS d FROM f),
        l AS (SELECT *, (sqrt(n_a::DOUBLE * n_b / (n_a + n_b)) + 0.12
                + 0.11 / sqrt(n_a::DOUBLE * n_b / (n_a + n_b))) * d AS lam FROM s),
        p AS (SELECT n_a, n_b, d, lam, list_sum(list_transform(range(1, 101), lambda j:
                 (CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END)::DOUBLE * exp(-2.0 * j * j * lam * lam)))
               AS p FROM l)
        SELECT n_a, n_b, round(d, 9) + 0.0 AS statistic,
               round(CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, p)) END, 6) + 0.0
                 AS p_value FROM p""",
)
def _ks_two_sample(spark, folder):
    # The asymptotic p-value at every size, as in the SQL; ks_exact has the exact one.
    rows = ks_two_sample(_halves(spark, folder), "value", "split", _HALVES, exact_steps=0)
    return rows.withColumns({
        "statistic": rounded(F.col("statistic"), 9), "p_value": rounded(F.col("p_value")),
    })


@query(
    "ks_exact",
    f"""WITH RECURSIVE v AS (SELECT s_acctbal AS x, s_nationkey < 9 AS g FROM supplier),
        c AS (SELECT x, sum(sum(g::INT)) OVER (ORDER BY x) AS a, sum(sum((NOT g)::INT)) OVER (ORDER BY x) AS b
              FROM v GROUP BY x),
        s AS (SELECT max(a)::BIGINT AS n_a, max(b)::BIGINT AS n_b,
                     (SELECT max(abs(a / (SELECT max(a) FROM c) - b / (SELECT max(b) FROM c))) FROM c) AS d FROM c),
        -- Row i of the lattice: share of the paths to (i, j) that stay inside the band, for every j.
        p AS (SELECT 0 AS i, (SELECT list(CASE WHEN j * n_a < round(d * n_a * n_b) THEN 1.0::DOUBLE ELSE 0 END
                                          ORDER BY j) FROM s, range(n_b + 1) r(j)) AS q
              UNION ALL
              SELECT i + 1, list_reduce(list_prepend([]::DOUBLE[], list_transform(range(n_b + 1), lambda j: [j::DOUBLE])),
                lambda made, cell: list_append(made, CASE WHEN abs((i + 1) * n_b - cell[1] * n_a) < round(d * n_a * n_b)
                  THEN (i + 1) / (i + 1 + cell[1]) * q[cell[1]::BIGINT + 1]
                       + CASE WHEN cell[1] > 0 THEN cell[1] / (i + 1 + cell[1]) * made[cell[1]::BIGINT] ELSE 0 END
                  ELSE 0 END))
              FROM p, s WHERE i < n_a)
        SELECT n_a, n_b, round(d, 9) + 0.0 AS statistic, round(1 - q[n_b + 1], 6) + 0.0 AS p_value
        FROM p, s WHERE i = n_a""",
)
def _ks_exact(spark, folder):
    """Account balances of suppliers of nine nations against the others: samples small enough
    for the exact p-value."""
    rows = table(spark, folder, "supplier").withColumn("g", F.col("s_nationkey") < 9)
    found = ks_two_sample(rows, "s_acctbal", "g", (True, False))
    return found.withColumns({
        "statistic": rounded(F.col("statistic"), 9), "p_value": rounded(F.col("p_value")),
    })


_ROC_SQL = """scored AS (SELECT d.n_chars AS s, l.quality AS y FROM documents d
                         JOIN labels l ON l.doc_id = d.doc_id),
  g AS (SELECT s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg
        FROM scored GROUP BY s),
  c AS (SELECT s, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
               sum(pos) OVER () AS np, sum(neg) OVER () AS nn
        FROM g WINDOW w AS (ORDER BY s DESC))"""


def _labelled(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "n_chars").join(
        table(spark, folder, "labels"), "doc_id"
    )


@query(
    "roc_curve",
    f"""WITH {_ROC_SQL} SELECT CAST(s AS DOUBLE) AS threshold, tp, fp,
          round(tp::DOUBLE / np, 9) + 0.0 AS tpr, round(fp::DOUBLE / nn, 9) + 0.0 AS fpr FROM c""",
)
def _roc_curve(spark, folder):
    return _round_all(roc_curve(_labelled(spark, folder), "n_chars", "quality"), ["tpr", "fpr"], 9)


@query(
    "auc_trapezoid",
    f"""WITH {_ROC_SQL} SELECT CAST(max(np) AS BIGINT) AS n_pos, CAST(max(nn) AS BIGINT) AS n_neg,
          round(sum(neg * (tp - pos / 2.0)) / (max(np)::DOUBLE * max(nn)), 9) + 0.0 AS auc FROM c""",
)
def _auc(spark, folder):
    return _round_all(auc(_labelled(spark, folder), "n_chars", "quality"), ["auc"], 9)


# --- trials, keys, rankings -----------------------------------------------------------


@query(
    "best_trial",
    """WITH t AS (SELECT l_suppkey AS trial, l_returnflag AS flag,
                         CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE round(avg(l_tax), 9) END AS score
                  FROM lineitem GROUP BY l_suppkey, l_returnflag),
       s AS (SELECT *, coalesce(score, 'infinity'::DOUBLE) AS f FROM t),
       r AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY f, trial) AS rn,
                    count(*) OVER (PARTITION BY flag) AS n FROM s)
       SELECT flag, trial AS best_params, f AS best_score, n AS n_trials FROM r WHERE rn = 1""",
)
def _best_trial(spark, folder):
    # Suppliers stand for trials; those whose number is divisible by 7 count as failed.
    trials = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("trial"), F.col("l_returnflag").alias("flag"))
        .agg(F.round(F.avg("l_tax"), 9).alias("score"))
        .withColumn("score", F.when(F.col("trial") % 7 != 0, F.col("score")))
    )
    return best_trial(trials, "trial", "score", by=["flag"])


@query("distinct_keys", "SELECT count(DISTINCT text) AS unique_keys FROM documents")
def _distinct_keys(spark, folder):
    return distinct_keys(table(spark, folder, "documents"), "text")


_IMPORTANCE_SQL = f"""{_EMB_SQL}, imp AS (SELECT 'dim_' || pos AS name,
    round(stddev_pop(x), 9) AS importance FROM long GROUP BY pos)"""


def _importance(spark, folder):
    """Spread of a position as a stand-in for its importance."""
    summary = feature_summary(table(spark, folder, "embeddings"), "embedding")
    return summary.select(
        F.format_string("dim_%d", "pos").alias("name"), F.round("std", 9).alias("importance")
    )


@query(
    "top_k",
    f"""WITH {_IMPORTANCE_SQL} SELECT name, importance + 0.0 AS importance,
          CAST(row_number() OVER (ORDER BY importance DESC, name) AS INTEGER) AS rank
        FROM imp QUALIFY rank <= 20""",
)
def _top_k(spark, folder):
    return top_k(_importance(spark, folder), "importance", "name", 20)


@query(
    "rank_features",
    f"""WITH {_IMPORTANCE_SQL} SELECT name, importance + 0.0 AS importance,
          CAST(row_number() OVER (ORDER BY importance DESC, name) AS INTEGER) AS rank FROM imp""",
)
def _rank_features(spark, folder):
    return rank_features(_importance(spark, folder), "importance", "name")


# --- training history -----------------------------------------------------------------


@query(
    "early_stop",
    f"""WITH {HISTORY_SQL},
        o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i,
                     min(loss) OVER (PARTITION BY run ORDER BY epoch
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM history),
        m AS (SELECT *, max(CASE WHEN b IS NULL OR loss < b THEN i END)
                OVER (PARTITION BY run ORDER BY i) AS last FROM o),
        s AS (SELECT *, min(CASE WHEN i - last >= 10 THEN i END) OVER (PARTITION BY run) AS stop FROM m)
        SELECT run, count(*) AS epochs_run, max(CASE WHEN i = stop THEN epoch END) AS stop_epoch,
               arg_min(epoch, (loss, epoch)) AS best_epoch, min(loss) + 0.0 AS best_loss
        FROM s WHERE stop IS NULL OR i <= stop GROUP BY run""",
)
def _early_stop(spark, folder):
    return early_stop(event_history(spark, folder), "run", "epoch", "loss")


@query(
    "best_epoch",
    f"""WITH {HISTORY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY loss, epoch) AS rn
                                  FROM history)
        SELECT run, epoch AS best_epoch, loss + 0.0 AS best_loss FROM r WHERE rn = 1""",
)
def _best_epoch(spark, folder):
    return best_epoch(event_history(spark, folder), "run", "epoch", "loss")


@query("learning_curve", f"WITH {HISTORY_SQL} SELECT run, epoch, loss + 0.0 AS loss FROM history")
def _learning_curve(spark, folder):
    return learning_curve(event_history(spark, folder), "run", "epoch", "loss")


# --- plot tables ------------------------------------------------------------------------


@query(
    "kde_grid",
    f"""WITH {_HALVES_SQL},
        sh AS (SELECT split, count(*) AS n, pow(count(*), -0.2) * stddev_samp(value) AS h,
                      min(value) AS lo, max(value) AS hi FROM halves GROUP BY split),
        w AS (SELECT split, value, count(*) AS w FROM halves GROUP BY split, value),
        g AS (SELECT split, n, h, unnest(range(200)) AS point,
                     lo - 3.0 * h AS a, hi + 3.0 * h AS b FROM sh),
        x AS (SELECT split, n, h, point, a + (b - a) * point / 199 AS x FROM g)
        SELECT x.split, CAST(x.point AS INTEGER) AS point, round(x.x, 6) + 0.0 AS x,
               round(sum(w.w * exp(-0.5 * ((x.x - w.value) / h) * ((x.x - w.value) / h)))
                     / (x.n * x.h * sqrt(2 * pi())), 9) + 0.0 AS density
        FROM x JOIN w ON w.split = x.split GROUP BY x.split, x.point, x.x, x.n, x.h""",
)
def _kde_grid(spark, folder):
    grid = kde_grid(_halves(spark, folder), "value", "split")
    return grid.withColumns({"x": rounded(F.col("x")), "density": rounded(F.col("density"), 9)})
