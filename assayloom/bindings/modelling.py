"""Scaling, pruning, models, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.bindings import query, table
from assayloom.bindings.aggregates import _EMB_SQL, _FOLD_SQL, _folded_lines
from assayloom.bindings.common import line_key
from assayloom.bindings.texts import DOCUMENT_FEATURES
from assayloom.functions.numeric import rounded
from assayloom.operators.report import score_status
from assayloom.operators.scale import (
    CorrelationPrune,
    RobustScale,
    StandardScale,
    dropped_positions,
    kept_features,
    prune_columns,
)
from assayloom.operators.split import holdout_hash, kfold_hash, three_way_split
from assayloom.operators.stats import (
    correlation_pairs,
    grouped_linear_fit,
    linear_cross_validate,
    regression_metrics,
)
from assayloom.plans.network import NetworkSettings, train_network
from assayloom.plans.runs import train_target
from assayloom.plans.scoring import batch_score, score_with_saved
from assayloom.plans.training import (
    SEARCH_SPACES,
    choice,
    cross_validate,
    draw_trials,
    feature_importance,
    param_search,
    run_report,
    train_regressor,
)
from assayloom.session import constant_table, fresh_path, spread_rows
from assayloom.sources.activity import as_activities
from assayloom.sources.models import save_model
from assayloom.sources.output import save_json

NAMES = [f"dim_{i}" for i in range(64)]
_TRAIN_SQL = """train AS (SELECT vec_id, pos, x FROM long WHERE md5(vec_id || '|42') >= '33333333')"""


def _split_vectors(spark, folder):
    return holdout_hash(table(spark, folder, "embeddings"), "vec_id")


@query(
    "robust_scale",
    f"""WITH {_EMB_SQL}, {_TRAIN_SQL},
        q AS (SELECT pos, quantile_cont(x, 0.5) AS m,
                     quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS s FROM train GROUP BY pos)
        SELECT l.vec_id, l.pos, round((l.x - q.m) / CASE WHEN q.s = 0 THEN 1 ELSE q.s END, 6) + 0.0 AS x
        FROM long l JOIN q ON q.pos = l.pos""",
)
def _robust_scale(spark, folder):
    rows = _split_vectors(spark, folder)
    scaler = RobustScale.fit(rows.where("split = 'train'"), "embedding")
    scaled = scaler.transform(rows, "embedding", "scaled")
    return scaled.select("vec_id", F.posexplode("scaled").alias("pos", "x")).select(
        "vec_id", F.col("pos").cast("bigint"), rounded(F.col("x")).alias("x")
    )


@query(
    "standardise_target",
    """WITH t AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS k, l_extendedprice AS y FROM lineitem),
       f AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM t WHERE md5(k || '|42') >= '33333333')
       SELECT k, round((y - m) / s, 4) + 0.0 AS z, round(y, 2) + 0.0 AS restored FROM t, f""",
)
def _standardise_target(spark, folder):
    rows = holdout_hash(
        table(spark, folder, "lineitem").select(line_key().alias("k"), "l_extendedprice"), "k"
    )
    scale = StandardScale.fit(rows.where("split = 'train'"), "l_extendedprice")
    z = scale.scaled(F.col("l_extendedprice"))
    return rows.select(
        "k", rounded(z, 4).alias("z"), rounded(scale.restored(z), 2).alias("restored")
    )


_DROP_SQL = f"""{_EMB_SQL}, {_TRAIN_SQL},
  dropped AS (SELECT DISTINCT pos FROM (
     SELECT b.pos AS pos, corr(a.x, b.x) AS r FROM train a JOIN train b
       ON a.vec_id = b.vec_id AND a.pos < b.pos GROUP BY a.pos, b.pos)
     WHERE r IS NOT NULL AND NOT isnan(r) AND abs(r) > 0.1)"""


@query(
    "correlation_prune",
    f"""WITH {_DROP_SQL}
        SELECT p.pos, 'dim_' || p.pos AS name, p.pos NOT IN (SELECT pos FROM dropped) AS kept
        FROM (SELECT DISTINCT pos FROM long) p""",
)
def _correlation_prune(spark, folder):
    train = _split_vectors(spark, folder).where("split = 'train'")
    fitted = CorrelationPrune.fit(train, "embedding", NAMES, threshold=0.1)
    kept = set(fitted.kept)
    positions = range(len(fitted.names))
    return constant_table(spark, {
        "pos": ("bigint", list(positions)),
        "name": ("string", list(fitted.names)),
        "kept": ("boolean", [i in kept for i in positions]),
    })


@query(
    "pruned_vectors",
    f"""WITH {_DROP_SQL}
        SELECT vec_id, count(*) AS width, round(sum(x), 6) + 0.0 AS total FROM long
        WHERE pos NOT IN (SELECT pos FROM dropped) GROUP BY vec_id""",
)
def _pruned_vectors(spark, folder):
    rows = _split_vectors(spark, folder)
    fitted = CorrelationPrune.fit(rows.where("split = 'train'"), "embedding", NAMES, threshold=0.1)
    pruned = fitted.transform(rows, "embedding", "kept")
    return pruned.select(
        "vec_id", F.size("kept").cast("bigint").alias("width"),
        rounded(F.aggregate("kept", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("total"),
    )


@query(
    "kept_features",
    f"""WITH {_DROP_SQL} SELECT p.pos, 'dim_' || p.pos AS name
        FROM (SELECT DISTINCT pos FROM long) p WHERE p.pos NOT IN (SELECT pos FROM dropped)""",
)
def _kept_features(spark, folder):
    vectors = _split_vectors(spark, folder)
    pairs = correlation_pairs(vectors.where("split = 'train'"), "embedding")
    positions = vectors.select(F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("pos"))
    names = positions.distinct().withColumn("name", F.format_string("dim_%d", "pos"))
    kept = kept_features(names, dropped_positions(pairs, 0.1))
    return kept.select(F.col("pos").cast("bigint"), "name")


@query(
    "prune_columns",
    """WITH r AS (SELECT abs(corr(l_quantity, l_extendedprice)) > 0.5 AS k1,
                         abs(corr(l_quantity, l_discount)) > 0.5
                           OR abs(corr(l_extendedprice, l_discount)) > 0.5 AS k2,
                         abs(corr(l_quantity, l_tax)) > 0.5 OR abs(corr(l_extendedprice, l_tax)) > 0.5
                           OR abs(corr(l_discount, l_tax)) > 0.5 AS k3 FROM lineitem)
       SELECT 0 AS pos, 'l_quantity' AS name, true AS kept FROM r
       UNION ALL SELECT 1, 'l_extendedprice', NOT k1 FROM r
       UNION ALL SELECT 2, 'l_discount', NOT k2 FROM r
       UNION ALL SELECT 3, 'l_tax', NOT k3 FROM r""",
)
def _prune_columns(spark, folder):
    return prune_columns(
        table(spark, folder, "lineitem"),
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 0.5,
    )


@query(
    "grouped_linear_fit",
    """SELECT l_suppkey, regr_count(l_extendedprice, l_quantity)::BIGINT AS n,
              round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 AS slope,
              round(regr_intercept(l_extendedprice, l_quantity), 4) + 0.0 AS intercept,
              round(regr_r2(l_extendedprice, l_quantity), 6) + 0.0 AS r2
       FROM lineitem GROUP BY l_suppkey HAVING regr_sxx(l_extendedprice, l_quantity) > 0""",
)
def _grouped_linear_fit(spark, folder):
    fits = grouped_linear_fit(
        table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", ["l_suppkey"]
    )
    return fits.withColumns({
        "slope": rounded(F.col("slope"), 4), "intercept": rounded(F.col("intercept"), 4),
        "r2": rounded(F.col("r2")),
    })


@query(
    "cross_validate",
    f"""WITH {_FOLD_SQL},
        f AS (SELECT v.fold, regr_slope(t.y, t.x) AS b, regr_intercept(t.y, t.x) AS a
              FROM folds t JOIN (SELECT DISTINCT fold FROM folds) v ON t.fold <> v.fold GROUP BY v.fold)
        SELECT f.fold, count(*) AS n, round(min(b), 4) + 0.0 AS slope, round(min(a), 3) + 0.0 AS intercept,
               round(1 - sum((y - a - b * x) * (y - a - b * x)) / (count(*) * var_pop(y)), 6) + 0.0 AS r2
        FROM folds JOIN f ON f.fold = folds.fold GROUP BY f.fold""",
)
def _cross_validate(spark, folder):
    rows = linear_cross_validate(_folded_lines(spark, folder), "x", "y")
    return rows.withColumns({
        "slope": rounded(F.col("slope"), 4), "intercept": rounded(F.col("intercept"), 3),
        "r2": rounded(F.col("r2")),
    })


@query(
    "linear_batch_score",
    """WITH t AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS k, l_quantity AS x, l_extendedprice AS y
                  FROM lineitem),
       f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t
             WHERE md5(k || '|42') >= '33333333')
       SELECT k, CASE WHEN x > 5 THEN round(a + b * x, 3) + 0.0 END AS predicted,
              CASE WHEN x > 5 THEN 'success' ELSE 'failed' END AS status FROM t, f""",
)
def _linear_batch_score(spark, folder):
    """A line fitted on the train rows scores all rows; rows without a valid x fail."""
    rows = holdout_hash(
        table(spark, folder, "lineitem").select(line_key().alias("k"), "l_quantity", "l_extendedprice"),
        "k",
    )
    fit = rows.where("split = 'train'").agg(F.struct(
        F.regr_slope("l_extendedprice", "l_quantity").alias("b"),
        F.regr_intercept("l_extendedprice", "l_quantity").alias("a"),
    )).scalar()
    x = F.when(F.col("l_quantity") > 5, F.col("l_quantity"))
    scored = rows.withColumn("_fit", fit).withColumn("p", F.col("_fit.a") + F.col("_fit.b") * x)
    return scored.select(
        "k", rounded(F.col("p"), 3).alias("predicted"), score_status(F.col("p")).alias("status")
    )


# --- fitted models --------------------------------------------------------------------------
#
# Without a penalty the linear model is least squares, which SQL can follow feature by feature:
# each feature is freed of the ones before it on the train rows, and the prediction is the mean
# plus the sum of (coefficient * freed feature). Fits repeat per ``part`` (a fold, or just 0).

_LINE_NAMES = ["quantity", "discount", "tax", "line"]
_PLAIN = {"regParam": 0.0}
_KEYED = """lines AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS k,
    l_extendedprice AS y, l_quantity AS x1, l_discount AS x2, l_tax AS x3,
    CAST(l_linenumber AS DOUBLE) AS x4 FROM lineitem),
  marked AS (SELECT *, CASE WHEN md5(k || '|42') < '33333333' THEN 'test'
    WHEN md5(k || '|43') < '33333333' THEN 'val' ELSE 'train' END AS split FROM lines)"""


def _least_squares(source: str) -> str:
    """WITH items that end in ``fitted`` (k, part, y, p, fit, split); ``source`` has x1..x4, fit."""
    steps = [f"""z0 AS (SELECT s.*, m.my, x1 - m1 AS r1, x2 - m2 AS c2, x3 - m3 AS c3, x4 - m4 AS c4
      FROM ({source}) s JOIN (SELECT part, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3,
        avg(x4) AS m4 FROM ({source}) WHERE fit GROUP BY part) m USING (part))"""]
    for k in range(2, 5):
        sums = ", ".join(f"sum(c{k} * r{j}) / sum(r{j} * r{j}) AS b{j}" for j in range(1, k))
        freed = " - ".join([f"c{k}", *(f"b{j} * r{j}" for j in range(1, k))])
        steps.append(f"""z{k - 1} AS (SELECT z.*, {freed} AS r{k} FROM z{k - 2} z JOIN
          (SELECT part, {sums} FROM z{k - 2} WHERE fit GROUP BY part) USING (part))""")
    sums = ", ".join(f"sum((y - my) * r{j}) / sum(r{j} * r{j}) AS a{j}" for j in range(1, 5))
    total = " + ".join(["my", *(f"a{j} * r{j}" for j in range(1, 5))])
    steps.append(f"""fitted AS (SELECT z.*, {total} AS p FROM z3 z JOIN
      (SELECT part, {sums} FROM z3 WHERE fit GROUP BY part) USING (part))""")
    return ", ".join(steps)


_FITTED = f"""{_KEYED}, {_least_squares("SELECT *, 0 AS part, split = 'train' AS fit FROM marked")}"""


def _line_vectors(spark, folder):
    """Four numbers per order line; price is learned from the others."""
    rows = table(spark, folder, "lineitem").select(
        line_key().alias("k"), F.col("l_extendedprice").alias("y"),
        F.array("l_quantity", "l_discount", "l_tax", F.col("l_linenumber").cast("double")).alias(
            "features"
        ),
    )
    return three_way_split(spread_rows(rows, "k"), "k")


def _line_model(rows):
    return train_regressor(
        rows, "features", "y", "linear", params=_PLAIN, names=_LINE_NAMES
    )


@query(
    "feature_importance_top",
    f"""WITH {_EMB_SQL}, r AS (SELECT l.pos, abs(corr(l.x, e.embedding[8])) AS r FROM long l
          JOIN embeddings e ON e.vec_id = l.vec_id
          WHERE md5(l.vec_id || '|42') >= '33333333' GROUP BY l.pos)
        SELECT 'dim_' || arg_max(pos, r) AS name, CAST(1 AS INTEGER) AS rank FROM r""",
)
def _feature_importance_top(spark, folder):
    """The label is one of the positions, so the forest must rank that one first."""
    rows = _split_vectors(spark, folder).withColumn("y", F.col("embedding")[7].cast("double"))
    ranked = feature_importance(rows, "embedding", "y", NAMES, k=1, trees=20, split_col="split")
    return ranked.select("name", F.col("rank").cast("int"))


@query("feature_importance")
def _feature_importance(spark, folder):
    """The 20 most important of 64 positions for the label, from 100 trees."""
    ranked = feature_importance(
        _split_vectors(spark, folder), "embedding", "label", NAMES, split_col="split"
    )
    return ranked.select("name", "importance", F.col("rank").cast("int"))


@query(
    "train_regressor",
    f"WITH {_FITTED} SELECT k, split, y, round(p, 3) + 0.0 AS predicted FROM fitted",
)
def _train_regressor(spark, folder):
    rows = _line_vectors(spark, folder)
    return _line_model(rows).score(rows).select(
        "k", "split", "y", rounded(F.col("predicted"), 3).alias("predicted")
    )


_FOLD_FIT = f"""{_KEYED}, folded AS (SELECT *, CAST(CAST('0x' || substr(md5(k || '|42'), 1, 8) AS BIGINT) % 3
    AS INTEGER) AS fold FROM lines),
  {_least_squares("SELECT f.*, v.part, fold <> v.part AS fit FROM folded f CROSS JOIN (SELECT unnest(range(3)) AS part) v")},
  scores AS (SELECT part, 1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) AS r2 FROM fitted
             WHERE NOT fit GROUP BY part)"""


@query(
    "cross_validate_pipeline",
    f"""WITH {_FOLD_FIT} SELECT fold, count(*) AS n,
          round((SELECT avg(r2) FROM scores), 6) + 0.0 AS mean_r2 FROM folded GROUP BY fold""",
)
def _cross_validate_pipeline(spark, folder):
    rows = kfold_hash(_line_vectors(spark, folder), "k", 3)
    score = cross_validate(rows, "features", "y", params=_PLAIN)
    return rows.groupBy("fold").agg(F.count("*").alias("n")).withColumn(
        "mean_r2", F.round(F.lit(score), 6)
    )


def _draw_sql(name: str) -> str:
    return f"CAST('0x' || substr(md5(trial || '|{name}|42'), 1, 12) AS BIGINT) / {float(16 ** 12)}::DOUBLE"


_TRIALS_SQL = f"""SELECT trial, round(ln(1e-6::DOUBLE) + {_draw_sql('regParam')} * ln(1e5::DOUBLE), 6) AS log_penalty,
    round({_draw_sql('elasticNetParam')}, 9) + 0.0 AS elastic_net, true AS scored
  FROM (SELECT unnest(range(20)) AS trial)"""


def _trials(spark, folder, fold_col=None):
    rows = _line_vectors(spark, folder)
    if fold_col:
        rows = kfold_hash(rows, "k", 3)
    _, trials, best = param_search(
        rows, "features", "y", "linear", names=_LINE_NAMES, fold_col=fold_col
    )
    drawn = draw_trials(spark, SEARCH_SPACES["linear"], 20)
    assert set(best) == {"regParam", "elasticNetParam"}
    return drawn.join(trials, "trial").select(
        "trial", F.round(F.log("regParam"), 6).alias("log_penalty"),
        rounded(F.col("elasticNetParam"), 9).alias("elastic_net"),
        (F.abs("score") < F.lit(float("inf"))).alias("scored"),
    )


@query("param_search", _TRIALS_SQL)
def _param_search(spark, folder):
    """Drawn parameters of all 20 trials; each gets a score on the val rows."""
    return _trials(spark, folder)


@query("param_search_folds", _TRIALS_SQL)
def _param_search_folds(spark, folder):
    """The same trials, scored by their mean held-out r2 over three folds of the train rows."""
    return _trials(spark, folder, "fold")


@query(
    "param_search_scores",
    f"""WITH {_FITTED}, t AS (SELECT trial, floor({_draw_sql('regParam')} * 3) AS pick
          FROM (SELECT unnest(range(8)) AS trial)),
        e AS (SELECT sqrt(avg((y - p) * (y - p))) AS rmse FROM fitted WHERE split = 'val')
        SELECT trial, CASE pick WHEN 0 THEN 0.0 WHEN 1 THEN 0.1 ELSE 10.0 END::DOUBLE AS penalty,
          CASE WHEN pick = 0 THEN round((SELECT rmse FROM e), 3) + 0.0 END AS score FROM t""",
)
def _param_search_scores(spark, folder):
    """Scores of the trials without a penalty are those of plain least squares on the val rows."""
    rows = _line_vectors(spark, folder)
    space = {"regParam": choice(0.0, 0.1, 10.0)}
    _, trials, best = param_search(
        rows, "features", "y", "linear", n_trials=8, space=space, names=_LINE_NAMES, threshold=None
    )
    drawn = draw_trials(spark, space, 8).join(trials, "trial")
    assert best["regParam"] == drawn.agg(F.min_by("regParam", F.struct("score", "trial"))).first()[0]
    return drawn.select(
        "trial", F.col("regParam").alias("penalty"),
        F.when(F.col("regParam") == 0.0, rounded(F.col("score"), 3)).alias("score"),
    )


@query(
    "train_trees",
    f"""WITH {_KEYED}, s AS (SELECT CASE WHEN md5(k || '|42') < '33333333' THEN 'test'
          WHEN md5(k || '|43') < '33333333' THEN 'val' ELSE 'train' END AS split FROM lines)
        SELECT split, count(*) AS n, true AS learned FROM s GROUP BY split""",
)
def _train_trees(spark, folder):
    """Boosted trees with early stopping on the val rows; the label has steps that trees can follow, so
    every split must be explained to 97 %."""
    rows = _line_vectors(spark, folder).withColumn(
        "y", F.when(F.col("features")[0] > 25, 10.0).otherwise(0.0)
        + F.when(F.col("features")[1] > 0.05, F.col("features")[3]).otherwise(0.0))
    trained = train_regressor(rows, "features", "y", "gbt", names=_LINE_NAMES)
    return regression_metrics(trained.score(rows), "y", "predicted", ["split"]).select(
        "split", "n", (F.col("r2") > 0.97).alias("learned"))


@query(
    "train_network",
    f"""WITH {_KEYED}, s AS (SELECT CASE WHEN md5(k || '|42') < '33333333' THEN 'test'
          WHEN md5(k || '|43') < '33333333' THEN 'val' ELSE 'train' END AS split FROM lines)
        SELECT split, count(*) AS n, true AS learned FROM s GROUP BY split""",
)
def _train_network(spark, folder):
    """A product of two numbers per order line, learned without noise: every split must be explained
    to 99 %."""
    rows = _line_vectors(spark, folder).select(
        "k", "split", F.array(F.col("features")[0] / 25 - 1, F.col("features")[1] * 20 - 1).alias("x"),
        (F.col("features")[0] * (1 - F.col("features")[1])).alias("y"))
    settings = NetworkSettings(hidden=(32, 32), rate=0.05, epochs=12, batches=4, dropout=0.0, step_size=6)
    made = train_network(rows, "x", "y", "k", settings)
    scored = rows.withColumn("predicted", made.predict(F.col("x")))
    return regression_metrics(scored, "y", "predicted", ["split"]).select(
        "split", "n", (F.col("r2") > 0.99).alias("learned"))


@query(
    "batch_score",
    f"""WITH {_FITTED} SELECT k, CASE WHEN x1 > 5 THEN round(p, 3) + 0.0 END AS predicted,
          CASE WHEN x1 > 5 THEN 'success' ELSE 'failed' END AS status,
          CASE WHEN x1 > 5 THEN round(p, 3) + 0.0 END AS mean FROM fitted""",
)
def _batch_score(spark, folder):
    rows = _line_vectors(spark, folder)
    some_bad = rows.withColumn("features", F.when(F.col("features")[0] > 5, F.col("features")))
    return batch_score(_line_model(rows), some_bad, "features").select(
        "k", rounded(F.col("predicted"), 3).alias("predicted"), "status",
        rounded(F.col("confidence.mean"), 3).alias("mean"),
    )


@query(
    "model_save_load",
    f"WITH {_FITTED} SELECT k, round(p, 3) + 0.0 AS predicted, 'success' AS status FROM fitted",
)
def _model_save_load(spark, folder):
    rows = _line_vectors(spark, folder)
    trained, path = _line_model(rows), fresh_path(spark, "model")
    save_model(spark, trained.pipeline, trained.metadata, path)
    return score_with_saved(spark, path, rows, "features").select(
        "k", rounded(F.col("predicted"), 3).alias("predicted"), "status"
    )


@query(
    "run_report",
    f"""WITH {_FITTED} SELECT split, count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 3) + 0.0 AS rmse,
          round(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 6) + 0.0 AS r2,
          'linear' AS regressor, 4 AS n_features, 'quantity,discount,tax,line' AS names
        FROM fitted GROUP BY split""",
)
def _run_report(spark, folder):
    rows = _line_vectors(spark, folder)
    trained = _line_model(rows)
    report = run_report(trained, trained.score(rows), "y", "lines", "Order lines")
    path = fresh_path(spark, "report")
    save_json(report, path)
    return spark.read.schema(report.schema).json(path).select(
        F.explode("metrics").alias("split", "m"), "regressor", F.col("n_features").cast("int"),
        F.array_join("feature_names", ",").alias("names"),
    ).select(
        "split", "m.n", rounded(F.col("m.rmse"), 3).alias("rmse"), rounded(F.col("m.r2")).alias("r2"),
        "regressor", "n_features", "names",
    )


_TARGET_SQL = """en AS (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents
    WHERE lang = 'en' AND n_chars > 0 AND n_chars < 1000000 AND trim(text) <> ''),
  r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42')) AS r, count(*) OVER () AS n
        FROM en WHERE rn = 1),
  c AS (SELECT r, ceil(n * 0.2::DOUBLE) AS t, ceil((n - ceil(n * 0.2::DOUBLE)) * 0.2::DOUBLE) AS v FROM r),
  s AS (SELECT CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'val' ELSE 'train' END AS split FROM c)"""


@query(
    "train_target",
    f"WITH {_TARGET_SQL} SELECT 'en' AS target_id, split, count(*) AS n, true AS learned FROM s GROUP BY split",
)
def _train_target(spark, folder):
    """documents as activities: target = language, key = text, value = number of characters.

    The whole 1,208-wide feature set is pruned, scaled and fitted; the label follows from the
    text length, one of the features, so the train rows must be explained well.
    """
    activities = as_activities(
        table(spark, folder, "documents"), F.col("lang"), F.col("doc_id"), F.col("text"),
        F.col("n_chars"),
    )
    _, report = train_target(spark, activities, "en", fresh_path(spark, "run"), DOCUMENT_FEATURES)
    return report.select("target_id", F.explode("metrics").alias("split", "m")).select(
        "target_id", "split", "m.n",
        ((F.col("split") != "train") | (F.col("m.r2") > 0.5)).alias("learned"),
    )
