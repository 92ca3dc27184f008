import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from assayloom.plans.moments import PENALTIES
from assayloom.plans.training import cross_validate, feature_pipeline, make_regressor, param_search


def lines(spark, n=900):
    x = [F.rand(1) * 50 + 1e6, F.rand(2), F.lit(3.0), F.rand(4) * 0.01]
    rows = spark.range(n).select("id", F.array(*x).alias("x"), (F.col("id") % 3).cast("int").alias("fold"),
                                 F.when(F.col("id") % 7 == 0, "val").otherwise("train").alias("split"))
    return rows.withColumn(
        "y", F.col("x")[0] * 2 - F.col("x")[1] * 30 + F.col("x")[3] * F.col("x")[1] * 900 + F.rand(5)).localCheckpoint()


@pytest.mark.parametrize("params", [
    {"regParam": 0.0}, {"regParam": 0.5}, {"regParam": 2.0, "elasticNetParam": 0.7},
    {"regParam": 0.3, "elasticNetParam": 1.0, "maxIter": 50}])
def test_scores_from_sums_are_those_of_fits_on_the_rows(spark, params):
    rows, evaluator = lines(spark), RegressionEvaluator(labelCol="y", predictionCol="_y_predicted", metricName="r2")
    assert set(params) <= PENALTIES
    scores = []
    for fold in range(3):
        model = Pipeline(stages=[
            *feature_pipeline("x", threshold=None), make_regressor("linear", params).setLabelCol("y"),
        ]).fit(rows.where(F.col("fold") != fold))
        scores.append(evaluator.evaluate(model.transform(rows.where(F.col("fold") == fold))))
    assert cross_validate(rows, "x", "y", params=params) == pytest.approx(sum(scores) / 3, abs=1e-6)


def test_a_search_over_folds_passes_once_over_the_rows(spark):
    rows, jobs = lines(spark), {}
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    watched = rows.mapInArrow(counted, rows.schema)
    for trials in (2, 6):
        before = seen.value
        _, table, best = param_search(watched, "x", "y", n_trials=trials, fold_col="fold")
        assert table.where("reason is null and score between 0.9 and 1").count() == trials
        jobs[trials] = seen.value - before
    assert jobs[2] == jobs[6]


def test_folds_without_sums_keep_the_general_path(spark):
    rows = lines(spark, 300)
    for kind, params in (("linear", {"fitIntercept": True, "regParam": 0.0}), ("forest", {"numTrees": 5})):
        assert 0.5 < cross_validate(rows, "x", "y", kind=kind, params=params) <= 1.0
    with pytest.raises(ValueError, match="two folds"):
        cross_validate(rows.where("fold = 1"), "x", "y")
    with pytest.raises(ValueError, match="finite"):
        cross_validate(rows.withColumn("y", F.lit(float("nan"))), "x", "y")


def test_linear_training_passes_its_rows_once_for_the_fit(spark):
    """Sums give the same label scale, pruning and model as Spark's own passes over the rows."""
    from assayloom.operators.scale import StandardScale
    from assayloom.plans.training import Y_SCALED, train_regressor

    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 5)) * [1, 10, 0.1, 3, 1] + [0, 100, 5, 0, 0]
    x[:, 3] = 2 * x[:, 0] + rng.normal(size=600) * 1e-3
    x[:, 4] = 7.0
    y = x @ [1, 0.5, -8, 0, 0] + rng.normal(size=600)
    made = spark.createDataFrame(
        [(i, [float(v) for v in a], float(b), "val" if i % 7 == 0 else "train")
         for i, (a, b) in enumerate(zip(x, y))], "k long, features array<double>, y double, split string")
    names = [f"f{i}" for i in range(5)]
    for params in ({"regParam": 0.0}, {"regParam": 0.05, "elasticNetParam": 0.4}):
        trained = train_regressor(made, "features", "y", "linear", params=params, names=names)
        train = made.where("split = 'train'")
        scale = StandardScale.fit(train, "y")
        plain = Pipeline(stages=[*feature_pipeline("features", names), make_regressor("linear", params)]).fit(
            train.withColumn(Y_SCALED, scale.scaled(F.col("y"))))
        assert trained.metadata["removed_features"] == ["f3"]
        assert trained.pipeline.stages[-1].numFeatures == 4
        assert np.isclose(trained.y_scale.std, scale.std) and np.isclose(trained.y_scale.mean, scale.mean)
        got = trained.pipeline.stages[-1].coefficients.toArray()
        assert np.allclose(got, plain.stages[-1].coefficients.toArray(), atol=1e-6)
        assert "ArrowEvalPython" not in trained.score(made)._jdf.queryExecution().executedPlan().toString()
        # The solver saw a few weighted rows, not the table.
        assert trained.pipeline.stages[-1].summary.numInstances < 20


def test_narrow_scaling_rejects_other_widths(spark):
    from assayloom.plans.stages import RobustModel

    model = RobustModel()._set(inputCol="v", outputCol="s", medians=[1.0, 2.0], divisors=[2.0, 4.0])
    got = model.transform(spark.createDataFrame([([3.0, 10.0],)], "v array<double>")).first()
    assert got["s"].toArray().tolist() == [1.0, 2.0]
    with pytest.raises(Exception, match="2 numbers"):
        model.transform(spark.createDataFrame([([1.0],)], "v array<double>")).collect()


def test_boosted_trees_see_a_repeated_row_once(spark):
    """Counted rows give the trees of the rows themselves."""
    from pyspark.ml import Pipeline

    from assayloom.operators.scale import StandardScale
    from assayloom.plans.training import Y_SCALED, train_regressor

    cells = [(float(a), float(b), float(a > 3) * 5 + a * b) for a in range(8) for b in range(6)]
    made = spark.createDataFrame(
        [([a, b], y, split) for a, b, y in cells for split, times in (("train", 20), ("val", 5))
         for _ in range(times + int(a))], "x array<double>, y double, split string").repartition(4).localCheckpoint()
    params = {"maxIter": 5, "maxDepth": 3}
    trained = train_regressor(made, "x", "y", "gbt", params=params)
    model = trained.pipeline.stages[-1]
    train = made.where("split <> 'test'").withColumn("_is_val", F.col("split") == "val")
    scale = StandardScale.fit(made.where("split = 'train'"), "y")
    regressor = make_regressor("gbt", {**model_params(params)}).setValidationIndicatorCol("_is_val")
    plain = Pipeline(stages=[*trained.pipeline.stages[:-1], regressor]).fit(
        train.withColumn(Y_SCALED, scale.scaled(F.col("y"))))
    assert model.getOrDefault("weightCol") == "_weight"
    both = trained.pipeline.transform(made.dropDuplicates(["x"])).select("x", F.col("_y_predicted").alias("p")).join(
        plain.transform(made.dropDuplicates(["x"])).select("x", "_y_predicted"), "x")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("_y_predicted")))).first()[0] < 1e-9


def model_params(params):
    from assayloom.plans.training import PRESETS

    return {**PRESETS["gbt"]["base"], **params}


def test_wide_vectors_are_scored_by_one_kernel(spark):
    """Pruning, scaling and the line of wide float vectors in one pass, equal to the stages of the pipeline."""
    from assayloom.plans.training import RAW_PREDICTION, train_regressor

    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, size=(300, 70)).astype(np.float32)
    x[:, 5] = 2 * x[:, 1]
    made = spark.createDataFrame(
        [(i, [float(v) for v in a], float(a[1] - a[9]), "val" if i % 7 == 0 else "train") for i, a in enumerate(x)],
        "k long, features array<float>, y double, split string")
    trained = train_regressor(made, "features", "y", "linear", names=[f"f{i}" for i in range(70)])
    assert trained.metadata["removed_features"] == ["f5"] and trained.metadata["input_dim"] == 69
    got = {r.k: r.predicted for r in trained.score(made).collect()}
    staged = trained.pipeline.transform(made).select("k", trained.y_scale.restored(F.col(RAW_PREDICTION)).alias("p"))
    want = {r.k: r.p for r in staged.collect()}
    assert len(got) == 300 and max(abs(got[k] - want[k]) for k in want) < 1e-9
    plan = trained.score(made)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "UDF(" not in plan
    empty = made.limit(3).withColumn("features", F.when(F.col("k") > 0, F.col("features")))
    assert trained.score(empty).where("predicted is null").count() == empty.where("features is null").count()
    with pytest.raises(Exception, match="reshape"):
        trained.score(made.withColumn("features", F.slice("features", 1, 9))).collect()


def test_a_weight_counts_a_row_several_times(spark):
    """Sums and ranks of weighted rows are those of the rows repeated."""
    from assayloom.operators.scale import RobustScale
    from assayloom.plans.moments import row_moments

    rng = np.random.default_rng(4)
    few = spark.createDataFrame(
        [([float(v) for v in a], float(a[0]), float(n)) for a, n in
         zip(rng.normal(size=(40, 3)).round(1), rng.integers(1, 9, 40))], "a array<double>, y double, w double")
    ragged = few.union(spark.createDataFrame([([1.0, float("nan"), 2.0], 1.0, 3.0), (None, 1.0, 2.0)], few.schema))
    for rows in (few, ragged):
        many = rows.select("a", "y", F.explode(F.array_repeat(F.lit(1.0), F.col("w").cast("int"))).alias("w"))
        one, other = RobustScale.fit(rows.repartition(3), "a", weight="w"), RobustScale.fit(many, "a")
        assert one == other
    many = few.select("a", "y", F.explode(F.array_repeat(F.lit(1.0), F.col("w").cast("int"))).alias("w"))
    one, other = row_moments(few, F.col("a"), "y", "w"), row_moments(many, F.col("a"), "y")
    assert one.n == other.n and np.allclose(one.mean, other.mean) and np.allclose(one.products, other.products)


def test_boosted_trees_prepare_from_counted_rows(spark, monkeypatch):
    """Label scale, pruning and ranks see the counted rows, not the table, and are those of the table."""
    from assayloom.operators.scale import RobustScale, StandardScale
    from assayloom.plans import training

    made = spark.range(4000).select(
        F.expr("array(id % 4 + 0.0D, id % 5 + 0.0D, 2 * (id % 4) + 1.0D)").alias("x"),
        F.expr("id % 4 + 0.5D * (id % 5)").alias("y"),
        F.expr("CASE WHEN id % 10 = 0 THEN 'test' WHEN id % 10 = 1 THEN 'val' ELSE 'train' END").alias("split"))
    seen, fit = [], RobustScale.fit.__func__
    monkeypatch.setattr(RobustScale, "fit", classmethod(
        lambda cls, df, *a, **k: (seen.append(df.count()), fit(cls, df, *a, **k))[1]))
    trained = training.train_regressor(made, "x", "y", "gbt", params={"maxIter": 2}, names=["a", "b", "c"])
    assert seen and max(seen) < 100
    train = made.where("split = 'train'")
    scale = StandardScale.fit(train, "y")
    plain = fit(RobustScale, train.select(F.slice("x", 1, 2).alias("x")), "x")
    stages = trained.pipeline.stages
    assert trained.metadata["removed_features"] == ["c"] and np.isclose(trained.y_scale.std, scale.std)
    assert stages[1].getOrDefault("medians") == list(plain.medians)
    assert stages[1].getOrDefault("divisors") == list(plain.divisors)


def test_unpruned_arrays_are_scored_without_a_detour(spark):
    from assayloom.plans.training import RAW_PREDICTION, train_regressor

    made = spark.range(400).select(
        F.expr("array(id % 4 + 0.0D, id % 5 + 0.0D)").alias("x"), F.expr("id % 4 + 0.5D * (id % 5)").alias("y"),
        F.expr("CASE WHEN id % 10 = 1 THEN 'val' ELSE 'train' END").alias("split"))
    trained = train_regressor(made, "x", "y", "gbt", params={"maxIter": 2})
    plan = trained.score(made)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF(") == 2  # the vector for the trees, and the trees
    both = trained.pipeline.transform(trained.score(made))
    away = F.abs(F.col("predicted") - trained.y_scale.restored(F.col(RAW_PREDICTION)))
    assert both.agg(F.max(away)).first()[0] < 1e-12
