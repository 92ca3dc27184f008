import json

import pytest
from pyspark.sql import functions as F

from assayloom.operators.curate import curate
from assayloom.operators.featurise import FeatureSet
from assayloom.operators.split import kfold_hash, three_way_split
from assayloom.plans.scoring import batch_score, score_texts, score_with_saved
from assayloom.plans.training import (
    SEARCH_SPACES, cross_validate, draw_trials, feature_importance, param_search, run_report,
    train_regressor,
)
from assayloom.session import cut_lineage, shared_folder
from assayloom.sources.activity import (
    ACTIVITY_SCHEMA, activity_scan, list_explode, read_activities, text_line_scan, text_lines,
)
from assayloom.sources.models import load_model, save_model, vacuum_model
from assayloom.sources.output import as_json, read_predictions, save_json, save_predictions
from assayloom.sources.stores import load_or_refresh, read_curated, read_raw, save_raw


def test_text_lines_and_lists(spark, folder):
    with open(f"{folder}/in.txt", "w", encoding="utf-8", newline="") as f:
        f.write("  CCO \r\n\n 　\nCN(C)C\t\nlast")
    assert [r.value for r in text_lines(spark, f"{folder}/in.txt").collect()] == ["CCO", "CN(C)C", "last"]
    rows = spark.createDataFrame([(1, "a , b,,c"), (2, " x\n\ny ")], "id int, t string")
    assert [r.item for r in list_explode(rows.where("id = 1"), "t").collect()] == ["a", "b", "", "c"]
    assert [(r.line_no, r.value) for r in text_line_scan(rows.where("id = 2"), "t").collect()] == [
        (0, "x"), (2, "y")]


def test_activity_formats(spark, folder):
    rows = spark.createDataFrame(
        [("T1", "e1", "aa", "IC50", "nM", "100"), ("T2", "e2", "bb", "IC50", "nM", "10")], ACTIVITY_SCHEMA
    )
    for fmt, options in (("parquet", {}), ("json", {}), ("csv", {"header": "true"}), ("orc", {})):
        path = f"{folder}/{fmt}"
        rows.write.format(fmt).options(**options).save(path)
        got = activity_scan(read_activities(spark, path, fmt, **options), "T1").collect()
        assert [r.entity_id for r in got] == ["e1"]


def test_load_or_refresh(spark, folder):
    calls = []

    def fetch(target):
        calls.append(target)
        return spark.createDataFrame([("e1", f"{target}-a", 100.0 * len(calls))],
                                     "entity_id string, key_text string, standard_value double")

    path = f"{folder}/curated"
    assert read_curated(spark, path, "T1") is None
    first = load_or_refresh(spark, path, "T1", fetch, curate).first().p_value
    assert load_or_refresh(spark, path, "T1", fetch, curate).first().p_value == first
    load_or_refresh(spark, path, "T2", fetch, curate)
    assert calls == ["T1", "T2"]
    changed = load_or_refresh(spark, path, "T1", fetch, curate, force_refresh=True).first().p_value
    assert changed != first and calls == ["T1", "T2", "T1"]
    assert read_curated(spark, path, "T2").count() == 1
    plan = read_curated(spark, path, "T2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(target_id" in plan
    for target in ("T3", "T1"):  # nothing left: an error, and no old rows that look fresh
        with pytest.raises(ValueError, match="passed the curation"):
            load_or_refresh(
                spark, path, target, lambda t: fetch(t).limit(0), curate, force_refresh=True)
        assert read_curated(spark, path, target) is None
    assert read_curated(spark, path, "T2").count() == 1


def test_raw_snapshots_append(spark, folder):
    rows = spark.range(3)
    path = f"{folder}/raw"
    assert read_raw(spark, path, rows.schema) is None
    save_raw(rows, path)
    save_raw(rows, path)
    assert read_raw(spark, path, rows.schema).count() == 6


def test_prediction_csv_quotes_everything_needed(spark, folder):
    rows = spark.createDataFrame(
        [('a,"b"', 1.25, "success"), ("two\nlines", None, "failed"), ("plain", 3.0, "success")],
        "key_text string, predicted double, status string",
    )
    save_predictions(rows, f"{folder}/p")
    got = read_predictions(spark, f"{folder}/p")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    save_json(rows.select(F.struct("*").alias("r")), f"{folder}/j")
    assert spark.read.json(f"{folder}/j").select("r.*").count() == 3
    text = as_json(rows, ("status",)).where("status = 'failed'").first().json
    assert json.loads(text)["key_text"] == "two\nlines"


def lines(spark, n=600):
    rows = spark.range(n).select(
        "id", F.array(
            (F.col("id") % 17).cast("double"), ((F.col("id") * 7) % 13).cast("double"),
            ((F.col("id") % 17) * 2).cast("double"), F.lit(5.0),
        ).alias("features"),
    ).withColumn("y", F.lit(3.0) + 2 * F.col("features")[0] - 1.5 * F.col("features")[1])
    return three_way_split(rows, "id")


NAMES = ["a", "b", "double_a", "constant"]


def test_noiseless_line_is_found_and_survives_saving(spark, folder):
    rows = lines(spark)
    trained = train_regressor(rows, "features", "y", "linear", params={"regParam": 0.0}, names=NAMES)
    assert trained.metadata["removed_features"] == ["double_a"]
    assert trained.metadata["feature_names"] == ["a", "b", "constant"]
    scored = trained.score(rows)
    report = run_report(trained, scored, "y", "T1", "target one").first()
    assert set(report.metrics) == {"train", "val", "test"}
    assert all(m.r2 > 0.999 for m in report.metrics.values()) and report.n_features == 3
    path = f"{folder}/model"
    save_model(spark, trained.pipeline, trained.metadata, path)
    with_gap = rows.withColumn("features", F.when(F.col("id") != 3, F.col("features")))
    direct = {r.id: r for r in batch_score(trained, with_gap, "features").collect()}
    loaded = {r.id: r for r in score_with_saved(spark, path, with_gap, "features").collect()}
    assert direct[3].status == loaded[3].status == "failed" and loaded[3].predicted is None
    assert loaded[3].features is None and loaded[3].confidence is None
    assert all(abs(direct[i].predicted - loaded[i].predicted) < 1e-9 for i in loaded if i != 3)
    assert loaded[5].predicted == pytest.approx(loaded[5].y, abs=1e-6)


def test_overwritten_model_is_whole(spark, folder):
    rows = lines(spark, 100)
    for scale in (1.0, 3.0):
        made = rows.withColumn("y", F.col("y") * scale)
        trained = train_regressor(made, "features", "y", params={"regParam": 0.0}, names=NAMES)
        save_model(spark, trained.pipeline, trained.metadata, f"{folder}/twice")
        got = score_with_saved(spark, f"{folder}/twice", made, "features").first()
        assert got.predicted == pytest.approx(got.y, abs=1e-6)
    assert vacuum_model(spark, f"{folder}/twice") == 1
    assert score_with_saved(spark, f"{folder}/twice", made, "features").first() == got


def test_repeated_keys_do_not_multiply_rows(spark, folder):
    from assayloom.sources.stores import _append, _store, featurise_with_store, upsert_features

    small = FeatureSet(hash_bits=16, dictionary=(None, "o"), patterns=())
    rows = spark.createDataFrame([(1, "ab"), (2, "cd")], "id int, t string")
    upsert_features(rows, "t", f"{folder}/store", small)
    name, _ = _store(spark, f"{folder}/store")
    for _ in range(2):  # a retried append
        _append(spark, name, spark.table(name))
    assert spark.table(name).count() > 2
    assert featurise_with_store(rows, "t", "id", f"{folder}/store", small).count() == 2


def test_paths_are_cleaned_up(spark):
    from assayloom.session import clean_up, fresh_path, stored

    path = fresh_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert stored(spark.range(4), "table").count() == 4
    assert clean_up(spark) >= 2 and clean_up(spark) == 0


def test_load_errors(spark, folder):
    with pytest.raises(FileNotFoundError):
        load_model(spark, f"{folder}/none")
    spark.createDataFrame([('{"version": 1.0}',)], "value string").write.text(f"{folder}/bad/metadata")
    with pytest.raises(KeyError, match="timestamp"):
        load_model(spark, f"{folder}/bad")


def test_tree_presets_search_and_importance(spark):
    rows = lines(spark, 300).select("id", "split", "y", F.slice("features", 1, 2).alias("features"))
    boosted = train_regressor(rows, "features", "y", "gbt", params={"maxIter": 5}, threshold=None)
    assert boosted.score(rows).where("predicted is null").count() == 0
    best, trials, params = param_search(rows, "features", "y", "linear", n_trials=4)
    assert trials.count() == 4 and set(params) == set(SEARCH_SPACES["linear"])
    scores = [r.score for r in trials.orderBy("trial").collect()]
    assert all(s >= 0 for s in scores) and best.metadata["params"]["regParam"] == params["regParam"]
    assert trials.where("reason is not null").count() == 0
    bad = {"regParam": lambda u: F.lit(-1.0)}
    with pytest.raises(ValueError, match="every trial failed"):
        param_search(rows, "features", "y", "linear", n_trials=1, space=bad)
    some = {"regParam": lambda u: F.when(F.col("trial") == 0, -1.0).otherwise(u)}
    _, trials, _ = param_search(rows, "features", "y", "linear", n_trials=2, space=some)
    assert [r.reason is None for r in trials.orderBy("trial").collect()] == [False, True]
    top = feature_importance(rows, "features", "y", ["a", "b"], trees=10).orderBy("rank").collect()
    assert top[0].name == "a" and sum(r.importance for r in top) == pytest.approx(1.0)


def test_trials_are_reproducible_and_in_range(spark):
    draws = draw_trials(spark, SEARCH_SPACES["gbt"], 200).collect()
    assert draws == draw_trials(spark, SEARCH_SPACES["gbt"], 200).collect()
    assert {r.maxBins for r in draws} == {16, 32, 64} and {r.maxDepth for r in draws} == {2, 3, 4}
    assert all(0.01 <= r.stepSize <= 0.3 and 0.7 <= r.subsamplingRate <= 0.95 for r in draws)
    assert len({r.stepSize for r in draws}) == 200


def test_cross_validation_refits_scalers(spark):
    rows = kfold_hash(lines(spark, 200), "id", 3)
    assert cross_validate(rows, "features", "y", params={"regParam": 0.0}) > 0.999


def test_texts_to_scores(spark):
    small = FeatureSet(hash_bits=16, dictionary=(None, "o"), patterns=())
    texts = three_way_split(spark.range(120).select(
        "id", F.repeat(F.lit("ab "), (F.col("id") % 9 + 1).cast("int")).alias("t")), "id")
    from assayloom.operators.featurise import assemble_features

    made = assemble_features(texts, "t", small).withColumn("y", F.length("t").cast("double"))
    trained = train_regressor(made, "features", "y", "linear", names=small.names)
    more = spark.createDataFrame([(1, "ab ab ab "), (2, " "), (3, None)], "id int, t string")
    got = {r.id: (r.predicted, r.status) for r in score_texts(trained, more, "t", small).collect()}
    assert got[2] == got[3] == (None, "failed") and got[1][0] == pytest.approx(9.0, abs=0.3)


def test_shared_folder_is_kept(spark):
    folder = shared_folder(spark)
    assert folder == shared_folder(spark)
    assert cut_lineage(spark.range(5)).count() == 5


def test_end_to_end_run(spark, folder):
    """Activity rows to saved model, report and reference scores; a second run reuses stores."""
    from assayloom.plans.runs import reference_scores, train_target
    from assayloom.sources.activity import as_activities
    from assayloom.sources.stores import read_features

    base = spark.range(260).select(
        "id", F.concat(F.repeat(F.lit("CO "), (F.col("id") % 12 + 1).cast("int")), F.lit("x"),
                       F.col("id").cast("string")).alias("t"))
    raw = as_activities(
        base, F.lit("CHEMBL238"), F.col("id"), F.col("t"), F.pow(F.lit(10.0), F.col("id") % 12 % 5)
    ).withColumn("family", (F.col("entity_id") % 7).cast("string"))
    small = FeatureSet(hash_bits=16, dictionary=(None, "o"))
    trained, report = train_target(spark, raw, "CHEMBL238", f"{folder}/run", small)
    r = report.first()
    assert r.target_name == "DAT" and set(r.metrics) == {"train", "val", "test"}
    assert sum(m.n for m in r.metrics.values()) == 260 and r.metrics["test"].n == 52
    assert r.n_features == len(r.feature_names) == trained.metadata["input_dim"]
    assert read_features(spark, f"{folder}/run/features").count() == 260
    saved = load_model(spark, f"{folder}/run/models/DAT_CHEMBL238")
    assert saved.metadata["feature_set"] == small.version
    ids = spark.createDataFrame([("CHEMBL238",)], "target_id string")
    known = reference_scores(trained, ids, small).collect()
    assert len(known) == 3 and all(k.status == "success" for k in known)
    _, report = train_target(
        spark, raw, "CHEMBL238", f"{folder}/grouped", small, split_method="group", group="family",
        n_trials=2, resample=True,
    )
    assert report.first().searched and report.first().n_trials == 2


def test_store_moves_wanted_keys_not_vectors(spark, folder):
    from assayloom.operators.featurise import FeatureSet
    from assayloom.sources import stores

    path, fs = f"{folder}/store", FeatureSet(hash_bits=8, dictionary=(None, "o"), patterns=())
    rows = spark.range(900).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"), "id")
    assert stores.upsert_features(rows, "t", path, fs, buckets=6).count() == 900
    plans = []
    for n in (3, 500):
        keys = rows.where(F.col("id") < n).select(stores.content_key(F.col("t"), fs.version).alias("key"))
        found = stores.lookup_features(spark, path, keys)
        assert found.count() == n
        plans.append(found._jdf.queryExecution().executedPlan().toString())
    few, many = plans
    assert "Exchange" not in few and "out of 6" in few  # buckets that may hold a key
    # Many keys: what is exchanged holds no vectors.
    assert all("features" not in line for line in many.splitlines() if "Exchange" in line)
    # A repeated append counts once, and compaction drops it.
    name, _ = stores._store(spark, path)
    stores._append(spark, name, spark.table(name).where("substring(key, 1, 1) = 'a'"))
    assert stores.read_features(spark, path).count() == 900 < spark.table(name).count()
    before = {r.key: r.features for r in stores.read_features(spark, path).collect()}
    assert stores.compact_features(spark, path) > 0
    assert {r.key: r.features for r in stores.read_features(spark, path).collect()} == before
    assert stores.compact_features(spark, path, buckets=3) == 0
    assert {r.key: r.features for r in stores.read_features(spark, path).collect()} == before
    assert stores.vacuum_features(spark, path) == 2
    assert stores.read_features(spark, path).count() == 900
    stores.clear_features(spark, path)
    assert stores.read_features(spark, path).count() == 0


def test_importance_ranks_planted_weights(spark):
    import random

    from assayloom.plans.training import feature_importance

    rng, weights = random.Random(2), [0.0, 5.0, 0.0, 2.5, 0.0, 1.2]
    rows = []
    for _ in range(800):
        x = [rng.random() for _ in weights]
        rows.append((x, sum(w * v for w, v in zip(weights, x))))
    frame = spark.createDataFrame(rows, "v array<double>, y double")
    names = [f"f{i}" for i in range(6)]
    ranked = feature_importance(frame, "v", "y", names, k=6, trees=30, max_depth=8).orderBy("rank").collect()
    assert [r.name for r in ranked[:3]] == ["f1", "f3", "f5"] and [r.rank for r in ranked] == [1, 2, 3, 4, 5, 6]
    assert sum(r.importance for r in ranked) == pytest.approx(1.0)
    # Variance explained goes with the square of the weight.
    assert ranked[0].importance > 2.5 * ranked[1].importance > 2.5 * 2 * ranked[2].importance
