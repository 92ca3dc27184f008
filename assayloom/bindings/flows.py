"""Operators chained as users chain them: files to predictions, reference scores, user features."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from assayloom.bindings import query, table
from assayloom.bindings.aggregates import BIN_SQL
from assayloom.bindings.common import line_key
from assayloom.functions.numeric import rounded
from assayloom.operators.featurise import DESCRIPTORS, FeatureSet, assemble_features
from assayloom.operators.lookup import linear_score
from assayloom.operators.report import ensemble_confidence, score_status
from assayloom.operators.split import holdout_hash, undersample_bins
from assayloom.operators.stats import prediction_summary
from assayloom.plans.runs import reference_scores
from assayloom.plans.training import train_regressor
from assayloom.session import fresh_path, spread_rows
from assayloom.settings import REFERENCE_ENTITIES
from assayloom.sources.activity import text_lines
from assayloom.sources.output import read_predictions, save_predictions


@query(
    "file_to_summary",
    """WITH p AS (SELECT CASE WHEN length(p_name) > 12 THEN 7.0 + 0.2 * length(p_name) END AS p FROM part)
       SELECT count(p) AS successful, count(*) - count(p) AS failed,
              round(CAST(min(p) AS DOUBLE), 6) + 0.0 AS min_predicted,
              round(CAST(max(p) AS DOUBLE), 6) + 0.0 AS max_predicted FROM p""",
)
def _file_to_summary(spark, folder):
    """A text file with one name per line, scored, written as CSV, read back and summed up."""
    lines, out = fresh_path(spark, "lines"), fresh_path(spark, "predictions")
    table(spark, folder, "part").select("p_name").write.text(lines)
    size = F.length("key_text").cast("double")
    rows = text_lines(spark, lines).select(F.col("value").alias("key_text")).select(
        "key_text", F.lit("unknown").alias("target"), F.when(size > 12, size).alias("size")
    )
    scored = linear_score(rows, "target", {"logp": "size"})
    save_predictions(
        scored.select("key_text", "predicted", score_status(F.col("predicted")).alias("status")), out
    )
    summary = prediction_summary(read_predictions(spark, out, multi_line=False), "predicted")
    return summary.withColumns({
        n: rounded(F.col(n)) for n in ("min_predicted", "max_predicted")
    })


_LENGTH_ONLY = FeatureSet(
    descriptors={"n_chars": DESCRIPTORS["n_chars"]}, hash_bits=8, dictionary=(), patterns=(),
    label="length",
)


@query(
    "reference_scores",
    "SELECT * FROM (VALUES " + ", ".join(
        f"('{t}', '{n}', CAST({len(k)} AS DOUBLE), 'success')" for t, n, k in REFERENCE_ENTITIES
    ) + ") r(target_id, name, predicted, status)",
)
def _reference_scores(spark, folder):
    """A model of the text length, learned on the documents, scores the reference entities."""
    rows = holdout_hash(
        assemble_features(
            spread_rows(table(spark, folder, "documents").select("doc_id", "text", "n_chars"), "doc_id"),
            "text", _LENGTH_ONLY,
        ), "doc_id",
    )
    trained = train_regressor(
        rows, "features", "n_chars", params={"regParam": 0.0}, names=_LENGTH_ONLY.names
    )
    targets = spark.createDataFrame(
        [(t,) for t in dict.fromkeys(t for t, _, _ in REFERENCE_ENTITIES)], "target_id string"
    )
    return reference_scores(trained, targets, _LENGTH_ONLY).select(
        "target_id", "name", rounded(F.col("predicted"), 2).alias("predicted"), "status"
    )


@query(
    "ensemble_confidence",
    """WITH p AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS k,
                         l_quantity * r AS p FROM lineitem, (SELECT unnest([1400.0, 1500.0, 1700.0]) AS r))
       SELECT k, round(avg(p), 4) + 0.0 AS mean, round(stddev_pop(p), 4) + 0.0 AS std,
              round(CAST(min(p) AS DOUBLE), 4) + 0.0 AS min, round(CAST(max(p) AS DOUBLE), 4) + 0.0 AS max
       FROM p GROUP BY k""",
)
def _ensemble_confidence(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        line_key().alias("k"),
        F.explode(F.transform(F.array(F.lit(1400.0), F.lit(1500.0), F.lit(1700.0)),
                              lambda r: F.col("l_quantity") * r)).alias("p"),
    )
    return ensemble_confidence(rows, "p", ["k"]).select(
        "k", *[rounded(F.col(f"confidence.{n}"), 4).alias(n) for n in ("mean", "std", "min", "max")]
    )


@query(
    "user_feature",
    r"SELECT doc_id, CAST(length(regexp_replace(text, '[^aeiou]', '', 'g')) AS DOUBLE) AS vowels FROM documents",
)
def _user_feature(spark, folder):
    """A user's pandas UDF as one more feature of the vector."""
    @F.pandas_udf("double")
    def vowels(text: pd.Series) -> pd.Series:
        return text.str.count("[aeiou]").astype(float)

    features = _LENGTH_ONLY.with_udf("vowels", vowels)
    rows = spread_rows(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    at = features.names.index("vowels")
    return assemble_features(rows, "text", features).select(
        "doc_id", F.get("features", F.lit(at)).cast("double").alias("vowels")
    )


_MERGED_SQL = f"""{BIN_SQL}, c AS (SELECT bin, count(*) AS n, row_number() OVER (ORDER BY bin) AS i
    FROM binned WHERE bin IS NOT NULL GROUP BY bin),
  w(i, bin, held, target) AS (SELECT i, bin, n, 0 FROM c WHERE i = 1
    UNION ALL SELECT c.i, c.bin, CASE WHEN w.held >= 30 THEN c.n ELSE w.held + c.n END,
                     CASE WHEN w.held >= 30 THEN c.bin ELSE w.target END FROM w JOIN c ON c.i = w.i + 1),
  e AS (SELECT held, target FROM w ORDER BY i DESC LIMIT 1),
  m AS (SELECT bin, CASE WHEN target = (SELECT target FROM e) AND (SELECT held FROM e) < 30
                    THEN coalesce((SELECT max(target) FROM w WHERE target < (SELECT target FROM e)), target)
                    ELSE target END AS target FROM w),
  b AS (SELECT event_id, target AS bin FROM binned JOIN m USING (bin)),
  r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(event_id || '|42')) AS rn,
               count(*) OVER (PARTITION BY bin) AS n FROM b)"""


@query(
    "undersample_merged",
    f"WITH RECURSIVE {_MERGED_SQL} SELECT event_id, CAST(bin AS INTEGER) AS bin FROM r "
    "WHERE rn <= (SELECT min(n) FROM r)",
)
def _undersample_merged(spark, folder):
    """Bins with fewer than 30 rows are merged before the others are cut to the smallest."""
    rows = table(spark, folder, "events").select("event_id", "value")
    return undersample_bins(rows, "value", "event_id", min_bin_count=30).select("event_id", "bin")
