"""Scores per row, per model and over models."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.catalog.base import (
    ALPHAS, experiment_results, individual_results, individual_rows,
    modeling, pinball_sql, predictions, query, rounded, with_ctes,
)
from panelspark.config import SKU_KEYS
from panelspark.functions.losses import pinball, pinball_rounded
from panelspark.models import empirical
from panelspark.operators import metrics, quantiles, sketches, summaries
from panelspark.session import materialize

_MODEL = [*SKU_KEYS, "quantile_level"]
_KEYS = ", ".join(_MODEL)
_E = "(target - prediction)"
_REGRESSION = (f"round(avg({_E} * {_E}), 9) AS mse, round(sqrt(avg({_E} * {_E})), 6) AS rmse, "
               f"round(avg(abs({_E})), 9) AS mae")
_ROUNDED = pinball_sql("target", "prediction", "quantile_level")
_RAW = pinball_sql("target", "prediction", "quantile_level", rounded=False)


@query(with_ctes("SELECT productID, storeID, quantile_level, round(q, 9) AS value FROM model_individual",
                 "model_individual"))
def empirical_quantile(spark, sf):
    train = modeling(spark, sf).where(F.col("split") == "train")
    model = empirical.fit(train, list(SKU_KEYS), ALPHAS)
    return rounded(quantiles.by_level(model, ALPHAS), "value")


@query(with_ctes("""
    SELECT productID, storeID, quantile_level, count(*) AS n_rows, true AS within FROM modeling JOIN model_individual USING (productID, storeID)
    WHERE split = 'train' GROUP BY ALL""", "modeling", "model_individual"))
def empirical_quantile_sketch(spark, sf):
    """Sketches per SKU and month, written once, merged to one per SKU: do their quantiles stay within the stated accuracy?"""
    keys = list(SKU_KEYS)
    train = materialize(modeling(spark, sf).where(F.col("split") == "train"), "train")
    monthly = materialize(sketches.build(train, [*keys, F.trunc("date", "month").alias("month")], "target"), "sketches")
    near = quantiles.by_level(sketches.quantiles(sketches.merge(monthly, keys), keys, ALPHAS), ALPHAS)
    exact = quantiles.by_level(empirical.fit(train, keys, ALPHAS), ALPHAS, name="exact")
    off = F.abs(F.col("value") - F.col("exact"))
    return near.join(exact, [*keys, "quantile_level"]).select(
        *keys, "quantile_level", F.col("total").alias("n_rows"), (off <= sketches.ACCURACY * F.col("exact") + 1e-9).alias("within"))


@query(with_ctes("SELECT quantile_level, round(q, 9) AS value FROM model_combined", "model_combined"))
def empirical_quantile_combined(spark, sf):
    train = modeling(spark, sf).where(F.col("split") == "train")
    return rounded(quantiles.by_level(empirical.fit(train, [], ALPHAS), ALPHAS), "value")


@query(with_ctes(f"""
    SELECT {_KEYS}, date, target, round_even(prediction, 0) AS prediction, round({_ROUNDED}, 9) AS quantile_loss
    FROM predictions""", "predictions"))
def pinball_rows(spark, sf):
    df = predictions(spark, sf)
    loss = pinball_rounded(F.col("target"), F.col("prediction"), F.col("quantile_level"))
    scored = df.withColumn("quantile_loss", loss).withColumn("prediction", F.bround("prediction", 0))
    return rounded(scored.drop("skuID"), "quantile_loss")


@query(with_ctes("SELECT productID, storeID, quantile_level, round(mean_quantile_loss, 9) AS mean_quantile_loss "
                 "FROM individual_results", "individual_results"))
def pinball_mean(spark, sf):
    return rounded(individual_results(spark, sf).drop("hp_type", "model_type"), "mean_quantile_loss")


@query(with_ctes(f"SELECT {_KEYS}, round(avg({_RAW}), 9) AS loss FROM predictions GROUP BY {_KEYS}", "predictions"))
def pinball_unrounded(spark, sf):
    scored = metrics.pinball_by_level(
        individual_rows(modeling(spark, sf)), ["skuID", *SKU_KEYS], ALPHAS, rounded=False)
    return rounded(scored.drop("skuID").withColumnRenamed("mean_quantile_loss", "loss"), "loss")


@query(with_ctes(f"SELECT {_KEYS}, {_REGRESSION} FROM predictions GROUP BY {_KEYS}", "predictions"))
def regression_metrics(spark, sf):
    return rounded(metrics.score(predictions(spark, sf), _MODEL), "mse", "mae", six=["rmse"])


@query(with_ctes(f"""
    SELECT {_KEYS}, {_REGRESSION}, round(avg({_ROUNDED}), 9) AS mean_quantile_loss
    FROM predictions GROUP BY {_KEYS}""", "predictions"))
def all_metrics(spark, sf):
    scored = metrics.score(predictions(spark, sf), _MODEL, ("regression", "quantile"))
    return rounded(scored, "mse", "mae", "mean_quantile_loss", six=["rmse"])


_EXTENDED = f"""
    CASE WHEN var_pop(target) = 0 THEN NULL
         ELSE round(1 - sum({_E} * {_E}) / (var_pop(target) * count(target)), 6) END AS r2,
    round(100 * avg(CASE WHEN target <> 0 THEN abs({_E} / target) END), 6) AS mape,
    round(max(abs({_E})), 6) AS max_error, round(avg({_E}), 6) AS mean_error,
    round(stddev_pop({_E}), 6) AS std_error,
    round(100 * avg(CASE WHEN abs({_E}) <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_1_unit,
    round(100 * avg(CASE WHEN abs({_E}) <= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_2_units,
    round(100 * avg(CASE WHEN abs({_E}) <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_5_units"""
_EXTENDED_NAMES = ("r2", "mape", "max_error", "mean_error", "std_error",
                   "within_1_unit", "within_2_units", "within_5_units")


@query(with_ctes(f"SELECT quantile_level, {_EXTENDED} FROM p GROUP BY quantile_level", "predictions",
                 p="SELECT quantile_level, target, round(prediction, 9) AS prediction FROM predictions"))
def metrics_extended(spark, sf):
    df = predictions(spark, sf).withColumn("prediction", F.round("prediction", 9))
    return rounded(metrics.score(df, ["quantile_level"], ("extended",)), six=_EXTENDED_NAMES)


@query(with_ctes(f"""
    SELECT {_KEYS}, round(avg(CASE WHEN target <= prediction THEN 1.0::DOUBLE ELSE 0 END), 9) AS coverage_probability,
           round(abs(avg(CASE WHEN target <= prediction THEN 1.0::DOUBLE ELSE 0 END) - quantile_level), 9)
             AS coverage_error,
           round(avg({_RAW}), 9) AS quantile_score
    FROM p GROUP BY {_KEYS}""", "predictions",
    p=f"SELECT {_KEYS}, target, round(prediction, 9) AS prediction FROM predictions"))
def coverage_metrics(spark, sf):
    df = predictions(spark, sf).withColumn("prediction", F.round("prediction", 9))
    scored = metrics.score(df, _MODEL, ("coverage",))
    return rounded(scored, "coverage_probability", "coverage_error", "quantile_score")


_LONG = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {m} AS value FROM scores" for m in ("mse", "rmse", "mae", "mean_quantile_loss"))
_SCORES = (f"SELECT avg({_E} * {_E}) AS mse, sqrt(avg({_E} * {_E})) AS rmse, avg(abs({_E})) AS mae, "
           f"avg({_ROUNDED}) AS mean_quantile_loss, {_KEYS} FROM predictions GROUP BY {_KEYS}")
_METRICS = ["mse", "rmse", "mae", "mean_quantile_loss"]


def _long_scores(spark, sf):
    scored = metrics.score(predictions(spark, sf), _MODEL, ("regression", "quantile"))
    return summaries.unpivot_metrics(scored, _MODEL, _METRICS)


@query(with_ctes("""
    SELECT metric, count(value) AS n_models,
           CASE WHEN count(value) = 1 THEN round(avg(value), 6) END AS value,
           CASE WHEN count(value) > 1 THEN round(avg(value), 6) END AS mean,
           CASE WHEN count(value) > 1 THEN round(min(value), 6) END AS min,
           CASE WHEN count(value) > 1 THEN round(max(value), 6) END AS max
    FROM long GROUP BY metric""", "predictions", scores=_SCORES, long=_LONG))
def performance_summary(spark, sf):
    return rounded(summaries.performance_summary(_long_scores(spark, sf)), six=("value", "mean", "min", "max"))


@query(with_ctes("""
    SELECT metric, count(value) AS n_models, 'empirical_quantile' AS model_types, 'individual' AS strategies,
           round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max,
           round(stddev_pop(value), 6) AS std
    FROM long GROUP BY metric""", "predictions", scores=_SCORES, long=_LONG))
def evaluation_summary(spark, sf):
    summary = summaries.performance_summary(_long_scores(spark, sf), with_std=True).drop("value")
    named = summary.withColumns({
        "model_types": F.lit("empirical_quantile"), "strategies": F.lit("individual")})
    return rounded(named, six=("mean", "min", "max", "std"))


_BY_MODEL = """
    SELECT 'level_' || CAST(quantile_level AS VARCHAR) AS model, round(mse, 6) AS mse, round(rmse, 6) AS rmse,
           round(r2, 6) AS r2
    FROM (SELECT quantile_level, avg({e} * {e}) AS mse, sqrt(avg({e} * {e})) AS rmse,
                 1 - sum({e} * {e}) / (var_pop(target) * count(target)) AS r2
          FROM predictions GROUP BY quantile_level) t""".format(e=_E)
_BY_MODEL_LONG = " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m} AS value FROM models"
                                    for m in ("mse", "rmse", "r2"))


def _model_scores(spark, sf):
    scored = metrics.score(predictions(spark, sf), ["quantile_level"], ("regression", "extended"))
    named = rounded(scored, six=("mse", "rmse", "r2")).withColumn(
        "model", F.concat(F.lit("level_"), F.col("quantile_level").cast("string")))
    return summaries.unpivot_metrics(named, ["model"], ["mse", "rmse", "r2"])


@query(with_ctes("""
    SELECT model, metric, value, rank() OVER (PARTITION BY metric ORDER BY
           CASE WHEN metric = 'r2' THEN -value ELSE value END) AS rank FROM long""",
    "predictions", models=_BY_MODEL, long=_BY_MODEL_LONG))
def rank_models(spark, sf):
    return summaries.rank_models(_model_scores(spark, sf))


@query(with_ctes("SELECT metric, "
    + ", ".join(f"max(value) FILTER (WHERE model = 'level_{a}') AS \"level_{a}\"" for a in ALPHAS)
    + " FROM long GROUP BY metric", "predictions", models=_BY_MODEL, long=_BY_MODEL_LONG))
def compare_models(spark, sf):
    return summaries.compare_models(_model_scores(spark, sf), [f"level_{a}" for a in ALPHAS])


@query(with_ctes("""
    SELECT productID, storeID, quantile_level, mean_quantile_loss, rank() OVER (
      PARTITION BY hp_type, quantile_level ORDER BY mean_quantile_loss) AS rank, hp_type
    FROM (SELECT * REPLACE (round(mean_quantile_loss, 9) AS mean_quantile_loss) FROM results) r""", "results"))
def rank_skus(spark, sf):
    """Every SKU's rank by loss within its experiment and level."""
    df = rounded(experiment_results(spark, sf).drop("model_type"), "mean_quantile_loss")
    return quantiles.spread_rank(df, ["hp_type", "quantile_level"], "mean_quantile_loss")


@query(with_ctes("""
    SELECT productID, storeID, quantile_level, hp_type AS tag, 'mean_quantile_loss' AS metric,
           round(mean_quantile_loss, 9) AS value FROM results""", "results"))
def results_long(spark, sf):
    df = experiment_results(spark, sf).withColumnRenamed("hp_type", "tag").drop("model_type")
    long = summaries.unpivot_metrics(df, ["productID", "storeID", "quantile_level", "tag"], ["mean_quantile_loss"])
    return rounded(long, "value")
