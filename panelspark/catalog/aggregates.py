"""Aggregations over the panel and over experiment results."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.catalog.base import (
    ALPHAS, SPLIT_DATE, challenger_and_baseline, experiment_results, individual_results, lagged, modeling,
    panel, query, rounded, with_ctes, prepared,
)
from panelspark.catalog.joins import _HISTORY
from panelspark.config import SKU_KEYS
from panelspark.operators import checks, compare, filters, sampling, scaling, summaries
from panelspark.session import materialize

_SCALED = ("price", "disc", "target_lag_1")
_STATS = ", ".join(
    f"avg({c}) AS {c}_mean, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS {c}_std"
    for c in _SCALED)
_APPLY = ", ".join(f"round(({c} - {c}_mean) / {c}_std, 6) AS {c}" for c in _SCALED)
_REL = """
    SELECT productID, storeID, quantile_level, c.mean_quantile_loss, b.mean_quantile_loss AS base,
           CASE WHEN c.mean_quantile_loss = 0 AND b.mean_quantile_loss = 0 THEN 0
                WHEN b.mean_quantile_loss = 0 THEN 100
                ELSE (c.mean_quantile_loss / b.mean_quantile_loss - 1) * 100 END AS rel_diff_pct
    FROM individual_results c JOIN combined_results b USING (productID, storeID, quantile_level)"""


@query(with_ctes("SELECT DISTINCT productID, storeID FROM panel", "panel"))
def distinct_skus(spark, sf):
    return sampling.distinct_skus(panel(spark, sf))


@query(with_ctes("""
    SELECT storeID, productID, min(date) AS date FROM panel GROUP BY ALL
    HAVING min(date) >= DATE '1995-02-01'""", "panel"))
def sku_first_date(spark, sf):
    return (
        panel(spark, sf).groupBy("storeID", "productID").agg(F.min("date").alias("date"))
        .where(F.col("date") >= F.lit("1995-02-01").cast("date"))
    )


@query(with_ctes("""
    SELECT storeID, productID, date_first, obs_train, obs_test,
           round(mean_train, 9) AS mean_train, round(mean_test, 9) AS mean_test
    FROM history ORDER BY storeID, productID""", "lagged", history=_HISTORY))
def train_summary(spark, sf):
    history = summaries.sku_history(lagged(spark, sf), SPLIT_DATE, "target_lag_1")
    return rounded(history, "mean_train", "mean_test").orderBy("storeID", "productID")


@query(with_ctes("SELECT sum(target_lag_1) AS total FROM lagged WHERE productID = 12 AND storeID = 3", "lagged"))
def sum_scalar(spark, sf):
    return filters.one_sku(lagged(spark, sf), 12, 3).agg(F.sum("target_lag_1").alias("total"))


@query(with_ctes("""
    SELECT productID, round(avg(target_lag_1), 9) AS mean_lag FROM modeling GROUP BY productID
    ORDER BY productID""", "modeling"))
def mean_by_product(spark, sf):
    means = modeling(spark, sf).groupBy("productID").agg(F.avg("target_lag_1").alias("mean_lag"))
    return rounded(means, "mean_lag").orderBy("productID")


@query(with_ctes("""
    SELECT count(*) AS n_samples_total, count(*) FILTER (WHERE split = 'train') AS n_samples_train,
           count(*) FILTER (WHERE split = 'test') AS n_samples_test, 9 AS n_features,
           count(DISTINCT skuID) AS n_skus FROM modeling""", "modeling"))
def dataset_stats(spark, sf):
    df = modeling(spark, sf)
    n_features = len([c for c in filters.feature_columns(df) if c != "split"])
    return (
        df.groupBy("skuID")
        .agg(F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("n_train"))
        .agg(
            F.sum("n").alias("n_samples_total"),
            F.sum("n_train").alias("n_samples_train"),
            F.sum(F.col("n") - F.col("n_train")).alias("n_samples_test"),
            F.lit(n_features).alias("n_features"),
            F.count("*").alias("n_skus"),
        )
    )


@query(with_ctes("""
    SELECT count(*) AS n_rows, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test,
           max(date) FILTER (WHERE split = 'train') AS last_train, min(date) FILTER (WHERE split = 'test') AS first_test, '' AS faults
    FROM modeling""", "modeling"))
def split_observed(spark, sf):
    """Counts and checks of a split, collected while its rows are written: one scan for both."""
    rows, seen = checks.watched(modeling(spark, sf))
    materialize(rows, "modeling")
    found = seen.get
    kept = [found[c] for c in ("n_rows", "n_train", "n_test", "last_train", "first_test")]
    return spark.createDataFrame([(*kept, ", ".join(checks.split_faults(found)))],
                                 "n_rows long, n_train long, n_test long, last_train date, first_test date, faults string")


@query(with_ctes(f"""
    SELECT bdID, split, {_APPLY} FROM modeling JOIN stats USING (productID, storeID)""", "modeling",
    stats=f"SELECT productID, storeID, {_STATS} FROM modeling WHERE split = 'train' GROUP BY productID, storeID"))
def scaler_fit_apply(spark, sf):
    df, keys = modeling(spark, sf), list(SKU_KEYS)
    scaled = scaling.fit_apply(df, list(_SCALED), keys)
    return rounded(scaled.select("bdID", "split", *_SCALED), six=_SCALED)


_TRAIN = "FILTER (WHERE split = 'train') OVER ()"
_SCALED_AT_ONCE = ", ".join(
    f"round(({c} - avg({c}) {_TRAIN}) / (CASE WHEN stddev_pop({c}) {_TRAIN} = 0 THEN 1.0 ELSE stddev_pop({c}) {_TRAIN} END), 6) AS {c}"
    for c in _SCALED)


@query(with_ctes(f"SELECT bdID, split, {_SCALED_AT_ONCE} FROM modeling", "modeling"))
def scaler_fit_apply_combined(spark, sf):
    df = prepared(spark, sf)
    scaled = scaling.apply(df, scaling.fit(df, list(_SCALED), []), list(_SCALED), [])
    return rounded(scaled.select("bdID", "split", *_SCALED), six=_SCALED)


@query(with_ctes("""
    SELECT hp_type, quantile_level, round(avg(mean_quantile_loss), 6) AS avg,
           round(stddev_samp(mean_quantile_loss), 6) AS std FROM results GROUP BY ALL""", "results"))
def mean_std_by_config(spark, sf):
    return rounded(summaries.mean_std(experiment_results(spark, sf)), six=("avg", "std"))


@query(with_ctes("""
    SELECT quantile_level, round(min(avg), 6) AS min_avg FROM (
      SELECT hp_type, quantile_level, avg(mean_quantile_loss) AS avg FROM results GROUP BY ALL) t
    GROUP BY quantile_level""", "results"))
def best_per_quantile(spark, sf):
    best = summaries.mean_std(experiment_results(spark, sf)).groupBy("quantile_level").agg(
        F.min("avg").alias("min_avg"))
    return rounded(best, six=["min_avg"])


_CELL = ("CAST(round(avg, 3) AS VARCHAR) || ' ± ' || CAST(round(std, 3) AS VARCHAR)")
_PIVOT = ", ".join(f"max(cell) FILTER (WHERE quantile_level = {a}::DOUBLE) AS \"{a}\"" for a in ALPHAS)


@query(with_ctes(f"SELECT hp_type, {_PIVOT} FROM cells GROUP BY hp_type ORDER BY CAST(hp_type AS INTEGER)", "results",
    agg="SELECT hp_type, quantile_level, avg(mean_quantile_loss) AS avg, "
        "stddev_samp(mean_quantile_loss) AS std FROM results GROUP BY ALL",
    cells=f"SELECT hp_type, quantile_level, CASE WHEN avg = min(avg) OVER (PARTITION BY quantile_level) "
          f"THEN '**' || {_CELL} || '**' ELSE {_CELL} END AS cell FROM agg"))
def pivot_quantiles(spark, sf):
    table = summaries.pivot_levels(summaries.mean_std(experiment_results(spark, sf)), ALPHAS)
    return table.orderBy(F.col("hp_type").cast("int"))


@query(with_ctes("""
    SELECT CAST(quantile_level AS VARCHAR) AS level, round(avg(rel_diff_pct), 6) AS mean_rel_diff
    FROM rel WHERE rel_diff_pct BETWEEN -100 AND 100 GROUP BY 1
    UNION ALL
    SELECT 'all', round(avg(rel_diff_pct), 6) FROM rel WHERE rel_diff_pct BETWEEN -100 AND 100""",
    "results", rel=_REL))
def mean_rel_diff(spark, sf):
    joined = compare.join_baseline(*challenger_and_baseline(spark, sf))
    kept = compare.differences(joined).where(F.col("rel_diff_pct").between(-100, 100))
    sums = kept.groupBy("quantile_level").agg(
        F.avg("rel_diff_pct").alias("m"), F.count("*").alias("n"), F.sum("rel_diff_pct").alias("s"))
    # The overall mean comes from the per-level sums, so the joined rows are read once.
    both = sums.withColumn("level", F.explode(F.array(F.col("quantile_level").cast("string"), F.lit("all"))))
    means = both.groupBy("level").agg((F.sum("s") / F.sum("n")).alias("mean_rel_diff"))
    return rounded(means, six=["mean_rel_diff"])


def _box_sql(value: str) -> str:
    return with_ctes("""
        SELECT quantile_level, hp_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
               count(v) AS n, round(min(v), 6) AS minimum, round(max(v), 6) AS maximum,
               round(min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
               round(max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
               count(*) FILTER (WHERE NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
        FROM vals JOIN q USING (quantile_level, hp_type)
        GROUP BY quantile_level, hp_type, q1, median, q3""", "results",
        vals=f"SELECT quantile_level, hp_type, {value} AS v FROM results WHERE mean_quantile_loss > 0",
        q="SELECT quantile_level, hp_type, quantile_cont(v, 0.25::DOUBLE) AS q1, "
          "quantile_cont(v, 0.5::DOUBLE) AS median, quantile_cont(v, 0.75::DOUBLE) AS q3 FROM vals GROUP BY ALL")


def _box(spark, sf, value):
    df = experiment_results(spark, sf).where(F.col("mean_quantile_loss") > 0).select(
        "quantile_level", "hp_type", value.alias("v"))
    table = summaries.box(df, ["quantile_level", "hp_type"], "v")
    return rounded(table, six=("q1", "median", "q3", "minimum", "maximum", "whisker_low", "whisker_high"))


@query(_box_sql("round(mean_quantile_loss, 9)"))
def box_summary(spark, sf):
    return _box(spark, sf, F.round("mean_quantile_loss", 9))


@query(_box_sql("round(log10(mean_quantile_loss), 9)"))
def box_summary_log10(spark, sf):
    return _box(spark, sf, F.round(F.log10("mean_quantile_loss"), 9))
