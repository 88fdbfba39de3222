"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.catalog.base import (
    ALPHAS, challenger_and_baseline, experiment_results, individual_results, lagged, modeling, panel,
    predictions, query, rounded, with_ctes, prepared,
)
from panelspark.catalog.aggregates import _CELL, _REL
from panelspark.catalog.joins import _HISTORY
from panelspark.catalog.base import SPLIT_DATE
from panelspark.config import SKU_KEYS
from panelspark.functions import calendar, labels
from panelspark.functions.compare import mean_shift_pct
from panelspark.operators import compare, summaries
from panelspark.sources import retail


@query("SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d')::DATE AS date FROM orders")
def parse_date(spark, sf):
    text = retail.table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("text"))
    return text.select("o_orderkey", calendar.parse_date(F.col("text")).alias("date"))


@query(with_ctes(f"SELECT hp_type, quantile_level, {_CELL} AS cell FROM agg", "results",
    agg="SELECT hp_type, quantile_level, avg(mean_quantile_loss) AS avg, "
        "stddev_samp(mean_quantile_loss) AS std FROM results GROUP BY ALL"))
def string_format(spark, sf):
    return summaries.mean_std(experiment_results(spark, sf)).select(
        "hp_type", "quantile_level", labels.mean_std_text(F.col("avg"), F.col("std")).alias("cell"))


@query(with_ctes("""
    SELECT model_type || '_individual_' || productID || 'x' || storeID || '_q' || CAST(quantile_level AS VARCHAR)
           AS model_id, productID, storeID, quantile_level FROM individual_results
    UNION ALL
    SELECT 'empirical_quantile_combined_' || n || 'skus_q' || CAST(quantile_level AS VARCHAR), NULL, NULL,
           quantile_level
    FROM (SELECT count(*) AS n FROM (SELECT DISTINCT productID, storeID FROM modeling) s), levels""",
    "individual_results", "levels"))
def model_id(spark, sf):
    rows = prepared(spark, sf)
    own = individual_results(spark, sf, rows).withColumns({"n_skus": F.lit(1).cast("bigint"), "strategy": F.lit("individual")})
    levels = F.array(*[F.lit(a) for a in ALPHAS])
    both = rows.select(*SKU_KEYS).distinct().agg(F.count("*").alias("n_skus")).select(
        F.lit(None).cast("int").alias("productID"), F.lit(None).cast("int").alias("storeID"),
        F.lit("empirical_quantile").alias("model_type"), F.lit("combined").alias("strategy"),
        "n_skus", F.explode(levels).alias("quantile_level"))
    models = own.select(*both.columns).unionByName(both)
    label = labels.model_id(*[F.col(c) for c in (
        "model_type", "strategy", "n_skus", "productID", "storeID", "quantile_level")])
    return models.select(label.alias("model_id"), *SKU_KEYS, "quantile_level")


@query(with_ctes("""
    SELECT productID, CASE WHEN n = 1 THEN '(' || productID || ', ' || s1 || ')'
        ELSE 'combined_' || productID || '_' || s1 || '_' || productID || '_' || s2
             || CASE WHEN n > 2 THEN '_etc' ELSE '' END END AS sku_key
    FROM (SELECT productID, count(*) AS n, min(storeID) AS s1,
                 min(storeID) FILTER (WHERE r = 2) AS s2
          FROM (SELECT *, row_number() OVER (PARTITION BY productID ORDER BY storeID) AS r
                FROM (SELECT DISTINCT productID, storeID FROM panel) d) x GROUP BY productID) t
    UNION ALL
    SELECT productID, '(' || productID || ', ' || storeID || ')' FROM (SELECT DISTINCT productID, storeID FROM panel) d
    """, "panel"))
def sku_key(spark, sf):
    """Labels of one model per product over its stores, and of one model per SKU."""
    skus = panel(spark, sf).select(*SKU_KEYS).distinct()
    one = skus.select("productID", F.array(F.struct(*SKU_KEYS)).alias("skus"))
    # The label names the first two SKUs and whether there are more, so three are enough.
    several = summaries.first_skus_of("productID", skus, 3)
    models = several.unionByName(one)
    return models.select("productID", labels.sku_key(F.col("skus")).alias("sku_key"))


@query(with_ctes("""
    SELECT productID, storeID, quantile_level, round(mean_quantile_loss - base, 9) AS abs_diff,
           round(rel_diff_pct, 6) AS rel_diff_pct FROM rel""", "results", rel=_REL))
def rel_diff(spark, sf):
    joined = compare.join_baseline(*challenger_and_baseline(spark, sf))
    diff = compare.differences(joined).select(*SKU_KEYS, "quantile_level", "abs_diff", "rel_diff_pct")
    return rounded(diff, "abs_diff", six=["rel_diff_pct"])


@query(with_ctes("""
    SELECT productID, storeID, round(CASE WHEN mean_train = 0 THEN NULL
           ELSE (mean_test / mean_train - 1) * 100 END, 6) AS rel_mean_diff FROM history""", "lagged", history=_HISTORY))
def rel_mean_shift(spark, sf):
    history = summaries.sku_history(lagged(spark, sf), SPLIT_DATE, "target_lag_1")
    shift = mean_shift_pct(F.col("mean_test"), F.col("mean_train")).alias("rel_mean_diff")
    return rounded(history.select(*SKU_KEYS, shift), six=["rel_mean_diff"])


@query(with_ctes("""
    SELECT productID, storeID, quantile_level, round(mean_quantile_loss, 9) AS mean_quantile_loss,
           round(base, 9) AS mean_quantile_loss_baseline, false AS is_better
    FROM rel WHERE NOT round(mean_quantile_loss, 9) <= round(base, 9)""", "results", rel=_REL))
def better_than_baseline(spark, sf):
    joined = compare.join_baseline(*challenger_and_baseline(spark, sf))
    ours, base = F.round("mean_quantile_loss", 9), F.round("mean_quantile_loss_baseline", 9)
    worse = joined.withColumn("is_better", ours <= base).where(~F.col("is_better"))
    return rounded(worse.drop("hp_type", "model_type"), "mean_quantile_loss", "mean_quantile_loss_baseline")


@query(with_ctes("""
    SELECT bdID, round_even(price, 0) AS whole_price, round(sqrt(target), 6) AS root,
           abs(target - target_lag_1) AS change, greatest(target, target_lag_1) AS larger,
           CASE WHEN target >= target_lag_1 THEN 'up' ELSE 'down' END AS direction,
           round(log10(target), 6) AS digits
    FROM modeling""", "modeling"))
def math_basic(spark, sf):
    return modeling(spark, sf).select(
        "bdID",
        F.bround("price", 0).alias("whole_price"),
        F.round(F.sqrt("target"), 6).alias("root"),
        F.abs(F.col("target") - F.col("target_lag_1")).alias("change"),
        F.greatest("target", "target_lag_1").alias("larger"),
        F.when(F.col("target") >= F.col("target_lag_1"), "up").otherwise("down").alias("direction"),
        F.round(F.log10("target"), 6).alias("digits"),
    )
