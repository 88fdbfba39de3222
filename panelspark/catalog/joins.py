"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.catalog.base import (
    ALPHAS, SPLIT_DATE, challenger_and_baseline, experiment_results, individual_results, lagged, modeling,
    panel, prepared, query, rounded, with_ctes, written_panel,
)
from panelspark.config import SKU_KEYS
from panelspark.functions.compare import mean_shift_pct
from panelspark.operators import compare, filters, sampling, splits, summaries
from panelspark.session import materialize
from panelspark.sources import retail

_HISTORY = f"""
    SELECT storeID, productID, min(date) AS date_first,
           count(*) FILTER (WHERE date < DATE '{SPLIT_DATE}') AS obs_train,
           count(*) FILTER (WHERE date >= DATE '{SPLIT_DATE}') AS obs_test,
           avg(target_lag_1) FILTER (WHERE date < DATE '{SPLIT_DATE}') AS mean_train,
           avg(target_lag_1) FILTER (WHERE date >= DATE '{SPLIT_DATE}') AS mean_test
    FROM lagged GROUP BY storeID, productID"""

_WORST = """
    SELECT * FROM results WHERE hp_type <> '0'
    QUALIFY row_number() OVER (PARTITION BY quantile_level, hp_type
                               ORDER BY mean_quantile_loss DESC NULLS FIRST, productID, storeID) <= 25"""


@query(with_ctes("""
    SELECT p.bdID, p.productID, p.storeID, p.date, w.name
    FROM panel p JOIN whitelist w USING (productID, storeID)""", "panel", "whitelist"))
def join_unseen_inner(spark, sf):
    nation = retail.table(spark, sf, "nation").where(F.col("n_regionkey").isin(0, 1))
    named = nation.select(F.col("n_nationkey").alias("storeID"), F.col("n_name").alias("name"))
    return panel(spark, sf).join(named, "storeID").select("bdID", *SKU_KEYS, "date", "name")


@query(with_ctes("""
    SELECT f.bdID, f.productID, f.storeID, f.date, f.disc, t.target
    FROM panel f LEFT JOIN (SELECT bdID, target FROM panel WHERE not_for_sale <> 1) t USING (bdID)""", "panel"))
def join_target_left(spark, sf):
    df = written_panel(spark, sf)
    known = filters.for_sale(df).select("bdID", "target")
    return retail.feature_frame(df).join(known, "bdID", "left").select(
        "bdID", *SKU_KEYS, "date", "disc", "target")


@query(with_ctes("""
    SELECT t.bdID, t.date, t.target, f.skuID
    FROM panel t JOIN (SELECT bdID, skuID FROM panel WHERE not_for_sale <> 1) f USING (bdID)""", "panel"))
def join_target_keys(spark, sf):
    df = written_panel(spark, sf)
    chosen = filters.for_sale(df).select("bdID", "skuID")
    return retail.target_frame(df).join(chosen, "bdID").select("bdID", "date", "target", "skuID")


@query(with_ctes("""
    SELECT bdID, date, target FROM panel
    WHERE bdID IN (SELECT bdID FROM panel WHERE date >= DATE '2000-01-01' AND not_for_sale <> 1)""", "panel"))
def semi_bdid(spark, sf):
    df = written_panel(spark, sf)
    ids = filters.for_sale(filters.date_range(df, SPLIT_DATE)).select("bdID")
    return retail.target_frame(df).join(ids, "bdID", "left_semi")


@query(with_ctes("""
    SELECT DISTINCT productID, storeID FROM panel p WHERE NOT EXISTS (
      SELECT 1 FROM (SELECT productID, storeID FROM panel GROUP BY ALL
                     HAVING min(date) >= DATE '1995-02-01') x
      WHERE x.productID = p.productID AND x.storeID = p.storeID)""", "panel"))
def anti_excluded_skus(spark, sf):
    first = panel(spark, sf).groupBy(*SKU_KEYS).agg(F.min("date").alias("first"))
    df = materialize(first, "first_days")
    late = (
        df.groupBy(*SKU_KEYS).agg(F.min("first").alias("first"))
        .where(F.col("first") >= F.lit("1995-02-01").cast("date"))
    )
    return sampling.distinct_skus(df).join(late, list(SKU_KEYS), "left_anti")


@query(with_ctes("""
    SELECT productID, storeID, n_train, quantile_level FROM (
      SELECT productID, storeID, count(*) AS n_train FROM modeling WHERE split = 'train' GROUP BY ALL) m, levels""",
    "modeling", "levels"))
def cross_models_quantiles(spark, sf):
    datasets = (
        modeling(spark, sf).where(F.col("split") == "train")
        .groupBy(*SKU_KEYS).agg(F.count("*").alias("n_train"))
    )
    levels = F.array(*[F.lit(a) for a in ALPHAS])
    return datasets.withColumn("quantile_level", F.explode(levels))


@query(with_ctes("""
    SELECT hp_type, quantile_level, round(avg, 6) AS avg, round(min_avg, 6) AS min_avg, avg = min_avg AS is_best
    FROM (SELECT *, min(avg) OVER (PARTITION BY quantile_level) AS min_avg FROM (
      SELECT hp_type, quantile_level, avg(mean_quantile_loss) AS avg FROM results GROUP BY ALL) a) b""", "results"))
def join_min_back(spark, sf):
    marked = summaries.mark_best(summaries.mean_std(experiment_results(spark, sf)))
    return rounded(marked.drop("std"), six=("avg", "min_avg"))


@query(with_ctes("""
    SELECT w.productID, w.storeID, w.quantile_level, w.hp_type,
           round(w.mean_quantile_loss, 9) AS mean_quantile_loss, h.date_first, h.obs_train, h.obs_test,
           round(h.mean_train, 9) AS mean_train, round(h.mean_test, 9) AS mean_test,
           round(CASE WHEN h.mean_train = 0 THEN NULL ELSE (h.mean_test / h.mean_train - 1) * 100 END, 6)
             AS rel_mean_diff
    FROM worst w LEFT JOIN history h USING (storeID, productID)""",
    "results", "lagged", worst=_WORST, history=_HISTORY))
def join_outlier_summary(spark, sf):
    results = experiment_results(spark, sf).where(F.col("hp_type") != "0")
    worst = summaries.worst_per_group(results, 25)
    history = summaries.sku_history(lagged(spark, sf), SPLIT_DATE, "target_lag_1")
    joined = worst.join(history, ["storeID", "productID"], "left").withColumn(
        "rel_mean_diff", mean_shift_pct(F.col("mean_test"), F.col("mean_train")))
    return rounded(joined.drop("model_type"), "mean_quantile_loss", "mean_train", "mean_test",
                   six=["rel_mean_diff"])


@query(with_ctes("""
    SELECT c.productID, c.storeID, c.quantile_level, c.hp_type,
           round(c.mean_quantile_loss, 9) AS mean_quantile_loss,
           round(b.mean_quantile_loss, 9) AS mean_quantile_loss_baseline
    FROM individual_results c JOIN combined_results b USING (productID, storeID, quantile_level)""", "results"))
def join_baseline(spark, sf):
    joined = compare.join_baseline(*challenger_and_baseline(spark, sf))
    return rounded(joined.drop("model_type"), "mean_quantile_loss", "mean_quantile_loss_baseline")


@query(with_ctes("""
    SELECT r.productID, r.storeID, r.quantile_level, round(r.mean_quantile_loss, 9) AS mean_quantile_loss,
           d.n_train, d.n_test
    FROM individual_results r JOIN (
      SELECT productID, storeID, count(*) FILTER (WHERE split = 'train') AS n_train,
             count(*) FILTER (WHERE split = 'test') AS n_test FROM modeling GROUP BY ALL) d
    USING (productID, storeID)""", "individual_results"))
def join_result_dataset(spark, sf):
    rows = prepared(spark, sf)
    datasets = rows.groupBy(*SKU_KEYS).agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"))
    joined = individual_results(spark, sf, rows).join(datasets, list(SKU_KEYS))
    return rounded(joined.drop("hp_type", "model_type"), "mean_quantile_loss")
