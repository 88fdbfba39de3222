"""Projections, filters and validity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.catalog.base import (
    ALPHAS, SKUS, SPLIT_DATE, experiment_results, individual_results, lagged, modeling, panel,
    query, rounded, with_ctes,
)
from panelspark.operators import checks, features, filters, splits, summaries
from panelspark.sources import retail

_SKU_PAIRS = ", ".join(str(s) for s in SKUS)
_PRODUCTS = ", ".join(str(p) for p in sorted({p for p, _ in SKUS}))
_STORES = ", ".join(str(s) for s in sorted({s for _, s in SKUS}))
_LAG_NAMES = ", ".join(f"target_lag_{k}" for k in range(1, 8))
_KEYED = "bdID, productID, storeID, date, target"


@query(with_ctes(f"SELECT price, disc, {_LAG_NAMES} FROM lagged", "lagged"))
def feature_columns(spark, sf):
    return filters.select_features(lagged(spark, sf))


@query(with_ctes(f"SELECT bdID, split, price, disc, {_LAG_NAMES}, target FROM modeling", "modeling"))
def prepare_xy(spark, sf):
    df = modeling(spark, sf)
    names = [c for c in filters.feature_columns(df) if c != "split"]
    return df.select("bdID", "split", *names, "target")


@query(with_ctes(f"SELECT {_KEYED} FROM panel WHERE productID = 12 AND storeID = 3", "panel"))
def filter_sku_single(spark, sf):
    return filters.one_sku(panel(spark, sf), 12, 3).select(*_KEYED.split(", "))


@query(with_ctes(f"SELECT {_KEYED} FROM panel WHERE (productID, storeID) IN ({_SKU_PAIRS})", "panel"))
def filter_sku_list(spark, sf):
    return filters.sku_tuples(panel(spark, sf), SKUS).select(*_KEYED.split(", "))


@query(with_ctes(
    f"SELECT {_KEYED} FROM panel WHERE productID IN ({_PRODUCTS}) AND storeID IN ({_STORES})", "panel"))
def filter_sku_cross(spark, sf):
    return filters.sku_tuples(panel(spark, sf), SKUS, mode="cross").select(*_KEYED.split(", "))


@query(with_ctes(
    f"SELECT {_KEYED} FROM panel WHERE storeID IN (2, 5, 9) AND productID IN (4, 8, 15, 16, 23)", "panel"))
def filter_store_product_default(spark, sf):
    kept = filters.whitelist(panel(spark, sf), stores=(2, 5, 9), products=(4, 8, 15, 16, 23))
    return kept.select(*_KEYED.split(", "))


@query(with_ctes(
    f"SELECT {_KEYED} FROM panel WHERE date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'", "panel"))
def filter_date_range(spark, sf):
    return retail.demand_panel(spark, sf, "1997-03-01", "1998-02-28").select(*_KEYED.split(", "))


@query(with_ctes(f"SELECT {_KEYED}, not_for_sale FROM panel WHERE not_for_sale <> 1", "panel"))
def filter_not_for_sale(spark, sf):
    return filters.for_sale(panel(spark, sf)).select(*_KEYED.split(", "), "not_for_sale")


@query(with_ctes("SELECT bdID, target, target_lag_1, target_lag_7 FROM lagged WHERE "
                 + " AND ".join(f"target_lag_{k} IS NOT NULL" for k in range(1, 8)), "lagged"))
def drop_nulls(spark, sf):
    return filters.drop_nulls(lagged(spark, sf)).select("bdID", "target", "target_lag_1", "target_lag_7")


@query(with_ctes(
    "SELECT bdID, target, target_lag_1, round(100 * (target / target_lag_1 - 1), 6) AS change_pct FROM lagged "
    "WHERE 100 * (target / target_lag_1 - 1) BETWEEN -100 AND 100", "lagged"))
def filter_between(spark, sf):
    df = features.lag_features(panel(spark, sf), "target", 1)
    change = 100 * (F.try_divide("target", "target_lag_1") - 1)
    return rounded(
        df.select("bdID", "target", "target_lag_1", change.alias("change_pct"))
        .where(F.col("change_pct").between(-100, 100)), six=["change_pct"])


@query(with_ctes(
    "SELECT productID, storeID, quantile_level, hp_type, round(mean_quantile_loss, 9) AS mean_quantile_loss "
    "FROM results WHERE hp_type IN ('100', '500', '1000') AND hp_type <> '0'", "results"))
def filter_in_list(spark, sf):
    kept = experiment_results(spark, sf).where(
        F.col("hp_type").isin("100", "500", "1000") & (F.col("hp_type") != "0"))
    return rounded(kept.drop("model_type"), "mean_quantile_loss")


@query(with_ctes(f"""
    SELECT storeID, productID, date_first, obs_train, obs_test FROM (
      SELECT storeID, productID, min(date) AS date_first,
             count(*) FILTER (WHERE date < DATE '{SPLIT_DATE}') AS obs_train,
             count(*) FILTER (WHERE date >= DATE '{SPLIT_DATE}') AS obs_test
      FROM panel GROUP BY ALL) t
    WHERE obs_train < 150 AND date_first >= DATE '1995-01-15' ORDER BY obs_train, storeID, productID""", "panel"))
def filter_thresholds(spark, sf):
    late = F.col("date_first") >= F.lit("1995-01-15").cast("date")
    return (
        summaries.sku_history(panel(spark, sf), SPLIT_DATE)
        .where((F.col("obs_train") < 150) & late)
        .orderBy("obs_train", "storeID", "productID")
    )


@query(with_ctes("""
    SELECT productID, storeID, CAST(quantile_level AS VARCHAR) AS quantile_level,
           CAST(hp_type AS INTEGER) AS sort_order, 'baseline' AS model_type,
           round(mean_quantile_loss, 9) AS loss FROM results""", "results"))
def cast_rename_lit(spark, sf):
    df = experiment_results(spark, sf).withColumns({
        "quantile_level": F.col("quantile_level").cast("string"),
        "hp_type": F.col("hp_type").cast("int"),
        "model_type": F.lit("baseline"),
    })
    renamed = df.withColumnsRenamed({"hp_type": "sort_order", "mean_quantile_loss": "loss"})
    return rounded(renamed, "loss")


@query(with_ctes("""
    SELECT productID, storeID,
           CASE WHEN productID <= 0 AND storeID <= 0 THEN 'product and store not positive'
                WHEN productID <= 0 THEN 'product not positive' ELSE 'store not positive' END AS reason,
           count(*) AS n_rows
    FROM panel WHERE productID <= 0 OR storeID <= 0 GROUP BY ALL""", "panel"))
def validate_skus(spark, sf):
    return checks.sku_violations(panel(spark, sf))


@query(with_ctes("""
    SELECT productID, storeID, n_train, n_test FROM (
      SELECT productID, storeID, count(*) FILTER (WHERE date < DATE '1995-02-01') AS n_train,
             count(*) FILTER (WHERE date >= DATE '1995-02-01') AS n_test FROM panel GROUP BY ALL) t
    WHERE n_train = 0 OR n_test = 0""", "panel"))
def validate_split(spark, sf):
    return checks.split_violations(splits.by_date(panel(spark, sf), "1995-02-01"), ["productID", "storeID"])
