"""Sorts, top-n, samples, folds and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.catalog.base import (
    ALPHAS, LAGS, SEED, TEST_FRACTION, challenger_and_baseline, experiment_results, individual_results,
    lagged, modeling, panel, query, rounded, with_ctes, written_panel,
)
from panelspark.catalog.joins import _WORST
from panelspark.config import SKU_KEYS
from panelspark.operators import compare, features, filters, sampling, splits, summaries
from panelspark.sources import retail

_RESULT = "productID, storeID, quantile_level, hp_type, round(mean_quantile_loss, 9) AS mean_quantile_loss"
_FOLD = "CAST(CAST('0x' || substr(md5('{seed}-' || bdID), 1, 8) AS BIGINT) % {k} AS INTEGER)"
N_FOLDS = 5


@query(with_ctes("""
    SELECT productID, storeID, date_first FROM (
      SELECT productID, storeID, min(date) AS date_first FROM panel GROUP BY ALL) t
    QUALIFY row_number() OVER (PARTITION BY productID ORDER BY date_first, storeID) <= 1""", "panel"))
def head_per_group(spark, sf):
    """The store in which each product was sold first."""
    first = panel(spark, sf).groupBy(*SKU_KEYS).agg(F.min("date").alias("date_first"))
    return summaries.head_per_group(first, ["productID"], ["date_first", "storeID"], 1)


@query(with_ctes("""
    SELECT productID, storeID, quantile_level, round(mean_quantile_loss, 9) AS loss FROM results
    WHERE hp_type = '100' ORDER BY quantile_level, loss DESC NULLS FIRST, productID, storeID""", "results"))
def sort_multi(spark, sf):
    df = rounded(individual_results(spark, sf).withColumnRenamed("mean_quantile_loss", "loss"), "loss")
    return df.drop("hp_type", "model_type").orderBy(
        "quantile_level", F.col("loss").desc_nulls_first(), *SKU_KEYS)


@query(with_ctes(f"SELECT {_RESULT} FROM ({_WORST}) w ORDER BY mean_quantile_loss DESC", "results"))
def topk_outliers(spark, sf):
    results = experiment_results(spark, sf).where(F.col("hp_type") != "0").drop("model_type")
    worst = summaries.worst_per_group(results, 25)
    return rounded(worst, "mean_quantile_loss").orderBy(F.desc_nulls_first("mean_quantile_loss"))


@query(with_ctes("""
    SELECT productID, storeID, quantile_level, round(c.mean_quantile_loss - b.mean_quantile_loss, 9) AS abs_diff
    FROM individual_results c JOIN combined_results b USING (productID, storeID, quantile_level)
    ORDER BY abs_diff DESC, productID, storeID, quantile_level LIMIT 50""", "results"))
def topk_overall(spark, sf):
    joined = compare.join_baseline(*challenger_and_baseline(spark, sf))
    diff = compare.differences(joined).select(*SKU_KEYS, "quantile_level", F.round("abs_diff", 9).alias("abs_diff"))
    return diff.orderBy(F.desc("abs_diff"), *SKU_KEYS, "quantile_level").limit(50)


@query(with_ctes("SELECT DISTINCT productID, storeID FROM panel ORDER BY productID, storeID LIMIT 100", "panel"))
def take_first_skus(spark, sf):
    return sampling.first_skus(panel(spark, sf), 100)


@query(with_ctes(f"""
    SELECT productID, storeID FROM (SELECT DISTINCT productID, storeID FROM panel) s
    ORDER BY md5('{SEED}-' || productID || '-' || storeID), productID, storeID LIMIT 100""", "panel"))
def sample_skus(spark, sf):
    return sampling.sample_skus(panel(spark, sf), 100, SEED)


@query(with_ctes(f"""
    SELECT bdID, productID, storeID, date, target FROM panel ORDER BY md5('{SEED}-' || bdID), bdID LIMIT 500""",
    "panel"))
def sample_rows(spark, sf):
    df = panel(spark, sf).select("bdID", *SKU_KEYS, "date", "target")
    return sampling.sample_rows(df, 500, SEED)


@query(with_ctes(f"""
    SELECT bdID, productID, storeID, date, target FROM panel ORDER BY md5('{SEED}-' || bdID), bdID LIMIT (SELECT count(*) // 2 FROM panel)""",
    "panel"))
def sample_rows_half(spark, sf):
    """Half the table at random: more rows than any task could merge."""
    df = written_panel(spark, sf).select("bdID", *SKU_KEYS, "date", "target")
    return sampling.sample_rows(df, df.count() // 2, SEED)


@query(with_ctes(f"""
    SELECT bdID, CAST((row_number() OVER (ORDER BY md5('{SEED}-' || bdID), bdID) - 1) % {N_FOLDS} AS INTEGER) AS fold
    FROM modeling WHERE split = 'train'""", "modeling"))
def kfold_assign(spark, sf):
    """Folds whose sizes differ by one at most."""
    train = modeling(spark, sf).where(F.col("split") == "train")
    return sampling.equal_folds(train.select("bdID"), N_FOLDS, SEED)


@query(with_ctes(f"SELECT bdID, {_FOLD.format(seed=SEED, k=N_FOLDS)} AS fold FROM modeling WHERE split = 'train'",
                 "modeling"))
def kfold_assign_hashed(spark, sf):
    """Folds fixed by each row's id alone."""
    train = modeling(spark, sf).where(F.col("split") == "train")
    return sampling.kfold(train, N_FOLDS, SEED).select("bdID", "fold")


@query(with_ctes(f"SELECT {_RESULT}, model_type FROM results", "results"))
def union_results(spark, sf):
    own, both = challenger_and_baseline(spark, sf)
    union = both.unionByName(own)
    return rounded(union, "mean_quantile_loss")


@query(with_ctes("""
    SELECT bdID FROM panel WHERE date < DATE '2000-01-01' INTERSECT
    SELECT bdID FROM panel WHERE date >= DATE '1999-10-01'""", "panel"))
def intersect_ids(spark, sf):
    """Ids that two sets share: the train rows and a window that reaches three months into them."""
    df = splits.by_date(written_panel(spark, sf), "2000-01-01")
    train = df.where(F.col("split") == "train").select("bdID")
    return train.intersect(filters.date_range(df, "1999-10-01").select("bdID"))


@query(with_ctes("""
    SELECT 'left' AS side, bdID, target FROM (
      SELECT bdID, target FROM panel EXCEPT ALL SELECT bdID, target FROM panel WHERE not_for_sale <> 1) l
    UNION ALL
    SELECT 'right', bdID, target FROM (
      SELECT bdID, target FROM panel WHERE not_for_sale <> 1 EXCEPT ALL SELECT bdID, target FROM panel) r""", "panel"))
def diff_datasets(spark, sf):
    """A full preparation against one without withdrawn rows."""
    df = written_panel(spark, sf)
    return compare.dataset_differences(
        df.select("bdID", "target"), filters.for_sale(df).select("bdID", "target"))


@query(with_ctes("SELECT count(*) AS n_rows, 0::BIGINT AS n_differences FROM panel", "panel"))
def diff_datasets_same(spark, sf):
    """Two ways to make the same lags leave no difference, over all rows."""
    df = written_panel(spark, sf).select("bdID", "skuID", "frequency", "date", "target")
    plain = features.lag_features(df, "target", 1).select("bdID", "target_lag_1")
    cut = features.lag_features(df, "target", 1, split_days=730).select("bdID", "target_lag_1")
    apart = compare.dataset_differences(plain, cut).agg(F.count("*").alias("n")).scalar()
    return plain.agg(F.count("*").alias("n_rows")).withColumn("n_differences", apart)
