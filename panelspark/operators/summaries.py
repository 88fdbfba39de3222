"""Summaries over models, experiments and SKUs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from panelspark.functions.labels import bold, mean_std_text
from panelspark.operators.quantiles import spread_quantiles, spread_rank


def sku_history(df: DataFrame, split_date: str, value: str | None = None) -> DataFrame:
    """Per SKU: first day and row counts before and from the split, with means of a value if asked."""
    day, cut = F.col("date"), F.lit(split_date).cast("date")
    aggs = [
        F.min(day).alias("date_first"),
        F.count_if(day < cut).alias("obs_train"),
        F.count_if(day >= cut).alias("obs_test"),
    ]
    if value:
        aggs.append(F.avg(F.when(day < cut, F.col(value))).alias("mean_train"))
        aggs.append(F.avg(F.when(day >= cut, F.col(value))).alias("mean_test"))
    return df.groupBy("storeID", "productID").agg(*aggs)


def unpivot_metrics(scores: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return scores.unpivot(keys, metrics, "metric", "value")


def performance_summary(long: DataFrame, with_std: bool = False) -> DataFrame:
    """Per metric: its value where there is one model, else mean, min and max."""
    several = F.col("n_models") > 1
    aggs = [F.count("value").alias("n_models"), F.avg("value").alias("mean"),
            F.min("value").alias("min"), F.max("value").alias("max")]
    if with_std:
        aggs.append(F.stddev_pop("value").alias("std"))
    names = ["mean", "min", "max"] + (["std"] if with_std else [])
    return long.groupBy("metric").agg(*aggs).select(
        "metric", "n_models",
        F.when(~several, F.col("mean")).alias("value"),
        *[F.when(several, F.col(n)).alias(n) for n in names],
    )


def mean_std(results: DataFrame, keys=("hp_type", "quantile_level"), value="mean_quantile_loss") -> DataFrame:
    return results.groupBy(*keys).agg(F.avg(value).alias("avg"), F.stddev_samp(value).alias("std"))


def mark_best(summary: DataFrame, group="quantile_level", value="avg") -> DataFrame:
    """Add the group's minimum and whether a row attains it."""
    low = F.min(value).over(W.partitionBy(group))
    return summary.withColumn("min_avg", low).withColumn("is_best", F.col(value) == F.col("min_avg"))


def pivot_levels(summary: DataFrame, alphas, index="hp_type") -> DataFrame:
    """``avg ± std`` cells, one row per configuration and one column per level, best in bold."""
    cell = bold(mean_std_text(F.col("avg"), F.col("std")), F.col("is_best"))
    return (
        mark_best(summary).withColumn("cell", cell)
        .withColumn("level", F.col("quantile_level").cast("string"))
        .groupBy(index).pivot("level", [str(a) for a in alphas]).agg(F.first("cell"))
    )


def box(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Box-plot numbers: quartiles, whiskers within 1.5 IQR, extremes and the outlier count."""
    quartiles = spread_quantiles(df, keys, value, [0.25, 0.5, 0.75]).select(
        *keys,
        F.col("quantiles")[0].alias("q1"), F.col("quantiles")[1].alias("median"),
        F.col("quantiles")[2].alias("q3"),
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v, low, high = F.col(value), F.col("q1") - reach, F.col("q3") + reach
    within = v.between(low, high)
    return (
        df.join(quartiles, keys)
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.count(v).alias("n"),
            F.min(v).alias("minimum"), F.max(v).alias("maximum"),
            F.min(F.when(within, v)).alias("whisker_low"),
            F.max(F.when(within, v)).alias("whisker_high"),
            F.count_if(~within).alias("n_outliers"),
        )
    )


def rank_models(long: DataFrame, higher_is_better=("r2",)) -> DataFrame:
    """Rank models per metric; losses ascending, fits descending. Any number of models."""
    signed = F.when(F.col("metric").isin(list(higher_is_better)), -F.col("value")).otherwise(F.col("value"))
    return spread_rank(long.withColumn("_signed", signed), ["metric"], "_signed").drop("_signed")


def compare_models(long: DataFrame, models: list[str]) -> DataFrame:
    """Metric rows against model columns."""
    return long.groupBy("metric").pivot("model", models).agg(F.first("value"))


def worst_per_group(results: DataFrame, n: int, groups=("quantile_level", "hp_type"),
                    value="mean_quantile_loss", ties=("productID", "storeID")) -> DataFrame:
    """The n highest losses of each group. Spark prunes to n per task before the shuffle."""
    order = W.partitionBy(*groups).orderBy(F.col(value).desc_nulls_first(), *ties)
    return results.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def first_skus_of(key: str, skus: DataFrame, n: int) -> DataFrame:
    """The first n SKUs of each key as an array; pruned to n per task before the shuffle."""
    order = W.partitionBy(key).orderBy("productID", "storeID")
    kept = skus.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    pairs = F.sort_array(F.collect_list(F.struct("productID", "storeID")))
    return kept.groupBy(key).agg(pairs.alias("skus"))


def head_per_group(df: DataFrame, groups: list[str], order: list[str], n: int) -> DataFrame:
    """First n rows of each group; the order must end in a tie-break."""
    place = F.row_number().over(W.partitionBy(*groups).orderBy(*order))
    return df.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")
