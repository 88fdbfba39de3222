"""Standardisation with train means and population deviations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def fit(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """Means and deviations of the train rows per model key; a flat column gets deviation 1."""
    stats = []
    for c in cols:
        spread = F.stddev_pop(c)
        stats.append(F.avg(c).alias(f"{c}_mean"))
        stats.append(F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias(f"{c}_std"))
    return df.where(F.col("split") == "train").groupBy(*keys).agg(*stats)


def fit_apply(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """Fit and scale series in one pass: a window per key, which a daily series bounds."""
    own, train = W.partitionBy(*keys), F.col("split") == "train"
    scaled = {}
    for c in cols:
        known = F.when(train, F.col(c))
        spread = F.stddev_pop(known).over(own)
        scaled[c] = (F.col(c) - F.avg(known).over(own)) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    seen = F.max(train).over(own)
    return df.select(*[c for c in df.columns if c not in cols], *[scaled[c].alias(c) for c in cols], seen.alias("_seen")).where(
        "_seen").drop("_seen").select(*df.columns)


def apply(df: DataFrame, stats: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """Scale both splits with the fitted statistics."""
    names = [f"{c}_{part}" for c in cols for part in ("mean", "std")]
    if keys:
        joined = df.join(stats, keys)
    else:
        joined = df.withColumn("_s", stats.select(F.struct(*names)).scalar()).select(*df.columns, "_s.*")
    scaled = {c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in cols}
    return joined.withColumns(scaled).drop(*names)
