"""Challenger against baseline, and one preparation against another."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.functions.compare import rel_diff_pct

RESULT_KEYS = ("productID", "storeID", "quantile_level")


def join_baseline(challenger: DataFrame, baseline: DataFrame, keys=RESULT_KEYS,
                  value="mean_quantile_loss") -> DataFrame:
    """Inner join on SKU and level; the baseline's value gets the suffix ``_baseline``."""
    base = baseline.select(*keys, F.col(value).alias(f"{value}_baseline"))
    return challenger.join(base, list(keys))


def differences(joined: DataFrame, value="mean_quantile_loss") -> DataFrame:
    ours, base = F.col(value), F.col(f"{value}_baseline")
    return joined.withColumns({"abs_diff": ours - base, "rel_diff_pct": rel_diff_pct(ours, base)})


def dataset_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only one side has, counted as often as they are in excess, tagged by side."""
    cols = left.columns
    tagged = left.withColumn("_n", F.lit(1)).unionByName(right.select(*cols).withColumn("_n", F.lit(-1)))
    excess = tagged.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0)
    side = F.when(F.col("_n") > 0, "left").otherwise("right")
    return excess.select(*[F.col(f"`{c}`") for c in cols], side.alias("side"), F.explode(F.sequence(F.lit(1), F.abs("_n"))).alias("_k")).drop("_k")
