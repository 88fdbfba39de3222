"""Constant prediction: the quantile of the train targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from panelspark.config import SKU_KEYS, check_alphas
from panelspark.operators.quantiles import grouped_quantiles, spread_quantiles


def fit(train: DataFrame, keys: list[str], alphas, target: str = "target") -> DataFrame:
    """Keys plus ``quantiles``, one value per level.

    A daily series has at most one row per day, so a model per SKU uses the plain
    aggregate. Coarser keys, or none, may hold any share of the rows and use the form
    that spreads a group over many tasks.
    """
    per_series = set(SKU_KEYS) <= set(keys) or "skuID" in keys
    build = grouped_quantiles if per_series else spread_quantiles
    return build(train, keys, target, alphas)


def predict(df: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Add the model's ``quantiles``; rows without a model drop out."""
    if not keys:
        return df.withColumn("quantiles", model.select("quantiles").scalar())
    return df.join(model, keys)


def fit_predict_series(df: DataFrame, keys: list[str], alphas, target: str = "target") -> DataFrame:
    """Fit on train rows and predict test rows of daily series in one shuffle.

    The quantile is a window aggregate over the series, so the panel is neither read
    twice nor joined to itself.
    """
    levels = F.array(*[F.lit(a) for a in check_alphas(alphas)])
    train = F.when(F.col("split") == "train", F.col(target))
    fitted = F.percentile(train, levels).over(W.partitionBy(*keys))
    return df.withColumn("quantiles", fitted).where(
        (F.col("split") == "test") & F.col("quantiles").isNotNull()
    )
