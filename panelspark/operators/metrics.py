"""Scores of predictions: every metric is one map-side combined aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.config import check_alphas
from panelspark.functions.losses import pinball, pinball_rounded

# Error bounds, in units of demand, of the within_k shares.
WITHIN_UNITS = (1, 2, 5)


def regression(y, p) -> dict:
    err = y - p
    mse = F.avg(err * err)
    return {"mse": mse, "rmse": F.sqrt(mse), "mae": F.avg(F.abs(err))}


def extended(y, p) -> dict:
    """Fit, relative error, error spread and shares within k units.

    r2 is null where the target is flat; mape leaves out zero targets.
    """
    err = y - p
    scores = {
        "r2": 1 - F.try_divide(F.sum(err * err), F.var_pop(y) * F.count(y)),
        "mape": 100 * F.avg(F.when(y != 0, F.abs(F.try_divide(err, y)))),
        "max_error": F.max(F.abs(err)),
        "mean_error": F.avg(err),
        "std_error": F.stddev_pop(err),
    }
    for k in WITHIN_UNITS:
        unit = "unit" if k == 1 else "units"
        scores[f"within_{k}_{unit}"] = 100 * F.avg((F.abs(err) <= k).cast("double"))
    return scores


def coverage(y, p, alpha) -> dict:
    share = F.avg((y <= p).cast("double"))
    return {
        "coverage_probability": share,
        "coverage_error": F.abs(share - F.first(alpha)),
        "quantile_score": F.avg(pinball(y, p, alpha)),
    }


def quantile(y, p, alpha) -> dict:
    return {"mean_quantile_loss": F.avg(pinball_rounded(y, p, alpha))}


def score(df: DataFrame, keys: list[str], families=("regression",), actual="target",
          predicted="prediction", alpha="quantile_level") -> DataFrame:
    """Score long prediction rows per model; ``alpha`` must be among the keys for quantile families."""
    y, p, a = F.col(actual), F.col(predicted), F.col(alpha)
    build = {
        "regression": lambda: regression(y, p),
        "extended": lambda: extended(y, p),
        "quantile": lambda: quantile(y, p, a),
        "coverage": lambda: coverage(y, p, a),
    }
    exprs = {}
    for family in families:
        exprs.update(build[family]())
    return df.groupBy(*keys).agg(*[e.alias(n) for n, e in exprs.items()])


def pinball_by_level(df: DataFrame, keys: list[str], alphas, actual="target", predicted="quantiles",
                     rounded: bool = True) -> DataFrame:
    """Mean pinball loss per key and level for rows that carry an array of predictions.

    All levels are averaged in one pass; only the scored groups are spread to one row
    per level, so the prediction rows are never multiplied.
    """
    alphas = check_alphas(alphas)
    loss = pinball_rounded if rounded else pinball
    means = [F.avg(loss(F.col(actual), F.col(predicted)[i], a)).alias(f"l{i}") for i, a in enumerate(alphas)]
    pairs = F.array(*[
        F.struct(F.lit(a).alias("quantile_level"), F.col(f"l{i}").alias("mean_quantile_loss"))
        for i, a in enumerate(alphas)
    ])
    return df.groupBy(*keys).agg(*means).select(*keys, F.inline(pairs))
