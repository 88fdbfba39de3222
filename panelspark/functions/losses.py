"""Loss expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _level(alpha) -> Column:
    return alpha if isinstance(alpha, Column) else F.lit(float(alpha))


def pinball(actual: Column, predicted: Column, alpha) -> Column:
    """Quantile loss without rounding, as used while tuning."""
    level, residual = _level(alpha), actual - predicted
    return F.when(residual >= 0, level * residual).otherwise((level - 1) * residual)


def pinball_rounded(actual: Column, predicted: Column, alpha) -> Column:
    """Report loss: demand is whole, so the prediction is rounded half to even first."""
    return pinball(actual, F.bround(predicted, 0), alpha)
