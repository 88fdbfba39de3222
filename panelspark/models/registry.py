"""Model types by name. A user adds one with :func:`register`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from panelspark.models import empirical, linear, trees
from panelspark.operators import quantiles


@dataclass(frozen=True)
class Setup:
    """What a model gets to know besides its rows."""

    keys: list[str]
    alphas: list[float] | None
    features: list[str]
    target: str
    params: dict
    id_col: str = "bdID"


@dataclass(frozen=True)
class ModelType:
    """A pair of functions.

    ``fit(train, setup)`` returns a table of fitted models or any object;
    ``predict(rows, fitted, setup)`` returns long rows with ``quantile_level`` (null
    without levels) and ``prediction``. ``fit_predict(rows, setup)`` may do both at once
    for frames with a ``split`` column and then returns the test rows only, or ``None``
    where it does not apply. ``as_table(fitted, setup)`` gives models as rows for a release,
    ``from_table(table, setup)`` takes them back.
    """

    fit: Callable[[DataFrame, Setup], Any] | None
    predict: Callable[[DataFrame, Any, Setup], DataFrame] | None
    requires_quantile: bool = False
    search_space: tuple = ()
    fit_predict: Callable[[DataFrame, Setup], DataFrame | None] | None = None
    as_table: Callable[[Any, Setup], DataFrame] | None = None
    from_table: Callable[[DataFrame, Setup], Any] = lambda table, setup: table
    description: str = ""


_TYPES: dict[str, ModelType] = {}


def register(name: str, model: ModelType) -> None:
    _TYPES[name] = model


def get(name: str) -> ModelType:
    if name not in _TYPES:
        raise ValueError(f"unknown model type {name!r}; known: {', '.join(sorted(_TYPES))}")
    return _TYPES[name]


def available() -> dict[str, str]:
    return {name: m.description for name, m in sorted(_TYPES.items())}


def from_ml(estimator, description: str = "") -> ModelType:
    """A Spark ML estimator or pipeline stage as a model type for all rows.

    Features are assembled into the estimator's features column and parameters of the same name as one of its own are set on a copy; the
    fitted object is a ``PipelineModel``, which has ML's own saving and loading. Predictions come from its prediction column.
    """
    def fit(train, s):
        if s.keys:
            raise ValueError("an ML estimator is fitted for all rows")
        own = estimator.copy()
        for name, value in s.params.items():
            if own.hasParam(name):
                own.set(own.getParam(name), value)
        own.set(own.getParam("labelCol"), s.target)
        return Pipeline(stages=[VectorAssembler(inputCols=list(s.features), outputCol=own.getOrDefault("featuresCol")), own]).fit(train)

    def predict(rows, fitted, s):
        last = fitted.stages[-1]
        scored = fitted.transform(rows).withColumnRenamed(last.getOrDefault("predictionCol"), "prediction")
        return scored.drop(last.getOrDefault("featuresCol")).withColumn("quantile_level", F.lit(None).cast("double"))

    return ModelType(fit, predict, description=description)


def _empirical_predict(rows, fitted, s):
    return quantiles.by_level(empirical.predict(rows, fitted, s.keys), s.alphas, name="prediction")


def _empirical_both(rows, s):
    if not s.keys:
        return None
    return quantiles.by_level(
        empirical.fit_predict_series(rows, s.keys, s.alphas, s.target), s.alphas, name="prediction")


def _empirical_from_table(table, s):
    levels = F.sort_array(F.collect_list(F.struct("quantile_level", "value")))
    return table.groupBy(*s.keys).agg(F.transform(levels, lambda x: x["value"]).alias("quantiles"))


register("empirical_quantile", ModelType(
    fit=lambda train, s: empirical.fit(train, s.keys, s.alphas, s.target),
    predict=_empirical_predict, fit_predict=_empirical_both, requires_quantile=True,
    as_table=lambda fitted, s: quantiles.by_level(fitted, s.alphas), from_table=_empirical_from_table,
    description="constant quantile of the train targets"))


def _linear_fit(train, s):
    options = {k: s.params[k] for k in ("max_iter", "p_tol", "method") if k in s.params}
    return linear.fit(train, s.keys, s.alphas, s.features, s.target, **options)


register("linear_quantile", ModelType(
    fit=_linear_fit, predict=lambda rows, fitted, s: linear.predict(rows, fitted, s.keys, s.features),
    requires_quantile=True, as_table=lambda fitted, s: fitted,
    description="linear quantile regression with intercept"))


def _tree_predict(rows, table, s):
    return trees.predict(rows, table, s.keys, s.features, s.target, s.id_col)


def _gbt_fit(train, s):
    if s.keys:
        return trees.fit_series(train, s.keys, s.alphas, s.features, s.target, s.params)
    return trees.fit_regression(train, s.features, s.target, s.params)


def _gbt_quantile_fit(train, s):
    return _gbt_fit(train, s) if s.keys else trees.fit_levels(train, s.alphas, s.features, s.target, s.params)


register("gbt_regress", ModelType(
    fit=_gbt_fit, predict=_tree_predict, search_space=trees.SEARCH_SPACE, as_table=lambda fitted, s: fitted,
    description="boosted trees, squared loss"))
register("gbt_quantile", ModelType(
    fit=_gbt_quantile_fit, predict=_tree_predict, requires_quantile=True,
    search_space=trees.SEARCH_SPACE, as_table=lambda fitted, s: fitted,
    description="boosted trees, pinball loss"))
