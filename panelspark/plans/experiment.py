"""Experiments: fit, predict and score every model and level, or tune."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.config import SKU_KEYS, DataConfig, ModelConfig, Strategy, check_skus
from panelspark.functions import labels
from panelspark.models import registry
from panelspark.models.registry import Setup
from panelspark.operators import filters, metrics, sampling, summaries
from panelspark.plans import prepare, tuning
from panelspark.session import materialize
from panelspark.sources import columnar, release

_NOT_FEATURES = ("split", "split_date")


def feature_names(rows: DataFrame, data: DataConfig | None = None) -> list[str]:
    """Columns that are neither metadata nor the configured id, date and target."""
    named = (data.id_column, data.date_column, data.target_column) if data else ()
    return [c for c in filters.feature_columns(rows) if c not in (*_NOT_FEATURES, *named)]


def setup_of(rows: DataFrame, config: ModelConfig, strategy: Strategy, target: str = "target",
             features: list[str] | None = None, id_col: str = "bdID") -> Setup:
    """What the model type needs to know; without a list, every column that may be a feature is one."""
    model = registry.get(config.model_type)
    if model.requires_quantile and not config.is_quantile_model:
        raise ValueError(f"{config.model_type} needs quantile levels")
    names = features or [c for c in feature_names(rows) if c not in (target, id_col)]
    alphas = config.quantile_alphas if model.requires_quantile else None
    return Setup(strategy.keys, alphas, names, target, config.settings, id_col)


def fit(rows: DataFrame, model_type: str, setup: Setup) -> Any:
    """Fitted models; a table of them is written once, so that no later read fits again."""
    fitted = registry.get(model_type).fit(rows.where(F.col("split") == "train"), setup)
    return materialize(fitted, "models") if isinstance(fitted, DataFrame) else fitted


def fit_predict(rows: DataFrame, model_type: str, setup: Setup) -> tuple[Any, DataFrame]:
    """Fitted models and predictions of the test rows, for all models and levels at once.

    The fitted part is ``None`` for model types that fit and predict in one step.
    """
    model = registry.get(model_type)
    if model.fit_predict is not None:
        predicted = model.fit_predict(rows, setup)
        if predicted is not None:
            return None, predicted
    fitted = fit(rows, model_type, setup)
    return fitted, model.predict(rows.where(F.col("split") == "test"), fitted, setup)


def predict_saved(spark: SparkSession, path: str, rows: DataFrame, model_type: str, setup: Setup) -> DataFrame:
    """Predictions of models that a release wrote below ``path``/model_params."""
    saved = spark.read.parquet(f"{path}/model_params").where(F.col("model_type") == model_type).drop("model_type")
    if "quantile_level" in saved.columns:  # a folder name
        saved = saved.withColumn("quantile_level", F.col("quantile_level").cast("double"))
    model = registry.get(model_type)
    return model.predict(rows, model.from_table(saved, setup), setup)


def score(predicted: DataFrame, config: ModelConfig, strategy: Strategy, target: str = "target") -> DataFrame:
    """One row per model and level with its metrics and identity."""
    by_level = registry.get(config.model_type).requires_quantile
    families = ("quantile",) if by_level else ("regression",)
    scored = metrics.score(predicted, [*strategy.keys, "quantile_level"], families, actual=target)
    return scored.withColumns({"model_type": F.lit(config.model_type), "modeling_strategy": F.lit(strategy.value)})


def split_facts(rows: DataFrame, strategy: Strategy, date_col: str = "date") -> DataFrame:
    """Per model the first test day and how many rows it was fitted and scored on."""
    train, test = F.col("split") == "train", F.col("split") == "test"
    return rows.groupBy(*strategy.keys).agg(
        F.min(F.when(test, F.col(date_col).cast("date"))).alias("split_date"),
        F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test"))


@dataclass
class ExperimentResults:
    """Tables of an experiment: one row per model, test predictions, fitted models."""

    experiment_name: str
    config: ModelConfig
    strategy: Strategy
    predictions: DataFrame | None
    results: DataFrame | None
    fitted: Any
    rows: DataFrame
    setup: Setup

    @property
    def skus(self) -> DataFrame:
        return sampling.distinct_skus(self.rows)

    def models(self) -> DataFrame | None:
        """Fitted models as rows; ``None`` for model types that are not tables."""
        model = registry.get(self.config.model_type)
        if model.as_table is None:
            return None
        if self.fitted is None:
            self.fitted = fit(self.rows, self.config.model_type, self.setup)
        return model.as_table(self.fitted, self.setup).withColumn("model_type", F.lit(self.config.model_type))

    @property
    def metric_names(self) -> list[str]:
        known = ("mse", "rmse", "mae", "mean_quantile_loss")
        return [c for c in known if c in self.results.columns]

    @property
    def release_metric(self) -> str:
        """The mean quantile loss where there is one, else rmse."""
        return "mean_quantile_loss" if "mean_quantile_loss" in self.metric_names else "rmse"

    def performance_summary(self) -> DataFrame:
        long = summaries.unpivot_metrics(self.results, ["model_type"], self.metric_names)
        return summaries.performance_summary(long)

    def evaluation_summary(self) -> DataFrame:
        long = summaries.unpivot_metrics(self.results, ["model_type"], self.metric_names)
        return summaries.performance_summary(long, with_std=True).withColumns(
            {"model_types": F.lit(self.config.model_type), "strategies": F.lit(self.strategy.value)})

    def identified(self) -> DataFrame:
        """Results with a readable model id."""
        n_skus = F.lit(1) if self.strategy is Strategy.INDIVIDUAL else self.skus.agg(F.count("*").alias("n")).scalar()
        own = self.strategy is Strategy.INDIVIDUAL
        product = F.col("productID") if own else F.lit(None).cast("int")
        store = F.col("storeID") if own else F.lit(None).cast("int")
        label = labels.model_id(
            F.col("model_type"), F.col("modeling_strategy"), n_skus, product, store, F.col("quantile_level"))
        return self.results.withColumn("model_id", label)

    def release(self, path: str) -> str:
        """Write bundle, members, metrics and, where models are rows, the models."""
        named = self.results
        if self.strategy is Strategy.COMBINED:
            named = named.withColumn("sku_key", combined_label(self.skus))
        return release.write_release(
            named, self.skus, self.models(), path, self.experiment_name, self.config.settings, self.release_metric)


def combined_label(skus: DataFrame):
    """Label of a model of all SKUs; it names two of them, so three are enough."""
    first = skus.orderBy(*SKU_KEYS).limit(3).agg(
        F.array_sort(F.collect_list(F.struct(*SKU_KEYS))).alias("s"))
    return first.select(labels.sku_key(F.col("s")).alias("k")).scalar()


def lookup(results: DataFrame, strategy: Strategy | None = None, quantile_only: bool = False,
           model_type: str | None = None) -> DataFrame:
    """Results of a strategy, of quantile models, or of one model type."""
    if strategy is not None:
        results = results.where(F.col("modeling_strategy") == strategy.value)
    if quantile_only:
        results = results.where(F.col("quantile_level").isNotNull())
    if model_type is not None:
        results = results.where(F.col("model_type") == model_type)
    return results


class ForecastBench:
    """Runs experiments on one data configuration."""

    def __init__(self, spark: SparkSession, data: DataConfig):
        self.spark, self.data = spark, data

    def modeling_rows(self, skus, strategy: Strategy) -> DataFrame:
        raw, targets = columnar.load(self.spark, self.data)
        return prepare.modeling_frame(raw, targets, self.data, strategy, skus)

    def run_experiment(self, sku_tuples=None, modeling_strategy: Strategy = Strategy.COMBINED,
                       model_type: str = "", hyperparameters: dict | None = None,
                       quantile_alphas: list[float] | None = None, experiment_name: str = "experiment",
                       evaluate_on_test: bool = True, mode: str = "train", tune_on: int | None = None,
                       tuning_config: dict | None = None, random_state: int = 42):
        """Train and score, or tune.

        ``sku_tuples`` is a list of pairs, a frame of SKUs, or ``None`` for every SKU.
        """
        if mode not in ("train", "hp_tune"):
            raise ValueError(f"unknown mode {mode!r}: an experiment either trains or runs hp_tune")
        if sku_tuples is not None and not isinstance(sku_tuples, DataFrame):
            check_skus(sku_tuples)
        if mode == "hp_tune":
            if tune_on is None:
                raise ValueError("tune_on is needed for tuning")
            return self._tune(sku_tuples, model_type, quantile_alphas, tune_on, tuning_config or {}, random_state)
        if hyperparameters is None:
            raise ValueError("hyperparameters are needed for training")
        config = ModelConfig(model_type, dict(hyperparameters), quantile_alphas, random_state)
        target = self.data.target_column
        # Written once: fitting, prediction, labels and the release all read it.
        rows = materialize(self.modeling_rows(sku_tuples, modeling_strategy), "rows")
        setup = setup_of(rows, config, modeling_strategy, target, feature_names(rows, self.data), self.data.id_column)
        if not evaluate_on_test:
            fitted = fit(rows, model_type, setup)
            return ExperimentResults(experiment_name, config, modeling_strategy, None, None, fitted, rows, setup)
        fitted, predicted = fit_predict(rows, model_type, setup)
        # Written once: whatever is read from them later, models are not fitted again.
        predicted = materialize(predicted, "predictions")
        facts = split_facts(rows, modeling_strategy, self.data.date_column)
        results = score(predicted, config, modeling_strategy, target)
        results = results.join(facts, modeling_strategy.keys, "left") if modeling_strategy.keys else results.withColumns(
            {c: facts.select(c).scalar() for c in facts.columns})
        results = materialize(results, "results")
        return ExperimentResults(
            experiment_name, config, modeling_strategy, predicted, results, fitted, rows, setup)

    def _tune(self, sku_tuples, model_type, alphas, tune_on, settings, seed):
        """Always one model over a sample of SKUs, at the first level only."""
        raw, _ = columnar.load(self.spark, self.data)
        pool = raw if sku_tuples is None else filters.sku_tuples(raw, sku_tuples)
        chosen = sampling.sample_skus(pool, tune_on, seed)
        rows = self.modeling_rows(chosen, Strategy.COMBINED).where(F.col("split") == "train")
        return tuning.random_search(
            rows, model_type, feature_names(rows, self.data), alphas[0] if alphas else None, self.data.target_column,
            settings.get("n_trials", 50), settings.get("n_folds", 3), seed,
            settings.get("n_jobs", 1), settings.get("fixed"), sampling.distinct_skus(chosen).count(), self.data.id_column)
