"""Cross-validation and random search."""

from __future__ import annotations

import random
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

import numpy as np
import pandas as pd

from panelspark.config import check_alphas
from panelspark.functions.losses import pinball
from panelspark.models import registry, trees
from panelspark.models.registry import Setup
from panelspark.operators.quantiles import counted_quantiles
from panelspark.operators.sampling import equal_folds, kfold
from panelspark.session import materialize

# A sample of SKUs with at most so many rows and numbers is sent whole to the task of each trial and fold.
SHARED_ROWS, SHARED_NUMBERS = 200_000, 4_000_000
# Of the trials, and of each one's rounds, this share goes on at every rung but the last.
RUNGS = (1 / 9, 1 / 3, 1.0)


def cv_empirical(train: DataFrame, k: int, seed: int, alphas, target: str = "target",
                 id_col: str = "bdID") -> DataFrame:
    """Loss of the empirical quantile per level and held-out fold.

    Fold and value are counted once; fitting and scoring work on the counts, so rows are
    never copied per fold.
    """
    alphas = check_alphas(alphas)
    counts = (
        kfold(train, k, seed, id_col).where(F.col(target).isNotNull())
        .groupBy("fold", F.col(target).cast("double").alias("v")).agg(F.count("*").alias("n"))
    )
    folds = F.array(*[F.lit(i) for i in range(k)])
    fitting = (
        counts.withColumn("held", F.explode(folds)).where(F.col("held") != F.col("fold"))
        .groupBy("held", "v").agg(F.sum("n").alias("n"))
    )
    models = counted_quantiles(fitting, ["held"], "v", "n", alphas)
    scored = counts.withColumnRenamed("fold", "held").join(models, "held")
    total = F.sum("n")
    losses = F.array(*[
        F.struct(F.lit(a).alias("quantile_level"),
                 (F.sum(F.col("n") * pinball(F.col("v"), F.col("quantiles")[i], a)) / total).alias("loss"))
        for i, a in enumerate(alphas)
    ])
    return scored.groupBy("held").agg(losses.alias("l"), total.alias("n_rows")).select(
        F.col("held").alias("fold"), "n_rows", F.inline("l"))


@dataclass(frozen=True)
class TuningResult:
    """Best parameters, their loss, and the table of all trials."""

    best_params: dict
    best_score: float
    n_trials: int
    n_folds: int
    model_type: str
    quantile_alpha: float | None
    n_skus_sampled: int
    optimization_time: float
    trials: DataFrame


def draw_trials(space, n_trials: int, seed: int, fixed: dict | None = None) -> list[dict]:
    """Seeded random draws from ``(name, low, high, whole)`` ranges; fixed values win."""
    if not space:
        raise NotImplementedError("this model type has no search space")
    draw = random.Random(seed)
    trials = []
    for _ in range(n_trials):
        params = {
            name: draw.randint(int(low), int(high)) if whole else draw.uniform(low, high)
            for name, low, high, whole in space
        }
        trials.append({**params, "seed": seed, **(fixed or {})})
    return trials


def random_search(train: DataFrame, model_type: str, features: list[str], alpha: float | None = None,
                  target: str = "target", n_trials: int = 50, n_folds: int = 3, seed: int = 42,
                  parallelism: int = 1, fixed: dict | None = None, n_skus: int = 0,
                  id_col: str = "bdID") -> TuningResult:
    """Mean validation loss of each trial over the folds; the lowest wins.

    Folds have equal sizes and are written once. Boosted trees on a sample that fits a task share its folds: a task fits one
    trial on one fold, and after a ninth and a third of their rounds only the best third of the trials go on; a trial's loss is
    its lowest at these points, its ``n_estimators`` the rounds there. All else runs as independent Spark jobs, ``parallelism``
    at a time.
    """
    began = time.time()
    model = registry.get(model_type)
    if model.requires_quantile and alpha is None:
        raise ValueError(f"{model_type} needs a quantile level")
    trials = draw_trials(model.search_space, n_trials, seed, fixed)
    rows = materialize(equal_folds(train.select(id_col, target, *features), n_folds, seed, id_col), "folds")
    if model_type in ("gbt_regress", "gbt_quantile") and _fits_a_task(rows, features):
        table = _halving(rows, trials, features, target, alpha, n_folds)
        best = table.orderBy("loss", "trial").first()
        params = {**trials[best["trial"]], "n_estimators": int(best["params"]["n_estimators"])}
        return TuningResult(params, best["loss"], n_trials, n_folds, model_type, alpha, n_skus, time.time() - began, table)

    def loss_of(task):
        number, params, fold = task
        setup = Setup([], [alpha] if alpha is not None else None, features, target, params)
        fitted = model.fit(rows.where(F.col("fold") != fold), setup)
        scored = model.predict(rows.where(F.col("fold") == fold), fitted, setup)
        y, p = F.col(target), F.col("prediction")
        loss = pinball(y, p, alpha) if alpha is not None else (y - p) * (y - p)
        return number, fold, scored.agg(F.avg(loss)).first()[0]

    tasks = [(i, params, fold) for i, params in enumerate(trials) for fold in range(n_folds)]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        scores = list(pool.map(loss_of, tasks))
    spark = train.sparkSession
    table = spark.createDataFrame(scores, "trial int, fold int, loss double").groupBy("trial").agg(
        F.avg("loss").alias("loss"))
    settings = spark.createDataFrame(
        [(i, {k: float(v) for k, v in p.items()}) for i, p in enumerate(trials)],
        "trial int, params map<string,double>")
    table = table.join(settings, "trial")
    best = table.orderBy("loss", "trial").first()
    return TuningResult(trials[best["trial"]], best["loss"], n_trials, n_folds, model_type, alpha,
                        n_skus, time.time() - began, table)


def _fits_a_task(rows: DataFrame, features: list[str]) -> bool:
    n = rows.count()
    return n <= SHARED_ROWS and n * len(features) <= SHARED_NUMBERS


def _halving(rows: DataFrame, trials: list[dict], features: list[str], target: str, alpha: float | None, n_folds: int) -> DataFrame:
    """trial, loss, params and rung (how many rungs it took): trials of boosted trees, the worse dropped at each rung."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(rows.orderBy(rows.columns[0]).toPandas()[["fold", target, *features]].to_numpy(float))

    def run(batches):
        data = sent.value
        fold, y, x = data[:, 0], data[:, 1], data[:, 2:]
        for tasks in batches:
            out = []
            for t in tasks.to_dict("records"):
                fit, held = fold != t["fold"], fold == t["fold"]
                bins, borders = trees._bins(x[fit])
                nodes = np.array(trees._boost_series(bins, borders, y[fit], alpha, t["rounds"], trees.settings_of(t["params"]), np.flatnonzero(fit)), float)
                r = y[held] - trees._evaluate(nodes, x[held])
                loss = r * r if alpha is None else np.where(r >= 0, alpha * r, (alpha - 1) * r)
                out.append((t["trial"], t["fold"], t["rounds"], float(loss.mean())))
            yield pd.DataFrame(out, columns=["trial", "fold", "rounds", "loss"])

    live, best = list(range(len(trials))), {}
    for rung, share in enumerate(RUNGS, 1):
        rounds = {i: max(1, int(np.ceil(share * trees.rounds_of(trials[i])))) for i in live}
        asked = [(i, f, rounds[i], {k: float(v) for k, v in trials[i].items()}) for f in range(n_folds) for i in live]
        jobs = spark.createDataFrame(asked, "trial int, fold int, rounds int, params map<string,double>")
        scored = jobs.repartitionByRange(len(asked), "fold", "trial").mapInPandas(run, "trial int, fold int, rounds int, loss double")
        losses = {r["trial"]: r["loss"] for r in scored.groupBy("trial").agg(F.avg("loss").alias("loss")).collect()}
        for i in live:
            if i not in best or losses[i] < best[i][0]:
                best[i] = (losses[i], rounds[i], rung)
        if rung < len(RUNGS):
            live = sorted(live, key=lambda i: (losses[i], i))[:max(1, -(-len(live) // 3))]
    sent.unpersist()
    found = [(i, loss, {**{k: float(v) for k, v in trials[i].items()}, "n_estimators": float(n)}, rung) for i, (loss, n, rung) in sorted(best.items())]
    return spark.createDataFrame(found, "trial int, loss double, params map<string,double>, rung int")
