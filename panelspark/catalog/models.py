"""Model operators, experiments and tuning.

Iterative fits have no SQL twin: their queries return check tables that a test reads, and one-round
cases with a closed form stand beside them.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from panelspark.catalog.base import (
    ALPHAS, LEVEL_LIST, SEED, SPLIT_DATE, experiment_results, modeling, pinball_sql, predictions, prepared, query,
    rounded, with_ctes, written_panel,
)
from panelspark.catalog.selections import N_FOLDS, _FOLD
from panelspark.config import SKU_KEYS, DataConfig, ModelConfig, Strategy
from panelspark.functions.losses import pinball
from panelspark.models import empirical, linear, registry
from panelspark.models.registry import ModelType, Setup
from panelspark.operators import quantiles, sampling
from panelspark.plans import experiment, tuning
from panelspark.session import scratch_path

FEATURES = ["price", "disc", *[f"target_lag_{k}" for k in range(1, 8)]]
TREES = {"n_estimators": 10, "max_depth": 3, "eta": 0.3}


def _run(rows, model_type, strategy, alphas=None, **params):
    """Predictions of the test rows under one model type."""
    config = ModelConfig(model_type, params, alphas)
    setup = experiment.setup_of(rows, config, strategy, features=FEATURES)
    return experiment.fit_predict(rows, model_type, setup)[1], config


@query(with_ctes(f"""
    SELECT productID, storeID, quantile_level, mean_quantile_loss, 'empirical_quantile' AS model_type,
           'individual' AS modeling_strategy FROM individual_results
    UNION ALL
    SELECT NULL, NULL, quantile_level,
           round(avg({pinball_sql('m.target', 'f.q', 'quantile_level')}), 6), 'empirical_quantile', 'combined'
    FROM modeling m, model_combined f WHERE m.split = 'test' GROUP BY quantile_level""",
    "individual_results", "model_combined"))
def fit_predict_all(spark, sf):
    """Both strategies of one model type over all SKUs and levels."""
    rows = prepared(spark, sf)
    own, config = _run(rows, "empirical_quantile", Strategy.INDIVIDUAL, ALPHAS)
    both, _ = _run(rows, "empirical_quantile", Strategy.COMBINED, ALPHAS)
    one = rounded(experiment.score(both, config, Strategy.COMBINED), six=["mean_quantile_loss"])
    many = rounded(experiment.score(own, config, Strategy.INDIVIDUAL), "mean_quantile_loss")
    return many.unionByName(one, allowMissingColumns=True)


@query(with_ctes(f"""
    SELECT CAST(held AS INTEGER) AS fold, quantile_level, count(*) AS n_rows,
           round(avg({pinball_sql('target', 'q', 'quantile_level', rounded=False)}), 6) AS loss
    FROM rows_ JOIN models ON fold = held GROUP BY held, quantile_level""", "modeling",
    rows_=f"SELECT target, {_FOLD.format(seed=SEED, k=N_FOLDS)} AS fold FROM modeling WHERE split = 'train'",
    models=f"SELECT held, unnest({LEVEL_LIST}) AS quantile_level, unnest(quantile_cont(target::DOUBLE, {LEVEL_LIST})) "
           f"AS q FROM rows_, range({N_FOLDS}) h(held) WHERE fold <> held GROUP BY held"))
def kfold_cv_quantile(spark, sf):
    train = modeling(spark, sf).where(F.col("split") == "train")
    return rounded(tuning.cv_empirical(train, N_FOLDS, SEED, ALPHAS), six=["loss"])


def _quantile_check(scored, constant):
    """Per level: loss and coverage of a model beside the constant quantile's loss."""
    y, p, a = F.col("target"), F.col("prediction"), F.col("quantile_level")

    def losses(df, name):
        return df.groupBy("quantile_level").agg(
            F.count("*").alias(f"n_{name}"), F.avg(pinball(y, p, a)).alias(f"loss_{name}"),
            F.avg((y <= p).cast("double")).alias(f"coverage_{name}"))

    return losses(scored, "model").join(losses(constant, "constant"), "quantile_level")


def _on_train(rows):
    """Rows that are both fitted and scored, to compare losses on the rows a fit saw."""
    train = rows.where(F.col("split") == "train")
    return train, train.withColumn("split", F.lit("test"))


def _linear(train, features, keys=()):
    """Scored train rows with the gap of their model, and the fitted models."""
    setup = Setup(list(keys), ALPHAS, features, "target", {})
    model = registry.get("linear_quantile")
    fitted = model.fit(train, setup)
    return model.predict(train, fitted, setup), fitted


@query()
def linear_quantile_losses(spark, sf):
    """One linear model per level over all rows, beside the constant quantile."""
    train, seen = _on_train(prepared(spark, sf))
    constant = quantiles.by_level(
        empirical.predict(seen, empirical.fit(train, [], ALPHAS), []), ALPHAS, name="prediction")
    return _quantile_check(_linear(train, FEATURES)[0], constant)


@query(with_ctes(f"""
    SELECT quantile_level, count(*) AS n_rows, round(avg({pinball_sql('target', 'q', 'quantile_level', rounded=False)}), 6) AS loss_constant,
           true AS gap_ok, true AS below_constant, true AS share_ok
    FROM modeling m, model_combined f WHERE m.split = 'train' GROUP BY quantile_level""", "modeling", "model_combined"))
def linear_quantile_fit(spark, sf):
    """One linear model per level over all rows: is each proven to have the least loss?

    gap_ok: the duality gap is at most a millionth of the loss. share_ok: as the least loss needs, at most a share alpha of the rows
    lie below the plane and at least that share below or on it.
    """
    train = _on_train(prepared(spark, sf))[0]
    scored, fitted = _linear(train, FEATURES)
    y, p, a = F.col("target"), F.col("prediction"), F.col("quantile_level")
    constant = quantiles.by_level(empirical.predict(train, empirical.fit(train, [], ALPHAS), []), ALPHAS, name="prediction").groupBy(
        "quantile_level").agg(F.avg(pinball(y, p, a)).alias("loss_constant"))
    seen = scored.groupBy("quantile_level").agg(
        F.count("*").alias("n_rows"), F.avg(pinball(y, p, a)).alias("loss"), F.avg((y < p - 1e-5).cast("double")).alias("below"),
        F.avg((y <= p + 1e-5).cast("double")).alias("reached"))
    table = seen.join(constant, "quantile_level").join(fitted.select("quantile_level", "gap"), "quantile_level")
    return rounded(table.select(
        "quantile_level", "n_rows", "loss_constant", (F.col("gap") <= 1e-6).alias("gap_ok"),
        (F.col("loss") <= F.col("loss_constant")).alias("below_constant"), ((F.col("below") <= a) & (F.col("reached") >= a)).alias("share_ok")),
        six=["loss_constant"])


# With one 0/1 feature the least loss is that of each side's own quantile, an order statistic.
@query(with_ctes(f"""
    SELECT quantile_level, count(*) AS n_rows, round(avg({pinball_sql('f.target', 's.q', 'quantile_level', rounded=False)}), 6) AS loss, true AS gap_ok
    FROM flagged f JOIN (SELECT flag, unnest({LEVEL_LIST}) AS quantile_level, unnest(quantile_disc(target::DOUBLE, {LEVEL_LIST})) AS q
                         FROM flagged GROUP BY flag) s USING (flag) GROUP BY quantile_level""", "modeling",
    flagged="SELECT *, target_lag_1 > 25 AS flag FROM modeling WHERE split = 'train'"))
def linear_quantile_two_sides(spark, sf):
    """The least loss over all rows where it has a closed form."""
    train = _on_train(prepared(spark, sf))[0].withColumn("flag", (F.col("target_lag_1") > 25).cast("double"))
    scored, fitted = _linear(train, ["flag"])
    loss = scored.groupBy("quantile_level").agg(
        F.count("*").alias("n_rows"), F.avg(pinball(F.col("target"), F.col("prediction"), F.col("quantile_level"))).alias("loss"))
    return rounded(loss.join(fitted.select("quantile_level", (F.col("gap") <= 1e-6).alias("gap_ok")), "quantile_level"), six=["loss"])


@query(with_ctes(f"""
    SELECT productID, storeID, quantile_level, count(*) AS n_rows,
           round(avg({pinball_sql('f.target', 's.q', 'quantile_level', rounded=False)}) + 3e-7, 6) AS loss, true AS gap_ok
    FROM flagged f JOIN (SELECT productID, storeID, flag, unnest({LEVEL_LIST}) AS quantile_level,
                                unnest(quantile_disc(target::DOUBLE, {LEVEL_LIST})) AS q
                         FROM flagged GROUP BY productID, storeID, flag) s USING (productID, storeID, flag)
    JOIN (SELECT productID, storeID FROM flagged GROUP BY ALL HAVING count(*) > 3 AND min(target) < max(target)) USING (productID, storeID)
    GROUP BY ALL""", "modeling", flagged="SELECT *, target_lag_1 > 25 AS flag FROM modeling WHERE split = 'train'"))
def linear_quantile_two_sides_individual(spark, sf):
    """The same for every SKU with more than three rows that differ; short means end on a rounding edge, so all are moved off it."""
    train = _on_train(prepared(spark, sf))[0].withColumn("flag", (F.col("target_lag_1") > 25).cast("double"))
    varied = train.groupBy(*SKU_KEYS).agg(F.count("*").alias("n"), F.min("target").alias("low"), F.max("target").alias("high")).where(
        (F.col("n") > 3) & (F.col("low") < F.col("high")))
    scored, fitted = _linear(train.join(varied.select(*SKU_KEYS), list(SKU_KEYS), "left_semi"), ["flag"], SKU_KEYS)
    loss = scored.groupBy(*SKU_KEYS, "quantile_level").agg(
        F.count("*").alias("n_rows"), F.avg(pinball(F.col("target"), F.col("prediction"), F.col("quantile_level"))).alias("loss"))
    ok = fitted.select(*SKU_KEYS, "quantile_level", (F.col("gap") <= 1e-6).alias("gap_ok"))
    return rounded(loss.join(ok, [*SKU_KEYS, "quantile_level"]).withColumn("loss", F.col("loss") + 3e-7), six=["loss"])


@query()
def linear_quantile_fit_individual(spark, sf):
    """One linear model per SKU and level, beside the SKU's constant quantile."""
    train, seen = _on_train(prepared(spark, sf))
    setup = Setup(list(SKU_KEYS), ALPHAS, FEATURES, "target", {})
    model = registry.get("linear_quantile")
    scored = model.predict(seen, model.fit(train, setup), setup)
    constant = quantiles.by_level(
        empirical.predict(seen, empirical.fit(train, list(SKU_KEYS), ALPHAS), list(SKU_KEYS)),
        ALPHAS, name="prediction")
    return _quantile_check(scored, constant)


@query(with_ctes("""
    SELECT m.bdID, 0.5::DOUBLE AS quantile_level, round(b0 + b1 * m.target_lag_1, 6) AS prediction
    FROM modeling m JOIN line USING (productID, storeID) WHERE m.split = 'test'""", "modeling",
    line="SELECT productID, storeID, regr_slope(target, target_lag_1) AS b1, "
         "regr_intercept(target, target_lag_1) AS b0 FROM modeling WHERE split = 'train' "
         "GROUP BY productID, storeID HAVING min(target_lag_1) < max(target_lag_1)"))
def linear_quantile_predict(spark, sf):
    """Predictions from given coefficients: here the least-squares line on the last value.

    A line needs a last value that varies, so SKUs without one have no model.
    """
    rows, keys = prepared(spark, sf), list(SKU_KEYS)
    line = (
        rows.where(F.col("split") == "train").groupBy(*keys)
        .agg(F.regr_slope("target", "target_lag_1").alias("b1"),
             F.regr_intercept("target", "target_lag_1").alias("intercept"),
             F.min("target_lag_1").alias("low"), F.max("target_lag_1").alias("high"))
        .where(F.col("low") < F.col("high"))
        .select(*keys, F.lit(0.5).alias("quantile_level"), "intercept", F.array("b1").alias("coefficients"))
    )
    scored = linear.predict(rows.where(F.col("split") == "test"), line, keys, ["target_lag_1"])
    return rounded(scored.select("bdID", "quantile_level", "prediction"), six=["prediction"])


def _regression_check(scored, rows):
    """Squared error of a model beside the train mean's, on the same test rows."""
    mean = rows.where(F.col("split") == "train").agg(F.avg("target")).scalar()
    y, p = F.col("target"), F.col("prediction")
    return scored.agg(
        F.count("*").alias("n_rows"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse_model"),
        F.sqrt(F.avg((y - mean) * (y - mean))).alias("rmse_mean"))


@query()
def gbt_regress_losses(spark, sf):
    rows = prepared(spark, sf)
    return _regression_check(_run(rows, "gbt_regress", Strategy.COMBINED, **TREES)[0], rows)


@query(with_ctes("""
    SELECT count(*) AS n_rows, round(stddev_pop(target), 6) AS rmse_mean, true AS below_mean, true AS mean_kept
    FROM modeling WHERE split = 'train'""", "modeling"))
def gbt_regress(spark, sf):
    """Boosted trees on the rows they saw: closer than the mean, and right on average, as steps of leaf means keep it."""
    train, seen = _on_train(prepared(spark, sf))
    scored = _run(train.unionByName(seen), "gbt_regress", Strategy.COMBINED, **TREES)[0]
    y, p = F.col("target"), F.col("prediction")
    table = scored.agg(F.count("*").alias("n_rows"), F.stddev_pop(y).alias("rmse_mean"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
                       F.avg(y - p).alias("bias"))
    return rounded(table.select("n_rows", "rmse_mean", (F.col("rmse") < F.col("rmse_mean")).alias("below_mean"),
                                (F.abs("bias") < 1e-6).alias("mean_kept")), six=["rmse_mean"])


@query()
def gbt_regress_individual(spark, sf):
    rows = prepared(spark, sf)
    scored, _ = _run(rows, "gbt_regress", Strategy.INDIVIDUAL, min_child_weight=5, **TREES)
    return _regression_check(scored, rows)


@query()
def gbt_quantile_losses(spark, sf):
    """Boosted trees of five levels over all rows, beside the constant quantile."""
    train, seen = _on_train(prepared(spark, sf))
    scored, _ = _run(train.unionByName(seen), "gbt_quantile", Strategy.COMBINED, ALPHAS, **TREES)
    constant = quantiles.by_level(
        empirical.predict(seen, empirical.fit(train, [], ALPHAS), []), ALPHAS, name="prediction")
    return _quantile_check(scored, constant)


@query(with_ctes(f"""
    SELECT quantile_level, count(*) AS n_rows, round(avg({pinball_sql('target', 'q', 'quantile_level', rounded=False)}), 6) AS loss_constant,
           true AS below_constant, true AS share_ok
    FROM modeling m, model_combined f WHERE m.split = 'train' GROUP BY quantile_level""", "modeling", "model_combined"))
def gbt_quantile(spark, sf):
    """Boosted trees of five levels over all rows: losses below the constant quantile's, and each level's share of rows reached."""
    found = gbt_quantile_losses(spark, sf)
    return rounded(found.select(
        "quantile_level", F.col("n_model").alias("n_rows"), "loss_constant", (F.col("loss_model") < F.col("loss_constant")).alias("below_constant"),
        (F.abs(F.col("coverage_model") - F.col("quantile_level")) < 0.03).alias("share_ok")), six=["loss_constant"])


# Two 0/1 features cut twice leave four cells, whichever is cut first; each round goes half of what is left of the way from the
# whole quantile to a cell's own.
@query(with_ctes(f"""
    SELECT t.bdID, c.quantile_level, round(w.q + 0.75 * (c.q - w.q), 6) AS prediction
    FROM flagged t JOIN (SELECT flag, dear, unnest({LEVEL_LIST}) AS quantile_level, unnest(quantile_cont(target::DOUBLE, {LEVEL_LIST})) AS q
                         FROM flagged WHERE split = 'train' GROUP BY flag, dear) c USING (flag, dear)
    JOIN model_combined w USING (quantile_level) WHERE t.split = 'test'""", "modeling", "model_combined",
    flagged="SELECT *, target_lag_1 > 25 AS flag, price > 1500 AS dear FROM modeling"))
def gbt_quantile_two_rounds(spark, sf):
    rows = prepared(spark, sf).withColumns({"flag": (F.col("target_lag_1") > 25).cast("double"), "dear": (F.col("price") > 1500).cast("double")})
    config = ModelConfig("gbt_quantile", {"n_estimators": 2, "eta": 0.5, "max_depth": 2}, ALPHAS)
    setup = experiment.setup_of(rows, config, Strategy.COMBINED, features=["flag", "dear"])
    scored = experiment.fit_predict(rows, "gbt_quantile", setup)[1]
    return rounded(scored.select("bdID", "quantile_level", "prediction"), six=["prediction"])


# One round of one cut by a 0/1 feature, taken whole, has a closed form: the two sides' means or quantiles.
_FLAGGED = "SELECT *, target_lag_1 > 25 AS flag FROM modeling"
_ALONE = "CAST(NULL AS DOUBLE)"


def _one_cut(spark, sf, model_type, strategy, alphas=None, **penalties):
    rows = prepared(spark, sf).withColumn("flag", (F.col("target_lag_1") > 25).cast("double"))
    config = ModelConfig(model_type, {"n_estimators": 1, "eta": 1.0, "max_depth": 1, **penalties}, alphas)
    setup = experiment.setup_of(rows, config, strategy, features=["flag"])
    scored = experiment.fit_predict(rows, model_type, setup)[1]
    return rounded(scored.select("bdID", "quantile_level", "prediction"), six=["prediction"])


@query(with_ctes(f"""
    SELECT t.bdID, {_ALONE} AS quantile_level, round(m.p, 6) AS prediction FROM flagged t
    JOIN (SELECT flag, avg(target) AS p FROM flagged WHERE split = 'train' GROUP BY flag) m USING (flag)
    WHERE t.split = 'test'""", "modeling", flagged=_FLAGGED))
def gbt_regress_one_cut(spark, sf):
    return _one_cut(spark, sf, "gbt_regress", Strategy.COMBINED)


def _penalised(keys: str, l1: float, l2: float) -> str:
    """Each side's sum of residuals, shrunk by the L1 penalty, over its rows and the L2 penalty, on top of the mean."""
    by = f"{keys}, " if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    return with_ctes(f"""
    SELECT t.bdID, CAST(NULL AS DOUBLE) AS quantile_level, round(a.m + sign(g) * greatest(abs(g) - {l1}, 0) / (n + {l2}), 6) AS prediction
    FROM flagged t JOIN whole a {using}
    LEFT JOIN (SELECT {by}flag, sum(target - m) AS g, count(*) AS n FROM flagged JOIN whole {using} WHERE split = 'train' GROUP BY {by}flag) s
    USING ({by}flag) WHERE t.split = 'test' AND n IS NOT NULL""", "modeling", flagged=_FLAGGED,
    whole=f"SELECT {by}avg(target) AS m FROM flagged WHERE split = 'train' {'GROUP BY ' + keys if keys else ''}")


@query(_penalised("", 5000.0, 300.0))
def gbt_regress_penalties(spark, sf):
    return _one_cut(spark, sf, "gbt_regress", Strategy.COMBINED, reg_alpha=5000.0, reg_lambda=300.0)


@query(_penalised("productID, storeID", 20.0, 4.0))
def gbt_regress_penalties_individual(spark, sf):
    """Only rows of sides that the SKU's train rows have."""
    scored = _one_cut(spark, sf, "gbt_regress", Strategy.INDIVIDUAL, reg_alpha=20.0, reg_lambda=4.0)
    rows = prepared(spark, sf).withColumn("flag", F.col("target_lag_1") > 25)
    sides = rows.where(F.col("split") == "train").select(*SKU_KEYS, "flag").distinct()
    return scored.join(rows.join(sides, [*SKU_KEYS, "flag"], "left_semi").select("bdID"), "bdID", "left_semi")


_ONE_CUT_OF_SKUS = """
    SELECT t.bdID, {level} AS quantile_level, round(coalesce(g.p, a.p), 6) AS prediction FROM flagged t
    JOIN whole a USING (productID, storeID)
    LEFT JOIN sides g ON g.productID = t.productID AND g.storeID = t.storeID AND g.flag = t.flag
    WHERE t.split = 'test'"""


@query(with_ctes(_ONE_CUT_OF_SKUS.format(level=_ALONE), "modeling", flagged=_FLAGGED,
    whole="SELECT productID, storeID, avg(target) AS p FROM flagged WHERE split = 'train' GROUP BY ALL",
    sides="SELECT productID, storeID, flag, avg(target) AS p FROM flagged WHERE split = 'train' GROUP BY ALL"))
def gbt_regress_one_cut_individual(spark, sf):
    return _one_cut(spark, sf, "gbt_regress", Strategy.INDIVIDUAL)


@query(with_ctes(f"""
    SELECT t.bdID, m.quantile_level, round(m.p, 6) AS prediction FROM flagged t
    JOIN (SELECT flag, unnest({LEVEL_LIST}) AS quantile_level, unnest(quantile_cont(target::DOUBLE, {LEVEL_LIST})) AS p
          FROM flagged WHERE split = 'train' GROUP BY flag) m USING (flag)
    WHERE t.split = 'test'""", "modeling", flagged=_FLAGGED))
def gbt_quantile_one_cut(spark, sf):
    return _one_cut(spark, sf, "gbt_quantile", Strategy.COMBINED, ALPHAS)


# A side counts only if its share at or above the whole quantile differs from the other side's: else nothing is gained by a cut.
@query(with_ctes(_ONE_CUT_OF_SKUS.format(level="0.7::DOUBLE"), "modeling", flagged=_FLAGGED,
    whole="SELECT productID, storeID, quantile_cont(target::DOUBLE, 0.7::DOUBLE) AS p FROM flagged WHERE split = 'train' GROUP BY ALL",
    shares="""SELECT f.productID, f.storeID, count(*) FILTER (WHERE flag) AS n1, count(*) FILTER (WHERE NOT flag) AS n0,
                count(*) FILTER (WHERE flag AND target >= p) AS k1, count(*) FILTER (WHERE NOT flag AND target >= p) AS k0
              FROM flagged f JOIN whole USING (productID, storeID) WHERE split = 'train' GROUP BY ALL""",
    sides="""SELECT f.productID, f.storeID, f.flag, quantile_cont(target::DOUBLE, 0.7::DOUBLE) AS p
             FROM flagged f JOIN shares USING (productID, storeID)
             WHERE split = 'train' AND k1 * n0 <> k0 * n1 GROUP BY ALL"""))
def gbt_quantile_one_cut_individual(spark, sf):
    return _one_cut(spark, sf, "gbt_quantile", Strategy.INDIVIDUAL, [0.7])


@query(with_ctes(f"""
    SELECT r.productID, r.storeID, m.quantile_level,
           round(avg({pinball_sql('r.target', 'm.q', 'm.quantile_level')}), 9) AS mean_quantile_loss,
           min(n.n_train) AS n_train, count(*) AS n_test, min(r.date) AS split_date, 'price,disc' AS features
    FROM rows_ r JOIN models m USING (productID, storeID)
    JOIN (SELECT productID, storeID, count(*) AS n_train FROM rows_ WHERE split = 'train' GROUP BY ALL) n USING (productID, storeID)
    WHERE r.split = 'test' GROUP BY r.productID, r.storeID, m.quantile_level""", "panel",
    rows_=f"SELECT *, CASE WHEN date < DATE '{SPLIT_DATE}' THEN 'train' ELSE 'test' END AS split FROM panel WHERE not_for_sale <> 1",
    models=f"SELECT productID, storeID, unnest({LEVEL_LIST}) AS quantile_level, "
           f"unnest(quantile_cont(target::DOUBLE, {LEVEL_LIST})) AS q FROM rows_ WHERE split = 'train' GROUP BY productID, storeID"))
def configured_columns(spark, sf):
    """An experiment on tables with other names for id, date and target; none of them is a feature."""
    df = written_panel(spark, sf).withColumnsRenamed({"bdID": "row_number", "date": "day", "target": "sales"})
    paths = [scratch_path(spark, name) for name in ("features", "targets")]
    df.drop("sales").write.parquet(paths[0])
    df.select("row_number", "day", "sales").write.parquet(paths[1])
    data = DataConfig(*paths, id_column="row_number", date_column="day", target_column="sales", split_date=SPLIT_DATE)
    found = experiment.ForecastBench(spark, data).run_experiment(
        None, Strategy.INDIVIDUAL, "empirical_quantile", {}, ALPHAS, "configured")
    table = found.results.withColumn("features", F.lit(",".join(found.setup.features)))
    return rounded(table.drop("model_type", "modeling_strategy"), "mean_quantile_loss")


@query()
def gbt_quantile_individual(spark, sf):
    """Boosted trees per SKU and level: losses of every model on its test rows."""
    scored, config = _run(
        prepared(spark, sf), "gbt_quantile", Strategy.INDIVIDUAL, ALPHAS, min_child_weight=5, **TREES)
    return experiment.score(scored, config, Strategy.INDIVIDUAL)


def _tuned(spark, sf, **settings):
    """Trials of boosted trees on the train rows of 100 sampled SKUs."""
    rows = prepared(spark, sf)
    chosen = sampling.sample_skus(rows, 100, SEED)
    train = rows.where(F.col("split") == "train").join(chosen, list(SKU_KEYS), "left_semi")
    return train, tuning.random_search(train, "gbt_regress", FEATURES, seed=SEED, parallelism=2, n_skus=100, **settings)


@query()
def tune_random_search_trials(spark, sf):
    """Two trials in two folds, few rounds: the table of trials."""
    _, found = _tuned(spark, sf, n_trials=2, n_folds=2, fixed={"n_estimators": 5, "max_depth": 4})
    return found.trials.withColumn("is_best", F.col("loss") == found.best_score)


@query(with_ctes(f"""
    SELECT 20::BIGINT AS n_trials, 3 AS n_folds, count(*) AS n_rows, round(var_pop(target), 6) AS variance, true AS best_is_lowest,
           true AS beats_constant, true AS all_in_space
    FROM modeling JOIN (SELECT DISTINCT productID, storeID FROM modeling
                        ORDER BY md5('{SEED}-' || productID || '-' || storeID), productID, storeID LIMIT 100) c USING (productID, storeID)
    WHERE split = 'train'""", "modeling"))
def tune_random_search(spark, sf):
    """Twenty trials in three folds with every parameter free: is the best one the lowest, and below the variance, a constant's loss?"""
    train, found = _tuned(spark, sf, n_trials=20, n_folds=3)
    space = {name: (low, high) for name, low, high, _ in registry.get("gbt_regress").search_space}
    inside = F.lit(True)
    for name, (low, high) in space.items():
        inside &= F.col("params")[name].between(0 if name == "n_estimators" else low, high)
    trials = found.trials.agg(F.count("*").alias("n_trials"), F.min("loss").alias("least"), F.min(inside).alias("all_in_space"))
    facts = train.agg(F.count("*").alias("n_rows"), F.var_pop("target").alias("variance"))
    table = trials.select("*", facts.select(F.struct("n_rows", "variance")).scalar().alias("f")).select(
        "n_trials", F.lit(found.n_folds).alias("n_folds"), "f.n_rows", "f.variance", (F.col("least") == found.best_score).alias("best_is_lowest"),
        (F.col("least") < F.col("f.variance")).alias("beats_constant"), "all_in_space")
    return rounded(table, six=["variance"])


@query(with_ctes("""
    SELECT productID, storeID, quantile_level, round(mean_quantile_loss, 9) AS mean_quantile_loss, hp_type, model_type,
           'individual' AS modeling_strategy
    FROM results WHERE hp_type = '100' AND quantile_level IS NOT NULL AND model_type = 'empirical_quantile'""", "results"))
def lookup_models(spark, sf):
    """The models of one strategy and type among the results of two experiments."""
    named = experiment_results(spark, sf).withColumn(
        "modeling_strategy", F.when(F.col("hp_type") == "0", "combined").otherwise("individual"))
    return experiment.lookup(named, Strategy.INDIVIDUAL, quantile_only=True, model_type="empirical_quantile")


def _weekday_fit(train, s):
    return train.groupBy(*s.keys, F.weekday("date").alias("weekday")).agg(F.avg(s.target).alias("prediction"))


def _weekday_predict(rows, fitted, s):
    keyed = rows.withColumn("weekday", F.weekday("date"))
    return keyed.join(fitted, [*s.keys, "weekday"]).withColumn("quantile_level", F.lit(None).cast("double"))


@query(with_ctes("""
    SELECT productID, storeID, CAST(NULL AS DOUBLE) AS quantile_level,
           round(avg((target - p) * (target - p)), 9) AS mse, round(sqrt(avg((target - p) * (target - p))), 6) AS rmse,
           round(avg(abs(target - p)), 9) AS mae, 'weekday_mean' AS model_type, 'individual' AS modeling_strategy
    FROM modeling m JOIN means w ON m.productID = w.pid AND m.storeID = w.sid AND isodow(m.date) = w.d
    WHERE split = 'test' GROUP BY productID, storeID""", "modeling",
    means="SELECT productID AS pid, storeID AS sid, isodow(date) AS d, avg(target) AS p FROM modeling "
          "WHERE split = 'train' GROUP BY ALL"))
def model_plugin(spark, sf):
    """A user's own model type: the mean of the weekday."""
    registry.register("weekday_mean", ModelType(_weekday_fit, _weekday_predict, description="mean per weekday"))
    scored, config = _run(prepared(spark, sf), "weekday_mean", Strategy.INDIVIDUAL)
    table = experiment.score(scored, config, Strategy.INDIVIDUAL)
    return rounded(table, "mse", "mae", six=["rmse"])


@query(with_ctes("""
    SELECT bdID, CAST(NULL AS DOUBLE) AS quantile_level,
           round((SELECT regr_intercept(target, target_lag_1) FROM modeling WHERE split = 'train')
                 + (SELECT regr_slope(target, target_lag_1) FROM modeling WHERE split = 'train') * target_lag_1, 6) AS prediction
    FROM modeling WHERE split = 'test'""", "modeling"))
def model_plugin_ml(spark, sf):
    """An estimator of Spark ML as a model type: fitted, saved, loaded again, predicting."""
    registry.register("ml_line", registry.from_ml(LinearRegression(solver="normal"), "least squares by Spark ML"))
    rows = prepared(spark, sf)
    setup = experiment.setup_of(rows, ModelConfig("ml_line", {}), Strategy.COMBINED, features=["target_lag_1"])
    model = registry.get("ml_line")
    path = scratch_path(spark, "ml")
    model.fit(rows.where(F.col("split") == "train"), setup).write().save(path)
    scored = model.predict(rows.where(F.col("split") == "test"), PipelineModel.load(path), setup)
    return rounded(scored.select("bdID", "quantile_level", "prediction"), six=["prediction"])
