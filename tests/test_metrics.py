import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import compare as cmp_fn
from panelspark.functions import labels
from panelspark.functions.losses import pinball, pinball_rounded
from panelspark.operators import compare, metrics, summaries


def pairs(spark, y, p, alpha=None):
    rows = [(float(a), float(b), alpha) for a, b in zip(y, p)]
    return spark.createDataFrame(rows, "target double, prediction double, quantile_level double")


def test_regression_metrics_closed_form(spark):
    # Errors -3, 1, 0 and 4 around targets whose squared deviations sum to 56.
    row = metrics.score(pairs(spark, [6, 8, 10, 16], [9, 7, 10, 12]), [], ("regression", "extended")).first()
    assert row["mse"] == pytest.approx(26 / 4)
    assert row["rmse"] == pytest.approx(np.sqrt(6.5))
    assert row["mae"] == pytest.approx(8 / 4)
    assert row["within_1_unit"] == 50
    assert row["r2"] == pytest.approx(1 - 26 / 56)


def test_mape_leaves_out_zero_targets(spark):
    row = metrics.score(pairs(spark, [4, 0, 10], [5, 7, 8]), [], ("extended",)).first()
    assert row["mape"] == pytest.approx((25 + 20) / 2)


def test_flat_target_has_no_r2(spark):
    assert metrics.score(pairs(spark, [2, 2], [1, 3]), [], ("extended",)).first()["r2"] is None


def test_tuning_loss(spark):
    # Two units short cost 2 * 0.7, three too many cost 3 * 0.3.
    df = pairs(spark, [7, 7], [5, 10], 0.7)
    loss = df.agg(F.avg(pinball(F.col("target"), F.col("prediction"), 0.7))).first()[0]
    assert loss == pytest.approx((1.4 + 0.9) / 2)
    assert metrics.score(df, []).first()["mse"] == pytest.approx((4 + 9) / 2)


def test_report_loss_rounds_half_to_even(spark):
    df = pairs(spark, [3, 3], [2.5, 3.5], 0.5)
    losses = [r[0] for r in df.select(pinball_rounded(F.col("target"), F.col("prediction"), 0.5)).collect()]
    assert losses == [0.5, 0.5]  # 2.5 becomes 2 and 3.5 becomes 4


def test_loss_by_level_equals_long_form(spark):
    y, q = [1.0, 5.0, 9.0], [3.4, 7.7]
    wide = spark.createDataFrame([(v, q) for v in y], "target double, quantiles array<double>")
    got = {r["quantile_level"]: r["mean_quantile_loss"] for r in metrics.pinball_by_level(wide, [], [0.5, 0.9]).collect()}
    for alpha, p in zip([0.5, 0.9], np.round(q)):
        r = np.array(y) - p
        assert got[alpha] == pytest.approx(np.where(r >= 0, alpha * r, (alpha - 1) * r).mean())


def test_coverage(spark):
    row = metrics.score(pairs(spark, [1, 2, 3, 4], [2, 2, 2, 2], 0.9), ["quantile_level"], ("coverage",)).first()
    assert row["coverage_probability"] == 0.5
    assert row["coverage_error"] == pytest.approx(0.4)


def test_performance_summary(spark):
    long = spark.createDataFrame(
        [("mse", 2.0), ("mse", 9.0), ("mse", 4.0), ("bias", -1.5)], "metric string, value double")
    got = {r["metric"]: r for r in summaries.performance_summary(long).collect()}
    assert (got["mse"]["mean"], got["mse"]["min"], got["mse"]["max"], got["mse"]["value"]) == (5, 2, 9, None)
    assert (got["bias"]["value"], got["bias"]["mean"]) == (-1.5, None)


def test_population_and_sample_deviation(spark):
    long = spark.createDataFrame([("m", 1.0), ("m", 3.0)], "metric string, value double")
    assert summaries.performance_summary(long, with_std=True).first()["std"] == 1.0
    results = spark.createDataFrame([("a", 0.5, 1.0), ("a", 0.5, 3.0)], "hp_type string, quantile_level double, mean_quantile_loss double")
    assert summaries.mean_std(results).first()["std"] == pytest.approx(np.sqrt(2))


def test_rank_models(spark):
    long = spark.createDataFrame(
        [("p", "mse", 9.0), ("q", "mse", 1.0), ("p", "r2", 0.9), ("q", "r2", 0.1)],
        "model string, metric string, value double")
    got = summaries.rank_models(long).orderBy("metric", "rank").collect()
    assert [(r["metric"], r["model"]) for r in got] == [("mse", "q"), ("mse", "p"), ("r2", "p"), ("r2", "q")]


def test_relative_differences(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(cmp_fn.rel_diff_pct(F.col("a"), F.col("b"))).collect()] == [0, 100, 50]
    assert [r[0] for r in df.select(cmp_fn.mean_shift_pct(F.col("a"), F.col("b"))).collect()] == [None, None, 50]


def test_dataset_differences_count_duplicates(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "v int")
    right = spark.createDataFrame([(1,), (3,)], "v int")
    got = sorted(tuple(r) for r in compare.dataset_differences(left, right).collect())
    assert got == [(1, "left"), (2, "left"), (3, "right")]


def test_labels(spark):
    skus = [[(1, 2)], [(1, 2), (3, 4)], [(1, 2), (3, 4), (5, 6)], []]
    df = spark.createDataFrame([(s,) for s in skus], "s array<struct<productID:int,storeID:int>>")
    assert [r[0] for r in df.select(labels.sku_key(F.col("s"))).collect()] == [
        "(1, 2)", "combined_1_2_3_4", "combined_1_2_3_4_etc", "all"]


def test_box_by_hand(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    row = summaries.box(df, ["k"], "v").first()
    assert (row["q1"], row["median"], row["q3"]) == (2, 3, 4)
    assert (row["whisker_low"], row["whisker_high"], row["n_outliers"]) == (1, 4, 1)


def test_worst_per_group_is_pruned_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr(
        "0.5D AS quantile_level", "IF(id % 3 = 0, 'b', 'a') AS hp_type", "CAST(id AS INT) AS productID", "1 AS storeID", "rand(1) AS mean_quantile_loss")
    worst = summaries.worst_per_group(df, 25)
    assert worst.count() == 50
    assert "WindowGroupLimit" in worst._jdf.queryExecution().executedPlan().toString()
