import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import quantiles

ALPHAS = [0.01, 0.25, 0.5, 0.7, 0.95, 0.99]


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows and has a heavy tail; others are tiny or constant."""
    rng = np.random.default_rng(7)
    groups = {
        "hot": rng.pareto(0.7, 20_000) * 10, "whole": np.round(rng.gamma(2, 9, 3_000)),
        "tiny": np.array([3.0, 1.0]), "one": np.array([5.5]), "flat": np.full(50, 2.0),
        "negative": rng.normal(-5, 3, 500),
    }
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in groups.items()])
    return groups, spark.createDataFrame(pdf).repartition(6).cache()


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_spread_quantiles_equal_numpy_per_key(skewed, buckets):
    groups, df = skewed
    for row in quantiles.spread_quantiles(df, ["k"], "v", ALPHAS, buckets).collect():
        assert np.allclose(row["quantiles"], np.quantile(groups[row["k"]], ALPHAS), rtol=1e-12)


def test_spread_quantiles_without_keys(skewed):
    groups, df = skewed
    got = quantiles.spread_quantiles(df, [], "v", ALPHAS).first()["quantiles"]
    assert np.allclose(got, np.quantile(np.concatenate(list(groups.values())), ALPHAS), rtol=1e-12)


def test_grouped_quantiles_equal_spread(skewed):
    _, df = skewed
    a = {r["k"]: r["quantiles"] for r in quantiles.grouped_quantiles(df, ["k"], "v", ALPHAS).collect()}
    b = {r["k"]: r["quantiles"] for r in quantiles.spread_quantiles(df, ["k"], "v", ALPHAS).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert np.allclose(a[k], b[k], rtol=1e-12)


def test_nulls_do_not_count(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert quantiles.spread_quantiles(df, [], "v", [0.5]).first()["quantiles"] == [2.0]


def test_spread_rank_equals_pandas(skewed):
    _, df = skewed
    pdf = quantiles.spread_rank(df, ["k"], "v").toPandas()
    assert (pdf["rank"] == pdf.groupby("k")["v"].rank(method="min").astype(int)).all()


@pytest.mark.parametrize("bad", [[], [0.0], [1.0], [0.5, 1.5]])
def test_levels_must_lie_inside_zero_and_one(spark, bad):
    df = spark.createDataFrame([(1.0,)], "v double").where(F.lit(True))
    with pytest.raises(ValueError):
        quantiles.grouped_quantiles(df, [], "v", bad)


def test_one_value_far_off_does_not_crowd_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BUCKET_LIMIT", 500)
    df = spark.range(20_000).selectExpr("id % 2 AS g", "CASE WHEN id = 7 THEN 1e12 ELSE id / 1e3 END AS v")
    counts = df.groupBy("g", "v").count().withColumnRenamed("count", "n")
    rows, totals = quantiles._bucketed(counts, ["g"], "v", "n", 64)
    assert totals.agg({"in_bucket": "max"}).first()[0] <= 500
    got = {r["g"]: r["quantiles"] for r in quantiles.spread_quantiles(df, ["g"], "v", [0.1, 0.5, 0.999], 64).collect()}
    values = df.toPandas()
    for g, part in values.groupby("g"):
        assert np.allclose(got[g], np.quantile(part.v, [0.1, 0.5, 0.999]))
    ranks = quantiles.spread_rank(df, ["g"], "v").toPandas()
    assert (ranks["rank"] == ranks.groupby("g")["v"].rank(method="min")).all()
