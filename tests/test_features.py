import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import features, filters, splits
from panelspark.sources import retail


def days(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "d string").select(F.to_date("d").alias("date"))


def test_weekend_is_saturday_and_sunday_unless_friday_is_asked_for(spark):
    df = days(spark, "2020-01-03", "2020-01-04", "2020-01-05", "2020-01-06")
    plain = [r["is_weekend"] for r in features.calendar_features(df).orderBy("date").collect()]
    literal = [r["is_weekend"] for r in features.calendar_features(df, friday_is_weekend=True).orderBy("date").collect()]
    assert plain == [False, True, True, False]
    assert literal == [True, True, True, False]


def test_calendar_of_an_iso_week_53(spark):
    row = features.calendar_features(days(spark, "2016-01-01")).first()
    assert (row["week_of_year"], row["day_of_week"], row["quarter"]) == (53, 5, 1)


def test_event_flags(spark):
    df = features.event_flags(days(spark, "2020-12-25", "2020-01-01", "2020-10-31", "2020-07-01"))
    flags = {str(r["date"]): tuple(r)[1:] for r in df.collect()}
    assert flags == {"2020-12-25": (1, 0, 0), "2020-01-01": (0, 1, 0), "2020-10-31": (0, 0, 1), "2020-07-01": (0, 0, 0)}


def test_one_hot_reads_small_domains_and_refuses_large_ones(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    out = features.one_hot(df, ["c"]).collect()
    assert [tuple(r) for r in out] == [(1, 0), (0, 1), (0, 0)]
    with pytest.raises(ValueError):
        features.one_hot(df, ["c"], max_values=1)


def test_a_later_year_gets_its_column(spark):
    df = features.calendar_features(days(spark, "2003-05-01", "1995-01-01"))
    assert [c for c in features.one_hot(df, ["year"]).columns if c.startswith("year_")] == ["year_1995", "year_2003"]


def gappy(spark, seed, n):
    draw = random.Random(seed)
    start = dt.date(2019, 1, 1)
    rows = [
        (s, "daily", start + dt.timedelta(days=d), float(draw.randint(0, 9)))
        for s in (1, 2, 3) for d in sorted(draw.sample(range(900), n))
    ]
    return spark.createDataFrame(rows, "skuID int, frequency string, date date, v double").repartition(5)


@pytest.mark.parametrize("span", [1, 10, 97, 5000])
def test_lags_in_spans_equal_one_window(spark, span):
    df = gappy(spark, span, 60)
    plain = features.lag_features(df, "v", [1, 2, 5]).orderBy("skuID", "date").collect()
    cut = features.lag_features(df, "v", [1, 2, 5], split_days=span).select(*plain[0].asDict())
    assert cut.orderBy("skuID", "date").collect() == plain


def test_lag_count_and_missing_columns(spark):
    df = gappy(spark, 1, 5)
    assert [c for c in features.lag_features(df, "v", 3).columns if "lag" in c] == ["v_lag_1", "v_lag_2", "v_lag_3"]
    with pytest.raises(ValueError, match="nothing"):
        features.lag_features(df, "nothing", 1)


def test_lags_count_rows_not_days(spark):
    df = spark.createDataFrame(
        [(1, "daily", dt.date(2020, 1, 1), 7.0), (1, "daily", dt.date(2020, 2, 1), 8.0)],
        "skuID int, frequency string, date date, v double")
    assert features.lag_features(df, "v", 1).orderBy("date").collect()[1]["v_lag_1"] == 7.0


def test_trend_starts_at_one(spark):
    df = features.trend_feature(days(spark, "2020-01-05", "2020-01-01"))
    assert sorted((str(r["date"]), r["trend"]) for r in df.collect()) == [("2020-01-01", 1), ("2020-01-05", 5)]


def test_drop_nulls_keeps_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert filters.drop_nulls(df).count() == 2


def test_exact_pairs_are_fewer_than_the_cross(panel):
    skus = [(1, 3), (12, 7)]
    exact = {tuple(r) for r in filters.sku_tuples(panel, skus).select("productID", "storeID").distinct().collect()}
    cross = {tuple(r) for r in filters.sku_tuples(panel, skus, "cross").select("productID", "storeID").distinct().collect()}
    assert exact <= set(skus)
    assert exact <= cross <= {(p, s) for p in (1, 12) for s in (3, 7)}


@pytest.mark.parametrize("fraction", [0.2, 0.3, 0.75])
@pytest.mark.parametrize("keys", [[], ["productID", "storeID"]])
def test_fraction_split_by_brute_force(panel, fraction, keys):
    pdf = splits.by_fraction(panel, fraction, keys).select("productID", "storeID", "date", "split").toPandas()
    groups = pdf.groupby(keys) if keys else [((), pdf)]
    for _, part in groups:
        known = sorted(part["date"].unique())
        at = int(len(known) * (1 - fraction))
        cut = known[at] if at < len(known) else known[-1]
        assert ((part["date"] < cut) == (part["split"] == "train")).all()


def test_panel_has_one_row_per_sku_and_day(panel, spark, sf):
    n = panel.count()
    assert panel.select("bdID").distinct().count() == n
    assert panel.select("productID", "storeID", "date").distinct().count() == n
    sold = retail.table(spark, sf, "lineitem").agg(F.sum("l_quantity")).first()[0]
    assert panel.agg(F.sum("target")).first()[0] == sold


def test_date_filter_reaches_the_scan(spark, sf):
    df = retail.demand_panel(spark, sf, min_date="2000-01-01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate,2000-01-01" in plan
    assert "l_tax" not in plan
