"""Feature preparation: calendar, one-hot, lags and trend."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.catalog.base import panel, query, with_ctes, written_panel
from panelspark.operators import features
from panelspark.plans import prepare
from panelspark.session import materialize
from panelspark.sources import retail

YEARS = range(1995, 2002)  # the years that the SQL below names; Spark reads them from the sales

_CALENDAR = """
    CAST(month(date) AS INTEGER) AS month, CAST(isodow(date) AS INTEGER) AS day_of_week,
    CAST(week(date) AS INTEGER) AS week_of_year, CAST(year(date) AS INTEGER) AS year,
    isodow(date) >= {first} AS is_weekend, CAST(quarter(date) AS INTEGER) AS quarter"""
_CAL = _CALENDAR.format(first=6)

_DOMAINS = {
    "day_of_week": range(1, 8), "month": range(1, 13), "quarter": range(1, 5),
    "week_of_year": range(1, 54), "year": YEARS,
}
_ONE_HOT = ", ".join(
    [f"CAST({c} = {v} AS TINYINT) AS {c}_{v}" for c, vs in _DOMAINS.items() for v in vs]
    + ["CAST(is_weekend AS TINYINT) AS is_weekend_true", "CAST(NOT is_weekend AS TINYINT) AS is_weekend_false"])
ONE_HOT_COLUMNS = [*_DOMAINS, "is_weekend"]
_LAGS = ", ".join(f"lag(target, {k}) OVER w AS target_lag_{k}" for k in range(1, 8))
_WINDOW = "WINDOW w AS (PARTITION BY skuID, frequency ORDER BY date)"


def years(spark, sf) -> list[int]:
    """The years of the sales, from one column of them."""
    sold = retail.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year")).distinct()
    return sorted(r["year"] for r in sold.collect() if r["year"] is not None)


@query(with_ctes(f"SELECT bdID, date, {_CAL} FROM panel", "panel"))
def calendar_features(spark, sf):
    return features.calendar_features(panel(spark, sf).select("bdID", "date"))


@query(with_ctes(f"SELECT bdID, date, {_CALENDAR.format(first=5)} FROM panel", "panel"))
def calendar_features_friday(spark, sf):
    return features.calendar_features(panel(spark, sf).select("bdID", "date"), friday_is_weekend=True)


@query(with_ctes("""
    SELECT bdID, CAST(month(date) = 12 AND day(date) = 25 AS INTEGER) AS "event_Christmas_0",
           CAST(month(date) = 1 AND day(date) = 1 AS INTEGER) AS "event_NewYear_0",
           CAST(month(date) = 10 AND day(date) = 31 AS INTEGER) AS "event_Halloween_0" FROM panel""", "panel"))
def event_flags(spark, sf):
    return features.event_flags(panel(spark, sf).select("bdID", "date")).drop("date")


@query(with_ctes(f"SELECT bdID, date, {_ONE_HOT} FROM cal", "panel", cal=f"SELECT bdID, date, {_CAL} FROM panel"))
def one_hot(spark, sf):
    df = features.calendar_features(panel(spark, sf).select("bdID", "date"))
    return features.one_hot(df, ONE_HOT_COLUMNS, {"year": years(spark, sf)})


@query(with_ctes(f"SELECT bdID, date, target, {_LAGS} FROM panel {_WINDOW}", "panel"))
def lag_features(spark, sf):
    df = panel(spark, sf).select("bdID", "skuID", "frequency", "date", "target")
    return features.lag_features(df, "target", range(1, 8)).drop("skuID", "frequency")


@query(with_ctes(f"SELECT bdID, date, target, {_LAGS} FROM panel {_WINDOW}", "panel"))
def lag_features_split(spark, sf):
    """The same lags with every series cut into spans of a year."""
    df = panel(spark, sf).select("bdID", "skuID", "frequency", "date", "target")
    return features.lag_features(df, "target", range(1, 8), split_days=365).drop("skuID", "frequency")


@query(with_ctes("""
    SELECT bdID, date, CAST(date_diff('day', (SELECT min(date) FROM panel), date) + 1 AS BIGINT) AS trend
    FROM panel""", "panel"))
def trend_feature(spark, sf):
    return features.trend_feature(written_panel(spark, sf).select("bdID", "date"))


@query(with_ctes("""
    SELECT CAST(d AS DATE) AS date, CAST(date_diff('day', lo, CAST(d AS DATE)) + 1 AS BIGINT) AS trend
    FROM (SELECT min(date) AS lo, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d
          FROM panel) s""", "panel"))
def date_spine(spark, sf):
    return features.date_spine(retail.table(spark, sf, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date")))


@query(with_ctes(f"""
    SELECT l.bdID, l.skuID, l.productID, l.storeID, l.date, l.price, l.disc, {_ONE_HOT},
           {", ".join(f"target_lag_{k}" for k in range(1, 8))},
           CAST(date_diff('day', (SELECT min(date) FROM chosen), l.date) + 1 AS BIGINT) AS trend
    FROM lags l JOIN cal USING (bdID) WHERE not_for_sale <> 1""", "panel", "whitelist",
    chosen="SELECT p.* FROM panel p JOIN whitelist w USING (productID, storeID)",
    cal=f"SELECT bdID, {_CAL} FROM chosen",
    lags=f"SELECT *, {_LAGS} FROM chosen {_WINDOW}"))
def prepare_features(spark, sf):
    """The whole preparation: whitelist, target join, calendar, one-hot, lags, trend, for sale."""
    # Written once, like the raw files a run starts from: four steps read it.
    df = materialize(panel(spark, sf), "panel")
    prepared = prepare.prepare_features(
        retail.feature_frame(df), df.select("bdID", "target"),
        whitelist=retail.store_whitelist(spark, sf, df), years=years(spark, sf))
    return prepared.drop("frequency", "not_for_sale", "name")
