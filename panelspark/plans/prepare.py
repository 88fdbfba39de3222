"""From raw feature and target tables to a panel ready for modeling."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelspark.config import SKU_KEYS, DataConfig, Strategy
from panelspark.operators import features, filters, splits

CALENDAR_COLUMNS = ("day_of_week", "month", "quarter", "week_of_year", "year", "is_weekend")


def prepare_features(raw: DataFrame, targets: DataFrame, whitelist: DataFrame | None = None,
                     lags=range(1, 8), years=None, value_col: str = "target",
                     friday_is_weekend: bool = False, id_col: str = "bdID") -> DataFrame:
    """Whitelist, target join, lags, trend, rows for sale, calendar, one-hot.

    One shuffle joins the targets by id and one groups the series for the lags. The wide
    one-hot columns come last, so they are never shuffled. The target itself is left out,
    as only its lags may be features.
    """
    df = raw
    if whitelist is not None:
        df = df.join(whitelist, list(SKU_KEYS))
    df = df.join(targets.select(id_col, value_col), id_col, "left")
    return (
        df.transform(features.lag_features, value_col, lags)
        .transform(features.trend_feature)
        .transform(filters.for_sale)
        .drop(value_col)
        .transform(features.calendar_features, friday_is_weekend=friday_is_weekend)
        .transform(features.one_hot, CALENDAR_COLUMNS, {"year": years} if years is not None else None)
    )


def select_rows(df: DataFrame, config: DataConfig, skus=None) -> DataFrame:
    """Rows of a run: SKUs, whitelists and dates first, so that they reach the scan."""
    df = filters.whitelist(df, config.default_stores, config.default_products)
    df = filters.date_range(df, config.min_date, config.max_date, config.date_column)
    if config.remove_not_for_sale and "not_for_sale" in df.columns:
        df = filters.for_sale(df)
    return df if skus is None else filters.sku_tuples(df, skus)


def modeling_frame(raw: DataFrame, targets: DataFrame, config: DataConfig, strategy: Strategy,
                   skus=None) -> DataFrame:
    """Features joined to targets with a ``split`` column; all models' rows in one frame."""
    chosen = filters.drop_nulls(select_rows(raw, config, skus))
    wanted = targets.select(config.id_column, config.target_column)
    joined = chosen.drop(config.target_column).join(wanted, config.id_column)
    if config.split_date:
        return splits.by_date(joined, config.split_date, config.date_column)
    return splits.by_fraction(joined, config.test_fraction, strategy.keys, config.date_column)
