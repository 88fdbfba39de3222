"""Feature steps, each a DataFrame -> DataFrame function for ``transform`` chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from panelspark.config import SERIES_KEYS
from panelspark.functions import calendar

# The whole domain of each calendar column, so no pass over the data is needed.
CALENDAR_DOMAINS = {
    "day_of_week": range(1, 8),
    "month": range(1, 13),
    "quarter": range(1, 5),
    "week_of_year": range(1, 54),
    "is_weekend": (True, False),
}


def calendar_features(df: DataFrame, date_col: str = "date", friday_is_weekend: bool = False) -> DataFrame:
    day = F.col(date_col).cast("date")
    return df.withColumns({date_col: day, **calendar.calendar_columns(day, friday_is_weekend)})


def event_flags(df: DataFrame, date_col: str = "date") -> DataFrame:
    return df.withColumns(calendar.event_columns(F.col(date_col)))


def one_hot(df: DataFrame, columns, domains: dict | None = None, max_values: int | None = None) -> DataFrame:
    """Replace each column by 0/1 columns ``{column}_{value}``.

    Calendar columns have a fixed domain. Another column needs ``domains[column]``
    or has its distinct values read: one column of the schema each, so ``max_values`` may
    name the most that a caller wants; more are an error. A value outside a given domain has no column.
    """
    known = {**CALENDAR_DOMAINS, **(domains or {})}
    flags = []
    for name in columns:
        values = known.get(name)
        if values is None:
            rows = df.select(name).distinct().collect()
            if max_values is not None and len(rows) > max_values:
                raise ValueError(f"{name} has {len(rows)} values, more than the {max_values} allowed; give its domain")
            values = sorted(r[0] for r in rows if r[0] is not None)
        for value in values:
            label = str(value).lower() if isinstance(value, bool) else value
            hit = F.col(name).eqNullSafe(F.lit(value))
            flags.append(hit.cast("tinyint").alias(f"{name}_{label}"))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in set(columns)]
    return df.select(*kept, *flags)


def _lag_list(lags) -> list[int]:
    return list(range(1, lags + 1)) if isinstance(lags, int) else list(lags)


def lag_features(df: DataFrame, value_col: str = "value", lags=range(1, 8), keys=None,
                 date_col: str = "date", split_days: int | None = None) -> DataFrame:
    """Add ``{value_col}_lag_{k}``: the value k rows earlier in the series.

    Lags count rows, not days, so a gap in the dates is stepped over. All lags share
    one window. A daily series holds at most one row per day, which bounds a window
    partition by the length of the calendar. For series without that bound, give
    ``split_days``: each series is then cut into spans of that many days which are
    windowed apart, and only the last rows of a span travel to the next one.
    """
    keys = list(SERIES_KEYS if keys is None else keys)
    missing = [c for c in [*keys, date_col, value_col] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    steps = _lag_list(lags)
    if split_days is None:
        window = W.partitionBy(*keys).orderBy(date_col)
        return df.withColumns({f"{value_col}_lag_{k}": F.lag(value_col, k).over(window) for k in steps})
    return _lag_in_spans(df, value_col, steps, keys, date_col, split_days)


def _lag_in_spans(df, value_col, steps, keys, date_col, split_days):
    depth = max(steps)
    span = F.floor(F.datediff(F.col(date_col), F.lit("1970-01-01").cast("date")) / split_days)
    inside = W.partitionBy(*keys, "_span").orderBy(date_col)
    rows = df.withColumn("_span", span).withColumns({
        "_pos": F.row_number().over(inside),
        **{f"_in_{k}": F.lag(value_col, k).over(inside) for k in steps},
    })

    # The last `depth` values of every span, newest first: at most `depth` rows per span.
    newest = W.partitionBy(*keys, "_span").orderBy(F.desc(date_col))
    tails = (
        df.withColumn("_span", span)
        .withColumn("_back", F.row_number().over(newest))
        .where(F.col("_back") <= depth)
        .groupBy(*keys, "_span")
        .agg(F.array_sort(F.collect_list(F.struct("_back", F.col(value_col).alias("v")))).alias("_tail"))
    )
    # `depth` earlier spans always hold enough rows, as no span is empty.
    earlier = W.partitionBy(*keys).orderBy(F.desc("_span")).rowsBetween(1, depth)
    carried = tails.select(
        *keys, "_span",
        F.slice(F.flatten(F.collect_list("_tail").over(earlier)), 1, depth).alias("_carry"),
    )
    joined = rows.join(carried, [*keys, "_span"], "left")
    filled = {}
    for k in steps:
        # A row at position p of its span reaches k - p + 1 values into the carried tail.
        reach = F.lit(k) - F.col("_pos") + 1
        carried_value = F.when(reach >= 1, F.try_element_at("_carry", reach)["v"])
        filled[f"{value_col}_lag_{k}"] = F.when(reach >= 1, carried_value).otherwise(F.col(f"_in_{k}"))
    return joined.withColumns(filled).drop("_span", "_pos", "_carry", *[f"_in_{k}" for k in steps])


def trend_feature(df: DataFrame, date_col: str = "date", first_day: str | None = None) -> DataFrame:
    """Add ``trend``: 1 on the first day of the whole panel, then one more each day.

    The first day comes from one narrow scan as a scalar subquery unless it is given.
    """
    start = (
        F.lit(first_day).cast("date") if first_day
        else df.agg(F.min(date_col).alias("first_day")).scalar()
    )
    return df.withColumn("trend", (F.datediff(F.col(date_col), start) + 1).cast("bigint"))


def date_spine(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Every day from the first to the last one, with a counter from 1."""
    ends = df.agg(F.min(date_col).alias("a"), F.max(date_col).alias("b"))
    days = F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))
    return (
        ends.select("a", F.explode(days).alias(date_col))
        .select(date_col, (F.datediff(F.col(date_col), F.col("a")) + 1).cast("bigint").alias("trend"))
    )
