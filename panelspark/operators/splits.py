"""Train and test split by time, carried as a ``split`` column instead of id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def _mark(day, cut):
    return F.when(day < cut, F.lit("train")).otherwise(F.lit("test"))


def by_date(df: DataFrame, split_date: str, date_col: str = "date") -> DataFrame:
    """Rows before the date train; rows on or after it test."""
    return df.withColumn("split", _mark(F.col(date_col), F.lit(split_date).cast("date")))


def split_dates(df: DataFrame, test_fraction: float, keys: list[str], date_col: str = "date") -> DataFrame:
    """Per model key, the day at which the last fraction of its distinct days begins.

    The collected set holds distinct days only, so its size is bounded by the calendar
    however many rows a key has, and it is merged map-side.
    """
    if not 0 < test_fraction < 1:
        raise ValueError("test_fraction must lie between 0 and 1")
    days = F.array_sort(F.collect_set(F.col(date_col).cast("date")))
    at = F.floor(F.size("days") * F.lit(1 - test_fraction)).cast("int") + 1
    last = F.size("days")
    return (
        df.groupBy(*keys).agg(days.alias("days"))
        .select(*keys, last.cast("bigint").alias("n_days"),
                F.element_at("days", F.least(at, last)).alias("split_date"))
    )


def by_fraction(df: DataFrame, test_fraction: float, keys: list[str], date_col: str = "date") -> DataFrame:
    """Split each model key at its own date; without keys there is one date for all.

    With keys, days are numbered in a window per key, which a daily series bounds: one scan
    and one shuffle. The one date for all comes from a scalar subquery.
    """
    if not 0 < test_fraction < 1:
        raise ValueError("test_fraction must lie between 0 and 1")
    if keys:
        day = F.col(date_col).cast("date")
        own = W.partitionBy(*keys)
        numbered = df.withColumn("_day", F.dense_rank().over(own.orderBy(day)))
        last = F.max("_day").over(own)
        at = F.least(F.floor(last * F.lit(1 - test_fraction)).cast("int") + 1, last)
        numbered = numbered.withColumn("_at", at)
        marked = numbered.withColumn("split_date", F.min(F.when(F.col("_day") == F.col("_at"), day)).over(own)).drop("_day", "_at")
    else:
        cuts = split_dates(df, test_fraction, keys, date_col)
        marked = df.withColumn("split_date", cuts.select("split_date").scalar())
    return marked.withColumn("split", _mark(F.col(date_col), F.col("split_date")))


def audit(df: DataFrame, keys: list[str], date_col: str = "date", id_col: str = "bdID") -> DataFrame:
    """Per model key: row counts, last train day, first test day, and whether time order holds."""
    train, test = F.col("split") == "train", F.col("split") == "test"
    return (
        df.groupBy(*keys)
        .agg(
            F.count("*").alias("n_rows"),
            F.count_distinct(id_col).alias("n_ids"),
            F.count_if(train).alias("n_train"),
            F.count_if(test).alias("n_test"),
            F.max(F.when(train, F.col(date_col))).alias("last_train"),
            F.min(F.when(test, F.col(date_col))).alias("first_test"),
        )
        .withColumns({
            "covers_all": F.col("n_train") + F.col("n_test") == F.col("n_rows"),
            "disjoint": F.col("n_ids") == F.col("n_rows"),
            "in_order": F.coalesce(F.col("last_train") < F.col("first_test"), F.lit(True)),
        })
    )
