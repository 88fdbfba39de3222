"""Row filters and projections. All are plain predicates, so they reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.config import METADATA_COLUMNS, SKU_KEYS


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in METADATA_COLUMNS]


def select_features(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in feature_columns(df)])


def one_sku(df: DataFrame, product: int, store: int) -> DataFrame:
    return df.where((F.col("productID") == product) & (F.col("storeID") == store))


def sku_frame(spark, skus) -> DataFrame:
    """SKU pairs as a frame; Spark picks the join by its size."""
    return spark.createDataFrame(list(skus), "productID int, storeID int").distinct()


def sku_tuples(df: DataFrame, skus, mode: str = "exact") -> DataFrame:
    """Rows of the given SKUs: a list of pairs, or a frame with productID and storeID.

    ``exact`` keeps only the pairs asked for. ``cross`` keeps every pair whose
    product and whose store appear somewhere in the list.
    """
    if mode not in ("exact", "cross"):
        raise ValueError(f"unknown mode {mode!r}")
    wanted = skus if isinstance(skus, DataFrame) else None
    if mode == "exact":
        if wanted is None and len(skus) == 1:
            return one_sku(df, *skus[0])
        wanted = sku_frame(df.sparkSession, skus) if wanted is None else wanted
        return df.join(wanted.select(*SKU_KEYS), list(SKU_KEYS), "left_semi")
    if wanted is None:
        return df.where(
            F.col("productID").isin(sorted({p for p, _ in skus}))
            & F.col("storeID").isin(sorted({s for _, s in skus}))
        )
    for key in SKU_KEYS:
        df = df.join(wanted.select(key).distinct(), key, "left_semi")
    return df


def whitelist(df: DataFrame, stores=None, products=None) -> DataFrame:
    """Keep the default stores and products; ``None`` means all."""
    if stores is not None:
        df = df.where(F.col("storeID").isin(list(stores)))
    if products is not None:
        df = df.where(F.col("productID").isin(list(products)))
    return df


def date_range(df: DataFrame, min_date=None, max_date=None, date_col: str = "date") -> DataFrame:
    """Closed date range; an open end is ``None``."""
    if min_date is not None:
        df = df.where(F.col(date_col) >= F.lit(str(min_date)).cast("date"))
    if max_date is not None:
        df = df.where(F.col(date_col) <= F.lit(str(max_date)).cast("date"))
    return df


def for_sale(df: DataFrame) -> DataFrame:
    """Rows not marked as withdrawn; an unknown mark drops the row."""
    return df.where(F.col("not_for_sale") != 1)


def all_present(df: DataFrame, cols=None) -> Column:
    names = df.columns if cols is None else cols
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in names])


def drop_nulls(df: DataFrame, cols=None) -> DataFrame:
    """Drop rows with a null; NaN is a value and stays."""
    return df.where(all_present(df, cols))
