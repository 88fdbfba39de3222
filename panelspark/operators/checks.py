"""Checks that report offenders as rows, so they run where the data is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F


def sku_violations(df: DataFrame) -> DataFrame:
    """SKU pairs that are missing or not positive, with the reason and row count."""
    product, store = F.col("productID"), F.col("storeID")
    reason = (
        F.when(product.isNull() | store.isNull(), "missing id")
        .when((product <= 0) & (store <= 0), "product and store not positive")
        .when(product <= 0, "product not positive")
        .when(store <= 0, "store not positive")
    )
    return (
        df.select(product, store, reason.alias("reason"))
        .where(F.col("reason").isNotNull())
        .groupBy("productID", "storeID", "reason")
        .agg(F.count("*").alias("n_rows"))
    )


def assert_valid_skus(df: DataFrame) -> DataFrame:
    """Strict form: raise on the first few offenders, or on an empty list."""
    if df.isEmpty():
        raise ValueError("at least one SKU is needed")
    bad = sku_violations(df).take(5)
    if bad:
        raise ValueError(f"invalid SKUs: {[tuple(r) for r in bad]}")
    return df


def split_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Models whose train or test side is empty."""
    return (
        df.groupBy(*keys)
        .agg(
            F.count_if(F.col("split") == "train").alias("n_train"),
            F.count_if(F.col("split") == "test").alias("n_test"),
        )
        .where((F.col("n_train") == 0) | (F.col("n_test") == 0))
    )


def watched(df: DataFrame, date_col: str = "date", target: str = "target") -> tuple[DataFrame, Observation]:
    """The rows, and numbers about them that the first action over them collects on its way: no further scan.

    ``observation.get`` waits for that action, such as the write of the modeling rows.
    """
    train, test, day = F.col("split") == "train", F.col("split") == "test", F.col(date_col).cast("date")
    seen = Observation("split")
    return df.observe(
        seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test"),
        F.count_if(F.col("split").isNull() | ~(train | test)).alias("n_unsplit"), F.count_if(F.col(target).isNull()).alias("n_missing"),
        F.max(F.when(train, day)).alias("last_train"), F.min(F.when(test, day)).alias("first_test")), seen


def split_faults(numbers: dict) -> list[str]:
    """What is wrong with a split, from the numbers that :func:`watched` collected."""
    faults = [f"no {side} rows" for side in ("train", "test") if not numbers[f"n_{side}"]]
    if numbers["n_unsplit"]:
        faults.append(f"{numbers['n_unsplit']} rows on neither side")
    if numbers["last_train"] and numbers["first_test"] and numbers["last_train"] >= numbers["first_test"]:
        faults.append("train rows on or after the first test day")
    return faults
