"""Seeded samples, first-n picks and folds.

Few rows are picked by a top-n operator, sorted per task first. Many are picked by counting how many rows lie below each
leading part of their random key, so no task ever merges them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from panelspark.config import SKU_KEYS
from panelspark.functions.compare import seeded_bucket, seeded_order


def distinct_skus(df: DataFrame) -> DataFrame:
    return df.select(*SKU_KEYS).distinct()


def first_skus(df: DataFrame, n: int) -> DataFrame:
    return distinct_skus(df).orderBy(*SKU_KEYS).limit(n)


def sample_skus(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n SKUs drawn by seed, or all of them where there are fewer."""
    return distinct_skus(df).orderBy(seeded_order(seed, *SKU_KEYS), *SKU_KEYS).limit(n)


PICK_ROWS = 10_000
_DIGITS = 4


def sample_rows(df: DataFrame, n: int, seed: int, id_col: str = "bdID") -> DataFrame:
    """The n rows with the least random keys, ties by id, or all where there are fewer.

    Rows are counted by the first digits of their keys; those before the digits that hold the n-th row are all taken. Only among
    rows that share these digits, PICK_ROWS at most unless keys repeat, is the order looked at.
    """
    key = seeded_order(seed, F.col(id_col))
    keyed = df.withColumn("_key", key)
    taken, prefix, left = [], "", n
    while left > 0:
        digits = len(prefix) + _DIGITS
        inside = keyed.where(F.startswith("_key", F.lit(prefix))) if prefix else keyed
        counts = sorted(tuple(r) for r in inside.groupBy(F.substring("_key", 1, digits)).count().collect())
        before = 0
        for last, size in counts:
            if before + size >= left:
                break
            before += size
        else:
            taken.append(inside)  # there are fewer than n
            break
        taken.append(inside.where(F.substring("_key", 1, digits) < last))
        left, prefix = left - before, last
        if size <= PICK_ROWS or digits >= 32:
            edge = keyed.where(F.startswith("_key", F.lit(prefix)))
            taken.append(edge if size == left else edge.orderBy("_key", id_col).limit(left))
            break
    if not taken:
        return df.limit(0)
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out.drop("_key")


def equal_folds(df: DataFrame, k: int, seed: int, id_col: str = "bdID") -> DataFrame:
    """Add ``fold`` 0..k-1 by place in the random order, so sizes differ by one at most.

    Places come from the counts of leading digits and the order within rows that share them: no task orders all rows.
    """
    if k < 2:
        raise ValueError("at least two folds are needed")
    keyed = df.withColumns({"_key": seeded_order(seed, F.col(id_col))}).withColumn("_head", F.substring("_key", 1, _DIGITS))
    counts = keyed.groupBy("_head").count()
    # At most 16 ** _DIGITS rows.
    starts = counts.select("_head", F.coalesce(F.sum("count").over(W.orderBy("_head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.row_number().over(W.partitionBy("_head").orderBy("_key", id_col))
    placed = keyed.withColumn("_nth", within).join(F.broadcast(starts), "_head")
    return placed.withColumn("fold", ((F.col("_start") + F.col("_nth") - 1) % k).cast("int")).select(*df.columns, "fold")


def kfold(df: DataFrame, k: int, seed: int, id_col: str = "bdID") -> DataFrame:
    """Add ``fold`` 0..k-1, fixed by seed and row id: no shuffle, no index arrays."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    return df.withColumn("fold", seeded_bucket(seed, k, F.col(id_col)))
