"""Mergeable quantile sketches: counts of values in buckets of equal relative width.

A sketch is a table of (keys, bucket, n). Sketches of parts merge by adding counts, so the order of merging does not matter and
no row is read again. A quantile from a sketch lies within ``accuracy``, relative to itself, of the exact quantile of the same
ranks: ranks are exact, only values are rounded to their bucket's middle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from panelspark.config import check_alphas

ACCURACY = 0.005
# Smaller values than this count as zero.
LEAST = 1e-12


def _growth(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("accuracy lies between 0 and 1")
    return math.log((1 + accuracy) / (1 - accuracy))


def build(df: DataFrame, keys: list[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """The sketch of each key's values; nulls do not count. A key has some ten thousand buckets at most."""
    v = F.col(value).cast("double")
    # Buckets of positive values count from 1 up, of negative ones from -1 down, in order of the values.
    least = math.ceil(math.log(LEAST) / _growth(accuracy)) - 1
    size = F.ceil(F.log(F.abs(v)) / _growth(accuracy)) - least
    bucket = F.when(F.abs(v) < LEAST, 0).otherwise(F.signum(v) * F.greatest(size, F.lit(1))).cast("int")
    return df.where(v.isNotNull()).groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer keys as one for each of ``keys``."""
    return sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], alphas, accuracy: float = ACCURACY) -> DataFrame:
    """Keys, ``total`` and ``quantiles``, with linear interpolation between ranks as in the exact form."""
    alphas = check_alphas(alphas)
    least = math.ceil(math.log(LEAST) / _growth(accuracy)) - 1
    size = F.abs("bucket") + least
    middle = 2 * F.exp(size * _growth(accuracy)) / (math.exp(_growth(accuracy)) + 1)
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(F.signum(F.col("bucket").cast("double")) * middle)
    upto = F.sum("n").over(W.partitionBy(*keys).orderBy("bucket"))
    total = F.sum("n").over(W.partitionBy(*keys))
    placed = sketch.select(*keys, value.alias("v"), upto.alias("upto"), total.alias("total"))
    picks = []
    for i, a in enumerate(alphas):
        spot = (F.col("total") - 1) * a
        picks += [F.min(F.when(F.col("upto") > F.floor(spot), F.col("v"))).alias(f"a{i}"),
                  F.min(F.when(F.col("upto") > F.ceil(spot), F.col("v"))).alias(f"b{i}")]
    found = placed.groupBy(*keys).agg(F.first("total").alias("total"), *picks)
    values = []
    for i, a in enumerate(alphas):
        spot = (F.col("total") - 1) * a
        share = spot - F.floor(spot)
        values.append(F.col(f"a{i}") * (1 - share) + F.col(f"b{i}") * share)
    return found.select(*keys, "total", F.array(*values).alias("quantiles"))
