"""Exact quantiles with linear interpolation, for small groups and for hot ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from panelspark.config import check_alphas
from panelspark.session import materialize

BUCKETS = 4096
# A bucket with more distinct values than this is cut again.
BUCKET_LIMIT = 100_000


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, alphas) -> DataFrame:
    """Quantiles of groups that are known to be small, such as one daily series.

    One aggregation; each group's distinct values meet in one task.
    """
    levels = F.array(*[F.lit(a) for a in check_alphas(alphas)])
    return df.groupBy(*keys).agg(F.percentile(value, levels).alias("quantiles"))


def spread_quantiles(df: DataFrame, keys: list[str], value: str, alphas, buckets: int = BUCKETS) -> DataFrame:
    """Quantiles of groups of any size; no task ever holds a whole group.

    Equal values are counted map-side, then ranked as in :func:`counted_quantiles`.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg(F.count("*").alias("n"))
    )
    return counted_quantiles(counts, keys, "v", "n", alphas, buckets)


def counted_quantiles(counts: DataFrame, keys: list[str], value: str, count: str, alphas,
                      buckets: int = BUCKETS) -> DataFrame:
    """Quantiles of values given with their frequencies.

    A group's value range is cut into equal buckets, and so is every bucket above
    BUCKET_LIMIT, until none is; bucket totals tell which buckets hold the wanted ranks,
    and only those are ordered. Bucket borders come from exact minima and maxima, so a
    recomputed task sees the same borders.
    """
    alphas = check_alphas(alphas)
    rows, totals = _bucketed(counts, keys, value, count, buckets)
    ranks = [r for a in alphas for r in (F.floor((F.col("total") - 1) * a), F.ceil((F.col("total") - 1) * a))]
    holds = F.exists(
        F.array(*ranks),
        lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("in_bucket")),
    )
    wanted = totals.where(holds).select(*keys, "bucket", "start")
    if not keys:
        wanted = F.broadcast(wanted)  # two rows per level at most
    ranked = _running_count(rows.join(wanted, [*keys, "bucket"]), keys, value, count)
    picks = []
    for i, a in enumerate(alphas):
        spot = (F.col("total") - 1) * a
        picks.append(F.min(F.when(F.col("upto") > F.floor(spot), F.col(value))).alias(f"a{i}"))
        picks.append(F.min(F.when(F.col("upto") > F.ceil(spot), F.col(value))).alias(f"b{i}"))
    found = ranked.groupBy(*keys).agg(F.first("total").alias("total"), *picks)
    values = []
    for i, a in enumerate(alphas):
        spot = (F.col("total") - 1) * a
        share = spot - F.floor(spot)
        low, high = F.col(f"a{i}"), F.col(f"b{i}")
        values.append(low * (1 - share) + high * share)
    return found.select(*keys, F.array(*values).alias("quantiles"))


def spread_rank(df: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """Rank 1, 2, 2, 4 .. of a value within its group, for groups of any size."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    rows, totals = _bucketed(counts, keys, value, "n", BUCKETS)
    starts = totals.select(*keys, "bucket", "start")
    ranked = _running_count(rows.join(starts, [*keys, "bucket"]), keys, value, "n")
    ranks = ranked.select(*keys, value, (F.col("upto") - F.col("n") + 1).alias(name))
    return df.join(ranks, [*keys, value], "left").select(*df.columns, name)


def _bucketed(counts, keys, value, count, buckets):
    """Rows with their bucket and group total, and per bucket the count of rows below it.

    A bucket is the path of its cuts, an array that sorts like the values. Equal widths leave most
    values in one bucket where one of them lies far off; such a bucket is cut by its own range.
    """
    counts = materialize(counts, "value_counts")
    facts = counts.groupBy(*keys).agg(F.sum(count).alias("total"))
    rows = counts.withColumn("bucket", F.array().cast("array<int>"))
    crowded = None
    while True:
        rows = _cut(rows, crowded, keys, value, buckets)
        sizes = rows.groupBy(*keys, "bucket").agg(F.count("*").alias("values"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        crowded = sizes.where((F.col("values") > BUCKET_LIMIT) & (F.col("lo") < F.col("hi"))).select(*keys, "bucket", "lo", "hi")
        if not crowded.take(1):
            break
        rows, crowded = materialize(rows, "buckets"), materialize(crowded, "crowded")
    if keys:
        rows = rows.join(facts, keys)
    else:
        rows = rows.withColumn("total", facts.select("total").scalar())
    # At most `buckets` rows per group, and as many for each bucket that was cut again.
    totals = rows.groupBy(*keys, "bucket").agg(
        F.sum(count).alias("in_bucket"), F.first("total").alias("total")
    )
    below = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("in_bucket").over(below), F.lit(0))
    return rows, totals.withColumn("start", start)


def _cut(rows, ranges, keys, value, buckets):
    """Append to the path of each row whose bucket has a range; at first that is the group's."""
    if ranges is None:
        ends = rows.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        if keys:
            joined = rows.join(ends, keys)
        else:
            joined = rows.withColumn("f", ends.select(F.struct("lo", "hi")).scalar()).select(*rows.columns, "f.*")
    else:
        joined = rows.join(ranges, [*keys, "bucket"], "left")
    place = F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets)
    at = F.when(F.col("hi") > F.col("lo"), F.least(place, F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int")
    path = F.when(F.col("lo").isNull(), F.col("bucket")).otherwise(F.concat("bucket", F.array(at)))
    return joined.withColumn("bucket", path).select(*rows.columns)


def _running_count(rows, keys, value, count):
    inside = W.partitionBy(*keys, "bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("upto", F.col("start") + F.sum(count).over(inside))


def by_level(df: DataFrame, alphas, column: str = "quantiles", name: str = "value") -> DataFrame:
    """One row per level instead of an array of levels."""
    alphas = check_alphas(alphas)
    pairs = F.array(*[
        F.struct(F.lit(a).alias("quantile_level"), F.col(column)[i].alias(name))
        for i, a in enumerate(alphas)
    ])
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.inline(pairs))
