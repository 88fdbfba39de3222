"""Expressions that set one value against another without dividing by zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rel_diff_pct(value: Column, base: Column) -> Column:
    """Percent change against a base: 0 for 0/0, 100 for x/0."""
    return (
        F.when((value == 0) & (base == 0), F.lit(0.0))
        .when(base == 0, F.lit(100.0))
        .otherwise((value / base - 1) * 100)
    )


def mean_shift_pct(later: Column, earlier: Column) -> Column:
    """Percent shift of a mean; null where the earlier mean is zero or missing."""
    return (F.try_divide(later, earlier) - 1) * 100


def seeded_order(seed: int, *keys) -> Column:
    """A text that orders rows at random but the same way for a seed, on any engine."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *keys))


def seeded_bucket(seed: int, n: int, *keys) -> Column:
    """A number 0..n-1 per row, fixed by the seed and the row's keys."""
    head = F.substring(seeded_order(seed, *keys), 1, 8)
    return (F.conv(head, 16, 10).cast("bigint") % n).cast("int")
