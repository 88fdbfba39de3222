"""Text labels for models, SKUs and table cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mean_std_text(avg: Column, std: Column, digits: int = 3) -> Column:
    """``avg ± std``, both rounded."""
    return F.concat(
        F.round(avg, digits).cast("string"), F.lit(" ± "), F.round(std, digits).cast("string")
    )


def bold(text: Column, where: Column) -> Column:
    return F.when(where, F.concat(F.lit("**"), text, F.lit("**"))).otherwise(text)


def model_id(model_type: Column, strategy: Column, n_skus: Column,
             product: Column, store: Column, alpha: Column) -> Column:
    """``type_strategy_PxS_qA``, or ``Nskus`` for a model of several SKUs."""
    one = F.concat(product.cast("string"), F.lit("x"), store.cast("string"))
    many = F.concat(n_skus.cast("string"), F.lit("skus"))
    level = F.when(alpha.isNotNull(), F.concat(F.lit("q"), alpha.cast("string")))
    return F.concat_ws("_", model_type, strategy, F.when(n_skus > 1, many).otherwise(one), level)


def sku_key(skus: Column) -> Column:
    """Label of a model's SKUs, given as array of (productID, storeID) structs.

    One SKU reads ``(p, s)``; several read ``combined_`` plus the first two and ``_etc``.
    """
    pair = F.format_string("(%d, %d)", skus[0]["productID"], skus[0]["storeID"])
    first_two = F.transform(
        F.slice(skus, 1, 2), lambda s: F.concat_ws("_", s["productID"], s["storeID"])
    )
    tail = F.when(F.size(skus) > 2, F.lit("_etc")).otherwise(F.lit(""))
    several = F.concat(F.lit("combined_"), F.array_join(first_two, "_"), tail)
    return (
        F.when(F.size(skus) == 0, F.lit("all"))
        .when(F.size(skus) == 1, pair)
        .otherwise(several)
    )
