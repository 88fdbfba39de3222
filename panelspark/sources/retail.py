"""The demand panel: one row per product, store and day, built from sales lines.

The sales tables are the driver's ``lineitem``, ``part`` and ``supplier``; a product is a
brand and a store is a supplier's nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.operators.filters import date_range

# The day ids count from, and the room left for days and stores in an id.
ID_EPOCH = "1990-01-01"
DAYS_PER_ID, STORES_PER_ID, STORES_PER_SKU = 100_000, 100, 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def demand_panel(spark: SparkSession, sf_dir: str, min_date=None, max_date=None) -> DataFrame:
    """Daily demand per SKU.

    Five narrow columns leave the sales scan, and a date range reaches it as a pushed
    filter. Joins carry no hints: Spark broadcasts part and supplier while they are small
    and falls back to sort-merge with skew splitting. The last aggregation combines
    map-side, so a SKU with very many sales lines still yields one row per day and task.
    Money is summed in whole cents, which makes the price independent of row order.
    """
    sales = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.col("l_shipdate").cast("date").alias("date"),
    )
    sales = date_range(sales, min_date, max_date)
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("productID"),
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("storeID")
    )
    daily = (
        sales.join(part, "l_partkey").join(supplier, "l_suppkey")
        .groupBy("productID", "storeID", "date")
        .agg(
            F.sum("l_quantity").alias("target"),
            F.sum("cents").alias("cents"),
            F.max("l_discount").alias("disc"),
            F.min("l_returnflag").alias("flag"),
        )
    )
    day = F.datediff("date", F.lit(ID_EPOCH).cast("date"))
    # A store number beyond its room would give two SKUs one id.
    store = F.when(F.col("storeID").between(0, STORES_PER_ID - 1), F.col("storeID")).otherwise(
        F.raise_error(F.concat(F.lit("store number out of range: "), F.col("storeID").cast("string"))))
    sku = F.col("productID").cast("bigint") * STORES_PER_ID + store
    return daily.select(
        "productID", "storeID",
        (F.col("productID") * STORES_PER_SKU + F.col("storeID")).alias("skuID"),
        F.lit("daily").alias("frequency"),
        (sku * DAYS_PER_ID + day).alias("bdID"),
        "date", "target",
        F.try_divide(F.col("cents") / 100, F.col("target")).alias("price"),
        "disc",
        F.when(F.col("flag") == "R", 1).otherwise(0).alias("not_for_sale"),
    )


def feature_frame(panel: DataFrame) -> DataFrame:
    return panel.drop("target")


def target_frame(panel: DataFrame) -> DataFrame:
    return panel.select("bdID", "date", "target")


def store_whitelist(spark: SparkSession, sf_dir: str, panel: DataFrame, regions=(0, 1)) -> DataFrame:
    """SKUs whose store lies in the given regions, with the store's name."""
    nation = table(spark, sf_dir, "nation").where(F.col("n_regionkey").isin(list(regions)))
    stores = nation.select(F.col("n_nationkey").alias("storeID"), F.col("n_name").alias("name"))
    return panel.select("productID", "storeID").distinct().join(stores, "storeID")
