"""Feature and target tables by format; reading is always lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspark.config import DataConfig
from panelspark.sources import arrow_ipc


def read_table(spark: SparkSession, path: str, file_format: str = "parquet", schema=None) -> DataFrame:
    if file_format == "arrow":
        return arrow_ipc.read(spark, path, schema)
    reader = spark.read.format(file_format)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def load(spark: SparkSession, config: DataConfig) -> tuple[DataFrame, DataFrame]:
    """Feature frame and target frame of a run."""
    return (
        read_table(spark, config.features_path, config.file_format),
        read_table(spark, config.target_path, config.file_format),
    )


def write_features(df: DataFrame, path: str, partition_by=("storeID",)) -> None:
    """Write processed features; store folders let a later SKU filter prune files.

    Rows meet by folder first, or each task would write a file into each; a folder with very many
    rows is split by adaptive execution.
    """
    df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, keys=("skuID",), order=("date",)) -> DataFrame:
    """Write a panel in buckets by series, sorted within, as a table at ``path``; returns it.

    Rows of a series lie in one file in order of time, so windows, splits and fits per series read the table without a
    shuffle. Another session opens it by :func:`open_bucketed`.
    """
    placed = df.repartition(buckets, *keys).sortWithinPartitions(*keys, *order)
    placed.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, *order).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def open_bucketed(spark: SparkSession, table: str, path: str, schema, buckets: int, keys=("skuID",), order=("date",)) -> DataFrame:
    """Declare a table that :func:`write_bucketed` wrote, where the session does not know it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    names = lambda cols: ", ".join(f"`{c}`" for c in cols)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({names(keys)}) "
              f"SORTED BY ({names([*keys, *order])}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header and a given schema, so nothing is inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
