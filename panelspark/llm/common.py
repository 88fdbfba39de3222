"""Helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.session import scratch_path


class Stored:
    """A frame written to the shared folder, read back, and deletable once nothing needs it.

    ``options`` go to the Parquet writer: a task holds one row group while it writes and while it reads.
    """

    def __init__(self, df: DataFrame, name: str, **options):
        self.spark, self.path = df.sparkSession, scratch_path(df.sparkSession, name)
        df.write.options(**options).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def delete(self):
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str):
    """Remove a folder of the shared store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body names it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def on_null_safe(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    """Equality of the named columns, nulls equal to nulls."""
    condition = F.lit(True)
    for c in cols:
        condition &= left[c].eqNullSafe(right[c])
    return condition
