"""Feature mapping: code -> name and company."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MAPPING_SCHEMA = "feature STRING, feature_name STRING, company_name STRING"


def from_dict(spark: SparkSession, mapping: dict) -> DataFrame:
    rows = [(code, v.get("feature_name"), v.get("company_name")) for code, v in mapping.items()]
    return spark.createDataFrame(rows, MAPPING_SCHEMA)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with feature, feature_name and company_name."""
    return spark.read.schema(MAPPING_SCHEMA).json(path)


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object whose members are codes: ``{"feature_0038": {"feature_name": .., "company_name": ..}, ..}``.

    A file is parsed as a whole: it has one entry for each column of a table.
    """
    entry = "STRUCT<feature_name: STRING, company_name: STRING>"
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"MAP<STRING, {entry}>").alias("m"))
    return parsed.select(F.explode("m").alias("feature", "v")).select("feature", "v.feature_name", "v.company_name")


def rename_features(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rename coded columns to their feature names; the column list bounds what is read."""
    known = mapping.where(F.col("feature").isin(df.columns)).groupBy("feature").agg(
        F.min("feature_name").alias("feature_name")).collect()
    return df.withColumnsRenamed({r["feature"]: r["feature_name"] for r in known})


def attach_names(long: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add feature and company names to long rows that carry a ``feature`` code."""
    return long.join(mapping, "feature", "left")
