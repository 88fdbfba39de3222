"""A release of an experiment: bundle, metrics and fitted models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value: the quantile key of a model without a quantile level.
STANDARD = "standard"


def quantile_key(level):
    return F.coalesce(level.cast("string"), F.lit(STANDARD))


def bundle(results: DataFrame, experiment_name: str, hyperparameters: dict | None = None) -> DataFrame:
    """One row: model type, quantile levels, hyper-parameters and counts.

    Levels are given by the user, so their set is small. SKUs and ids are as many as the
    data has; they stay rows, see :func:`bundle_members`.
    """
    params = hyperparameters or {}
    pairs = [x for k, v in sorted(params.items()) if k != "quantile_alphas" for x in (F.lit(k), F.lit(str(v)))]
    settings = F.create_map(*pairs) if pairs else F.expr("map()").cast("map<string,string>")
    return results.agg(
        F.min("model_type").alias("model_type"),
        F.array_sort(F.collect_set("quantile_level")).alias("quantiles"),
        F.count("*").alias("num_models"),
    ).withColumns({"experiment_name": F.lit(experiment_name), "hyperparameters": settings})


def bundle_members(skus: DataFrame) -> DataFrame:
    """The distinct SKUs, product ids and store ids of a release as rows of one table."""
    none = F.lit(None).cast("int")
    pairs = skus.select(F.lit("sku").alias("kind"), "productID", "storeID")
    products = skus.select(F.lit("product").alias("kind"), "productID", none.alias("storeID"))
    stores = skus.select(F.lit("store").alias("kind"), none.alias("productID"), "storeID")
    return pairs.unionByName(products).unionByName(stores).distinct()


def release_metrics(results: DataFrame, value: str = "mean_quantile_loss") -> DataFrame:
    """Flat metrics: quantile key, SKU label, value."""
    label = F.col("sku_key") if "sku_key" in results.columns else F.format_string(
        "(%d, %d)", F.col("productID"), F.col("storeID"))
    return results.select(
        quantile_key(F.col("quantile_level")).alias("quantile_key"),
        label.alias("sku_key"), F.col(value).alias("metric_value"),
    )


def write_release(results: DataFrame, skus: DataFrame, models: DataFrame | None, path: str,
                  experiment_name: str, hyperparameters: dict | None = None,
                  value: str = "mean_quantile_loss") -> str:
    """Write ``bundle``, ``members``, ``metrics`` and ``model_params`` into a new folder of ``path/experiment_name`` and
    return it.

    A release counts once its manifest is there, which is written last; :func:`current` names the newest such folder. A
    write that fails leaves the release before it whole. Members and metrics are JSON lines and models are parquet, so they
    are written by all tasks; only the one-row bundle comes from a single task. Results and SKUs are read once or more: give written
    tables.
    """
    spark = results.sparkSession
    home = f"{path.rstrip('/')}/{experiment_name}"
    number = max([n for n, _ in _manifests(spark, home)], default=0) + 1
    root = f"{home}/release-{number:06d}-{uuid.uuid4().hex[:8]}"
    bundle(results, experiment_name, hyperparameters).write.json(f"{root}/bundle")
    bundle_members(skus).write.partitionBy("kind").json(f"{root}/members")
    release_metrics(results, value).write.partitionBy("quantile_key").json(f"{root}/metrics")
    if models is not None:
        write_models(models, f"{root}/model_params")
    _commit(spark, home, number, root.rsplit("/", 1)[1])
    return root


def _store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, home: str) -> list[tuple[int, str]]:
    """Number and folder of each committed release; both are in the manifest's name."""
    place, fs = _store(spark, f"{home}/manifests")
    if not fs.exists(place):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(place)]
    return sorted((int(n.split(".", 1)[0]), n.split(".", 1)[1]) for n in names if not n.startswith((".", "_")))


def _commit(spark: SparkSession, home: str, number: int, folder: str) -> None:
    """One file, whose name says it all, appears at once or not at all."""
    place, fs = _store(spark, f"{home}/manifests/{number:06d}.{folder}")
    fs.create(place, False).close()


def current(spark: SparkSession, path: str, experiment_name: str) -> str:
    """The folder of the newest committed release."""
    home = f"{path.rstrip('/')}/{experiment_name}"
    found = _manifests(spark, home)
    if not found:
        raise FileNotFoundError(f"no release in {home}")
    return f"{home}/{found[-1][1]}"


def write_models(models: DataFrame, path: str) -> None:
    """Fitted models are rows; folders name the model type and the quantile level where there is one."""
    folders = [c for c in ("model_type", "quantile_level") if c in models.columns]
    models.write.mode("overwrite").partitionBy(*folders).parquet(path)
