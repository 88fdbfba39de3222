"""Sources and sinks. Sinks write below the shared folder and the query reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelspark.catalog.base import (
    ALPHAS, LAGS, experiment_results, individual_results, modeling, panel, prepared, query, rounded, with_ctes,
)
from panelspark.config import SKU_KEYS, ModelConfig, Strategy
from panelspark.models import empirical
from panelspark.operators import features, quantiles
from panelspark.plans import experiment
from panelspark.session import materialize, scratch_path
from panelspark.sources import arrow_ipc, columnar, mapping, release, retail

_PANEL = "bdID, productID, storeID, skuID, date, target, price, disc, not_for_sale"
_RESULT_SCHEMA = "productID INT, storeID INT, quantile_level DOUBLE, mean_quantile_loss DOUBLE, hp_type STRING, model_type STRING"


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem")
def src_columnar(spark, sf):
    df = columnar.read_table(spark, f"{sf}/lineitem.parquet")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query(with_ctes(f"SELECT {_PANEL} FROM panel", "panel"))
def src_arrow_ipc(spark, sf):
    path = scratch_path(spark, "arrow")
    arrow_ipc.write(panel(spark, sf).select(*_PANEL.split(", ")), path)
    return columnar.read_table(spark, path, "arrow")


@query(with_ctes("SELECT productID, storeID, quantile_level, mean_quantile_loss, hp_type, model_type FROM results",
                 "results"))
def src_csv_typed(spark, sf):
    path = scratch_path(spark, "csv")
    columnar.write_csv(experiment_results(spark, sf).select(*[c.split()[0] for c in _RESULT_SCHEMA.split(", ")]), path)
    return columnar.read_csv(spark, path, _RESULT_SCHEMA)


@query(with_ctes("SELECT productID, storeID, quantile_level, mean_quantile_loss FROM individual_results",
                 "individual_results"))
def sink_csv(spark, sf):
    path = scratch_path(spark, "csv")
    columnar.write_csv(individual_results(spark, sf).select(*SKU_KEYS, "quantile_level", "mean_quantile_loss"), path)
    return columnar.read_csv(
        spark, path, "productID INT, storeID INT, quantile_level DOUBLE, mean_quantile_loss DOUBLE")


@query(with_ctes("""
    SELECT n_name || '_' || CAST(year(date) AS VARCHAR) AS feature_name, r_name AS company_name, sum(target) AS total
    FROM panel JOIN nation ON n_nationkey = storeID JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""", "panel"))
def src_feature_mapping(spark, sf):
    """Codes made from store and year, named by a mapping file written from the store tables."""
    df = panel(spark, sf)
    code = F.format_string("feature_%02d_%04d", F.col("storeID"), F.year("date"))
    coded = df.groupBy("storeID", F.year("date").alias("year")).agg(F.sum("target").alias("total")).select(
        F.format_string("feature_%02d_%04d", F.col("storeID"), F.col("year")).alias("feature"), "total")
    nation, region = retail.table(spark, sf, "nation"), retail.table(spark, sf, "region")
    names = (
        df.select("storeID", F.year("date").alias("year"), code.alias("feature")).distinct()
        .join(nation, F.col("storeID") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("feature", F.concat_ws("_", "n_name", F.col("year").cast("string")).alias("feature_name"),
                F.col("r_name").alias("company_name"))
    )
    path = scratch_path(spark, "mapping")
    names.write.json(path)
    named = mapping.attach_names(coded, mapping.read_mapping(spark, path))
    return named.drop("feature")


@query(with_ctes(f"SELECT {_PANEL} FROM panel", "panel"))
def sink_columnar(spark, sf):
    path = scratch_path(spark, "features")
    df = panel(spark, sf).select(*_PANEL.split(", "))
    columnar.write_features(df, path)
    return columnar.read_table(spark, path, schema=df.schema)


_LAGGED = ", ".join(f"lag(target, {k}) OVER (PARTITION BY skuID ORDER BY date) AS target_lag_{k}" for k in LAGS)


@query(with_ctes(f"SELECT {_PANEL}, {_LAGGED} FROM panel", "panel"))
def sink_columnar_bucketed(spark, sf):
    """The panel in buckets by SKU, sorted by day; lags over the stored table need no shuffle."""
    path, table = scratch_path(spark, "bucketed"), f"panel_{uuid.uuid4().hex}"
    stored = columnar.write_bucketed(panel(spark, sf).select(*_PANEL.split(", "), "frequency"), table, path, 8)
    return features.lag_features(stored, "target", LAGS).drop("frequency")


@query(with_ctes("""
    SELECT year(date) AS year, sum(target) FILTER (storeID = 3) AS "NATION_3 sales", sum(target) FILTER (storeID = 7) AS "NATION_7 sales",
           sum(target) FILTER (storeID = 15) AS "NATION_15 sales" FROM panel WHERE storeID IN (3, 7, 15) GROUP BY year(date)""", "panel"))
def rename_features(spark, sf):
    """Coded columns named by a mapping stored as one nested object."""
    df = panel(spark, sf).where(F.col("storeID").isin(3, 7, 15))
    coded = df.groupBy(F.year("date").cast("long").alias("year")).agg(
        *[F.sum(F.when(F.col("storeID") == k, F.col("target"))).alias(f"feature_{k:04d}") for k in (3, 7, 15)])
    nation, region = retail.table(spark, sf, "nation"), retail.table(spark, sf, "region")
    named = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.format_string("feature_%04d", F.col("n_nationkey")).alias("code"),
        F.struct(F.concat_ws(" ", "n_name", F.lit("sales")).alias("feature_name"), F.col("r_name").alias("company_name")).alias("entry"))
    path = scratch_path(spark, "mapping")
    named.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("code", "entry"))))).write.text(path)
    return mapping.rename_features(coded, mapping.read_nested(spark, path))


@query(with_ctes("""
    SELECT 'header' AS part, 'empirical_quantile' AS name, CAST(NULL AS INTEGER) AS productID,
           CAST(NULL AS INTEGER) AS storeID, count(*) AS n FROM individual_results
    UNION ALL SELECT 'quantile', CAST(quantile_level AS VARCHAR), NULL, NULL, 1 FROM individual_results
              GROUP BY quantile_level
    UNION ALL SELECT DISTINCT 'sku', 'sku', productID, storeID, 1 FROM individual_results
    UNION ALL SELECT DISTINCT 'product', 'product', productID, NULL, 1 FROM individual_results
    UNION ALL SELECT DISTINCT 'store', 'store', NULL, storeID, 1 FROM individual_results""", "individual_results"))
def sink_release_bundle(spark, sf):
    """The bundle of a release, written, read back and laid out as rows."""
    results = materialize(individual_results(spark, sf), "results")
    path = scratch_path(spark, "release")
    release.write_release(results, results, None, path, "all_skus")
    root = release.current(spark, path, "all_skus")
    header = spark.read.schema(
        "model_type string, quantiles array<double>, num_models bigint").json(f"{root}/bundle")
    none = F.lit(None).cast("int")
    head = header.select(F.lit("header").alias("part"), F.col("model_type").alias("name"),
                         none.alias("productID"), none.alias("storeID"), F.col("num_models").alias("n"))
    levels = header.select(F.explode("quantiles").alias("q")).select(
        F.lit("quantile").alias("part"), F.col("q").cast("string").alias("name"),
        none.alias("productID"), none.alias("storeID"), F.lit(1).cast("bigint").alias("n"))
    members = spark.read.schema("kind string, productID int, storeID int").json(f"{root}/members").select(
        F.col("kind").alias("part"), F.col("kind").alias("name"), *SKU_KEYS, F.lit(1).cast("bigint").alias("n"))
    return head.unionByName(levels).unionByName(members)


@query(with_ctes("""
    SELECT CAST(quantile_level AS VARCHAR) AS quantile_key, '(' || productID || ', ' || storeID || ')' AS sku_key,
           mean_quantile_loss AS metric_value FROM individual_results""", "individual_results"))
def sink_release_metrics(spark, sf):
    results = materialize(individual_results(spark, sf), "results")
    path = scratch_path(spark, "release")
    release.write_release(results, results, None, path, "all_skus")
    root = release.current(spark, path, "all_skus")
    return spark.read.schema("quantile_key string, sku_key string, metric_value double").json(
        f"{root}/metrics")


@query(with_ctes("""
    SELECT 'empirical_quantile' AS model_type, quantile_level, productID, storeID, round(q, 9) AS value
    FROM model_individual""", "model_individual"))
def sink_models(spark, sf):
    train = modeling(spark, sf).where(F.col("split") == "train")
    models = quantiles.by_level(empirical.fit(train, list(SKU_KEYS), ALPHAS), ALPHAS).withColumn(
        "model_type", F.lit("empirical_quantile"))
    path = scratch_path(spark, "models")
    release.write_models(models, path)
    saved = spark.read.schema(
        "productID int, storeID int, value double, model_type string, quantile_level double").parquet(path)
    return rounded(saved, "value")


_FOUR = {"empirical_quantile": ({}, [0.5, 0.9]), "linear_quantile": ({}, [0.5, 0.9]),
         "gbt_regress": ({"n_estimators": 2, "max_depth": 2}, None), "gbt_quantile": ({"n_estimators": 2, "max_depth": 2}, [0.5, 0.9])}


@query(with_ctes("""
    SELECT m.model_type, s.strategy, m.quantile_level, s.n AS n_rows, true AS same
    FROM (SELECT unnest(['empirical_quantile', 'linear_quantile', 'gbt_quantile']) AS model_type, unnest([[0.5, 0.9], [0.5, 0.9], [0.5, 0.9]]) AS l) t,
         LATERAL (SELECT t.model_type, unnest(t.l)::DOUBLE AS quantile_level) m, sizes s
    UNION ALL SELECT 'gbt_regress', strategy, NULL, n, true FROM sizes""", "modeling", sizes="""
    SELECT 'combined' AS strategy, count(*) AS n FROM modeling WHERE split = 'test' UNION ALL
    SELECT 'individual', count(*) FROM modeling WHERE split = 'test'
      AND (productID, storeID) IN (SELECT productID, storeID FROM modeling WHERE split = 'train')"""))
def sink_models_all(spark, sf):
    """Every model type under both strategies: fitted, stored as rows, read back. Do the stored ones predict as before?"""
    rows = prepared(spark, sf)
    out = None
    for strategy in Strategy:
        for model_type, (params, alphas) in _FOUR.items():
            config = ModelConfig(model_type, params, alphas)
            setup = experiment.setup_of(rows, config, strategy, features=["price", "disc", "target_lag_1"])
            fitted, predicted = experiment.fit_predict(rows, model_type, setup)
            found = experiment.ExperimentResults("all", config, strategy, predicted, None, fitted, rows, setup)
            root = scratch_path(spark, "models")
            release.write_models(found.models(), f"{root}/model_params")
            again = experiment.predict_saved(spark, root, rows.where(F.col("split") == "test"), model_type, setup)
            cols = ["bdID", "quantile_level"]
            both = predicted.select(*cols, "prediction").join(
                again.select(*[F.col(c).alias(f"_{c}") for c in cols], F.col("prediction").alias("stored")),
                (F.col("bdID") == F.col("_bdID")) & F.col("quantile_level").eqNullSafe(F.col("_quantile_level")), "full")
            part = both.groupBy("quantile_level").agg(
                F.count("prediction").alias("n_rows"),
                F.coalesce(F.max(F.abs(F.col("prediction") - F.col("stored"))) <= 1e-9, F.lit(False)).alias("close"),
                (F.count("prediction") == F.count("stored")).alias("all")).select(
                F.lit(model_type).alias("model_type"), F.lit(strategy.value).alias("strategy"), "quantile_level", "n_rows",
                (F.col("close") & F.col("all")).alias("same"))
            out = part if out is None else out.unionByName(part)
    return out
