import dataclasses
import glob
import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelspark.config import DataConfig, ModelConfig, Strategy, check_skus
from panelspark.models import registry
from panelspark.operators import checks, features
from panelspark.plans.experiment import ForecastBench, lookup, predict_saved
from panelspark.sources import arrow_ipc, columnar, mapping

ALPHAS = [0.5, 0.9]


@pytest.fixture(scope="module")
def bench(spark, panel, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    kept = panel.where("storeID BETWEEN 1 AND 6")
    lags = features.lag_features(kept, "target", 2)
    lags.drop("target", "frequency").write.parquet(f"{root}/features")
    kept.select("bdID", "date", "target").write.parquet(f"{root}/targets")
    return ForecastBench(spark, DataConfig(f"{root}/features", f"{root}/targets", split_date="1999-06-01"))


def test_individual_empirical(bench):
    found = bench.run_experiment(None, Strategy.INDIVIDUAL, "empirical_quantile", {}, ALPHAS, "own")
    table = found.results.toPandas()
    assert set(table.quantile_level) == set(ALPHAS) and (table.mean_quantile_loss >= 0).all()
    assert not table.duplicated(["productID", "storeID", "quantile_level"]).any()
    ids = [r["model_id"] for r in found.identified().take(3)]
    assert all(i.startswith("empirical_quantile_individual_") and "_q0." in i for i in ids)
    assert found.performance_summary().first()["n_models"] == len(table)
    assert found.evaluation_summary().first()["std"] is not None


@pytest.mark.parametrize("model_type, params, alphas", [
    ("empirical_quantile", {}, ALPHAS), ("linear_quantile", {"max_iter": 50}, ALPHAS),
    ("gbt_regress", {"n_estimators": 2, "max_depth": 2}, None),
    ("gbt_quantile", {"n_estimators": 2, "max_depth": 2}, [0.7]),
])
@pytest.mark.parametrize("strategy", list(Strategy))
def test_every_model_type_runs_both_ways(bench, model_type, params, alphas, strategy):
    found = bench.run_experiment([(2, 3), (5, 1), (9, 2), (11, 6)], strategy, model_type, params, alphas, "all")
    table = found.results.toPandas()
    assert len(table) >= 1 and table[found.metric_names].notna().all().all()
    if strategy is Strategy.COMBINED:
        assert len(table) == len(alphas or [None])


def test_release_holds_bundle_members_metrics_and_models(bench, tmp_path):
    found = bench.run_experiment(None, Strategy.INDIVIDUAL, "empirical_quantile", {"note": "x"}, ALPHAS, "rel")
    root = found.release(str(tmp_path))
    bundle = json.loads("".join(open(f).read() for f in glob.glob(f"{root}/bundle/*.json")))
    assert bundle["quantiles"] == ALPHAS and bundle["experiment_name"] == "rel"
    assert bundle["num_models"] == found.results.count()
    assert bundle["hyperparameters"]["note"] == "x"
    assert sorted(os.listdir(f"{root}/members"))[-3:] == ["kind=product", "kind=sku", "kind=store"]
    assert os.path.isdir(f"{root}/metrics/quantile_key=0.5")
    assert os.path.isdir(f"{root}/model_params/model_type=empirical_quantile/quantile_level=0.9")


def test_release_of_a_combined_standard_model(bench, tmp_path):
    found = bench.run_experiment(None, Strategy.COMBINED, "gbt_regress", {"n_estimators": 2}, None, "std")
    root = found.release(str(tmp_path))
    lines = [json.loads(x) for f in glob.glob(f"{root}/metrics/quantile_key=standard/*.json") for x in open(f)]
    assert len(lines) == 1 and lines[0]["sku_key"].startswith("combined_") and lines[0]["sku_key"].endswith("_etc")


def test_tuning(bench):
    found = bench.run_experiment(
        None, Strategy.COMBINED, "gbt_regress", mode="hp_tune", tune_on=5,
        tuning_config={"n_trials": 1, "n_folds": 2, "fixed": {"n_estimators": 2, "max_depth": 2}})
    assert found.n_skus_sampled == 5 and found.best_score > 0 and found.best_params["n_estimators"] == 2


def test_fraction_split_and_filters(bench, spark):
    data = bench.data
    config = DataConfig(data.features_path, data.target_path, test_fraction=0.3, min_date="1996-01-01",
                        max_date="2000-12-31", default_stores=(1, 2, 3, 4), default_products=tuple(range(1, 20)))
    rows = ForecastBench(spark, config).modeling_rows(None, Strategy.INDIVIDUAL)
    seen = rows.agg(F.min("date"), F.max("date"), F.max("storeID"), F.max("not_for_sale")).first()
    assert str(seen[0]) >= "1996-01-01" and str(seen[1]) <= "2000-12-31" and seen[2] <= 4 and seen[3] == 0


@pytest.mark.parametrize("call", [
    {"mode": "other"}, {"mode": "hp_tune"}, {"model_type": "nothing", "hyperparameters": {}},
    {"model_type": "gbt_regress"}, {"model_type": "empirical_quantile", "hyperparameters": {}},
    {"sku_tuples": []}, {"sku_tuples": [(1, 0)]}, {"sku_tuples": [(1, 2, 3)]},
])
def test_wrong_calls_raise(bench, call):
    with pytest.raises(ValueError):
        bench.run_experiment(**call)


def test_config_checks():
    for bad in ([0.0], [1.2]):
        with pytest.raises(ValueError):
            ModelConfig("m", {}, bad)
    with pytest.raises(TypeError):
        ModelConfig("m", [], None)
    with pytest.raises(ValueError):
        ModelConfig("", {})
    with pytest.raises(TypeError):
        check_skus(((1, 2),))
    given = {}
    assert ModelConfig("m", given).settings["random_state"] == 42 and given == {}
    with pytest.raises(ValueError, match=r"\(0, 2\).*'x'"):
        check_skus([(1, 2), (0, 2), "x"])


def test_other_column_names_give_the_same_results(bench, spark, tmp_path):
    data = bench.data
    for part, path in (("f", data.features_path), ("t", data.target_path)):
        names = {"bdID": "row", "date": "day", "target": "sales"}
        spark.read.parquet(path).withColumnsRenamed(names).write.parquet(str(tmp_path / part))
    other = ForecastBench(spark, dataclasses.replace(
        data, features_path=str(tmp_path / "f"), target_path=str(tmp_path / "t"), id_column="row", date_column="day",
        target_column="sales"))
    for model, params, strategy in (("linear_quantile", {}, Strategy.COMBINED), ("gbt_quantile", {"n_estimators": 2}, Strategy.INDIVIDUAL)):
        found = [b.run_experiment([(1, 3), (1, 7), (12, 3)], strategy, model, params, [0.7]) for b in (bench, other)]
        assert found[0].setup.features == found[1].setup.features
        losses = [sorted(r["mean_quantile_loss"] for r in f.results.collect()) for f in found]
        assert losses[0] == pytest.approx(losses[1])
    tuned = other.run_experiment(None, Strategy.COMBINED, "gbt_regress", mode="hp_tune", tune_on=3,
                                 tuning_config={"n_trials": 1, "n_folds": 2, "fixed": {"n_estimators": 1, "max_depth": 2}})
    assert tuned.best_score > 0


def test_models_are_fitted_once(bench, monkeypatch, tmp_path):
    calls = []
    plain = registry.get("linear_quantile")
    counted = dataclasses.replace(plain, fit=lambda train, s: calls.append(1) or plain.fit(train, s))
    monkeypatch.setitem(registry._TYPES, "linear_quantile", counted)
    found = bench.run_experiment([(1, 3), (1, 7)], Strategy.COMBINED, "linear_quantile", {}, [0.5])
    found.results.collect()
    found.performance_summary().collect()
    found.release(str(tmp_path))
    assert len(calls) == 1
    for table in (found.results, found.predictions):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "InPandas" not in plan and "Scan parquet" in plan
    facts = found.results.first()
    assert facts["n_train"] > 0 and facts["n_test"] > 0 and facts["split_date"] is not None


def test_fewer_skus_than_asked_for(bench):
    there = sorted(tuple(r) for r in bench.modeling_rows(None, Strategy.COMBINED).select("productID", "storeID").distinct().collect())
    found = bench.run_experiment(
        there[:3], Strategy.COMBINED, "gbt_regress", mode="hp_tune", tune_on=100,
        tuning_config={"n_trials": 1, "n_folds": 2, "fixed": {"n_estimators": 1, "max_depth": 2}})
    assert found.n_skus_sampled == 3


@pytest.mark.parametrize("params,alphas,strategy", [
    ({"tree_method": "hist"}, None, Strategy.COMBINED), ({"max_leaves": 4}, None, Strategy.INDIVIDUAL),
    ({"scale_pos_weight": 0.5}, [0.5], Strategy.COMBINED)])
def test_tree_parameters_without_effect_are_refused(bench, params, alphas, strategy):
    model = "gbt_quantile" if alphas else "gbt_regress"
    with pytest.raises(ValueError, match="no effect"):
        bench.run_experiment([(1, 3)], strategy, model, {"n_estimators": 1, **params}, alphas)


@pytest.mark.parametrize("params,strategy", [
    ({"reg_alpha": 500.0}, Strategy.COMBINED), ({"reg_lambda": 300.0}, Strategy.INDIVIDUAL), ({"subsample": 0.5}, Strategy.COMBINED)])
def test_penalties_and_draws_have_an_effect(bench, params, strategy):
    skus = [(2, 3), (5, 1), (9, 2), (11, 6)]
    plain, other = (bench.run_experiment(skus, strategy, "gbt_regress", {"n_estimators": 2, "max_depth": 2, **p}) for p in ({}, params))
    one, two = (f.predictions.orderBy("bdID").toPandas().prediction for f in (plain, other))
    assert len(one) == len(two) and not np.allclose(one, two)


def test_strict_sku_check(spark):
    bad = spark.createDataFrame([(1, 2), (0, 3), (None, 1)], "productID int, storeID int")
    with pytest.raises(ValueError, match="not positive|missing"):
        checks.assert_valid_skus(bad)
    with pytest.raises(ValueError):
        checks.assert_valid_skus(bad.limit(0))


def test_lookup(spark):
    rows = spark.createDataFrame(
        [("a", "combined", 0.5), ("a", "individual", None), ("b", "individual", 0.9)],
        "model_type string, modeling_strategy string, quantile_level double")
    assert lookup(rows, Strategy.INDIVIDUAL).count() == 2
    assert lookup(rows, quantile_only=True).count() == 2
    assert lookup(rows, Strategy.INDIVIDUAL, True, "b").count() == 1


def test_known_model_types():
    assert {"empirical_quantile", "linear_quantile", "gbt_regress", "gbt_quantile"} <= set(registry.available())


def test_arrow_ranges_hold_each_batch_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "some.feather")
    schema = pa.schema([("a", pa.int64()), ("b", pa.string())])
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, schema) as writer:
        for part in ([1, 2], [3], [4], [5, 6], [7]):
            writer.write_batch(pa.record_batch([pa.array(part), pa.array([str(v) for v in part])], schema=schema))
    for size, ranges in ((1 << 20, 1), (os.path.getsize(path) // 3 + 1, 3), (1, os.path.getsize(path))):
        monkeypatch.setattr(arrow_ipc, "RANGE_BYTES", size)
        reader = arrow_ipc.ArrowReader(path, arrow_ipc.from_arrow_schema(schema))
        plan = reader.partitions()
        assert len(plan) == ranges
        found = [[r for batch in reader.read(p) for r in batch.column("a").to_pylist()] for p in plan]
        assert [v for part in found for v in part] == list(range(1, 8))
    monkeypatch.undo()
    df = arrow_ipc.read(spark, path)
    assert sorted(tuple(r) for r in df.collect()) == [(i, str(i)) for i in range(1, 8)]
    assert sorted(r["b"] for r in arrow_ipc.read(spark, path, "b string").collect()) == [str(i) for i in range(1, 8)]


def test_arrow_round_trip(spark, panel, tmp_path):
    path = str(tmp_path / "panel")
    arrow_ipc.write(panel, path)
    arrow_ipc.write(panel, path, "overwrite")
    back = columnar.read_table(spark, path, "arrow")
    assert back.schema.simpleString() == panel.schema.simpleString()
    assert back.exceptAll(panel).isEmpty() and back.count() == panel.count()


def test_feature_mapping(spark, tmp_path):
    names = mapping.from_dict(spark, {"feature_0038": {"feature_name": "sales_0", "company_name": "c"}})
    names.write.json(str(tmp_path / "m"))
    df = spark.createDataFrame([(1, 2)], "feature_0038 int, other int")
    assert mapping.rename_features(df, mapping.read_mapping(spark, str(tmp_path / "m"))).columns == ["sales_0", "other"]


@pytest.mark.parametrize("model_type, params, alphas", [
    ("empirical_quantile", {}, ALPHAS), ("linear_quantile", {"max_iter": 30}, ALPHAS),
    ("gbt_regress", {"n_estimators": 2, "max_depth": 2}, None), ("gbt_quantile", {"n_estimators": 2, "max_depth": 2}, ALPHAS)])
@pytest.mark.parametrize("strategy", list(Strategy))
def test_saved_models_predict_as_before(bench, spark, tmp_path, model_type, params, alphas, strategy):
    found = bench.run_experiment([(2, 3), (5, 1), (9, 2), (11, 6)], strategy, model_type, params, alphas, "kept")
    root = found.release(str(tmp_path))
    again = predict_saved(spark, root, found.rows.where("split = 'test'"), model_type, found.setup)
    cols = ["bdID", "quantile_level", "prediction"]
    one, two = (df.select(cols).toPandas().sort_values(cols[:2]) for df in (found.predictions, again))
    assert len(one) and (one.bdID.values == two.bdID.values).all() and np.allclose(one.prediction, two.prediction)


def test_trees_are_fitted_without_scoring(bench):
    found = bench.run_experiment([(2, 3), (5, 1)], Strategy.INDIVIDUAL, "gbt_quantile", {"n_estimators": 2}, [0.5], evaluate_on_test=False)
    assert found.results is None and found.models().count() > 0
