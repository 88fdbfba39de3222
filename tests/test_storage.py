"""Arrow pushdown, bucketed tables, releases, mappings, sketches, samples and folds."""

import datetime
import glob
import json
import os

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from panelspark.models import registry
from panelspark.models.registry import Setup
from panelspark.operators import checks, features, sampling, sketches
from panelspark.sources import arrow_ipc, columnar, mapping, release


# ---- Arrow ------------------------------------------------------------------------------

def batches_read(path, schema, filters, monkeypatch):
    """Batches that a reader decodes under these conditions, and the rows it sends on."""
    reader = arrow_ipc.ArrowReader(path, schema)
    assert list(reader.pushFilters(filters)) == filters
    seen, plain = [], arrow_ipc.ArrowReader._wanted
    monkeypatch.setattr(arrow_ipc.ArrowReader, "_wanted", lambda *a: seen.extend(found := plain(*a)) or found)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    monkeypatch.undo()
    return len(seen), rows


def test_a_date_filter_reads_fewer_batches(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "days")
    day = datetime.date(2000, 1, 1)
    rows = [(day + datetime.timedelta(i), i % 5, f"t{i % 3}", float(i)) for i in range(1000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    df = spark.createDataFrame(rows, "date date, a int, b string, x double").coalesce(2)
    arrow_ipc.write(df, path)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    back = arrow_ipc.read(spark, path)
    every, _ = batches_read(path, back.schema, [], monkeypatch)
    late = day + datetime.timedelta(900)
    some, found = batches_read(path, back.schema, [GreaterThanOrEqual(("date",), late)], monkeypatch)
    assert every >= 20 and some <= every // 5
    assert sorted(r["x"] for r in found) == [float(i) for i in range(900, 1000)]
    for condition, keep in (([EqualTo(("b",), "t1"), LessThan(("date",), late)], lambda r: r[2] == "t1" and r[0] < late),
                            ([In(("a",), (1, 4))], lambda r: r[1] in (1, 4)), ([EqualTo(("x",), 5.0)], lambda r: True)):
        _, found = batches_read(path, back.schema, condition, monkeypatch)
        assert sorted(r["x"] for r in found) == sorted(r[3] for r in rows if keep(r))
    query = back.where((F.col("date") >= F.lit(late)) & (F.col("b") == "t2"))
    assert query.count() == sum(r[0] >= late and r[2] == "t2" for r in rows)


def test_planning_opens_no_file(tmp_path, monkeypatch):
    for i in range(300):
        (tmp_path / f"part-{i:04d}.arrow").write_bytes(b"not an arrow file")
    monkeypatch.setattr(arrow_ipc.pa.ipc, "open_file", None)
    reader = arrow_ipc.ArrowReader(str(tmp_path), arrow_ipc.from_arrow_schema(arrow_ipc.pa.schema([("a", arrow_ipc.pa.int64())])))
    assert len(reader.partitions()) == 300


def test_overwrite_drops_old_files_and_bounds(spark, tmp_path):
    path = str(tmp_path / "a")
    arrow_ipc.write(spark.range(10), path)
    arrow_ipc.write(spark.range(5), path, "overwrite")
    assert arrow_ipc.read(spark, path).where("id >= 3").count() == 2
    files = {os.path.basename(f) for f in glob.glob(f"{path}/*.arrow")}
    assert {f[1:].removesuffix(".stats") for f in os.listdir(path) if f.startswith(".") and f.endswith(".stats")} == files


# ---- buckets ----------------------------------------------------------------------------

def test_lags_over_the_stored_panel_need_no_shuffle(spark, panel, tmp_path):
    path = str(tmp_path / "bucketed")
    stored = columnar.write_bucketed(panel, "stored_panel", path, 4)
    lagged = features.lag_features(stored, "target", [1, 2])
    assert "Exchange" not in lagged._jdf.queryExecution().executedPlan().toString()
    want = features.lag_features(panel, "target", [1, 2])
    assert lagged.select(want.columns).exceptAll(want).isEmpty() and lagged.count() == want.count()
    spark.sql("DROP TABLE stored_panel")
    again = columnar.open_bucketed(spark, "opened_panel", path, panel.schema, 4)
    assert again.count() == panel.count()
    plan = features.lag_features(again, "target", [1])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("DROP TABLE opened_panel")


# ---- releases and mappings --------------------------------------------------------------

def results_of(spark, n):
    return spark.createDataFrame([("m", 0.5, i, 1, float(i)) for i in range(n)],
                                 "model_type string, quantile_level double, productID int, storeID int, mean_quantile_loss double")


def test_a_failed_release_leaves_the_former_whole(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        release.current(spark, str(tmp_path), "e")
    good = results_of(spark, 3)
    first = release.write_release(good, good, None, str(tmp_path), "e")
    broken = good.withColumn("mean_quantile_loss", F.when(F.col("productID") == 1, F.raise_error(F.lit("broken"))).otherwise(1.0).cast("double"))
    with pytest.raises(Exception, match="broken"):
        release.write_release(broken, good, None, str(tmp_path), "e")
    assert release.current(spark, str(tmp_path), "e").endswith(first.rsplit("/", 1)[1])
    assert spark.read.json(f"{release.current(spark, str(tmp_path), 'e')}/metrics").count() == 3
    second = release.write_release(results_of(spark, 5), good, None, str(tmp_path), "e")
    assert release.current(spark, str(tmp_path), "e").endswith(second.rsplit("/", 1)[1])
    assert spark.read.json(f"{first}/metrics").count() == 3 and spark.read.json(f"{second}/metrics").count() == 5


def test_nested_mapping(spark, tmp_path):
    stored = {"feature_0038": {"feature_name": "sales_0", "company_name": "c"}, "feature_0039": {"feature_name": "price", "company_name": None}}
    (tmp_path / "m.json").write_text(json.dumps(stored, indent=1))
    names = mapping.read_nested(spark, str(tmp_path / "m.json"))
    assert {tuple(r) for r in names.collect()} == {(k, v["feature_name"], v["company_name"]) for k, v in stored.items()}
    df = spark.createDataFrame([(1, 2, 3)], "feature_0038 int, other int, feature_0039 int")
    assert mapping.rename_features(df, names).columns == ["sales_0", "other", "price"]


# ---- sketches ---------------------------------------------------------------------------

@pytest.mark.parametrize("accuracy", [0.005, 0.05])
def test_sketches_merge_in_any_order_within_their_accuracy(spark, accuracy):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(3, 2, 3000), -rng.gamma(2, 5, 500), np.zeros(100), [1e-300, 1e200]])
    rows = [(int(i % 7), float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows + [(1, None)], "part int, v double").repartition(6)
    parts = sketches.build(df, ["part"], "v", accuracy)
    whole = {tuple(r) for r in sketches.build(df, [], "v", accuracy).collect()}
    assert {tuple(r) for r in sketches.merge(parts, []).collect()} == whole
    some = [sketches.merge(parts.where(F.col("part").isin(ids)), []) for ids in ([5, 0], [1, 2, 3], [6, 4])]
    for order in ((0, 1, 2), (2, 0, 1)):
        joined = some[order[0]].unionByName(some[order[1]]).unionByName(some[order[2]])
        assert {tuple(r) for r in sketches.merge(joined, []).collect()} == whole
    alphas = [0.01, 0.1, 0.5, 0.9, 0.999]
    row = sketches.quantiles(sketches.merge(parts, []), [], alphas, accuracy).first()
    exact = np.quantile(values, alphas)
    assert row["total"] == len(values)
    assert (np.abs(np.array(row["quantiles"]) - exact) <= accuracy * np.abs(exact) * 1.001 + 1e-9).all()


# ---- samples and folds ------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 7, 499, 500, 900, 5000])
def test_sample_equals_the_sorted_form(spark, monkeypatch, n):
    monkeypatch.setattr(sampling, "PICK_ROWS", 3)
    df = spark.range(900).selectExpr("id AS bdID", "id % 7 AS x", "'k' AS _other").repartition(3)
    want = df.orderBy(sampling.seeded_order(5, F.col("bdID")), "bdID").limit(n)
    got = sampling.sample_rows(df, n, 5)
    assert got.columns == df.columns and sorted(got.collect()) == sorted(want.collect())


def test_sample_with_repeated_ids(spark):
    df = spark.range(100).selectExpr("id % 4 AS bdID", "id AS x")
    assert sampling.sample_rows(df, 30, 1).count() == 30


@pytest.mark.parametrize("n,k", [(1000, 3), (17, 5), (4, 5), (0, 2)])
def test_folds_have_equal_sizes(spark, n, k):
    df = spark.range(n).selectExpr("id AS bdID", "id AS x").repartition(4)
    folds = sampling.equal_folds(df, k, 9)
    sizes = {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()}
    counts = [sizes.get(i, 0) for i in range(k)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    assert sorted(folds.collect()) == sorted(sampling.equal_folds(df.repartition(2), k, 9).collect())


# ---- observed checks --------------------------------------------------------------------

def test_split_is_checked_by_the_pass_that_writes_it(spark, tmp_path):
    day = datetime.date(2000, 1, 1)
    rows = [(day + datetime.timedelta(i), 1.0, "train" if i < 7 else "test") for i in range(10)]
    spark.createDataFrame(rows, "date date, target double, split string").write.parquet(str(tmp_path / "in"))
    df, seen = checks.watched(spark.read.parquet(str(tmp_path / "in")))
    df.write.parquet(str(tmp_path / "out"))
    assert seen.get["n_train"] == 7 and seen.get["n_rows"] == 10 and checks.split_faults(seen.get) == []
    assert df._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    mixed = spark.createDataFrame([*rows, (day + datetime.timedelta(9), None, "train"), (day, 1.0, None)], "date date, target double, split string")
    df, seen = checks.watched(mixed)
    df.count(), df.collect()
    assert checks.split_faults(seen.get) == ["1 rows on neither side", "train rows on or after the first test day"]
    df, seen = checks.watched(mixed.limit(0))
    df.collect()
    assert checks.split_faults(seen.get) == ["no train rows", "no test rows"]


# ---- ML estimators ----------------------------------------------------------------------

def test_an_ml_estimator_as_a_model_type(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 9), float(i % 5), 3.0 + 2 * (i % 9) - (i % 5)) for i in range(90)], "bdID int, a double, b double, target double")
    model = registry.from_ml(LinearRegression(solver="normal"))
    setup = Setup([], None, ["a", "b"], "target", {"regParam": 0.0, "unknown": 1})
    fitted = model.fit(df, setup)
    fitted.write().save(str(tmp_path / "m"))
    one = model.predict(df, fitted, setup).orderBy("bdID").toPandas()
    two = model.predict(df, PipelineModel.load(str(tmp_path / "m")), setup).orderBy("bdID").toPandas()
    assert np.allclose(one.prediction, two.prediction) and np.allclose(one.prediction, one.target)
    assert one.quantile_level.isna().all()
    with pytest.raises(ValueError):
        model.fit(df, Setup(["productID"], None, ["a"], "target", {}))
