import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.models import boosting, empirical, linear, trees
from panelspark.operators import sampling, scaling
from panelspark.plans import tuning

N_SKUS, N_DAYS = 6, 80


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(42)
    n = N_SKUS * N_DAYS
    pdf = pd.DataFrame({
        "productID": np.repeat(np.arange(1, N_SKUS + 1), N_DAYS).astype("int32"),
        "storeID": np.int32(1), "bdID": np.arange(n),
        "a": rng.normal(size=n), "b": 100 + 20 * rng.normal(size=n), "flat": 3.0,
        "split": np.where(np.arange(n) % N_DAYS < 60, "train", "test"),
    })
    pdf["target"] = np.round(20 + 4 * pdf.a + 0.2 * pdf.b + rng.gamma(2, 2, n))
    return pdf


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data).repartition(5).cache()


def loss(y, p, alpha):
    r = np.asarray(y) - p
    return np.where(r >= 0, alpha * r, (alpha - 1) * r).mean()


def best_linear_loss(x, y, alpha):
    """Subgradient-free check: long smoothed descent to the minimum."""
    x = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))])
    beta, floor, best = np.linalg.lstsq(x, y, rcond=None)[0], y.std(), np.inf
    for _ in range(600):
        r = y - x @ beta
        best = min(best, loss(y, x @ beta, alpha))
        w = np.where(r >= 0, alpha, 1 - alpha) / np.maximum(abs(r), floor)
        beta = np.linalg.solve(x.T @ (x * w[:, None]) + 1e-9 * np.eye(x.shape[1]), x.T @ (w * y))
        floor = max(floor * 0.95, 1e-8)
    return best


FEATURES = ["a", "b", "flat"]


def test_linear_for_all_rows_is_near_the_minimum(data, frame):
    train = frame.where("split = 'train'")
    own = data[data.split == "train"]
    model = linear.fit(train, [], [0.5, 0.9], FEATURES)
    scored = linear.predict(train, model, [], FEATURES).toPandas()
    for alpha, part in scored.groupby("quantile_level"):
        low = best_linear_loss(own[FEATURES].to_numpy(), own.target.to_numpy(), alpha)
        assert loss(part.target, part.prediction, alpha) <= low * 1.001
        assert abs((part.target <= part.prediction).mean() - alpha) < 0.05


def test_linear_per_sku_is_near_the_minimum(data, frame):
    train = frame.where("split = 'train'")
    model = linear.fit(train, ["productID", "storeID"], [0.7], FEATURES)
    scored = linear.predict(train, model, ["productID", "storeID"], FEATURES).toPandas()
    for product, part in scored.groupby("productID"):
        own = data[(data.split == "train") & (data.productID == product)]
        low = best_linear_loss(own[FEATURES].to_numpy(), own.target.to_numpy(), 0.7)
        assert loss(part.target, part.prediction, 0.7) <= low * 1.001


def test_linear_for_all_rows_never_collects_rows_and_repeats(frame, monkeypatch):
    train = frame.where("split = 'train'")
    seen = []
    plain = type(frame).toPandas
    monkeypatch.setattr(type(frame), "toPandas", lambda df: seen.append(len(out := plain(df))) or out)
    one = linear.fit(train, [], [0.7], FEATURES).first()
    assert max(seen) <= (len(FEATURES) + 1) * (len(FEATURES) + 2) + 1
    two = linear.fit(train.repartition(5), [], [0.7], FEATURES).first()
    assert np.allclose(one["coefficients"], two["coefficients"], atol=1e-6) and one["n_iter"] == two["n_iter"]


def test_interior_point_proves_its_loss():
    rng = np.random.default_rng(1)
    for n, p, alpha in ((400, 4, 0.5), (60, 8, 0.95), (3000, 3, 0.99)):
        x = np.column_stack([np.ones(n), rng.normal(size=(n, p - 1)), np.ones(n)])  # one column twice
        y = np.round(x[:, 1:p] @ rng.normal(size=p - 1) + rng.gamma(2, 2, n))
        unit = np.ones(n)
        beta, d = linear.interior_point(x, y, (alpha - 1) * unit, alpha * unit, np.zeros(p + 1), np.zeros(p + 1))
        assert (d >= alpha - 1).all() and (d <= alpha).all() and abs(x.T @ d).max() < 1e-6 * n
        assert abs(loss(y, x @ beta, alpha) * n - d @ y) <= 1e-7 * n


@pytest.mark.parametrize("band", [100, 20_000])
def test_linear_gap_closes_for_any_band(frame, data, monkeypatch, band):
    """Bands that hold only some of the rows are sampled, narrowed and widened again; the bound is that of all rows."""
    monkeypatch.setattr(linear, "BAND_ROWS", band)
    passes = []
    plain = linear._pass
    monkeypatch.setattr(linear, "_pass", lambda *a: passes.append(1) or plain(*a))
    train, own = frame.where("split = 'train'"), data[data.split == "train"]
    model = linear.fit(train, [], [0.5, 0.9], FEATURES).collect()
    assert len(passes) < 20
    for r in model:
        p = r["intercept"] + own[FEATURES].to_numpy() @ np.array(r["coefficients"])
        low = best_linear_loss(own[FEATURES].to_numpy(), own.target.to_numpy(), r["quantile_level"])
        assert loss(own.target, p, r["quantile_level"]) <= low * (1 + 1e-6)
        assert r["gap"] is not None and r["gap"] <= 1e-6


def test_linear_options(frame):
    train = frame.where("split = 'train'")
    with pytest.raises(ValueError, match="method"):
        linear.fit(train, [], [0.5], FEATURES, method="bfgs")
    assert linear.fit(train, [], [0.5], FEATURES, max_iter=1).first()["n_iter"] == 1
    per_sku = linear.fit(train, ["productID", "storeID"], [0.5, 0.9], FEATURES)
    assert per_sku.where("gap IS NULL OR gap > 1e-6").count() == 0


def test_linear_with_many_rows_on_the_plane(spark):
    """More rows than a band holds lie exactly on the best plane: it is found, its gap is unknown or small."""
    rows = [(float(i % 7), 0.0 if i % 10 else float(i % 13)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, target double")
    row = linear.fit(df, [], [0.5], ["a"]).first()
    assert abs(row["intercept"]) < 1e-4 and abs(row["coefficients"][0]) < 1e-4


def test_linear_with_few_rows_falls_back_to_the_quantile(spark):
    df = spark.createDataFrame([(1, 1, 0.1, 5.0), (1, 1, 0.2, 9.0)], "productID int, storeID int, a double, target double")
    row = linear.fit(df, ["productID", "storeID"], [0.5], ["a"]).first()
    assert row["fallback"] and row["intercept"] == 7.0 and row["coefficients"] == [0.0]


def test_linear_refuses_coarse_keys(frame):
    with pytest.raises(ValueError):
        linear.fit(frame, ["storeID"], [0.5], FEATURES)


def test_empirical_window_form_equals_fit_and_join(frame):
    keys = ["productID", "storeID"]
    one = empirical.fit_predict_series(frame, keys, [0.5, 0.9]).select("bdID", "quantiles")
    model = empirical.fit(frame.where("split = 'train'"), keys, [0.5, 0.9])
    two = empirical.predict(frame.where("split = 'test'"), model, keys).select("bdID", "quantiles")
    assert sorted(one.collect()) == sorted(two.collect())


def test_scaler_uses_population_deviation_and_keeps_flat_columns(data, frame):
    stats = scaling.fit(frame, FEATURES, [])
    got = scaling.apply(frame, stats, FEATURES, []).orderBy("bdID").toPandas()
    train = data[data.split == "train"]
    for c in ("a", "b"):
        assert np.allclose(got[c], (data[c] - train[c].mean()) / train[c].std(ddof=0))
    assert (got["flat"] == 0).all()


TREES = {"n_estimators": 8, "max_depth": 3, "eta": 0.3}


def test_trees_need_rounds():
    with pytest.raises(ValueError):
        trees.rounds_of({})


def test_squared_trees_beat_the_mean_and_repeat(data, frame):
    train, test = frame.where("split = 'train'"), frame.where("split = 'test'")
    runs = []
    for _ in range(2):
        model = trees.fit_regression(train, ["a", "b"], "target", {**TREES, "seed": 1})
        runs.append(trees.predict(test, model, [], ["a", "b"]).orderBy("bdID").toPandas())
    assert np.allclose(runs[0].prediction, runs[1].prediction)
    own = data[data.split == "train"].target
    assert ((runs[0].target - runs[0].prediction) ** 2).mean() < ((runs[0].target - own.mean()) ** 2).mean()


def test_quantile_trees_lower_the_loss(frame):
    train = frame.where("split = 'train'")
    model = trees.fit_quantile(train, 0.7, ["a", "b"], "target", TREES)
    scored = trees.predict(train, model, [], ["a", "b"]).toPandas()
    start = model.where("tree = 0").first()["value"]
    assert loss(scored.target, scored.prediction, 0.7) < 0.7 * loss(scored.target, start, 0.7)
    assert 0.6 < (scored.target <= scored.prediction).mean() < 0.85


@pytest.mark.parametrize("alphas", [None, [0.5, 0.9]])
def test_trees_per_sku_beat_a_constant(data, frame, alphas):
    keys = ["productID", "storeID"]
    table = trees.fit_series(frame.where("split = 'train'"), keys, alphas, ["a", "b"], "target", {**TREES, "min_child_weight": 5})
    got = trees.predict(frame.where("split = 'test'"), table, keys, ["a", "b"]).toPandas()
    assert len(got) == (len(alphas) if alphas else 1) * (data.split == "test").sum()
    train = data[data.split == "train"]
    for alpha in alphas or [None]:
        part = got if alpha is None else got[got.quantile_level == alpha]
        if alpha is None:
            base = part.productID.map(train.groupby("productID").target.mean())
            assert ((part.target - part.prediction) ** 2).mean() < ((part.target - base) ** 2).mean()
        else:
            base = part.productID.map(train.groupby("productID").target.quantile(alpha))
            assert loss(part.target, part.prediction, alpha) < loss(part.target, base, alpha)


def test_first_cut_of_a_series_tree_by_brute_force():
    rng = np.random.default_rng(3)
    x, g = rng.integers(0, 20, (60, 3)).astype(float), rng.normal(size=60)
    g[x[:, 1] > 11] += 3
    bins, borders = trees._bins(x)
    leaf, cuts = trees._grow(bins, g, 1, 4, 0.0)
    nodes = np.array(trees._nodes_of(0, cuts, borders, {0: 1.0, 1: 2.0}))
    assert (trees._evaluate(nodes, x) == leaf + 1.0).all()

    def gain(mask):
        return g[mask].sum() ** 2 / mask.sum() + g[~mask].sum() ** 2 / (~mask).sum()

    masks = [x[:, j] <= v for j in range(3) for v in np.unique(x[:, j])]
    best = max(gain(m) for m in masks if 4 <= m.sum() <= 56)
    assert gain(leaf == 0) == pytest.approx(best)


def options(**more):
    return trees.settings_of({"eta": 1.0, "max_depth": 2, **more})


@pytest.mark.parametrize("levels,at_once,here", [([None, 0.5, 0.9], 10**6, 1 << 24), ([None, 0.25], 3, 0)])
def test_boosting_over_tasks_equals_one_series_in_a_task(data, frame, monkeypatch, levels, at_once, here):
    """The same trees from histograms of many tasks, half of them by subtraction, and from all rows in one place; exact leaf
    quantiles also where prefixes must be narrowed again."""
    monkeypatch.setattr(boosting, "VALUES_AT_ONCE", at_once)
    monkeypatch.setattr(boosting, "SUMMED_HERE", here)
    own = data.assign(a=data.a.round(1), b=(data.b / 4).round())
    o = options(max_depth=3, eta=0.5, min_child_weight=4, reg_lambda=2.0, reg_alpha=1.5)
    spark = frame.sparkSession
    seen = []
    plain = boosting.Booster._borders
    monkeypatch.setattr(boosting.Booster, "_borders", lambda *a: seen.append(plain(*a)) or seen[-1])
    got = boosting.fit(spark.createDataFrame(own).repartition(4), levels, ["a", "b"], "target", o, 3)
    x, y = own[["a", "b"]].to_numpy(float), own.target.to_numpy(float)
    borders = seen[0]
    bins = np.column_stack([np.searchsorted(b, c) for b, c in zip(borders, x.T)])
    for level in levels:
        rows = trees._boost_series(bins, borders, y, level, 3, o, np.arange(len(y)))
        want = trees._evaluate(np.array(rows, float), x)
        mine = trees._evaluate(np.array([r[1:] for r in got if r[0] == level], float), x)
        assert np.allclose(mine, want, atol=1e-9)


def test_counts_of_prefixes_move_once(frame):
    sc = frame.sparkSession.sparkContext
    booster = boosting.Booster(frame.where("split = 'train'"), [0.3, 0.7], ["a", "b"], "target", trees.settings_of({}))
    sc.setJobGroup("ranks", "")
    found = booster.leaf_quantiles([[], []])
    jobs = sc.statusTracker().getJobIdsForGroup("ranks")
    sc.setLocalProperty("spark.jobGroup.id", None)
    y = np.array([r[0] for r in frame.where("split = 'train'").select("target").collect()], float)
    assert [f[0] for f in found] == pytest.approx(np.quantile(y, [0.3, 0.7]).tolist())
    assert len(jobs) <= 5  # filling the cache, then two narrowings, each of one shuffle and its reading
    booster.close()


@pytest.mark.parametrize("shift", [0, 24, 44])
def test_pairs_and_packed_rows_beside_numpy(shift):
    rng = np.random.default_rng(shift)
    leaf, prefix = rng.integers(0, 8, 3000), boosting.ordered(rng.integers(-40, 40, 3000) * 1.7e9) >> shift
    want, n = np.unique(np.stack([leaf, prefix]), axis=1, return_counts=True)
    got = boosting.count_pairs(leaf, prefix)
    assert (np.stack(got[:2]) == want).all() and (got[2] == n).all()
    twice = boosting.count_pairs(*(np.concatenate([v, v]) for v in got))
    assert (np.stack(twice[:2]) == want).all() and (twice[2] == 2 * n).all()
    x = rng.random((7, 3))
    assert (boosting.unpack(boosting.pack(x).slice(2, 4), float, 3) == x[2:6]).all()
    assert boosting.unpack(boosting.pack(x[:0]), float, 3).shape == (0, 3)


def test_draws_of_rows_and_columns_change_trees_but_repeat(frame):
    train = frame.where("split = 'train'")
    fitted = {}
    for name, params in {"all": {}, "rows": {"subsample": 0.6}, "columns": {"colsample_bytree": 0.5}}.items():
        for keys in ([], ["productID", "storeID"]):
            def run():
                if keys:
                    table = trees.fit_series(train, keys, None, ["a", "b"], "target", {**TREES, **params})
                else:
                    table = trees.fit_regression(train, ["a", "b"], "target", {**TREES, **params})
                return trees.predict(train, table, keys, ["a", "b"]).orderBy("bdID").toPandas().prediction
            fitted[name, bool(keys)] = run()
            if keys or name == "columns":
                assert np.allclose(fitted[name, bool(keys)], run())
    for keys in (False, True):
        assert not np.allclose(fitted["all", keys], fitted["rows", keys])
        assert not np.allclose(fitted["all", keys], fitted["columns", keys])


def test_unknown_tree_parameters_are_errors():
    with pytest.raises(ValueError, match="tree_method"):
        trees.settings_of({"tree_method": "hist"})


def test_keys_sort_like_the_numbers():
    v = np.array([-1e300, -2.5, -1e-300, -0.0, 0.0, 3e-310, 1.0, 2.5, 1e300, np.inf])
    k = boosting.ordered(v)
    assert (np.diff(k) >= 0).all() and (boosting.unordered(k) == v).all()


def test_folds_cover_all_rows_and_repeat(frame):
    folds = sampling.kfold(frame, 3, 42).select("bdID", "fold").toPandas()
    assert set(folds.fold) == {0, 1, 2} and len(folds) == N_SKUS * N_DAYS
    again = sampling.kfold(frame.repartition(2), 3, 42).select("bdID", "fold").toPandas()
    assert folds.sort_values("bdID").fold.tolist() == again.sort_values("bdID").fold.tolist()
    with pytest.raises(ValueError):
        sampling.kfold(frame, 1, 42)


def test_cross_validated_quantile_by_brute_force(frame):
    got = tuning.cv_empirical(frame, 3, 42, [0.5, 0.9]).toPandas()
    pdf = sampling.kfold(frame, 3, 42).toPandas()
    for _, row in got.iterrows():
        fit, held = pdf[pdf.fold != row.fold].target, pdf[pdf.fold == row.fold].target
        assert row.loss == pytest.approx(loss(held, np.quantile(fit, row.quantile_level), row.quantile_level))
        assert row.n_rows == len(held)


def test_random_search_picks_the_lowest_trial(frame):
    found = tuning.random_search(
        frame.where("split = 'train'"), "gbt_regress", ["a", "b"], n_trials=2, n_folds=2, seed=7,
        parallelism=2, fixed={"n_estimators": 2, "max_depth": 2})
    table = found.trials.toPandas()
    assert len(table) == 2 and found.best_score == table.loss.min()
    assert 0.01 <= found.best_params["eta"] <= 0.3


def test_random_search_repeats_and_needs_a_space():
    assert tuning.draw_trials(trees.SEARCH_SPACE, 3, 5) == tuning.draw_trials(trees.SEARCH_SPACE, 3, 5)
    with pytest.raises(NotImplementedError):
        tuning.draw_trials((), 3, 5)


def test_sample_skus_is_capped_and_seeded(frame):
    few = {tuple(r) for r in sampling.sample_skus(frame, 3, 1).collect()}
    assert few == {tuple(r) for r in sampling.sample_skus(frame, 3, 1).collect()} and len(few) == 3
    assert sampling.sample_skus(frame, 100, 1).count() == N_SKUS
    assert frame.agg(F.count("*")).first()[0] == N_SKUS * N_DAYS
