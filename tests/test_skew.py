"""One SKU holds a third of all sales lines; results stay whole and no series outgrows the calendar."""

import numpy as np
import pandas as pd
import pytest

from panelspark.models import empirical
from panelspark.operators import metrics, splits
from panelspark.sources import retail

N = 30_000


@pytest.fixture(scope="module")
def sales(tmp_path_factory):
    rng = np.random.default_rng(11)
    hot = rng.random(N) < 1 / 3
    lines = pd.DataFrame({
        "l_partkey": np.where(hot, 0, rng.integers(0, 40, N)),
        "l_suppkey": np.where(hot, 0, rng.integers(0, 12, N)),
        "l_quantity": rng.integers(1, 51, N).astype(float),
        "l_extendedprice": np.round(rng.random(N) * 1e4, 2),
        "l_discount": rng.integers(0, 11, N) / 100,
        "l_returnflag": rng.choice(list("ANR"), N),
        "l_shipdate": pd.Timestamp("1999-06-01") + pd.to_timedelta(rng.integers(0, 400, N), unit="D"),
    }).astype({"l_shipdate": "datetime64[us]"})
    part = pd.DataFrame({"p_partkey": range(40), "p_brand": [f"Brand#{k % 7 + 1}" for k in range(40)]})
    supplier = pd.DataFrame({"s_suppkey": range(12), "s_nationkey": np.arange(12, dtype="int32") % 5})
    root = tmp_path_factory.mktemp("sales")
    for name, pdf in (("lineitem", lines), ("part", part), ("supplier", supplier)):
        pdf.to_parquet(f"{root}/{name}.parquet", index=False)
    joined = lines.merge(part, left_on="l_partkey", right_on="p_partkey").merge(
        supplier, left_on="l_suppkey", right_on="s_suppkey")
    joined["productID"] = joined.p_brand.str.replace("Brand#", "").astype(int)
    joined["date"] = joined.l_shipdate.dt.date
    daily = joined.groupby(["productID", "s_nationkey", "date"]).l_quantity.sum().reset_index()
    return str(root), daily


def test_panel_is_whole_and_bounded_by_the_calendar(spark, sales):
    root, daily = sales
    got = retail.demand_panel(spark, root).toPandas()
    assert len(got) == len(daily) and got.target.sum() == daily.l_quantity.sum()
    assert got.groupby(["productID", "storeID"]).size().max() <= 400


@pytest.mark.parametrize("keys", [[], ["productID", "storeID"]])
def test_scores_by_brute_force(spark, sales, keys):
    root, daily = sales
    rows = splits.by_date(retail.demand_panel(spark, root), "2000-01-01")
    model = empirical.fit(rows.where("split = 'train'"), keys, [0.5, 0.9])
    test = empirical.predict(rows.where("split = 'test'"), model, keys)
    got = metrics.pinball_by_level(test, ["productID", "storeID"], [0.5, 0.9]).toPandas()
    train = daily[daily.date < pd.Timestamp("2000-01-01").date()]
    held = daily[daily.date >= pd.Timestamp("2000-01-01").date()]
    for _, row in got.iterrows():
        own = train
        if keys:
            own = train[(train.productID == row.productID) & (train.s_nationkey == row.storeID)]
        y = held[(held.productID == row.productID) & (held.s_nationkey == row.storeID)].l_quantity
        r = y - np.round(np.quantile(own.l_quantity, row.quantile_level))
        want = np.where(r >= 0, row.quantile_level * r, (row.quantile_level - 1) * r).mean()
        assert row.mean_quantile_loss == pytest.approx(want)
    assert len(got) == 2 * held.groupby(["productID", "s_nationkey"]).ngroups
