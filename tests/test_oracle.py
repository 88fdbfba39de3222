"""Every registered query beside its SQL on the small tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(table):
    df = table.to_pandas()
    df = df[sorted(df.columns)]
    out = [tuple(None if v is None or v is pd.NaT or v != v else v for v in r)
           for r in df.itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple(str(v) for v in r))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf).toArrow()
    want = duck.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert {f.name: str(f.type) for f in got.schema} == {f.name: str(f.type) for f in want.schema}
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == entry.entry(spark).columns
    assert df.count() > 0


LOSS_TABLES = {"linear_quantile_losses": 1.0, "linear_quantile_fit_individual": 1.0, "gbt_quantile_losses": 1.0}


@pytest.mark.parametrize("name", LOSS_TABLES)
def test_fit_tables_show_lower_losses_than_the_constant(spark, sf, name):
    """On the rows a fit saw, every level loses no more than the constant quantile, and covers its share."""
    found = entry.queries()[name](spark, sf).collect()
    assert len(found) == 5
    for r in found:
        assert r["n_model"] == r["n_constant"] > 0
        assert r["loss_model"] <= r["loss_constant"] * 1.0005
        # A short series lies on its own line in part, so only one model for all has exact shares.
        assert name.endswith("individual") or abs(r["coverage_model"] - r["quantile_level"]) < 0.05


@pytest.mark.parametrize("name", ["gbt_regress_losses", "gbt_regress_individual"])
def test_regression_tables_are_whole(spark, sf, name):
    row = entry.queries()[name](spark, sf).first()
    assert row["n_rows"] > 0 and 0 < row["rmse_model"] < 1.5 * row["rmse_mean"]


def test_boosted_series_are_scored_at_every_level(spark, sf):
    found = entry.queries()["gbt_quantile_individual"](spark, sf).toPandas()
    per_level = found.groupby("quantile_level").size()
    assert len(per_level) == 5 and per_level.nunique() == 1 and (found["mean_quantile_loss"] >= 0).all()


def test_the_best_trial_is_the_lowest(spark, sf):
    found = entry.queries()["tune_random_search_trials"](spark, sf).toPandas()
    assert len(found) == 2 and (found.loss[found.is_best] == found.loss.min()).all()
