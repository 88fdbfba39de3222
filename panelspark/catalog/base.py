"""Registry, shared inputs and shared SQL of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.models import empirical
from panelspark.operators import features, filters, metrics, quantiles, splits
from panelspark.config import SKU_KEYS
from panelspark.session import materialize
from panelspark.sources import retail

ALPHAS = [0.5, 0.7, 0.9, 0.95, 0.99]
SPLIT_DATE = "2000-01-01"
LAGS = range(1, 8)
SEED = 42
TEST_FRACTION = 0.2
# Pairs typed by a user: four exist in the panel's id ranges, one product and one store repeat.
SKUS = [(1, 3), (1, 7), (12, 3), (20, 15)]

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(fn):
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, *cols: str, six=()) -> DataFrame:
    """Round computed doubles, so that the order of a sum does not show.

    Means of whole numbers get nine places, so none sits on a rounding edge; roots,
    deviations and ratios, listed in ``six``, get six.
    """
    places = {**dict.fromkeys(cols, 9), **dict.fromkeys(six, 6)}
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


# ---- shared Spark inputs -------------------------------------------------------------

def panel(spark: SparkSession, sf: str) -> DataFrame:
    return retail.demand_panel(spark, sf)


def lagged(spark: SparkSession, sf: str) -> DataFrame:
    return features.lag_features(panel(spark, sf), "target", LAGS)


def modeling(spark: SparkSession, sf: str) -> DataFrame:
    """Panel with lags, complete rows only, split at the split date."""
    return splits.by_date(filters.drop_nulls(lagged(spark, sf)), SPLIT_DATE)


def written_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel written once, for plans that read it several times: one scan of the sales."""
    return materialize(panel(spark, sf), "panel")


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    """The modeling frame written once, for plans that read it several times."""
    return materialize(modeling(spark, sf), "prepared")


def individual_rows(rows: DataFrame) -> DataFrame:
    return empirical.fit_predict_series(rows, ["skuID"], ALPHAS)


def individual_results(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """One model per SKU: a single pass over the panel."""
    rows = modeling(spark, sf) if rows is None else rows
    scored = metrics.pinball_by_level(individual_rows(rows), ["skuID", *SKU_KEYS], ALPHAS)
    return rounded(scored.drop("skuID"), "mean_quantile_loss").withColumns(
        {"hp_type": F.lit("100"), "model_type": F.lit("empirical_quantile")})


def combined_results(rows: DataFrame) -> DataFrame:
    """One model for all SKUs, scored per SKU."""
    model = empirical.fit(rows.where(F.col("split") == "train"), [], ALPHAS)
    test = empirical.predict(rows.where(F.col("split") == "test"), model, [])
    scored = metrics.pinball_by_level(test, list(SKU_KEYS), ALPHAS)
    return rounded(scored, "mean_quantile_loss").withColumns(
        {"hp_type": F.lit("0"), "model_type": F.lit("empirical_quantile")})


def challenger_and_baseline(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Per-SKU models against one model for all, from one prepared frame."""
    rows = prepared(spark, sf)
    return individual_results(spark, sf, rows), combined_results(rows)


def experiment_results(spark: SparkSession, sf: str) -> DataFrame:
    """Two experiments, hp_type 0 (all SKUs) and 100 (per SKU), written as one results table."""
    own, both = challenger_and_baseline(spark, sf)
    return materialize(both.unionByName(own), "results")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Test rows of the per-SKU models, one per level."""
    rows = individual_rows(modeling(spark, sf)).select("skuID", *SKU_KEYS, "date", "target", "quantiles")
    return quantiles.by_level(rows, ALPHAS, name="prediction")


# ---- shared SQL ----------------------------------------------------------------------

LEVELS = ", ".join(f"({a}::DOUBLE)" for a in ALPHAS)
LEVEL_LIST = "[" + ", ".join(f"{a}::DOUBLE" for a in ALPHAS) + "]"
PINBALL = "CASE WHEN {y} >= {p} THEN {a} * ({y} - {p}) ELSE ({a} - 1) * ({y} - {p}) END"


def pinball_sql(y: str, p: str, a: str, rounded: bool = True) -> str:
    p = f"round_even({p}, 0)" if rounded else f"({p})"
    return "(" + PINBALL.format(y=y, p=p, a=a) + ")"


_LAG_COLS = ", ".join(f"lag(target, {k}) OVER w AS target_lag_{k}" for k in LAGS)
_LAG_SET = " AND ".join(f"target_lag_{k} IS NOT NULL" for k in LAGS)
_RESULT_COLS = "productID, storeID, quantile_level"

_CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "panel": ("""
        SELECT productID, storeID, productID * 1000 + storeID AS skuID, 'daily' AS frequency,
               (productID::BIGINT * 100 + storeID) * 100000
                 + date_diff('day', DATE '1990-01-01', date) AS bdID,
               date, target, cents / 100.0::DOUBLE / target AS price, disc,
               CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS not_for_sale
        FROM (
          SELECT CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS productID,
                 s_nationkey AS storeID, CAST(l_shipdate AS DATE) AS date,
                 SUM(l_quantity) AS target,
                 SUM(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE AS cents,
                 MAX(l_discount) AS disc, MIN(l_returnflag) AS flag
          FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
          GROUP BY 1, 2, 3) d""", ()),
    "lagged": (f"SELECT *, {_LAG_COLS} FROM panel WINDOW w AS (PARTITION BY skuID, frequency ORDER BY date)",
               ("panel",)),
    "modeling": (f"""SELECT *, CASE WHEN date < DATE '{SPLIT_DATE}' THEN 'train' ELSE 'test' END AS split
        FROM lagged WHERE {_LAG_SET}""", ("lagged",)),
    "levels": (f"SELECT a AS quantile_level FROM (VALUES {LEVELS}) t(a)", ()),
    "model_individual": ("""
        SELECT productID, storeID, unnest(LEVEL_LIST) AS quantile_level,
               unnest(quantile_cont(target::DOUBLE, LEVEL_LIST)) AS q
        FROM modeling WHERE split = 'train' GROUP BY productID, storeID""".replace("LEVEL_LIST", LEVEL_LIST),
        ("modeling",)),
    "model_combined": ("""
        SELECT unnest(LEVEL_LIST) AS quantile_level, unnest(quantile_cont(target::DOUBLE, LEVEL_LIST)) AS q
        FROM modeling WHERE split = 'train'""".replace("LEVEL_LIST", LEVEL_LIST), ("modeling",)),
    "predictions": ("""
        SELECT m.skuID, m.productID, m.storeID, m.date, m.target, f.quantile_level, f.q AS prediction
        FROM modeling m JOIN model_individual f USING (productID, storeID)
        WHERE m.split = 'test'""", ("modeling", "model_individual")),
    "individual_results": (f"""
        SELECT {_RESULT_COLS}, round(avg({pinball_sql('target', 'prediction', 'quantile_level')}), 9) AS mean_quantile_loss,
               '100' AS hp_type, 'empirical_quantile' AS model_type
        FROM predictions GROUP BY {_RESULT_COLS}""", ("predictions",)),
    "combined_results": (f"""
        SELECT {_RESULT_COLS}, round(avg({pinball_sql('m.target', 'f.q', 'quantile_level')}), 9) AS mean_quantile_loss,
               '0' AS hp_type, 'empirical_quantile' AS model_type
        FROM modeling m, model_combined f WHERE m.split = 'test'
        GROUP BY {_RESULT_COLS}""", ("modeling", "model_combined")),
    "results": ("SELECT * FROM combined_results UNION ALL SELECT * FROM individual_results",
                ("combined_results", "individual_results")),
    "whitelist": ("""
        SELECT DISTINCT p.productID, p.storeID, n_name AS name
        FROM panel p JOIN nation ON n_nationkey = p.storeID WHERE n_regionkey IN (0, 1)""", ("panel",)),
}


def with_ctes(body: str, *names: str, **extra: str) -> str:
    """``body`` preceded by the named shared CTEs and what they need, in order."""
    order: list[str] = []

    def visit(name):
        for need in _CTES[name][1]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({_CTES[n][0]})" for n in order] + [f"{n} AS ({s})" for n, s in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
