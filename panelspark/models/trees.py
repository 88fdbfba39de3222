"""Boosted trees: squared loss and quantile loss.

One model for all rows adds up histograms over all tasks. One model per daily series grows
small trees inside tasks, since a series is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelspark.config import check_alphas
from panelspark.models import boosting
from panelspark.models.histograms import BINS, choose, descend, histogram, leaf_value, nodes_of as _nodes_of
from panelspark.session import spread_by_key

# The tuning space of the tree models, name, low, high, whole number.
SEARCH_SPACE = (
    ("eta", 0.01, 0.3, False),
    ("max_depth", 3, 10, True),
    ("min_child_weight", 1, 30, True),
    ("subsample", 0.6, 1.0, False),
    ("colsample_bytree", 0.6, 1.0, False),
    ("gamma", 0.0, 5.0, False),
    ("reg_alpha", 0.0, 10.0, False),
    ("reg_lambda", 0.1, 10.0, False),
    ("n_estimators", 50, 300, True),
)

# One default for each parameter, whichever tree model it goes to.
DEFAULTS = {"eta": 0.3, "max_depth": 6, "min_child_weight": 1, "gamma": 0.0, "subsample": 1.0, "colsample_bytree": 1.0,
            "reg_alpha": 0.0, "reg_lambda": 0.0}
_ALSO = {"num_boost_round", "n_estimators", "seed", "random_state", "quantile_alphas"}


def settings_of(params: dict) -> dict:
    """Parameters with defaults filled in, as numbers. Unknown names are errors: they would have no effect.

    ``gamma`` is the least gain per row of a node; ``reg_alpha`` and ``reg_lambda`` act on cuts and on the
    leaves of squared loss (pinball leaves are quantiles).
    """
    unknown = sorted(set(params) - set(DEFAULTS) - _ALSO)
    if unknown:
        raise ValueError(f"tree parameters that would have no effect: {unknown}")
    found = {name: float(params.get(name, value)) for name, value in DEFAULTS.items()}
    whole = {name: int(found[name]) for name in ("max_depth", "min_child_weight")}
    return {**found, **whole, "seed": int(params.get("seed", params.get("random_state", 42)))}


def rounds_of(params: dict) -> int:
    """Boosting rounds, which have no default."""
    for name in ("num_boost_round", "n_estimators"):
        if name in params:
            return int(params[name])
    raise ValueError("give 'n_estimators' or 'num_boost_round'")


# ---- fitted trees as rows ------------------------------------------------------------

# A row with ``value`` x is added where a tree ends there; tree 0 is one leaf, the start value. A row goes to
# ``low`` where its feature is at most ``border``, else to ``high``; without a feature always to ``low``.
NODE_FIELDS = "tree int, node int, feature int, border double, low int, high int, value double"
TABLE = f"quantile_level double, {NODE_FIELDS}"
_NODE_NAMES = [f.split()[0] for f in NODE_FIELDS.split(", ")]


def _evaluate(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sum over the trees of the leaf value of each row; ``nodes`` are rows of NODE_FIELDS."""
    out = np.zeros(len(x))
    nodes = nodes[np.lexsort((nodes[:, 1], nodes[:, 0]))]
    for tree in np.split(nodes, np.flatnonzero(np.diff(nodes[:, 0])) + 1) if len(nodes) else []:
        feature, low, high = (tree[:, i].astype(int) for i in (2, 4, 5))
        at = np.zeros(len(x), int)
        while True:
            inner = low[at] >= 0
            if not inner.any():
                break
            cut = inner & (feature[at] >= 0)
            right = cut & ~(x[np.arange(len(x)), np.maximum(feature[at], 0)] <= tree[at, 3])
            at = np.where(right, high[at], np.where(inner, low[at], at))
        out += tree[at, 6]
    return out


def predict(df: DataFrame, table: DataFrame, keys: list[str], features: list[str], target: str = "target",
            id_col: str = "bdID") -> DataFrame:
    """Predictions of saved or just fitted trees, one row per level.

    One model for all rows: its trees, bounded by rounds and depth, go to every task, and all other
    columns stay. One model per series: rows and trees of a series meet in one task; the keys,
    row id and target stay.
    """
    if keys:
        return _predict_series(df, table, keys, features, target, id_col)
    found = table.toPandas()
    levels = sorted(found["quantile_level"].drop_duplicates(), key=lambda v: (pd.isna(v), v))
    models = [found.loc[found["quantile_level"].isna() if pd.isna(a) else found["quantile_level"] == a, _NODE_NAMES].to_numpy(float)
              for a in levels]
    sent = df.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("array<double>")
    def value(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in batches:
            x = pdf.to_numpy(float)
            yield pd.Series(list(np.stack([_evaluate(m, x) for m in sent.value], axis=1)))

    scored = df.withColumn("_p", value(F.struct(*[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)])))
    pairs = F.array(*[F.struct(F.lit(None if pd.isna(a) else float(a)).cast("double").alias("quantile_level"),
                               F.col("_p")[i].alias("prediction")) for i, a in enumerate(levels)])
    return scored.select(*df.columns, F.inline(pairs))


# ---- one model for all rows ----------------------------------------------------------

def fit_levels(train: DataFrame, alphas: list, features: list[str], target: str, params: dict) -> DataFrame:
    """Boosting of the pinball loss at all levels at once, as a table of nodes; a level of None is squared loss."""
    levels = [None if a is None else check_alphas([a])[0] for a in alphas]
    rows = boosting.fit(train, levels, features, target, settings_of(params), rounds_of(params))
    return train.sparkSession.createDataFrame([tuple(None if v != v else v for v in r) for r in rows], TABLE)


def fit_regression(train: DataFrame, features: list[str], target: str, params: dict) -> DataFrame:
    """Squared-loss boosting over all rows, as a table of nodes."""
    return fit_levels(train, [None], features, target, params)


def fit_quantile(train: DataFrame, alpha: float, features: list[str], target: str, params: dict) -> DataFrame:
    """Gradient boosting of the pinball loss over all rows, as a table of nodes."""
    return fit_levels(train, [alpha], features, target, params)


# ---- one model per daily series ------------------------------------------------------

def _bins(x):
    """Each column's values as bin numbers, and the borders: quantiles of the train rows."""
    marks = np.linspace(0, 1, BINS + 1)[1:-1]
    borders = [np.unique(np.quantile(col, marks, method="lower")) for col in x.T]
    return np.column_stack([np.searchsorted(b, col) for b, col in zip(borders, x.T)]), borders


def _grow(bins, g, depth, min_rows, min_gain, l1=0.0, l2=0.0, live=None, columns=None):
    """Leaf numbers of the rows and, per level, whether, by which column and at which border each node is cut.

    All nodes of a level are cut at once, by the ``live`` rows.
    """
    cuts = []
    for level in range(depth):
        leaf = descend(bins, cuts)
        *cut, _ = choose(*histogram(bins, g, leaf if live is None else np.where(live, leaf, -1), 2 ** level), min_rows, min_gain, l1, l2, columns)
        cuts.append(tuple(cut))
    return descend(bins, cuts), cuts


def _boost_series(bins, borders, y, alpha, rounds, o, ids):
    """Nodes of the trees of one series; no level means squared loss."""
    fit = np.full(len(y), np.mean(y) if alpha is None else np.quantile(y, alpha))
    rows = [(0, 0, -1, np.nan, -1, -1, float(fit[0]))]
    for number in range(1, rounds + 1):
        g = y - fit if alpha is None else np.where(y >= fit, alpha, alpha - 1)
        live = boosting.draw(ids, o["seed"], number) < o["subsample"] if o["subsample"] < 1 else np.ones(len(y), bool)
        columns = boosting.drawn_columns(bins.shape[1], o["colsample_bytree"], o["seed"], number)
        leaf, cuts = _grow(bins, g, o["max_depth"], o["min_child_weight"], o["gamma"], o["reg_alpha"], o["reg_lambda"], live, columns)
        leaves = {}
        for one in np.unique(leaf):
            r = (y - fit)[leaf == one]
            if alpha is None:
                step = leaf_value(r[live[leaf == one]].sum(), live[leaf == one].sum(), o["reg_alpha"], o["reg_lambda"])
            else:
                step = np.quantile(r, alpha)
            leaves[int(one)] = step = float(o["eta"] * step)
            fit[leaf == one] += step
        rows += _nodes_of(number, cuts, borders, leaves)
    return rows


def _typed(df, names):
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)


def fit_series(train: DataFrame, keys: list[str], alphas, features: list[str], target: str, params: dict) -> DataFrame:
    """Boost every series on its train rows, all in one shuffle; a table of nodes per key and level.

    A task holds one daily series at a time, at most one row per day.
    """
    levels = check_alphas(alphas) if alphas else [None]
    rounds = rounds_of(params)
    options = settings_of(params)
    names = [*keys, *[f.split()[0] for f in TABLE.split(", ")]]

    def boost(key, pdf):
        bins, borders = _bins(pdf[features].to_numpy(float))
        y = pdf[target].to_numpy(float)
        # Draws go by a row's place in the order of its values, which does not depend on the shuffle.
        ids = np.lexsort((*bins.T, y)).argsort()
        rows = [(*key, a, *r) for a in levels for r in _boost_series(bins, borders, y, a, rounds, options, ids)]
        return pd.DataFrame(rows, columns=names).astype({"quantile_level": float})

    rows = spread_by_key(train.select(*keys, target, *features), keys)
    return rows.groupBy(*keys).applyInPandas(boost, f"{_typed(train, keys)}, {TABLE}")


def _predict_series(df, table, keys, features, target, id_col):
    kept = [*keys, id_col, target]
    types = f"{_typed(df, kept)}, quantile_level double, prediction double"

    def score(pdf, nodes):
        if pdf.empty or nodes.empty:
            return pd.DataFrame(columns=[*kept, "quantile_level", "prediction"])
        x = pdf[features].to_numpy(float)
        parts = [pdf[kept].assign(quantile_level=a, prediction=_evaluate(part[_NODE_NAMES].to_numpy(float), x))
                 for a, part in nodes.groupby("quantile_level", dropna=False)]
        return pd.concat(parts, ignore_index=True).astype({"quantile_level": float})

    rows = spread_by_key(df.select(*kept, *features), keys)
    return rows.groupBy(*keys).cogroup(spread_by_key(table, keys).groupBy(*keys)).applyInPandas(score, types)
