"""Linear quantile regression: the least pinball loss, with a duality gap that proves it.

The loss is a linear program. Its dual gives each row a number d in [alpha - 1, alpha] with sum(d * x) = 0; sum(d * y) is
then a lower bound of the loss, whatever the coefficients. Rows far from the current plane have d at one end, so they count
as two sums; the rows in a band around the plane are the program that is left, solved by primal-dual interior-point steps.

One model for all rows: each round is one pass that sums the far rows and hands the band, a bounded number of rows per
level, to one task per level. A band with more rows is sampled and narrows until it fits; then the bound is exact. One
model per daily series: a series is bounded by the calendar, so each is solved whole inside a task, all in one shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelspark.config import SKU_KEYS, check_alphas
from panelspark.operators import scaling
from panelspark.operators.quantiles import spread_quantiles
from panelspark.session import materialize, spread_by_key

# The most rounds, and the gap, as a share of the loss, at which they stop.
MAX_ITER, P_TOL = 5_000, 1e-6
METHODS = ("interior_point",)
# Rows of a band that one task solves, and what a sampled band narrows by: some multiple of the sampling error.
BAND_ROWS = 20_000
NARROW = 4.0
# Rounds also stop after so many that do not lower the loss.
PATIENCE = 8
# Sizes of residuals are counted in steps of a quarter octave around the target's deviation.
_BINS, _PER_OCTAVE, _ZERO_BIN = 256, 4, 200
# Coefficients may move so many half-widths of the band; a bound beyond that is no bound.
_REACH = 4.0
_RIDGE = 1e-12
_STEPS, _PRECISION, _BACK = 80, 1e-10, 0.9995
MODEL_COLUMNS = "quantile_level double, intercept double, coefficients array<double>, n_rows bigint, n_iter int, fallback boolean, gap double"


# ---- the program in one place -----------------------------------------------------------

def _pinball(r, alpha):
    return float(np.where(r >= 0, alpha * r, (alpha - 1) * r).sum())


def interior_point(x, y, low, high, pull, beta):
    """Coefficients that minimise sum(high * max(r, 0) - low * min(r, 0)) - pull @ beta with r = y - x @ beta, and the rows' duals.

    Mehrotra's predictor-corrector steps: the duals are ``low`` + a with 0 <= a <= ``high`` - ``low`` and x.T @ duals = -pull.
    """
    room = high - low
    need = -pull - x.T @ low
    r = y - x @ beta
    spread = np.abs(r).mean() + 1e-12
    a = room * np.clip(0.5 + 0.45 * r / (np.abs(r) + spread), 0.05, 0.95)
    s = room - a
    w, z = np.maximum(r, 0) + spread, np.maximum(-r, 0) + spread
    size = max(float(np.abs(y) @ np.maximum(np.abs(low), np.abs(high))), 1e-300)

    def longest(v, dv):
        falling = dv < 0
        return min(1.0, _BACK * float(np.min(v[falling] / -dv[falling]))) if falling.any() else 1.0

    for _ in range(_STEPS):
        missing = need - x.T @ a
        off = y - x @ beta - w + z
        gap = float(a @ z + s @ w)
        if gap <= _PRECISION * size and np.abs(missing).max() <= 1e-9 * max(np.abs(need).max(), room.sum()):
            break
        q = 1 / (z / a + w / s)
        gram = x.T @ (x * q[:, None])
        gram += _RIDGE * np.trace(gram) / len(gram) * np.eye(len(gram))

        def direction(az, sw):
            # With da = q (off + az / a - sw / s - x dbeta): what the rows' equations leave for the coefficients.
            known = off + az / a - sw / s
            db = np.linalg.solve(gram, x.T @ (q * known) - missing)
            da = q * (known - x @ db)
            return db, da, (az - z * da) / a, (sw + w * da) / s

        db, da, dz, dw = direction(-a * z, -s * w)
        primal, dual = min(longest(a, da), longest(s, -da)), min(longest(z, dz), longest(w, dw))
        ahead = float((a + primal * da) @ (z + dual * dz) + (s - primal * da) @ (w + dual * dw))
        mean = gap / (2 * len(y)) * (ahead / gap) ** 3
        db, da, dz, dw = direction(mean - a * z - da * dz, mean - s * w + da * dw)
        primal, dual = min(longest(a, da), longest(s, -da)), min(longest(z, dz), longest(w, dw))
        a, s = a + primal * da, s - primal * da
        beta, z, w = beta + dual * db, z + dual * dz, w + dual * dw
    return beta, low + a


def _design(pdf: pd.DataFrame, features):
    return np.column_stack([np.ones(len(pdf)), pdf[features].to_numpy(float)])


def _standardise(x):
    """Columns with mean 0 and deviation 1, and how to take coefficients back."""
    mean, spread = x[:, 1:].mean(0), x[:, 1:].std(0)
    spread = np.where(spread == 0, 1.0, spread)
    return np.column_stack([x[:, :1], (x[:, 1:] - mean) / spread]), mean, spread


def _unscale(beta, mean, spread):
    """Coefficients for the features as they are."""
    slopes = beta[1:] / spread
    return float(beta[0] - slopes @ mean), slopes.tolist()


def _share(loss, bound):
    """The gap as a share of the loss; rounding may put the bound a little above."""
    return max(0.0, (loss - bound) / loss) if loss > 0 else 0.0


def _fit_series(x, y, alpha):
    """Coefficients of rows in one place, the gap, and whether few rows fell back to the quantile."""
    beta = np.zeros(x.shape[1])
    beta[0] = np.quantile(y, alpha)
    if len(y) <= x.shape[1] or y.std() == 0:
        return beta, None, True
    unit = np.ones(len(y))
    beta, d = interior_point(x, y / y.std(), (alpha - 1) * unit, alpha * unit, np.zeros(x.shape[1]), beta / y.std())
    beta = beta * y.std()
    return beta, _share(_pinball(y - x @ beta, alpha), float(d @ y)), False


def fit(train: DataFrame, keys: list[str], alphas, features: list[str], target: str = "target",
        max_iter: int = MAX_ITER, p_tol: float = P_TOL, method: str = METHODS[0]) -> DataFrame:
    """One row per model key and level: intercept, coefficients and how the fit went.

    ``gap`` is the share of the loss by which it may be above the least one, at most ``p_tol`` unless ``max_iter`` rounds
    ended first. It is null for fallbacks, and where more than BAND_ROWS rows lie on the plane itself. Features are
    standardised on the train rows for the fit; the coefficients are given for the features as they are, so predicting needs
    no scaler.
    """
    alphas = check_alphas(alphas)
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    if not keys:
        return _fit_all(train, alphas, features, target, max_iter, p_tol)
    if not (set(SKU_KEYS) <= set(keys) or "skuID" in keys):
        raise ValueError("linear models are fitted for all rows or per SKU")

    def solve(key, pdf):
        x, mean, spread = _standardise(_design(pdf, features))
        y = pdf[target].to_numpy(float)
        rows = []
        for a in alphas:
            beta, gap, fallback = _fit_series(x, y, a)
            rows.append((*key, a, *_unscale(beta, mean, spread), len(y), 1, fallback, gap))
        return pd.DataFrame(rows, columns=out_names).astype({"gap": float})

    key_types = [f"{k} {train.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*key_types, MODEL_COLUMNS])
    out_names = [*keys, *[c.split()[0] for c in MODEL_COLUMNS.split(", ")]]
    rows = spread_by_key(train.select(*keys, *features, target), keys)
    return rows.groupBy(*keys).applyInPandas(solve, schema)


# ---- rounds over all rows ---------------------------------------------------------------

@dataclass
class _Round:
    """What a level's next pass does, and the best it has shown so far."""

    alpha: float
    beta: np.ndarray
    width: float = np.inf   # half-width of the band
    keep: float = 1.0       # share of the band that is taken
    share: float = 1.0      # of all rows that the band is to hold
    bound: float = -np.inf  # of the loss, proven by the solution before
    best: np.ndarray | None = None
    best_loss: float = np.inf
    slower: float = 0.0     # bands narrow to no less than this share of the one before
    rounds: int = 0
    idle: int = 0
    open: bool = True

    def gap(self):
        return _share(self.best_loss, self.bound) if np.isfinite(self.bound) else None

    def take(self, found, n, p, max_iter, p_tol):
        """Learn from a pass; decide on the next band. After a worse plane the best one is taken up again, with a wider band
        of other rows."""
        before = self.gap()
        worse = found["loss"] > self.best_loss
        self.idle = 0 if self.best_loss - found["loss"] > 0.01 * p_tol * found["loss"] else self.idle + 1
        if not worse:
            self.best, self.best_loss = self.beta, found["loss"]
        if np.isfinite(found["bound"]):
            self.bound = max(self.bound, found["bound"])
        self.rounds += 1
        now = self.gap()
        self.open = not (now is not None and now <= p_tol or self.rounds >= max_iter or self.idle >= PATIENCE)
        if not self.open:
            return
        fits = 0.8 * BAND_ROWS / n
        if worse:
            self.beta, self.share, self.slower = self.best, min(1.0, 4 * self.share), 0.5
        elif found["beta"] is not None:
            exact = self.keep == 1.0
            self.beta = np.array(found["beta"])
            stuck = exact and before is not None and now is not None and now > before / 2
            narrower = self.share * max(self.slower, min(0.5, NARROW * np.sqrt(p / BAND_ROWS)))
            self.share = min(1.0, 4 * self.share) if stuck else min(1.0, max(narrower, fits))
        # Residuals near the next plane are spread about as near this one; a band that turns out too full is not solved.
        within = np.cumsum(found["sizes"])
        bin_ = int(np.searchsorted(within, self.share * n))
        self.width = np.inf if self.share >= 1 or bin_ >= _BINS - 1 else found["scale"] * 2.0 ** ((bin_ + 1 - _ZERO_BIN) / _PER_OCTAVE)
        expected = within[min(bin_, _BINS - 1)]
        self.keep = 1.0 if expected <= 1.5 * BAND_ROWS else BAND_ROWS / expected


def _partial(x, y, u, states, scale):
    """Per level: loss, sizes of residuals, sums of the rows above and below the band, and the band's rows."""
    for s in states:
        r = y - x @ s.beta
        with np.errstate(divide="ignore"):
            size = np.floor(np.log2(np.abs(r) / scale) * _PER_OCTAVE) + _ZERO_BIN
        sizes = np.bincount(np.clip(np.nan_to_num(size, neginf=0), 0, _BINS - 1).astype(int), minlength=_BINS)
        above, below = r > s.width, r < -s.width
        sums = np.concatenate([[_pinball(r, s.alpha)], sizes, x[above].sum(0), [y[above].sum()], x[below].sum(0), [y[below].sum()]])
        # Another part of a sampled band in each round.
        taken = ~above & ~below & ((u + 0.618034 * s.rounds) % 1 <= s.keep)
        yield s.alpha, sums, np.column_stack([x[taken], y[taken]])


def _solve_band(sums, band, state, scale, p):
    """The next coefficients, and the bound that the duals of the far rows and the band prove together."""
    at = 1 + _BINS
    x_above, y_above = sums[at:at + p], sums[at + p]
    x_below, y_below = sums[at + p + 1:at + 2 * p + 1], sums[at + 2 * p + 1]
    alpha = state.alpha
    x, y = band[:, :p], band[:, p] / scale
    heft = np.full(len(y), 1 / state.keep)
    low, high = (alpha - 1) * heft, alpha * heft
    pull = alpha * x_above + (alpha - 1) * x_below
    start = state.beta / scale
    walls = 0
    if np.isfinite(state.width):
        # Walls around the coefficients: rows that cost nothing within reach and more than all others beyond.
        reach, weight = _REACH * state.width / scale, np.abs(pull).max() + heft.sum()
        walls = 2 * p
        x = np.vstack([x, np.eye(p), np.eye(p)])
        y = np.concatenate([y, start + reach, start - reach])
        low = np.concatenate([low, np.full(p, -weight), np.zeros(p)])
        high = np.concatenate([high, np.zeros(p), np.full(p, weight)])
    beta, d = interior_point(x, y, low, high, pull, start)
    held = walls and np.abs(d[-walls:]).max() > 1e-7 * max(1.0, heft.sum())
    # Duals that miss their equations by a little prove a little less; walls are no rows.
    rows = d[:len(band)]
    error = np.abs(pull + x[:len(band)].T @ rows)
    proven = float(rows @ band[:, p]) + alpha * y_above + (alpha - 1) * y_below - float(error @ (np.abs(beta) * scale))
    return beta * scale, proven if state.keep == 1.0 and not held else -np.inf


_FOUND = "a double, loss double, sizes array<double>, beta array<double>, bound double"


def _pass(rows, states, features, target, scale):
    """One job: tasks reduce their rows, one task per level solves. The driver gets one row per level."""
    p = len(features) + 1
    by_alpha = {s.alpha: s for s in states}

    def partial(batches):
        sums, bands = {}, {}
        for pdf in batches:
            for a, part, band in _partial(_design(pdf, features), pdf[target].to_numpy(float), pdf["_u"].to_numpy(), states, scale):
                sums[a] = sums[a] + part if a in sums else part
                kept = bands.setdefault(a, [])
                # More than any task could solve: none are sent, the count tells.
                if sum(map(len, kept)) <= 4 * BAND_ROWS:
                    kept.append(band)
        for a, total in sums.items():
            band = np.concatenate(bands[a])
            full = len(band) > 4 * BAND_ROWS
            yield pd.DataFrame({"a": [a], "sums": [total.tolist()], "full": [full], "band": [b"" if full else band.tobytes()]})

    def solve(key, pdf):
        state = by_alpha[key[0]]
        total = np.sum(np.stack([np.asarray(v, float) for v in pdf["sums"]]), axis=0)
        band = np.concatenate([np.frombuffer(b, float).reshape(-1, p + 1) for b in pdf["band"]])
        beta, bound = None, -np.inf
        if not pdf["full"].any() and p < len(band) <= 8 * BAND_ROWS:
            beta, bound = _solve_band(total, band, state, scale, p)
            beta = beta.tolist()
        return pd.DataFrame({"a": [key[0]], "loss": [total[0]], "sizes": [total[1:1 + _BINS].tolist()], "beta": [beta], "bound": [bound]})

    parts = rows.mapInPandas(partial, "a double, sums array<double>, full boolean, band binary")
    found = parts.groupBy("a").applyInPandas(solve, _FOUND).toPandas()
    return {r["a"]: {**r, "scale": scale} for r in found.to_dict("records")}


def _fit_all(train, alphas, features, target, max_iter, p_tol):
    """Rounds over one written table, the same for any number of rows.

    The driver holds coefficients and one row per level and round, never a data row. The table is kept in the
    executors' memory between rounds; what does not fit, or is lost, is read again.
    """
    spark = train.sparkSession
    train = train.select(*features, target).withColumn("split", F.lit("train"))
    stats = scaling.fit(train, features, [])
    scales = stats.first()
    mean, spread = (np.array([scales[f"{c}_{part}"] for c in features]) for part in ("mean", "std"))
    design = scaling.apply(train, stats, features, []).drop("split").withColumn("_u", F.rand(42))
    rows = materialize(design, "design").persist()
    totals = rows.agg(F.count(target).alias("n"), F.stddev_pop(target).alias("spread"), F.avg(target).alias("mean")).first()
    n, p = totals["n"], len(features) + 1
    if not n:
        raise ValueError("no train rows")
    if n <= p or not totals["spread"]:
        values = spread_quantiles(rows, [], target, alphas).first()["quantiles"]
        fitted = [(a, v, [0.0] * len(features), n, 0, True, None) for a, v in zip(alphas, values)]
        return spark.createDataFrame(fitted, MODEL_COLUMNS)
    start = np.zeros(p)
    start[0] = totals["mean"]
    states = [_Round(a, start, keep=1.0 if n <= 1.5 * BAND_ROWS else BAND_ROWS / n) for a in alphas]
    while any(s.open for s in states):
        active = [s for s in states if s.open]
        found = _pass(rows, active, features, target, float(totals["spread"]))
        for s in active:
            s.take(found[s.alpha], n, p, max_iter, p_tol)
    rows.unpersist()
    fitted = [(s.alpha, *_unscale(s.best, mean, spread), n, s.rounds, False, s.gap()) for s in states]
    return spark.createDataFrame(fitted, MODEL_COLUMNS)


def predict(df: DataFrame, model: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Long rows with ``quantile_level`` and ``prediction``."""
    fitted = ["quantile_level", "intercept", "coefficients"]
    if keys:
        joined = df.join(model.select(*keys, *fitted), keys)
    else:
        # As many entries as there are levels.
        levels = model.agg(F.collect_list(F.struct(*fitted)).alias("m")).scalar()
        joined = df.withColumn("_m", levels).select(*df.columns, F.inline("_m"))
    terms = [F.col("coefficients")[i] * F.col(f"`{c}`") for i, c in enumerate(features)]
    value = reduce(lambda a, b: a + b, terms, F.col("intercept"))
    return joined.withColumn("prediction", value).drop("intercept", "coefficients")
