"""Boosted trees over all rows, for any number of quantile levels at once, from histograms.

Rows are binned once. For each level of a tree, one pass adds up gradients by (quantile level, leaf, feature, bin) in every
task, and one small row per task and quantile level is shuffled. Of two sibling leaves only the smaller is read; the other is
what is left of their parent. Leaves of a pinball tree take the exact quantile of their residuals, found by narrowing the
leading bits of the numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.models.histograms import BINS, choose, descend, histogram, leaf_value, nodes_of
from panelspark.session import drop_scratch, materialize

ROUNDS_PER_CUT = 5
_ROWS_AT_ONCE = 100_000
_ACCURACY = 2_000
_TASKS_PER_SUM = 64
# Tasks' histograms of so many bytes in all are added up on the driver.
SUMMED_HERE = 16 << 20
# Numbers share their leading bits down to these; a group of at most so many rows is ordered whole.
_SHIFTS = (44, 24, 4, 0)
VALUES_AT_ONCE = 1_000_000
# A task adds up its counts of prefixes when it holds so many, and hands them on if more than half are different.
_COUNTS_AT_ONCE = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def draw(ids: np.ndarray, seed: int, number: int) -> np.ndarray:
    """Numbers from 0 to 1, fixed by row, seed and round."""
    with np.errstate(over="ignore"):
        h = ids.view(np.uint64) + _MIX * np.uint64(1 + number + (seed % 1_000_003) * 7919)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


def drawn_columns(width: int, share: float, seed: int, number: int) -> np.ndarray | None:
    """Which columns a tree may use: that share of them, one at least."""
    if share >= 1:
        return None
    picked = np.zeros(width, bool)
    picked[np.random.default_rng([seed, number]).permutation(width)[:max(1, int(round(share * width)))]] = True
    return picked


def ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers that sort like the given doubles."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))


def unordered(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >= 0, keys, keys ^ np.int64(0x7FFFFFFFFFFFFFFF)).view(np.float64)


def pack(values: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    values = np.ascontiguousarray(values)
    size = values.itemsize * values.shape[1]
    ends = np.arange(len(values) + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def unpack(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Rows of equally many numbers from their bytes, not copied."""
    n, size = len(column), width * np.dtype(dtype).itemsize
    if not n or not width:
        return np.empty((n, width), dtype)
    _, ends, data = column.buffers()
    begin = int(np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset])
    return np.frombuffer(data, np.uint8)[begin:begin + n * size].view(dtype).reshape(n, width)


def count_pairs(leaf: np.ndarray, prefix: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs in order, and how often each is there; ``n`` counts pairs that were added up before."""
    if not len(leaf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    low, span = int(prefix.min()), int(prefix.max()) - int(prefix.min()) + 1
    if n is None and span * (int(leaf.max()) + 1) < 1 << 62:
        one = np.sort(leaf * span + (prefix - low))
        leaf, prefix = one // span, one % span + low
    else:
        order = np.lexsort((prefix, leaf))
        leaf, prefix, n = leaf[order], prefix[order], None if n is None else n[order]
    first = np.flatnonzero(np.concatenate([[True], (leaf[1:] != leaf[:-1]) | (prefix[1:] != prefix[:-1])]))
    counts = np.diff(np.append(first, len(leaf))) if n is None else np.add.reduceat(n, first)
    return leaf[first], prefix[first], counts


class Booster:
    """Progress of the trees of all levels; a level of None is squared loss."""

    def __init__(self, train: DataFrame, levels: list, features: list[str], target: str, options: dict):
        self.levels, self.options, self.width = levels, options, len(features)
        self.borders = self._borders(train, features)
        self.done: list[list] = [[] for _ in levels]     # rows of finished trees
        self.recent: list[list] = [[] for _ in levels]   # (cuts, values) since the rows were last written
        self.rows, self.path = None, None
        self._write(self._binned(train, features, target))

    def _borders(self, train, features):
        marks = [float(m) for m in np.linspace(0, 1, BINS + 1)[1:-1]]
        found = train.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), marks, _ACCURACY).alias(f"q{i}")
                            for i, c in enumerate(features)]).first()
        return [np.unique(np.array([v for v in found[f"q{i}"] or [] if v == v], float)) for i in range(self.width)]

    def _binned(self, train, features, target):
        """b (a byte per feature), y, id (random, for draws) and f (a double per level)."""
        borders, levels = self.borders, len(self.levels)
        plain = train.select(F.col(target).cast("double").alias("y"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)])

        def bin_rows(batches):
            for batch in batches:
                columns = [np.searchsorted(b, batch.column(i + 1).to_numpy(zero_copy_only=False)).astype(np.uint8) for i, b in enumerate(borders)]
                packed = np.column_stack(columns) if columns else np.empty((batch.num_rows, 0), np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pack(packed), batch.column(0), pack(np.zeros((batch.num_rows, levels)))],
                    names=["b", "y", "f"])

        found = plain.where(F.col("y").isNotNull()).mapInArrow(bin_rows, "b binary, y double, f binary")
        return found.withColumn("id", (F.rand(int(self.options["seed"])) * 2.0**62).cast("long"))

    def _write(self, rows):
        """Rows with all trees so far in f: plans stay short, and a lost executor costs a few rounds."""
        old, before = self.rows, self.path
        written = materialize(rows, "boost")
        self.path = written.inputFiles()
        self.rows = written.persist()
        self.tasks = len(self.path)
        self.recent = [[] for _ in self.levels]
        if old is not None:
            old.unpersist()
            drop_scratch(written.sparkSession, before)

    def _read(self):
        """A function from a batch to (bins, y, ids, f) with recent trees added."""
        width, levels, recent = self.width, len(self.levels), self.recent

        def read(batch):
            bins, f = unpack(batch.column("b"), np.uint8, width), unpack(batch.column("f"), float, levels).copy()
            for level, trees in enumerate(recent):
                for cuts, values in trees:
                    f[:, level] += values[descend(bins, cuts)]
            return bins, batch.column("y").to_numpy(), batch.column("id").to_numpy(), f

        return read

    def settle(self):
        """Write the rows again with their present fits."""
        read = self._read()

        def moved(batches):
            for batch in batches:
                *_, f = read(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("b"), batch.column("y"), pack(f), batch.column("id")], names=["b", "y", "f", "id"])

        self._write(self.rows.mapInArrow(moved, "b binary, y double, f binary, id long"))

    # ---- one round ----

    def _sums(self, slots, cuts, number):
        """Histograms of the wanted leaves of each level, summed over all tasks; a slot of -1 is not wanted."""
        read, levels, options = self._read(), self.levels, self.options

        def partial(batches):
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                    bins, y, ids, f = read(batch.slice(at, _ROWS_AT_ONCE))
                    live = draw(ids, options["seed"], number) < options["subsample"] if options["subsample"] < 1 else np.ones(len(y), bool)
                    for level, alpha in enumerate(levels):
                        r = y - f[:, level]
                        g = r if alpha is None else np.where(r >= 0, alpha, alpha - 1)
                        n = int(slots[level].max()) + 1
                        if n:
                            slot = np.where(live, slots[level][descend(bins, cuts[level])], -1)
                            found = np.stack(histogram(bins, g, slot, n)).ravel()
                            totals[level] = totals[level] + found if level in totals else found
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["a", "v"])

        def add(pdf):
            total = np.sum([np.frombuffer(v, float) for v in pdf["v"]], axis=0)
            return pd.DataFrame({"a": [pdf["a"].iloc[0]], "v": [total.tobytes()]})

        parts = self.rows.mapInArrow(partial, "a int, v binary")
        size = sum(int(slot.max()) + 1 for slot in slots) * self.width * BINS * 16 * self.tasks
        if size <= SUMMED_HERE:
            # As much as a shuffle would bring here anyway: one stage less.
            found: dict[int, np.ndarray] = {}
            for r in parts.collect():
                found[r["a"]] = found.get(r["a"], 0) + np.frombuffer(r["v"], float)
            return {a: v.reshape(2, -1, self.width, BINS) for a, v in found.items()}
        if self.tasks > 2 * _TASKS_PER_SUM:
            spread = F.pmod(F.spark_partition_id(), F.lit(self.tasks // _TASKS_PER_SUM))
            parts = parts.withColumn("s", spread).groupBy("a", "s").applyInPandas(lambda pdf: add(pdf[["a", "v"]]), "a int, v binary")
        found = parts.groupBy("a").applyInPandas(add, "a int, v binary").collect()
        return {r["a"]: np.frombuffer(r["v"], float).reshape(2, -1, self.width, BINS) for r in found}

    def grow(self, number: int):
        """Cuts of one tree per level, and what its leaves hold."""
        o = self.options
        columns = drawn_columns(self.width, o["colsample_bytree"], o["seed"], number)
        cuts: list[list] = [[] for _ in self.levels]
        slots = [np.zeros(1, np.int64) for _ in self.levels]
        whole: list = [None] * len(self.levels)
        sides: list = [None] * len(self.levels)
        for depth in range(o["max_depth"]):
            found = self._sums(slots, cuts, number)
            for level in range(len(self.levels)):
                empty = np.zeros((2, 0, self.width, BINS))
                whole[level] = self._whole(whole[level], slots[level], cuts[level], found.get(level, empty))
                *cut, sides[level] = choose(*whole[level], o["min_child_weight"], o["gamma"], o["reg_alpha"], o["reg_lambda"], columns)
                cuts[level].append(tuple(cut))
                # Of the two sides of a cut the smaller is read next; nodes without a cut need no reading.
                rows = sides[level][0].reshape(-1, 2)
                small = np.zeros((len(rows), 2), bool)
                small[np.arange(len(rows)), (rows[:, 1] < rows[:, 0]).astype(int)] = cut[0]
                slots[level] = np.where(small.ravel(), np.cumsum(small.ravel()) - 1, -1)
        return cuts, sides

    def _whole(self, parents, slots, cuts, found):
        """Histograms of all leaves of a level from those read and their parents'."""
        if parents is None:
            return found if found.shape[1] else np.zeros((2, 1, self.width, BINS))
        out = np.zeros((2, len(slots), self.width, BINS))
        read = slots >= 0
        out[:, read] = found[:, slots[read]]
        cut = cuts[-1][0]
        for node in range(len(cut)):
            low, high = 2 * node, 2 * node + 1
            if not cut[node]:
                out[:, low] = parents[:, node]
            elif read[low]:
                out[:, high] = parents[:, node] - out[:, low]
            else:
                out[:, low] = parents[:, node] - out[:, high]
        return out

    def leaf_quantiles(self, cuts) -> list[dict[int, float]]:
        """The exact quantile, with linear interpolation, of each leaf's residuals, for each level.

        Ranks are narrowed by the leading bits of the residuals: first the counts of all prefixes, then only rows of the
        prefixes that hold a wanted rank, until few enough remain to be ordered by value.
        """
        read, levels = self._read(), self.levels
        wanted, shifts = None, list(_SHIFTS)
        out: list[dict] = [{} for _ in levels]
        shares: dict = {}
        while True:
            shift = shifts.pop(0)
            found = self._ranks(read, cuts, wanted, None if wanted is None else before, shift)
            for r in found:
                shares[r["a"], r["leaf"]] = r["share"]
            if shift == 0:
                ends: dict = {}
                for r in found:
                    ends.setdefault((r["a"], r["leaf"]), {})[r["which"]] = float(unordered(np.array([r["prefix"]], np.int64))[0])
                for (a, leaf), v in ends.items():
                    low, high, share = v[0], v.get(1, v[0]), shares[a, leaf]
                    out[a][leaf] = low * (1 - share) + high * share
                return out
            wanted = {}
            for r in found:
                wanted.setdefault((r["a"], r["leaf"]), {}).setdefault(r["prefix"], []).append((r["which"], r["rank"], r["share"]))
            before = shift
            if max((r["n"] for r in found), default=0) <= VALUES_AT_ONCE:
                shifts = [0]

    def _ranks(self, read, cuts, wanted, before, shift):
        """a, leaf, which (0 or 1), prefix, rank within it, its rows n, and the share between the two ranks."""
        levels = self.levels
        quantile = [i for i, alpha in enumerate(levels) if alpha is not None]

        # The prefixes to go on with, in order, for each level and leaf.
        live = {at: np.sort(np.array(list(prefixes), np.int64)) for at, prefixes in (wanted or {}).items()}

        def merged(counts):
            return {a: [count_pairs(*map(np.concatenate, zip(*parts)))] for a, parts in counts.items()}

        def table(counts):
            leaf, prefix, n = map(np.concatenate, zip(*[v[0] for v in counts.values()]))
            # What a prefix was before it was made longer.
            above = np.zeros(len(prefix), np.int64) if wanted is None else prefix >> (before - shift)
            a = np.repeat(np.array(list(counts), np.int32), [len(v[0][0]) for v in counts.values()])
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (a, leaf, above, prefix, n)], names=["a", "leaf", "above", "prefix", "n"])

        def partial(batches):
            counts: dict[int, list] = {}
            held = 0
            for batch in batches:
                bins, y, _, f = read(batch)
                for a in quantile:
                    leaf, key = descend(bins, cuts[a]), ordered(y - f[:, a])
                    if wanted is not None:
                        above = key >> before
                        kept = np.zeros(len(key), bool)
                        for (level, node), prefixes in live.items():
                            if level == a:
                                near = prefixes[np.minimum(np.searchsorted(prefixes, above), len(prefixes) - 1)]
                                kept |= (leaf == node) & (near == above)
                        leaf, key = leaf[kept], key[kept]
                    found = count_pairs(leaf, key >> shift)
                    if len(found[0]):
                        counts.setdefault(a, []).append(found)
                        held += len(found[0])
                if held >= _COUNTS_AT_ONCE:
                    counts = merged(counts)
                    held = sum(len(v[0][0]) for v in counts.values())
                    if held >= _COUNTS_AT_ONCE // 2:
                        yield table(counts)
                        counts, held = {}, 0
            if held:
                yield table(merged(counts))

        def pick(key, pdf):
            a, leaf, above = (int(k) for k in key)
            counts = pdf.groupby("prefix")["n"].sum().sort_index()
            upto = counts.cumsum().to_numpy()
            if wanted is None:
                spot = (upto[-1] - 1) * levels[a]
                asked = [(0, int(np.floor(spot)), spot - np.floor(spot)), (1, int(np.ceil(spot)), spot - np.floor(spot))]
            else:
                asked = wanted[a, leaf][above]
            rows = []
            for which, rank, share in asked:
                at = int(np.searchsorted(upto, rank, side="right"))
                n = int(counts.iloc[at])
                rows.append((a, leaf, which, int(counts.index[at]), int(rank - (upto[at] - n)), n, float(share)))
            return pd.DataFrame(rows, columns=["a", "leaf", "which", "prefix", "rank", "n", "share"])

        parts = self.rows.mapInArrow(partial, "a int, leaf long, above long, prefix long, n long")
        # Tasks have added up their own: one shuffle serves the sum and the choice.
        parts = parts.repartition("a", "leaf", "above").groupBy("a", "leaf", "above", "prefix").agg(F.sum("n").alias("n"))
        return parts.groupBy("a", "leaf", "above").applyInPandas(
            pick, "a int, leaf long, which int, prefix long, rank long, n long, share double").collect()

    def start(self):
        """Tree 0 of each level is one leaf: the mean or the quantile."""
        none = [[] for _ in self.levels]
        quantiles = self.leaf_quantiles(none) if any(a is not None for a in self.levels) else none
        mean = self.rows.agg(F.avg("y")).first()[0]
        for level, alpha in enumerate(self.levels):
            value = float(mean) if alpha is None else quantiles[level][0]
            self.recent[level].append(([], np.array([value])))
            self.done[level] += nodes_of(0, [], self.borders, {0: value})

    def step(self, number: int):
        """One more tree for each level."""
        o = self.options
        cuts, sides = self.grow(number)
        exact = self.leaf_quantiles(cuts) if any(a is not None for a in self.levels) else None
        for level, alpha in enumerate(self.levels):
            n = 2 ** len(cuts[level])
            if alpha is None:
                rows, total = sides[level] if sides[level] is not None else (np.zeros(1), np.zeros(1))
                values = np.where(rows > 0, leaf_value(total, rows, o["reg_alpha"], o["reg_lambda"]), 0.0)
            else:
                values = np.array([exact[level].get(i, 0.0) for i in range(n)])
            values = o["eta"] * values
            self.recent[level].append((cuts[level], values))
            self.done[level] += nodes_of(number, cuts[level], self.borders, dict(enumerate(values)))
        if number % ROUNDS_PER_CUT == 0:
            self.settle()

    def close(self):
        self.rows.unpersist()
        drop_scratch(self.rows.sparkSession, self.path)


def fit(train: DataFrame, levels: list, features: list[str], target: str, options: dict, rounds: int) -> list[tuple]:
    """Rows (level, tree, node, feature, border, low, high, value) of boosted trees for all levels.

    ``options``: eta, max_depth, min_child_weight, gamma (least gain per row), reg_alpha, reg_lambda, subsample,
    colsample_bytree, seed. Rows with a null target do not count; NaN features go to the high side. What the driver holds is
    bounded by levels, leaves, features and bins.
    """
    if train.select(target).where(F.col(target).isNotNull()).isEmpty():
        raise ValueError("no train rows")
    booster = Booster(train, levels, features, target, options)
    booster.start()
    for number in range(1, rounds + 1):
        booster.step(number)
    booster.close()
    return [(level, *row) for level, rows in zip(levels, booster.done) for row in rows]
