"""Quality rules whose cutoffs are chosen on labelled documents, with a bound on false rejections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.llm.common import Stored, let

# Fixed values of the base rules.
SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# What a rule measures (a share of words, letters or lines) and the cutoffs it may take, laxest first.
RULES = {
    "symbols": ("n_symbols", "n_words", (2.0, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    "capitals": ("n_capitals", "n_letters", (0.9, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    "repeats": ("n_repeat_words", "n_words", (0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.04, 0.02)),
    "lines": ("n_dup_lines", "n_lines", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
}
FALSE_REJECTIONS = 0.05
ERROR_RATE = 0.05
# In a choice among safe cutoffs, one lost good document weighs as much as so many rejected bad ones.
GOOD_WEIGHT = 10


# ---- measures ---------------------------------------------------------------------------

def _count(text: Column, others: str) -> Column:
    """Code points left without runs of ``others``."""
    return F.length(F.regexp_replace(text, others, ""))


def _repeat_words(words: Column) -> Column:
    """Words that stand in a window of five found at least twice in the text.

    Windows are compared by 64-bit hashes. Few texts have an equal pair; only they are sorted.
    """
    n = F.size(words)

    def windows(hashes):
        at = lambda i: [F.get(hashes, i + k) for k in range(WINDOW)]
        return F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*at(i)))

    def starts(prints):
        """Starts of windows that have an equal one, ascending."""
        order = F.array_sort(F.transform(prints, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def equal(pairs):
            other = lambda k: F.get(pairs, k)["h"]
            kept = F.filter(pairs, lambda p, k: (F.coalesce(other(k - 1) == p["h"], F.lit(False)))
                            | F.coalesce(other(k + 1) == p["h"], F.lit(False)))
            return F.array_sort(F.transform(kept, lambda p: p["i"]))

        return let(order, equal)

    def covered(found):
        """Each start covers five words, or as many as there are before the next start."""
        return F.aggregate(
            F.transform(found, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(found, k + 1) - i, F.lit(WINDOW)))),
            F.lit(0), lambda a, x: a + x)

    def counted(prints):
        return F.when(F.size(F.array_distinct(prints)) == F.size(prints), 0).otherwise(let(starts(prints), covered))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n < WINDOW + 1, 0).otherwise(let(let(hashes, windows), counted))


def _measures(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))

    def of_words(words):
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).cast("long").alias("n_repeat_words"))

    def of_lines(found):
        return F.struct(F.size(found).cast("long").alias("n_lines"),
                        (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"))

    return F.struct(
        let(F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), 0), of_words).alias("words"),
        let(lines, of_lines).alias("lines"),
        _count(text, f"[^{SYMBOLS}]+").cast("long").alias("n_symbols"),
        _count(text, r"\P{Lu}+").cast("long").alias("n_capitals"),
        _count(text, r"\P{L}+").cast("long").alias("n_letters"))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters"]


def measure(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with one more column ``m``, a struct of counts over the whole text (null: empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.col("m")
    flat = {"n_words": found["words"]["n_words"], "word_chars": found["words"]["word_chars"],
            "n_repeat_words": found["words"]["n_repeat_words"], "n_lines": found["lines"]["n_lines"],
            "n_dup_lines": found["lines"]["n_dup_lines"]}
    flat |= {c: found[c] for c in ("n_symbols", "n_capitals", "n_letters")}
    return rows.withColumn("m", _measures(text)).withColumn("m", F.struct(*[flat[c].alias(c) for c in COUNTS]))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def _share(m: Column, rule: str) -> Column:
    part, whole, _ = RULES[rule]
    return F.when(m[whole] > 0, m[part] / m[whole]).otherwise(0.0)


# ---- exact binomial bound ---------------------------------------------------------------

def _log_gamma(x: Column) -> Column:
    """Stirling's series after eight steps up; right to about 1e-13 for x >= 1."""
    y = x + 8
    steps = F.log(x)
    for k in range(1, 8):
        steps = steps + F.log(x + k)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - steps


def log_binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """Log of P(X <= k) for X binomial(n, rate), for k < n * rate.

    Terms fall from i = k down; summed until the rest is below double precision.
    """
    first = (_log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0)
             + k * math.log(rate) + (n - k) * math.log1p(-rate))
    steps = F.least(k, F.ceil(10 * F.sqrt(n * rate)) + 20)
    odds = (1 - rate) / rate
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc, j):
        i = k - j + 1  # from the term of i to that of i - 1
        term = F.when(j == 0, acc["term"]).otherwise(acc["term"] * i / (n - i + 1) * odds)
        return F.struct(term.alias("term"), F.when(j == 0, acc["sum"]).otherwise(acc["sum"] + term).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(0).cast("long"), steps), start, add)
    return first + F.log(total["sum"])


# ---- cutoffs ----------------------------------------------------------------------------

def learn(measured: DataFrame, labels: DataFrame, *, id_col: str, false_rejections: float, error_rate: float) -> DataFrame:
    """One row per stratum with a map from rule to cutoff.

    Among labelled documents that pass the base rules, a cutoff's false rejections are the good ones at or above it.
    It is safe if the exact binomial test rejects a rate above ``false_rejections`` / number of
    rules: then all rules of a stratum together reject at most ``false_rejections`` of its good
    documents. Each rule of each stratum tests its cutoffs from the laxest on and stops at the first
    that fails (fixed sequence), at level ``error_rate`` / (strata * rules); so with probability
    1 - ``error_rate`` all chosen cutoffs are safe. The safe cutoff that gains most is taken, the
    laxest among equals; none if none gains.
    """
    truth = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.max("quality").alias("good"))
    passed = measured.where(~base_failed(F.col("m"))).select(F.col(id_col).alias("doc_id"), "stratum", "m")
    met = lambda r: F.filter(F.array(*map(F.lit, RULES[r][2])), lambda c: c <= _share(F.col("m"), r))
    shares = F.array(*[F.struct(F.lit(r).alias("rule"), F.size(met(r)).alias("met")) for r in RULES])
    levels = Stored(passed.join(truth, "doc_id").select("stratum", "good", F.explode(shares).alias("s")).groupBy(
        "stratum", "s.rule", "s.met").agg(
        F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("good") == 1, 0).otherwise(1)).alias("bad")), "levels").df
    # A document that meets the last j cutoffs of the list is at or above each of them.
    size = {r: len(RULES[r][2]) for r in RULES}
    cutoffs = F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*[F.array(*map(F.lit, RULES[r][2])) for r in RULES]))
    every = levels.groupBy("stratum", "rule").agg(
        F.sum("good").alias("n"), F.collect_list(F.struct("met", "good", "bad")).alias("levels"))
    tests = every.select("stratum", "rule", "n", "levels", F.posexplode(cutoffs[F.col("rule")]).alias("step", "cutoff"))
    reach = F.when(F.lit(True), F.lit(0))
    for r in RULES:
        reach = F.when(F.col("rule") == r, size[r] - F.col("step")).otherwise(reach)
    hit = lambda c: F.aggregate(F.filter("levels", lambda x: x["met"] >= reach), F.lit(0).cast("long"),
                                lambda a, x: a + x[c])
    tests = tests.select("stratum", "rule", "n", "step", "cutoff", hit("good").alias("k"), hit("bad").alias("caught"))
    rate = false_rejections / len(RULES)
    strata = max(1, levels.select("stratum").distinct().count())
    chance = F.when(F.col("k") < F.col("n") * rate, log_binomial_tail(F.col("k"), F.col("n"), rate)).otherwise(0.0)
    tests = tests.withColumn("safe", chance <= math.log(error_rate / len(RULES) / strata))
    so_far = W.partitionBy("stratum", "rule").orderBy("step")
    gain = F.col("caught") - GOOD_WEIGHT * F.col("k")
    safe = tests.withColumn("safe", F.min("safe").over(so_far)).where(F.col("safe") & (gain > 0))
    best = safe.groupBy("stratum", "rule").agg(F.max(F.struct(gain.alias("gain"), "cutoff")).alias("best"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "best.cutoff"))).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          keep_columns: bool = False, false_rejections: float = FALSE_REJECTIONS, error_rate: float = ERROR_RATE) -> DataFrame:
    """Every row with its counts, base_failed, kept and rejected_by (names of rules, comma-joined).

    Columns: doc_id and the counts, or with ``keep_columns`` the struct ``row`` of all columns of ``docs``
    besides. A null text is empty and fails the base rules. Null strata form one of their own. A label of a repeated
    id counts for each row; labels that disagree count as good; null labels or ids do not
    count. A stratum with too few labels gets no cutoff, so it keeps all that pass the base rules.
    An empty table gives no rows; empty labels give no cutoffs.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).select(
        F.col(f"row.{id_col}").alias("doc_id"), F.col(f"row.{text_col}").alias("text"),
        F.coalesce(F.col(f"row.{stratum_col}").cast("string"), F.lit("")).alias("stratum"), "row")
    wanted = ["doc_id", "stratum", "m"] + ["row"] * keep_columns
    measured = Stored(measure(rows, "text").select(*wanted), "measured").df
    cutoffs = Stored(learn(measured, labels, id_col="doc_id", false_rejections=false_rejections,
                           error_rate=error_rate), "cutoffs").df
    m = F.col("m")
    by = F.array_compact(F.array(*[F.when(_share(m, r) >= F.col("cutoffs")[r], F.lit(r)) for r in RULES]))
    judged = measured.join(cutoffs, "stratum", "left").withColumns(
        {"base_failed": base_failed(m), "rejected_by": F.array_join(F.coalesce(by, F.array().cast("array<string>")), ",")})
    kept = ~F.col("base_failed") & (F.col("rejected_by") == "")
    return judged.select("doc_id", *[m[c].alias(c) for c in COUNTS[:5]], "base_failed", kept.alias("kept"),
                         "rejected_by", *["row"] * keep_columns)
