"""Secrets in texts: a trigram inverted index picks the documents a rule can match, the rule verifies them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.llm.common import Stored, let


@dataclass(frozen=True)
class Rule:
    """A pattern that Java and Python read alike; matches whose group is shorter than ``least`` do not count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# Fixed patterns. The first three are the base kinds, in their order.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # as runs of [0-9a-f] of 24 and more: a run is matched whole
)
FURTHER = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("login", r"://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)
RULES = BASE + FURTHER

_MOST_STRINGS = 64


# ---- Boolean trigram queries ------------------------------------------------------------

def _all(parts):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *dict.fromkeys(parts))


def _any(parts):
    """One of the parts; a part that asks for all that another asks for, and more, adds nothing."""
    parts = list(dict.fromkeys(parts))
    flat = {p: {p} if isinstance(p, str) else set(p[1:]) if p is not True and p[0] == "and" else None for p in parts}
    parts = [p for p in parts if flat[p] is None or not any(o and o < flat[p] for o in flat.values())]
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings):
    return _any([_all([s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(items):
    """Strings that the items match, if they are few, else None; and what any match must hold."""
    run, needs, exact = {""}, [], True
    for op, arg in items:
        strings, need = _item(str(op), arg)
        if strings is not None and len(run) * len(strings) <= _MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
            continue
        needs += [_of_strings(run), need if strings is None else True]
        run, exact = (strings or {""}), False
    needs.append(_of_strings(run))
    return (run if exact else None), _all(needs)


def _item(op, arg):
    if op == "LITERAL":
        return {chr(arg).lower()}, True
    if op == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
        return {chr(a).lower() for _, a in arg}, True
    if op == "SUBPATTERN":
        return _walk(arg[-1])
    if op == "BRANCH":
        found = [_walk(branch) for branch in arg[1]]
        if all(s is not None for s, _ in found):
            return set().union(*(s for s, _ in found)), _any([q for _, q in found])
        return None, _any([q for _, q in found])
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = arg
        strings, need = _walk(inner)
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, True
        return None, need if low else True
    if op in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}, True
    return None, True  # a class or any character


def trigram_query(pattern: str):
    """What the lower-cased text of every match must hold: a trigram, ("and", ...), ("or", ...) or True.

    True: the rule has no trigram that it must have, so each text is scanned.
    """
    return _walk(re._parser.parse(pattern))[1]


def trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1:]))


def _holds(query, present: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(present, query)
    parts = [_holds(q, present) for q in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if query[0] == "and" else (out | p)
    return out


# ---- index ------------------------------------------------------------------------------

def build_index(rows: DataFrame, rules=RULES) -> Stored:
    """Postings (trigram, key) of the trigrams that the rules' queries name; no others can be asked for.

    ``rows``: text and its hash ``key``. Equal hashes share postings, so copies are indexed once; texts
    that differ and share a hash at worst give a candidate too many.
    """
    words = sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))
    low = F.lower("text")
    held = let(low, lambda t: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(t, w)))
    return Stored(rows.select(F.explode(held).alias("trigram"), "key").distinct(), "postings")


def candidates(postings: DataFrame, rules=RULES) -> DataFrame:
    """key and the kinds whose query its postings satisfy, for keys with any."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {k: q for k, q in queries.items() if q is not True}
    present = postings.where(F.col("trigram").isin(*set().union(*map(trigrams, asked.values())))).groupBy("key").agg(
        F.collect_set("trigram").alias("present"))
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("present")), F.lit(k)) for k, q in asked.items()]))
    return present.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


# ---- verification -----------------------------------------------------------------------

def prefix_sums(values: Column) -> Column:
    """Sum of all values before each: blocks of about the root of their number, so that appending stays cheap."""
    zero = F.lit(0).cast("long")

    def running(part, start):
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out")), step)["out"]

    def of_blocks(blocks):
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x))
        return F.flatten(F.zip_with(blocks, running(totals, zero), running))

    size = F.ceil(F.sqrt(F.size(values))).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.size(values), size), lambda i: F.slice(values, i, size))
    return let(blocks, of_blocks)


def _matches(rule: Rule, text: Column, body, none: Column) -> Column:
    """``body(matches, gaps, values)`` where the rule matches, else ``none``. There is a gap before each match and one after."""
    values = F.regexp_extract_all(text, F.lit(rule.pattern), rule.group)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), 0)
    return let(found, lambda f: F.when(F.size(f) == 0, none).otherwise(
        let(F.split(text, rule.pattern, -1), lambda g: body(f, g, f if rule.group == 0 else values))))


_SPANS = "array<struct<start:bigint,nth:int,stop:bigint>>"


def _spans(rule: Rule, nth: int, text: Column) -> Column:
    """Spans in code points, end exclusive."""

    def body(found, gaps, values):
        whole = F.zip_with(gaps, found, lambda g, f: F.length(g) + F.coalesce(F.length(f), F.lit(0)))

        def placed(sums):
            spans = F.transform(found, lambda f, i: F.struct(
                (F.get(sums, i) + F.length(F.get(gaps, i))).alias("start"), F.lit(nth).alias("nth"),
                (F.get(sums, i) + F.length(F.get(gaps, i)) + F.length(f)).alias("stop")))
            return F.filter(spans, lambda s, i: F.length(F.get(values, i)) >= rule.least).cast(_SPANS)

        return let(prefix_sums(F.transform(whole, lambda x: x.cast("long"))), placed)

    return _matches(rule, text, body, F.array().cast(_SPANS))


def _prepared(rows: DataFrame, rules) -> DataFrame:
    """``rows`` (with a column text) and the kinds whose index query each text satisfies."""
    keyed = rows.withColumn("key", F.xxhash64("text"))
    found = candidates(build_index(keyed.select("text", "key"), rules).df, rules)
    return keyed.join(Stored(found, "candidates").df, "key", "left")


def _where_asked(rule: Rule, value: Column, none: Column) -> Column:
    if trigram_query(rule.pattern) is True:
        return value
    return F.when(F.array_contains("kinds", rule.kind), value).otherwise(none)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules=RULES, n_base: int = len(BASE)) -> DataFrame:
    """doc_id, a count per base kind, base_sha256 and spans of every row.

    spans: kind:start:end by start, then kind as listed, comma-joined; base_sha256 is over those
    of the first ``n_base`` rules. Matches are leftmost and non-overlapping per kind. A null text is empty; null,
    equal and repeated ids are rows of their own; an empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text, none = F.col("text"), F.array().cast(_SPANS)
    found = F.array_sort(F.concat(*[_where_asked(r, _spans(r, i, text), none) for i, r in enumerate(rules)]))
    spans = _prepared(rows, rules).select("doc_id", found.alias("found"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    show = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(
        ":", F.get(kinds, s["nth"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["nth"] < n_base)
    return spans.select(
        "doc_id", *[_count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules[:n_base])],
        F.sha2(show(base), 256).alias("base_sha256"), show(F.col("found")).alias("spans"))


def _count(nth: int) -> Column:
    return F.size(F.filter("found", lambda s: s["nth"] == nth)).cast("long")


def redact(docs: DataFrame, *, text_col: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with each secret replaced by its kind in brackets, rule by rule in their order.

    Null and other texts without secrets stay as they are, and so do all other columns.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = packed.withColumn("text", F.col(f"row.{text_col}"))
    text = F.col("text")
    out = _prepared(rows, rules)
    for rule in rules:
        def body(found, gaps, values, rule=rule):
            put = F.transform(found, lambda f, i: F.when(F.length(F.get(values, i)) >= rule.least, F.lit(f"[{rule.kind}]")).otherwise(f))
            return F.array_join(F.flatten(F.zip_with(gaps, put, lambda g, p: F.array_compact(F.array(g, p)))), "")

        out = out.withColumn("text", _where_asked(rule, _matches(rule, text, body, text), text))
    return out.select(*[F.col("text" if c == text_col else f"row.{c}").alias(c) for c in docs.columns])
