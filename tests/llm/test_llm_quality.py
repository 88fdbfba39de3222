"""Counts beside plain Python, cutoffs beside the exact binomial."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from panelspark.llm import quality

SPACE = "\x20\x09-\x0d"


def counts(text):
    text = text or ""
    words = re.findall(f"[^{SPACE}]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(f"[^{SPACE}]", x)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \t\n", "a b c d e", "a b c d e a b c d e", "x " * 40, "l 1\nl 1\n\nl 1\n#*$%&|<>é ü w",
         "a b c d e f a b c d e g h i j k l m n o a b c d e f", "é" * 70_000 + " w" * 9_000, "1 2 3 4 5 6 7 8 9 10 11"]


def test_counts_equal_plain_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr(
        "*", "CAST(NULL AS STRING) AS lang", "'x' AS m", "1 AS stratum", "2 AS row", "3 AS n_words")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for r in quality.judge(docs, labels).collect():
        want = counts(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed)


def test_counts_equal_on_the_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.judge(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id])


@pytest.mark.parametrize("k,n,rate", [(0, 300, 0.0125), (2, 900, 0.0125), (9, 1000, 0.0125), (300, 100_000, 0.0125), (1, 3, 0.5)])
def test_binomial_tail(spark, k, n, rate):
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate)
            for i in range(k + 1)]
    want = max(logs) + math.log(sum(math.exp(x - max(logs)) for x in logs))
    tail = quality.log_binomial_tail(F.col("k"), F.col("n"), rate)
    got = spark.createDataFrame([(k, n)], "k long, n long").select(tail.alias("p")).collect()[0].p
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9)


def labelled(spark, n_good, n_bad, good_symbols=0):
    clean = " ".join(f"w{i}" for i in range(20))
    rows = [(i, clean + (" #a #b #c #d #e #f" if i < good_symbols else ""), "xx", 1) for i in range(n_good)]
    rows += [(n_good + i, clean + " #a #b #c #d #e #f", "xx", 0) for i in range(n_bad)]
    rows += [(n_good + n_bad, clean + " #a #b #c #d #e #f", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    return df.drop("quality"), df.select("doc_id", "quality")


def test_cutoff_needs_enough_good_documents(spark):
    rejected = lambda *a: quality.judge(*labelled(spark, *a)).where(~F.col("kept")).count()
    # 0.95 of ln(0.05 / 4) / ln(1 - 0.05 / 4) documents, and more than that.
    need = math.log(0.05 / 4) / math.log(1 - 0.05 / 4)
    assert rejected(int(0.95 * need), 50) == 0
    assert rejected(int(1.05 * need), 50) == 50  # the unlabelled stratum has no cutoff
    assert rejected(int(1.05 * need), 50, 30) == 0


def test_repeated_and_null_labels(spark):
    docs, labels = labelled(spark, 400, 30)
    twice = labels.union(labels).union(spark.createDataFrame([(None, 0), (5, None), (401, 1)], "doc_id long, quality int"))
    out = quality.judge(docs.union(docs), twice, keep_columns=True)
    assert out.count() == 2 * docs.count() and out.where(~F.col("kept")).count() == 60
    assert quality.judge(docs.limit(0), labels).count() == 0
