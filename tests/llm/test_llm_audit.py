"""The filter audit beside plain Python over all pairs and all orders."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from panelspark.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, mask int, n long"


def fails(rows):
    out = []
    for doc_id, text, part in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        failed = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": re.search("[#$%&*|]", text) is not None,
            "E": doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in rows)}
        out.append((doc_id, part or "", {f for f in "ABCDE" if failed[f]}))
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed, out = fails(rows), {}
    for part in {p for _, p, _ in failed}:
        mine = [(i, f) for i, p, f in failed if p == part]
        share = {x: 0 for x in "ABCDE"}
        for order in permutations("ABCDE"):
            for _, f in mine:
                first = next((x for x in order if x in f), None)
                if first:
                    share[first] += 1
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                removed = [i for i, f in mine if x in f and not f & before]
                out[part, "".join(order), k + 1] = (
                    sum(not f & (before | {x}) for _, f in mine), len(removed), sum(x in f and bool(f & before) for _, f in mine),
                    sum(f == {x} for _, f in mine), sum(i in good for i in removed), sum(i in toxic for i in removed), share[x])
    return out


def random_rows(seed, n=120):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeXYZ" for b in "efghé "] + ["A&B", "#x"]
    texts = [" ".join(rng.choice(words[:rng.choice((5, 30, 50))]) for _ in range(rng.choice((0, 1, 5, 99, 100, 140)))) for _ in range(25)]
    texts += [t + "x" for t in texts[:8]] + [t[:-1] for t in texts[:8]] + ["long " * 50_000, "x" * 300_000, "x" * 300_000 + "y", None, ""]
    hot = texts[3]
    return [(rng.choice((None, *range(60))), hot if rng.random() < 0.33 else rng.choice(texts), rng.choice(("en", "de", "", None))) for _ in range(n)]


@pytest.mark.parametrize("seed,crowd", [(1, 100), (2, 1)])
def test_beside_all_pairs(spark, monkeypatch, seed, crowd):
    rows = random_rows(seed)
    rng = random.Random(seed)
    labels = [(rng.choice((None, *range(60))), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(60)]
    monkeypatch.setattr(filter_audit, "_CHUNK_BYTES", 200_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"mask": F.lit(1), "n": F.lit(5)}).repartition(5)
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, truth, rows_per_prefix=crowd, length_per_range=20_000).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute(rows, labels)
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got})


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    assert {(r.kept, r.removed) for r in filter_audit.audit(one, labels).where("step = 1").collect()} == {(0, 1), (1, 0)}


def test_trie_keeps_least_ids_of_whole_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode() for _ in range(400)]
    trie, gone = filter_audit.Trie(), []
    for i, t in sorted(enumerate(texts), key=lambda x: rng.random()):
        gone += trie.add(trie.terminal(t), i, (i,), 1) or []
    assert sorted(i for (i,), _ in gone) == [i for i, t in enumerate(texts) if t in texts[:i]]
    assert {(t, i) for t, _, (i,), _ in trie.rows()} == {(t, texts.index(t)) for t in texts}


def test_prefixes_adapt_to_crowds(spark):
    docs = spark.createDataFrame([(f"shared beginning of many texts {i:04d}",) for i in range(2000)] + [("copy",)] * 2000, "text string")
    key, bounds = filter_audit.plan_ranges(docs, 50, 2000)
    rows = docs.select("text", key.alias("key")).distinct().collect()
    assert len({bytes(r.key) for r in rows}) > 1000 and len(bounds) > 20
    assert [bytes(r.key)[0] for r in rows if r.text == "copy"] == [0xFF]
