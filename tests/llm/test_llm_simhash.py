"""Fingerprints and components beside all pairs."""

import re

import numpy as np
import xxhash

from panelspark.llm import simhash


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_of_components(prints, ids):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    values = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 4):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    members = {}
    for i in range(len(prints)):
        members.setdefault(find(i), []).append(ids[i])
    return [min((x for x in members[find(i)] if x is not None), default=None) for i in range(len(prints))]


def test_small_table_beside_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    prints = [fingerprint(r.text) for r in rows]
    want = dict(zip([r.doc_id for r in rows], zip([f"{p:016x}" for p in prints], least_of_components(prints, [r.doc_id for r in rows]))))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.cluster(docs).collect()} == want
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {c for _, c in want.values()}


def test_nulls_repeats_and_empty_texts(spark):
    long = "A b\x0bc d é " * 4000
    rows = [(5, None), (3, ""), (None, " \n"), (7, "one two"), (7, "ONE\ttwo"), (None, "alone words here now then"), (9, long), (9, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fingerprint", "'x' AS root", "2 AS component_id")
    got = sorted(((r.fingerprint, r.component_id, r.doc_id) for r in simhash.cluster(docs).collect()), key=str)
    prints = [fingerprint(t) for _, t in rows]
    assert got == sorted(zip([f"{p:016x}" for p in prints], least_of_components(prints, [i for i, _ in rows]), [i for i, _ in rows]), key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    assert simhash.cluster(docs.limit(0)).count() == 0 == simhash.keep_one(docs.limit(0)).count()


def test_crowded_buckets_keep_every_link(spark):
    rng = np.random.default_rng(1)
    points = {0}
    at = int(rng.integers(1 << 62))
    for _ in range(1200):
        near = at
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            near ^= 1 << int(bit)
        points.add(near)
        at = near if rng.random() < 0.1 else at
    values = np.array(sorted(points), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint long")
    stars = {r.node: r.root for r in simhash.components(simhash.links(df, bucket_limit=40)).collect()}
    signed = values.view(np.int64).tolist()
    assert [stars.get(v, v) for v in signed] == least_of_components(values, signed)


def test_masks_cover_all_near_pairs():
    rng = np.random.default_rng(2)
    for fixed in (0, (1 << 20) - 1):
        for blocks in (6, 8):
            masks = simhash.masks(fixed, blocks, 4)
            for _ in range(50):
                change = sum(1 << int(b) for b in rng.choice(np.arange(20, 64), 4, replace=False))
                assert any(not change & m for m in masks) and all(m & fixed == fixed for m in masks)


def test_columns_of_any_name_stay(spark):
    rows = [(1, "same text here", "a", 5, "r"), (2, "same text here", "b", 6, "s"), (3, "another one, quite different from it", None, 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text_hash string, hash int, row string").selectExpr("*", "1 AS id", "2 AS _id", "3 AS root")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect()) == sorted(r for r in docs.collect() if r.doc_id != 2)
