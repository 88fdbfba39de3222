"""Nearest examples beside all cosines, held-out accuracy, odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import toxicity as T


def made(seed, n=700, terms=60):
    rng = np.random.default_rng(seed)
    vectors = []
    for _ in range(n):
        place = np.unique(rng.integers(0, terms, rng.integers(0, 6)) ** 2 // terms)
        vectors.append((place.tolist(), rng.integers(1, 4, len(place)).tolist()))
    return vectors, (rng.random(n) < 0.3).tolist(), rng.uniform(0.1, 3, terms), rng


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_beside_all_cosines(seed):
    vectors, toxic, idf, rng = made(seed)
    index = T.Index(vectors, toxic, list(range(len(vectors))), [1.0] * len(vectors), idf)

    def dense(v):
        out = np.zeros(len(idf))
        out[v[0]] = (1 + np.log(v[1])) * idf[v[0]]
        return out / max(np.linalg.norm(out), 1e-12)

    table = np.array([dense(v) for v in vectors])
    for q in range(0, len(vectors), 7):
        place, n = map(np.array, vectors[q])
        entry, score = index.nearest(place.astype(int), n, 25)
        cosine = np.sort(table @ dense(vectors[q]))[::-1]
        copies = index.copies[entry]
        got = np.repeat(score, copies)[:25]
        want = cosine[:25][cosine[:25] > 1e-12]
        assert np.allclose(got[:len(want)], want, atol=1e-9) and len(got) >= len(want)
        if len(entry):
            near = 1 / (0.05 + 1 - np.minimum(score, 1))
            assert index.vote(entry, score) == pytest.approx((near * index.bad[entry]).sum() / (near * index.all[entry]).sum())


def test_bounds_skip_blocks(monkeypatch):
    vectors = [([i // 70], [1 + i % 70]) for i in range(7000)]
    index = T.Index(vectors, [False] * 7000, list(range(7000)), [1.0] * 7000, np.ones(100))
    vectors = [([i // 70, 99], [1 + i % 70, 1]) for i in range(6900)]
    index = T.Index(vectors, [False] * 6900, list(range(6900)), [1.0] * 6900, np.r_[np.ones(99), 0.05])
    read = []

    class Counted(list):
        def __getitem__(self, i):
            read.append(i)
            return super().__getitem__(i)

    index.blocks = Counted(index.blocks)
    index.nearest(np.array([3]), np.array([2]), 5)
    assert 0 < len(read) < 10


def test_curve_rises():
    rng = np.random.default_rng(3)
    votes = rng.random(300)
    x, y = T.isotonic(votes, (rng.random(300) < votes).astype(float), np.ones(300))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = T.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    wrong = sum(r.predicted != r.toxic for r in rows)
    assert len(rows) > 50 and wrong / len(rows) < 0.1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_held_out_labels_and_other_columns_teach_nothing(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumns({"lang": F.lit("x"), "source": F.lit("y"), "toxic": F.lit(1), "n": F.lit(2), "score": F.lit(1.0)})
    key = lambda df: sorted((r.doc_id, r.score) for r in df.collect())
    assert key(T.score(docs, labels)) == key(T.score(other, turned))


def test_odd_rows(spark):
    toxic, clean = "you idiot moron clown", "have a nice day"
    rows = [(i, f"{toxic if i % 2 else clean} {i:03d}") for i in range(60)]
    rows += [(None, toxic), (100, None), (101, ""), (102, "word " * 200_000 + toxic), (102, "word " * 200_000 + toxic), (103, "\udc00".encode("utf-8", "replace").decode())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (7, None), (3, 0)], "doc_id long, toxic int")
    out = T.score(docs, labels, least_chi=5.0).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[None].predicted == 1 and by[102].predicted == 1 and by[1].predicted == 1 and by[0].predicted == 0
    assert by[100].score == by[101].score and by[1].evidence[0].toxic == 1
    empty = spark.createDataFrame([], docs.schema)
    assert T.score(empty, labels).count() == 0
    none = T.score(docs, spark.createDataFrame([], labels.schema)).collect()
    assert len(none) == len(rows) and len({r.score for r in none}) == 1
