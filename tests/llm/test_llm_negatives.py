"""Hard negatives beside all pairs."""

import numpy as np
import pytest

from panelspark.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, key string, v int"


def brute(rows, every=50):
    kept = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept[i] = ([int(np.floor(256 * float(np.float32(x)))) for x in v], (label + 1) % 10 if i % 7 == 0 else label)
    out = set()
    for a, (v, label) in kept.items():
        if a % every:
            continue
        others = sorted((-sum(x * y for x, y in zip(v, w)), i, m == label) for i, (w, m) in kept.items() if i != a and len(w) == len(v))
        for p, i, _ in [x for x in others if x[2]][:5]:
            found = [(n, j) for n, j, same in others if not same and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out |= {(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(found)}
    return out


def made(seed, n, dims, hot):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dims))
    rows = []
    for i in range(n):
        v = (centers[rng.integers(12)] * rng.uniform(0.2, 2) + rng.normal(size=dims) * rng.choice([0.01, 0.3])).tolist()
        if rng.random() < hot:
            v = [0.5] * dims
        rows.append((i, v, int(rng.integers(4)), "key", 1))
    return rows


@pytest.mark.parametrize("seed,dims,hot,tree_rows", [(1, 8, 0.3, 64), (2, 3, 0.0, 500), (3, 1, 0.1, 40)])
def test_beside_all_pairs(spark, seed, dims, hot, tree_rows):
    rows = made(seed, 400, dims, hot)
    odd = [(700, None, 1, "", 1), (750, [0.1] * (dims - 1) + [None], 1, "", 1), (800, [0.1] * (dims - 1) + [float("nan")], 1, "", 1),
           (850, [float("inf")] * dims, 1, "", 1), (900, [0.5] * dims, None, "", 1), (None, [0.5] * dims, 1, "", 1), (1000, [], 1, "", 1),
           (1001, [], 2, "", 1), (1002, [], 1, "", 1), (1050, [0.5] * (dims + 1), 1, "", 1), rows[3], rows[50]]
    docs = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    got = [tuple(r) for r in H.mine(docs, tree_rows=tree_rows).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows + odd)


def test_huge_components_and_empty_table(spark):
    rows = [(i, [3e37 * (i % 5 - 2), 1.0, float(i)], i % 2, "", 0) for i in range(100)]
    assert H.mine(spark.createDataFrame(rows, SCHEMA)).count() >= 0
    assert H.mine(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_covers_and_separates():
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(800, 3)) * 256).astype(np.int64)
    tree = H.CoverTree(x, np.zeros(800, np.int64), [[i] for i in range(800)])
    space = x.astype(float)
    squares = (space**2).sum(axis=1)
    space = np.c_[space, np.sqrt(squares.max() - squares)]

    def below(node):
        own = [] if tree.again[node] else [int(tree.point[node])]
        return own + [p for c in (tree.children[node] if tree.children[node] is not None else []) for p in below(c)]

    assert sorted(below(0)) == list(range(800))
    for node, children in enumerate(tree.children):
        if children is None:
            continue
        far = np.linalg.norm(space[below(node)] - space[tree.point[node]], axis=1)
        assert far.max() <= tree.radius[node] + 1e-9
        if sum(len(below(c)) for c in children) > H.LEAF_ROWS + 1:
            assert (tree.radius[children] <= tree.radius[node] / 2 + 1e-9).all()
            c = space[tree.point[children]]
            apart = np.linalg.norm(c[:, None] - c[None], axis=2)[~np.eye(len(c), dtype=bool)]
            assert not len(apart) or apart.min() > tree.radius[node] / 2 - 1e-9


def test_search_opens_few_nodes(monkeypatch):
    """Windows and bounds keep a search from scoring most points."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 6)) * 2000
    x = (centers[np.repeat(np.arange(40), 100)] + rng.normal(size=(4000, 6)) * 5).astype(np.int64)
    tree = H.CoverTree(x, np.arange(4000) % 3, [[i] for i in range(4000)])
    scored = []
    plain = H.products
    monkeypatch.setattr(H, "products", lambda q, v, m: scored.append(len(q) * len(v)) or plain(q, v, m))
    one = x[:1]
    exact = x @ one[0]
    for low, high in ((0, 10**9), (exact.max() // 2, exact.max() * 3 // 4)):
        scored.clear()
        got = [[]]
        H.search(tree, one, np.array([0]), False, np.array([low]), np.array([high]), 3, got)
        want = sorted((-int(s), i) for i, s in enumerate(exact) if low <= s <= high and i % 3)[:3]
        assert [(s, p) for s, (p,) in got[0]] == want
        assert sum(scored) < 1500
