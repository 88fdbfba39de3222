"""Hard negatives of anchors: inner products searched in cover trees over norm-augmented vectors."""

from __future__ import annotations

import heapq
import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from panelspark.llm.common import Stored, delete
from panelspark.session import scratch_path

# Fixed values of the mining rule.
SCALE = 256
ANCHOR_EVERY = 50
POSITIVES = 5
NEGATIVES = 3
LEAST_PERCENT, MOST_PERCENT = 50, 95

TREE_ROWS = 4096
LEAF_ROWS = 32
BLOCK_BYTES = 32 << 20
_CELLS_AT_ONCE = 4_000_000
_EXACT = 2**53
_LONG = 2**63 - 1


# ---- cover tree -------------------------------------------------------------------------

class CoverTree:
    """Nodes in arrays. A node stands for its point and all points within ``radius`` of it, in the space where
    each vector has one more coordinate that brings all to the same length.

    Children of a node of radius r have radii of at most r / 2 and lie more than r / 2 apart, but for nodes of few
    points, whose children are the points. A child may be the node's own point again (``again``).
    """

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: list[list[int]]):
        self.vectors, self.labels, self.ids = vectors, labels, ids
        space = vectors.astype(np.float64)
        squares = (space * space).sum(axis=1)
        self.space = np.concatenate([space, np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))[:, None]], axis=1)
        self.point, self.radius, self.again, self.children = [0], [0.0], [False], [None]
        rest = np.arange(1, len(vectors))
        todo = [(0, rest, self._distance(0, rest))]
        while todo:
            node, members, distance = todo.pop()
            if len(members):
                self.radius[node] = float(distance.max())
                todo += self._split(node, members, distance)
        self.point, self.radius, self.again = np.array(self.point), np.array(self.radius), np.array(self.again)
        self.largest = int(np.abs(vectors).max(initial=0))
        del self.space

    def to_bytes(self) -> bytes:
        return pickle.dumps(self.__dict__)

    @classmethod
    def of_bytes(cls, raw: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        tree.__dict__.update(pickle.loads(raw))
        return tree

    def _distance(self, point: int, members: np.ndarray) -> np.ndarray:
        away = self.space[members] - self.space[point]
        return np.sqrt(np.einsum("ij,ij->i", away, away))

    def _new(self, point: int, again: bool) -> int:
        self.point.append(point)
        self.radius.append(0.0)
        self.again.append(again)
        self.children.append(None)
        return len(self.point) - 1

    def _split(self, node: int, members: np.ndarray, distance: np.ndarray) -> list[tuple]:
        half = self.radius[node] / 2
        if len(members) <= LEAF_ROWS or half == 0:
            self.children[node] = np.array([self._new(int(m), False) for m in members])
            return []
        below, far = [], members[distance > half]
        if len(far) < len(members):
            near = distance <= half
            below.append((self._new(self.point[node], True), members[near], distance[near]))
        while len(far):
            center = int(far[0])
            apart = self._distance(center, far)
            inside = apart <= half
            inside[0] = False
            below.append((self._new(center, False), far[inside], apart[inside]))
            inside[0] = True
            far = far[~inside]
        self.children[node] = np.array([b[0] for b in below])
        return below


def products(queries: np.ndarray, vectors: np.ndarray, largest: int) -> np.ndarray:
    """Exact inner products of integers; those beyond 64 bits stop at the last one."""
    bound = int(np.abs(queries).max(initial=0)) * largest * max(1, queries.shape[1])
    if bound < _EXACT:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    whole = queries.astype(object) @ vectors.astype(object).T
    return np.clip(whole, -_LONG, _LONG).astype(np.int64)


def _first(scores: np.ndarray, good: np.ndarray, k: int):
    """(row, column) of the k highest good scores of each row, the first columns among equals."""
    n = scores.shape[1]
    if n > k and np.abs(scores).max(initial=0) < 2**62 // n:
        # One number that orders by score, then column.
        order = np.where(good, scores * n + (n - 1 - np.arange(n)), -_LONG)
        top = np.argpartition(-order, k, axis=1)[:, :k]
    else:
        top = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), -scores, ~good), axis=1)[:, :k]
    row = np.repeat(np.arange(len(scores)), top.shape[1])
    column = top.ravel()
    kept = good[row, column]
    return row[kept], column[kept]


def search(tree: CoverTree, queries: np.ndarray, labels: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int, best: list[list]):
    """Bring ``best`` up to date: for each query the k points (-score, ids) of its label (or of others) with the highest
    scores within its window, ties by smaller id. The points of a tree are in order of their ids.

    Best first: each query opens the node of the highest bound next. A node is skipped where its bounds show that
    no score within is in the window or above the k-th found, in earlier trees too. Queries that open the same node do
    it together.
    """
    length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    reach = float(np.sqrt((tree.vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
    rounding = 1e-9 * length * reach + 1e-6

    def score(rows: np.ndarray, nodes: np.ndarray):
        """Verify the nodes' points; bounds of what is below them."""
        point = tree.point[nodes]
        found = products(queries[rows], tree.vectors[point], tree.largest)
        wanted = (tree.labels[point][None, :] == labels[rows][:, None]) == same
        good = wanted & ~tree.again[nodes][None, :] & (found >= low[rows][:, None]) & (found <= high[rows][:, None])
        order = np.argsort(point, kind="stable")
        r, c = _first(found[:, order], good[:, order], k)
        c = order[c]
        for i, s, p in zip(rows[r].tolist(), found[r, c].tolist(), point[c].tolist()):
            best[i].append((-s, tree.ids[p]))
        for i in np.unique(rows[r]).tolist():
            best[i] = sorted(best[i])[:k]
        inner = np.flatnonzero([tree.children[n] is not None for n in nodes.tolist()])
        slack = length[rows][:, None] * tree.radius[nodes[inner]][None, :] + rounding[rows][:, None]
        return inner, found[:, inner] - slack, found[:, inner] + slack

    frontier: list[list] = [[] for _ in queries]

    def visit(rows: np.ndarray, nodes: np.ndarray):
        per = max(1, _CELLS_AT_ONCE // len(nodes))
        for some in (rows[i:i + per] for i in range(0, len(rows), per)):
            inner, least, most = score(some, nodes)
            for r, c in zip(*np.nonzero((most >= low[some][:, None]) & (least <= high[some][:, None]))):
                heapq.heappush(frontier[some[r]], (-most[r, c], int(nodes[inner[c]])))

    visit(np.arange(len(queries)), np.array([0]))
    live = [i for i, f in enumerate(frontier) if f]
    while live:
        opened = defaultdict(list)
        for i in live:
            bound, node = heapq.heappop(frontier[i])
            if len(best[i]) == k and -bound < -best[i][-1][0]:
                frontier[i] = []  # all others are lower still
            else:
                opened[node].append(i)
        for node, rows in opened.items():
            visit(np.array(rows), tree.children[node])
        live = [i for i in live if frontier[i]]


# ---- Spark ------------------------------------------------------------------------------

def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, v (integers) and key (of label and v) of the rows that take part."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    label = F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col)).cast("int")
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("vec_id"), label.alias("label"),
        F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("v"))
    return rows.withColumn("key", F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.array_join("v", ",")), 256))


def plant(points: DataFrame, tree_rows: int) -> Stored:
    """Trees over ``points`` (key, label, v, ids), one for each few thousand points of a task, as binary rows."""
    n = max(1, -(-points.count() // tree_rows))

    def grow(batches):
        held = defaultdict(list)

        def made(rows):
            rows.sort(key=lambda r: r[2][0])
            tree = CoverTree(np.array([r[1] for r in rows], np.int64).reshape(len(rows), -1), np.array([r[0] for r in rows], np.int64),
                             [r[2] for r in rows])
            return pa.RecordBatch.from_arrays([pa.array([tree.to_bytes()], pa.binary())], names=["tree"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("label", "v", "ids")]):
                held[len(row[1])].append(row)
                if len(held[len(row[1])]) == 2 * tree_rows:
                    yield made(held.pop(len(row[1])))
        for rows in held.values():
            yield made(rows)

    return Stored(points.repartition(n, "key").mapInArrow(grow, "tree binary"), "trees")


def search_all(trees: DataFrame, queries: DataFrame, same: bool, k: int) -> Stored:
    """key, mark, and found, the first k (id, score), for each window of ``queries`` (key, label, v, windows).

    A window is (mark, low, high). Queries go to the trees in blocks of about BLOCK_BYTES, each sent to all tasks; a
    task returns its own first k, and the best of them are taken.
    """
    spark = trees.sparkSession
    size = queries.agg(F.sum(F.size("v") * 8 + 200).alias("s")).first()["s"] or 0
    blocks = -(-size // BLOCK_BYTES)
    path = scratch_path(spark, "found")
    for block in range(max(1, blocks)):
        mine = queries.where(F.pmod(F.xxhash64("key"), F.lit(max(1, blocks))) == block).collect()
        flat = defaultdict(list)
        for r in mine:
            flat[len(r["v"])] += [(r["key"], r["label"], r["v"], *w) for w in r["windows"]]
        sent = spark.sparkContext.broadcast({
            dims: ([x[0] for x in rows], np.array([x[1] for x in rows], np.int64), np.array([x[2] for x in rows], np.int64).reshape(len(rows), dims),
                   *[np.array([x[j] for x in rows], np.int64) for j in (3, 4, 5)]) for dims, rows in flat.items()})

        def look(batches, sent=sent):
            best = {dims: [[] for _ in keys] for dims, (keys, *_) in sent.value.items()}
            for batch in batches:
                for raw in batch.column("tree").to_pylist():
                    tree = CoverTree.of_bytes(raw)
                    if (dims := tree.vectors.shape[1]) in best:
                        _, labels, vectors, _, low, high = sent.value[dims]
                        search(tree, vectors, labels, same, low, high, k, best[dims])
            for dims, found in best.items():
                keys, _, _, mark, *_ = sent.value[dims]
                flat = [(keys[i], int(mark[i]), -s, ids) for i, near in enumerate(found) for s, ids in near]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[j] for x in flat], kind) for j, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())))],
                    names=["key", "mark", "score", "ids"])

        trees.mapInArrow(look, "key string, mark bigint, score bigint, ids array<bigint>").write.mode("append").parquet(path)
        sent.unpersist()
    every = spark.read.schema("key string, mark bigint, score bigint, ids array<bigint>").parquet(path)
    order = W.partitionBy("key", "mark").orderBy(F.desc("score"), "id")
    first = every.select("key", "mark", "score", F.explode("ids").alias("id")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    top = first.groupBy("key", "mark").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("found"))
    out = Stored(top, "best")
    delete(spark, path)
    return out


def mine(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, tree_rows: int = TREE_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Rows without id, label or vector, or with a null or non-finite component, take no part. Repeated rows count once;
    of different rows with one id, one is taken. Vectors of different lengths never meet; empty vectors score 0. Scores
    beyond 64 bits stop there. An anchor without positives, or a pair without a row in its window, gives no rows; so does an
    empty table. Other columns are not read.

    Equal vectors of one label are one point with its first ids, merged before they move: no result takes more of
    them. Anchors that share a point share its searches. All rows are searched, tree by tree.
    """
    rows = usable(vectors, id_col, vector_col, label_col)
    most = positives + 1  # the anchor itself may be among them
    owners = Stored(rows.groupBy("vec_id").agg(F.min("key").alias("key")), "owners")
    nth = F.row_number().over(W.partitionBy("key").orderBy("vec_id"))
    ids = owners.df.withColumn("nth", nth).where(F.col("nth") <= max(most, negatives)).groupBy("key").agg(
        F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = Stored(rows.groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v")).join(ids, "key"), "points")
    trees = plant(points.df, tree_rows)

    anchors = owners.df.where(F.col("vec_id") % anchor_every == 0)
    wide = F.array(F.struct(F.lit(0).cast("long"), F.lit(-_LONG).cast("long"), F.lit(_LONG).cast("long")))
    queries = Stored(points.df.join(anchors.select("key").distinct(), "key", "left_semi").select("key", "label", "v", wide.alias("windows")), "queries")
    near = search_all(trees.df, queries.df, True, most)
    # 100 * n lies from LEAST_PERCENT * p to MOST_PERCENT * p; below zero there is no such n.
    part = lambda p, percent, up: F.floor((p % 100 * percent + up) / 100).cast("long") + F.floor(p / 100).cast("long") * percent
    window = lambda p: F.struct(p, part(p, LEAST_PERCENT, 99), part(p, MOST_PERCENT, 0))
    scores = F.array_distinct(F.transform(F.filter("found", lambda f: f["score"] >= 0), lambda f: f["score"]))
    windows = near.df.select("key", F.transform(scores, window).alias("windows"))
    hard = search_all(trees.df, queries.df.drop("windows").join(windows, "key"), False, negatives)

    each = near.df.select("key", F.transform("found", lambda f: f["id"]).alias("among"), F.explode("found").alias("p"))
    answers = each.join(hard.df.select("key", F.col("mark").alias("score"), F.col("found").alias("negatives")),
                        (each["key"] == hard.df["key"]) & (each["p"]["score"] == F.col("score"))).select(
        each["key"], "among", "p", "negatives")
    answers = Stored(answers, "answers")
    own = F.array_position("among", F.col("vec_id"))
    place = F.col("p")["nth"]
    taken = (F.col("p")["id"] != F.col("vec_id")) & (place <= F.when(own > 0, most).otherwise(positives))
    pairs = anchors.join(answers.df, "key").where(taken)
    return pairs.select(F.col("vec_id").alias("anchor_id"), F.col("p")["id"].alias("positive_id"), F.col("p")["score"].alias("positive_score"),
                        F.explode("negatives").alias("x")).select(
        "anchor_id", "positive_id", F.col("x")["nth"].cast("int").alias("rank"), F.col("x")["id"].alias("negative_id"), "positive_score",
        F.col("x")["score"].alias("negative_score"))
