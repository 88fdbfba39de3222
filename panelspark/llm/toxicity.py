"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import Stored
from panelspark.llm.language import held_out
from panelspark.llm.tokens import slices

# What the classifier is fitted on: about so many labelled documents of each class.
EXAMPLES = 8_000
VOCABULARY = 4_096
LEAST_DOCS = 5
LEAST_CHI_SQUARE = 30.0
# The share of chi-square in the number of examples: how strong a link is, whatever the number of examples.
LEAST_LINK = 0.004
NEIGHBOURS = 25
# One in so many examples is kept out of the index to calibrate votes.
CALIBRATE_EVERY = 4
EVIDENCE = 3

_WORD = re.compile(r"\w+")
_STEMS = range(4, 9)
_BLOCK = 64
# Words, judged vectors and terms that a worker remembers at a time.
_MEMORY, _VECTORS, _TERMS = 100_000, 20_000, 150_000


def terms_of(word: str) -> list[str]:
    """The word, and its longer beginnings as stems: insults of inflected languages share those."""
    return [word, *[word[:k] + "*" for k in _STEMS if len(word) > k]]


class Places(dict):
    """Places in the vocabulary of each word's terms, found once for each word; never more than _MEMORY words."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.vocabulary[t] for t in terms_of(word) if t in self.vocabulary)
        if len(self) >= _MEMORY:
            self.clear()
        self[word] = found
        return found


def counts_of(text: str | None, places: Places) -> tuple[list[int], list[int]]:
    """Which terms a whole text holds, ascending, and how often."""
    hits = [p for found in map(places.__getitem__, _WORD.findall((text or "").lower())) if found for p in found]
    if not hits:
        return [], []
    place, n = np.unique(hits, return_counts=True)
    return place.tolist(), n.tolist()


# ---- index ------------------------------------------------------------------------------

class Index:
    """Examples in blocks; for each term the highest weight in each block bounds what a block can reach.

    Examples with equal vectors are one entry with their number and that of toxic ones. Entries are in order of their
    heaviest terms, so that a block's examples are alike and its bounds near what it holds.
    """

    def __init__(self, vectors: list[tuple], toxic: list[bool], names: list, weight: list[float], idf: np.ndarray):
        self.idf = idf
        merged: dict[tuple, list] = {}
        for v, y, name, w in zip(vectors, toxic, names, weight):
            if v[0]:
                entry = merged.setdefault((tuple(v[0]), tuple(v[1])), [0.0, 0.0, 0, name, y])
                entry[0] += w
                entry[1] += w * y
                entry[2] += 1
                if name is not None and (entry[3] is None or name < entry[3]):
                    entry[3], entry[4] = name, y
        heavy = {k: self.unit(*map(np.array, k)) for k in merged}
        order = sorted(merged, key=lambda k: ([k[0][i] for i in np.argsort(-heavy[k], kind="stable")], k[1]))
        self.all = np.array([merged[k][0] for k in order])
        self.bad = np.array([merged[k][1] for k in order])
        self.copies = np.array([merged[k][2] for k in order], np.int64)
        self.names = [merged[k][3] for k in order]
        self.toxic = [bool(merged[k][4]) for k in order]
        self.blocks, bounds = [], np.zeros((len(idf), -(-len(order) // _BLOCK)))
        for b in range(0, len(order), _BLOCK):
            mine = order[b:b + _BLOCK]
            local = np.unique(np.concatenate([np.array(k[0]) for k in mine]))
            table = np.zeros((len(mine), len(local)))
            for i, k in enumerate(mine):
                table[i, np.searchsorted(local, k[0])] = heavy[k]
            self.blocks.append((local, table))
            bounds[local, b // _BLOCK] = table.max(axis=0)
        self.bounds = bounds

    def unit(self, place: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.idf[place]
        length = np.sqrt((w * w).sum())
        return w / length if length > 0 else w

    def nearest(self, place: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries with the highest cosines above zero, first entries among equals, until they stand for k examples.

        Blocks are read in order of their bounds until no other can hold one of them.
        """
        w = self.unit(place, n)
        most = w @ self.bounds[place] if len(place) else np.zeros(0)
        dense = np.zeros(len(self.idf))
        dense[place] = w
        entry, score = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-most, kind="stable").tolist():
            if most[b] <= 0 or (len(score) and self.copies[entry].sum() >= k and most[b] < score[-1] - 1e-9):
                break
            local, table = self.blocks[b]
            found = table @ dense[local]
            good = np.flatnonzero(found > 0)
            entry = np.concatenate([entry, b * _BLOCK + good])
            score = np.round(np.concatenate([score, found[good]]), 12)
            order = np.lexsort((entry, -score))
            entry, score = entry[order], score[order]
            enough = int(np.searchsorted(np.cumsum(self.copies[entry]), k)) + 1
            entry, score = entry[:enough], score[:enough]
        return entry, score

    def vote(self, entry: np.ndarray, score: np.ndarray) -> float:
        """Share of toxic examples, each counting by its nearness."""
        near = 1 / (0.05 + 1 - np.minimum(score, 1))
        return float((near * self.bad[entry]).sum() / (near * self.all[entry]).sum())


def isotonic(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising shares of toxic over votes (pool adjacent violators), as points to interpolate between."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for x, y, w in zip(votes[order], toxic[order], weight[order]):
        pools.append([x * w, y * w, w])
        while len(pools) > 1 and (pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Model:
    """Vocabulary, index, and how votes become chances."""

    def __init__(self, vocabulary: list[str], idf: np.ndarray, rows: list[tuple], share: dict[bool, float]):
        self.vocabulary = vocabulary
        weight = [1 / share[y] for _, y, _, _ in rows]
        kept = [h % CALIBRATE_EVERY != 0 for *_, h in rows]
        pick = lambda values, want: [v for v, k in zip(values, kept) if k == want]
        vectors, toxic, names = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        self.index = Index(pick(vectors, True), pick(toxic, True), pick(names, True), pick(weight, True), idf)
        bare = [(y, w) for v, y, w in zip(vectors, toxic, weight) if not v[0]]
        every = [(y, w) for y, w in zip(toxic, weight)]
        chance = lambda some: (sum(y * w for y, w in some) + 0.1) / (sum(w for _, w in some) + 1)
        self.bare = chance(bare or every)
        votes, truth, heft = [], [], []
        for v, y, w in zip(pick(vectors, False), pick(toxic, False), pick(weight, False)):
            entry, score = self.index.nearest(np.array(v[0], np.int64), np.array(v[1]), NEIGHBOURS)
            if len(entry):
                votes.append(self.index.vote(entry, score))
                truth.append(float(y))
                heft.append(w)
        self.x, self.y = isotonic(np.array(votes), np.array(truth), np.array(heft)) if votes else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def judge(self, place: list[int], n: list[int]):
        """(score, the nearest examples as id, label and cosine)."""
        entry, score = self.index.nearest(np.array(place, np.int64), np.array(n), NEIGHBOURS)
        if not len(entry):
            return self.bare, []
        vote = self.index.vote(entry, score)
        # A little of the vote keeps the order within a flat step.
        chance = 0.98 * float(np.interp(vote, self.x, self.y)) + 0.02 * vote
        return chance, [(self.index.names[e], int(self.index.toxic[e]), float(s)) for e, s in zip(entry[:EVIDENCE], score[:EVIDENCE])]


# ---- Spark ------------------------------------------------------------------------------

def examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> tuple[Stored, dict[bool, float]]:
    """About ``most`` documents of each label whose rows may teach, and the share of each label's rows that they are.

    A row is taken if the hash of its id is below a bound set from the label's count. Only the taken ids, at
    most about 2 * ``most`` rows, are sent to all tasks; equal texts are one, toxic if half of them are.
    """
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        (F.max("toxic") == 1).alias("toxic"))
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    share = {y: min(1.0, most / total[y]) if total.get(y) else 1.0 for y in (True, False)}
    bound = {y: int(share[y] * 2.0**63) * 2 - 2**63 - 1 if share[y] < 1 else 2**63 - 1 for y in share}
    taken = rows.where(F.xxhash64("doc_id") <= F.when(F.col("toxic"), bound[True]).otherwise(bound[False]))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(taken), "doc_id")
    texts = texts.groupBy(F.xxhash64("text").alias("hash")).agg(
        F.first("text").alias("text"), F.min("doc_id").alias("doc_id"), (F.avg(F.col("toxic").cast("int")) >= 0.5).alias("toxic"))
    return Stored(texts, "examples"), share


def select_terms(found: DataFrame, least_docs: int, least_chi: float, least_link: float, most: int) -> list[str]:
    """The terms that go most with label 1, by chi-square on the documents that hold them."""
    size = {r["toxic"]: r["count"] for r in found.groupBy("toxic").count().collect()}
    n1, n0 = size.get(True, 0), size.get(False, 0)
    if not n1 or not n0:
        return []

    def count(batches):
        bad: dict[str, int] = {}
        every: dict[str, int] = {}

        def flush():
            names = list(every)
            made = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([bad.get(t, 0) for t in names], pa.int64()), pa.array([every[t] for t in names], pa.int64())],
                names=["term", "a", "n"])
            bad.clear()
            every.clear()
            return made

        for batch in batches:
            for part in slices(batch, 100):
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    for t in {t for w in set(_WORD.findall(text.lower())) for t in terms_of(w)}:
                        every[t] = every.get(t, 0) + 1
                        if toxic:
                            bad[t] = bad.get(t, 0) + 1
                    if len(every) > _TERMS:
                        yield flush()
        yield flush()

    terms = found.select("text", "toxic").mapInArrow(count, "term string, a long, n long").groupBy("term").agg(
        F.sum("a").cast("double").alias("a"), F.sum("n").cast("double").alias("n")).where(F.col("n") >= least_docs)
    a, b = F.col("a"), F.col("n") - F.col("a")
    c, d = n1 - a, n0 - b
    chi = (n1 + n0) * F.pow(a * d - b * c, F.lit(2)) / F.greatest(F.col("n") * (c + d) * n1 * n0, F.lit(1e-9))
    best = terms.where(a * n0 > b * n1).select("term", chi.alias("chi")).where(
        F.col("chi") >= max(least_chi, least_link * (n1 + n0))).orderBy(F.desc("chi"), "term").limit(most)
    return [r["term"] for r in best.collect()]


def features(docs: DataFrame, vocabulary: list[str], *keep: str) -> DataFrame:
    """``keep`` columns, and place and n: the vocabulary's terms in the whole ``text`` and how often."""
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def read(batches):
        places = Places(sent.value)
        for batch in batches:
            for part in slices(batch, 100):
                found = [counts_of(t, places) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array([p for p, _ in found], pa.list_(pa.int32())),
                     pa.array([n for _, n in found], pa.list_(pa.int32()))], names=[*keep, "place", "n"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keep], "place array<int>, n array<int>"])
    return docs.select("text", *keep).mapInArrow(read, schema)


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", examples_per_label: int = EXAMPLES,
          vocabulary: int = VOCABULARY, least_docs: int = LEAST_DOCS, least_chi: float = LEAST_CHI_SQUARE, least_link: float = LEAST_LINK) -> DataFrame:
    """doc_id, held_out, score (chance of label 1), predicted (1 from 0.5 on) and evidence, the nearest examples.

    Labels (doc_id, toxic) teach unless crc32 of the id as text divides by five. Terms are words and stems; the
    vocabulary holds those that go with label 1 among the examples, their document frequencies come from all documents. A text is
    the vector of its terms' (1 + log n) * idf; the examples with the highest cosines vote, each by 1 / (0.05 + distance),
    and votes become chances by a rising curve fitted on examples outside the index. Examples count by the share of their label's rows
    that was taken. Texts without a term (null and empty ones too) get the share of toxic examples among
    such (0.1 without any example); without examples of both labels there is no term and all get that. Ties of cosine go to the
    first entry. Of several labels of an id, 1 wins; null labels and ids do not count. Null and repeated ids stay, each
    row with its score; an empty table gives no rows. Other columns are not read.

    All texts are read once, into term counts. The index holds at most about 2 * ``examples_per_label`` examples.
    """
    spark = docs.sparkSession
    found, share = examples(docs, labels, id_col, text_col, examples_per_label)
    terms = select_terms(found.df, least_docs, least_chi, least_link, vocabulary)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    read = Stored(features(rows, terms, "doc_id"), "term_counts")
    known = {r["p"]: r["count"] for r in read.df.select(F.explode("place").alias("p")).groupBy("p").count().collect()}
    total = read.df.count()
    idf = np.array([np.log((1 + total) / (1 + known.get(i, 0))) + 0.01 for i in range(len(terms))])
    taught = features(found.df, terms, "doc_id", "toxic", "hash").collect()
    taught = sorted(((list(r["place"]), list(r["n"])), r["toxic"], r["doc_id"], r["hash"]) for r in taught)
    sent = spark.sparkContext.broadcast(Model(terms, idf, taught, share))
    found.delete()
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def judge(batches):
        model, seen = sent.value, {}
        for batch in (part for whole in batches for part in slices(whole, 2000)):
            out = []
            for place, n in zip(batch.column("place").to_pylist(), batch.column("n").to_pylist()):
                key = (tuple(place), tuple(n))
                if key not in seen:
                    if len(seen) >= _VECTORS:
                        seen.clear()
                    seen[key] = model.judge(place, n)
                out.append(seen[key])
            ids = batch.schema.field("doc_id").type
            evidence = pa.list_(pa.struct([("doc_id", ids), ("toxic", pa.int32()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([s for s, _ in out], pa.float64()),
                 pa.array([[dict(zip(("doc_id", "toxic", "cosine"), e)) for e in near] for _, near in out], evidence)],
                names=["doc_id", "score", "evidence"])

    judged = read.df.mapInArrow(judge, f"doc_id {id_type}, score double, evidence array<struct<doc_id:{id_type},toxic:int,cosine:double>>")
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
