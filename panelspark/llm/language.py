"""Language of texts: a convolutional network over bytes, trained in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.tokens import slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
EMBEDDING = 8
TRAIN_DOCS = 3_000
WINDOWS_PER_DOC = 4
EPOCHS = 10
_BATCH = 64
_RATE = 0.01
_WINDOWS_AT_ONCE = 512


class ByteNet:
    """Embedded bytes, filters of several widths, the most that each reaches in a window, softmax.

    A filter's answer is a sum of one number per byte of its width; ``tables`` holds those sums for
    pairs of bytes, so that reading a window is looking up.
    """

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        n = FILTERS * len(WIDTHS)
        self.weights = {"embed": rng.normal(0, 0.5, (256, EMBEDDING)), "out": rng.normal(0, 0.1, (n, len(classes))),
                        "bias": np.zeros(len(classes))}
        for w in WIDTHS:
            self.weights[f"filter{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS))
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def _pooled(self, windows: np.ndarray):
        """Per width the maxima over a window, at least 0, and where they are. Padding (byte 0) answers like any other."""
        out = []
        for w in WIDTHS:
            by_byte = np.einsum("be,wef->wbf", self.weights["embed"], self.weights[f"filter{w}"])
            n = windows.shape[1] - w + 1
            answer = by_byte[0][windows[:, :n]]
            for j in range(1, w):
                answer = answer + by_byte[j][windows[:, j:j + n]]
            where = answer.argmax(axis=1)
            top = np.take_along_axis(answer, where[:, None, :], axis=1)[:, 0, :]
            out.append((np.maximum(top, 0), where))
        return out

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> ByteNet:
        """Adam on the cross-entropy, classes weighted alike."""
        rng = np.random.default_rng(seed)
        weight = (1 / np.maximum(np.bincount(labels, minlength=len(self.classes)), 1)).astype(np.float32)
        weight = weight[labels] / weight[labels].mean()
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), _BATCH):
                rows = order[at:at + _BATCH]
                gradient = self._gradient(windows[rows], labels[rows], weight[rows])
                step += 1
                rate = _RATE * (1 - epoch / epochs)
                for k, g in gradient.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.weights[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-7)
        return self

    def _gradient(self, windows, labels, weight):
        pooled = self._pooled(windows)
        features = np.concatenate([p for p, _ in pooled], axis=1)
        chance = _softmax(features @ self.weights["out"] + self.weights["bias"])
        chance[np.arange(len(labels)), labels] -= 1
        error = chance * (weight / len(labels))[:, None]
        out = {"out": features.T @ error, "bias": error.sum(axis=0), "embed": np.zeros_like(self.weights["embed"])}
        back = (error @ self.weights["out"].T) * (features > 0)
        for i, w in enumerate(WIDTHS):
            # Only the place of each maximum learns.
            g, where = back[:, i * FILTERS:(i + 1) * FILTERS], pooled[i][1]
            filters = self.weights[f"filter{w}"]
            change = np.zeros_like(filters)
            for j in range(w):
                bytes_ = np.take_along_axis(windows, where + j, axis=1)
                embedded = self.weights["embed"][bytes_]
                change[j] = np.einsum("bfe,bf->ef", embedded, g)
                np.add.at(out["embed"], bytes_.ravel(), (g[:, :, None] * filters[j].T[None]).reshape(-1, EMBEDDING))
            out[f"filter{w}"] = change
        return out

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, what each pair of its bytes adds to an answer, and the last byte of an odd width."""
        out = []
        for w in WIDTHS:
            by_byte = np.einsum("be,wef->wbf", self.weights["embed"], self.weights[f"filter{w}"]).astype(np.float32)
            pairs = [(by_byte[j][:, None, :] + by_byte[j + 1][None, :, :]).reshape(65_536, -1) for j in range(0, w - 1, 2)]
            out.append(pairs + [by_byte[w - 1]] * (w % 2))
        return out

    def predict(self, windows: np.ndarray, tables) -> np.ndarray:
        """Log probabilities of each class for each window."""
        pairs = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
        features = []
        for w, parts in zip(WIDTHS, tables):
            n = windows.shape[1] - w + 1
            answer = parts[0][pairs[:, :n]]
            for j, part in enumerate(parts[1:], 1):
                answer += part[(pairs if len(part) == 65_536 else windows)[:, 2 * j:2 * j + n]]
            features.append(np.maximum(answer.max(axis=1), 0))
        return np.log(np.maximum(_softmax(np.concatenate(features, axis=1) @ self.weights["out"] + self.weights["bias"]), 1e-12))


def _softmax(x):
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def windows_of(raw: bytes) -> np.ndarray:
    """The whole of a text, A-Z in lower case, in windows of WINDOW bytes, the last filled with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[:len(raw)] = np.frombuffer(raw.lower(), np.uint8)
    return out.reshape(n, WINDOW)


def held_out(doc_id) -> F.Column:
    """Documents that teach nothing: crc32 of the id as text divides by five. A null id is like an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, text_col: str, lang_col: str, most: int, windows_per_doc: int):
    """Windows and labels of at most ``most`` documents, as many of each language as there are.

    The distinct texts with the least hashes are taken, and windows at even distances in them. Only these windows come
    to the driver, at most most * windows_per_doc * WINDOW characters, or one text's of each language if there are
    more than ``most`` languages. A hash counts only below a bound, set from the count of a language's texts so that
    about twice as many as wanted lie below it. The bounds, one row per language, are sent to all tasks, and texts are cut to
    their windows there: no whole text moves, and no task ranks more than a language's few hashes.
    """
    from pyspark.sql import Window as W

    texts = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["count"] for r in texts.select("lang", "hash").distinct().groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.empty((0, WINDOW), np.uint8), np.empty(0, np.int64)
    step = F.greatest(F.lit(0), (F.length("text") - WINDOW) / F.lit(max(1, windows_per_doc - 1)))
    parts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(windows_per_doc - 1)), lambda i: F.substring(
        F.col("text"), (i * step).cast("int") + 1, F.lit(WINDOW))))
    each = max(1, most // len(langs))
    # Hashes spread evenly from -2**63 on; 2 * each + 100 or more are expected below the bound.
    bounds = {x: int((2 * each + 100) / n * 2.0**64) - 2**63 for x, n in counts.items() if n > 2 * each + 100}
    spark = docs.sparkSession
    bound = spark.createDataFrame(list(bounds.items()), "lang string, bound long")
    low = texts.join(F.broadcast(bound), "lang", "left").where(F.col("bound").isNull() | (F.col("hash") <= F.col("bound")))
    low = low.select("lang", "hash", parts.alias("parts")).dropDuplicates(["lang", "hash"])
    least = F.row_number().over(W.partitionBy("lang").orderBy("hash"))
    rows = low.withColumn("nth", least).where(F.col("nth") <= each).select("lang", F.explode("parts").alias("part")).collect()
    rows = sorted((r["lang"], r["part"]) for r in rows)
    windows = np.concatenate([windows_of(p.encode()[:WINDOW]) for _, p in rows])
    place = {x: i for i, x in enumerate(langs)}
    return langs, windows, np.array([place[x] for x, _ in rows], np.int64)


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS,
          windows_per_doc: int = WINDOWS_PER_DOC, epochs: int = EPOCHS) -> ByteNet | None:
    """A network for the languages of ``docs``; none without a labelled text. ``most`` bounds the documents it sees."""
    langs, windows, labels = sample(docs, text_col, lang_col, most, windows_per_doc)
    return ByteNet(langs).fit(windows, labels, epochs) if langs else None


def predict(docs: DataFrame, model: ByteNet | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row.

    All windows of a text count: their log probabilities are averaged, score is the chance of the best class then.
    lang_pred is ``und`` and score 0 for a null text, one without a letter, or without a model; of languages of equal chance
    the first by name wins. Null and repeated ids stay; an
    empty table gives no rows. Other columns are not read. A map: no row moves.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        net = sent.value
        tables = net.tables() if net else None
        for batch in batches:
            for part in slices(batch, 200):
                letters = part.column("letters").to_pylist()
                raw = [t if ok else None for t, ok in zip(part.column("text").cast(pa.binary()).to_pylist(), letters)]
                names, scores = ["und"] * len(raw), [0.0] * len(raw)
                known = [i for i, t in enumerate(raw) if t and net]
                if known:
                    windows = [windows_of(raw[i]) for i in known]
                    counts = [len(w) for w in windows]
                    stacked = np.concatenate(windows)
                    logs = np.concatenate([net.predict(stacked[i:i + _WINDOWS_AT_ONCE], tables)
                                           for i in range(0, len(stacked), _WINDOWS_AT_ONCE)])
                    starts = np.cumsum([0, *counts[:-1]])
                    chance = _softmax(np.add.reduceat(logs, starts, axis=0) / np.array(counts)[:, None])
                    for i, c in zip(known, chance):
                        names[i], scores[i] = net.classes[int(c.argmax())], float(c.max())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names), pa.array(scores)],
                                                 names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(label, schema)
