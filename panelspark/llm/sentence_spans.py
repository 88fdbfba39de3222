"""Repeated passages: every run of consecutive sentences is hashed and joined globally; only its first place keeps it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import Stored
from panelspark.llm.tokens import slices

SENTENCES = 2
WORDS = 12
# A sentence of so many words or more is cut after the least word hash of each so many words in a row.
CUT_WINDOW = 12
# A passage reaches past its last whole run by a part of a sentence and less than a run at most.
_CONTEXT = WORDS + CUT_WINDOW

_SPACE = np.array([chr(i).isspace() for i in range(0x3002)])
_STOPS = np.array([ord(c) for c in ".!?"])
_CLOSERS = np.array([ord(c) for c in "\"')]»”’"])
# What a task holds at once: texts being split, and a row group of a table between two stages.
_CHARS_AT_ONCE = 1 << 18
_ROW_GROUP = {"parquet.block.size": 4 << 20}
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _blank(points: np.ndarray) -> np.ndarray:
    return _SPACE[np.minimum(points, len(_SPACE) - 1)]


class Split:
    """Words and sentences of several texts at once; all positions count over the texts in order.

    A sentence ends after . ! ? (and closing marks) before white space, or at a line end. One of CUT_WINDOW words
    or more is cut after the word of least hash of each CUT_WINDOW words in a row (winnowing): cuts depend on nearby words
    only, so equal passages are cut alike, and no piece is longer. Words are compared lower-cased.
    """

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        first = np.cumsum(sizes) - sizes
        points = _points(joined)
        lowered = joined.lower()
        if len(lowered) != len(joined):
            lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in joined)
        blank = _blank(points)
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        self.begin, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        # The words of text i are those from word_from[i] on; the same for sentences.
        self.word_from = np.searchsorted(self.begin, np.append(first, len(points) + 1))
        self.first = first
        self.hash = self._hashes(_points(lowered), blank)
        n = len(self.begin)
        begins = self._ends(points)
        if n >= CUT_WINDOW:
            of = np.cumsum(begins)
            windows = np.lib.stride_tricks.sliding_window_view(self.hash, CUT_WINDOW)
            inside = np.flatnonzero(of[CUT_WINDOW - 1:] == of[:n - CUT_WINDOW + 1])
            after = inside + windows[inside].argmin(axis=1) + 1
            begins[after[after < n]] = True
        self.sentence = np.flatnonzero(begins)
        self.sentence_from = np.searchsorted(self.sentence, self.word_from)

    def _hashes(self, points: np.ndarray, blank: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word: the sum of its letters, each mixed with its place in the word."""
        at = np.flatnonzero(~blank)
        if not len(at):
            return np.empty(0, np.uint64)
        length = self.end - self.begin
        starts = np.cumsum(length) - length
        place = np.arange(len(at), dtype=np.uint64) - np.repeat(starts, length).astype(np.uint64)
        return _mix(np.add.reduceat(_mix(points[at].astype(np.uint64) | (place + np.uint64(1)) << np.uint64(32)), starts))

    def _ends(self, points: np.ndarray) -> np.ndarray:
        """Whether a sentence begins at each word."""
        n = len(self.begin)
        if not n:
            return np.zeros(0, bool)
        lines = np.cumsum(points == 10)
        begins = np.concatenate([[True], lines[self.begin[1:]] != lines[self.end[:-1] - 1]])
        last = self.end - 1
        live = np.flatnonzero(np.isin(points[last], _CLOSERS))
        while len(live):
            last[live] -= 1
            live = live[last[live] >= self.begin[live]]
            live = live[np.isin(points[last[live]], _CLOSERS)]
        stop = (last >= self.begin) & np.isin(points[np.maximum(last, 0)], _STOPS)
        begins[1:] |= stop[:-1]
        return begins

    def runs(self, least_sentences: int, least_words: int):
        """(text, first word, word after the last, hash) of the shortest run of so many sentences and words
        from each sentence. A run's hash comes from prefix sums over the hashes of words."""
        total = np.append(self.sentence, len(self.begin))
        count = len(self.sentence)
        text = np.repeat(np.arange(len(self.sentence_from) - 1), np.diff(self.sentence_from))
        stop = np.maximum(np.searchsorted(total, self.sentence + least_words), np.arange(count) + least_sentences)
        good = np.flatnonzero(stop <= self.sentence_from[text + 1])
        a, b = self.sentence[good], total[stop[good]]
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(self.begin), _BASE)]))
            back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(self.begin), _INVERSE)]))
            prefix = np.concatenate([[np.uint64(0)], np.cumsum(self.hash * power[:-1])])
            h = _mix((prefix[b] - prefix[a]) * back[a] + (b - a).astype(np.uint64))
        return text[good], a, b, h


def _groups(texts: list[str | None]):
    """Slices of a list of texts of about _CHARS_AT_ONCE characters, null as empty."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _CHARS_AT_ONCE or i == len(texts) - 1:
            yield begin, [t or "" for t in texts[begin:i + 1]]
            begin, size = i + 1, 0


def _spans(rows: DataFrame, least_sentences: int, least_words: int) -> DataFrame:
    """hash, doc_id, text_hash, start and stop (words) of every run; and for each text a row without hash, whose
    stop is its number of sentences."""

    def hashed(batches):
        for batch in batches:
            for part in slices(batch):
                for at, texts in _groups(part.column("text").to_pylist()):
                    split = Split(texts)
                    text, a, b, h = split.runs(least_sentences, least_words)
                    base = split.word_from[text]
                    every = np.arange(len(texts))
                    of = pa.array(at + np.concatenate([text, every]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([h.view(np.int64), every]), mask=np.arange(len(of)) >= len(text)),
                         part.column("doc_id").take(of), part.column("text_hash").take(of),
                         pa.array(np.concatenate([a - base, every * 0 - 1]).astype(np.int32)),
                         pa.array(np.concatenate([b - base, np.diff(split.sentence_from)]).astype(np.int32))],
                        names=["hash", "doc_id", "text_hash", "start", "stop"])

    return rows.mapInArrow(hashed, f"hash long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, start int, stop int")


def _edges(later: DataFrame) -> DataFrame:
    """hash, n, side (0 left, 1 right), doc_id, text_hash and at: where a text's later runs, taken together,
    begin and end, and the run that does. A window over the runs of one text."""
    from pyspark.sql import Window as W

    before = W.partitionBy("doc_id", "text_hash").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("doc_id", "text_hash").orderBy("start").rowsBetween(1, 1)
    each = later.select("hash", "doc_id", "text_hash", "start", "stop").withColumns({
        "reached": F.max("stop").over(before), "next": F.min("start").over(after)})
    # stop rises with start, so a run is the last of its group if the next one begins after its end.
    left = F.when(F.col("reached").isNull() | (F.col("reached") < F.col("start")), F.struct(F.lit(0).alias("side"), F.col("start").alias("at")))
    right = F.when(F.col("next").isNull() | (F.col("next") > F.col("stop")), F.struct(F.lit(1).alias("side"), F.col("stop").alias("at")))
    found = each.select("hash", "doc_id", "text_hash", (F.col("stop") - F.col("start")).alias("n"), F.explode(F.array_compact(F.array(left, right))).alias("e"))
    return found.select("hash", "n", "doc_id", "text_hash", "e.side", "e.at").where((F.col("side") == 1) | (F.col("at") > 0))


def _contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text_hash, side, at and words: hashes of the words next to each place, the nearest first."""
    found = _by_text(rows, wanted.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("side", "at")).alias("places")), "inner", "places")

    def read(batches):
        for batch in batches:
            for part in slices(batch):
                places = part.column("places").to_pylist()
                for first, texts in _groups(part.column("text").to_pylist()):
                    split, out, of = Split(texts), [], []
                    for i in range(len(texts)):
                        words = split.hash[split.word_from[i]:split.word_from[i + 1]].view(np.int64)
                        for p in places[first + i]:
                            side, at = p["side"], p["at"]
                            near = words[at:at + _CONTEXT] if side else words[max(0, at - _CONTEXT):at][::-1]
                            out.append((side, at, near))
                            of.append(first + i)
                    of = pa.array(of, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(of), part.column("text_hash").take(of), pa.array([x[0] for x in out], pa.int32()),
                         pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.list_(pa.int64()))],
                        names=["doc_id", "text_hash", "side", "at", "words"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(read, f"doc_id {kind}, text_hash long, side int, at int, words array<long>")


def _few(df: DataFrame) -> DataFrame:
    """The side of a join with one short row for each key: hashed by partition, so that no task sorts the other side,
    whose texts or runs are many times as large."""
    return df.hint("shuffle_hash")


def _by_text(rows: DataFrame, places: DataFrame, how: str, *cols: str) -> DataFrame:
    """doc_id, text_hash, text and ``cols`` of the places of each text (one row of places for each)."""
    places = _few(Stored(places, "places", **_ROW_GROUP).df)
    same = (rows["text_hash"] == places["text_hash"]) & rows["doc_id"].eqNullSafe(places["doc_id"])
    return rows.join(places, same, how).select(rows["doc_id"], rows["text_hash"], "text", *cols)


_OUT = "doc_id {}, text string, n_sentences long, n_removed long, n_removed_words long, removed array<struct<start:bigint,stop:bigint>>"
_REMOVED = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _cut(text: str, ranges: list) -> tuple:
    """The text without these ranges of words; how many sentences lie in them whole, how many words go, and where."""
    split = Split([text])
    covered = np.zeros(len(split.begin) + 1, np.int64)
    for r in ranges:
        covered[r["start"]] += 1
        covered[r["stop"]] -= 1
    gone = np.cumsum(covered)[:-1] > 0
    whole = int(np.logical_and.reduceat(gone, split.sentence).sum())
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    kept, removed, at = [], [], 0
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        kept.append(text[at:int(split.begin[a])])
        removed.append({"start": int(split.begin[a]), "stop": int(split.end[b - 1])})
        # Up to the next word, so that no gap is left behind.
        at = int(split.begin[b]) if b < len(split.begin) else len(text)
    kept.append(text[at:])
    return "".join(kept).rstrip(), whole, int(gone.sum()), removed


def _cut_all(batches):
    for batch in batches:
        for part in slices(batch):
            out = [_cut(t, r) if r else (t, 0, 0, []) for t, r in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist())]
            text, n, words, removed = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(text, pa.string()), part.column("n_sentences"), pa.array(n, pa.int64()), pa.array(words, pa.int64()),
                 pa.array(removed, _REMOVED)], names=["doc_id", "text", "n_sentences", "n_removed", "n_removed_words", "removed"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_sentences: int = SENTENCES,
                   least_words: int = WORDS) -> DataFrame:
    """doc_id, text without repeated passages, n_sentences, n_removed (sentences that go whole), n_removed_words and
    removed (spans of the whole text).

    From each sentence, the shortest run of at least ``least_sentences`` sentences and ``least_words`` words is a span;
    words are compared without regard to case and white space. The first place of a span, by id (null last), text
    hash and position, keeps it; at all other places, in the same document too, its sentences go. Where
    such sentences end, the words beside them go as well as far as they equal those beside the first place: a passage that
    begins or ends within a sentence goes whole. Any 51 equal words hold a span. Rows equal in id and text count as one
    place. A null text stays null, an empty one empty, a very long one is a text like others; an empty table gives no rows. Other columns
    are not read.

    Runs are counted, map-side first; only places of repeated ones go on. A run that a third of all documents hold
    is split by adaptive execution: both sides of each join are plain scans. Texts without a repeat are
    split into words once. A task holds _CHARS_AT_ONCE characters as words, a row group of each table it reads or writes and
    its share of the repeated hashes, their first places, or the ranges of its texts; runs and texts pass by unsorted in these joins.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    spans = Stored(_spans(rows, least_sentences, least_words), "spans", **_ROW_GROUP)
    runs = spans.df.where(F.col("hash").isNotNull())
    repeated = Stored(runs.groupBy("hash").count().where(F.col("count") > 1).select("hash"), "repeated", **_ROW_GROUP)
    hits = Stored(runs.join(_few(repeated.df), "hash"), "hits", **_ROW_GROUP)
    repeated.delete()
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "start")
    first = Stored(hits.df.groupBy("hash").agg(F.min(place).alias("first")), "first_places", **_ROW_GROUP)
    later = Stored(hits.df.join(_few(first.df), "hash").where(place != F.col("first")).drop("first"), "later", **_ROW_GROUP)
    hits.delete()
    # A repeated row's runs stand twice among the later ones; that changes no edge.
    edges = _edges(later.df).distinct().join(first.df, "hash")
    there = F.col("first")["start"] + F.when(F.col("side") == 1, F.col("n")).otherwise(0)
    pairs = Stored(edges.select("doc_id", "text_hash", "side", "at", F.col("first")["doc_id"].alias("first_id"),
                                F.col("first")["text_hash"].alias("first_hash"), there.alias("first_at")), "pairs", **_ROW_GROUP)
    own = pairs.df.select("doc_id", "text_hash", "side", "at")
    theirs = pairs.df.select(F.col("first_id").alias("doc_id"), F.col("first_hash").alias("text_hash"), "side", F.col("first_at").alias("at"))
    near = Stored(_contexts(rows, own.unionByName(theirs).distinct()), "contexts", **_ROW_GROUP)
    grown = _grown(pairs.df, near.df)
    ranges = later.df.select("doc_id", "text_hash", "start", "stop").unionByName(grown).unionByName(
        spans.df.where(F.col("hash").isNull()).select("doc_id", "text_hash", "start", "stop"))
    of_text = ranges.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.when(F.col("start") >= 0, F.struct("start", "stop"))).alias("ranges"),
        F.max(F.when(F.col("start") < 0, F.col("stop"))).cast("long").alias("n_sentences"))
    both = _by_text(rows, of_text, "left", "ranges", "n_sentences").drop("text_hash")
    for s in (spans, first, later, pairs, near):
        s.delete()
    return both.mapInArrow(_cut_all, _OUT.format(docs.schema[id_col].dataType.simpleString()))


def _grown(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """doc_id, text_hash, start and stop of the words beside a run that equal those beside its first place."""
    mine = near.select(*[F.col(c).alias(f"m_{c}") for c in near.columns])
    theirs = near.select(*[F.col(c).alias(f"t_{c}") for c in near.columns])
    found = pairs.join(mine, (pairs["text_hash"] == F.col("m_text_hash")) & pairs["doc_id"].eqNullSafe(F.col("m_doc_id"))
                       & (pairs["side"] == F.col("m_side")) & (pairs["at"] == F.col("m_at")))
    found = found.join(theirs, (F.col("first_hash") == F.col("t_text_hash")) & F.col("first_id").eqNullSafe(F.col("t_doc_id"))
                       & (F.col("side") == F.col("t_side")) & (F.col("first_at") == F.col("t_at")))
    other = F.array_position(F.zip_with("m_words", "t_words", lambda a, b: a.eqNullSafe(b)), False)
    n = F.when(other > 0, other - 1).otherwise(F.size("m_words")).cast("int")
    at = F.col("at")
    return found.withColumn("n", n).where(F.col("n") > 0).select(
        "doc_id", "text_hash", F.when(F.col("side") == 1, at).otherwise(at - F.col("n")).alias("start"),
        F.when(F.col("side") == 1, at + F.col("n")).otherwise(at).alias("stop"))
