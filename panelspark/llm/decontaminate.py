"""Benchmark passages in documents: q-grams counted in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import Stored
from panelspark.llm.tokens import grouped

Q = 8
# Edits allowed for an item: this share of its characters, as far as the lemma can bear.
EDIT_SHARE = 0.08
ITEMS_PER_BLOCK = 20_000
LENGTH_PER_BLOCK = 16 << 20
# Of a longer item, each window of PART characters, one every PART_STEP, is searched for by itself too.
PART = 100
PART_STEP = 50
_TABLE_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CELLS_AT_ONCE = 1_000_000
_CHARS_AT_ONCE = 1 << 20
_HITS_AT_ONCE = 1_000_000
_STRETCH = 101


def _tables():
    """For code points below 65,536: lower case, and whether letter or digit."""
    points = [chr(i) for i in range(65_536)]
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(points)], np.uint32)
    return lower, np.array([c.isalnum() for c in points])


class Texts:
    """Normal forms of several texts, one after the other: lower-cased letters and digits, one space for
    anything between, none at the ends. ``at``: each character's place in its own text."""

    def __init__(self, texts: list[str], tables):
        lower, alnum = tables
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        first = np.cumsum(sizes) - sizes
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        small = np.minimum(points, 65_535)
        word = alnum[small] | (points > 65_535)
        keep = word.copy()
        keep[1:] |= word[:-1]  # the first of each run of others
        at = np.flatnonzero(keep)
        word = word[at]
        self.points = np.where(word, lower[small[at]], 32).astype(np.uint32)
        high = points[at] > 65_535
        self.points[high] = points[at][high]
        self.start = np.searchsorted(at, first)
        self.stop = np.append(self.start[1:], len(at))
        full = self.stop > self.start
        self.start[full] += ~word[self.start[full]]
        full = self.stop > self.start
        self.stop[full] -= ~word[self.stop[full] - 1]
        self.at = at
        self.first = first

    def of(self, places: np.ndarray) -> np.ndarray:
        """The text that each place of the normal forms belongs to."""
        return np.searchsorted(self.start, places, side="right") - 1


def grams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q characters from each place."""
    with np.errstate(over="ignore"):
        h = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        width, power, out, done = 1, _BASE, None, 0
        while True:  # doubling: hashes of width w from those of w / 2
            if q & width:
                out = h if out is None else out[:len(out) - width] * power + h[done:][:len(out) - width]
                done += width
            if width * 2 > q:
                break
            h = h[:-width] * power + h[width:] if len(h) > width else h[:0]
            power = power * power
            width *= 2
        return out[:max(0, len(points) - q + 1)]


def edit_budget(length: int, q: int = Q, share: float = EDIT_SHARE) -> int:
    """Edits for an item of so many characters, such that the lemma still asks for a q-gram."""
    return max(0, min(int(share * length), (length - q) // q))


class Items:
    """A block of items: normal forms, budgets, and the sorted q-grams with their places."""

    def __init__(self, rows: list[tuple], tables, q: int, share: float):
        texts = Texts([text or "" for _, text in rows], tables)
        self._fill([(key, texts.points[a:b]) for (key, _), a, b in zip(rows, texts.start, texts.stop) if b - a >= q], q, share)

    def parts(self, share: float) -> Items:
        """Overlapping windows of the items that are longer than one, each an item of its own."""
        out = Items.__new__(Items)
        found = []
        for key, p in zip(self.keys, self.points):
            if len(p) > PART:
                starts = sorted({*range(0, len(p) - PART, PART_STEP), len(p) - PART})
                found += [(key, p[a:a + PART]) for a in starts]
        out._fill(found, self.q, share)
        return out

    def _fill(self, kept: list[tuple], q: int, share: float):
        self.q = q
        self.keys, self.points = [k for k, _ in kept], [p for _, p in kept]
        self.length = np.array([len(p) for p in self.points], np.int64)
        self.edits = np.array([edit_budget(int(n), q, share) for n in self.length], np.int64)
        hashes = [grams(p, q) for p in self.points]
        joined = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(joined, kind="stable")
        self.gram, self.item, self.place = joined[order], item[order], place[order]
        ends = np.searchsorted(self.gram, self.gram, "right")
        self.copies = ends - np.arange(len(ends))  # from the first of equal ones, how many
        self.present = np.zeros(1 << _TABLE_BITS, bool)
        self.present[(self.gram >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        # What the lemma leaves to any match: so many q-grams within _STRETCH places (of a longer item the share of one of the
        # stretches that cover it), and the places that a match may span.
        need, span = self.length - q + 1 - q * self.edits, self.length - q + 1 + self.edits
        self.dense = int((-(-need // -(-span // _STRETCH))).min()) if len(need) else 1
        self.span = int(span.max()) if len(span) else 0


def shared(texts: Texts, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Places in the texts of q-grams that some item has, and their hashes."""
    hashes = grams(texts.points, items.q)
    at = np.flatnonzero(items.present[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
    low = np.searchsorted(items.gram, hashes[at], "left")
    low[low == len(items.gram)] = 0
    real = items.gram[low] == hashes[at] if len(items.gram) else np.zeros(len(at), bool)
    at = at[real]
    at = at[at + items.q <= texts.stop[texts.of(at)]] if len(at) else at
    return at, hashes[at]


def crowded(at: np.ndarray, items: Items) -> np.ndarray:
    """Which of the ascending places are no further than a match from a stretch with as many as any match must have."""
    k = items.dense
    if k <= 1 or len(at) < k:
        return np.full(len(at), k <= 1)
    first = np.flatnonzero(at[k - 1:] - at[:len(at) - k + 1] < _STRETCH)
    near = np.zeros(len(at) + 1, np.int64)
    np.add.at(near, np.searchsorted(at, at[first] - items.span), 1)
    np.add.at(near, np.searchsorted(at, at[first + k - 1] + items.span, "right"), -1)
    return np.cumsum(near)[:-1] > 0


def candidates(texts: Texts, items: Items, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, lowest diagonal) of bands that hold as many shared q-grams as the lemma asks for.

    A match with e edits keeps n - q + 1 - q * e q-grams of an item of n characters, all on diagonals no
    more than e from where it starts. Bands are 2 (e + 1) wide and begin every e + 1, so the e + 1
    diagonals that any match meets lie within one. Diagonals count from the start of the text. Where a q-gram
    repeats in text and item, hits grow with the square: they are made and counted _HITS_AT_ONCE at a time, so only the counts of bands are held.
    """
    empty = np.empty(0, np.int64)
    kept = crowded(at, items)
    at, hashes = at[kept], hashes[kept]
    if not len(at) or not len(items.gram):
        return empty, empty, empty
    low = np.searchsorted(items.gram, hashes, "left")
    low[low == len(items.gram)] = 0
    real = items.gram[low] == hashes
    at, low = at[real], low[real]
    text, copies = texts.of(at), items.copies[low]
    # Keys of bands and how many hits each has, of the pieces so far.
    keys, n = empty, empty
    piece = np.cumsum(copies) // _HITS_AT_ONCE
    for a, b in zip(*(lambda cut: (cut[:-1], cut[1:]))(np.flatnonzero(np.diff(piece, prepend=-1, append=-1)).tolist())):
        count = copies[a:b]
        found = np.repeat(low[a:b], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = items.item[found]
        diagonal = np.repeat(at[a:b] - texts.start[text[a:b]], count) - items.place[found]
        # A hit counts for the two bands that cover its diagonal; text and item take the high bits of a key.
        owner = (np.repeat(text[a:b], count) * len(items.keys) + item) << 36
        band = diagonal // (items.edits[item] + 1) + (1 << 35)
        some, times = np.unique(np.concatenate([owner + band, owner + band - 1]), return_counts=True)
        keys, of = np.unique(np.concatenate([keys, some]), return_inverse=True)
        n = np.bincount(of, np.concatenate([n, times]), len(keys)).astype(np.int64)
    item = (keys >> 36) % len(items.keys)
    enough = n >= items.length[item] - items.q + 1 - items.q * items.edits[item]
    keys, item = keys[enough], item[enough]
    band = (keys & ((1 << 36) - 1)) - (1 << 35)
    return (keys >> 36) // len(items.keys), item, band * (items.edits[item] + 1)


def align(texts: Texts, items: Items, text: np.ndarray, item: np.ndarray, diagonal: np.ndarray):
    """Least edits of each item within its band of its text, and where in the text that match starts and ends.

    Rows are the item's characters, columns the band's diagonals; a match may start at any. Candidates of all texts with
    like budgets advance together, in bands of the widest.
    """
    best = np.full(len(item), 1 << 20, np.int64)
    first, last = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
    far = np.int32(1 << 20)
    like = np.ceil(np.log2(items.edits[item] + 1)).astype(int)
    for group in np.unique(like):
        every = np.flatnonzero(like == group)
        every = every[np.argsort(items.length[item[every]], kind="stable")]
        e = int(items.edits[item[every]].max())
        width = 4 * e + 3  # the band, and e to either side for a path that leaves its start
        steps = np.arange(width, dtype=np.int32)[None, :]
        per = max(1, _CELLS_AT_ONCE // width)
        for some in (every[i:i + per] for i in range(0, len(every), per)):
            length = items.length[item[some]]
            letters = np.zeros((len(some), int(length.max())), np.uint32)
            for i, k in enumerate(item[some]):
                letters[i, :len(items.points[k])] = items.points[k]
            begin = texts.start[text[some]][:, None]
            size = texts.stop[text[some]][:, None] - begin
            base = diagonal[some][:, None] - e + np.arange(width)[None, :]
            cost = np.where((base >= 0) & (base <= size), 0, far).astype(np.int32)
            start = base.astype(np.int32)
            wall = np.full((len(some), 1), far, np.int32)
            for row in range(letters.shape[1]):
                live = int(np.searchsorted(length, row, "right"))  # candidates before are done: they are in order of length
                where = base[live:] + row  # the document character this row may take
                inside = (where >= 0) & (where < size[live:])
                same = texts.points[np.where(inside, begin[live:] + where, 0)] == letters[live:, row:row + 1]
                old, begun = cost[live:], start[live:]
                taken = np.where(inside, old + ~same, far)
                skip = np.concatenate([old[:, 1:] + 1, wall[live:]], axis=1)  # item character dropped
                skip_start = np.concatenate([begun[:, 1:], begun[:, -1:]], axis=1)
                new = np.minimum(taken, skip)
                new_start = np.where(taken <= skip, begun, skip_start)
                # Document characters added: running least of cost - column, then the column back.
                flat = new - steps
                least = np.minimum.accumulate(flat, axis=1)
                source = np.maximum.accumulate(np.where(flat == least, steps, 0), axis=1)
                cost[live:], start[live:] = least + steps, np.take_along_axis(new_start, source, axis=1)
            stop = base + length[:, None]
            cost = np.where((stop >= 0) & (stop <= size), cost, far)
            column = cost.argmin(axis=1)
            row = np.arange(len(some))
            best[some], first[some], last[some] = cost[row, column], start[row, column], stop[row, column]
    return best, first, last


def _aligned(normal: Texts, items: Items, at: np.ndarray, hashes: np.ndarray, known=frozenset()):
    """(text number, {(item key, start, stop): edits}) of the candidates that align, in code points; not of (text number, key)
    that are ``known``."""
    text, item, diagonal = candidates(normal, items, at, hashes)
    if known:
        new = np.array([(t, items.keys[i]) not in known for t, i in zip(text.tolist(), item.tolist())], bool)
        text, item, diagonal = text[new], item[new], diagonal[new]
    edits, first, last = align(normal, items, text, item, diagonal)
    good = (edits <= items.edits[item]) & (last > first)
    found: dict[int, dict[tuple, int]] = {}
    for t, k, e, i, j in zip(*(x[good].tolist() for x in (text, item, edits, first, last))):
        place = normal.at[normal.start[t]:normal.stop[t]] - normal.first[t]
        span = (items.keys[k], int(place[i]), int(place[j - 1]) + 1)
        mine = found.setdefault(t, {})
        mine[span] = min(e, mine.get(span, e))
    yield from found.items()


def _apart(found: dict[tuple, int]) -> dict[object, list]:
    """Bands overlap: of matches of one item that share text, the one with fewest edits stays."""
    kept: dict[object, dict[int, tuple]] = {}
    starts: dict[object, list[int]] = {}
    for (key, i, j), e in sorted(found.items(), key=lambda x: (x[1], x[0][1:])):
        mine, order = kept.setdefault(key, {}), starts.setdefault(key, [])
        at = bisect_left(order, i)
        if (at == len(order) or order[at] >= j) and (not at or mine[order[at - 1]][1] <= i):
            mine[i] = (i, j, e)
            order.insert(at, i)
    return {key: [mine[i] for i in starts[key]] for key, mine in kept.items()}


def matches(texts: list[str | None], items: Items, tables, parts: Items | None = None) -> list[tuple]:
    """(text number, item key, start, stop, edits, whole) of each item in the texts, in code points.

    With ``parts``, an item that is not in a text as a whole, but some of its windows are, is there too, once for each stretch of
    windows that overlap, with the edits of its worst window.
    """
    if not items.keys:
        return []
    normal = Texts([t or "" for t in texts], tables)
    at, hashes = shared(normal, items)
    whole = {t: _apart(found) for t, found in _aligned(normal, items, at, hashes)}
    out = [(t, key, *span, True) for t, kept in whole.items() for key, spans in kept.items() for span in spans]
    known = {(t, key) for t, kept in whole.items() for key in kept}
    for t, found in _aligned(normal, parts, at, hashes, known) if parts is not None else ():
        stretches: dict[object, list[list]] = {}
        for (key, i, j), e in sorted(found.items(), key=lambda x: x[0][1:]):
            mine = stretches.setdefault(key, [])
            if mine and i < mine[-1][1]:
                mine[-1] = [mine[-1][0], max(j, mine[-1][1]), max(e, mine[-1][2])]
            else:
                mine.append([i, j, e])
        out += [(t, key, *span, False) for key, spans in stretches.items() for span in spans]
    return sorted(out, key=lambda x: (x[0], x[2], x[3]))


def _texts(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_id, text and key, which is the text's hash."""
    return benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key")).where(
        F.col("text").isNotNull())


def _blocks(items: DataFrame, per_block: int):
    """Each distinct text once, in blocks of bounded number and summed length, each read to the driver and sent out by
    itself."""
    texts = items.groupBy("key").agg(F.first("text").alias("text"))
    count, length = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n_blocks = max(1, -(-count // per_block), -(-length // LENGTH_PER_BLOCK))
    for i in range(n_blocks):
        yield [tuple(r) for r in texts.where(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == i).collect()]


def find(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", q: int = Q, edit_share: float = EDIT_SHARE, per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """doc_id, text_hash, item_id, start, stop, edits, whole: where documents hold an item of the benchmark.

    Texts are compared without case, signs and white space. An item matches where the whole of it aligns with at
    most ``edit_share`` of its characters edited (fewer where the q-gram lemma would ask for nothing). Of one longer than PART
    characters, each window of that length is searched for likewise in texts without the whole of it, so a part that holds a window is found
    (``whole`` is false). Items shorter than ``q`` and null texts match nothing; null ids, repeated documents and items of
    equal text stay as they are, repeated items count once; empty tables give no rows. Other columns are not read.

    The benchmark is the query set: its distinct texts go out in blocks of about ``per_block`` texts and
    LENGTH_PER_BLOCK characters, each a map over all documents, so no document moves and memory is bounded. Ids of items
    are joined to what was found.
    """
    items = _texts(benchmark, item_col, item_text_col)
    found = _find(docs, items, id_col, text_col, q, edit_share, per_block)
    named = items.select("key", "item_id").distinct().withColumnRenamed("key", "_key")
    return found.join(named, found["key"] == named["_key"]).select("doc_id", "text_hash", "item_id", "start", "stop", "edits", "whole")


def _find(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, q: int, edit_share: float, per_block: int) -> DataFrame:
    """As ``find``, with the key of the item's text for its id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, text_hash long, key long, start long, stop long, edits long, whole boolean"
    out = None
    for block in _blocks(items, per_block):
        sent = spark.sparkContext.broadcast(block)

        def search(batches, sent=sent):
            tables = _tables()
            whole = Items(sent.value, tables, q, edit_share)
            windows = whole.parts(edit_share)
            for batch in batches:
                for part, texts in grouped(batch, "text", _CHARS_AT_ONCE):
                    found = matches(texts, whole, tables, windows)
                    if found:
                        of, *columns, all_of = zip(*found)
                        of = pa.array(of)
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(of), part.column("text_hash").take(of), *(pa.array(c, pa.int64()) for c in columns),
                             pa.array(all_of)], names=["doc_id", "text_hash", "key", "start", "stop", "edits", "whole"])

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item and no window of one; columns are those of ``docs``."""
    settings = {"q": Q, "edit_share": EDIT_SHARE, "per_block": ITEMS_PER_BLOCK, "item_col": "item_id", "item_text_col": "text"} | options
    items = _texts(benchmark, settings.pop("item_col"), settings.pop("item_text_col"))
    found = _find(docs, items, id_col, text_col, **settings)
    hit = Stored(found.select("text_hash").distinct().withColumnRenamed("text_hash", "_hit"), "contaminated").df
    # Equal texts share a fate, so the text's hash is the key; one of 64 bits.
    return docs.join(hit, F.xxhash64(docs[text_col]) == hit["_hit"], "left_anti")
