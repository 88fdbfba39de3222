"""What each of five filters removes, in every order, with duplicates found in radix tries over whole texts."""

from __future__ import annotations

from bisect import bisect_right
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelspark.llm.tokens import slices

# Fixed values of the filters.
FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITAL_PERCENT = 10
SYMBOLS = b"#$%&*|"

# Prefixes, in code points, that a text may be placed by, and the share of all rows (or number, if more) from which
# one is crowded.
LEVELS = (4, 16, 64, 256, 1024)
MOST_PREFIXES = 4096
ROWS_PER_PREFIX = 100
LENGTH_PER_RANGE = 32 << 20
_CHUNK_BYTES = 16 << 20

_NOT_CAPITAL = bytes(set(range(256)) - set(range(65, 91)))
_NOT_SYMBOL = bytes(set(range(256)) - set(SYMBOLS))
_DUPLICATE = 1 << FILTERS.index("E")


# ---- tries ------------------------------------------------------------------------------

class Node:
    """A run of bytes, what follows it by first byte, and the rows and the place of the text that ends here."""

    __slots__ = ("run", "next", "least", "rows", "place")

    def __init__(self, run: bytes):
        self.run, self.next, self.least, self.rows, self.place = run, {}, None, None, None


def _common(run: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of ``run`` and ``text`` from ``at`` on."""
    low, high = 0, min(len(run), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if run[low:middle] == text[at + low:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Whole texts as paths; a terminal keeps the least id seen and the rows that have it."""

    def __init__(self):
        self.root = Node(b"")

    def terminal(self, text: bytes) -> Node:
        node, at = self.root, 0
        while at < len(text):
            below = node.next.get(text[at])
            if below is None:
                below = node.next[text[at]] = Node(text[at:])
            elif not text.startswith(below.run, at):
                k = _common(below.run, text, at)
                split = node.next[text[at]] = Node(below.run[:k])
                below.run = below.run[k:]
                split.next[below.run[0]] = below
                below = split
            node, at = below, at + len(below.run)
        return node

    def add(self, node: Node, doc_id, row, count: int) -> list | None:
        """Put a row at a terminal. The rows that turn out to have a smaller id's text: this one, or those
        that stood there before."""
        if node.rows is None or doc_id < node.least:
            before, node.least, node.rows = node.rows, doc_id, {row: count}
            return list(before.items()) if before else None
        if doc_id == node.least:
            node.rows[row] = node.rows.get(row, 0) + count
            return None
        return [(row, count)]

    def rows(self):
        """(text, place, row, count) of the least id of each text, by a walk over all paths."""
        stack = [(self.root, b"")]
        while stack:
            node, text = stack.pop()
            if node.rows:
                for row, count in node.rows.items():
                    yield text, node.place, row, count
            stack += [(below, text + below.run) for below in node.next.values()]


# ---- ranges -----------------------------------------------------------------------------

def _key(text: Column, crowded: dict[int, list[int]]) -> Column:
    """The shortest prefix of a text that is not crowded, as bytes; equal texts have equal keys.

    A text with a crowd of copies goes by its hash, since its copies merge before they move. One whose
    longest prefix is still crowded by different texts goes by that prefix and its hash.
    """
    digest = F.unhex(F.lpad(F.hex(F.xxhash64(text)), 16, "0"))
    key = F.lit(None).cast("binary")
    key = F.when(F.xxhash64(text).isin(crowded.get(0, [])), F.concat(F.lit(b"\xff"), digest)).otherwise(key)
    for n in LEVELS:
        prefix = F.substring(text, 1, n)
        key = F.coalesce(key, F.when(~F.xxhash64(prefix).isin(crowded.get(n, [])), prefix.cast("binary")))
    return F.coalesce(key, F.concat(F.substring(text, 1, LEVELS[-1]).cast("binary"), digest))


def plan_ranges(texts: DataFrame, rows_per_prefix: int, length_per_range: int) -> tuple[Column, list[bytes]]:
    """The key of column ``text``, and the least keys of the ranges in order.

    Rows are counted for each prefix of each length; only crowded ones reach the driver, at most
    MOST_PREFIXES of each length. Then Spark orders the distinct keys, each as often as its texts weigh, and
    the first key of each range is taken.
    """
    text = F.col("text")
    total, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    limit = max(rows_per_prefix, total // MOST_PREFIXES)
    levels = [F.when(F.length(text) > before, F.struct(
        F.lit(n).alias("level"), F.xxhash64(F.substring(text, 1, n) if n else text).alias("hash")))
        for n, before in zip((0, *LEVELS), (-1, -1, *LEVELS))]
    found = texts.select(F.explode(F.array_compact(F.array(*levels))).alias("p")).groupBy("p.level", "p.hash").count()
    crowded: dict[int, list[int]] = {}
    for r in found.where(F.col("count") > limit).collect():
        crowded.setdefault(r["level"], []).append(r["hash"])
    key = _key(text, crowded)
    n = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // length_per_range))
    weight = F.when(F.hex(F.substring("key", 1, 1)) == "FF", 1).otherwise(1 + F.floor(F.col("size") * (8 * n / max(1, size))))
    weighed = texts.select(key.alias("key"), F.length(text).alias("size")).groupBy("key").agg(F.sum("size").alias("size")).select(
        "key", F.explode(F.sequence(F.lit(1).cast("long"), weight.cast("long"))))
    first = weighed.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("at")).agg(F.min("key").alias("key"))
    return key, sorted({bytes(r["key"]) for r in first.collect()})


# ---- masks ------------------------------------------------------------------------------

def text_mask(raw: bytes, points: int) -> int:
    """Bits of the filters that a text fails by itself; bytes.split() splits at the same characters as the contract."""
    words = raw.split()
    n = len(words)
    capitals = len(raw.translate(None, _NOT_CAPITAL))
    return ((n < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * n) << 1
            | (100 * capitals > MOST_CAPITAL_PERCENT * points) << 2 | bool(raw.translate(None, _NOT_SYMBOL)) << 3)


def _batch(rows: list[tuple], schema: pa.Schema):
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
          rows_per_prefix: int = ROWS_PER_PREFIX, length_per_range: int = LENGTH_PER_RANGE) -> DataFrame:
    """doc_id, part, mask and n: rows by the filters they fail (bit i: the i-th of ABCDE), equal ones counted.

    E is found in tries over whole texts. A task first merges the copies among its own rows: all but the
    least id of a text are flagged there and move on without their text, so a text with any number of copies moves
    once from each chunk of rows. The others go, with whole texts, to the range of their key; a task holds one range.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key, bounds = plan_ranges(rows.select("text"), rows_per_prefix, length_per_range)
    ranges = max(1, len(bounds))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    keyed = rows.select("doc_id", "part", "text", F.length("text").alias("points"), key.alias("key"))
    sent = docs.sparkSession.sparkContext.broadcast(bounds)

    def local(batches):
        first, schema, out = sent.value, None, []
        trie, held, turn = Trie(), 0, 0

        def flush():
            nonlocal trie, held
            for raw, place, row, count in trie.rows():
                out.append((*row, count, raw, place))
            made = [_batch(out[i:i + 2000], schema) for i in range(0, len(out), 2000)]
            trie, held = Trie(), 0
            out.clear()
            return made

        for batch in batches:
            if schema is None:
                schema = pa.schema([batch.schema.field("doc_id"), ("part", pa.string()), ("mask", pa.int32()),
                                    ("n", pa.int64()), ("text", pa.binary()), ("range", pa.int32())])
            for part in slices(batch):
                columns = [part.column(c) for c in ("doc_id", "part", "text", "points", "key")]
                columns[2] = columns[2].cast(pa.binary())
                for doc_id, name, raw, points, k in zip(*[c.to_pylist() for c in columns]):
                    row = (doc_id, name, text_mask(raw, points))
                    turn += 1
                    if doc_id is None:
                        out.append((*row, 1, None, turn % ranges))
                        continue
                    node = trie.terminal(raw)
                    if node.place is None:
                        node.place = max(0, bisect_right(first, bytes(k)) - 1)
                        held += len(raw) + 300
                    for (a, b, mask), count in trie.add(node, doc_id, row, 1) or ():
                        out.append((a, b, mask | _DUPLICATE, count, None, turn % ranges))
                if held > _CHUNK_BYTES:
                    yield from flush()
        if schema is not None:
            yield from flush()

    moved = keyed.mapInArrow(local, f"doc_id {id_type}, part string, mask int, n bigint, text binary, range int")

    def whole(batches):
        trie, out, schema = Trie(), [], None
        for batch in batches:
            if schema is None:
                schema = pa.schema([batch.schema.field(c) for c in ("doc_id", "part", "mask", "n")])
            for doc_id, name, mask, count, raw in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "part", "mask", "n", "text")]):
                if raw is None:
                    out.append((doc_id, name, mask, count))
                else:
                    for (a, b, m), c in trie.add(trie.terminal(raw), doc_id, (doc_id, name, mask), count) or ():
                        out.append((a, b, m | _DUPLICATE, c))
            if len(out) > 10_000:
                yield _batch(out, schema)
                out = []
        if schema is not None:
            yield _batch(out + [(*row, count) for _, _, row, count in trie.rows()], schema)

    return moved.repartitionById(ranges, F.col("range")).mapInArrow(whole, f"doc_id {id_type}, part string, mask int, n bigint")


# ---- orders -----------------------------------------------------------------------------

def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


def summarize(found: DataFrame) -> DataFrame:
    """One row per part, order and step from part, mask, good, toxic and n.

    The rows that reach this are at most 128 for each part. A row that fails m filters is removed by each of
    them in 120 / m orders: that is its share of ``shapley``.
    """
    steps = []
    for order in orders():
        before = 0
        for i, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            steps.append(f"{order},{i + 1},{bit},{before}")
            before |= bit
    # One literal, read once: 600 structs would make a plan of thousands of nodes.
    each = found.select("part", "mask", "good", "toxic", "n", F.explode(F.split(F.lit(";".join(steps)), ";")).alias("s"))
    each = each.withColumn("s", F.split("s", ","))
    each = each.select("part", "mask", "good", "toxic", "n", F.col("s")[0].alias("filter_order"), F.col("s")[1].cast("int").alias("step"),
                       F.col("s")[2].cast("int").alias("bit"), F.col("s")[3].cast("int").alias("before"))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    count = lambda c, v=F.col("n"): F.sum(F.when(c, v).otherwise(F.lit(0).cast("long")))
    share = F.col("n") * F.when(F.col("mask") != 0, F.lit(120) / F.bit_count("mask")).otherwise(0).cast("long")
    return each.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"), count(fails & ~gone & F.col("good")).alias("good_lost"),
        count(fails & ~gone & F.col("toxic")).alias("toxic_lost"), count(fails, share).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """What each filter does at each step of each of the 120 orders, per part.

    A null text is empty, a null part the empty string. A null id is nobody's copy and has no label; rows that
    share the least id of a text all pass E. Of several labels of an id, one that says good (or toxic) is enough. Empty documents
    give no rows; empty labels lose nobody. Other columns are not read. Options as for ``masks``.
    """
    found = masks(docs, **columns)
    truth = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    counted = found.join(truth, "doc_id", "left").groupBy("part", "mask", flag("good"), flag("toxic")).agg(F.sum("n").alias("n"))
    return summarize(counted)
