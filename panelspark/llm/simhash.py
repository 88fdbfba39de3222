"""Near-duplicates by SimHash fingerprints: blocks shared by pigeonhole, exact Hamming distance, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import Stored
from panelspark.llm.tokens import slices

WORDS = 4
MAX_BITS = 4
SEED = 42
# A bucket above this many fingerprints is cut into finer blocks.
BUCKET_LIMIT = 4096
_HASHES_AT_ONCE = 1 << 16


# ---- fingerprints -----------------------------------------------------------------------

def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """64 bits, each set if over half the shingles' XXH64 have it; 0 without words."""
    from xxhash import xxh64_intdigest

    tokens = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(tokens))
    bounds = list(zip(starts[:len(tokens) - width + 1].tolist(), ends[width - 1:].tolist()))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(bounds), _HASHES_AT_ONCE):
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in bounds[i:i + _HASHES_AT_ONCE]], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(bounds), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, text_hash and fingerprint (its 64 bits as a signed long) of each row, a map over the texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def sign(batches):
        for batch in batches:
            for part in slices(batch):
                found = np.array([fingerprint(t, words) for t in part.column(2).cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found.view(np.int64))],
                                                 names=["doc_id", "text_hash", "fingerprint"])

    return rows.mapInArrow(sign, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fingerprint long")


# ---- links ------------------------------------------------------------------------------

def _cuts(bits: list[int], blocks: int) -> list[list[int]]:
    return [list(map(int, part)) for part in np.array_split(np.array(bits), blocks)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(fixed: int, blocks: int, max_bits: int) -> list[int]:
    """``fixed`` and some more blocks of the other bits: two values that differ in at most
    ``max_bits`` of these agree on all blocks but ``max_bits``, so under one mask at least."""
    free = [b for b in range(64) if not fixed >> b & 1]
    blocks = min(blocks, len(free))
    return [fixed | sum(1 << b for part in chosen for b in part)
            for chosen in combinations(_cuts(free, blocks), max(0, blocks - max_bits))]


def blocks_for(n: int, max_bits: int) -> int:
    """The fewest blocks whose shared part has more values than there are fingerprints."""
    blocks = max_bits + 2
    while 2 ** (64 * (blocks - max_bits) / blocks) < 4 * n and blocks < 16:
        blocks += 1
    return blocks


def _forest(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that connect what is linked in a bucket, at most one fewer than its fingerprints."""
    left, edges = prints, []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            node = frontier.pop()
            near = np.bitwise_count(left ^ node) <= max_bits
            if near.any():
                reached = left[near]
                edges += [(int(node), int(x)) for x in reached]
                frontier += list(reached)
                left = left[~near]
    return edges


def _linker(max_bits: int):
    small = 8

    def edges_of(bucket, prints):
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(np.append(cut, len(bucket)))
        size_of = np.repeat(sizes, sizes)
        a, b = [], []
        for shift in range(1, small):
            if len(prints) <= shift:
                break
            near = (bucket[shift:] == bucket[:-shift]) & (size_of[shift:] <= small)
            near &= np.bitwise_count(prints[shift:] ^ prints[:-shift]) <= max_bits
            a.append(prints[:-shift][near])
            b.append(prints[shift:][near])
        for at, size in zip(cut[sizes > small], sizes[sizes > small]):
            found = np.array(_forest(prints[at:at + size], max_bits), np.uint64).reshape(-1, 2)
            a.append(found[:, 0])
            b.append(found[:, 1])
        if not a:
            return None
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        low, high = np.minimum(a, b), np.maximum(a, b)
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["low", "high"])

    def link(batches):
        held = np.empty((0, 3), np.int64)
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("mask", "key", "fingerprint")], axis=1)
            rows = np.concatenate([held, rows])
            new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
            last = int(np.flatnonzero(new)[-1])  # the last bucket may go on
            held, bucket = rows[last:], np.cumsum(new)[:last]
            if last and (found := edges_of(bucket, rows[:last, 2].copy().view(np.uint64))) is not None:
                yield found
        if len(held) and (found := edges_of(np.zeros(len(held)), held[:, 2].copy().view(np.uint64))) is not None:
            yield found

    return link


def links(prints: DataFrame, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Pairs (low, high) of fingerprints that connect all that differ in at most ``max_bits`` bits.

    ``prints``: one column ``fingerprint``, distinct. Fingerprints are joined on the bits under each mask. Buckets
    above ``bucket_limit`` are cut by masks of more bits, again exact, at most twice: by then the
    bits left bound a bucket. A task compares one bucket at a time and returns a spanning
    forest of a large one, never all its pairs.
    """
    n = prints.count()
    levels = [masks(0, blocks_for(n, max_bits), max_bits)]
    spark = prints.sparkSession
    rows = None
    found, stored = [], []
    for level in range(3):
        table = spark.createDataFrame(
            [(i, m) for i, m in enumerate(map(_signed, levels[-1]))], "mask long, bits long")
        if rows is None:
            choice = F.array(*[F.struct(F.lit(i).alias("mask"), F.lit(_signed(m)).alias("bits")) for i, m in enumerate(levels[-1])])
            rows = prints.select("fingerprint", F.explode(choice).alias("m"))
            rows = rows.select(F.col("m.mask").cast("long").alias("mask"),
                               F.col("fingerprint").bitwiseAND(F.col("m.bits")).alias("key"), "fingerprint")
        else:
            rows = rows.join(F.broadcast(table.withColumnRenamed("mask", "finer").withColumn(
                "mask", F.floor(F.col("finer") / F.lit(len(levels[-1]) // len(levels[-2]))))), "mask")
            rows = rows.select(F.col("finer").alias("mask"), F.col("fingerprint").bitwiseAND(F.col("bits")).alias("key"), "fingerprint")
        if level < 2:
            crowded = Stored(rows.groupBy("mask", "key").count().where(F.col("count") > bucket_limit).drop("count"), "crowded")
            stored.append(crowded)
            any_crowded = bool(crowded.df.take(1))
        else:
            any_crowded = False
        fit = rows.join(crowded.df, ["mask", "key"], "left_anti") if any_crowded else rows
        found.append(fit.repartition("mask", "key").sortWithinPartitions("mask", "key", "fingerprint").mapInArrow(
            _linker(max_bits), "low long, high long"))
        if not any_crowded:
            break
        crowd = Stored(rows.join(crowded.df, ["mask", "key"], "left_semi"), "crowded_rows")
        stored.append(crowd)
        rows = crowd.df
        levels.append([finer for m in levels[-1] for finer in masks(m, 2 * max_bits, max_bits)])
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    out = Stored(out.distinct(), "links")
    for s in stored:
        s.delete()
    return out.df


# ---- components -------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node with an edge, roots left out.

    ``edges``: columns low and high, low < high. Each round hangs the larger neighbours of
    a node on its least one, then the smaller ones, until nothing changes; rounds grow with
    the logarithm of a component's length. Each round is written, so a lost executor costs
    one round; minima are written before they are joined, so that a node with many edges is split.
    """
    now = Stored(edges.select(F.col("high").alias("u"), F.col("low").alias("v")).distinct(), "stars")
    while True:
        before = _state(now.df)
        both = now.df.union(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = Stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        # Each edge once, from its smaller end: the larger end hangs on that end's least neighbour.
        hung = now.df.join(least.df.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")).distinct()
        large = Stored(hung, "large")
        down = Stored(large.df.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.df.join(down.df, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = Stored(small.union(down.df.select("u", F.col("m").alias("v"))).distinct(), "stars")
        done = _state(after.df) == before
        for s in (now, least, large, down):
            s.delete()
        now = after
        if done:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()


# ---- operator ---------------------------------------------------------------------------

def cluster(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
            max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, text_hash, fingerprint (16 hex digits) and component_id of every row.

    Fingerprints link at ``max_bits`` or fewer differing bits; component_id is the smallest doc_id that links
    reach. A null text, an empty one and one of white space have fingerprint zero, linked like any
    other. Null ids are rows of their own and no component's smallest id, unless all are null.
    Repeated rows stay. An empty table gives no rows. Other columns are not read.

    Equal fingerprints are merged before any pair is formed, so copies cost nothing further.
    """
    found = _rooted(docs, id_col, text_col, words, max_bits, bucket_limit)
    return found.drop("root").withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def _rooted(docs, id_col, text_col, words, max_bits, bucket_limit) -> DataFrame:
    """Every row with its component's least fingerprint and least id."""
    prints = Stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = Stored(prints.df.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    stars = components(links(nodes.df.select("fingerprint"), max_bits, bucket_limit))
    rooted = nodes.df.join(stars.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint"))
    rooted = Stored(rooted, "rooted")
    least = Stored(rooted.df.groupBy("root").agg(F.min("least").alias("component_id")), "component_ids")
    ids = Stored(rooted.df.join(least.df, "root").select("fingerprint", "root", "component_id"), "components")
    for s in (nodes, rooted, least):
        s.delete()
    return prints.df.join(ids.df, "fingerprint").select("doc_id", "text_hash", "fingerprint", "root", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
             max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, one of each component: that of the smallest id, then of the smallest
    text hash. Columns are those of ``docs``, whatever their names."""
    found = _rooted(docs, id_col, text_col, words, max_bits, BUCKET_LIMIT)
    first = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    first = Stored(first.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")).distinct(), "first").df
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    packed = packed.select("row", F.col(f"row.{id_col}").alias("id"), F.xxhash64(f"row.{text_col}").alias("hash"))
    kept = packed.join(first, packed["id"].eqNullSafe(first["_id"]) & (packed["hash"] == first["_hash"]), "left_semi")
    return kept.dropDuplicates(["id", "hash"]).select("row.*")
