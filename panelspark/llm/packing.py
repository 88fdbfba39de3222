"""Packing of token sequences: shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from panelspark.llm.tokens import WordEncoder, crc32, slices
from panelspark.session import materialize

CAPACITY = 4096


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns (how often, lengths longest first) that hold every length exactly as often as counted.

    Lengths are placed longest first, each into the pattern with the most room; a pattern used
    only in part is split. Where nothing has room, new packs take as many copies as fit. The
    work and the number of patterns depend on ``capacity``, not on the number of documents.
    """
    open_by_room: dict[int, list] = defaultdict(list)
    rooms: list[int] = []  # negated, so the most room comes first
    done = []

    def put(room, times, lengths):
        if not times:
            return
        if room == 0:
            done.append((times, lengths))
            return
        if not open_by_room[room]:
            heapq.heappush(rooms, -room)
        open_by_room[room].append((times, lengths))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            while rooms and not open_by_room[-rooms[0]]:
                heapq.heappop(rooms)
            if not rooms or -rooms[0] < length:
                copies = capacity // length
                put(capacity - copies * length, left // copies, [length] * copies)
                put(capacity - (left % copies) * length, int(left % copies > 0), [length] * (left % copies))
                break
            room = -rooms[0]
            times, lengths = open_by_room[room].pop()
            used = min(times, left)
            put(room, times - used, lengths)
            put(room - length, used, [*lengths, length])
            left -= used
    for room in open_by_room.values():
        done += room
    return done


def places(patterns: list[tuple[int, list[int]]], capacity: int) -> np.ndarray:
    """One row per pattern and length in it: which ranks of that length go where.

    Columns: length, first rank, first sequence, offset, copies in a sequence, padded length.
    """
    rows, rank, sequence = [], defaultdict(int), 0
    for times, lengths in patterns:
        total = sum(lengths)
        padded = total if total & (total - 1) == 0 else capacity
        offset = i = 0
        while i < len(lengths):
            copies = 1
            while i + copies < len(lengths) and lengths[i + copies] == lengths[i]:
                copies += 1
            rows.append((lengths[i], rank[lengths[i]], sequence, offset, copies, padded))
            rank[lengths[i]] += times * copies
            offset += copies * lengths[i]
            i += copies
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def _cutter(path: str, capacity: int, end_id: int, keep_ids: bool, id_type: pa.DataType):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank_in_part"]
    types = [id_type] + [pa.int64()] * 6
    schema = pa.schema(list(zip(names, types)) + ([("ids", pa.list_(pa.int32()))] if keep_ids else []))
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        from pyspark import TaskContext

        encoder = WordEncoder.of_worker(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for rows in slices(batch):
                out = []
                for key, raw in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1).to_pylist())):
                    raw += end
                    total = len(raw) // 4
                    for start in range(0, total, capacity):
                        piece = raw[4 * start:4 * (start + capacity)]
                        n = len(piece) // 4
                        row = (key, start, n, crc32(piece), total, part, int(seen[n]))
                        seen[n] += 1
                        out.append(row + (np.frombuffer(piece, "<u4").astype(np.int32),) if keep_ids else row)
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        encoder.forget()

    return cut


def _placer(table, schema_names):
    """Looks up each piece's sequence and offset from its length and rank."""

    def place(batches):
        slots = table.value
        keys = slots[:, 0] << 44 | slots[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = slots[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            nth = rank - at[:, 1]
            found = {"sequence_id": at[:, 2] + nth // at[:, 4], "offset": at[:, 3] + length * (nth % at[:, 4]),
                     "padded_length": at[:, 5]}
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[n]) if n in found else batch.column(n) for n in schema_names], names=schema_names)

    return place


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Sequences of at most ``capacity`` tokens, from whole documents and their end id.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    padded_length (of its sequence: the tokens themselves at a power of two, else ``capacity``)
    and, on request, ids. A document longer than ``capacity`` is cut there; its rest is packed
    like a whole one. A null or empty text is the end id alone; null, equal and repeated ids
    are documents of their own; an empty table gives no rows. Columns other than the two named
    are not read. ``tokenizer`` is a path that every executor can open.

    Spark numbers the pieces of equal length (a count per task, then running sums of counts),
    so a length that many documents share is never gathered. Only the histogram, at most
    ``capacity`` rows, comes to the driver, and the table of places, bounded likewise, goes back.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_field = rows.schema["doc_id"]
    fields = [T.StructField("doc_id", id_field.dataType)] + [
        T.StructField(n, T.LongType()) for n in
        ("start", "length", "ids_crc32", "doc_tokens", "part", "rank_in_part")]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    from pyspark.sql.pandas.types import to_arrow_type

    cut = _cutter(tokenizer, capacity, end_id, keep_ids, to_arrow_type(id_field.dataType))
    pieces = materialize(rows.mapInArrow(cut, T.StructType(fields)), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")
    counts = materialize(counts.select("length", "part", "n", before.alias("before")), "piece_counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(pack_histogram(histogram, capacity), capacity))
    ranked = pieces.join(counts.drop("n").hint("merge"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("rank_in_part"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + (["ids"] if keep_ids else [])
    out = T.StructType([f for n in names for f in fields if f.name == n] + [
        T.StructField(n, T.LongType()) for n in ("sequence_id", "offset", "padded_length")])
    return ranked.select(*names, "rank").mapInArrow(_placer(table, out.names), out)
