"""Token ids as raw binary shards, with a minimal perfect hash index of the documents.

Files below a folder that all executors share:

* ``shards/*.ids``: ids of the documents in ascending order of document id, nothing else; unsigned
  16-bit where the vocabulary allows it, else 32-bit, little-endian.
* ``index/*.mph``: for one bucket of keys, the bit vectors of a minimal perfect hash and one record
  per key at the key's number: fingerprint, shard, offset, number of ids.
* ``documents``, ``shard_table``, ``index_table`` (Parquet): keys in order, and which files count. A task
  that ran twice leaves a file that no table names.

A key is a document id and, among equal ids, its number from 0.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.llm.tokens import WordEncoder, crc32, slices

RECORD = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")])
KEYS_PER_BUCKET = 250_000
_GAMMA = 2.0
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _open(path: str):
    """File system and path of a shared location, whichever store it is in."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _child(folder: str, name: str):
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    return fs, f"{base}/{name}"


# ---- minimal perfect hash ---------------------------------------------------------------

def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Well spread 64 bits of a two-part key, other ones for each level."""
    with np.errstate(over="ignore"):
        x = a + b * np.uint64(2 * level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
        return x ^ (x >> np.uint64(31))


def build_mph(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Bit vectors, one a level: a key takes the first level where its place is its own.

    The keys must differ; a pair of 64-bit hashes stands for each.
    """
    if len(np.unique(np.stack([a, b], axis=1), axis=0)) < len(a):
        raise ValueError("keys must differ")
    levels, left = [], np.arange(len(a))
    while len(left):
        size = max(64, int(_GAMMA * len(left)) // 64 * 64 + 64)
        at = (_mix(a[left], b[left], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels


def with_ranks(levels: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each bit vector with the number of its set bits, from where the level before left off."""
    out, base = [], 0
    for bits in levels:
        ranks = np.cumsum(bits, dtype=np.uint32)
        out.append((bits, ranks + np.uint32(base) - np.uint32(1)))
        base += int(ranks[-1])
    return out


def mph_number(levels: list[tuple[np.ndarray, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of each key, from 0 without gaps; -1 where no level has a place for it."""
    number, left = np.full(len(a), -1, dtype=np.int64), np.arange(len(a))
    for level, (bits, ranks) in enumerate(levels):
        if not len(left):
            break
        at = (_mix(a[left], b[left], level) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        number[left[hit]] = ranks[at[hit]]
        left = left[~hit]
    return number


def _fingerprint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (_mix(b, a, 77) >> np.uint64(32)).astype(np.uint32)


# ---- writing ----------------------------------------------------------------------------

_DOCS = "doc_id {id}, nth long, shard long, offset long, n_tokens long, file string"


def _shard_writer(tokenizer: str, folder: str, end_id: int, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("nth", pa.int64()), ("shard", pa.int64()), ("offset", pa.int64()),
                        ("n_tokens", pa.int64()), ("file", pa.string())])

    def write(batches):
        from pyspark import TaskContext

        encoder = WordEncoder.of_worker(tokenizer)
        width = "<u2" if encoder.tokenizer.get_vocab_size() <= 65_536 else "<u4"
        shard = TaskContext.get().partitionId()
        name = f"{shard:06d}-{uuid.uuid4().hex}.ids"
        fs, path = _child(f"{folder}/shards", name)
        end, offset, nth, last = np.array([end_id], "<u4").tobytes(), 0, 0, ()
        with fs.open_output_stream(path) as sink:
            for batch in batches:
                for rows in slices(batch):
                    out = []
                    for key, raw in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1).to_pylist())):
                        raw += end
                        sink.write(np.frombuffer(raw, "<u4").astype(width).tobytes())
                        nth, last = (nth + 1, last) if last == (key,) else (0, (key,))
                        out.append((key, nth, shard, offset, len(raw) // 4, name))
                        offset += len(raw) // 4
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        encoder.forget()

    return write


def _index_writer(folder: str):
    def write(key, table):
        bucket = key[0].as_py()
        a, b = (table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("a", "b"))
        levels = build_mph(a, b)
        records = np.zeros(len(a), RECORD)
        at = mph_number(with_ranks(levels), a, b)
        for field, values in (("fingerprint", _fingerprint(a, b)), ("shard", table.column("shard").to_numpy()),
                              ("offset", table.column("offset").to_numpy()), ("n", table.column("n_tokens").to_numpy())):
            records[field][at] = values
        packed = [np.packbits(x) for x in levels]
        head = json.dumps({"keys": len(a), "levels": [len(x) for x in levels]}).encode()
        name = f"{bucket:06d}-{uuid.uuid4().hex}.mph"
        fs, path = _child(f"{folder}/index", name)
        with fs.open_output_stream(path) as sink:
            sink.write(np.array([len(head)], "<u8").tobytes() + head)
            for x in packed:
                sink.write(x.tobytes())
            sink.write(records.tobytes())
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "index_file": [name], "keys": pa.array([len(a)], pa.int64())})

    return write


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    """Two hashes of a key and its bucket. A null id is a key like any other."""
    text = F.concat_ws("#", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("nth").cast("string"))
    return keys.withColumns({"a": F.xxhash64(text, F.lit(1)), "b": F.xxhash64(text, F.lit(2))}).withColumn(
        "bucket", F.pmod(F.col("a"), F.lit(buckets)))


def write(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = 2) -> None:
    """Write all documents, ascending by id, each with its end id, and the index.

    Null ids come first; rows of equal id are ordered by text and numbered. A null or empty text
    is the end id alone. An empty table gives empty tables and no files. Only the two named
    columns are read. Rows move once, to their range of ids; equal ids may be split among
    ranges, so a repeated id is no burden. The driver sees one row per shard.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ranged = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = rows.schema["doc_id"].dataType
    shards = ranged.mapInArrow(_shard_writer(tokenizer, folder, end_id, to_arrow_type(id_type)),
                               _DOCS.format(id=id_type.simpleString()))
    shards.write.parquet(f"{folder}/written")
    written = spark.read.schema(_DOCS.format(id=id_type.simpleString())).parquet(f"{folder}/written")
    found = written.groupBy("shard", "file").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"),
        F.min_by("doc_id", "offset").alias("first_id"), F.max_by("doc_id", "offset").alias("last_id"),
        F.max_by("nth", "offset").alias("last_nth")).orderBy("shard").collect()
    start, carried, last, table = 0, 0, (), []
    for r in found:
        carry = carried if last == (r["first_id"],) else 0
        table.append((r["shard"], r["file"], start, r["n_docs"], r["n_tokens"], r["first_id"], carry))
        start += r["n_tokens"]
        same = r["first_id"] == r["last_id"]
        carried, last = r["last_nth"] + 1 + (carry if same else 0), (r["last_id"],)
    shard_schema = (f"shard long, file string, start long, n_docs long, n_tokens long, first_id {id_type.simpleString()}, carry long")
    spark.createDataFrame(table, shard_schema).coalesce(1).write.parquet(f"{folder}/shard_table")
    shard_table = spark.read.schema(shard_schema).parquet(f"{folder}/shard_table")
    carry = F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("carry")).otherwise(0)
    keyed = written.drop("file").join(shard_table.select("shard", "first_id", "carry"), "shard").select(
        "doc_id", (F.col("nth") + carry).alias("nth"), "shard", "offset", "n_tokens")
    keyed.select("doc_id", "nth").write.parquet(f"{folder}/documents")
    buckets = max(1, -(-sum(r["n_docs"] for r in found) // KEYS_PER_BUCKET))
    index = _hashed(keyed, buckets).groupBy("bucket").applyInArrow(
        _index_writer(folder), "bucket long, index_file string, keys long")
    index.write.parquet(f"{folder}/index_table")


# ---- reading ----------------------------------------------------------------------------

class Reader:
    """Keyed access to the files of a folder; holds the bit vectors of a few buckets."""

    def __init__(self, folder: str, index: dict[int, str], shards: dict[int, tuple[str, int]], width: str, keep: int = 4):
        self.folder, self.index, self.shards, self.width, self.keep = folder, index, shards, width, keep
        self.buckets: dict[int, tuple] = {}
        self.open: dict[int, object] = {}

    def _bucket(self, bucket: int):
        if bucket not in self.buckets:
            if len(self.buckets) >= self.keep:
                self.buckets.pop(next(iter(self.buckets)))
            fs, base = _open(f"{self.folder}/index")
            file = fs.open_input_file(f"{base}/{self.index[bucket]}")
            size = int(np.frombuffer(file.read_at(8, 0), "<u8")[0])
            head = json.loads(bytes(file.read_at(size, 8)))
            at, levels = 8 + size, []
            for n in head["levels"]:
                levels.append(np.unpackbits(np.frombuffer(file.read_at(n // 8, at), np.uint8)).astype(bool))
                at += n // 8
            self.buckets[bucket] = (with_ranks(levels), file, at)
        return self.buckets[bucket]

    def find(self, bucket: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Records of keys of one bucket, and which keys are there."""
        levels, file, at = self._bucket(bucket)
        number = mph_number(levels, a, b)
        found = np.zeros(len(a), RECORD)
        order = np.argsort(number)
        order = order[number[order] >= 0]
        if len(order):
            # Few keys: a read each. Many: the span that holds them.
            if len(order) < 64:
                for i in order:
                    found[i] = np.frombuffer(file.read_at(RECORD.itemsize, at + int(number[i]) * RECORD.itemsize), RECORD)[0]
            else:
                low, high = int(number[order[0]]), int(number[order[-1]])
                span = np.frombuffer(file.read_at((high - low + 1) * RECORD.itemsize, at + low * RECORD.itemsize), RECORD)
                found[order] = span[number[order] - low]
        return found, (number >= 0) & (found["fingerprint"] == _fingerprint(a, b))

    def ids(self, shard: int, offset: int, n: int) -> np.ndarray:
        if shard not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            fs, base = _open(f"{self.folder}/shards")
            self.open[shard] = fs.open_input_file(f"{base}/{self.shards[shard][0]}")
        size = np.dtype(self.width).itemsize
        return np.frombuffer(self.open[shard].read_at(n * size, offset * size), self.width)


def read_keys(keys: DataFrame, folder: str, tokenizer: str, *, keep_ids: bool = False) -> DataFrame:
    """Look up keys (doc_id, nth) and read their ids: one row per key that is there.

    Columns doc_id, nth, start (ids of all documents before it), n_tokens, ids_crc32 (of 32-bit
    little-endian ids) and, on request, ids. Keys are sorted by bucket, then, once found, by
    shard and offset, so that files are read forward.
    """
    spark: SparkSession = keys.sparkSession
    from tokenizers import Tokenizer

    width = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 65_536 else "<u4"
    index = {r["bucket"]: r["index_file"] for r in spark.read.parquet(f"{folder}/index_table").collect()}
    shards = {r["shard"]: (r["file"], r["start"]) for r in spark.read.parquet(f"{folder}/shard_table").collect()}
    known = spark.sparkContext.broadcast((index, shards))
    id_type = keys.schema["doc_id"].dataType.simpleString()

    def find(batches):
        reader = Reader(folder, *known.value, width)
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            for one in np.unique(bucket):
                if int(one) not in reader.index:
                    continue
                rows = batch.filter(pa.array(bucket == one))
                a, b = (rows.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
                found, there = reader.find(int(one), a, b)
                found = found[there]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(c).filter(pa.array(there)) for c in ("doc_id", "nth")]
                    + [pa.array(found[c].astype(np.int64)) for c in ("shard", "offset", "n")],
                    names=["doc_id", "nth", "shard", "offset", "n_tokens"])

    def read(batches):
        reader = Reader(folder, *known.value, width)
        for batch in batches:
            shard, offset, n = (batch.column(c).to_pylist() for c in ("shard", "offset", "n_tokens"))
            crc, ids = [], []
            for s, o, k in zip(shard, offset, n):
                raw = reader.ids(s, o, k)
                crc.append(crc32(raw.astype("<u4").tobytes()))
                if keep_ids:
                    ids.append(raw.astype(np.int32))
            start = [reader.shards[s][1] + o for s, o in zip(shard, offset)]
            columns = [batch.column("doc_id"), batch.column("nth"), pa.array(start, pa.int64()), batch.column("n_tokens"),
                       pa.array(crc, pa.int64())] + ([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else [])
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "nth", "start", "n_tokens", "ids_crc32"] + (["ids"] if keep_ids else []))

    found = _hashed(keys, max(1, len(index))).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        find, f"doc_id {id_type}, nth long, shard long, offset long, n_tokens long")
    # A shard is one task's file; cutting it by offset spreads a large one over several readers.
    ordered = found.repartition("shard", F.shiftright("offset", 22)).sortWithinPartitions("shard", "offset")
    return ordered.mapInArrow(read, f"doc_id {id_type}, nth long, start long, n_tokens long, ids_crc32 long"
                              + (", ids array<int>" if keep_ids else ""))
