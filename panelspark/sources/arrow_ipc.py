"""Arrow IPC (Feather) files as a Spark data source.

Reading is planned from a listing alone: each file is cut into ranges by its size, and the task of a range opens the footer and
reads its share of the record batches, one at a time. Simple conditions on columns are pushed into the tasks: batches whose stored
least and greatest values rule them out are not read, rows that fail them are not sent on. Writing puts one file per task into a
folder, and beside it a small file with each batch's least and greatest values.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan,
    LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema

FORMAT = "arrow_ipc"
SUFFIXES = (".arrow", ".feather")
STATS = ".stats"
RANGE_BYTES = 16 << 20


def _resolve(path: str):
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def _listed(path: str) -> list[tuple[str, int]]:
    """Arrow files and their sizes."""
    fs, root = _resolve(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [(root, info.size or 0)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size or 0) for f in found if f.is_file and f.path.endswith(SUFFIXES))


def _files(path: str) -> list[str]:
    return [file for file, _ in _listed(path)]


def _stats_file(file: str) -> str:
    folder, _, name = file.rpartition("/")
    return f"{folder}/.{name}{STATS}"


@dataclass
class Range(InputPartition):
    """The ``nth`` of ``of`` equal shares of a file's record batches."""

    file: str
    nth: int
    of: int


@dataclass
class Written(WriterCommitMessage):
    file: str | None


# A pushed condition by its kind: rows that pass, and whether a batch with these bounds can hold one.
_TESTS = {
    EqualTo: (pc.equal, lambda low, high, v: low <= v <= high),
    GreaterThan: (pc.greater, lambda low, high, v: high > v),
    GreaterThanOrEqual: (pc.greater_equal, lambda low, high, v: high >= v),
    LessThan: (pc.less, lambda low, high, v: low < v),
    LessThanOrEqual: (pc.less_equal, lambda low, high, v: low <= v),
    In: (lambda column, values: pc.is_in(column, pa.array(list(values), column.type)), lambda low, high, v: any(low <= x <= high for x in v)),
}


def _bounded(kind: pa.DataType) -> bool:
    return pa.types.is_integer(kind) or pa.types.is_date(kind) or pa.types.is_string(kind)


class ArrowReader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.names, self.tests = path, schema.fieldNames(), []

    def pushFilters(self, filters):
        """Take conditions on whole numbers, dates and texts. Spark still checks every row, so all are handed back."""
        for f in filters:
            column = getattr(f, "attribute", ())
            value = getattr(f, "value", None)
            if type(f) in _TESTS and len(column) == 1 and value is not None:
                self.tests.append((column[0], type(f), value))
            yield f

    def partitions(self):
        """Shares of files by size; no file is opened."""
        plan = []
        for file, size in _listed(self.path):
            of = max(1, -(-size // RANGE_BYTES))
            plan += [Range(file, i, of) for i in range(of)]
        return plan or [Range("", 0, 0)]

    def _wanted(self, fs, file: str, batches: range, schema: pa.Schema):
        """The batches that may hold rows passing all tests."""
        if not self.tests or fs.get_file_info(_stats_file(file)).type == pafs.FileType.NotFound:
            return batches
        with fs.open_input_file(_stats_file(file)) as handle:
            bounds = pa.ipc.open_file(handle).read_all().to_pydict()

        def possible(i):
            for column, kind, value in self.tests:
                low, high = (bounds.get(f"{column}:{end}", {i: None})[i] for end in ("min", "max"))
                if low is not None and not _TESTS[kind][1](low, high, value):
                    return False
            return True

        return [i for i in batches if possible(i)]

    def read(self, partition):
        """Decode only the columns of the schema asked for."""
        if not partition.of:
            return
        fs, _ = _resolve(self.path)
        with fs.open_input_file(partition.file) as handle:
            whole = pa.ipc.open_file(handle)
            schema, n = whole.schema, whole.num_record_batches
        mine = range(partition.nth * n // partition.of, (partition.nth + 1) * n // partition.of)
        options = pa.ipc.IpcReadOptions(included_fields=sorted(schema.names.index(c) for c in self.names))
        tests = [t for t in self.tests if t[0] in self.names and _bounded(schema.field(t[0]).type)]
        with fs.open_input_file(partition.file) as handle:
            reader = pa.ipc.open_file(handle, options=options)
            for i in self._wanted(fs, partition.file, mine, schema):
                batch = reader.get_batch(i).select(self.names)
                for column, kind, value in tests:
                    batch = batch.filter(_TESTS[kind][0](batch.column(column), value))
                if batch.num_rows:
                    yield batch


def _bounds(batch: pa.RecordBatch) -> dict:
    """Least and greatest value of each column that has an order without surprises; nulls where all are null."""
    found = {}
    for name, column in zip(batch.schema.names, batch.columns):
        if _bounded(column.type):
            ends = pc.min_max(column)
            found[f"{name}:min"], found[f"{name}:max"] = ends["min"], ends["max"]
    return found


def _final(file: str) -> str:
    return file.removesuffix(".tmp") + ".arrow"


class ArrowWriter(DataSourceArrowWriter):
    """Tasks write under a hidden name; only committed tasks' files get their final one."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path = path
        fs, root = _resolve(path)
        fs.create_dir(root, recursive=True)
        # Read before the job; these go only once all tasks have succeeded.
        self.replaced = _files(path) if overwrite else []

    def write(self, iterator):
        fs, root = _resolve(self.path)
        file, writer = f"{root}/part-{uuid.uuid4().hex}.tmp", None
        sink, bounds = None, []
        for batch in iterator:
            if writer is None:
                sink = fs.open_output_stream(file)
                writer = pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch)
            bounds.append(_bounds(batch))
        if writer is None:
            return Written(None)
        writer.close()
        sink.close()
        table = pa.table({c: pa.array([b[c].as_py() for b in bounds], bounds[0][c].type) for c in bounds[0]})
        with fs.open_output_stream(_stats_file(_final(file))) as out, pa.ipc.new_file(out, table.schema) as stats:
            stats.write_table(table)
        return Written(file)

    def commit(self, messages):
        fs, _ = _resolve(self.path)
        for message in messages:
            if message is not None and message.file:
                fs.move(message.file, _final(message.file))
        for file in self.replaced:
            self._remove(fs, file)

    @staticmethod
    def _remove(fs, file):
        for f in (file, _stats_file(file)):
            if fs.get_file_info(f).type == pafs.FileType.File:
                fs.delete_file(f)

    def abort(self, messages):
        fs, _ = _resolve(self.path)
        for message in messages:
            if message is not None and message.file:
                fs.delete_file(message.file)
                self._remove(fs, _final(message.file))


class ArrowIpcSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        fs, _ = _resolve(self.options["path"])
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no Arrow files in {self.options['path']}")
        with fs.open_input_file(files[0]) as handle:
            return from_arrow_schema(pa.ipc.open_file(handle).schema)

    def reader(self, schema):
        return ArrowReader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        return ArrowWriter(self.options["path"], overwrite)


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """All columns, or those of the given schema."""
    spark.dataSource.register(ArrowIpcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(FORMAT)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    df.sparkSession.dataSource.register(ArrowIpcSource)
    df.write.format(FORMAT).mode(mode).save(path)
