"""Session start and the shared folder for cut lineage and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def start(app: str = "panelspark", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC days and adaptive execution; callers add cluster settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, named by ``spark.checkpoint.dir``.

    A local session without the setting gets a fresh temporary folder; a cluster
    session without it is an error, since executors do not share local disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="panelspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, files: list[str]) -> None:
    """Remove written tables below the shared folder, given by their files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    inside = jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath()
    for folder in {f.rsplit("/", 1)[0] for f in files}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(f"{inside}/"):
            path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: a cut that outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash rows by key into exactly ``spark.sql.shuffle.partitions`` parts.

    Adaptive execution sizes partitions by bytes. Where each row carries much work, as in a
    fit per series, merging small partitions would leave executors idle.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
