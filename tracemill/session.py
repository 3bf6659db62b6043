"""Session set-up and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folder that tables are written below while a scratch scope is open.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)
#: Makes Spark remove the shuffle files of a query as soon as the query has ended.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracemill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by spark.checkpoint.dir.

    Only a local session may go without it; it then gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a fresh folder inside the shared one, or inside the open scratch scope."""
    return f"{_SCRATCH.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def folder_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has made, on whatever file system it lies."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table that several later steps read to the shared folder and read it back.

    The lineage ends at the files, so a lost executor costs no recomputation of what came
    before, and the shuffle files of the write, which nothing needs any more, are removed.
    """
    spark = df.sparkSession
    path, before = new_folder(spark, name), spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A scope whose written tables are deleted at its end.

    What is to outlive it is written by the function that the scope gives, which puts a table
    where the scope was opened. A table that still reads from the scope must not leave it
    otherwise. Scopes may be nested.
    """
    outer = _SCRATCH.get()
    folder = new_folder(spark, "scratch")
    token = _SCRATCH.set(folder)

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner = _SCRATCH.set(outer)
        try:
            return written(df, name)
        finally:
            _SCRATCH.reset(inner)

    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        delete_folder(spark, folder)
