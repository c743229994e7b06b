"""Shared storage for intermediate tables and files.

Everything written here goes to the folder named by ``spark.checkpoint.dir``, which driver and executors share, so a
result survives the loss of the executor that made it. Only a local session (tests) may name no folder: a temporary one
is used. A cluster without a folder is refused, as its machines would not see each other's files.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder; a temporary local folder only where the session names none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="pagelens-")
        root = _LOCAL[app]
    return root.rstrip("/") if "://" in root or root.startswith("file:") else "file://" + root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder name that no other call has."""
    return f"{shared_root(spark)}/pagelens/{name}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet in the shared folder and return them read back: lineage is cut there."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a table. They go to the JVM as Arrow data: for tuples alone, Spark would start a second
    kind of Python worker on every executor, which stays beside those that run operators."""
    kinds = StructType.fromDDL(schema)
    fields = to_arrow_schema(kinds)
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields), kinds)


def unused(name: str, columns: list[str], prefix: str) -> str:
    """The name, with the prefix before it as often as it takes to differ from all columns (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = prefix + name
    return name


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """While this holds, actions send Python workers so many rows at a time: a bound on memory where rows are wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that :func:`save` returned and that no later plan reads, in any store Spark reads."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Return memory that a Python worker no longer uses to the machine: workers wait for tasks beside the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of batches, giving memory back before and after; what operators leave in the worker goes."""

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        from . import shingles, tokens, unigram

        tokens.forget()
        unigram.forget()
        give_back()
        yield from run(batches)
        shingles.forget()
        give_back()

    return tidied


def filesystem_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a URI, for files that Spark's own writers cannot express."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri.removeprefix("file://").removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def commit_file(filesystem: pafs.FileSystem, temporary: str, final: str) -> None:
    """Move a finished file to its name in one step; a task that is run again replaces it by the same bytes."""
    filesystem.move(temporary, final)
