"""Cutting lineage with tables in the folder that every executor shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType

_own: str | None = None
#: Bytes of an Arrow batch: rows with long texts otherwise come 64 MB at a time, in the JVM and in each worker.
BATCH = "4m"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it's unset, one of our own in local mode, and an error on a
    cluster, whose machines would each write to a disk of their own."""
    global _own
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="lectern-")
    return f"file://{_own}"


def _top(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lectern/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{_top(spark)}/{tag}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Delete all tables of this application, results included: for its end."""
    delete(spark, _top(spark))


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, BATCH)


@contextmanager
def _shuffles_end_with_their_query(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the query that made them ends: the table that it wrote takes their place."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.getAll.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    small_batches(spark)
    with _shuffles_end_with_their_query(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a lost executor costs no recomputation past it."""
    return _write(df, fresh_path(df.sparkSession, tag))


class Workspace:
    """The tables of one operator, used in a `with` block, at whose end they go, whether it failed or not. `finish`
    writes the operator's result, which stays."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *error: object) -> None:
        while self.paths:
            delete(self.spark, self.paths.popitem()[1][0])

    def folder(self, tag: str) -> str:
        """A path for files of the operator's own."""
        path = fresh_path(self.spark, tag)
        self.paths[path] = (path, None)
        return path

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.folder(tag)
        out = _write(df, path)
        self.paths[id(out)] = (self.paths.pop(path)[0], out)
        return out

    def pieces(self, parts: Iterable[DataFrame], tag: str) -> DataFrame:
        """One table of at least one part, written one after another: the shuffles of a part go before the next one's."""
        path = self.folder(tag)
        for k, df in enumerate(parts):
            last = _write(df, f"{path}/piece={k}")
        out = self.spark.read.schema(StructType([*last.schema.fields, StructField("piece", IntegerType())])).parquet(path).drop("piece")
        self.paths[id(out)] = (self.paths.pop(path)[0], out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            delete(self.spark, self.paths.pop(id(t))[0])

    def finish(self, df: DataFrame, tag: str) -> DataFrame:
        return materialize(df, tag)
