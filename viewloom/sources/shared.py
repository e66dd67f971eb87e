"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from viewloom.errors import StorageError

#: Folder -> its session, of tables that are still there.
_kept: dict[str, SparkSession] = {}
#: Folders written since ``scratch`` was entered.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise StorageError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='viewloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _kept[path] = spark
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the reread table.

    A lost executor then costs a reread instead of the whole lineage. The files go with ``forget``, else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    _kept[path] = spark
    if _scratch.get() is not None:
        _scratch.get().append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def keep_measured(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """As ``keep``, with aggregates of the rows that are taken as they are written: always ``n``, their number."""
    seen = Observation()
    out = keep(df.observe(seen, F.count(F.lit(1)).alias("n"), *[m.alias(k) for k, m in measures.items()]), name)
    return out, seen.get


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables kept inside are deleted at the end, but for those put into the list that this gives."""
    saved: list[DataFrame] = []
    outer, written = _scratch.get(), []
    token = _scratch.set(written)
    try:
        yield saved
    finally:
        _scratch.reset(token)
        stays = {getattr(t, "kept_path", None) for t in saved}
        for path in written:
            if path in stays:
                if outer is not None:
                    outer.append(path)
            elif path in _kept:
                delete(_kept.pop(path), path)


def forget(*tables: DataFrame | None) -> None:
    """Delete tables of ``keep`` that nothing reads any more; others are left alone."""
    for table in tables:
        path = getattr(table, "kept_path", None)
        if path in _kept:
            delete(_kept.pop(path), path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clear() -> None:
    for path, spark in _kept.items():
        with contextlib.suppress(Exception):
            delete(spark, path)
    _kept.clear()
