"""Tables that cut lineage: written to the folder all executors share, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextmanager
def scope() -> Iterator[list[str]]:
    """The folders that are asked for inside, by this thread of work alone, oldest first; whoever opens the scope owns them."""
    made: list[str] = []
    token = _owner.set(made)
    try:
        yield made
    finally:
        _owner.reset(token)


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, the folder that driver and executors share; without it there is nowhere safe to write."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"  # driver and tasks are one process on one machine
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (mine := _owner.get()) is not None:
        mine.append(path)
    return path


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The same rows, read from a table that survives lost executors.

    rows: of a row group, which a task holds whole when it writes and when it reads; for rows of megabytes, as Parquet looks at
    the size of a group only after a hundred rows.
    """
    path = folder(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.row.count.limit", rows) if rows else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Removes folders that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in list(paths):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def finished(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns; if it has written tables on its way, the result is written too and they go."""
    with scope() as made:
        out = make()
    if not made:
        return out
    kept = stored(out, name)
    discard(spark, made)
    return kept
