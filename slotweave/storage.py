"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables stored within the open scopes, the innermost last.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session sets none (unit tests), a folder of our own is made; a cluster
    must name one, as its machines share no temporary folder.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="slotweave-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, what: str = "t", row_group: int | None = None, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and reread it.

    Cuts the lineage: what is read later survives the loss of any executor. ``row_group``:
    bytes of a row group, for tables whose rows take long to work on: a file can then be
    split among tasks. ``replaces``: a stored table that nobody needs any more once this one
    is written (the round before in a loop); it is deleted.
    """
    path = f"{shared_dir(df.sparkSession)}/slotweave-{what}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if row_group:
        writer = writer.option("parquet.block.size", row_group)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _scopes:
        _scopes[-1].append(path)
    if replaces is not None:
        drop(replaces)
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that ``stored`` gave; other DataFrames are left alone."""
    path = getattr(df, "_stored_at", None)
    if path is not None:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scope(spark: SparkSession, keep: list[DataFrame] | None = None) -> Iterator[list[DataFrame]]:
    """Tables stored inside are deleted at the end, but for those put on the list that it gives."""
    kept: list[DataFrame] = [] if keep is None else keep
    _scopes.append([])
    try:
        yield kept
    finally:
        mine, left = _scopes.pop(), {getattr(d, "_stored_at", None) for d in kept}
        for path in mine:
            if path not in left:
                _delete(spark, path)
        if _scopes:
            _scopes[-1] += [p for p in mine if p in left]
