"""Shared helpers of the training-data operators: scratch tables, sizes, word patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from slotweave.storage import drop, scope, shared_dir, stored  # noqa: F401

#: A word is a run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
#: Small tables (one row per source, group, ...) are broadcast up to this many rows, else joined by a shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast only if its counted ``rows`` are within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Number of words of a text, 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null ids: crc32 of the empty text)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod


def chunks(texts: list, most: int = 1_000_000):
    """Slices (start, end) of ``texts`` with about ``most`` characters each; a longer text is alone in its slice."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def mapped(df: DataFrame, inputs: list[str], fn: Callable, new: str, keep: list[str] | None = None) -> DataFrame:
    """``df``'s columns (``keep`` of them, all by default) and the columns ``new`` (DDL) that ``fn`` makes.

    ``fn`` gets each batch's ``inputs`` as Arrow arrays and returns one list or array per
    new column. What is kept stays in Arrow, so nulls, long ids and nested columns pass
    through unchanged.
    """
    keep = df.columns if keep is None else keep
    added = T.StructType.fromDDL(new)
    schema = T.StructType([*[df.schema[c] for c in keep], *added.fields])
    kinds = to_arrow_schema(added).types
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = fn(*(b.column(c) for c in inputs))
            made = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *made], names=names)

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, schema)
