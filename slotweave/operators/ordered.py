"""Ordered operations over a whole table without one task for all of it.

A global window would send every row to one task. Here rows are windowed within buckets
of the order key; one narrow row per bucket carries the bucket's end over to the next. The
buckets' rows are windowed in the same way, within buckets of buckets, so a task has at
most ``BUCKET`` of them and the one window over all has a row per ``BUCKET`` squared keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order keys per bucket: a bucket is one window partition, and its summary one row of the small table.
BUCKET = 10_000


def _bucket(key: str, size: int) -> Column:
    return F.floor(F.col(key) / size).cast("bigint")


def _carried(ends: DataFrame, total: Callable[[Column], Column], before: Callable[[Column, Window], Column], both: Callable[[Column, Column], Column], within: tuple[str, ...] = ()) -> DataFrame:
    """``ends`` (within, _b, _m) with ``_carry``, what all buckets before give, instead of ``_m``.

    ``total``: of the _m of a bucket of buckets; ``before``: of those before a row in a window;
    ``both``: of an outer and an inner carry.
    """
    e = ends.withColumn("_s", _bucket("_b", BUCKET))
    tops = e.groupBy(*within, "_s").agg(total(F.col("_m")).alias("_t"))
    tops = tops.withColumn("_o", before(F.col("_t"), Window.partitionBy(*within).orderBy("_s"))).drop("_t")
    e = e.withColumn("_i", before(F.col("_m"), Window.partitionBy(*within, "_s").orderBy("_b")))
    return e.join(tops, [*within, "_s"]).select(*within, "_b", both(F.col("_o"), F.col("_i")).alias("_carry"))


def _running(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def with_previous(df: DataFrame, key: str, value: str | None = None, name: str = "prev", size: int = BUCKET, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds the ``value`` (the key itself by default) of the row before in order of ``key``, null for the first.

    A null value of the row before is null: rows are told from no rows by a struct.
    """
    value = value or key
    b = df.withColumn("_b", _bucket(key, size))
    held = F.struct(F.col(value).alias("v"))
    ends = b.groupBy(*within, "_b").agg(F.max_by(held, key).alias("_m"))
    ends = _carried(ends, lambda m: F.max_by(m, "_b"), lambda m, w: F.lag(m).over(w), lambda outer, inner: F.coalesce(inner, outer), within)
    local = F.lag(held).over(Window.partitionBy(*within, "_b").orderBy(key))
    return b.withColumn("_l", local).join(ends, [*within, "_b"]).withColumn(name, F.coalesce("_l", "_carry")["v"]).drop("_b", "_l", "_carry")


def with_running_max(df: DataFrame, key: str, value: str, name: str = "high", size: int = BUCKET) -> DataFrame:
    """Adds the greatest ``value`` of all rows before, in order of ``key``; null for the first."""
    b = df.withColumn("_b", _bucket(key, size))
    ends = b.groupBy("_b").agg(F.max(value).alias("_m"))
    ends = _carried(ends, F.max, lambda m, w: F.max(m).over(_running(w)), F.greatest)
    local = F.max(value).over(_running(Window.partitionBy("_b").orderBy(key)))
    return b.withColumn("_l", local).join(ends, "_b").withColumn(name, F.greatest("_l", "_carry")).drop("_b", "_l", "_carry")


def with_running_count(df: DataFrame, key: str, condition: Column, name: str = "n", size: int = BUCKET) -> DataFrame:
    """Adds the number of rows up to and with this one, in order of ``key``, for which ``condition`` holds."""
    b = df.withColumn("_b", _bucket(key, size)).withColumn("_c", F.coalesce(condition, F.lit(False)).cast("bigint"))
    ends = b.groupBy("_b").agg(F.sum("_c").alias("_m"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    ends = _carried(ends, F.sum, lambda m, w: F.sum(m).over(_running(w)), lambda outer, inner: zero(outer) + zero(inner))
    local = F.sum("_c").over(Window.partitionBy("_b").orderBy(key))
    return b.withColumn("_l", local).join(ends, "_b").withColumn(name, F.col("_l") + F.col("_carry")).drop("_b", "_c", "_l", "_carry")


def last_wins(df: DataFrame, keys: list[str], ingest: str) -> DataFrame:
    """Of rows with equal keys, that with the greatest ``ingest``.

    An aggregate, not a window: partial results are combined before the shuffle, so a key
    with very many writes is no hot partition.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ingest).alias("_r"))
    return best.select(*keys, *[F.col("_r").getField(c).alias(c) for c in rest])
