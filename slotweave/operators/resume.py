"""Resuming a stream: repeats dropped per filter, checkpoints, watermarks, frame indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotweave.operators.ordered import BUCKET, with_running_max

REWIND, FLOOR = 4, 32
#: Statuses that are never dropped as repeats.
ALWAYS = ("completed", "dead")


def dedup_key(kind: Column, key: Column, status: Column | None = None, bank: Column | None = None) -> Column:
    """What tells updates of a slot apart. Statuses: (status, bank), without bank once confirmed or finalised."""
    if status is None:
        return F.concat_ws("|", kind, key.cast("string"))
    of_slot = F.concat_ws("|", F.lit("slot"), status, F.when(~status.isin("confirmed", "finalized"), bank.cast("string")))
    return F.when(kind == "slot", of_slot).otherwise(F.concat_ws("|", kind, key.cast("string")))


def drop_repeats(updates: DataFrame, key: str = "dedup_key", order: str = "ingest") -> DataFrame:
    """Updates with the filter names that have not had them yet; gone when none is left.

    ``updates``: slot, filters (array), the key and the ingest order. A null key is never a repeat.
    """
    keyed = updates.where(F.col(key).isNotNull())
    first = keyed.select("slot", key, order, F.explode("filters").alias("_f")).groupBy("slot", key, "_f").agg(F.min(order).alias(order))
    names = first.groupBy("slot", key, order).agg(F.sort_array(F.collect_set("_f")).alias("_names"))
    kept = keyed.join(names, ["slot", key, order]).withColumn("filters", F.col("_names")).drop("_names")
    return kept.unionByName(updates.where(F.col(key).isNull()).select(*kept.columns))


def checkpoint(states: DataFrame) -> DataFrame:
    """One row: min(oldest open slot, newest complete slot). ``states``: slot, state (open, complete)."""
    oldest = F.min(F.when(F.col("state") == "open", F.col("slot")))
    newest = F.max(F.when(F.col("state") == "complete", F.col("slot")))
    return states.agg(F.least(oldest, newest).alias("checkpoint"))


def resubscribe(point: Column, oldest_parent: Column, configured: Column) -> Column:
    """Where to start again: the checkpoint less REWIND or an older incomplete parent, at most FLOOR back, not before the configured start."""
    back = F.least(point - REWIND, F.coalesce(oldest_parent, point))
    return F.greatest(back, point - FLOOR, configured)


def passthrough_markers(rows: DataFrame, order: str = "ingest") -> DataFrame:
    """slot: a marker for each slot that a higher one ended, and for the last at the close.

    Rows of a slot below the highest so far move nothing.
    """
    run = with_running_max(rows.select("slot", order), order, "slot", "high")
    moved = run.where(F.col("slot") > F.col("high")).select(F.col("high").alias("slot"), F.lit(False).alias("final"))
    last = run.agg(F.max(F.greatest("slot", F.coalesce("high", F.col("slot")))).alias("slot")).where("slot is not null").withColumn("final", F.lit(True))
    return moved.unionByName(last)


def last_committed(markers: DataFrame) -> DataFrame:
    """One row: the highest slot of the JSON markers (partition, value); an error if there are values but no slot in any."""
    slot = F.get_json_object("value", "$.slot").cast("bigint")
    per = markers.groupBy("partition").agg(F.max(slot).alias("slot"), F.count("value").alias("_n"))
    bad = F.raise_error(F.concat(F.lit("no marker can be read in partition "), F.col("partition").cast("string")))
    return per.select(F.when(F.col("slot").isNull() & (F.col("_n") > 0), bad.cast("bigint")).otherwise(F.col("slot")).alias("slot")).agg(F.max("slot").alias("slot"))


def frame_index(frames: DataFrame, order: str = "ingest") -> DataFrame:
    """Transactions with ``frame``: their running index in their slot, which restarts don't reset.

    A stream remembers a bounded number of *slots* (``streaming.feeds``); no transaction of
    a slot is ever left out. Slots of many rows are numbered by ranges of the order key, so
    none is one task.
    """
    b = frames.withColumn("_b", F.floor(F.col(order) / BUCKET).cast("bigint"))
    before = Window.partitionBy("slot").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = b.groupBy("slot", "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_n", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    n = F.row_number().over(Window.partitionBy("slot", "_b").orderBy(order)) - 1
    return b.withColumn("_l", n).join(ends, ["slot", "_b"]).withColumn("frame", F.col("_l") + F.col("_n")).drop("_b", "_l", "_n")


def restarts(marks: DataFrame, order: str = "ingest") -> DataFrame:
    """slot, restarts: how often a start follows an end. ``marks``: slot, mark (start, end), ingest."""
    before = F.lag("mark").over(Window.partitionBy("slot").orderBy(order))
    return marks.withColumn("_b", before).groupBy("slot").agg(F.count_if((F.col("mark") == "start") & (F.col("_b") == "end")).alias("restarts"))
