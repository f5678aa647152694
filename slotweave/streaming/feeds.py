"""A feed's frames as rows: transactions numbered per slot, what is dropped and why.

A feed that marks its slots sends ``start``, ``end``, ``transaction``, ``clipped`` (the feed
itself withheld ``withheld`` transactions), ``unknown`` (a payload of no known kind) and
``reconnected`` (of no slot: whatever is open then has missed something). All of it is
windows over the ingest order, so a batch of captured frames and a micro-batch are framed by
the same plan; across micro-batches ``Numbering`` carries the counts of a bounded number of
slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from slotweave.operators.ordered import with_running_count
from slotweave.operators.resume import frame_index

#: Slots behind the highest that a stream still numbers.
RETAINED_SLOTS = 64
# What becomes of a frame, as counted.
COUNTERS = ("delivered", "out_of_frame", "vote_rule_dropped", "unknown_result", "undecodable", "restarts", "clipped", "unknown_payload", "reconnects")


def wanted(filters: Column, is_vote: Column, vote_rules: dict[str, bool]) -> Column:
    """The filter names that get a transaction: those whose vote rule, if they have one, is met."""
    out = F.lit(True)
    rules = F.create_map(*[F.lit(x) for pair in vote_rules.items() for x in pair]) if vote_rules else None
    return filters if rules is None else F.filter(filters, lambda f: out & F.coalesce(F.element_at(rules, f) == is_vote, F.lit(True)))


def framed(frames: DataFrame, bounded: bool = True, vote_rules: dict[str, bool] | None = None) -> DataFrame:
    """Frames with ``fate`` (delivered, dropped for a reason, or null for marks), ``frame``, ``out_of_frame``, ``restart``, ``names``.

    ``frames``: ingest, kind, slot, result (null: unknown), decoded, is_vote, filters,
    withheld. ``frame`` is a delivered transaction's index in its slot; restarts don't reset
    it. ``bounded``: the feed marks its slots, and transactions outside of them are delivered
    and counted as ``out_of_frame``.
    """
    is_ = lambda k: F.col("kind") == k
    f = with_running_count(frames, "ingest", is_("reconnected"), "_epoch")
    names = wanted(F.col("filters"), F.col("is_vote"), vote_rules or {})
    fate = F.when(F.col("result").isNull(), "unknown_result").when(~F.col("decoded"), "undecodable").when(F.size(names) == 0, "vote_rule_dropped").otherwise("delivered")
    f = f.withColumns({"names": F.when(is_("transaction"), names), "fate": F.when(is_("transaction"), fate)})
    before = Window.partitionBy("slot").orderBy("ingest").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("kind").isin("start", "end"), F.struct("kind", "_epoch"))
    last = F.last(mark, ignorenulls=True).over(before)
    of_slot = f.where("slot is not null").withColumn("_last", last)
    open_ = (F.col("_last.kind") == "start") & (F.col("_last._epoch") == F.col("_epoch"))
    # a slot that had ended, or was open when the connection broke, starts again
    again = is_("start") & F.col("_last").isNotNull() & ~F.coalesce(open_, F.lit(False))
    outside = is_("transaction") & (F.col("fate") == "delivered") & ~F.coalesce(open_, F.lit(False)) & F.lit(bounded)
    of_slot = of_slot.withColumns({"restart": again, "out_of_frame": F.coalesce(outside, F.lit(False))}).drop("_last", "_epoch")
    given = frame_index(of_slot.where("fate = 'delivered'"))
    rest = of_slot.where("fate is null or fate <> 'delivered'").unionByName(f.where("slot is null").drop("_epoch"), allowMissingColumns=True)
    return given.unionByName(rest, allowMissingColumns=True)


def counters(frames: DataFrame) -> DataFrame:
    """One row of ``COUNTERS`` over the output of ``framed``."""
    fates = [F.count_if(F.col("fate") == c).alias(c) for c in ("delivered", "vote_rule_dropped", "unknown_result", "undecodable")]
    kinds = [F.count_if(F.col("kind") == k).alias(c) for k, c in (("unknown", "unknown_payload"), ("reconnected", "reconnects"))]
    more = [F.count_if("out_of_frame").alias("out_of_frame"), F.count_if("restart").alias("restarts"), F.coalesce(F.sum(F.when(F.col("kind") == "clipped", F.col("withheld"))), F.lit(0)).cast("bigint").alias("clipped")]
    return frames.agg(*fates, *more, *kinds).select(*COUNTERS)


class Numbering(StatefulProcessor):
    """Numbers a feed's delivered transactions per slot across micro-batches; slots far behind the highest are forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getMapState("next", "slot bigint", "n bigint")
        self.high = handle.getValueState("high", "slot bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows)).sort_values("ingest", kind="stable")
        high = max(int(batch["slot"].max()), int(self.high.get()[0]) if self.high.exists() else 0)
        per = batch.groupby("slot").cumcount()
        starts = {int(s): int(self.next.getValue((int(s),))[0]) if self.next.containsKey((int(s),)) else 0 for s in batch["slot"].unique()}
        batch = batch.assign(frame=[starts[int(s)] + int(n) for s, n in zip(batch["slot"], per, strict=True)])
        for slot, n in batch.groupby("slot").size().items():
            self.next.updateValue((int(slot),), (starts[int(slot)] + int(n),))
        for (slot,) in [k for k in self.next.keys() if k[0] < high - RETAINED_SLOTS]:
            self.next.removeKey((slot,))
        self.high.update((high,))
        yield batch[["feed", "slot", "ingest", "signature", "frame"]]

    def close(self) -> None:
        pass


def numbered(delivered: DataFrame) -> DataFrame:
    """A stream of delivered transactions (feed, slot, ingest, signature) with ``frame``. One state per feed."""
    return delivered.groupBy("feed").transformWithStateInPandas(Numbering(), "feed string, slot bigint, ingest bigint, signature string, frame bigint", outputMode="Append", timeMode="None")


def merged_regions(updates: DataFrame, time: str, delay: str) -> DataFrame:
    """Several regions' copies of one feed as one: of equal (slot, signature) the first that comes, within the watermark's delay."""
    return updates.withWatermark(time, delay).dropDuplicatesWithinWatermark(["slot", "signature"])
