"""The slot machine as a Structured Streaming operator, with one state per chain."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from slotweave.streaming.machine import Event, SlotMachine

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "chain string, ingest bigint, kind string, slot bigint, bank bigint, parent bigint, expected bigint, key string, payload string, decoded boolean, entries bigint, executed bigint"
OUTPUT = "chain string, kind string, slot bigint, bank bigint, key string, payload string, counts string"


def _none(x):
    return None if x is None or pd.isna(x) else x


class SlotOrderError(RuntimeError):
    """Order can't be kept any more: two confirmed banks, contradicting metadata, too many pending banks, ..."""


class SlotProcessor(StatefulProcessor):
    """Applies a chain's events in ingest order. The state is the machine's, as JSON.

    A fatal error fails the query: a stream that went on would drop all that follows. The
    batch is not committed, so a restart meets the same events again.
    """

    def __init__(self, **options):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        machine = SlotMachine(json.loads(self.state.get()[0]) if self.state.exists() else None, **self.options)
        events = pd.concat(list(rows)).sort_values("ingest", kind="stable")
        out = []
        for r in events.itertuples(index=False):
            number = lambda x: None if _none(x) is None else int(x)
            e = Event(r.kind, int(r.slot), number(r.bank), number(r.parent), number(r.expected), _none(r.key), _none(r.payload), _none(r.decoded) is not False, number(r.entries), number(r.executed))
            out += [(key[0], o.kind, o.slot, o.bank, o.key, o.payload, json.dumps(o.counts) if o.counts else None) for o in machine.apply(e)]
            if machine.failed:
                raise SlotOrderError(f"chain {key[0]}: {machine.failed}")
        self.state.update((json.dumps(machine.state()),))
        frame = pd.DataFrame(out, columns=["chain", "kind", "slot", "bank", "key", "payload", "counts"])
        yield frame.astype({"slot": "Int64", "bank": "Int64"})

    def close(self) -> None:
        pass


def commits(events: DataFrame, **options) -> DataFrame:
    """Records and commit markers in slot order, and late and dropped rows, of a stream of EVENTS.

    ``options``: the machine's (whole_start, accounts, unique_banks).

    The order is global per chain, so a chain is one state and one task; decode before,
    where the work is. Needs the RocksDB state store (``configure``).
    """
    return events.groupBy("chain").transformWithStateInPandas(SlotProcessor(**options), OUTPUT, outputMode="Append", timeMode="None")


def configure(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class WatermarkProcessor(StatefulProcessor):
    """A marker for the slot before, whenever a higher one begins; lower slots move nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("slot", "slot bigint")

    def handleInputRows(self, key, rows, timer_values):  # noqa: N802
        now = int(self.state.get()[0]) if self.state.exists() else None
        out = []
        for slot in pd.concat(list(rows)).sort_values("ingest", kind="stable")["slot"].tolist():
            if now is None:
                now = slot
            elif slot > now:
                out.append((key[0], now))
                now = slot
        if now is not None:
            self.state.update((now,))
        yield pd.DataFrame(out, columns=["chain", "slot"])

    def close(self) -> None:
        pass


def passthrough_markers(rows: DataFrame) -> DataFrame:
    """chain, slot: slots that are complete, as they are passed. ``rows``: chain, slot, ingest."""
    return rows.groupBy("chain").transformWithStateInPandas(WatermarkProcessor(), "chain string, slot bigint", outputMode="Append", timeMode="None")


def without_repeats(updates: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """Resume dedup on a stream: repeats within the watermark's delay are dropped, per filter name."""
    each = updates.withColumn("filter", F.explode("filters")).drop("filters")
    return each.withWatermark(time, delay).dropDuplicatesWithinWatermark(["slot", *keys, "filter"])


def event_rates(events: DataFrame, time: str, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts per window and kind, with late data bounded by a watermark. NTZ times must be cast first."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window), "kind").agg(F.count(F.lit(1)).alias("n"))
