"""A live feed as a streaming source, over a pluggable transport.

``spark.readStream.format("live_feed")`` with ``transport``, an importable ``module:name`` of a
function from the options to an object with ``first()`` and ``latest()``, positions (slots, or
a group stream's message numbers), and ``read(start, end)``, an iterator over the updates
(position, kind, key, filters, payload) at positions in [start, end), which may be read again.
Offsets are positions, so a restart reads again from what was committed; ``rewind`` goes back
further when a query starts, and ``resume.drop_repeats`` or ``coordinator.without_repeats``
drop what then comes twice. Errors that may go away are retried with growing pauses, others
end the query; ``exit_status`` tells how.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from slotweave.sources.scan import Transient, pauses, retried

SCHEMA = "position bigint, kind string, key string, filters array<string>, payload string"


class _Span(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.width = int(self.options.get("span", 1000))
        self.most = int(self.options.get("most", 100_000))
        self.at: int | None = None

    def _transport(self):
        module, _, name = self.options["transport"].partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def _retried(self, f):
        first, last, attempts = (self.options.get(k, d) for k, d in (("first_pause", 0.5), ("last_pause", 10), ("retries", 10)))
        return retried(f, waits=lambda: pauses(float(first), float(last), int(attempts)))

    def initialOffset(self) -> dict:  # noqa: N802
        """``from``, or where the transport begins; less ``rewind``, but not before its beginning."""
        first = self._retried(lambda: self._transport().first())
        start = int(self.options.get("from", first)) - int(self.options.get("rewind", 0))
        return {"position": max(first, start)}

    def latestOffset(self) -> dict:  # noqa: N802
        """The end of what is there, at most ``most`` positions further than the last batch."""
        latest = self._retried(lambda: self._transport().latest()) + 1
        if self.at is None:
            self.at = self.initialOffset()["position"]
        return {"position": max(self.at, min(latest, self.at + self.most))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = start["position"], end["position"]
        self.at = b
        return [_Span(x, min(x + self.width, b)) for x in range(a, b, self.width)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        """Rows as they come; after a broken connection it is read again from the first position not yet whole."""
        at, given, waits = partition.start, 0, self._waits()
        while True:
            try:
                skip = given
                for row in self._transport().read(at, partition.end):
                    if row[0] != at:
                        at, given, skip = row[0], 0, 0
                    if skip:
                        skip -= 1
                        continue
                    yield row
                    given += 1
                return
            except Transient:
                self._pause(waits)

    def _waits(self) -> Iterator[float]:
        return pauses(float(self.options.get("first_pause", 0.5)), float(self.options.get("last_pause", 10)), int(self.options.get("retries", 10)))

    @staticmethod
    def _pause(waits: Iterator[float]) -> None:
        import time

        wait = next(waits, None)
        if wait is None:
            raise Transient("the transport keeps failing")
        time.sleep(wait)

    def commit(self, end: dict) -> None:
        pass


class LiveFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):  # noqa: N802
        return _Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(LiveFeed)


class Folder:
    """A transport over JSON files named by position, ``<position>.json``, each a list of updates. For tests and replays."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def _positions(self) -> list[int]:
        import os

        return sorted(int(x[:-5]) for x in os.listdir(self.path) if x.endswith(".json"))

    def first(self) -> int:
        return min(self._positions(), default=0)

    def latest(self) -> int:
        return max(self._positions(), default=-1)

    def read(self, start: int, end: int) -> Iterator[tuple]:
        import json

        for p in self._positions():
            if start <= p < end:
                with open(f"{self.path}/{p}.json", encoding="utf-8") as f:
                    for u in json.load(f):
                        yield p, u["kind"], u.get("key"), u.get("filters", []), u.get("payload")


def exit_status(query: StreamingQuery) -> tuple[str, str | None]:
    """(running, completed, connection_lost, order_lost or failed; message) of a query."""
    if query.isActive:
        return "running", None
    error = query.exception()
    if error is None:
        return "completed", None
    text = str(error)
    kind = "connection_lost" if "Transient" in text else "order_lost" if "SlotOrderError" in text else "failed"
    return kind, text
