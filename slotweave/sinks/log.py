"""Whole slots to a partitioned log, in order, each in one transaction.

The log is a pluggable producer: an importable ``module:name`` of a function from (options,
chain) to an object with ``begin()``, ``send(topic, key, value, headers)``, ``commit()`` and
``abort()``, and ``last()``, the highest slot whose marker the log holds. A slot's records and its
marker go in one transaction; if any of it fails, the whole slot is tried again, and a batch
that is written again skips what the log has.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.sources.scan import Transient, pauses


@dataclass
class LogSink:
    """For ``foreachBatch`` over the output of ``coordinator.commits``. ``topics``: of records and accounts, by kind."""

    producer: str
    options: dict = field(default_factory=dict)
    topics: dict = field(default_factory=lambda: {"record": "transaction.slots", "account": "account.slots"})
    attempts: int = 3
    backoff: float = 0.2

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """A chain's slots go through one task in order; chains side by side."""
        rows = batch.where("kind in ('record', 'commit', 'account', 'account_commit')").withColumn("_n", F.monotonically_increasing_id())
        # the batch has a chain's rows in their order; so has the task that writes them
        ordered = rows.repartition("chain").sortWithinPartitions("chain", "_n")
        ordered.select("chain", "kind", "slot", "key", "payload", "counts").foreachPartition(self._partition)

    def _partition(self, rows: Iterator) -> None:
        module, _, name = self.producer.partition(":")
        make = getattr(importlib.import_module(module), name)
        producer, chain, held = None, None, {}
        for r in rows:
            if r["chain"] != chain:
                chain, held = r["chain"], {}
                producer = make(self.options, chain)
                done = {what: producer.last(self.topics[what]) for what in self.topics}
            what, marker = "account" if r["kind"].startswith("account") else "record", r["kind"].endswith("commit")
            rows_of = held.setdefault((what, r["slot"]), [])
            rows_of.append(r)
            if marker:
                if done[what] is None or r["slot"] > done[what]:
                    self._slot(producer, self.topics[what], rows_of)
                del held[what, r["slot"]]

    def _slot(self, producer, topic: str, rows: list) -> None:
        def go() -> None:
            producer.begin()
            try:
                for r in rows:
                    marker = r["kind"].endswith("commit")
                    value = json.dumps({"marker": "commit", "slot": r["slot"], **json.loads(r["counts"] or "{}")}) if marker else r["payload"]
                    producer.send(topic, None if marker else r["key"], value, {"slot": r["slot"]})
                producer.commit()
            except BaseException:
                producer.abort()
                raise

        attempt(go, self.attempts, self.backoff)


def attempt(f: Callable[[], None], attempts: int, backoff: float) -> None:
    """Runs ``f`` up to ``attempts`` times while it raises ``Transient``."""
    import time

    waits = pauses(backoff, 10.0, attempts - 1)
    while True:
        try:
            return f()
        except Transient:
            wait = next(waits, None)
            if wait is None:
                raise
            time.sleep(wait)
