"""A pluggable scan of accounts by owner, as a Python data source.

``spark.read.format("account_scan")`` with options ``fetch`` (an importable ``module:name``
of a function from an owner to an iterable of account tuples), ``owners`` (comma-separated
base58) and ``parsers`` (their names, in the same order). One partition per (parser, owner).
``fetch`` gives an owner's accounts in the same order each time. Transient errors are retried
with growing pauses; any other error fails the read.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIRST_PAUSE, LAST_PAUSE, ATTEMPTS = 0.5, 10.0, 10


class Transient(Exception):
    """An error that may go away by itself."""


def pauses(first: float = FIRST_PAUSE, last: float = LAST_PAUSE, attempts: int = ATTEMPTS) -> Iterator[float]:
    """Seconds between attempts: doubling up to a limit."""
    for k in range(attempts):
        yield min(last, first * 2**k)


def retried(f: Callable, sleep: Callable[[float], None] = time.sleep, waits: Callable[[], Iterator[float]] = pauses):
    """The result of ``f``; each ``Transient`` costs one of the pauses, and the last one is raised."""
    for wait in waits():
        try:
            return f()
        except Transient:
            sleep(wait)
    return f()


class _Part(InputPartition):
    def __init__(self, parser: str, owner: str):
        super().__init__(f"{parser}:{owner}")
        self.parser, self.owner = parser, owner


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        owners, parsers = self.options["owners"].split(","), self.options["parsers"].split(",")
        return [_Part(p, o) for p, o in zip(parsers, owners, strict=True)]

    def read(self, partition):
        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        # rows pass through as they come; after a broken connection those already given are skipped
        given, waits = 0, pauses()
        while True:
            try:
                for n, (pubkey, lamports, data) in enumerate(fetch(partition.owner)):
                    if n >= given:
                        yield (partition.parser, pubkey, partition.owner, lamports, data, True, 0)
                        given += 1
                return
            except Transient:
                wait = next(waits, None)
                if wait is None:
                    raise
                time.sleep(wait)


class AccountScan(DataSource):
    @classmethod
    def name(cls) -> str:
        return "account_scan"

    def schema(self) -> str:
        return "parser string, pubkey string, owner string, lamports bigint, data binary, is_startup boolean, write_version bigint"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(AccountScan)
