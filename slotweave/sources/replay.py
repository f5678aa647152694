"""Reading captured updates: ranges of slots, epochs, files as streams, JSON fixtures."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.schema import KINDS

EPOCH_SLOTS = 432_000


def epoch_range(epoch: int) -> tuple[int, int]:
    """[first, end) of an epoch's slots."""
    return epoch * EPOCH_SLOTS, (epoch + 1) * EPOCH_SLOTS


def read_range(spark: SparkSession, path: str, first: int, end: int, reverse: bool = False) -> DataFrame:
    """Updates of slots in [first, end): a filter that reaches the scan, and prunes partitions by ``epoch`` if there are any.

    ``reverse``: ordered from the last slot to the first; else files are read side by side, in no order.
    """
    df = spark.read.parquet(path)
    out = df.where((F.col("slot") >= first) & (F.col("slot") < end))
    if "epoch" in df.columns:
        out = out.where((F.col("epoch") >= first // EPOCH_SLOTS) & (F.col("epoch") <= (end - 1) // EPOCH_SLOTS))
    return out.orderBy(F.col("slot").desc()) if reverse else out


def capture(updates: DataFrame, path: str) -> None:
    """Writes updates so that ``read_range`` prunes them: one folder per epoch, sorted by slot within files."""
    out = updates.withColumn("epoch", F.floor(F.col("slot") / EPOCH_SLOTS).cast("bigint"))
    out.repartitionByRange("epoch", "slot").sortWithinPartitions("epoch", "slot").write.mode("overwrite").partitionBy("epoch").parquet(path)


def stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Captured files as a stream, a few at a time; offsets and recovery are Spark's."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def snapshot(accounts: DataFrame, owners: DataFrame, rows: int = 100_000) -> DataFrame:
    """A snapshot as updates: one finalised slot status, then the accounts whose owner anyone asks for.

    ``owners``: owner, parser, one row for each parser that wants the owner; up to ``rows``
    of them are broadcast. Adds update, status and ``parsers``, who gets the row.
    """
    wanted = owners.groupBy("owner").agg(F.sort_array(F.collect_set("parser")).alias("parsers"))
    few = owners.limit(rows + 1).count() <= rows
    a = accounts.join(F.broadcast(wanted) if few else wanted, "owner").withColumns({"update": F.lit("account"), "status": F.lit(None).cast("string")})
    status = accounts.sparkSession.range(1).select(F.lit("slot").alias("update"), F.lit("finalized").alias("status"))
    return status.unionByName(a, allowMissingColumns=True)


def possible_leader_skips(blocks: DataFrame) -> DataFrame:
    """Slots between a block and its parent, for which no block came."""
    gap = F.when(F.col("slot") - F.col("parent_slot") > 1, F.sequence(F.col("parent_slot") + 1, F.col("slot") - 1))
    return blocks.select(F.explode(gap).alias("slot"))


def account_fixture(text: str) -> dict:
    """An account update from the JSON of a fixture (bytes as lists of numbers)."""
    a = json.loads(text)
    zero = {"slot": 0, "bank_id": 0, "write_version": 0, "is_startup": False, "txn_signature": None}
    return zero | {"pubkey": bytes(a["pubkey"]), "owner": bytes(a["owner"]), "lamports": a["lamports"], "executable": a["executable"], "rent_epoch": a["rentEpoch"], "data": bytes(a["data"])}


def transaction_fixture(text: str) -> list[dict]:
    """Instruction rows from the JSON of a fixture, in call order. Either a list of calls, or calls with log lines."""
    doc = json.loads(text)
    calls = doc if isinstance(doc, list) else doc["instructions"]
    logs = [] if isinstance(doc, list) else doc.get("log_messages", [])
    out = []

    def walk(ix: dict, path: list[int]) -> None:
        out.append({"path": path, "program": bytes(ix["program"]), "accounts": [bytes(a) for a in ix["accounts"]], "data": bytes(ix["data"]), "log_messages": logs})
        for k, inner in enumerate(ix["inner"]):
            walk(inner, [*path, k])

    for k, ix in enumerate(calls):
        walk(ix, [k])
    return out


def fixtures(spark: SparkSession, paths: str) -> DataFrame:
    """Account fixtures as account updates: text files by Spark's reader, decoded per file."""
    from decimal import Decimal

    import pandas as pd

    def run(batches):
        for b in batches:
            rows = [account_fixture(x) for x in b["value"]]
            for r in rows:
                for c in ("slot", "bank_id", "write_version", "lamports", "rent_epoch"):
                    r[c] = Decimal(r[c])
            yield pd.DataFrame(rows, columns=KINDS["account"].names)

    return spark.read.option("wholetext", True).text(paths).mapInPandas(run, KINDS["account"])
