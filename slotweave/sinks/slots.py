"""Idempotent sinks for slots: batches may be written again, and count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions.encoding import zigzag_varint
from slotweave.operators import resume


def confluent(payload: Column, schema_id: int, indices: list[int] | None = None) -> Column:
    """The registry's wire format: a zero byte, the schema's id, the message's indices, the payload.

    The first message of a schema, [0], is the single byte 0.
    """
    path = indices or [0]
    packed = b"\0" if path == [0] else zigzag_varint(len(path)) + b"".join(map(zigzag_varint, path))
    return F.concat(F.lit(b"\0" + schema_id.to_bytes(4, "big") + packed), payload)


class SlotSink:
    """Writes records and commit markers of streaming batches; a batch that is written again replaces itself."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: records first, then the markers that make them count."""
        records = batch.where("kind = 'record'")
        markers = batch.where("kind = 'commit'").select("chain", "slot", "bank", "counts")
        records.write.mode("overwrite").parquet(f"{self.path}/records/batch={batch_id}")
        markers.write.mode("overwrite").parquet(f"{self.path}/markers/batch={batch_id}")

    def committed(self, spark: SparkSession) -> DataFrame:
        """Records of slots that have their marker, so never half a slot. Chains have slots of their own."""
        r = spark.read.parquet(f"{self.path}/records")
        return r.join(spark.read.parquet(f"{self.path}/markers").select("chain", "slot", "bank"), ["chain", "slot", "bank"], "left_semi")

    def last_slot(self, spark: SparkSession, chain: str) -> int | None:
        """Where to go on with a chain after a restart."""
        m = spark.read.parquet(f"{self.path}/markers").where(F.col("chain") == chain)
        return resume.last_committed(m.select(F.col("batch").alias("partition"), F.to_json(F.struct("slot")).alias("value"))).first()["slot"]


def republished(decoded: DataFrame, programs: list[str]) -> DataFrame:
    """What subscribers of ``programs`` get; a program that nobody serves gives nothing."""
    return decoded.where(F.col("program").isin(programs))
