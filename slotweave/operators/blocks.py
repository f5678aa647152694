"""Block metadata, rewards and statuses as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.schema import BLOCK_META, COMMITMENTS


def block_meta(blocks: DataFrame) -> DataFrame:
    """The metadata of block rows, whatever else they hold: other columns stay unread."""
    return blocks.select(*[F.col(n).cast(BLOCK_META[n].dataType).alias(n) if n in blocks.columns else F.lit(None).cast(BLOCK_META[n].dataType).alias(n) for n in BLOCK_META.names])


def rewards(blocks: DataFrame) -> DataFrame:
    """One row per reward; blocks without rewards give none."""
    return blocks.select("slot", "bank_id", F.explode("rewards").alias("r")).select("slot", "bank_id", "r.*")


def highest_commitment(statuses: DataFrame) -> DataFrame:
    """slot, bank_id and the most final of its statuses; statuses between slots don't count."""
    rank = F.array_position(F.array(*map(F.lit, COMMITMENTS)), F.col("status"))
    best = statuses.groupBy("slot", "bank_id").agg(F.max(rank).alias("_r")).where("_r > 0")
    return best.select("slot", "bank_id", F.element_at(F.array(*map(F.lit, COMMITMENTS)), F.col("_r").cast("int")).alias("status"))


def parallel_kinds(updates: dict[str, DataFrame], wanted: dict[str, set[str]]) -> dict[str, DataFrame]:
    """Per update kind its DataFrame with ``filters``, the names of those who want the kind; unwanted kinds are left out."""
    out = {}
    for kind, df in updates.items():
        names = sorted(n for n, kinds in wanted.items() if kind in kinds)
        if names:
            out[kind] = df.withColumn("filters", F.array(*map(F.lit, names)))
    return out
