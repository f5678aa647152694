"""Mixing sources to target weights, without a sort.

Method: hash-threshold histograms. Every document gets a fixed 60-bit hash of its
id. Sizes are summed by source and the leading 12 bits of the hash; the bucket in
which the running sum passes the source's budget is the *boundary*. Only the
boundary bucket's documents are summed again by their next 12 bits, and so on for
five levels, which ends at one hash value. A document is in the sample if its hash
is below the threshold, so a larger budget always contains a smaller one.

Budgets above a source's size mean repeats: every document is taken
``floor(target / source_size)`` times and those below the threshold once more.

Main path: DataFrame functions only. The documents' texts are read once; what is
read again is a narrow table (id, source, size, hash).

Edge cases: a null text has size 0; a null source is a source of its own, ordered
last; a null id hashes like the empty text; rows with equal ids share a hash and
are taken or left together; an empty table gives an empty result; a source with no
words has target 0. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, stored, table, word_count

BITS, LEVELS = 12, 5
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0


def hash60(id_col: str | Column) -> Column:
    """The leading 60 bits of the MD5 of an id's text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    digest = F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target): the budget shared by weight, none above ``cap`` times its size.

    Repeated resharing of the excess has one fixed point: with sources in order of
    cap/weight, a prefix of them is full, and the rest share what is left by weight.
    One row per source goes through the global windows, never documents.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = sources.withColumn("_rank", F.row_number().over(by_name) - 1)
    t = t.withColumn("_w", F.element_at(w, (F.col("_rank") % len(weights) + 1).cast("int")))
    t = t.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    t = t.withColumn("_b", F.sum("source_size").over(everything) * F.lit(float(share)))
    t = t.withColumn("_left", F.col("_b") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    t = t.withColumn("_wleft", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    t = t.withColumn("_full", F.col("_left") / F.col("_wleft") >= F.col("_ratio"))
    t = t.withColumn("_full_cap", F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everything))
    t = t.withColumn("_open_w", F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(everything))
    level = F.col("_w") * ((F.col("_b") - F.col("_full_cap")) / F.col("_open_w"))
    return t.select("source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(level).alias("target"))


def thresholds(base: DataFrame, goals: DataFrame, n_sources: int) -> DataFrame:
    """(source, source_size, target, _copies, _theta): take once more what has ``_h`` <= ``_theta``."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    keys = ["source", "source_size", "target", "_copies", "_rem"]
    edge = goals.withColumn("_copies", copies).withColumn("_rem", F.col("target") - F.col("_copies") * F.col("source_size"))
    edge = edge.withColumn("_lo", F.lit(0)).withColumn("_at", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        e = edge.withColumnRenamed("source", "_s")
        inside = base.join(small(e, n_sources), base["source"].eqNullSafe(F.col("_s"))).where(
            F.shiftright("_h", shift + BITS) == F.col("_at")
        )
        # the table's few columns ride along as keys, so that each level reads the one before it once
        hist = inside.groupBy(*keys, "_lo", F.shiftright("_h", shift).alias("_bucket")).agg(F.sum("size").alias("_sum"))
        run = Window.partitionBy("source").orderBy("_bucket")
        hist = hist.withColumn("_cum", F.col("_lo") + F.sum("_sum").over(run))
        # first bucket whose running sum passes the rest; a source without words keeps its first
        passed = F.when((F.col("_cum") > F.col("_rem")) | (F.col("source_size") == 0), F.struct("_bucket", "_sum", "_cum"))
        edge = hist.groupBy(*keys).agg(F.min(passed).alias("_e"))
        edge = edge.select(
            *keys, (F.col("_e._cum") - F.col("_e._sum")).alias("_lo"), F.col("_e._bucket").alias("_at"), F.col("_e._sum").alias("_last")
        )
    nearer = (F.col("_lo") + F.col("_last") - F.col("_rem")) < (F.col("_rem") - F.col("_lo"))
    theta = F.when(nearer, F.col("_at")).otherwise(F.col("_at") - 1)
    return edge.select("source", "source_size", "target", "_copies", theta.alias("_theta"))


def _times() -> Column:
    """How often the mix takes a document, of its source's threshold."""
    return F.col("_copies") + (F.col("_h") <= F.col("_theta")).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, ``carry``, size, source_size, target, taken.

    ``taken`` is the words that the mix takes of the document, repeats counted.
    """
    base = stored(docs.select("doc_id", "source", *carry, word_count("text").alias("size"), hash60("doc_id").alias("_h")), "mix")
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stored(targets(sources, weights, share, cap), "goals")
    n = goals.count()
    narrow = base.select("source", "size", "_h")
    t = thresholds(narrow, goals, n).withColumnRenamed("source", "_s")
    out = base.join(small(t, n), base["source"].eqNullSafe(F.col("_s")))
    return out.select("doc_id", "source", *carry, "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mix itself: ``docs`` with each document as often as it is taken, all columns as they were."""
    narrow = stored(docs.select("source", word_count("text").alias("size"), hash60("doc_id").alias("_h")), "mix")
    goals = stored(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "goals")
    n = goals.count()
    t = thresholds(narrow, goals, n).select(F.col("source").alias("_s"), "_copies", "_theta")
    packed = docs.select(F.col("source").alias("_source"), hash60("doc_id").alias("_h"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    out = packed.join(small(t, n), F.col("_source").eqNullSafe(F.col("_s")))
    return out.select("doc", F.explode(F.array_repeat(F.lit(1), _times().cast("int")))).select("doc.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][rk % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM r),
o AS (SELECT *, cap / w AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS b FROM w),
l AS (SELECT *, b - coalesce(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS remains,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS wleft
      FROM o),
f AS (SELECT *, remains / wleft >= ratio AS isfull FROM l),
g AS (SELECT *, sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER () AS fc, sum(CASE WHEN isfull THEN 0 ELSE w END) OVER () AS ow FROM f),
t AS (SELECT source, source_size, CAST(CASE WHEN isfull THEN cap ELSE w * ((b - fc) / ow) END AS DOUBLE) AS target FROM g),
k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
h AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS sz FROM base GROUP BY source, h),
c AS (SELECT h.source, h.h, h.sz, k.target - k.copies * k.source_size AS rem, k.source_size,
         CAST(sum(h.sz) OVER (PARTITION BY h.source ORDER BY h.h) AS BIGINT) AS cum
      FROM h JOIN k ON h.source IS NOT DISTINCT FROM k.source),
e AS (SELECT source, min_by(CASE WHEN (cum - rem) < (rem - (cum - sz)) THEN h ELSE h - 1 END, h) AS theta
      FROM c WHERE cum > rem OR source_size = 0 GROUP BY source)
SELECT b.doc_id, b.size, k.source_size, k.target,
       CAST(b.size * (k.copies + CASE WHEN b.h <= e.theta THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM base b JOIN k ON b.source IS NOT DISTINCT FROM k.source JOIN e ON b.source IS NOT DISTINCT FROM e.source
"""
