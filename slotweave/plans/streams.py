"""Queries over slots, banks and event streams, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotweave.operators import resume, slots
from slotweave.operators.prefilter import BlockPart, SlotPart
from slotweave.operators.ordered import with_previous, with_running_count
from slotweave.plans.transactions import WITH, query
from slotweave.sources import adapters, replay

#: The banks and slot events of the adapters in SQL.
BANKS = (
    WITH
    + """
, b0 AS (SELECT slot, count(*) AS expected, count(*) - max(CASE WHEN slot > 1500 AND slot % 10 = 7 THEN 1 ELSE 0 END) AS parsed FROM tx GROUP BY slot),
bk AS (SELECT slot, coalesce(lag(slot) OVER (ORDER BY slot), slot - 1) AS parent, expected, parsed, slot % 50 <> 49 AS confirmed,
          CASE WHEN slot % 23 = 5 THEN 'Forked' WHEN slot % 31 = 11 THEN 'Dead' WHEN slot % 37 = 3 THEN 'Incomplete' END AS discarded FROM b0),
ev AS (SELECT CAST(floor((epoch_us(ts) / 1000000.0 - 1704067200) / 3600) AS BIGINT) AS slot, event_id, user_id, event_type AS kind, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
"""
)


def on_banks(sql: str):
    return query(BANKS + sql)


_GATED = """
, live AS (SELECT *, lag(slot) OVER (ORDER BY slot) AS prev FROM bk WHERE discarded IS NULL),
chk AS (SELECT *, parsed >= expected AND {confirmed} AND (CASE WHEN prev IS NULL THEN parent < slot ELSE parent <= prev OR parent IN (SELECT slot FROM bk WHERE discarded = 'Incomplete') END) AS ok FROM live),
cut AS (SELECT min(slot) AS c FROM chk WHERE NOT ok)
"""


@on_banks(
    _GATED.format(confirmed="confirmed")
    + """
SELECT slot, expected, CASE WHEN c IS NULL OR slot < c THEN 'flushed' ELSE 'held' END AS state FROM chk, cut
UNION ALL SELECT slot, expected, 'discarded' FROM bk WHERE discarded IS NOT NULL
"""
)
def gated_flush(spark, sf_dir):
    """Slots flushed in order up to the first live one that isn't ready."""
    b = adapters.banks(spark, sf_dir)
    return slots.gated(b, slots.instruction_gate()).select("slot", "expected", "state")


@on_banks(
    _GATED.format(confirmed="slot % 1000 <> 999")
    + "SELECT count(CASE WHEN c IS NULL OR slot < c THEN 1 END) AS flushed, count(CASE WHEN slot >= c THEN 1 END) AS held, min(c) AS held_from FROM chk, cut"
)
def gap_blocks_flush(spark, sf_dir):
    """Where the queue stops: counts before and behind the first gap."""
    b = adapters.banks(spark, sf_dir).withColumn("confirmed", F.col("slot") % 1000 != 999)
    g = slots.gated(b, slots.instruction_gate()).where("state <> 'discarded'")
    held = F.col("state") == "held"
    return g.agg(F.count_if(~held).alias("flushed"), F.count_if(held).alias("held"), F.min(F.when(held, F.col("slot"))).alias("held_from"))


@on_banks("""
, c AS (SELECT slot, 0 AS bank, confirmed FROM bk UNION ALL SELECT slot, 1, FALSE FROM bk WHERE slot % 3 = 0)
SELECT slot, bank, CASE WHEN slot % 37 = 3 THEN 'Incomplete' WHEN slot % 23 = 5 AND bank = 1 THEN 'Forked' WHEN slot % 31 = 11 AND bank = 0 AND NOT confirmed THEN 'Forked'
       WHEN bank = 1 AND (slot % 50 <> 49) THEN 'Unconfirmed' END AS discarded FROM c
""")
def fork_discard(spark, sf_dir):
    """Winners and notices: confirmation beats a fork, an incomplete slot drops all its banks."""
    b = adapters.banks(spark, sf_dir)
    banks = b.select("slot", F.lit(0).alias("bank_id"), "confirmed").unionByName(b.where("slot % 3 = 0").select("slot", F.lit(1).alias("bank_id"), F.lit(False).alias("confirmed")))
    n = lambda cond, bank, why: b.where(cond).select("slot", F.lit(bank).cast("int").alias("bank_id"), F.lit(why).alias("reason"))
    notices = n("slot % 23 = 5", 1, "Forked").unionByName(n("slot % 31 = 11", 0, "Forked")).unionByName(n("slot % 37 = 3", None, "Incomplete"))
    return slots.winners(banks, notices).select("slot", F.col("bank_id").alias("bank"), "discarded")


@query("""
WITH RECURSIVE tx AS (SELECT DISTINCT datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS slot FROM orders),
bk AS (SELECT slot, slot - 1 - slot % 3 AS parent FROM tx),
r AS (
  SELECT slot, 0::BIGINT AS depth FROM bk WHERE slot % 400 < 3
  UNION ALL
  SELECT bk.slot, r.depth + 1 FROM bk JOIN r ON bk.parent = r.slot WHERE NOT bk.slot % 400 < 3)
SELECT bk.slot, bk.parent, r.slot IS NOT NULL AS linked, r.depth FROM bk LEFT JOIN r ON bk.slot = r.slot
""")
def chain_ancestry(spark, sf_dir):
    """Whether each slot's ancestry reaches a root without a hole, and how deep it is."""
    b = adapters.headers(spark, sf_dir).select("slot").distinct()
    b = b.withColumn("parent", F.col("slot") - 1 - F.col("slot") % 3)
    return slots.ancestry(b, F.col("slot") % 400 < 3).select("slot", "parent", "linked", "depth")


@on_banks("SELECT slot, parent, lag(expected) OVER (ORDER BY slot) AS before, sum(CASE WHEN expected > 6 THEN 1 ELSE 0 END) OVER (ORDER BY slot)::BIGINT AS large_so_far FROM bk")
def sorted_slot_drain(spark, sf_dir):
    """Slots in order with what came before, without one task for all of them."""
    b = adapters.banks(spark, sf_dir).select("slot", "parent", "expected")
    b = with_previous(b, "slot", "expected", "before", size=500)
    return with_running_count(b, "slot", F.col("expected") > 6, "large_so_far", size=500).drop("expected")


@on_banks("""
, m AS (SELECT slot, event_id, max(CASE WHEN event_id % 50 = 0 THEN slot - 5 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS frontier,
          slot - CASE WHEN event_id % 7 = 0 THEN 20 ELSE 0 END AS s FROM ev)
SELECT s AS slot, count(*) AS n, count(CASE WHEN s <= frontier THEN 1 END) AS late FROM m GROUP BY s
""")
def late_event_counts(spark, sf_dir):
    """Events behind the flush frontier of their time, counted per slot. Every 50th event flushes up to five slots back."""
    e = adapters.slot_events(spark, sf_dir)
    events = e.select((F.col("event_id") * 2).alias("ingest"), (F.col("slot") - F.when(F.col("event_id") % 7 == 0, 20).otherwise(0)).alias("slot"))
    flushes = e.where("event_id % 50 = 0").select((F.col("event_id") * 2 + 1).alias("ingest"), (F.col("slot") - 5).alias("flushed"))
    return slots.late(events, flushes).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late"))


_SEEN = """
, u AS (SELECT slot, event_id AS ingest, user_id, kind, ['a', 'b'] AS filters FROM ev WHERE event_id < 6000
        UNION ALL SELECT slot, event_id + 100000, user_id, kind, ['b', 'c'] FROM ev WHERE event_id >= 5000)
"""


@on_banks(
    _SEEN
    + """
, f AS (SELECT slot, ingest, kind || '|' || user_id AS key, unnest(filters) AS name FROM u WHERE kind <> 'error'),
k AS (SELECT slot, key, name, min(ingest) AS ingest FROM f GROUP BY ALL)
SELECT slot, ingest, string_agg(name, ',' ORDER BY name) AS filters FROM k GROUP BY slot, key, ingest
UNION ALL SELECT slot, ingest, array_to_string(filters, ',') FROM u WHERE kind = 'error'
"""
)
def resume_dedup(spark, sf_dir):
    """Two overlapping reads: each filter gets an update once. Errors have no key and always pass."""
    e = adapters.slot_events(spark, sf_dir)
    read = lambda cond, shift, *names: e.where(cond).select("slot", (F.col("event_id") + shift).alias("ingest"), "user_id", "kind", F.array(*map(F.lit, names)).alias("filters"))
    u = read("event_id < 6000", 0, "a", "b").unionByName(read("event_id >= 5000", 100000, "b", "c"))
    u = u.withColumn("dedup_key", F.when(F.col("kind") != "error", resume.dedup_key(F.col("kind"), F.col("user_id"))))
    return resume.drop_repeats(u).select("slot", "ingest", F.array_join("filters", ",").alias("filters"))


@on_banks("""
, s AS (SELECT slot, CASE WHEN bool_or(kind = 'purchase') AND slot % 100 <> 50 THEN 'complete' ELSE 'open' END AS state FROM ev GROUP BY slot)
SELECT least(min(CASE WHEN state = 'open' THEN slot END), max(CASE WHEN state = 'complete' THEN slot END)) AS checkpoint FROM s
""")
def resume_checkpoint(spark, sf_dir):
    """Where a resumed read may start: before the oldest open slot."""
    e = adapters.slot_events(spark, sf_dir).groupBy("slot").agg(F.max((F.col("kind") == "purchase").cast("int")).alias("done"))
    state = F.when((F.col("done") == 1) & (F.col("slot") % 100 != 50), "complete").otherwise("open")
    return resume.checkpoint(e.select("slot", state.alias("state")))


@on_banks("""
, m AS (SELECT slot, event_id, max(slot) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM ev)
SELECT high AS slot, FALSE AS final FROM m WHERE slot > high
UNION ALL SELECT max(slot), TRUE FROM m
""")
def passthrough_watermark(spark, sf_dir):
    """A marker whenever the slot rises, and one at the end."""
    e = adapters.slot_events(spark, sf_dir).select("slot", F.col("event_id").alias("ingest"))
    return resume.passthrough_markers(e)


@on_banks("""
, m AS (SELECT slot, kind, lag(kind) OVER (PARTITION BY slot ORDER BY event_id) AS b FROM ev WHERE kind IN ('signup', 'purchase'))
SELECT slot, count(CASE WHEN kind = 'signup' AND b = 'purchase' THEN 1 END) AS restarts FROM m GROUP BY slot
""")
def restart_count(spark, sf_dir):
    """How often a slot starts again after its end (signups stand for starts, purchases for ends)."""
    e = adapters.slot_events(spark, sf_dir).where(F.col("kind").isin("signup", "purchase"))
    mark = F.when(F.col("kind") == "signup", "start").otherwise("end")
    return resume.restarts(e.select("slot", mark.alias("mark"), F.col("event_id").alias("ingest")))


@on_banks("""
, m AS (SELECT slot % 8 AS partition, slot FROM ev WHERE kind = 'purchase')
SELECT max(slot) AS slot FROM m
""")
def last_committed_slot(spark, sf_dir):
    """Startup scan: the highest slot of the JSON markers of all partitions."""
    e = adapters.slot_events(spark, sf_dir).where("kind = 'purchase'")
    markers = e.select((F.col("slot") % 8).alias("partition"), F.to_json(F.struct("slot", F.lit("commit").alias("marker"))).alias("value"))
    return resume.last_committed(markers)


@on_banks("""
SELECT slot, slot % 4 AS bank FROM bk WHERE slot + 1 IN (SELECT slot FROM bk WHERE confirmed) AND slot % 2 = 0
""")
def inferred_commits(spark, sf_dir):
    """A confirmed child commits the one bank that it names by blockhash."""
    b = adapters.banks(spark, sf_dir).select("slot", (F.col("slot") % 4).alias("bank_id"), (F.col("confirmed") & (F.col("slot") % 2 == 1)).alias("confirmed"))
    hash_ = lambda s: F.concat(F.lit("h"), s)
    # odd slots have two candidates with the hash that the child names
    twin = b.where("slot % 2 = 1").withColumn("bank_id", F.col("bank_id") + 4).withColumn("confirmed", F.lit(False))
    b = b.unionByName(twin).select("slot", "bank_id", hash_(F.col("slot")).alias("blockhash"), (F.col("slot") - 1).alias("parent_slot"), hash_(F.col("slot") - 1).alias("parent_blockhash"), F.col("confirmed").alias("committed"))
    return slots.inferred_commits(b).select("slot", F.col("bank_id").alias("bank"))


@on_banks("""
, a AS (SELECT slot, parent, expected, expected - CASE WHEN slot = 1200 THEN 1 ELSE 0 END AS processed, slot % 97 <> 5 OR slot < 1500 AS committed FROM bk),
live AS (SELECT *, lag(slot) OVER (ORDER BY slot) AS prev FROM a),
cut AS (SELECT min(slot) AS c FROM live WHERE NOT (processed >= expected AND committed AND (prev IS NULL OR parent <= prev)))
SELECT slot, processed, CASE WHEN c IS NULL OR slot < c THEN 'flushed' ELSE 'held' END AS state FROM live, cut
""")
def account_gated_flush(spark, sf_dir):
    """Accounts have a gate and a frontier of their own: the frozen number and a commitment."""
    b = adapters.banks(spark, sf_dir).withColumn("discarded", F.lit(None).cast("string"))
    b = b.withColumns({"processed": F.col("expected") - F.when(F.col("slot") == 1200, 1).otherwise(0), "committed": (F.col("slot") % 97 != 5) | (F.col("slot") < 1500)})
    return slots.gated(b, slots.account_gate()).select("slot", "processed", "state")


@on_banks("SELECT kind, count(*) AS n FROM ev WHERE kind IN ('view', 'click', 'purchase') GROUP BY kind UNION ALL SELECT 'at_commitment', count(*) FROM ev WHERE kind = 'click'")
def slot_status_filter(spark, sf_dir):
    """Statuses by commitment, or all levels; other events stand for statuses between slots."""
    names = F.create_map(*[F.lit(x) for x in ("view", "processed", "click", "confirmed", "purchase", "finalized", "error", "dead", "signup", "completed")])
    e = adapters.slot_events(spark, sf_dir).withColumn("status", names[F.col("kind")])
    levels = e.where(SlotPart(False).column("confirmed")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    one = e.where(SlotPart().column("confirmed")).agg(F.lit("at_commitment").alias("kind"), F.count(F.lit(1)).alias("n"))
    return levels.unionByName(one)


@on_banks("""
SELECT slot, count(*) FILTER (fee_payer % 10 < 3) AS n, coalesce(CAST(sum(lamports) FILTER (fee_payer % 10 < 3) AS BIGINT), 0) AS lamports FROM tx GROUP BY slot
""")
def block_contents(spark, sf_dir):
    """Blocks with the transactions of some keys; accounts and entries aren't asked for and stay unread."""
    t = adapters.headers(spark, sf_dir)
    tx = F.struct(F.array((F.col("fee_payer") % 10).cast("string")).alias("account_keys"), "lamports")
    blocks = t.groupBy("slot").agg(F.collect_list(tx).alias("transactions")).withColumns({"accounts": F.array(), "entries": F.array()})
    b = BlockPart(accounts_include=frozenset("012"), include_transactions=True).project(blocks)
    return b.select("slot", F.size("transactions").cast("bigint").alias("n"), F.aggregate("transactions", F.lit(0).cast("bigint"), lambda a, x: a + x["lamports"]).alias("lamports"))


@on_banks("""
, s AS (SELECT DISTINCT slot FROM tx), p AS (SELECT slot, lag(slot) OVER (ORDER BY slot) AS parent FROM s)
SELECT unnest(generate_series(parent + 1, slot - 1)) AS slot FROM p WHERE slot - parent > 1
""")
def leader_skips(spark, sf_dir):
    """Slots without a block, between a block and its parent."""
    b = adapters.banks(spark, sf_dir).where("parent >= 0").select("slot", F.col("parent").alias("parent_slot"))
    return replay.possible_leader_skips(b)


@on_banks("""
, e AS (SELECT 'account' AS update, CAST(c_custkey AS VARCHAR) AS key, c_nationkey AS owner FROM customer WHERE c_nationkey IN (3, 4, 5)
        UNION ALL SELECT 'slot', 'finalized', NULL)
SELECT * FROM e
""")
def snapshot_scan(spark, sf_dir):
    """A snapshot as updates: one finalised status, then the accounts of the owners asked for."""
    owners = spark.createDataFrame([(3, "p"), (4, "p"), (5, "q"), (5, "p")], "owner bigint, parser string")
    u = replay.snapshot(adapters.accounts(spark, sf_dir), owners)
    return u.select("update", F.coalesce(F.col("pubkey").cast("string"), "status").alias("key"), F.col("owner").cast("int").alias("owner"))
