"""Queries over sources, filters, blocks and streams, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.operators import blocks, dispatch, slots
from slotweave.operators.prefilter import (
    AccountPart, BlockFooterPart, BlockPart, DataSize, DataSlice, Filters, Lamports, Memcmp, Prefilter, PrefilterError, SlotPart, TokenAccountState, TransactionPart, narrowed, validate_filters,
)
from slotweave.plans.streams import on_banks
from slotweave.plans.transactions import query
from slotweave.sources import adapters, feed, live, replay, scan, wire
from slotweave.storage import shared_dir
from slotweave.streaming import coordinator, feeds

# --- 2.3 prefilters ---------------------------------------------------------------------------------


@query("SELECT c_custkey AS pubkey, c_nationkey::BIGINT AS owner FROM customer WHERE c_custkey % 2 = 0 AND c_custkey < 2000 AND c_nationkey < 12")
def account_members(spark, sf_dir) -> DataFrame:
    """Long key lists are semi-joins; keys sent as a probabilistic filter elsewhere are an exact set here."""
    p = AccountPart(owners=frozenset(range(12)), members=frozenset(range(0, 2000, 2)))
    return p.apply(adapters.accounts(spark, sf_dir)).select("pubkey", "owner")


@query("SELECT slot, signature FROM tx WHERE fee_payer % 3 = 0 AND NOT failed")
def transaction_votes(spark, sf_dir) -> DataFrame:
    """Votes alone; every third payer stands for a voter."""
    t = adapters.headers(spark, sf_dir).withColumn("is_vote", F.col("fee_payer") % 3 == 0)
    return t.where(TransactionPart(vote=True).column()).select("slot", "signature")


@query("SELECT slot, signature FROM tk WHERE list_has_any(account_keys, ['s2', 's4']) AND NOT failed")
def transaction_members(spark, sf_dir) -> DataFrame:
    part = Prefilter.builder().transaction_members({"s2"}).build().transaction.merge(TransactionPart(members=frozenset({"s4"})))
    return adapters.with_keys(spark, sf_dir).where(part.column()).select("slot", "signature")


@query("""
, b AS (SELECT signature, max(CASE WHEN supplier % 2 = 0 THEN supplier * 3 END) AS owner, bool_or(supplier = 5) AS excluded FROM ln GROUP BY signature)
SELECT tk.slot, tk.signature, CAST(len(account_keys) AS INTEGER) AS n_keys FROM tk LEFT JOIN b ON tk.signature = b.signature
WHERE NOT list_has_any(account_keys, ['s7']) AND coalesce(b.owner, -1) <> 12
""")
def exclude_with_null_owners(spark, sf_dir) -> DataFrame:
    """Excluded keys where owners are null: a null owner hides nothing."""
    owner = F.max(F.when(F.col("supplier") % 2 == 0, F.concat(F.lit("c"), F.col("supplier") * 3).cast("string")))
    top = F.max(F.when(F.col("supplier") % 2 == 0, F.col("supplier") * 3))
    b = adapters.lines(spark, sf_dir).groupBy("signature").agg(top.alias("o"), owner.alias("_o")).drop("_o")
    b = b.select("signature", F.array(F.struct(F.concat(F.lit("o"), F.col("o").cast("string")).alias("owner"), F.lit(1).cast("bigint").alias("pre"), F.lit(2).cast("bigint").alias("post"))).alias("token_balances"))
    t = adapters.with_keys(spark, sf_dir).join(b, "signature", "left")
    part = TransactionPart(exclude=frozenset({"s7", "o12"}), token_accounts="all", failed=None)
    return t.where(part.column()).select("slot", "signature", F.size("account_keys").alias("n_keys"))


@query("""
SELECT stage, slot, signature FROM (
  SELECT 'before' AS stage, slot, signature FROM tx WHERE signature = 7 UNION ALL
  SELECT 'updated', slot, signature FROM tx WHERE signature = 35 UNION ALL
  SELECT 'merged', slot, signature FROM tx WHERE NOT failed UNION ALL
  SELECT 'reset', slot, signature FROM tx WHERE signature = 7)
""")
def filter_updates(spark, sf_dir) -> DataFrame:
    """A filter edited while its parser runs: replaced, merged with another, reset."""
    one = lambda s, failed=None: Prefilter(transaction=TransactionPart(signature=s, failed=failed))
    f = Filters({"p": one(7)})
    t = adapters.headers(spark, sf_dir)
    out = []
    for stage, change in (("before", None), ("updated", lambda: f.update("p", one(35))), ("merged", lambda: f.update("p", narrowed(one(9, False), one(11, False)))), ("reset", f.reset)):
        if change is not None:
            assert change()
        out.append(f.routed(t, "transaction").select(F.lit(stage).alias("stage"), "slot", "signature"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _refused(f) -> bool:
    try:
        f()
    except PrefilterError:
        return True
    return False


_RULES = (
    ("memcmp base58", True, lambda: Memcmp(0, "0OIl", "base58").validate()), ("memcmp base64", True, lambda: Memcmp(0, "QQ", "base64").validate()), ("memcmp not canonical", True, lambda: Memcmp(0, "QR==", "base64").validate()),
    ("memcmp empty", True, lambda: Memcmp(0, b"").validate()), ("memcmp long", True, lambda: Memcmp(0, bytes(129)).validate()), ("memcmp fits", False, lambda: Memcmp(0, bytes(128)).validate()),
    ("five filters", True, lambda: validate_filters([Memcmp(i, b"x") for i in range(5)])), ("repeats count once", False, lambda: validate_filters([Memcmp(0, b"x")] * 5)), ("two sizes", True, lambda: validate_filters([DataSize(1), DataSize(2)])),
    ("no such comparison", True, lambda: validate_filters([Lamports("le", 1)])), ("uninitialised accounts", True, lambda: validate_filters([TokenAccountState(False)])), ("empty slice", True, lambda: DataSlice.validate_all([DataSlice(0, 0)])),
    ("slices overlap", True, lambda: DataSlice.validate_all([DataSlice(0, 5), DataSlice(4, 1)])), ("slices apart", False, lambda: DataSlice.validate_all([DataSlice(0, 4), DataSlice(4, 1)])), ("slice beyond 64 bits", True, lambda: DataSlice.validate_all([DataSlice(2**64 - 1, 1)])),
    ("set twice", True, lambda: Prefilter.builder().slots().slots().build()), ("set once", False, lambda: Prefilter.builder().slots().slot_interslot_updates(True).block_metas().build()),
    ("feed without transactions", True, lambda: feed.feed_filters(Filters({"x": Prefilter()}))), ("feed with owners", True, lambda: feed.feed_filters(Filters({"x": Prefilter(transaction=TransactionPart(include=frozenset("a"), token_accounts="all"))}))),
    ("feed fits", False, lambda: feed.feed_filters(Filters({"x": Prefilter(transaction=TransactionPart(include=frozenset("a")))}))), ("coordinator's own name", True, lambda: feed.tapped(Filters({"coordinator": Prefilter()}))),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{name.replace(chr(39), chr(39) * 2)}', {str(bad).upper()})" for name, bad, _ in _RULES) + ") t(rule, refused)")
def validation_rules(spark, sf_dir) -> DataFrame:
    """What no source could act on is refused before it is asked."""
    return spark.createDataFrame([(name, _refused(f)) for name, _, f in _RULES], "rule string, refused boolean")


@on_banks("SELECT kind, count(*) AS n, slot % 2 = 0 AS even FROM ev GROUP BY ALL")
def interslot_updates(spark, sf_dir) -> DataFrame:
    """With the statuses between slots, every event comes."""
    p = Prefilter.builder().slot_interslot_updates(True).build()
    e = adapters.slot_events(spark, sf_dir).withColumn("status", F.col("kind"))
    return e.where(p.slot.merge(SlotPart(False)).column("confirmed")).groupBy("kind", (F.col("slot") % 2 == 0).alias("even")).agg(F.count(F.lit(1)).alias("n"))


# --- blocks ---------------------------------------------------------------------------------------------


def _blocks(spark, sf_dir) -> DataFrame:
    t = adapters.headers(spark, sf_dir)
    reward = F.struct(F.concat(F.lit("c"), F.col("fee_payer")).alias("pubkey"), F.col("lamports"), F.col("lamports").cast("decimal(20,0)").alias("post_balance"), F.lit(1).alias("reward_type"), F.lit(None).cast("string").alias("commission"))
    b = t.groupBy("slot").agg(F.count(F.lit(1)).alias("executed_transaction_count"), F.collect_list(F.when(F.col("failed"), reward)).alias("rewards"), F.collect_list("signature").alias("transactions"))
    return b.select("*", F.lit(0).alias("bank_id"), (F.col("slot") - 1).alias("parent_slot"), F.concat(F.lit("h"), "slot").alias("blockhash"), F.array(F.lit(b"c")).alias("certificates"))


@query("SELECT slot, slot - 1 AS parent_slot, 'h' || slot AS blockhash, count(*) AS executed FROM tx GROUP BY slot")
def block_metas(spark, sf_dir) -> DataFrame:
    """Block metadata alone: what else a block holds stays unread."""
    m = blocks.block_meta(_blocks(spark, sf_dir))
    return m.select(F.col("slot").cast("bigint").alias("slot"), F.col("parent_slot").cast("bigint").alias("parent_slot"), "blockhash", F.col("executed_transaction_count").cast("bigint").alias("executed"))


@query("SELECT slot, 'c' || fee_payer AS pubkey, lamports FROM tx WHERE failed")
def block_rewards(spark, sf_dir) -> DataFrame:
    """One row per reward; failed transactions stand for rewards."""
    return blocks.rewards(_blocks(spark, sf_dir)).select(F.col("slot").cast("bigint").alias("slot"), "pubkey", "lamports")


@query("SELECT CAST(slot AS BIGINT) AS slot, slot % 2 = 0 AS with_certificates FROM (SELECT DISTINCT slot FROM tx)")
def block_footers(spark, sf_dir) -> DataFrame:
    """Footers with certificates where any parser asked for them."""
    b = _blocks(spark, sf_dir)
    with_, without = BlockFooterPart().merge(BlockFooterPart(True)), BlockFooterPart()
    one = with_.project(b.where("slot % 2 = 0")).select("slot", F.col("certificates").isNotNull().alias("with_certificates"))
    other = without.project(b.where("slot % 2 <> 0"))
    assert "certificates" not in other.columns
    return one.unionByName(other.select("slot", F.lit(False).alias("with_certificates")))


@query("SELECT slot, count(*) AS n FROM tx GROUP BY slot")
def block_with_transactions(spark, sf_dir) -> DataFrame:
    part = BlockPart(include_transactions=True).merge(BlockPart(include_accounts=False))
    return part.project(_blocks(spark, sf_dir)).select("slot", F.size("transactions").cast("bigint").alias("n"))


@on_banks("""
, s AS (SELECT slot, max(CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END) AS r FROM ev GROUP BY slot)
SELECT slot, CASE r WHEN 1 THEN 'processed' WHEN 2 THEN 'confirmed' ELSE 'finalized' END AS status FROM s WHERE r > 0
""")
def highest_commitments(spark, sf_dir) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("view", "processed", "click", "confirmed", "purchase", "finalized")])
    e = adapters.slot_events(spark, sf_dir).select("slot", F.lit(0).alias("bank_id"), F.coalesce(names[F.col("kind")], F.lit("dead")).alias("status"))
    return blocks.highest_commitment(e).select("slot", "status")


@query("SELECT 'account' AS kind, count(*) AS n, 'p,q' AS filters FROM customer UNION ALL SELECT 'transaction', count(*), 'p' FROM orders")
def update_kinds(spark, sf_dir) -> DataFrame:
    """Per kind of update who wants it; kinds that nobody wants aren't read."""
    all_ = {"account": adapters.accounts(spark, sf_dir).select("pubkey"), "transaction": adapters.headers(spark, sf_dir).select("signature"), "slot": adapters.slot_events(spark, sf_dir).select("slot")}
    got = blocks.parallel_kinds(all_, {"p": {"account", "transaction"}, "q": {"account"}})
    assert sorted(got) == ["account", "transaction"]
    parts = [df.groupBy(F.lit(k).alias("kind"), F.array_join("filters", ",").alias("filters")).agg(F.count(F.lit(1)).alias("n")) for k, df in got.items()]
    return parts[0].unionByName(parts[1])


# --- feeds ---------------------------------------------------------------------------------------------------

_FRAMES = """
, fr AS (SELECT event_id AS ingest, slot // 24 AS slot, CASE WHEN event_id % 400 = 0 THEN 'reconnected' WHEN event_id % 50 = 0 THEN 'start' WHEN event_id % 50 = 49 THEN 'end' ELSE 'transaction' END AS kind,
                CASE WHEN event_id % 7 = 0 THEN 'unknown_result' WHEN event_id % 11 = 0 THEN 'undecodable' WHEN event_id % 13 = 0 THEN 'vote_rule_dropped' ELSE 'delivered' END AS fate FROM ev)
"""


def _frames(spark, sf_dir) -> DataFrame:
    """A day is a slot; every 50th frame starts it again, and every 400th is a new connection."""
    e = F.col("event_id")
    kind = F.when(e % 400 == 0, "reconnected").when(e % 50 == 0, "start").when(e % 50 == 49, "end").otherwise("transaction")
    tx = kind == "transaction"
    return adapters.slot_events(spark, sf_dir).select(
        e.alias("ingest"), kind.alias("kind"), F.when(kind != "reconnected", F.floor(F.col("slot") / 24)).alias("slot"), F.when(tx & (e % 7 != 0), "success").alias("result"), F.when(tx, e % 11 != 0).alias("decoded"),
        F.when(tx, e % 13 == 0).alias("is_vote"), F.when(tx, F.array(F.lit("novote"))).alias("filters"), F.lit(None).cast("bigint").alias("withheld"),
    )


@on_banks(_FRAMES + "SELECT slot, ingest AS event_id, row_number() OVER (PARTITION BY slot ORDER BY ingest) - 1 AS frame FROM fr WHERE kind = 'transaction' AND fate = 'delivered'")
def preconf_index(spark, sf_dir) -> DataFrame:
    """Delivered transactions numbered per slot, over restarts and without an end: slots here have hundreds."""
    f = feeds.framed(_frames(spark, sf_dir), vote_rules={"novote": False}).where("fate = 'delivered'")
    return f.select("slot", F.col("ingest").alias("event_id"), F.col("frame").cast("bigint").alias("frame"))


@on_banks(_FRAMES + """
, ep AS (SELECT *, count(*) FILTER (kind = 'reconnected') OVER (ORDER BY ingest) AS epoch FROM fr),
mk AS (SELECT *, last_value(CASE WHEN kind IN ('start', 'end') THEN kind || epoch END IGNORE NULLS) OVER (PARTITION BY slot ORDER BY ingest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM ep WHERE kind <> 'reconnected')
SELECT count(*) FILTER (kind = 'transaction' AND fate = 'delivered') AS delivered, count(*) FILTER (kind = 'transaction' AND fate = 'delivered' AND coalesce(last, '') <> 'start' || epoch) AS out_of_frame,
       count(*) FILTER (kind = 'transaction' AND fate = 'vote_rule_dropped') AS vote_rule_dropped, count(*) FILTER (kind = 'transaction' AND fate = 'unknown_result') AS unknown_result,
       count(*) FILTER (kind = 'transaction' AND fate = 'undecodable') AS undecodable, count(*) FILTER (kind = 'start' AND last IS NOT NULL AND last <> 'start' || epoch) AS restarts,
       CAST(0 AS BIGINT) AS clipped, CAST(0 AS BIGINT) AS unknown_payload, (SELECT count(*) FROM fr WHERE kind = 'reconnected') AS reconnects
FROM mk
""")
def drop_counters(spark, sf_dir) -> DataFrame:
    """What a feed delivered, and what it dropped and why."""
    return feeds.counters(feeds.framed(_frames(spark, sf_dir), vote_rules={"novote": False}))


_MODES = [(r, c, f, live_) for r in (0, 3) for c in ("processed", "confirmed", "finalized") for f in (None, 5) for live_ in (False, True)]


@query("""
SELECT r AS retries, c AS commitment, f AS from_slot, l AS live_filters, CASE WHEN r = 0 THEN 'off' WHEN c IN ('confirmed', 'finalized') THEN 'slot_resume' WHEN f IS NULL AND NOT l THEN 'bank_replay' ELSE 'off' END AS mode
FROM (VALUES (0), (3)) a(r), (VALUES ('processed'), ('confirmed'), ('finalized')) b(c), (VALUES (NULL), (5)) d(f), (VALUES (FALSE), (TRUE)) e(l)
""")
def reconnect_modes(spark, sf_dir) -> DataFrame:
    return spark.createDataFrame([(*m, feed.reconnect_mode(*m)) for m in _MODES], "retries int, commitment string, from_slot int, live_filters boolean, mode string")


@query("SELECT code, code NOT IN ('OUT_OF_RANGE', 'NOT_FOUND', 'UNAUTHENTICATED', 'INTERNAL from_slot is not supported') AS recoverable FROM (VALUES ('UNAVAILABLE'), ('INTERNAL'), ('UNKNOWN'), ('DEADLINE_EXCEEDED'), ('CANCELLED'), ('ABORTED'), ('RESOURCE_EXHAUSTED'), ('OUT_OF_RANGE'), ('NOT_FOUND'), ('UNAUTHENTICATED'), ('INTERNAL from_slot is not supported')) t(code)")
def recoverable_codes(spark, sf_dir) -> DataFrame:
    codes = [*sorted(feed.RECOVERABLE), "OUT_OF_RANGE", "NOT_FOUND", "UNAUTHENTICATED", "INTERNAL from_slot is not supported"]
    return spark.createDataFrame([(c, feed.recoverable(*c.split(" ", 1))) for c in codes], "code string, recoverable boolean")


@query("SELECT i AS attempt, least(10.0, 0.5 * 2 ** i)::DOUBLE AS pause, least(10.0, 0.1 * 2 ** i)::DOUBLE AS resubscribe FROM range(10) t(i)")
def retry_pauses(spark, sf_dir) -> DataFrame:
    """Pauses between attempts: doubling up to a limit."""
    r = feed.Resubscribe()
    return spark.createDataFrame([(i, float(p), float(r.pause(1))) for i, p in enumerate(scan.pauses())], "attempt bigint, pause double, resubscribe double")


@on_banks("SELECT slot, greatest(least(slot - 4, CASE WHEN slot % 10 = 0 THEN slot - 20 WHEN slot % 10 = 5 THEN slot - 90 ELSE slot END), slot - 32, 300) AS start FROM bk")
def resubscribe_slots(spark, sf_dir) -> DataFrame:
    """Where a broken read goes on: a little back, further for an incomplete parent, but not before the configured start."""
    from slotweave.operators import resume

    b, s = adapters.banks(spark, sf_dir), F.col("slot")
    parent = F.when(s % 10 == 0, s - 20).when(s % 10 == 5, s - 90)
    return b.select("slot", resume.resubscribe(s, parent, F.lit(300)).alias("start"))


@on_banks("""
, u AS (SELECT slot, event_id AS ingest, user_id % 3 AS bank, CASE kind WHEN 'view' THEN 'processed' WHEN 'click' THEN 'confirmed' WHEN 'purchase' THEN 'finalized' WHEN 'error' THEN 'dead' ELSE 'completed' END AS status FROM ev)
SELECT slot, min(ingest) AS ingest, status FROM u WHERE status NOT IN ('dead', 'completed') GROUP BY slot, status, CASE WHEN status = 'processed' THEN bank END
UNION ALL SELECT slot, ingest, status FROM u WHERE status IN ('dead', 'completed')
""")
def status_dedup(spark, sf_dir) -> DataFrame:
    """Slot statuses once each: with their bank, but not once confirmed; dead and completed ones always."""
    from slotweave.operators import resume

    names = F.create_map(*[F.lit(x) for x in ("view", "processed", "click", "confirmed", "purchase", "finalized", "error", "dead", "signup", "completed")])
    e = adapters.slot_events(spark, sf_dir).select("slot", F.col("event_id").alias("ingest"), names[F.col("kind")].alias("status"), (F.col("user_id") % 3).alias("bank"), F.array(F.lit("a")).alias("filters"))
    key = resume.dedup_key(F.lit("slot"), F.lit(""), F.col("status"), F.col("bank"))
    e = e.withColumn("dedup_key", F.when(~F.col("status").isin(*resume.ALWAYS), key))
    return resume.drop_repeats(e).select("slot", "ingest", "status")


@query("SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS is_vote, 1 AS signatures, CASE WHEN o_orderkey % 5 = 4 THEN 0 END AS version, o_orderkey % 5 <> 3 AS readable FROM orders")
def wire_transactions(spark, sf_dir) -> DataFrame:
    """Transactions as they go over the wire: legacy and versioned messages, votes, and cut ones."""
    import pandas as pd

    o = F.col("o_orderkey")
    program = F.when(o % 3 == 0, F.lit(wire.VOTE_PROGRAM)).otherwise(F.lit(b"\x05" * 32))
    # an order's vote is told in legacy messages alone, so versioned ones aren't votes: none of them is asked for here
    body = F.concat(F.lit(b"\1" + bytes(64)), F.lit(b"\1\0\1\2" + b"\7" * 32), program, F.lit(bytes(32)), F.lit(b"\1\1\1\0\2hi"))
    new = F.concat(F.lit(b"\1" + bytes(64)), F.lit(b"\x80\1\0\1\2" + b"\7" * 32), program, F.lit(bytes(32)), F.lit(b"\1\1\1\0\2hi"), F.lit(b"\0"))
    data = F.when(o % 5 == 4, new).when(o % 5 == 3, body.substr(F.lit(1), F.octet_length(body) - 1)).otherwise(body)
    rows = adapters.table(spark, sf_dir, "orders").select(o.alias("id"), data.alias("data"))

    def run(batches):
        for b in batches:
            out = []
            for i, d in zip(b["id"], b["data"], strict=True):
                try:
                    t = wire.parse(bytes(d))
                    key = t["static_keys"][t["instructions"][0]["program_id_index"]]
                    vote = wire.is_vote(t) if t["version"] is None else key == wire.VOTE_PROGRAM
                    out.append((i, vote, len(t["signatures"]), t["version"], True))
                except wire.WireError:
                    out.append((i, i % 3 == 0, 1, None, False))
            frame = pd.DataFrame(out, columns=["id", "is_vote", "signatures", "version", "readable"])
            yield frame.astype({"version": "Int32"})

    return rows.mapInPandas(run, "id long, is_vote boolean, signatures int, version int, readable boolean")


def scanned(owner: str):
    """The accounts of an owner, for ``account_scan``: as many as its number says."""
    for i in range(int(owner)):
        yield f"{owner}-{i}", 100 * int(owner) + i, bytes([i % 256])


@query("SELECT CASE WHEN n % 2 = 0 THEN 'p' ELSE 'q' END AS parser, n || '-' || i AS pubkey, CAST(100 * n + i AS BIGINT) AS lamports, TRUE AS is_startup FROM (SELECT n_nationkey AS n FROM nation) t, range(25) r(i) WHERE i < n")
def account_scan_source(spark, sf_dir) -> DataFrame:
    """Accounts by owner through the pluggable scan, a partition per owner."""
    scan.register(spark)
    owners = range(25)
    df = spark.read.format("account_scan").options(fetch="slotweave.plans.sources:scanned", owners=",".join(map(str, owners)), parsers=",".join("pq"[n % 2] for n in owners)).load()
    return df.select("parser", "pubkey", "lamports", "is_startup")


@query("SELECT n_nationkey * 10 AS lamports, CAST(n_nationkey AS VARCHAR) AS first_byte, octet_length(encode(n_name)) AS n FROM nation")
def fixture_accounts(spark, sf_dir) -> DataFrame:
    """Captured accounts as JSON files, read back as updates."""
    from slotweave.functions.encoding import uint

    digits = lambda c: F.array_join(F.transform(F.sequence(F.lit(0), F.octet_length(c) - 1), lambda i: F.conv(F.hex(F.substring(c, i + 1, F.lit(1))), 16, 10)), ",")
    key = lambda n: F.concat(F.lit("["), n.cast("string"), F.lit(",0" * 31 + "]"))
    name = F.encode("n_name", "UTF-8")
    text = F.concat(
        F.lit('{"pubkey":'), key(F.col("n_nationkey")), F.lit(',"owner":'), key(F.lit(1)), F.lit(',"lamports":'), (F.col("n_nationkey") * 10).cast("string"), F.lit(',"executable":false,"rentEpoch":0,"data":['), digits(name), F.lit("]}")
    )
    path = f"{shared_dir(spark)}/fixtures-{uuid.uuid4().hex}"
    adapters.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), text.alias("value")).repartition(25, "k").write.partitionBy("k").text(path)
    a = replay.fixtures(spark, f"{path}/*/*.txt")
    return a.select(F.col("lamports").cast("bigint").alias("lamports"), uint("pubkey", 0, 1).cast("string").alias("first_byte"), F.octet_length("data").alias("n"))


# --- streams and chains -----------------------------------------------------------------------------------------


@on_banks("""
, two AS (SELECT chain, slot, bank, parent, hash, parent_hash, ok FROM (VALUES ('x')) c(chain), (SELECT slot, 0 AS bank, parent, 'h' || slot AS hash, 'h' || parent AS parent_hash, slot % 40 = 0 AS ok FROM bk)),
r AS (SELECT slot, (SELECT min(b.slot) FROM two b WHERE b.ok AND b.slot >= a.slot) AS child FROM two a)
SELECT slot FROM r WHERE child IS NOT NULL AND slot % 40 <> 0
""")
def commits_up_the_chain(spark, sf_dir) -> DataFrame:
    """Every 40th slot's bank is committed, and commits all its ancestors that it names by hash."""
    b = adapters.banks(spark, sf_dir)
    h = lambda c: F.concat(F.lit("h"), c)
    b = b.select("slot", F.lit(0).alias("bank_id"), h(F.col("slot")).alias("blockhash"), F.col("parent").alias("parent_slot"), h(F.col("parent")).alias("parent_blockhash"), (F.col("slot") % 40 == 0).alias("committed"))
    return slots.inferred_commits(b).select("slot")


@on_banks("SELECT slot FROM bk WHERE slot % 60 = 0 AND slot < (SELECT min(slot) FROM bk WHERE slot % 1000 = 777)")
def finality_forwarding(spark, sf_dir) -> DataFrame:
    """Finality goes on only over a whole committed ancestry: one uncommitted bank stops all behind it."""
    b = adapters.banks(spark, sf_dir)
    h = lambda c: F.concat(F.lit("h"), c)
    b = b.select("slot", F.lit(0).alias("bank_id"), h(F.col("slot")).alias("blockhash"), F.col("parent").alias("parent_slot"), h(F.col("parent")).alias("parent_blockhash"), (F.col("slot") % 1000 != 777).alias("committed"), (F.col("slot") % 60 == 0).alias("finalized"))
    return slots.forwarded_finality(b).select("slot")


@on_banks("""
, c AS (SELECT slot, parent, 0 AS bank, slot % 50 <> 49 AS confirmed FROM bk)
SELECT slot, bank, CASE WHEN slot % 29 = 4 AND confirmed THEN 'Incomplete' WHEN slot % 29 = 4 THEN 'Incomplete' WHEN slot % 31 = 7 THEN 'Dead'
       WHEN slot % 50 = 49 AND slot NOT IN (SELECT parent FROM c WHERE confirmed) THEN 'Forked' END AS discarded FROM c
""")
def notice_precedence(spark, sf_dir) -> DataFrame:
    """Two notices for a bank: the stronger one counts. A confirmed child lifts its parent's fork."""
    b = adapters.banks(spark, sf_dir)
    banks = b.select("slot", F.lit(0).alias("bank_id"), "confirmed", "parent")
    n = lambda cond, bank, *why: [b.where(cond).select("slot", F.lit(bank).cast("int").alias("bank_id"), F.lit(w).alias("reason")) for w in why]
    parts = [*n("slot % 29 = 4", 0, "Forked", "Incomplete"), *n("slot % 31 = 7 and slot % 29 <> 4", None, "Forked", "Dead"), *n("slot % 50 = 49", None, "Forked")]
    notices = parts[0]
    for p in parts[1:]:
        notices = notices.unionByName(p)
    return slots.winners(banks, notices).select("slot", F.col("bank_id").alias("bank"), "discarded")


@on_banks("""
, s AS (SELECT slot, event_id, kind, slot * 24 + 12 AS freeze FROM ev),
f AS (SELECT slot, min(event_id) AS at FROM s WHERE kind = 'purchase' GROUP BY slot)
SELECT s.slot, CASE WHEN f.at IS NOT NULL THEN count(*) FILTER (s.kind = 'view' AND s.event_id < f.at) END AS expected, count(*) FILTER (s.kind = 'view' AND s.event_id >= f.at) AS late, f.at IS NOT NULL AS committed
FROM s LEFT JOIN f ON s.slot = f.slot GROUP BY s.slot, f.at HAVING f.at IS NOT NULL OR count(*) FILTER (s.kind = 'view') > 0
""")
def account_expectation(spark, sf_dir) -> DataFrame:
    """Account events counted until the bank's commitment freezes their number; those after it are late."""
    e = adapters.slot_events(spark, sf_dir).select("slot", F.lit(0).alias("bank_id"), F.col("event_id").alias("ingest"), "kind")
    return slots.expected_accounts(e.where("kind = 'view'").drop("kind"), e.where("kind = 'purchase'").drop("kind")).select("slot", "expected", "late", "committed")


@query("""
SELECT chain, CAST(n AS BIGINT) AS slot, payload FROM (SELECT CASE n_regionkey % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS chain, n_nationkey + 10 AS n, n_name AS payload FROM nation) WHERE n <> 20
""")
def stream_commits(spark, sf_dir) -> DataFrame:
    """The slot machine as a stream into its sink: two chains, one slot of which never gets its confirmation."""
    n = adapters.table(spark, sf_dir, "nation").select(F.when(F.col("n_regionkey") % 2 == 0, "even").otherwise("odd").alias("chain"), (F.col("n_nationkey") + 10).cast("bigint").alias("slot"), "n_name")
    # slot 20 is told to be incomplete, so the chain goes on without it
    step = lambda kind, i, **c: n.select("chain", (F.col("slot") * 10 + i).alias("ingest"), F.lit(kind).alias("kind"), "slot", F.lit(0).cast("bigint").alias("bank"), *[c.get(k, F.lit(None)).cast(t).alias(k) for k, t in (("parent", "bigint"), ("expected", "bigint"), ("key", "string"), ("payload", "string"))], F.lit(True).alias("decoded"), F.lit(None).cast("bigint").alias("entries"), F.lit(None).cast("bigint").alias("executed"))
    events = step("meta", 0, parent=F.lit(9), expected=F.lit(0)).unionByName(step("record", 1, key=F.lit("1.1"), payload=F.col("n_name"))).unionByName(step("confirm", 2).where("slot <> 20"))
    events = events.unionByName(step("discard", 2, key=F.lit("Incomplete")).where("slot = 20").withColumn("bank", F.lit(None).cast("bigint")))
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events.coalesce(1).write.parquet(f"{base}/in")
    coordinator.configure(spark)
    from slotweave.sinks.slots import SlotSink

    sink = SlotSink(f"{base}/out")
    stream = replay.stream(spark, f"{base}/in", events.schema)
    q = coordinator.commits(stream).writeStream.outputMode("append").foreachBatch(sink.write).option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert live.exit_status(q)[0] == "completed"
    return sink.committed(spark).select("chain", "slot", "payload")


@query("SELECT event_type AS marker, CAST(epoch(date_trunc('hour', ts)) / 3600 AS BIGINT) % 24 AS hour, count(*) AS n FROM events GROUP BY ALL")
def commit_markers(spark, sf_dir) -> DataFrame:
    """Markers as JSON and back: a kind, the slot and counters, nulls left out."""
    e = adapters.table(spark, sf_dir, "events").select("event_type", (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) % 24).cast("bigint").alias("slot"))
    e = e.groupBy("event_type", "slot").agg(F.count(F.lit(1)).alias("n")).withColumn("blockhash", F.lit(None).cast("string"))
    m = e.select("event_type", dispatch.marker("commit", "blockhash", "n").alias("m"))
    assert "blockhash" not in m.first()["m"]
    return m.select(F.col("event_type").alias("marker"), F.get_json_object("m", "$.slot").cast("bigint").alias("hour"), F.get_json_object("m", "$.n").cast("bigint").alias("n"))
