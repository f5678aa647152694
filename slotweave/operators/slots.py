"""Ordered, fork-aware, gated commits per slot, as batch operators.

A *bank* is a candidate block of a slot. A slot commits when its one confirmed bank has its
metadata and all its transactions are parsed; slots commit in ascending order, and the
first live slot that isn't ready holds back all behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.operators.ordered import with_previous
from slotweave.storage import stored

#: Reasons that drop a bank, the strongest first. An incomplete bank stays one whatever else is said of it;
#: a fork is the weakest, as a confirmation of the bank or of its child lifts it.
DISCARDS = ("Incomplete", "Dead", "Cleared", "Forked")


def _strongest(reason: Column) -> Column:
    """Aggregate: of several notices the one that counts; unknown reasons come behind all."""
    rank = F.array_position(F.array(*map(F.lit, DISCARDS)), reason)
    return F.min_by(reason, F.when(rank > 0, rank).otherwise(len(DISCARDS) + 1))


def winners(banks: DataFrame, notices: DataFrame | None = None) -> DataFrame:
    """Banks with ``discarded``: the reason, or null for a live one.

    ``banks``: slot, bank_id, confirmed, and parent where it is known; ``notices``: slot,
    bank_id (null: all of the slot's banks), reason, any number for a bank.

    Of a slot with a confirmed bank all others are ``Unconfirmed``. A confirmed bank that
    froze incomplete ends its slot. A fork notice gives way to a confirmation of the bank,
    and of a slot with metadata to that of a child that names it as parent.
    """
    ok = banks.where("confirmed").groupBy("slot").agg(F.min("bank_id").alias("winner"), F.count(F.lit(1)).alias("_n"))
    two = F.raise_error(F.concat(F.lit("two confirmed banks in slot "), F.col("slot").cast("string")))
    ok = ok.select("slot", F.when(F.col("_n") > 1, two.cast("bigint")).otherwise(F.col("winner")).alias("winner"))
    out = banks.join(ok, "slot", "left")
    lost = F.when(F.col("winner").isNotNull() & (F.col("winner") != F.col("bank_id")), "Unconfirmed")
    if notices is None:
        return out.withColumn("discarded", lost).drop("winner")
    slotwide = notices.where("bank_id is null").groupBy("slot").agg(_strongest(F.col("reason")).alias("_all"))
    own = notices.where("bank_id is not null").groupBy("slot", "bank_id").agg(_strongest(F.col("reason")).alias("_own"))
    ended = banks.where("confirmed").select("slot", "bank_id").join(own.where("_own = 'Incomplete'"), ["slot", "bank_id"]).select("slot", F.lit(True).alias("_ended"))
    out = out.join(own, ["slot", "bank_id"], "left").join(slotwide, "slot", "left").join(ended, "slot", "left")
    repaired = F.lit(False)
    if "parent" in banks.columns:
        children = banks.where("confirmed").select(F.col("parent").alias("slot"), F.lit(True).alias("_child")).distinct()
        out = out.join(children, "slot", "left")
        repaired = F.coalesce(F.col("_child") & F.col("parent").isNotNull(), F.lit(False))
    of_slot = F.when(F.col("_ended") & (F.col("_all").isNull() | (F.col("_all") == "Forked")), "Incomplete").otherwise(F.col("_all"))
    fork_stands = lambda lifted: ~F.coalesce(lifted, F.lit(False)) & ~repaired
    mine = F.when((F.col("_own") != "Forked") | fork_stands(F.col("confirmed")), F.col("_own"))
    all_ = F.when((of_slot != "Forked") | fork_stands(F.col("winner").isNotNull()), of_slot)
    return out.withColumn("discarded", F.coalesce(F.when(all_ == "Incomplete", all_), mine, all_, lost)).select(*banks.columns, "discarded")


def instruction_gate() -> Column:
    """Metadata there, every transaction parsed, bank confirmed."""
    return F.col("expected").isNotNull() & (F.coalesce("parsed", F.lit(0)) >= F.col("expected")) & F.col("confirmed")


def account_gate() -> Column:
    """The expected number frozen, as many processed, commitment reached."""
    return F.col("expected").isNotNull() & (F.coalesce("processed", F.lit(0)) >= F.col("expected")) & F.col("committed")


def gated(banks: DataFrame, ready: Column) -> DataFrame:
    """``banks`` (slot, parent, discarded, ...) with ``state``: flushed, held or discarded.

    A live slot may follow if it is ready and its parent is at or before the live slot
    before it, or was discarded as incomplete, or (for the first) lies before the stream.
    The first live slot that may not holds itself and all behind it.
    """
    live = with_previous(banks.where("discarded is null"), "slot")
    holes = banks.where("discarded = 'Incomplete'").select(F.col("slot").alias("_hole"))
    live = live.join(holes, F.col("parent") == F.col("_hole"), "left")
    linked = F.when(F.col("prev").isNull(), F.col("parent") < F.col("slot")).otherwise((F.col("parent") <= F.col("prev")) | F.col("_hole").isNotNull())
    live = live.withColumn("_ok", F.coalesce(ready & linked, F.lit(False)))
    # one row: the first slot that holds the queue
    cut = live.where("not _ok").agg(F.min("slot").alias("_cut"))
    state = F.when(F.col("_cut").isNull() | (F.col("slot") < F.col("_cut")), "flushed").otherwise("held")
    live = live.join(F.broadcast(cut)).withColumn("state", state).drop("prev", "_hole", "_ok", "_cut")
    return live.unionByName(banks.where("discarded is not null").withColumn("state", F.lit("discarded")))


def expected_accounts(events: DataFrame, freezes: DataFrame) -> DataFrame:
    """slot, bank_id, expected, late, committed: account events until the gate froze, and those after it.

    ``events``: slot, bank_id, ingest, one row per account event; ``freezes``: slot, bank_id,
    ingest of the statuses at the commitment, of which the first freezes the gate. Banks
    without one have no expected number yet.
    """
    first = freezes.groupBy("slot", "bank_id").agg(F.min("ingest").alias("_at"))
    both = events.select("slot", "bank_id", "ingest").join(first, ["slot", "bank_id"], "full")
    before = F.col("ingest") < F.col("_at")
    n = both.groupBy("slot", "bank_id").agg(F.count_if(before).alias("_n"), F.count_if(~before).alias("late"), F.max("_at").alias("_at"))
    return n.select("slot", "bank_id", F.when(F.col("_at").isNotNull(), F.col("_n")).alias("expected"), "late", F.col("_at").isNotNull().alias("committed"))


def commits(records: DataFrame, keys: tuple[str, ...] = ("slot",), failed: str | None = None, **more: Column) -> DataFrame:
    """Per-slot counters of records: decoded, filtered, errors, fallback, and ``more`` aggregates.

    ``records``: keys, outcome (null: nothing was parsed), fallback. ``failed``: the column
    that says whether the row's transaction failed; its rows then count for nothing but
    ``more``.
    """
    out = F.col("outcome") if failed is None else F.when(~F.col(failed), F.col("outcome"))
    falls = F.col("fallback") if failed is None else F.col("fallback") & ~F.col(failed)
    return records.groupBy(*keys).agg(
        F.count_if(out == "parsed").alias("decoded"),
        F.count_if(out == "filtered").alias("filtered"),
        F.count_if(out == "error").alias("errors"),
        F.count_if(falls).alias("fallback"),
        *[c.alias(name) for name, c in more.items()],
    )


def entry_completeness(entries: DataFrame, meta: DataFrame) -> DataFrame:
    """slot, bank_id, entries, transactions, complete: distinct entries and their transactions as the metadata has them.

    Repeats of an entry count once. More than the metadata says is an overshoot.
    """
    e = entries.groupBy("slot", "bank_id", "index").agg(F.max("executed_transaction_count").alias("n"))
    e = e.groupBy("slot", "bank_id").agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("transactions"))
    m = meta.select("slot", "bank_id", "entries_count", F.col("executed_transaction_count").alias("executed"))
    out = m.join(e, ["slot", "bank_id"], "left").fillna(0, ["entries", "transactions"])
    over = (F.col("entries") > F.col("entries_count")) | (F.col("transactions") > F.col("executed"))
    done = (F.col("entries") == F.col("entries_count")) & (F.col("transactions") == F.col("executed"))
    return out.select("slot", "bank_id", "entries", "transactions", F.when(over, "overshoot").when(done, "complete").otherwise("short").alias("state"))


def ancestry(links: DataFrame, root: Column, key: str = "slot", parent: str = "parent") -> DataFrame:
    """``links`` (key, parent) with ``linked`` and ``depth``: whether and how far below a root a row hangs.

    Pointer doubling: after round k every row knows its ancestor 2**k up, so the rounds
    grow with the logarithm of the depth. A row whose chain breaks is not linked.
    """
    t = links.select(F.col(key).alias("_k"), F.col(parent).alias("_p"), F.coalesce(root, F.lit(False)).alias("_top"))
    jump = stored(t.select("_k", F.when(F.col("_top"), F.col("_k")).otherwise(F.col("_p")).alias("up"), F.when(F.col("_top"), 0).otherwise(1).cast("bigint").alias("depth"), F.col("_top").alias("done")), "ancestry")
    while jump.where("not done and up is not null").limit(1).count():
        above = jump.select(F.col("_k").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("done").alias("_done"))
        step = jump.join(above, "up", "left")
        # an ancestor that isn't there breaks the chain: up becomes null
        moved = F.when(F.col("done"), F.col("up")).otherwise(F.col("_up"))
        depth = F.when(F.col("done"), F.col("depth")).otherwise(F.col("depth") + F.coalesce("_d", F.lit(0)))
        jump = stored(step.select("_k", moved.alias("up"), depth.alias("depth"), (F.col("done") | F.coalesce("_done", F.lit(False))).alias("done")), "ancestry", replaces=jump)
    return links.join(jump.select(F.col("_k").alias(key), F.col("done").alias("linked"), F.when(F.col("done"), F.col("depth")).alias("depth")), key)


def _bank(slot: str = "slot", bank: str = "bank_id") -> Column:
    return F.concat_ws("/", F.col(slot).cast("string"), F.col(bank).cast("string"))


def _linked(banks: DataFrame) -> DataFrame:
    """``banks`` with ``_key`` and ``_up``: the one bank that parent_slot and parent_blockhash name, null if none or several do."""
    named = banks.groupBy(F.col("slot").alias("parent_slot"), F.col("blockhash").alias("parent_blockhash")).agg(F.count(F.lit(1)).alias("_c"), F.min(_bank()).alias("_up"))
    return banks.withColumn("_key", _bank()).join(named.where("_c = 1").drop("_c"), ["parent_slot", "parent_blockhash"], "left")


def inferred_commits(banks: DataFrame) -> DataFrame:
    """slot, bank_id of banks that a committed descendant commits, over any number of generations.

    ``banks``: slot, bank_id, blockhash, parent_slot, parent_blockhash, committed. A committed
    child names its parent by slot and blockhash; only a unique candidate counts. A committed
    bank in the parent's slot that isn't the one named is a conflict, and fails the query.

    Marks go up by pointer doubling, so the rounds grow with the logarithm of the chain.
    """
    links = stored(_linked(banks).select("slot", "bank_id", "_key", "_up", "committed", "parent_slot", "parent_blockhash", "blockhash"), "links")
    state = stored(links.select(F.col("_key").alias("k"), F.col("_up").alias("up"), F.col("committed").alias("marked")), "marks")
    while state.where("up is not null").limit(1).count():
        sent = state.where("marked and up is not null").select(F.col("up").alias("k"), F.lit(True).alias("got")).distinct()
        above = state.select(F.col("k").alias("up"), F.col("up").alias("next"))
        step = state.join(sent, "k", "left").join(above, "up", "left")
        state = stored(step.select("k", F.col("next").alias("up"), (F.col("marked") | F.coalesce("got", F.lit(False))).alias("marked")), "marks", replaces=state)
    whole = links.join(state.where("marked").select(F.col("k").alias("_key")), "_key")
    child = whole.select(F.col("parent_slot").alias("slot"), F.col("parent_blockhash").alias("named")).distinct()
    wrong = F.raise_error(F.concat(F.lit("committed banks disagree on slot "), F.col("slot").cast("string"))).cast("boolean")
    # one expression, so that no other filter hides a conflict
    checked = whole.join(child, "slot", "left").where(F.when(F.col("named") != F.col("blockhash"), wrong).otherwise(~F.col("committed")))
    return checked.select("slot", "bank_id").distinct()


def forwarded_finality(banks: DataFrame, frontier: int | None = None) -> DataFrame:
    """slot, bank_id of finalised banks whose whole ancestry is committed and linked by blockhash.

    ``banks``: as for ``inferred_commits``, with ``finalized``. The ancestry ends at a parent
    at or before ``frontier`` (the last slot flushed) or, without one, before the first slot.
    """
    first = banks.agg(F.min("slot").alias("_first"))
    links = _linked(banks.where("committed")).crossJoin(F.broadcast(first))  # one row
    top = F.col("parent_slot") < F.col("_first") if frontier is None else F.col("parent_slot") <= frontier
    found = ancestry(stored(links.withColumn("_root", top), "links"), F.col("_root"), "_key", "_up")
    return found.where("finalized and linked").select("slot", "bank_id")


def late(events: DataFrame, frontier: DataFrame) -> DataFrame:
    """``events`` (slot, ...) with ``late``: their slot was already flushed when they came.

    ``frontier``: ingest, flushed (the highest slot flushed so far), one row per flush.
    Joined as of the event's ingest order, by ranges of the order key.
    """
    from slotweave.operators.ordered import with_running_max

    both = events.select("ingest", "slot", F.lit(None).cast("bigint").alias("flushed"), F.lit(True).alias("_event")).unionByName(
        frontier.select("ingest", F.lit(None).cast("bigint").alias("slot"), "flushed", F.lit(False).alias("_event"))
    )
    run = with_running_max(both, "ingest", "flushed", "frontier")
    return run.where("_event").select("ingest", "slot", "frontier", F.coalesce(F.col("slot") <= F.col("frontier"), F.lit(False)).alias("late"))
