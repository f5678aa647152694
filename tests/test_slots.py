"""Commits per slot: batch operators, the state machine, and both against each other; streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from slotweave.operators import ordered, resume, slots
from slotweave.sinks.slots import SlotSink, confluent, republished
from slotweave.streaming import coordinator
from slotweave.streaming.machine import PENDING_LIMIT, Event, SlotMachine


def run(*events):
    m = SlotMachine()
    out = []
    for e in events:
        m = SlotMachine(json.loads(json.dumps(m.state())))  # through the store and back
        out += m.apply(e)
    return out, m


def full(slot, bank=0, parent=None, txs=1, records=()):
    meta = Event("meta", slot, bank, parent=slot - 1 if parent is None else parent, expected=txs)
    return [meta, *[Event("record", slot, bank, key=k, payload=p) for k, p in records], *[Event("tx_parsed", slot, bank)] * txs, Event("confirm", slot, bank)]


def committed(out):
    return [o.slot for o in out if o.kind == "commit"]


def test_in_order():
    out, _ = run(*full(11), *full(10, records=[("1.2", "b"), ("1.1", "a"), ("10.1", "c")]))
    assert committed(out) == [11] or committed(out) == [10, 11]  # 11 has no earlier slot to wait for
    out, _ = run(Event("meta", 10, parent=9, expected=1), *full(11), *[Event("tx_parsed", 10), Event("confirm", 10)])
    assert committed(out) == [10, 11]


def test_records_sorted_and_last_wins():
    out, _ = run(*full(10, records=[("2.1", "b"), ("1.2", "x"), ("1.2", "a"), ("10.1", "c")]))
    assert [(o.key, o.payload) for o in out if o.kind == "record"] == [("1.2", "a"), ("2.1", "b"), ("10.1", "c")]
    assert out[-1].counts == {"transaction_count": 1, "decoded": 3, "fallback": 0}


def test_gates():
    e = full(10)
    for left_out in range(len(e)):
        out, _ = run(*[x for i, x in enumerate(e) if i != left_out])
        assert not committed(out)


def test_stats_and_fallback():
    e = full(5)
    out, _ = run(e[0], Event("record", 5, key="1", payload="x", decoded=False), Event("stat", 5, key="filtered"), Event("stat", 5, key="filtered"), *e[1:])
    assert out[-1].counts == {"transaction_count": 1, "decoded": 0, "fallback": 1, "filtered": 2}


def test_winner_drops_other_banks():
    out, m = run(*full(10)[:1], Event("record", 10, 1, key="1", payload="loser"), *full(10)[1:], Event("record", 10, 1, key="2"))
    assert committed(out) == [10] and not m.slots


def test_two_confirmed_banks_stop():
    out, m = run(Event("confirm", 10, 0), Event("meta", 10, 1, parent=9, expected=0), Event("confirm", 10, 1))
    assert out[-1].kind == "error" and m.failed
    assert run(*full(10), Event("confirm", 10, 0))[1].failed is None


def test_forks_and_confirmation():
    out, _ = run(*full(10)[:-1], Event("confirm", 10), Event("discard", 10, 0, key="Forked"))
    assert committed(out) == [10]
    out, _ = run(Event("meta", 10, parent=9, expected=9), Event("confirm", 10), Event("discard", 10, 0, key="Forked"), *[Event("tx_parsed", 10)] * 9)
    assert committed(out) == [10]  # confirmation wins
    out, _ = run(*full(10)[:2], Event("discard", 10, 0, key="Dead"), *full(11, parent=9))
    assert committed(out) == [11]


def test_incomplete_parent_lets_children_pass():
    out, _ = run(*full(10), Event("meta", 11, parent=10, expected=5), *full(12, parent=11), Event("discard", 11, None, key="Incomplete"))
    assert committed(out) == [10, 12]
    out, _ = run(*full(10), *full(12, parent=11))
    assert committed(out) == [10]  # 11 may still come


def test_late_and_dropped():
    out, _ = run(*full(10), Event("record", 9, key="1"), Event("record", 10, key="1"))
    assert [o.kind for o in out][-2:] == ["late", "late"]
    out, _ = run(Event("meta", 10, parent=9, expected=1), Event("discard", 11, None, key="Dead"), Event("record", 11, key="1"))
    assert out[-1].kind == "dropped"


def test_conflicts_and_limit():
    assert run(Event("meta", 10, parent=9, expected=1), Event("meta", 10, parent=8, expected=1))[1].failed
    assert run(Event("meta", 10, parent=9, expected=1), Event("meta", 10, parent=9, expected=1))[1].failed is None
    assert "pending" in run(*[Event("record", s, key="1") for s in range(PENDING_LIMIT + 1)])[1].failed
    assert not committed(run(Event("meta", 10, parent=10, expected=0), Event("confirm", 10))[0])


def test_late_entries_hold_and_overshoot_drops():
    e = [Event("meta", 10, parent=9, expected=0, entries=2, executed=3), Event("confirm", 10), Event("entry", 10, key="0", executed=1)]
    out, _ = run(*e)
    assert not committed(out)
    out, _ = run(*e, Event("entry", 10, key="0", executed=1), Event("entry", 10, key="1", executed=2))
    assert committed(out) == [10]
    out, m = run(*e, Event("entry", 10, key="1", executed=9), *full(11, parent=10))
    assert committed(out) == [11] and m.gone == {10: "Incomplete"}


def test_start_within_a_slot():
    def go(*events):
        m = SlotMachine(whole_start=True)
        return committed([o for e in events for o in m.apply(e)])

    cut = [Event("entry", 10, key="5", executed=0), Event("meta", 10, parent=9, expected=0), Event("confirm", 10)]
    whole = [Event("created", 10), Event("entry", 10, key="0", executed=0), Event("meta", 10, parent=9, expected=0), Event("confirm", 10)]
    assert go(*whole) == [10] and go(*cut, *full(11, parent=10)) == [11]


def _scenario(seed):
    """Banks in random states, as a table and as events in random order of arrival within slots."""
    rng = random.Random(seed)
    rows, events, prev = [], [], 0
    for slot in sorted(rng.sample(range(1, 60), 25)):
        why = rng.choice([None] * 6 + ["Dead", "Incomplete"])
        parent = prev if rng.random() < 0.97 else slot - 1
        expected = rng.randrange(3)
        parsed = expected if rng.random() < 0.95 else max(0, expected - 1)
        rows.append((slot, parent, expected, parsed, rng.random() < 0.97, why))
        prev = slot
    first = rows[0][0]
    rows[0] = (first, first - 1, 0, 0, True, None)
    for slot, parent, expected, parsed, ok, why in rows:
        e = [Event("meta", slot, parent=parent, expected=expected), *[Event("tx_parsed", slot)] * parsed]
        if why:
            e.append(Event("discard", slot, None, key=why))
        elif ok:
            e.append(Event("confirm", slot))
        events.append(e)
    # slots are announced in order, then finish in any order
    tail = [x for e in events for x in e[1:]]
    rng.shuffle(tail)
    return rows, [e[0] for e in events] + tail


@pytest.mark.parametrize("seed", range(6))
def test_batch_equals_machine(spark, seed):
    rows, events = _scenario(seed)
    banks = spark.createDataFrame(rows, "slot bigint, parent bigint, expected bigint, parsed bigint, confirmed boolean, discarded string")
    batch = sorted(r.slot for r in slots.gated(banks, slots.instruction_gate()).where("state = 'flushed'").collect())
    assert committed(run(*events)[0]) == batch


def test_winners(spark):
    b = spark.createDataFrame([(1, 0, True), (1, 1, False), (2, 0, False), (3, 0, False), (3, 1, True)], "slot bigint, bank_id int, confirmed boolean")
    n = spark.createDataFrame([(3, 1, "Forked"), (2, None, "Incomplete")], "slot bigint, bank_id int, reason string")
    got = {(r.slot, r.bank_id): r.discarded for r in slots.winners(b, n).collect()}
    assert got == {(1, 0): None, (1, 1): "Unconfirmed", (2, 0): "Incomplete", (3, 0): "Unconfirmed", (3, 1): None}
    two = spark.createDataFrame([(1, 0, True), (1, 1, True)], "slot bigint, bank_id int, confirmed boolean")
    with pytest.raises(Exception, match="two confirmed banks"):
        slots.winners(two).collect()


def test_notices_rank_by_strength(spark):
    b = spark.createDataFrame([(1, 0, True, 0), (1, 1, False, 0), (2, 0, False, 1), (3, 0, False, 2), (4, 0, True, 3), (5, 0, False, None), (6, 0, True, 5), (7, 0, False, 6)], "slot bigint, bank_id int, confirmed boolean, parent bigint")
    n = [(1, 0, "Forked"), (1, 0, "Incomplete"), (2, None, "Forked"), (2, None, "Dead"), (3, None, "Forked"), (4, 0, "Forked"), (5, None, "Forked"), (7, 0, "Incomplete"), (7, 0, "Forked")]
    got = {(r.slot, r.bank_id): r.discarded for r in slots.winners(b, spark.createDataFrame(n, "slot bigint, bank_id int, reason string")).collect()}
    # 1: confirmed but incomplete, so its slot ends; 3: named by the confirmed 4; 5: named by 6, but without metadata
    assert got == {(1, 0): "Incomplete", (1, 1): "Incomplete", (2, 0): "Dead", (3, 0): None, (4, 0): None, (5, 0): "Forked", (6, 0): None, (7, 0): "Incomplete"}


def test_fork_repair_in_the_machine():
    frozen = [Event("meta", 10, parent=9, expected=0)]
    fork = Event("discard", 10, None, key="Forked")
    child, confirm = full(11, parent=10), Event("confirm", 10)
    for events in ([*frozen, fork, *child, confirm], [*frozen, *child, fork, confirm], [*frozen, *child, confirm, fork], [*frozen, confirm, fork, *child]):
        assert committed(run(*events)[0]) == [10, 11]
    # nobody lifts it: the slot is passed over, and its child waits for a parent that never comes
    assert committed(run(*full(9), *frozen, fork, *full(12, parent=9))[0]) == [9, 12]
    out, m = run(*frozen, Event("discard", 10, 0, key="Incomplete"), Event("discard", 10, 0, key="Forked"), confirm, *full(11, parent=10))
    assert committed(out) == [11] and m.gone[10] == "Incomplete"
    assert "cleared" in run(*frozen, Event("discard", 10, 0, key="Cleared"))[1].failed
    assert run(Event("created", 10), Event("discard", 10, 0, key="Cleared"))[1].failed is None


def test_bank_in_two_slots_is_fatal():
    m = SlotMachine(unique_banks=True)
    assert [o for s, b in ((10, 1), (10, 2), (11, 2)) for o in m.apply(Event("created", s, b))][-1].payload == "bank 2 is in slots 10 and 11"


def accounts(slot, n, done=None, level="confirm"):
    seen = [Event("account_seen", slot) for _ in range(n)]
    return [*seen, Event(level, slot), *[Event("account", slot, key=f"{k}:p{k}", payload=f"{slot}/{k}") for k in range(n if done is None else done)]]


def test_accounts_have_a_frontier_of_their_own():
    def go(*events, level="confirmed"):
        m = SlotMachine(accounts=level)
        out = []
        for e in events:
            m = SlotMachine(json.loads(json.dumps(m.state())))
            out += m.apply(e)
        return [(o.kind, o.slot) for o in out if o.kind.endswith("commit")], out, m

    meta = lambda s, n=0: Event("meta", s, parent=s - 1, expected=n)
    got, out, m = go(meta(10, 1), *accounts(10, 2), meta(11), *accounts(11, 1), Event("tx_parsed", 10))
    assert got == [("account_commit", 10), ("account_commit", 11), ("commit", 10), ("commit", 11)] and not m.slots
    assert [o.payload for o in out if o.kind == "account"] == ["10/0", "10/1", "11/0"]
    # one account short: its slot and those behind wait, instructions don't
    got, _, m = go(meta(10), *accounts(10, 2, 1), meta(11), *accounts(11, 1))
    assert got == [("commit", 10), ("commit", 11)] and (m.frontier, m.account_frontier) == (11, None)
    # the number is frozen by the first status at the level; what comes later is counted as late
    got, out, _ = go(meta(10), Event("account_seen", 10), Event("confirm", 10), Event("account_seen", 10), Event("account", 10, key="1:p"))
    assert got == [("commit", 10), ("account_commit", 10)] and out[-1].counts["late"] == 1 and [o.kind for o in out].count("late") == 1
    # at finalized, a confirmation isn't enough
    steps = [meta(10), *accounts(10, 1), Event("finalize", 10)]
    assert go(*steps[:-1], level="finalized")[0] == [("commit", 10)] and go(*steps, level="finalized")[0] == [("commit", 10), ("account_commit", 10)]


def test_batch_gate_equals_machine_for_accounts(spark):
    rng = random.Random(5)
    plans = [(s, rng.randrange(4), rng.random() < 0.9) for s in range(10, 40)]
    machine, out, events, freezes, done, ingest = SlotMachine(accounts="confirmed"), [], [], [], [], 0
    for s, n, whole in plans:
        for e in [Event("meta", s, parent=s - 1, expected=0), *accounts(s, n, n if whole or not n else n - 1)]:
            ingest += 1
            out += machine.apply(e)
            if e.kind == "account_seen":
                events.append((s, 0, ingest))
            elif e.kind == "confirm":
                freezes.append((s, 0, ingest))
            elif e.kind == "account":
                done.append((s, 0))
    got = slots.expected_accounts(spark.createDataFrame(events, "slot bigint, bank_id int, ingest bigint"), spark.createDataFrame(freezes, "slot bigint, bank_id int, ingest bigint"))
    parsed = spark.createDataFrame(done, "slot bigint, bank_id int").groupBy("slot", "bank_id").agg(F.count(F.lit(1)).alias("processed"))
    banks = got.join(parsed, ["slot", "bank_id"], "left").withColumns({"parent": F.col("slot") - 1, "discarded": F.lit(None).cast("string")})
    flushed = sorted(r.slot for r in slots.gated(banks, slots.account_gate()).where("state = 'flushed'").collect())
    assert flushed == [o.slot for o in out if o.kind == "account_commit"] and 0 < len(flushed) < 30


def test_commits_go_up_the_chain(spark):
    kind = "slot bigint, bank_id int, blockhash string, parent_slot bigint, parent_blockhash string, committed boolean, finalized boolean"
    row = lambda s, b=0, ok=False, final=False, parent=None, h=None: (s, b, h or f"h{s}", s - 1, parent or f"h{s - 1}", ok, final)
    chain = [row(s) for s in range(1, 20)] + [row(20, ok=True, final=True), row(7, 1, h="other"), row(5, 1)]
    got = sorted((r.slot, r.bank_id) for r in slots.inferred_commits(spark.createDataFrame(chain, kind)).collect())
    assert got == [(s, 0) for s in range(6, 20)]  # at 5 two banks have the hash
    with pytest.raises(Exception, match="disagree on slot 7"):
        slots.inferred_commits(spark.createDataFrame([*chain[:-2], row(7, 1, ok=True, h="other")], kind)).collect()
    whole = [row(s, ok=True, final=s in (3, 9)) for s in range(1, 6)] + [row(s, ok=True, final=s == 9) for s in range(7, 10)]
    final = lambda rows, **k: sorted(r.slot for r in slots.forwarded_finality(spark.createDataFrame(rows, kind), **k).collect())
    assert final(whole) == [3] and final(whole, frontier=6) == [3, 9] and final([*whole, row(6, ok=True)]) == [3, 9]


def test_ancestry(spark):
    links = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (5, 4), (6, 5), (7, 3)], "slot bigint, parent bigint")
    got = {r.slot: (r.linked, r.depth) for r in slots.ancestry(links, F.col("slot") == 1).collect()}
    assert got == {1: (True, 0), 2: (True, 1), 3: (True, 2), 7: (True, 3), 5: (False, None), 6: (False, None)}


def test_ordered_operators(spark):
    rng = random.Random(2)
    keys = rng.sample(range(10_000), 300)
    df = spark.createDataFrame([(k, rng.randrange(100)) for k in keys], "k bigint, v bigint")
    data = sorted((r.k, r.v) for r in df.collect())
    prev = {r.k: r.prev for r in ordered.with_previous(df, "k", size=700).collect()}
    high = {r.k: r.high for r in ordered.with_running_max(df, "k", "v", size=700).collect()}
    count = {r.k: r.n for r in ordered.with_running_count(df, "k", F.col("v") > 50, size=700).collect()}
    before, top, n = None, None, 0
    for k, v in data:
        n += v > 50
        assert (prev[k], high[k], count[k]) == (before, top, n)
        before, top = k, v if top is None else max(top, v)
    # a null before isn't skipped for what an earlier bucket had
    gaps = spark.createDataFrame([(1, 10), (15, None), (16, 12), (25, 3)], "k bigint, v bigint")
    assert {r.k: r.prev for r in ordered.with_previous(gaps, "k", "v", size=10).collect()} == {1: None, 15: 10, 16: None, 25: 12}


def test_ordered_operators_in_buckets_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET", 3)
    test_ordered_operators(spark)


def test_every_transaction_is_numbered(spark, monkeypatch):
    frames = spark.createDataFrame([(i % 3 // 2, i) for i in range(2000)], "slot bigint, ingest bigint")
    for bucket in (10_000, 7):
        monkeypatch.setattr(resume, "BUCKET", bucket)
        got = {r.ingest: r.frame for r in resume.frame_index(frames).collect()}
        for s in (0, 1):
            assert [got[i] for i in range(2000) if i % 3 // 2 == s] == list(range(sum(i % 3 // 2 == s for i in range(2000))))


def test_resume(spark):
    u = spark.createDataFrame([(1, "x", 1, ["a", "b"]), (1, "x", 2, ["b", "c"]), (1, "x", 3, ["a"]), (1, None, 4, ["a"]), (2, "x", 5, ["a"])], "slot int, dedup_key string, ingest int, filters array<string>")
    assert {(r.ingest, tuple(r.filters)) for r in resume.drop_repeats(u).collect()} == {(1, ("a", "b")), (2, ("c",)), (4, ("a",)), (5, ("a",))}
    s = spark.createDataFrame([(5, "open"), (9, "complete"), (7, "complete")], "slot int, state string")
    assert resume.checkpoint(s).first()[0] == 5 and resume.checkpoint(s.where("state = 'complete'")).first()[0] == 9
    r = spark.range(1).select(*[resume.resubscribe(F.lit(100), F.lit(p), F.lit(c)) for p, c in ((None, 0), (90, 0), (10, 0), (None, 99))]).first()
    assert list(r) == [96, 90, 68, 99]
    m = spark.createDataFrame([(0, '{"slot": 4}'), (1, '{"slot": 9}'), (1, "zz")], "partition int, value string")
    assert resume.last_committed(m).first()[0] == 9
    with pytest.raises(Exception, match="no marker"):
        resume.last_committed(m.where("value = 'zz'")).collect()
    w = spark.createDataFrame([(3, 1), (3, 2), (5, 3), (4, 4), (8, 5)], "slot bigint, ingest bigint")
    assert sorted((x.slot, x.final) for x in resume.passthrough_markers(w).collect()) == [(3, False), (5, False), (8, True)]


EVENTS = [("c", i, e.kind, e.slot, e.bank, e.parent, e.expected, e.key, e.payload, e.decoded, e.entries, e.executed) for i, e in enumerate([*full(10, records=[("1.1", "a")]), *full(12, parent=10), Event("discard", 11, None, key="Dead"), *full(11)])]


def test_stream_and_sink(spark, tmp_path):
    half = len(EVENTS) // 2
    for k, part in enumerate((EVENTS[:half], EVENTS[half:])):
        spark.createDataFrame(part, coordinator.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del k
    stream = spark.readStream.schema(coordinator.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = SlotSink(str(tmp_path / "out"))
    q = coordinator.commits(stream).writeStream.outputMode("append").foreachBatch(sink.write).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    assert [(r.slot, r.key, r.payload) for r in sink.committed(spark).collect()] == [(10, "1.1", "a")]
    assert sink.last_slot(spark, "c") == 12
    sink.write(spark.createDataFrame([("c", "commit", 12, 0, None, None, "{}")], coordinator.OUTPUT), 1)  # written again: replaced, not added
    assert spark.read.parquet(str(tmp_path / "out/markers")).where("slot = 12").count() == 1


def test_sink_keeps_chains_apart(spark, tmp_path):
    sink = SlotSink(str(tmp_path / "out"))
    rows = [("a", "record", 7, 0, "1.1", "a7", None), ("b", "record", 7, 0, "1.1", "b7", None), ("a", "commit", 7, 0, None, None, "{}"), ("b", "commit", 3, 0, None, None, "{}")]
    sink.write(spark.createDataFrame(rows, coordinator.OUTPUT), 0)
    assert [(r.chain, r.payload) for r in sink.committed(spark).collect()] == [("a", "a7")]
    assert (sink.last_slot(spark, "a"), sink.last_slot(spark, "b"), sink.last_slot(spark, "z")) == (7, 3, None)


def test_fatal_errors_stop_the_query(spark, tmp_path):
    two = [Event("confirm", 10, 0), Event("meta", 10, 1, parent=9, expected=0), Event("confirm", 10, 1), *full(11)]
    rows = [("c", i, e.kind, e.slot, e.bank, e.parent, e.expected, e.key, e.payload, e.decoded, e.entries, e.executed) for i, e in enumerate(two)]
    spark.createDataFrame(rows, coordinator.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(coordinator.EVENTS).parquet(str(tmp_path / "in"))
    q = coordinator.commits(stream).writeStream.format("memory").queryName("fatal").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="two banks are confirmed"):
        q.awaitTermination(240)
    assert spark.table("fatal").count() == 0


def test_stream_markers(spark, tmp_path):
    spark.createDataFrame([("c", s, i) for i, s in enumerate([3, 3, 5, 4, 8])], "chain string, slot bigint, ingest bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("chain string, slot bigint, ingest bigint").parquet(str(tmp_path / "in"))
    q = coordinator.passthrough_markers(stream).writeStream.format("memory").queryName("marks").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    assert sorted(r.slot for r in spark.table("marks").collect()) == [3, 5]


def test_wire_format(spark):
    df = spark.createDataFrame([(b"xy", "p")], "v binary, program string")
    assert bytes(df.select(confluent(F.col("v"), 7)).first()[0]) == b"\0\0\0\0\7\0xy"
    assert bytes(df.select(confluent(F.col("v"), 7, [1, 2])).first()[0]) == b"\0\0\0\0\7\x04\x02\x04xy"
    assert republished(df, ["q"]).count() == 0
