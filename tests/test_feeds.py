"""Feeds, resuming, protocol buffers and configuration."""

import re

import pytest

from slotweave import config
from slotweave.decode import idl, ir, proto
from slotweave.decode.builtin import PROGRAMS, TOKEN
from slotweave.operators.prefilter import Filters, Prefilter, PrefilterError, TransactionPart
from slotweave.sources import feed
from slotweave.streaming import feeds
from tests.test_decode import ANCHOR

S = frozenset


def one(part, name="p"):
    return feed.feed_filters(Filters({name: Prefilter(transaction=part)}))


def test_feed_filters():
    got = one(TransactionPart(include=S("b"), members=S("a"), failed=True))["p"]
    assert got["include"] == ["a", "b"] and got["results"] == ["execution_failure", "fees_only"]
    assert one(TransactionPart(signature="s", failed=None))["p"]["results"] == []
    for bad in (TransactionPart(), TransactionPart(exclude=S("a")), TransactionPart(include=S("a"), token_accounts="all"), TransactionPart(include=S(map(str, range(10_001))))):
        with pytest.raises(PrefilterError):
            one(bad)
    with pytest.raises(PrefilterError):
        one(TransactionPart(include=S("a")), "n" * 65)
    with pytest.raises(PrefilterError):
        feed.feed_filters(Filters({"x": Prefilter()}))
    with pytest.raises(PrefilterError):
        feed.feed_filters(Filters({str(i): Prefilter(transaction=TransactionPart(include=S("a"))) for i in range(65)}))
    assert feed.unserved(Filters({"x": Prefilter(), "y": Prefilter(transaction=TransactionPart(include=S("a")))})) == ["x"]


@pytest.mark.parametrize(
    "args,want",
    [((0, "confirmed", None, False), "off"), ((3, "confirmed", 5, True), "slot_resume"), ((3, "finalized", None, False), "slot_resume"), ((3, "processed", None, False), "bank_replay"), ((3, None, 7, False), "off"), ((3, "processed", None, True), "off")],
)
def test_reconnect_modes(args, want):
    assert feed.reconnect_mode(*args) == want


def test_recoverable_and_pauses():
    assert feed.recoverable("UNAVAILABLE") and feed.recoverable("INTERNAL") and not feed.recoverable("OUT_OF_RANGE")
    assert not feed.recoverable("INTERNAL", "from_slot is not supported here")
    r = feed.Resubscribe()
    assert [r.pause(1) for _ in range(8)] == [0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 6.4, 10.0] and r.pause(61) == 0.1


FRAMES = "ingest bigint, kind string, slot bigint, result string, decoded boolean, is_vote boolean, filters array<string>, withheld bigint"


def frames(spark, rows):
    """(kind, slot) marks, or ("transaction", slot, result, decoded, is_vote, filters)."""
    wide = [(i, r[0], r[1], *(r[2:6] if r[0] == "transaction" else (None, None, None, None)), r[2] if r[0] == "clipped" else None) for i, r in enumerate(rows)]
    return spark.createDataFrame(wide, FRAMES)


def test_framing(spark):
    tx = lambda slot, names=("a",), result="success", decoded=True, vote=False: ("transaction", slot, result, decoded, vote, list(names))
    rows = [
        tx(5), ("start", 5), tx(5, ("a", "vote")), tx(5, ("novote",), vote=True), tx(5, result=None), tx(5, decoded=False), ("end", 5), ("start", 5), tx(5, result="fees_only"),
        ("reconnected", None), tx(5), ("start", 5), tx(5), ("clipped", 5, 7), ("unknown", None), ("start", 6), tx(6),
    ]
    f = feeds.framed(frames(spark, rows), vote_rules={"novote": False, "vote": True})
    got = {r.ingest: r for r in f.collect()}
    assert len(got) == len(rows)
    assert [(i, got[i].frame, got[i].out_of_frame) for i in sorted(got) if got[i].fate == "delivered"] == [(0, 0, True), (2, 1, False), (8, 2, False), (10, 3, True), (12, 4, False), (16, 0, False)]
    assert got[2].names == ["a"] and [got[i].fate for i in (3, 4, 5)] == ["vote_rule_dropped", "unknown_result", "undecodable"]
    assert feeds.counters(f).first().asDict() == {"delivered": 6, "out_of_frame": 2, "vote_rule_dropped": 1, "unknown_result": 1, "undecodable": 1, "restarts": 2, "clipped": 7, "unknown_payload": 1, "reconnects": 1}
    u = feeds.counters(feeds.framed(frames(spark, [tx(1), tx(2)]), bounded=False)).first()
    assert (u.delivered, u.out_of_frame) == (2, 0)
    assert feeds.counters(feeds.framed(frames(spark, [tx(1)]).where("slot = 9"))).first().delivered == 0


def test_numbering_stream(spark, tmp_path):
    kind = "feed string, slot bigint, ingest bigint, signature string"
    for k, rows in enumerate(([(1, 0), (1, 1), (2, 2)], [(1, 3), (2, 4)], [(100, 5), (1, 6)], [(1, 7)])):
        spark.createDataFrame([("f", s, i, f"t{i}") for s, i in rows], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/k={k}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = feeds.numbered(stream).writeStream.format("memory").queryName("numbered").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = {r.ingest: r.frame for r in spark.table("numbered").collect()}
    assert [got[i] for i in range(6)] == [0, 1, 0, 2, 1, 0] and got[6] == 3
    assert got[7] == 0  # its slot was forgotten


def test_regions_merge(spark, tmp_path):
    kind = "slot bigint, signature string, at timestamp, region string"
    from datetime import datetime

    rows = [(1, "a", datetime(2024, 1, 1), r) for r in "xyz"] + [(1, "b", datetime(2024, 1, 1), "y"), (2, "a", datetime(2024, 1, 1), "x")]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    q = feeds.merged_regions(stream, "at", "1 hour").writeStream.format("memory").queryName("regions").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    assert sorted((r.slot, r.signature) for r in spark.table("regions").collect()) == [(1, "a"), (1, "b"), (2, "a")]


def test_slot_tracker():
    t = feed.SlotTracker(start=3)
    assert t.resume_from() == 3 and t.checkpoint() is None
    assert t.deliver(10, "tx", "s1", ["a", "b"]) == ["a", "b"] and t.deliver(10, "tx", "s1", ["a", "c"]) == ["c"] and t.deliver(10, "tx", "s1", ["a"]) == []
    assert t.checkpoint() == 10
    t.deliver(10, "slot", None, ["a"], "confirmed", parent=9)
    assert t.state[10] == "complete" and t.checkpoint() == 10
    t.deliver(11, "tx", "s2", ["a"])
    t.deliver(12, "slot", None, ["a"], "confirmed")
    assert t.checkpoint() == 11 and t.resume_from() == 7
    assert t.deliver(12, "slot", None, ["a"], "dead") == ["a"] == t.deliver(12, "slot", None, ["a"], "dead")
    for s in range(11, 120):
        t.deliver(s, "slot", None, ["a"], "confirmed")
    assert min(t.seen) >= 115 and min(t.state) >= 119 - feed.FLOOR
    t.deliver(119, "slot", None, ["a"], "confirmed", parent=50)
    assert t.resume_from() == 119 - feed.FLOOR  # an old hole, but no further back than this


def test_schema_text():
    text = proto.schema_text(idl.load(ANCHOR))
    assert text.startswith('syntax = "proto3";')
    for part in ("message Pool {\n  PublicKey owner = 1;\n  optional uint32 fee = 2;\n}", "enum Side {", "message ProgramInstruction {\n  oneof kind {\n    SwapInstruction swap = 1;"):
        assert part in text
    for p in PROGRAMS.values():
        names = re.findall(r"^(?:message|enum) (\w+)", proto.schema_text(p), re.M)
        used = {n for n in re.findall(r"^\s+(?:optional |repeated )?([A-Z]\w*) \w+ = ", proto.schema_text(p), re.M)}
        assert len(names) == len(set(names)) and used <= set(names)


def test_encoding():
    s = ir.Struct((("a", ir.Num("u32")), ("b", ir.Option(ir.Num("u8"))), ("c", ir.Items(ir.Num("u16"), None)), ("k", ir.Key()), ("t", ir.Prefixed(ir.Num("u8"), ir.Bytes(True))), ("s", ir.Struct((("x", ir.Bool()),)))))
    value = {"a": 150, "b": 0, "c": [3, 270], "k": "1" * 32, "t": "hi", "s": {"x": True}}
    assert proto.encode(s, value, {}).hex() == "089601" + "1000" + "1a03038e02" + "2222" + "0a20" + "00" * 32 + "2a026869" + "32020801"
    assert proto.encode(s, {"a": 0, "b": None, "c": [], "k": "1" * 32, "t": "", "s": {"x": False}}, {}).hex() == "2222" + "0a20" + "00" * 32 + "3200"
    e = ir.Enum((("none", None), ("some", ir.Struct((("x", ir.Num("i64")),)))))
    assert proto.encode(e, {"kind": "some", "some": {"x": -1}}, {}).hex() == "120b08" + "ff" * 9 + "01"
    layout = TOKEN.accounts[0].layout
    assert proto.encode(layout, layout.read(bytes(82), 0, {})[0], {}) == b""


def test_config():
    c = config.load('[buffer]\njobs = 4\n[sink]\nbrokers = "b:1"\ntransactional-id = "t"\npassword = "secret"\n[source]\ntoken = "hush"')
    assert c.buffer.parallelism(9) == 4 and config.BufferConfig().parallelism(9) == 9 and config.BufferConfig(jobs=0).parallelism(9) == 1
    assert c.sink.options()["kafka.transactional.id"] == "t" and "secret" not in repr(c) and "hush" not in repr(c)
    for bad in ("[other]\nx = 1", "[sink]\nnope = 1"):
        with pytest.raises(ValueError, match="unknown"):
            config.load(bad)


def test_tap():
    own = Prefilter.builder().block_include_entries(True).block_footers(True).account_owners({"o"}).build()
    t = feed.tapped(Filters({"p": own}))
    assert t.by_id["p"].block is None and t.by_id["p"].block_footer is None and t.by_id["p"].account
    assert t.by_id["coordinator"].slot.interslot_updates and t.by_id["coordinator"].block_meta
    with pytest.raises(PrefilterError):
        feed.tapped(Filters({"coordinator": own}))


def test_blocks_and_markers(spark):
    from pyspark.sql import functions as F

    from slotweave.operators import blocks, dispatch

    b = spark.createDataFrame([(1, 0, [("k", 5, 9, 1, "x")], "big"), (2, 0, [], "big")], "slot bigint, bank_id bigint, rewards array<struct<pubkey:string,lamports:bigint,post_balance:bigint,reward_type:int,commission:string>>, transactions string")
    assert blocks.block_meta(b).columns[:2] == ["slot", "bank_id"] and "transactions" not in blocks.block_meta(b).columns
    assert [(r.slot, r.lamports) for r in blocks.rewards(b).collect()] == [(1, 5)]
    s = spark.createDataFrame([(1, 0, "processed"), (1, 0, "finalized"), (1, 0, "dead"), (2, 0, "dead")], "slot bigint, bank_id bigint, status string")
    assert [tuple(r) for r in blocks.highest_commitment(s).collect()] == [(1, 0, "finalized")]
    kinds = blocks.parallel_kinds({"slot": s, "block": b}, {"p": {"slot"}, "q": {"slot", "x"}})
    assert list(kinds) == ["slot"] and kinds["slot"].first().filters == ["p", "q"]
    a = spark.createDataFrame([(1, b"\1", b"\2", 5, 6, b"hi", None)], "slot bigint, pubkey binary, owner binary, lamports bigint, write_version bigint, data binary, error string")
    assert a.select(dispatch.raw_account()).first()[0] == '{"slot":"1","pubkey":"01","owner":"02","lamports":"5","write_version":"6","data":"aGk="}'
    m = spark.createDataFrame([(4, None, 2)], "slot bigint, blockhash string, decoded bigint")
    assert m.select(dispatch.marker("commit", "blockhash", "decoded")).first()[0] == '{"marker":"commit","slot":4,"decoded":2}'
    assert m.select(F.get_json_object(dispatch.marker("watermark"), "$.slot")).first()[0] == "4"
