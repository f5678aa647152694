"""Registries, records, sources, and the driver's entry points."""

import json

import pytest
from pyspark.sql import functions as F

from slotweave.operators import dispatch
from slotweave.sources import replay, scan, wire


def registry():
    ok = F.when(F.col("v") > 0, dispatch.outcome("parsed", "good", F.col("v").cast("string"))).when(F.col("v") == 0, dispatch.outcome("filtered")).otherwise(dispatch.outcome("error", error="bad"))
    second = F.when(F.col("v") == -1, dispatch.outcome("parsed", "rescued")).otherwise(dispatch.outcome("filtered"))
    r = dispatch.Registry()
    return r.register(dispatch.Parser("one", "p", ok, "t1", "dead")).register(dispatch.Parser("two", "p", second, "t2"))


def test_first_that_parses_wins(spark):
    df = spark.createDataFrame([("p", 1), ("p", 0), ("p", -1), ("p", -2), ("q", 5)], "program string, v int")
    got = {(r.program, r.v): (r.outcome, r.parser, r.topic, r.fallback) for r in registry().dispatch(df).collect()}
    assert got[("p", 1)] == ("parsed", "one", "t1", False)
    assert got[("p", 0)][0] == "filtered"
    assert got[("p", -1)] == ("parsed", "two", "t2", False)
    assert got[("p", -2)] == ("error", "one", "dead", True)
    assert got[("q", 5)] == ("filtered", None, None, False)
    m = dispatch.metrics(registry().dispatch(df), "instruction").first()
    assert (m.received, m.parsed, m.filtered, m.errors, m.fallbacks) == (5, 2, 2, 1, 1)
    with pytest.raises(dispatch.DuplicateParser):
        registry().register(dispatch.Parser("one", "p", dispatch.outcome("filtered"), "t"))


def test_records(spark):
    df = spark.createDataFrame([("p", 1), ("p", -2), ("q", 1)], "program string, v int")
    r = dispatch.records(registry().dispatch(df), dispatch.instruction_key("v", "program", F.lit("1.2")), dispatch.headers("v", missing=F.lit(None)), F.lit("raw")).collect()
    by = {x.topic: x for x in r}
    assert by["t1"].key == "1:p:1.2" and by["t1"].value == "1" and [h.key for h in by["t1"].headers] == ["v"]
    assert by["dead"].value == "raw" and [h.key for h in by["dead"].headers] == ["v", "parse_error"] and not by["dead"].is_decoded


def test_capture_and_range(spark, tmp_path):
    n = replay.EPOCH_SLOTS
    df = spark.createDataFrame([(s,) for s in (1, n - 1, n, 2 * n)], "slot bigint")
    replay.capture(df, str(tmp_path / "c"))
    first, end = replay.epoch_range(0)
    assert sorted(r.slot for r in replay.read_range(spark, str(tmp_path / "c"), first, end).collect()) == [1, n - 1]
    plan = replay.read_range(spark, str(tmp_path / "c"), n, n + 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(epoch" in plan and "PushedFilters: [IsNotNull(slot)" in plan
    gaps = spark.createDataFrame([(5, 3), (6, 5)], "slot bigint, parent_slot bigint")
    assert [r.slot for r in replay.possible_leader_skips(gaps).collect()] == [4]


def test_fixtures(spark, tmp_path):
    a = {"data": [1, 2], "pubkey": [1] * 32, "executable": False, "lamports": 5, "owner": [2] * 32, "rentEpoch": 2**64 - 1, "space": 2}
    (tmp_path / "a.json").write_text(json.dumps(a))
    r = replay.fixtures(spark, str(tmp_path)).first()
    assert int(r.rent_epoch) == 2**64 - 1 and bytes(r.data) == b"\1\2"
    ix = {"ix_index": [0, 0], "program": [1] * 32, "accounts": [[2] * 32], "data": [3], "inner": []}
    rows = replay.transaction_fixture(json.dumps({"instructions": [{**ix, "inner": [ix, ix]}], "log_messages": ["x"]}))
    assert [r["path"] for r in rows] == [[0], [0, 0], [0, 1]]


def fetch(owner):
    return [(f"{owner}-{i}", i, b"x") for i in range(2)]


def test_account_scan(spark):
    scan.register(spark)
    df = spark.read.format("account_scan").option("fetch", "tests.test_dispatch:fetch").option("owners", "A,B").option("parsers", "p,q").load()
    assert sorted((r.parser, r.pubkey) for r in df.collect()) == [("p", "A-0"), ("p", "A-1"), ("q", "B-0"), ("q", "B-1")]


def test_retries():
    assert list(scan.pauses()) == [0.5, 1, 2, 4, 8, 10, 10, 10, 10, 10]
    slept, left = [], [2]

    def flaky():
        if left[0]:
            left[0] -= 1
            raise scan.Transient
        return 7

    assert scan.retried(flaky, slept.append) == 7 and slept == [0.5, 1]
    with pytest.raises(ZeroDivisionError):
        scan.retried(lambda: 1 / 0, slept.append)


def _message(version=None, program=b"\3" * 32):
    body = bytes([1, 0, 1, 2]) + b"\1" * 32 + program + b"\2" * 32 + bytes([1, 1, 1, 0, 2]) + b"hi"
    return bytes([1]) + b"\4" * 64 + (bytes([0x80 | version]) + body + b"\0" if version is not None else body)


def test_wire():
    t = wire.parse(_message())
    assert t["version"] is None and t["instructions"] == [{"program_id_index": 1, "accounts": [0], "data": b"hi"}] and not wire.is_vote(t)
    assert wire.parse(_message(0))["version"] == 0 and wire.is_vote(wire.parse(_message(program=wire.VOTE_PROGRAM)))
    for bad in (_message()[:-1], _message() + b"x", _message(5), b""):
        with pytest.raises(wire.WireError):
            wire.parse(bad)


def test_entry_points(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "slot_commit_summary" in q
    assert all(callable(f) for f in q.values())
