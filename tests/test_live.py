"""The live source, the log sink and the registry client, over transports of the tests' own."""

import json
import os

import pytest

from slotweave.sinks.log import LogSink
from slotweave.sinks.registry import RegistryError, SchemaRegistry
from slotweave.sources import live
from slotweave.sources.scan import Transient
from slotweave.streaming import coordinator


class Flaky(live.Folder):
    """Breaks once after two updates, and once when it is asked for the latest position."""

    def _once(self, name):
        try:
            os.open(f"{self.path}/{name}", os.O_CREAT | os.O_EXCL)
        except FileExistsError:
            return
        raise Transient(name)

    def latest(self):
        self._once("latest.broke")
        return super().latest()

    def read(self, start, end):
        for n, row in enumerate(super().read(start, end)):
            if n == 2:
                self._once("read.broke")
            yield row


class Lost(live.Folder):
    def read(self, start, end):
        raise Transient("gone")
        yield


def put(path, position, *keys):
    (path / f"{position}.json").write_text(json.dumps([{"kind": "tx", "key": k, "filters": ["a"]} for k in keys]))


def run(spark, tmp_path, **options):
    live.register(spark)
    stream = spark.readStream.format("live_feed").options(path=str(tmp_path / "feed"), first_pause="0.01", **options).load()
    return stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()


def test_live_feed_reconnects_and_resumes(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    put(tmp_path / "feed", 10, "a", "b", "c")
    put(tmp_path / "feed", 11, "d")
    q = run(spark, tmp_path, transport="tests.test_live:Flaky")
    assert q.awaitTermination(240)
    read = lambda: sorted((r.position, r.key) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert read() == [(10, "a"), (10, "b"), (10, "c"), (11, "d")] and live.exit_status(q) == ("completed", None)
    put(tmp_path / "feed", 13, "e")
    q = run(spark, tmp_path, transport="tests.test_live:Flaky")
    assert q.awaitTermination(240)
    assert read() == [(10, "a"), (10, "b"), (10, "c"), (11, "d"), (13, "e")]


def test_lost_connections_end_the_query(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    put(tmp_path / "feed", 1, "a")
    q = run(spark, tmp_path, transport="tests.test_live:Lost", retries="2")
    with pytest.raises(Exception, match="keeps failing"):
        q.awaitTermination(240)
    assert live.exit_status(q)[0] == "connection_lost"


def test_start_and_rewind(tmp_path):
    (tmp_path / "feed").mkdir()
    for p in (5, 6, 7, 8):
        put(tmp_path / "feed", p, "k")
    reader = lambda **o: live._Reader({"transport": "slotweave.sources.live:Folder", "path": str(tmp_path / "feed"), **o})
    assert reader().initialOffset() == {"position": 5} and reader(**{"from": "8", "rewind": "1"}).initialOffset() == {"position": 7}
    assert reader(**{"from": "6", "rewind": "4"}).initialOffset() == {"position": 5}
    r = reader(most="3", span="2")
    assert r.latestOffset() == {"position": 8} and [(p.start, p.end) for p in r.partitions({"position": 5}, {"position": 8})] == [(5, 7), (7, 8)]
    assert r.latestOffset() == {"position": 9}


class Files:
    """A producer over a file per topic; ``flaky``: the first commit of slot 8 fails."""

    def __init__(self, options, chain):
        self.path, self.chain, self.flaky, self.rows = options["path"], chain, options.get("flaky"), []

    def last(self, topic):
        found = [json.loads(x) for x in self._lines(topic)]
        return max((x["slot"] for x in found if "marker" in x["value"] and x["chain"] == self.chain), default=None)

    def _lines(self, topic):
        try:
            with open(f"{self.path}/{topic}") as f:
                return f.readlines()
        except FileNotFoundError:
            return []

    def begin(self):
        self.rows = []

    def send(self, topic, key, value, headers):
        self.rows.append((topic, {"chain": self.chain, "key": key, "value": value, "slot": headers["slot"]}))

    def abort(self):
        self.rows = []

    def commit(self):
        if self.flaky and self.rows[0][1]["slot"] == 8 and not os.path.exists(f"{self.path}/failed"):
            open(f"{self.path}/failed", "w").close()
            raise Transient("the log is busy")
        for topic, row in self.rows:
            with open(f"{self.path}/{topic}", "a") as f:
                f.write(json.dumps(row) + "\n")


def test_log_sink_writes_whole_slots_once(spark, tmp_path):
    rows = [("a", "record", s, 0, k, f"a{s}{k}", None) for s in (7, 8) for k in ("1.1", "2.1")] + [("a", "commit", s, 0, None, None, '{"decoded": 2}') for s in (7, 8)]
    rows += [("b", "commit", 3, 0, None, None, "{}"), ("a", "account", 7, 0, "1:p", "acc", None), ("a", "account_commit", 7, 0, None, None, "{}"), ("a", "late", 2, 0, "x", None, None)]
    batch = spark.createDataFrame(rows, coordinator.OUTPUT)
    sink = LogSink("tests.test_live:Files", {"path": str(tmp_path), "flaky": True}, backoff=0.01)
    for _ in range(2):  # the batch is written again
        sink.write(batch, 0)
    log = [json.loads(x) for x in (tmp_path / "transaction.slots").read_text().splitlines()]
    mine = [(x["slot"], x["key"], x["value"]) for x in log if x["chain"] == "a"]
    assert [m[:2] for m in mine] == [(7, "1.1"), (7, "2.1"), (7, None), (8, "1.1"), (8, "2.1"), (8, None)]
    assert json.loads(mine[2][2]) == {"marker": "commit", "slot": 7, "decoded": 2} and sum(x["chain"] == "b" for x in log) == 1
    assert len((tmp_path / "account.slots").read_text().splitlines()) == 2


def test_registry():
    asked = []

    def transport(method, path, body):
        asked.append((method, path))
        if len(asked) == 1:
            return 503, {}
        if method == "POST":
            return (422, {"message": "invalid"}) if body["schema"] == "bad" else (200, {"id": 7})
        return (200, {"schema": "s"}) if path == "/schemas/ids/7" else (404, {"message": "none"})

    r = SchemaRegistry(transport, first_pause=0.001)
    assert r.id_of("a/b-value", "s") == 7 == r.id_of("a/b-value", "s") and asked == [("POST", "/subjects/a%2Fb-value/versions")] * 2
    assert r.schema_of(7) == "s" and r.latest("x") is None
    with pytest.raises(RegistryError, match="invalid"):
        r.id_of("x", "bad")
