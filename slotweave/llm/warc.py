"""WARC archives, compressed record by record with a dictionary of their own.

Every row of a table becomes one WARC/1.1 record: ``response`` with an HTTP head and the
payload, or ``revisit`` without the payload if an equal payload of at least ``MIN_REVISIT``
bytes is archived elsewhere. Of records with equal payloads, that with the largest id is
the response.

Archive layout: a skippable frame (magic 0x184D2A5D, little-endian size) that holds the
dictionary, one Zstandard frame per record, compressed with that dictionary, and a last
skippable frame (0x184D2A5E) with the number of records, which tells a cut archive. The
dictionary is trained from the archive's own records (at most ``SAMPLE_BYTES`` of them,
evenly spread over the archive), so archives are written side by side, need no
coordination and can each be read alone. An archive closes after ``ARCHIVE_BYTES`` of
uncompressed records, which bounds a task's memory.

Archives are rows (part, seq, records, payload) of a Parquet table in the shared folder:
Spark's own readers, writers and commit protocol carry them, so a lost executor's archives
are written again. ``export`` puts them into plain ``.warc.zst`` files.

Edge cases: page ids are integers (others fail the cast); null or empty html has an empty
payload and is a response; null ids come
first in order and are never named by a revisit while another id has the payload; rows
that share id and payload are the same record, and each is written as the response; an
empty table gives no archives and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stored, table

MIN_REVISIT = 1000
ARCHIVE_BYTES = 24_000_000
DICT_BYTES, SAMPLE_BYTES = 32_768, 1_500_000
LEVEL = 3
SKIPPABLE, TRAILER = 0x184D2A5D, 0x184D2A5E
_END = struct.Struct("<IIQ")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_ID_SPACE = "77617263-0000-4000"
NO_ID = "ffffffffffffffff"


def record_id(page_id: int | None) -> str:
    """A record's URN: the id's 64 bits behind a fixed prefix, so it can be read back."""
    h = NO_ID if page_id is None else f"{page_id & (2**64 - 1):016x}"
    return f"<urn:uuid:{_ID_SPACE}-{h[:4]}-{h[4:]}>"


def id_of(urn: str) -> int | None:
    h = urn.strip("<>")[len("urn:uuid:") + len(_ID_SPACE) + 1 :].replace("-", "")
    if h == NO_ID:
        return None
    n = int(h, 16)
    return n - 2**64 if n >= 2**63 else n


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; ``size``: of the full payload, which a revisit's HTTP head still states.

    Line ends inside a URL would break the head, so they are percent-encoded.
    """
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    block = http if revisit else http + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> bytes:
    """A dictionary from the records: of all their parts of DICT_BYTES, evenly spread ones.

    Where there is too little for the trainer, those parts themselves are the dictionary.
    """
    import zstandard

    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    parts = [(k, i) for k, r in enumerate(records) for i in range(0, len(r), DICT_BYTES)]
    samples = [records[k][i : i + DICT_BYTES] for k, i in parts[::step]]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def pack(records: list[bytes]) -> bytes:
    import zstandard

    d = train(records)
    kind = zstandard.ZstdCompressionDict(d)
    kind.precompute_compress(level=LEVEL)
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_checksum=True)
    return struct.pack("<II", SKIPPABLE, len(d)) + d + b"".join(map(c.compress, records)) + _END.pack(TRAILER, 8, len(records))


def unpack(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record."""
    import zstandard

    if len(archive) < 8 + _END.size:
        raise ValueError("the archive is cut")
    magic, size = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    last, _, expected = _END.unpack_from(archive, len(archive) - _END.size)
    if last != TRAILER:
        raise ValueError("the archive is cut")
    d = archive[8 : 8 + size]
    source = memoryview(archive)[8 + size : len(archive) - _END.size]
    if not len(source):
        return
    dctx = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d) if d else None)
    reader = dctx.stream_reader(source, read_across_frames=True)
    buffer, at, seen = b"", 0, 0

    def more(n: int) -> bool:
        nonlocal buffer, at
        got = reader.read(max(n, 1 << 20))
        buffer, at = buffer[at:] + got, 0
        return bool(got)

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more(1):
                if len(buffer) > at or seen != expected:
                    raise ValueError("records are missing")
                return
        lines = buffer[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        at = end + 4
        while len(buffer) - at < n + 4:
            if not more(n + 4 - (len(buffer) - at)):
                raise ValueError("the archive ends inside a record")
        block = buffer[at : at + n]
        at += n + 4
        seen += 1
        yield fields, block


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, body, digest, refers_to, revisit for every row."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body"))
    p = p.withColumn("digest", F.sha1("body"))
    long_ones = p.where(F.octet_length("body") >= MIN_REVISIT).groupBy("digest")
    # one row per payload that is there more than once; equal rows count as one
    twice = long_ones.agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    twice = stored(twice.select(F.col("digest").alias("_d"), "keeper"), "keepers")
    out = p.join(small(twice, twice.count()), p["digest"] == F.col("_d"), "left")
    revisit = F.col("_d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    # ids travel as text: pandas would turn a column with nulls into floats
    ids = [F.col("page_id").cast("string").alias("page_id"), F.when(revisit, F.col("keeper")).cast("string").alias("refers_to")]
    return out.select(*ids, "url", F.when(revisit, None).otherwise(F.col("body")).alias("body"), F.octet_length("body").alias("size"), "digest", revisit.alias("revisit"))


def write(pages: DataFrame) -> DataFrame:
    """The archives: part, seq, records, payload."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, records, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for page_id, url, body, full, digest, refers, revisit in zip(*(b[c].tolist() for c in ("page_id", "url", "body", "size", "digest", "refers_to", "revisit")), strict=True):
                page_id, refers = (None if x is None else int(x) for x in (page_id, refers))
                r = record(page_id, url, b"" if revisit else bytes(body), full, digest, refers, revisit)
                records.append(r)
                size += len(r)
                if size >= ARCHIVE_BYTES:
                    yield pd.DataFrame({"part": [part], "seq": [seq], "records": [len(records)], "payload": [pack(records)]})
                    seq, records, size = seq + 1, [], 0
        if records:
            yield pd.DataFrame({"part": [part], "seq": [seq], "records": [len(records)], "payload": [pack(records)]})

    return stored(plan(pages).mapInPandas(run, "part int, seq int, records long, payload binary"), "warc")


def read(archives: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, body from the archives.

    A response's digest is computed again from its payload; damage raises ValueError.
    """
    return _read(archives, True)


def _read(archives: DataFrame, bodies: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["payload"]:
                rows = []
                for fields, block in unpack(bytes(data)):
                    kind = fields["WARC-Type"]
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(head.rpartition(b"Content-Length: ")[2])
                    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or length != len(payload)):
                        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
                    refers = id_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    rows.append((id_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], length, digest, kind, refers, *[payload if kind == "response" else None] * bodies))
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["body"] * bodies]
                columns = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else dict.fromkeys(names, ())
                # ids with nulls among them must not become floats
                yield pd.DataFrame({n: pd.array(c, "Int64") if n in ("page_id", "refers_to") else list(c) for n, c in columns.items()})

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", body binary" * bodies
    return archives.select("payload").mapInPandas(run, schema)


def export(archives: DataFrame, folder: str) -> None:
    """Plain .warc.zst files under a mounted folder that all executors see."""
    import os

    os.makedirs(folder, exist_ok=True)

    def put(rows) -> None:
        for r in rows:
            name = f"{folder}/part-{r['part']:06d}-{r['seq']:06d}.warc.zst"
            with open(f"{name}.tmp", "wb") as f:
                f.write(r["payload"])
            os.replace(f"{name}.tmp", name)

    archives.select("part", "seq", "payload").foreachPartition(put)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS size, sha1(body) AS digest FROM p),
k AS (SELECT digest, max(page_id) AS keeper FROM d WHERE size >= 1000 GROUP BY digest HAVING count(*) > 1)
SELECT d.page_id, CAST(d.size AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN k.digest IS NOT NULL AND d.page_id IS DISTINCT FROM k.keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.digest IS NOT NULL AND d.page_id IS DISTINCT FROM k.keeper THEN k.keeper END AS refers_to
FROM d LEFT JOIN k ON d.digest = k.digest
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(write(table(spark, sf_dir, "pages")), False).drop("url")
