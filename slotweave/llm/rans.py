"""Token ids in a binary file format: static range asymmetric numeral systems (rANS).

One frequency table of 2**20 slots, made from the ids of all documents, is shared by all
shards. A shard holds a run of documents in ascending doc_id order. Its ids are coded in
independent blocks of 65,536; in each block 32 coders take turns (id ``i`` belongs to coder
``i % 32``) and share one stream of 32-bit words. Every 512 turns the block notes the 32
coder states and its place in the stream: a checkpoint, from which decoding may start. So a
block's stretches between checkpoints are decoded side by side, here as numpy vectors. Each
block carries the CRC-32 of its ids, each shard that of its body, and the table its own.

Shard layout (little-endian): ``RANS`` magic, version, table CRC, counts and section sizes,
then zlib-packed document index (ids and lengths), block heads, states, words. Rows of a
Parquet table in the shared folder carry the bytes, so writing and rereading need nothing
but Spark's own file systems and commit protocol; ``export`` puts them into plain files.

Edge cases: ids are integers (others fail the cast); a null or empty text has only its end id; null doc_ids come first; rows with
equal doc_ids stand side by side, ordered by their ids' bytes; an empty table gives no
shards and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, small, stored, table
from .pieces import encode_texts

END = 0
SYMBOLS = 50_257
BITS = 20
LANES, BLOCK, TURNS = 32, 65_536, 512
SHARD_IDS = 2_000_000
LOW = np.uint64(1 << 31)
MAGIC, VERSION = b"RANS", 1
_HEAD = struct.Struct("<4sIIIQQIIIIQI")
_S, _M, _W = np.uint64(BITS), np.uint64((1 << BITS) - 1), np.uint64(32)


class Table:
    """Frequencies that sum to 2**20, each seen id having at least one slot."""

    def __init__(self, freq: np.ndarray):
        assert int(freq.sum()) == 1 << BITS
        self.freq = freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq.astype(np.int64))
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Proportional shares, rounded down; what remains goes to the most frequent ids."""
        counts = counts.astype(np.float64)
        if not counts.any():
            counts[END] = 1
        seen = counts > 0
        freq = np.where(seen, 1 + np.floor(counts * (((1 << BITS) - int(seen.sum())) / counts.sum())), 0).astype(np.int64)
        freq[int(np.argmax(counts))] += (1 << BITS) - int(freq.sum())
        return cls(freq)

    def pack(self) -> bytes:
        return zlib.compress(self.freq.astype("<u4").tobytes())

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        return cls(np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64))


def _encode_grid(ids: np.ndarray, t: Table):
    """ids: (blocks, turns, lanes). States at checkpoints, words, and word numbers by (block, turn)."""
    blocks, turns, lanes = ids.shape
    x = np.full((blocks, lanes), LOW)
    out, need = np.zeros((turns, blocks, lanes), np.uint32), np.zeros((turns, blocks, lanes), bool)
    stops = list(range(0, turns, TURNS))
    states = np.zeros((len(stops), blocks, lanes), np.uint64)
    for k in range(turns - 1, -1, -1):
        s = ids[:, k, :]
        f = t.freq[s]
        n = x >= (f << np.uint64(43))
        need[k], out[k] = n, x.astype(np.uint32)
        x = np.where(n, x >> _W, x)
        q = x // f
        x = (q << _S) + (x - q * f) + t.start[s]
        if k % TURNS == 0:
            states[k // TURNS] = x
    words, per_turn = out.transpose(1, 0, 2)[need.transpose(1, 0, 2)], need.sum(axis=2).T
    return states.transpose(1, 0, 2), words, per_turn


def _decode_grid(states: np.ndarray, turns: int, places: np.ndarray, words: np.ndarray, t: Table) -> np.ndarray:
    """ids (stretches, turns, lanes) from the states (stretches, lanes) and each stretch's place in the words."""
    x, at = states.copy(), places.astype(np.int64).copy()
    out = np.empty((len(states), turns, states.shape[1]), np.uint16)
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    for k in range(turns):
        slot = x & _M
        s = t.symbol[slot]
        out[:, k, :] = s
        x = t.freq[s] * (x >> _S) + slot - t.start[s]
        need = x < LOW
        rank = np.cumsum(need, axis=1)
        i = np.minimum(at[:, None] + rank - 1, len(words) - 1)
        x = np.where(need, (x << _W) | words[i], x)
        at += rank[:, -1]
    return out


def _parts(n: int) -> list[tuple[int, int, int]]:
    """(first id, blocks, turns) of the even grids that n ids are cut into: full blocks, then the rest."""
    full = n // BLOCK
    rest = n - full * BLOCK
    return [(0, full, BLOCK // LANES)] * (full > 0) + [(full * BLOCK, 1, -(-rest // LANES))] * (rest > 0)


def encode_shard(doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray, first: int, t: Table) -> bytes:
    """One shard's bytes; ``first``: ids of the documents before it in its partition."""
    states, words, places, crcs, at = [], [], [], [], 0
    fill = int(np.argmax(t.freq))
    for a, blocks, turns in _parts(len(ids)):
        size = blocks * turns * LANES
        part = ids[a : a + size]
        grid = np.concatenate([part, np.full(size - len(part), fill, part.dtype)]).reshape(blocks, turns, LANES)
        st, w, per_turn = _encode_grid(grid, t)
        before = at + (np.cumsum(per_turn.ravel()) - per_turn.ravel()).reshape(blocks, turns)
        places.append(before[:, ::TURNS].ravel())
        states.append(st.reshape(-1, LANES))
        words.append(w)
        crcs += [zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes()) for i in range(a, min(len(ids), a + size), BLOCK)]
        at += len(w)
    join = lambda x, kind: np.concatenate(x).astype(kind).tobytes() if x else b""
    index = zlib.compress(doc_ids.astype("<i8").tobytes() + nulls.astype("u1").tobytes() + lengths.astype("<u4").tobytes())
    body = [index, np.array(crcs, "<u4").tobytes(), join(places, "<u4"), join(states, "<u8"), join(words, "<u4")]
    blob = b"".join(body)
    return _HEAD.pack(MAGIC, VERSION, t.crc, len(doc_ids), len(ids), first, *map(len, body[:4]), len(body[4]), zlib.crc32(blob)) + blob


def decode_shard(data: bytes, t: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(doc_ids, nulls, lengths, ids, first); raises ValueError on any damage."""
    magic, version, crc, docs, n, first, *sizes, body_crc = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION or crc != t.crc or zlib.crc32(data[_HEAD.size :]) != body_crc:
        raise ValueError("the shard is damaged or belongs to another table")
    cut = np.cumsum([_HEAD.size, *sizes])
    index, crcs, places, states, words = (data[a:b] for a, b in zip(cut, cut[1:], strict=False))
    index = zlib.decompress(index)
    doc_ids, nulls = np.frombuffer(index, "<i8", docs), np.frombuffer(index, "u1", docs, 8 * docs).astype(bool)
    lengths = np.frombuffer(index, "<u4", docs, 9 * docs).astype(np.int64)
    crcs, places = np.frombuffer(crcs, "<u4"), np.frombuffer(places, "<u4")
    states, words = np.frombuffer(states, "<u8").reshape(-1, LANES), np.frombuffer(words, "<u4")
    out, used = [], 0
    for _, blocks, turns in _parts(n):
        stops = -(-turns // TURNS)
        st, pl = states[used : used + blocks * stops], places[used : used + blocks * stops]
        used += blocks * stops
        grid = np.empty((blocks, stops, TURNS, LANES), np.uint16) if turns % TURNS == 0 else None
        if grid is not None:
            out.append(_decode_grid(st, TURNS, pl, words, t).ravel())
        else:  # one block, whose last stretch is shorter
            if stops > 1:
                out.append(_decode_grid(st[:-1], TURNS, pl[:-1], words, t).ravel())
            out.append(_decode_grid(st[-1:], turns - (stops - 1) * TURNS, pl[-1:], words, t).ravel())
    ids = np.concatenate(out)[:n] if out else np.zeros(0, np.uint16)
    for k, c in enumerate(crcs.tolist()):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) != c:
            raise ValueError(f"block {k} is damaged")
    return doc_ids, nulls, lengths, ids, first


def decode_stretch(data: bytes, t: Table, number: int) -> np.ndarray:
    """Ids of one stretch between checkpoints, from its checkpoint alone: nothing before it is decoded.

    ``number`` counts the shard's checkpoints; a stretch has ``LANES * TURNS`` ids, the last
    one of the shard what remains. Damage shows when the block is checked (``decode_shard``).
    """
    magic, version, crc, _, n, _, *sizes, _ = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION or crc != t.crc:
        raise ValueError("the shard belongs to another table")
    cut = np.cumsum([_HEAD.size, *sizes])
    places, states, words = (np.frombuffer(data[cut[i] : cut[i + 1]], k) for i, k in ((2, "<u4"), (3, "<u8"), (4, "<u4")))
    size = LANES * TURNS
    turns = min(TURNS, -(-(n - number * size) // LANES))
    if not 0 <= number < len(places):
        raise IndexError(number)
    got = _decode_grid(states.reshape(-1, LANES)[number : number + 1], turns, places[number : number + 1], words, t)
    return got.ravel()[: n - number * size]


def tokenize(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids: little-endian 16-bit ids of the whole text and the end id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, out = b["text"].tolist(), []
            for i, j in chunks(texts):
                ids, n = encode_texts(texts[i:j], vocabulary)
                ends = np.cumsum(n)
                whole = np.insert(ids, ends, END).astype("<u2")
                ends += np.arange(1, len(ends) + 1)
                data, last = whole.tobytes(), 0
                for e in ends.tolist():
                    out.append(data[2 * last : 2 * e])
                    last = e
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": out})

    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return t.mapInPandas(run, "doc_id long, ids binary")


def frequency_table(tokens: DataFrame) -> Table:
    """From the counts of all ids; at most one row for each of the vocabulary's ids comes to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS, np.int64)
        for b in batches:
            for data in b["ids"]:
                total += np.bincount(np.frombuffer(data, "<u2"), minlength=SYMBOLS) if len(data) > 100_000 else 0
            small = b"".join(x for x in b["ids"] if len(x) <= 100_000)
            total += np.bincount(np.frombuffer(small, "<u2"), minlength=SYMBOLS)
        (seen,) = np.nonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    got = tokens.select("ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS, np.int64)
    counts[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return Table.of_counts(counts)


def encode(docs: DataFrame, vocabulary: str | None = None) -> tuple[DataFrame, bytes]:
    """(shards, packed table). Shards: part, seq, docs, n_ids, payload; in order of (part, seq)."""
    tokens = stored(tokenize(docs, vocabulary), "tokens")
    packed = frequency_table(tokens).pack()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, part, seq, first = Table.unpack(packed), TaskContext.get().partitionId(), 0, 0
        rows: list[tuple[object, bytes]] = []
        size = 0

        def shard():
            ids = np.frombuffer(b"".join(r[1] for r in rows), "<u2")
            lengths = np.array([len(r[1]) // 2 for r in rows], np.int64)
            nulls = np.array([pd.isna(r[0]) for r in rows], bool)
            doc_ids = np.array([0 if z else int(r[0]) for r, z in zip(rows, nulls, strict=True)], np.int64)
            data = encode_shard(doc_ids, nulls, lengths, ids, first, t)
            return pd.DataFrame({"part": [part], "seq": [seq], "docs": [len(rows)], "n_ids": [len(ids)], "payload": [data]})

        for b in batches:
            for row in zip(b["doc_id"].tolist(), b["ids"].tolist(), strict=True):
                rows.append(row)
                size += len(row[1]) // 2
                if size >= SHARD_IDS:
                    yield shard()
                    seq, first, rows, size = seq + 1, first + size, [], 0
        if rows:
            yield shard()

    ordered = tokens.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    return stored(ordered.mapInPandas(run, "part int, seq int, docs long, n_ids long, payload binary"), "shards"), packed


def bases(shards: DataFrame) -> DataFrame:
    """(part, base): ids in all partitions before; one row per partition, never per document."""
    per = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))


def decode(shards: DataFrame, packed: bytes, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids as an array), read from the shards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Table.unpack(packed)
        for b in batches:
            for part, data in zip(b["part"].tolist(), b["payload"].tolist(), strict=True):
                doc_ids, nulls, lengths, ids, first = decode_shard(data, t)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                spans = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
                out = pd.DataFrame({"part": part, "doc_id": pd.array(doc_ids, "Int64"), "at": first + ends - lengths, "n_tokens": lengths})
                out.loc[nulls, "doc_id"] = pd.NA
                out["ids_crc32"] = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in spans]
                if with_ids:
                    out["ids"] = [ids[i:j].astype(np.int32) for i, j in spans]
                yield out

    schema = "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = shards.select("part", "payload").mapInPandas(run, schema)
    # one row per shuffle partition
    starts = stored(bases(shards), "bases")
    out = rows.join(small(starts, starts.count()), "part")
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def export(shards: DataFrame, packed: bytes, folder: str) -> None:
    """Plain files under a mounted folder that all executors see: table.rans and part-*-*.rans."""
    import os

    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/table.rans", "wb") as f:
        f.write(packed)

    def put(rows) -> None:
        for r in rows:
            name = f"{folder}/part-{r['part']:06d}-{r['seq']:06d}.rans"
            with open(f"{name}.tmp", "wb") as f:
                f.write(r["payload"])
            os.replace(f"{name}.tmp", name)

    shards.select("part", "seq", "payload").foreachPartition(put)


def op4_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(*encode(table(spark, sf_dir, "documents")))
