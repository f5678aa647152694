"""Near-duplicate documents: BagMinHash signatures, banding, exact verification, classes.

A document is the multiset of its five-word shingles (a text of one to four words is one
shingle). Its signature has ``BANDS * ROWS`` registers. Weights are discretised to whole
units (here: multiplicities); every shingle and unit owns a Poisson process of points in
time, and a register keeps the earliest point that falls on it, so two registers agree
with exactly the probability of the weighted Jaccard similarity: the estimate is unbiased.

The processes are hierarchical: units are grouped in dyadic intervals (0,1], (1,2], (2,4],
(4,8], ... One process runs per interval at the rate of its width, and a point descends by
binary splits to one unit of it; points of units beyond the weight are skipped. A shingle
of weight w thus runs O(log w) processes, and each stops as soon as its next point is
later than the document's latest register.

Equal multisets are one *node*, so exact copies cost one row each and no pair. Nodes that
share a band are candidates. First each bucket's members are compared with one pivot, and
classes made of the links found. Buckets that then hold more than one class go on: those
of at most ``FEW`` members compare what remains pair by pair (so a member has fewer than
``FEW`` partners there), larger ones block by block with matrix products, leaving out the
pairs within the largest class. Every two members of a bucket that could still join two
classes are compared, so no link is lost; links within a class are not looked for. A
comparison is the exact overlap of the two multisets of shingles, which are told apart by
64-bit hashes (for two texts of a million words the chance of a wrong count is below one in
a million); a link needs a similarity of at least ``SIMILARITY``. Classes are the links' connected components.

Edge cases: texts without words (null, empty, blank) are never linked; null ids sort
behind all others, and a class's id is null only if all its ids are; rows with equal ids
and texts are copies of each other; an empty table gives an empty result; ``dedup`` returns
all columns of its input untouched, whatever their names; texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, drop, small, stored, table
from .pieces import codes, mixed, release, span_hashes

SHINGLE = 5
BANDS, ROWS = 25, 5
M = BANDS * ROWS
SIMILARITY = 0.8
BATCH_CHARS = 2_000_000
#: Narrow tables of pairs (two or three longs a row) are broadcast up to this many rows.
PAIR_ROWS = 1_000_000
#: Members of smaller buckets are compared pair by pair, those of larger ones block by block.
FEW, BLOCK = 16, 256
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, place of each text's first word, with the end as last)."""
    cp, at = codes(texts)
    inside = ~((cp == 32) | ((cp >= 9) & (cp <= 13)))
    edge = np.zeros(len(cp) + 1, bool)
    edge[at] = True
    before = np.append(False, inside)
    now = np.append(inside, False)
    starts = np.flatnonzero(now & (~before | edge))
    ends = np.flatnonzero(before & (~now | edge))
    return span_hashes(cp, starts, ends), np.searchsorted(starts, at)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle, number of its text), text by text."""
    w, at = words(texts)
    n = np.diff(at)
    per = np.where(n >= SHINGLE, n - SHINGLE + 1, n > 0)
    owner = np.repeat(np.arange(len(texts)), per)
    first = at[owner] + np.arange(len(owner)) - (np.cumsum(per) - per)[owner]
    padded = np.append(w, np.zeros(SHINGLE, np.uint64))
    h = np.zeros(len(first), np.uint64)
    for k in range(SHINGLE):
        x = padded[first + k]
        short = n[owner] <= k
        if short.any():
            x = np.where(short, np.uint64(0), x)
        h = h * _A + x + np.uint64(k)
    return mixed(h), owner


def weights(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle, text, multiplicity), sorted by text and shingle."""
    h, owner = shingles(texts)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    return h[starts], owner[starts], np.diff(np.append(starts, len(h)))


def signatures(h: np.ndarray, owner: np.ndarray, weight: np.ndarray, docs: int, m: int = M) -> np.ndarray:
    """(docs, m) registers: the earliest point's time. ``weight``: whole units, at least 1."""
    out = np.full((docs, m), np.inf)
    flat = out.reshape(-1)
    # one process for each shingle and dyadic interval that its weight reaches into
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1
    element = np.repeat(np.arange(len(h)), levels)
    level = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.where(level == 0, 1, low)
    seed, doc, top = mixed(h[element] + level.astype(np.uint64) * _C), owner[element], weight[element]
    rate, now, k = m * width.astype(np.float64), np.zeros(len(element)), 0
    while len(seed):
        g = int(np.clip(20_000 // len(seed), 1, 64))
        # the next g points of every process that still matters
        r = mixed(seed[:, None] + (np.arange(k + 1, k + g + 1).astype(np.uint64) * _B)[None, :])
        u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        t = now[:, None] + np.cumsum(-np.log(u) / rate[:, None], axis=1)
        q = mixed(r ^ _A)
        register = ((q >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        # the lower bits, read as binary digits, are the descent to one unit of the interval
        unit = ((q & np.uint64(0xFFFFFFFF)).astype(np.float64) * (width[:, None] * 2.0**-32)).astype(np.int64)
        hit = low[:, None] + unit < top[:, None]
        np.minimum.at(flat, (doc[:, None] * m + register)[hit], t[hit])
        latest = out.max(axis=1)
        now, k = t[:, -1], k + g
        alive = now <= latest[doc]
        if not alive.all():
            seed, doc, top, low, width, rate, now = (x[alive] for x in (seed, doc, top, low, width, rate, now))
    return out


def bands(registers: np.ndarray) -> np.ndarray:
    """(docs, BANDS) hashes. Single precision, so that a last bit of ``log`` can't part equal points."""
    x = registers.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(len(registers), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1).astype(np.uint64) * _C, (len(registers), BANDS)).copy()
    for k in range(ROWS):
        out = mixed(out * _A + x[:, :, k])
    return out.view(np.int64)


def sketch(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(k1, k2, n, bands): two 64-bit sums that name the multiset, its size, and its band hashes."""
    texts = [t or "" for t in texts]
    h, owner, weight = weights(texts)
    n = np.zeros(len(texts), np.int64)
    np.add.at(n, owner, weight)
    keys = []
    for salt in (_A, _B):
        part, total = mixed((h ^ salt) + weight.astype(np.uint64) * _C), np.zeros(len(texts), np.uint64)
        np.add.at(total, owner, part)
        keys.append(total.view(np.int64))
    return keys[0], keys[1], n, bands(signatures(h, owner, weight, len(texts)))


def elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(element, text): the i-th copy of a shingle is an element of its own, so multisets become sets."""
    h, owner = shingles(texts)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    place = np.arange(len(h))
    ordinal = place - np.maximum.accumulate(np.where(new, place, 0))
    return mixed(h + ordinal.astype(np.uint64) * _B), owner


def overlap(a: list[str], b: list[str]) -> np.ndarray:
    """Weighted Jaccard similarity of each a[i] and b[i], exactly."""
    distinct = list(dict.fromkeys([*a, *b]))
    number = {t: i for i, t in enumerate(distinct)}
    sets: list[np.ndarray] = []
    for i, j in chunks(distinct, BATCH_CHARS):
        x, owner = elements(distinct[i:j])
        sets += np.split(x, np.searchsorted(owner, np.arange(1, j - i)))
    out = np.zeros(len(a))
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        p, q = sets[number[x]], sets[number[y]]
        both = np.sort(np.concatenate([p, q]))
        shared = int((both[1:] == both[:-1]).sum())
        out[k] = shared / max(1, len(p) + len(q) - shared)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """The stored table of rows: doc (all columns), row (unique), k1, k2, n, bands."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    schema = T.StructType([packed.schema["doc"], *T.StructType.fromDDL("row long, k1 long, k2 long, n long, bands array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = pc.struct_field(b.column(0), "text").to_pylist()
            for i, j in chunks(texts, BATCH_CHARS):
                k1, k2, n, x = sketch(texts[i:j])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, BANDS), pa.int32()), pa.array(x.reshape(-1)))
                rows = pa.array(np.arange(row, row + j - i), pa.int64())
                row += j - i
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), rows, pa.array(k1), pa.array(k2), pa.array(n), lists], names=schema.names)

    return stored(packed.mapInArrow(run, schema), "sketch")


def _verified(pairs: DataFrame, n_pairs: int, texts: DataFrame) -> DataFrame:
    """The stored table (a, b, linked) of ``pairs``, by the overlap of their texts."""
    ends = pairs.select("a").distinct()
    left = texts.select(F.col("row").alias("b"), F.col("text").alias("tb")).join(small(pairs, n_pairs, PAIR_ROWS), "b")
    right = texts.select(F.col("row").alias("a"), F.col("text").alias("ta")).join(small(ends, n_pairs, PAIR_ROWS), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, end = pc.utf8_length(b.column("ta")).to_pylist(), 0
            for start, end in chunks([range(s) for s in sizes], BATCH_CHARS):
                part = b.slice(start, end - start)
                s = overlap(part.column("ta").to_pylist(), part.column("tb").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(s >= SIMILARITY - 1e-12)], names=["a", "b", "linked"])

    return stored(left.join(right, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, linked boolean"), "verified")


def components(links: DataFrame) -> DataFrame:
    """The stored table (row, label): each linked row's least reachable row.

    Least neighbours' labels with pointer jumping: the rounds grow with the logarithm of
    a component's diameter.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "row"), "labels")
    n, table_ = labels.count(), labels
    while True:
        of = lambda name, label: small(labels.select(F.col("row").alias(name), F.col("label").alias(label)), n, PAIR_ROWS)
        near = both.join(of("b", "lb"), "b").groupBy("a").agg(F.min("lb").alias("lb")).withColumnRenamed("a", "row")
        step = labels.join(small(near, n, PAIR_ROWS), "row").select("row", F.col("label").alias("old"), F.least("label", "lb").alias("l"))
        step = step.join(of("l", "jumped"), "l")
        new = stored(step.select("row", F.least("l", "jumped").alias("label"), "old"), "labels")
        moved = new.where(F.col("label") != F.col("old")).limit(1).count()
        drop(table_)
        table_, labels = new, new.select("row", "label")
        if not moved:
            drop(both)
            return labels


def _classed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("row"))
    return members.join(small(labels, labels.count(), PAIR_ROWS), "row", "left").withColumn("label", F.coalesce("label", "row"))


def _open(members: DataFrame) -> DataFrame:
    """The stored members of buckets that still hold more than one class; of buckets with equal members, one."""
    per = members.groupBy("h").agg(
        F.min("label").alias("_lo"),
        F.max("label").alias("_hi"),
        F.bit_xor(F.xxhash64("row")).alias("_x"),
        F.bit_xor(F.xxhash64("row", F.lit(1))).alias("_y"),
        F.count(F.lit(1)).alias("c"),
    )
    per = per.where(F.col("_lo") != F.col("_hi")).groupBy("_x", "_y", "c").agg(F.min("h").alias("h")).select("h")
    per = stored(per, "open")
    return stored(members.join(small(per, per.count(), PAIR_ROWS), "h"), "members")


def _like(x, y):
    """Sizes that a similarity of SIMILARITY allows."""
    return F.least(x, y) >= F.greatest(x, y) * (SIMILARITY - 1e-12)


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(row, label) of the linked nodes. ``nodes``: row, n, bands; ``texts``: row, text."""
    long_ = nodes.select("row", "n", F.explode("bands").alias("h"))
    shared = long_.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("row"), "row", "n")).alias("f"))
    # the bucket's pivot: the least hash, so the same node in as many bands as possible
    shared = stored(shared.where(F.col("c") > 1).select("h", "c", F.col("f.row").alias("pivot"), F.col("f.n").alias("pn")), "buckets")
    n_shared = shared.count()
    if not n_shared:
        return None
    members = stored(long_.join(small(shared, n_shared, PAIR_ROWS), "h"), "members")
    pairs = members.where((F.col("row") != F.col("pivot")) & _like(F.col("n"), F.col("pn"))).select(F.col("pivot").alias("a"), F.col("row").alias("b"))
    pairs = stored(_unordered(pairs), "pairs")
    tried = _verified(pairs, pairs.count(), texts)
    found = tried.where("linked").select("a", "b")
    labels = components(found) if found.limit(1).count() else None
    # a bucket of two is settled; in others, members of different classes may still be linked
    rest = _open(_classed(members.where("c > 2").select("h", "c", "row", "n"), labels))
    few = rest.where(F.col("c") <= FEW)
    other = few.select("h", F.col("row").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    # at most FEW partners for each member
    pairs = few.join(other, "h").where((F.col("row") < F.col("b")) & (F.col("label") != F.col("lb")) & _like(F.col("n"), F.col("nb")))
    pairs = _unordered(pairs.select(F.col("row").alias("a"), "b")).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    pairs = stored(pairs, "pairs")
    more = _verified(pairs, pairs.count(), texts).where("linked").select("a", "b").unionByName(_blocks(rest.where(F.col("c") > FEW), texts))
    more = stored(more, "more")
    if more.limit(1).count():
        labels = components(found.unionByName(more))
    return labels


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _blocks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links between the classes of large buckets, enough to join all classes that any link joins.

    A bucket's largest class is dealt into blocks of about BLOCK members, and so are all
    other members together. Each block of others meets each block of either kind once, in
    one task that compares them all by matrix products; within the largest class nothing
    is compared. A member is sent once for each block that it meets.
    """
    sizes = members.groupBy("h", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.max(F.struct("k", "label")).alias("m"), F.sum("k").alias("c"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.select("h", F.col("m.label").alias("main"), blocks(F.col("m.k")).alias("nm"), blocks(F.col("c") - F.col("m.k")).alias("nu"))
    dealt = members.select("h", "row", "label").join(sizes, "h").withColumn("in_main", F.col("label") == F.col("main"))
    dealt = dealt.withColumn("k", F.pmod(F.xxhash64("row"), F.when(F.col("in_main"), F.col("nm")).otherwise(F.col("nu"))).cast("int"))
    key = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    us, ms = F.sequence(F.lit(0), F.col("nu") - 1), F.sequence(F.lit(0), F.col("nm") - 1)
    meets = F.when(F.col("in_main"), F.transform(us, lambda u: key(0, u, F.col("k")))).otherwise(
        F.concat(F.transform(ms, lambda m: key(0, F.col("k"), m)), F.transform(us, lambda u: key(1, F.least(u, F.col("k")), F.greatest(u, F.col("k")))))
    )
    dealt = stored(dealt.select("h", "row", "label", F.explode(meets).alias("g")), "dealt")
    n = dealt.count()
    whole = texts.join(small(dealt, n, PAIR_ROWS), "row").select("h", "g", "row", "label", "text")

    def compare(t: pa.Table) -> pa.Table:
        return pa.table(dict(zip("ab", joined(*(t.column(c).to_pylist() for c in ("row", "label", "text"))), strict=True)))

    return whole.groupBy("h", "g").applyInArrow(compare, "a long, b long")


def joined(rows: list[int], labels: list[int], texts: list[str]) -> tuple[pa.Array, pa.Array]:
    """Links of one block: enough to join all labels that any link joins."""
    x, owner = elements(texts)
    keys, where, n = np.unique(x, return_inverse=True, return_counts=True)
    # elements of one text alone are in no overlap
    both = n[where] > 1
    column = (np.cumsum(n > 1) - 1)[where[both]]
    size, doc = np.bincount(owner, minlength=len(rows)).astype(np.float32), owner[both]
    shared, width = np.zeros((len(rows), len(rows)), np.float32), 4096
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (first, first + width))
        m = np.zeros((len(rows), width), np.float32)
        m[doc[a:b], column[a:b] - first] = 1
        shared += m @ m.T
    alike = shared >= (SIMILARITY - 1e-9) * (size[:, None] + size[None, :] - shared)
    label = np.array(labels)
    i, j = np.nonzero(np.triu(alike & (label[:, None] != label[None, :]), 1))
    up = {k: k for k in labels}

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    out: tuple[list, list] = [], []
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        u, v = top(labels[p]), top(labels[q])
        if u != v:
            up[u] = v
            out[0].append(min(rows[p], rows[q]))
            out[1].append(max(rows[p], rows[q]))
    return pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())


def classes(rows: DataFrame) -> DataFrame:
    """row, doc_id, class_id, keeper (the row that stands for its class) for every row of ``sketches``."""
    narrow = rows.select("row", F.col("doc.doc_id").alias("doc_id"), "k1", "k2", "n")
    rank = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    full = rows.select("row", F.col("doc.doc_id").alias("doc_id"), "k1", "k2", "n", "bands").where("n > 0")
    nodes = full.groupBy("k1", "k2").agg(F.min(rank).alias("f"), F.min_by(F.struct("n", "bands"), rank).alias("s"))
    nodes = stored(nodes.select("k1", "k2", "f", F.col("f.row").alias("row"), "s.n", "s.bands"), "nodes")
    labels = links(nodes.select("row", "n", "bands"), rows.select("row", F.col("doc.text").alias("text")))
    named = nodes.select("k1", "k2", "f", "row")
    if labels is None:
        named = named.select("k1", "k2", "f")
    else:
        n_labels = labels.count()
        named = named.join(small(labels, n_labels, PAIR_ROWS), "row", "left")
        heads = named.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("f").alias("head"))
        named = named.join(small(heads, n_labels, PAIR_ROWS), "label", "left").select("k1", "k2", F.coalesce("head", "f").alias("f"))
    out = narrow.join(named, ["k1", "k2"], "left")
    alone = F.col("n") == 0
    return out.select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("f.id")).alias("class_id"),
        F.when(alone, F.col("row")).otherwise(F.col("f.row")).alias("keeper"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: that with the least id."""
    rows = sketches(docs)
    dropped = stored(classes(rows).where(F.col("row") != F.col("keeper")).select("row"), "dropped")
    kept = rows.join(small(dropped, dropped.count(), PAIR_ROWS), "row", "left_anti")
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(sketches(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "class_id")
