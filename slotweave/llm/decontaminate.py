"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``m`` characters may differ from a passage by ``k = floor(m * ERROR_RATE)``
edits. Cut into ``k + 1`` pieces, at least one piece is untouched in any such passage. All
pieces of all items go into one Aho-Corasick automaton; each exact hit names a window of
``m + 2k`` characters, and Myers' bit-parallel algorithm finds the least edit distance
between the item and any passage of the window. Nothing within the budget is missed and
nothing beyond it is reported.

Items and texts are compared in lower case, with every run of other than letters and
digits as one blank; edits are counted on that form.

The benchmark is the query set: it is read in blocks of ``BLOCK_CHARS`` characters, which
bounds the automaton in every task, and each block is held against all documents, whole
texts. Documents are never shuffled.

Items of fewer than ``MIN_ITEM`` characters are found as whole words without edits, and only
reported: any text may hold them by chance, so ``clean`` removes no document for them.

Edge cases: null or empty texts and items match nothing; a document with
several items gives a row for each, with the least distance and the first place that has
it; repeated rows each give theirs; empty tables give an empty result or leave all
documents; other columns are ignored by ``matches`` and returned untouched by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import table

ERROR_RATE = 0.08
MIN_ITEM = 20
BLOCK_CHARS = 1_000_000
#: Combining marks are parts of words.
_OTHER = regex.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def budget(m: int, rate: float = ERROR_RATE) -> int:
    return int(m * rate)


def cut(item: str, pieces: int) -> list[tuple[int, str]]:
    """(place, piece): ``pieces`` parts of nearly equal length."""
    at = [i * len(item) // pieces for i in range(pieces + 1)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:], strict=False)]


class Pattern:
    """Myers' bit vectors of one item."""

    def __init__(self, item: str):
        self.m = len(item)
        self.item = item
        self.ones = (1 << self.m) - 1
        self.top = 1 << (self.m - 1)
        self.eq: dict[str, int] = {}
        for i, c in enumerate(item):
            self.eq[c] = self.eq.get(c, 0) | (1 << i)

    def best(self, text: str) -> tuple[int, int]:
        """(least edit distance to any passage of ``text``, end of the first such passage)."""
        vp, vn, score, best, end = self.ones, 0, self.m, self.m, 0
        eq, ones, top = self.eq.get, self.ones, self.top
        for j, c in enumerate(text, 1):
            x = eq(c, 0) | vn
            d0 = (((x & vp) + vp) ^ vp) | x
            hn = vp & d0
            hp = (vn | ~(vp | d0)) & ones
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
                if score < best:
                    best, end = score, j
            x = (hp << 1) & ones
            vn = x & d0
            vp = ((hn << 1) | ~(x | d0)) & ones
        return best, end


class Matcher:
    """One block of items, ready to be looked for."""

    def __init__(self, items: list[tuple[object, str]], rate: float = ERROR_RATE):
        import ahocorasick

        self.ids, self.patterns, self.k = [], [], []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            n = len(self.ids)
            self.ids.append(item_id)
            self.patterns.append(Pattern(text))
            self.k.append(budget(len(text), rate) if len(text) >= MIN_ITEM else 0)
            # a short item is looked for as whole words, without edits
            whole = [(-1, f" {text} ")] if len(text) < MIN_ITEM else cut(text, self.k[-1] + 1)
            for at, piece in whole:
                found.setdefault(piece, []).append((n, at + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, where)
        if found:
            self.automaton.make_automaton()

    def search(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """(item id, distance, start, end) of each item within its budget; places in the normal form."""
        text = normal(text)
        if not text or not self.ids:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        short: dict[int, int] = {}
        # with a blank at both ends, so that words at the text's ends have borders, too
        for end, where in self.automaton.iter(f" {text} "):
            end -= 1
            for n, inside in where:
                if self.patterns[n].m < MIN_ITEM:
                    short.setdefault(n, end - self.patterns[n].m)
                    continue
                k, m = self.k[n], self.patterns[n].m
                start = end + 1 - inside
                a, b = max(0, start - k), min(len(text), start + m + k)
                if b - a >= m - k:
                    windows.setdefault(n, []).append((a, b))
        out = [(self.ids[n], 0, at, at + self.patterns[n].m) for n, at in short.items()]
        for n, spans in windows.items():
            best = self._verify(n, spans, text)
            if best is not None:
                out.append((self.ids[n], *best))
        return out

    def _verify(self, n: int, spans: list[tuple[int, int]], text: str) -> tuple[int, int, int] | None:
        p, k = self.patterns[n], self.k[n]
        at = text.find(p.item)
        if at >= 0:
            return 0, at, at + p.m
        spans.sort()
        merged = [spans[0]]
        for a, b in spans[1:]:
            if a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        found = None
        for a, b in merged:
            d, end = p.best(text[a:b])
            if d <= k and (found is None or d < found[0]):
                found = (d, a + end)
        if found is None:
            return None
        # the passage's start: the same search on both strings reversed, from its end
        d, end = found
        low = max(0, end - p.m - k)
        back = Pattern(p.item[::-1]).best(text[low:end][::-1])[1]
        return d, end - back, end


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS, least: int = 1) -> Iterator[list[tuple[object, str]]]:
    """The items of at least ``least`` characters in normal form, in blocks of at most ``most`` (a longer item alone)."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        text = normal(r["text"])
        if len(text) < least:
            continue
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((r["item_id"], text))
        size += len(text)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, distance, start, end for every item that a document holds within its budget."""
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"]])
    for name in ("distance", "start", "end"):
        schema = schema.add(name, "long")
    kinds = to_arrow_schema(schema).types[1:]

    def searcher(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Matcher(block, rate)
            for b in batches:
                rows, hits = [], []
                for i, text in enumerate(b.column("text").to_pylist()):
                    for hit in m.search(text):
                        rows.append(i)
                        hits.append(hit)
                columns = list(zip(*hits, strict=True)) if hits else [()] * 4
                arrays = [b.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

        return run

    out = None
    for block in blocks(benchmark):
        part = docs.select("doc_id", "text").mapInArrow(searcher(block), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """``docs`` without the documents that hold an item of at least ``MIN_ITEM`` characters within its budget.

    Shorter items are words that any text may hold by chance; ``matches`` tells where they are.
    """

    def filter_by(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Matcher(block, rate)
            for b in batches:
                yield b.filter(pa.array([not m.search(t) for t in b.column("text").to_pylist()], pa.bool_()))

        return run

    for block in blocks(benchmark, least=MIN_ITEM):
        docs = docs.mapInArrow(filter_by(block), docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
