"""Token counts by prefix dynamic programming.

For byte-pair encodings, the encoding of every prefix of a piece ends in exactly one
token ``t``, and what is before ``t`` is the encoding of the shorter prefix. So, from
left to right, ``count[i] = count[i - len(t)] + 1`` where ``t`` is the one vocabulary
entry that ends at ``i`` and may follow the last token of the prefix before it. Whether
two tokens may stand side by side is the library's own answer for the two together,
remembered per pair. The table answers counts, truncation to a budget and budget
checks for every prefix without encoding again, in time linear in the piece.

Distinct pieces of a batch are looked up in the worker's store (see ``pieces``: a hit is
compared sign by sign), so the programme runs once for each piece that a worker meets.

Edge cases: null text counts as empty (0 tokens, 0 bytes); texts are taken whole, however
long; special strings in a text are one token, as the library's default has it; repeated
rows each get their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, mapped, table
from .pieces import END_TEXT, SPACE, Pieces, classes

LIMIT = 1024


class PrefixTable(Pieces):
    """For each known piece: the exact token count of each of its byte prefixes."""

    #: The programme is slow for a new piece, so more are kept: some 60 bytes each.
    most = 3_000_000

    def __init__(self, path: str | None = None):
        super().__init__(path)
        self.rank = self.library.id_of
        self.longest = max(map(len, self.rank))
        self.beside: dict[tuple[bytes, bytes], bool] = {}

    def clear(self) -> None:
        super().clear()
        self.pool = self.pool.astype(np.uint32)

    def _fits(self, a: bytes, b: bytes) -> bool:
        known = self.beside.get((a, b))
        if known is None:
            if len(self.beside) > 1_000_000:
                self.beside.clear()
            known = self.beside[a, b] = self.library.ids(a + b) == [self.rank[a], self.rank[b]]
        return known

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Tokens of piece[:1], piece[:2], ... by dynamic programming."""
        counts, last, rank = [0], [b""], self.rank
        for end in range(1, len(piece) + 1):
            for size in range(min(end, self.longest), 0, -1):
                token = piece[end - size : end]
                if token in rank:
                    before = last[end - size]
                    if self._fits(before, token) if before else size == 1 or self.library.ids(token) == [rank[token]]:
                        counts.append(counts[end - size] + 1)
                        last.append(token)
                        break
        return counts[1:]

    def _values(self, piece: bytes) -> tuple[list[int], int]:
        counts = self.prefix_counts(piece)
        return counts, counts[-1]

    def of_text(self, text: str) -> np.ndarray:
        """Exact token count of text[:0], text[:1], ..., text[:len(text)] (by code points)."""
        out = np.zeros(1, np.int64)
        for k, part in enumerate(text.split(END_TEXT)):
            if k:
                # inside a special string, what is there so far is still ordinary text
                seen = before + END_TEXT  # noqa: F821
                tail = [self._plain(seen[: len(before) + i])[-1] for i in range(1, len(END_TEXT))]  # noqa: F821
                base = out[-1] - self._plain(before)[-1]  # noqa: F821
                out = np.concatenate([out, base + np.array(tail), [out[-1] + 1]])
            out = np.concatenate([out, out[-1] + self._plain(part)[1:]])
            before = part
        return out

    def _plain(self, text: str) -> np.ndarray:
        out = np.zeros(len(text) + 1, np.int64)
        cp, _, starts = self.cut([text])
        place = self.places(cp, starts)
        space = (classes()[cp] == SPACE).tolist()
        total, run = 0, 0
        for k, (s, p) in enumerate(zip(starts.tolist(), place.tolist(), strict=True)):
            end = int(starts[k + 1]) if k + 1 < len(starts) else len(text)
            piece = text[s:end]
            table = self.pool[self.starts[p] :]
            bytes_ = np.cumsum([len(c.encode("utf-8", "replace")) for c in piece])
            out[s + 1 : end + 1] = total + table[bytes_ - 1]
            if s and space[s] and space[s - 1]:
                # a prefix that ends in white space takes the whole run as one piece
                whole = self.prefix_counts(text[run : s + 1].encode("utf-8", "replace"))[-1]
                out[s + 1] = out[run] + whole
            elif space[s]:
                run = s
            if len(piece) == 3 and piece[0] == "'" and piece[1:] in ("re", "ve", "ll"):
                out[s + 2] = total + 2  # cut in two, it is no contraction: an apostrophe and a letter
            total += int(self.counts[p])
            out[end] = total if end == len(text) or not (space[end - 1] and space[s]) else out[end]
        return out

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens."""
        return text[: int(np.flatnonzero(self.of_text(text) <= budget)[-1])]


@lru_cache(maxsize=2)
def prefix_table(path: str | None = None) -> PrefixTable:
    return PrefixTable(path)


def count_texts(texts: list[str | None], path: str | None = None) -> np.ndarray:
    """Token count per text, from the prefix tables' last entries."""
    parts = [(t or "").split(END_TEXT) for t in texts]
    per = np.array([len(p) for p in parts], np.int64)
    got = prefix_table(path).count([x for p in parts for x in p])
    sums = np.append(0, np.cumsum(got))
    ends = np.cumsum(per)
    return sums[ends] - sums[ends - per] + per - 1


def count(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""

    def run(texts):
        texts = texts.to_pylist()
        n = [count_texts(texts[i:j], path) for i, j in chunks(texts)]
        return (np.concatenate(n) if n else np.zeros(0, np.int64),)

    t = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return mapped(t, ["text"], run, "n_tokens long", ["doc_id", "n_bytes"]).withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"))


