"""Byte-level BPE by whole arrays: split into pieces with numpy, tokenize each distinct piece once.

The pattern of the vocabulary cuts a text into pieces, and BPE never crosses a piece's
border. Real text repeats its pieces, so a batch of texts is cut with array operations,
each distinct piece is looked up by a 64-bit hash, and only pieces new to the worker are
tokenized, by the tokenizers library's own BPE. A hit counts only if its code points are
those that are stored, so no result rests on the hash.

Classes of code points (letter, number, white space, other) come from a table made with
the ``regex`` module. Where Unicode's versions may differ (``_doubts``), the text is cut
by the library's own pre-tokenizer.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache
from itertools import repeat

import numpy as np

END_TEXT = "<|endoftext|>"
END_ID = 50256
#: Pieces kept in a worker's memory; beyond it the store starts anew (a bound on memory, not on results).
KEPT = 500_000
#: New pieces that are gathered before they are merged into the sorted ones.
PENDING = 100_000
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Spans of more values are hashed one by one.
LONG = 64
_CONTRACTIONS = (("s",), ("t",), ("m",), ("d",), ("r", "e"), ("v", "e"), ("l", "l"))
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))
_ONE, _TWO = np.uint64((1 << 21) - 1), np.uint64((1 << 42) - 1)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    import regex

    n = 0x110000
    out = np.full(n, OTHER, np.uint8)
    chars = [c for c in range(n) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, chars))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, text):
            a, b = chars[m.start()], chars[m.end() - 1]
            out[a : b + 1][: b - a + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


@lru_cache(maxsize=1)
def _doubts() -> np.ndarray:
    """Code points whose class isn't the one that Unicode 3.2 gave them: newer tables differ there."""
    from unicodedata import ucd_3_2_0

    kinds = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    then = np.fromiter((kinds.get(ucd_3_2_0.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    then[9:14] = SPACE
    return then != classes()


def doubtful(texts: list[str]) -> list[int]:
    """Which of the texts hold a code point of doubtful class."""
    some = [i for i, t in enumerate(texts) if not t.isascii()]
    if not some:
        return []
    cp, at = codes([texts[i] for i in some])
    hit = np.flatnonzero(_doubts()[cp])
    return [some[k] for k in np.unique(np.searchsorted(at, hit, side="right") - 1).tolist()] if len(hit) else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, and the place of each text's first (with the end as last)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return cp, at


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for each span; equal spans have equal hashes.

    Step by step, each multiplies and shifts what is there so far: no sum over places that
    other values could cancel. A step takes a 64-bit value, or three code points (32-bit
    values), of 21 bits each. Long spans are hashed by BLAKE2b.
    """
    n = ends - starts
    h = n.astype(np.uint64) * _K2 + _K3
    for i in np.flatnonzero(n > LONG).tolist():
        data = values[starts[i] : ends[i]].astype("<u8").tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")
    size = np.where(n > LONG, 0, n).astype(np.uint8)
    order = np.argsort(LONG - size, kind="stable")
    at, now = starts[order], h[order]
    # spans in order of length: so many have at least k values
    least = len(n) - np.cumsum(np.bincount(size + 1, minlength=LONG + 6)[: LONG + 5])
    wide = values.astype(np.uint64)
    step = 3 if values.dtype == np.uint32 else 1
    if step == 3:
        one = wide.copy()
        wide[:-1] |= one[1:] << np.uint64(21)
        wide[:-2] |= one[2:] << np.uint64(42)
    for k in range(0, LONG, step):
        m = int(least[k + 1])
        if not m:
            break
        x, v = now[:m], wide[at[:m] + k]
        if step == 3:
            two, three = int(least[k + 2]), int(least[k + 3])
            v[three:two] &= _TWO
            v[two:] &= _ONE
        v *= _K1
        x ^= v
        x *= _K2
        x ^= x >> np.uint64(32)
    h[order] = now
    return mixed(h)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values in order, a place of each, the number of each place's value)."""
    order = np.argsort(h)
    s = h[order]
    new = np.ones(len(h), bool)
    new[1:] = s[1:] != s[:-1]
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return s[new], order[new], back


def differing(values: np.ndarray, starts: np.ndarray, n: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which spans ``values[start:start + n]`` are not ``other[at:at + n]``."""
    out = np.zeros(len(n), bool)
    ends = np.cumsum(n)
    inside = np.arange(int(ends[-1]) if len(n) else 0) - np.repeat(ends - n, n)
    wrong = values[inside + np.repeat(starts, n)] != other[inside + np.repeat(at, n)]
    if wrong.any():
        out[np.searchsorted(ends, np.flatnonzero(wrong), side="right")] = True
    return out


def split(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces start in the joined code points ``cp`` of texts that start at ``at``.

    The pattern in words: a contraction ('s 't 're 've 'm 'll 'd); a run of letters, of numbers or of
    other signs, with the one blank before it; a run of white space, less its last
    sign if a non-blank follows; that last sign by itself, unless it is the blank
    that the next piece takes.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    first = np.zeros(n, bool)
    first[at[:-1][at[:-1] < n]] = True
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # the last white space of a run with something behind it (in the same text) stands apart
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start |= before
    # a blank joins what follows
    blank = before & (cp == 32)
    joins = np.flatnonzero(blank) + 1
    start[joins] = False
    # contractions: where an other-run could begin a piece with its apostrophe
    marks = np.flatnonzero(cp == 39)
    if len(marks):
        _contract(cp, kind, start, first, at, marks)
    return np.flatnonzero(start)


def _contract(cp, kind, start, first, at, marks) -> None:
    n = len(cp)
    ends = at[np.searchsorted(at, marks, side="right")]
    # only an apostrophe at which a piece starts: pieces of other signs are cut only at their start
    free = start[marks]
    marks, ends = marks[free], ends[free]
    c1 = np.where(marks + 1 < ends, cp[np.minimum(marks + 1, n - 1)], 0)
    c2 = np.where(marks + 2 < ends, cp[np.minimum(marks + 2, n - 1)], 0)
    size = np.zeros(len(marks), np.int64)
    for tail in _CONTRACTIONS:
        if len(tail) == 1:
            size[c1 == ord(tail[0])] = 2
    for tail in _CONTRACTIONS:
        if len(tail) == 2:
            size[(c1 == ord(tail[0])) & (c2 == ord(tail[1]))] = 3
    hit = size > 0
    marks, size, ends = marks[hit], size[hit], ends[hit]
    for k in (1, 2):
        inside = marks[size > k] + k
        start[inside] = False
    after = marks + size
    ok = after < ends
    start[after[ok]] = True
    # white space behind keeps its own cuts; a letter run that follows starts a new piece, which was set above


@lru_cache(maxsize=1)
def _byte_signs() -> list[str]:
    """The sign that stands for each byte in the vocabulary: itself where it is printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Library:
    """The tokenizers library's vocabulary, pre-tokenizer and BPE."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.model, self.cutter = self.whole.model, self.whole.pre_tokenizer
        signs = _byte_signs()
        self.signs = {b: c for b, c in enumerate(signs)}
        byte_of = {c: b for b, c in enumerate(signs)}
        special = self.whole.get_added_tokens_decoder()
        #: bytes of each id; of special ones, their text's
        self.bytes_of = {i: special[i].content.encode() if i in special else bytes(byte_of[c] for c in t) for t, i in self.whole.get_vocab().items()}
        self.id_of = {b: i for i, b in self.bytes_of.items() if i not in special}

    def ids(self, piece: bytes) -> list[int]:
        """Ids of one piece's bytes."""
        return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.signs))]

    def cuts(self, text: str) -> list[int]:
        """Where the library's own pre-tokenizer starts a piece."""
        return [a for _, (a, _) in self.cutter.pre_tokenize_str(text)]


class Pieces:
    """Token ids of pieces, kept from batch to batch in one worker."""

    most = KEPT

    def __init__(self, path: str | None = None):
        self.library = Library(path)
        self.clear()

    def clear(self) -> None:
        # hashes of known pieces in order, with their places; new ones wait in a small dict
        self.keys, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.pending: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, np.uint16)
        self.starts, self.counts = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        #: the code points of each piece
        self.signs, self.sign_at, self.sign_n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = self.known = self.signs_used = 0

    def _room(self, name: str, need: int) -> np.ndarray:
        x = getattr(self, name)
        if need > len(x):
            x = np.concatenate([x, np.zeros(max(need, 2 * len(x)) - len(x), x.dtype)])
            setattr(self, name, x)
        return x

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Places of pieces by their sorted hashes; -1 where a piece is new."""
        out = np.full(len(keys), -1, np.int64)
        if len(self.keys):
            i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[i] == keys
            out[hit] = self.where[i[hit]]
        if self.pending:
            rest = np.flatnonzero(out < 0)
            out[rest] = np.fromiter(map(self.pending.get, keys[rest].tolist(), repeat(-1)), np.int64, len(rest))
        return out

    def _remember(self, keys: np.ndarray, places: np.ndarray) -> None:
        self.pending.update(zip(keys.tolist(), places.tolist(), strict=True))
        if len(self.pending) > PENDING:
            n = len(self.pending)
            keys = np.concatenate([self.keys, np.fromiter(self.pending.keys(), np.uint64, n)])
            where = np.concatenate([self.where, np.fromiter(self.pending.values(), np.int32, n)])
            order = np.argsort(keys, kind="stable")
            self.keys, self.where, self.pending = keys[order], where[order], {}

    def _values(self, piece: bytes) -> tuple[list[int], int]:
        """(what is kept of a piece, its number of tokens)."""
        ids = self.library.ids(piece)
        return ids, len(ids)

    def _add(self, cp: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Tokenizes pieces and returns their places."""
        ends = np.cumsum(n)
        inside = np.arange(int(ends[-1])) + np.repeat(starts - (ends - n), n)
        signs = cp[inside]
        text = signs.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        found, sizes, totals = [], [], []
        for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
            got, total = self._values(text[a:b].encode("utf-8", "replace"))
            found += got
            sizes.append(len(got))
            totals.append(total)
        k, m, u, v = self.known, len(n), self.used, self.signs_used
        self._room("pool", u + len(found))[u : u + len(found)] = found
        self._room("signs", v + len(signs))[v : v + len(signs)] = signs
        for name, x in (("starts", u + np.cumsum(sizes) - sizes), ("counts", totals), ("sign_at", v + ends - n), ("sign_n", n)):
            self._room(name, k + m)[k : k + m] = x
        self.used, self.known, self.signs_used = u + len(found), k + m, v + len(signs)
        return np.arange(k, k + m)

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code points, places of the texts, starts of the pieces)."""
        cp, at = codes(texts)
        starts = split(cp, at)
        odd = doubtful(texts)
        if odd:
            keep = np.ones(len(starts), bool)
            for i in odd:
                keep[np.searchsorted(starts, at[i]) : np.searchsorted(starts, at[i + 1])] = False
            own = [at[i] + np.array(self.library.cuts(texts[i]), np.int64) for i in odd]
            starts = np.sort(np.concatenate([starts[keep], *own]))
        return cp, at, starts

    def places(self, cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The store's place of every piece."""
        if self.known > self.most:
            self.clear()
        if not len(starts):
            return np.zeros(0, np.int64)
        n = np.diff(np.append(starts, len(cp)))
        unique, where, back = distinct(span_hashes(cp, starts, starts + n))
        first, size = starts[where], n[where]
        place = self._places(unique)
        hit = np.flatnonzero(place >= 0)
        if len(hit):
            p = place[hit]
            same = self.sign_n[p] == size[hit]
            same[same] = ~differing(cp, first[hit][same], size[hit][same], self.signs, self.sign_at[p][same])
            place[hit[~same]] = -2  # another piece has this hash: it is tokenized anew each time
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            new = place[fresh] == -1
            place[fresh] = self._add(cp, first[fresh], size[fresh])
            self._remember(unique[fresh[new]], place[fresh[new]])
        out = place[back]
        # pieces of one hash within the batch
        odd = n != size[back]
        like = np.where(odd, starts, first[back])  # of another length: odd in any case
        wrong = cp != cp[np.arange(len(cp)) + np.repeat(like - starts, n)]
        if wrong.any() or odd.any():
            odd[np.searchsorted(starts, np.flatnonzero(wrong), side="right") - 1] = True
            i = np.flatnonzero(odd)
            out[i] = self._add(cp, starts[i], n[i])
        return out

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the store's place of every piece, number of pieces of every text)."""
        cp, at, starts = self.cut(texts)
        per = np.searchsorted(starts, at[1:]) - np.searchsorted(starts, at[:-1])
        return self.places(cp, starts), per

    def ids(self, place: np.ndarray) -> np.ndarray:
        """All ids of the pieces one after another."""
        counts = self.counts[place]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.starts[place] - (ends - counts), counts) + np.arange(total)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, number of ids of every text)."""
        place, per = self.look_up(texts)
        return self.ids(place), self._summed(place, per)

    def count(self, texts: list[str]) -> np.ndarray:
        return self._summed(*self.look_up(texts))

    def _summed(self, place: np.ndarray, per: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(self.counts[place]))
        border = np.append(0, np.cumsum(per))
        return sums[border[1:]] - sums[border[:-1]]


@lru_cache(maxsize=2)
def shared(path: str | None = None) -> Pieces:
    """The worker's store; it outlives tasks where workers are reused."""
    return Pieces(path)


def release() -> None:
    """Gives the store's memory back, for a worker that goes on to work without pieces."""
    shared.cache_clear()


def encode_texts(texts: list[str | None], path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their numbers per text (null: none), special strings as the library takes them by default."""
    texts = [t or "" for t in texts]
    if not any(END_TEXT in t for t in texts):
        return shared(path).encode(texts)
    parts = [t.split(END_TEXT) for t in texts]
    ids, per = shared(path).encode([x for p in parts for x in p])
    out, n, i, a = [], [], 0, 0
    for p in parts:
        size = 0
        for k in range(len(p)):
            if k:
                out.append(np.array([END_ID], np.uint16))
            out.append(ids[a : a + per[i]])
            a += per[i]
            size += per[i] + (k > 0)
            i += 1
        n.append(size)
    return np.concatenate(out), np.array(n, np.int64)
