"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 per language: absolute discounts per order from the counts of counts,
continuation counts below the highest order, and a uniform floor over all characters. The
models live in sorted arrays of 64-bit n-gram hashes, one per order and shared by the
languages, with a row of interpolated log probabilities (a column per language); a second
array per order holds the back-off weights of the contexts. A text is scored by binary
search: n-grams that no language knows fall back to the next lower order.

Texts are lower-cased; a run of other than letters is one blank. The language with the
lowest cross-entropy per character wins, ties going to the first by code point. Rejection
is calibrated: documents of the sample that the models were not fitted to give each
language's usual cross-entropy, and a text far above it (``REJECT`` standard deviations) is
marked ``rejected`` and its score lowered. The score is the posterior over languages.

Fit: a sample of at most ``DOCS_PER_LANG`` labelled documents per language, those with the
least hashes of their ids; of a longer one a passage of ``MAX_SAMPLE_CHARS`` characters at
a place that a second hash chooses, so that a language with long documents alone is learned,
too. One in ``ASIDE`` of them, by the second hash, calibrates. Predictions read whole texts
of all documents.

Edge cases: null texts and texts without a letter are ``und`` with score 0, as is every
text if there is nothing to learn from; rows without a language don't teach; repeated rows
each get theirs; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, crc_mod, mapped, table
from .pieces import LETTER, classes, codes, mixed

ORDER = 4
DOCS_PER_LANG, MAX_SAMPLE_CHARS, ASIDE = 600, 20_000, 5
REJECT = 4.0
BITS60 = 1 << 60
#: A text speaks for its language with at most so many independent characters.
WEIGHT_CHARS = 64
BLOCK = 1 << 17
UNKNOWN = "und"
_P = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xD6E8FEB86659FD93)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, their text, which count, letters per text).

    Each text starts with ORDER - 1 blanks that are context only; a run of other than
    letters is one blank.
    """
    cp, at = codes([t.lower() for t in texts])
    letter = classes()[cp] == LETTER
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    letters = np.bincount(owner[letter], minlength=len(texts))
    x = np.where(letter, cp, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])
    x, owner = x[keep], owner[keep]
    n = np.bincount(owner, minlength=len(texts))
    pad = ORDER - 1
    starts = np.cumsum(n) - n
    x = np.insert(x, np.repeat(starts, pad), np.uint32(32))
    all_ = np.repeat(np.arange(len(texts)), n + pad)
    counts = np.ones(len(x), bool)
    first = np.cumsum(n + pad) - (n + pad)
    for k in range(pad):
        counts[first + k] = False
    return x, all_, counts, letters


def grams(x: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1- to ORDER-gram that ends at each place (undefined where the text has not begun)."""
    out, acc, power = [], np.zeros(len(x), np.uint64), np.uint64(1)
    v = x.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(1, ORDER + 1):
            acc = acc.copy()
            acc[n - 1 :] += v[: len(v) - n + 1] * power
            power = power * _P
            out.append(mixed(acc ^ (_SALT * np.uint64(n))))
    return out


def _find(keys: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.searchsorted(keys, q)
    i[i == len(keys)] = 0
    return i, keys[i] == q if len(keys) else np.zeros(len(q), bool)


class Models:
    """All languages' models in merged arrays."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        size = len(self.langs)
        seen: list[list[tuple]] = [[] for _ in range(ORDER)]
        alphabet = set()
        for lang in self.langs:
            x, _, counts, _ = symbols(texts[lang])
            alphabet.update(np.unique(x).tolist())
            g = grams(x)
            places = np.flatnonzero(counts)
            context = lambda n: g[n - 2][places - 1] if n > 1 else np.zeros(len(places), np.uint64)  # noqa: B023, E731
            # distinct n-grams with counts; below the highest order the distinct longer n-grams are counted
            key, first, c = np.unique(g[ORDER - 1][places], return_index=True, return_counts=True)
            for n in range(ORDER, 0, -1):
                ctx = context(n)[first]
                low = g[n - 2][places][first] if n > 1 else None
                seen[n - 1].append((key, ctx, low, c))
                if n > 1:
                    key2, index, c = np.unique(low, return_index=True, return_counts=True)
                    first, key = first[index], key2
        self.floor = -np.log2(len(alphabet) + 1.0)
        self.keys, self.logp, self.contexts, self.backoff = [], [], [], []
        below = None
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([s[0] for s in seen[n - 1]]))
            ctxs = np.unique(np.concatenate([s[1] for s in seen[n - 1]]))
            p, gamma = np.zeros((len(keys), size)), np.ones((len(ctxs), size))
            ctx_of, low_of = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for k, (key, ctx, low, c) in enumerate(seen[n - 1]):
                n1, n2 = int((c == 1).sum()), int((c == 2).sum())
                d = n1 / (n1 + 2 * n2) if n1 else 0.5
                i, j = np.searchsorted(keys, key), np.searchsorted(ctxs, ctx)
                total, kinds = np.bincount(j, c, len(ctxs)), np.bincount(j, minlength=len(ctxs))
                has = total > 0
                gamma[has, k] = d * kinds[has] / total[has]
                p[i, k] = (c - d) / total[j]
                ctx_of[i] = j
                if n > 1:
                    low_of[i] = np.searchsorted(self.keys[-1], low)
            lower = below[low_of] if n > 1 else np.full((len(keys), size), 2.0**self.floor)
            p += gamma[ctx_of] * lower
            below = p
            self.keys.append(keys)
            self.logp.append(np.log2(p).astype(np.float32))
            self.contexts.append(ctxs)
            self.backoff.append(np.log2(gamma).astype(np.float32))
        self.usual: dict[str, tuple[float, float]] = {}

    def _score(self, n: int, g: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """(places, languages) log2 probabilities from order ``n`` down."""
        i, hit = _find(self.keys[n - 1], g[n - 1])
        out = self.logp[n - 1][i]
        miss = np.flatnonzero(~hit)
        if len(miss):
            if n == 1:
                lower = np.full((len(miss), len(self.langs)), self.floor, np.float32)
                out[miss] = lower + self.backoff[0][0]
            else:
                lower = self._score(n - 1, [x[miss] for x in g[: n - 1]], [x[miss] for x in before[: n - 2]])
                j, known = _find(self.contexts[n - 1], before[n - 2][miss])
                out[miss] = lower + np.where(known[:, None], self.backoff[n - 1][j], np.float32(0))
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits per character by text and language, characters, letters)."""
        total, size, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for i, j in chunks(texts, BLOCK):
            x, owner, counts, letters[i:j] = symbols(texts[i:j])
            g = grams(x)
            places = np.flatnonzero(counts)
            for a in range(0, len(places), BLOCK):
                at = places[a : a + BLOCK]
                s = self._score(ORDER, [y[at] for y in g], [y[at - 1] for y in g[:-1]])
                who = owner[at]
                cut = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
                np.add.at(total, i + who[cut], np.add.reduceat(s, cut, axis=0, dtype=np.float64))
                np.add.at(size, i + who[cut], np.diff(np.append(cut, len(who))))
        return -total / np.maximum(size, 1)[:, None], size, letters

    def calibrate(self, texts: dict[str, list[str]]) -> None:
        for k, lang in enumerate(self.langs):
            e, _, letters = self.entropies(texts.get(lang) or [])
            e = e[letters >= 20, k] if len(e) else np.zeros(0)
            self.usual[lang] = (float(np.median(e)), max(0.05, float(e.std()))) if len(e) >= 5 else (-self.floor, 1.0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        e, size, letters = self.entropies([t or "" for t in texts])
        best = e.argmin(axis=1)
        rows = np.arange(len(texts))
        logits = (e[rows, best][:, None] - e) * (np.minimum(size, WEIGHT_CHARS) * np.log(2))[:, None]
        score = 1 / np.exp(logits).sum(axis=1)
        usual = np.array([self.usual.get(x, (-self.floor, 1.0)) for x in self.langs])
        # short texts vary more, in proportion to the root of their length
        spread = usual[best, 1] * (1 + np.sqrt(200 / np.maximum(size, 1)))
        over = (e[rows, best] - usual[best, 0]) / spread - REJECT
        rejected = over > 0
        score = np.where(rejected, score * np.exp(-np.maximum(over, 0)), score)
        none = letters == 0
        langs = [UNKNOWN if z else self.langs[k] for z, k in zip(none.tolist(), best.tolist(), strict=True)]
        return langs, np.where(none, 0.0, score), rejected | none


def fit(labelled: DataFrame, per_lang: int = DOCS_PER_LANG) -> Models | None:
    """Models from a bounded sample of ``labelled`` (doc_id, text, lang); None without usable rows."""
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # two hashes of 60 bits: one chooses documents, the other, independent of it, those set aside and the passage
    h, other = (F.conv(F.substring(F.md5(F.concat(F.lit(salt), id_).cast("binary")), 1, 15), 16, 10).cast("long") for salt in ("choose:", "aside:"))
    room = F.greatest(F.char_length("text") - MAX_SAMPLE_CHARS, F.lit(0)) + 1
    passage = F.substring(F.col("text"), (F.shiftright(other, 8) % room + 1).cast("int"), F.lit(MAX_SAMPLE_CHARS))
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", h.alias("h"), other.alias("other"), passage.alias("text"))
    # one row per language
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    # a little more than is wanted, so that enough remain; then exactly the least hashes
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(BITS60, int(BITS60 * min(1.0, (1.2 * per_lang + 50) / n))))])
    chosen: dict[str, list[tuple]] = {}
    for r in usable.where(F.col("h") <= F.element_at(share, F.col("lang"))).toLocalIterator():
        chosen.setdefault(r["lang"], []).append((r["h"], r["text"], r["other"] % ASIDE == 0))
    fitted: dict[str, list[str]] = {}
    aside: dict[str, list[str]] = {}
    for lang, rows in chosen.items():
        for _, text, apart in sorted(rows)[:per_lang]:
            (aside if apart else fitted).setdefault(lang, []).append(text)
    for lang, texts in aside.items():
        fitted.setdefault(lang, texts)
    models = Models({k: sorted(v) for k, v in fitted.items()})
    models.calibrate({k: sorted(v) for k, v in aside.items()})
    return models


def identify(docs: DataFrame, models: Models | None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default), lang_pred, score, rejected for every document."""

    def run(texts):
        texts = texts.to_pylist()
        if models is None:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        return models.predict(texts)

    return mapped(docs, ["text"], run, "lang_pred string, score double, rejected boolean", keep)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_mod("doc_id", 4) == 2).alias("held_out"))
    models = fit(docs.where(~F.col("held_out")))
    return identify(docs.drop("lang"), models, ["doc_id", "held_out"])
