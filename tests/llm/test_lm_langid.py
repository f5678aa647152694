"""The language model and language identification."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from slotweave.llm import langid, lm
from tests.llm.conftest import edge_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_normal_form():
    texts = ["A b\n C", "", "  ", "É É x", "a b", "tab\tx"]
    out, h, n, at = lm.normal(texts)
    whole = "".join(out)
    assert [whole[a:].split(" ")[0] for a in at[:2]] == ["a", "b"]
    assert out == [" ".join(WORD.findall(t.translate(LOW))) for t in texts]
    assert n.tolist() == [len(WORD.findall(t)) for t in texts] and len(h) == n.sum()


def test_squeezed():
    x = np.array([0, 1, 255, 256, 70_000, 2**24 + 5, 2**31 - 1])  # more than 16.7 million distinct words, too
    assert lm.expanded(lm.squeezed(x, 4), 4).tolist() == x.tolist() and lm.expanded(lm.squeezed(x[:0], 4), 4).tolist() == []


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 300, 4000)
    spelling = lm.Spelling(np.bincount(ids, minlength=lm.FULL))
    per = np.full(40, 100)
    s, n = spelling(ids, per)
    x, y, m = lm.inputs_and_targets(s, n, spelling.end)
    big = np.zeros((lm.KEPT_IDS,) * 2)
    np.add.at(big, (x, y), 1)
    return lm.Attention(big, spelling.end), spelling, x, y, m


def test_probabilities_sum_to_one(model):
    a, _, x, y, m = model
    a.train(x, y, m, 1)
    every = np.arange(lm.KEPT_IDS).astype(np.int16)
    # texts that differ in their third token alone
    first = x[:3].astype(np.int16)
    xs = np.tile(np.append(first, 0), lm.KEPT_IDS).astype(np.int16)
    ys = np.tile(np.append(x[1:3], [0, 0]), lm.KEPT_IDS).astype(np.int16)
    xs[3::4], ys[2::4] = every, every
    ys[3::4] = a.end
    p = a.score(xs, ys, np.full(lm.KEPT_IDS, 4))
    # the end after each differs: take it off by scoring it alone in the same place
    third = [a.score(xs[4 * i : 4 * i + 3], ys[4 * i : 4 * i + 3], np.array([3]))[0] for i in range(0, lm.KEPT_IDS, 37)]
    head = a.score(xs[:2], ys[:2], np.array([2]))[0]
    full = [a.score(xs[4 * i : 4 * i + 3], ys[4 * i : 4 * i + 3], np.array([3]))[0] for i in range(lm.KEPT_IDS)]
    assert abs(sum(10 ** (f - head) for f in full) - 1) < 1e-3
    assert len(third) and np.isfinite(p).all()


def test_masked_windows_score_each_token_once(model):
    a, _, x, y, m = model
    whole = a.score(x, y, m)
    one = np.array([a.score(x[s : s + k], y[s : s + k], np.array([k]))[0] for s, k in zip(np.cumsum(m) - m, m, strict=True)])
    assert np.allclose(whole, one, atol=1e-3)
    # a later token never changes an earlier one's probability
    cut = 70
    assert abs(a.score(x[:cut], y[:cut], np.array([cut]))[0] - a._gradients(x[:cut], y[:cut], *lm.windows(np.array([cut])), np.array([cut]))[0] / -math.log(10)) < 1e-2
    z = y.copy()
    z[cut - 1] = (z[cut - 1] + 1) % 50
    x2 = x.copy()
    x2[cut] = z[cut - 1]
    assert abs(a.score(x[: cut - 1], y[: cut - 1], np.array([cut - 1]))[0] - a.score(x2[: cut - 1], z[: cut - 1], np.array([cut - 1]))[0]) < 1e-4


def test_gradients_are_finite_differences(monkeypatch):
    monkeypatch.setattr(lm, "CLASSES", 4)
    monkeypatch.setattr(lm, "KEPT_IDS", 32)
    monkeypatch.setattr(lm, "IN_CLASS", 8)
    rng = np.random.default_rng(5)
    x, y, m = lm.inputs_and_targets(rng.integers(0, 31, 70), np.array([50, 0, 20]), 31)
    a = lm.Attention(rng.integers(0, 9, (32, 32)), 31)
    a.p = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in a.p.items()}
    a.oc, a.ot, a.causal = (t.astype(np.float64) for t in (a.oc, a.ot, a.causal))
    rows, first = lm.windows(m)
    loss = lambda: a._gradients(x, y, rows, first, m)[0] / len(x)
    g = a._gradients(x, y, rows, first, m)[2]
    for name, v in a.p.items():
        for i in rng.integers(0, v.size, 6):
            old = v.flat[i]
            v.flat[i] = old + 1e-5
            up = loss()
            v.flat[i] = old - 1e-5
            down = loss()
            v.flat[i] = old
            assert abs((up - down) / 2e-5 - g[name].flat[i]) < 1e-4 * max(1, abs(g[name].flat[i])), name


def test_products_by_rows_are_whole(model):
    """A step's gradients, whose products take some rows at a time, are the means of its parts' by tokens: no row is lost."""
    rng = np.random.default_rng(8)
    for n in (0, 1, lm.ROWS, lm.ROWS + 1, 3 * lm.ROWS - 1):
        b, c, w = rng.standard_normal((n, 17)), rng.standard_normal((n, 5)), rng.standard_normal((17, 33))
        assert np.allclose(lm._product(b, w), b @ w) and np.allclose(lm._gathered(b, c), b.T @ c)
    a, _, x, y, m = model
    rows, first = lm.windows(m)
    loss, n, g = a._gradients(x, y, rows, first, m)
    parts = [a._gradients(x, y, rows[i::5], first[i::5], m) for i in range(5)]
    assert n == len(x) == sum(p[1] for p in parts) and abs(sum(p[0] for p in parts) / loss - 1) < 1e-5
    for k, v in g.items():
        assert np.abs(sum(p[1] * p[2][k] for p in parts) / n - v).max() < 1e-4 * max(1e-2, np.abs(v).max()), k


def test_steps_and_scores_keep_little_at_once(model):
    """What a step or a batch of scores holds at once is what makes it slow beside others on a machine."""
    a, _, x, y, m = model
    x, y, m = np.tile(x, 5), np.tile(y, 5), np.tile(m, 5)
    rows, first = lm.windows(m)
    a.score(x, y, m)
    peaks = []
    for f in (lambda: a._gradients(x, y, rows[:192], first[:192], m), lambda: a.score(x, y, m)):
        tracemalloc.start()
        f()
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert peaks[0] < 10 and peaks[1] < 5


def test_training_lowers_the_loss():
    pattern = np.tile(np.arange(50), 60)
    ids = np.where(np.arange(3000) % 2, pattern, np.roll(pattern, 2))  # more than pairs tell
    x, y, m = lm.inputs_and_targets(ids.astype(np.int16), np.full(30, 100), 900)
    a = lm.Attention(np.zeros((lm.KEPT_IDS,) * 2), 900)
    losses = a.train(x, y, m, 150)
    assert losses[-1] < 0.6 * losses[0]


def cut(words):
    """Segments of a text's words, by the same rule in plain Python."""
    out, now = [], []
    for w, h in words:
        now.append(w)
        if h % lm.SEGMENT == 0 or len(now) == lm.MAX_SEGMENT:
            out.append(tuple(now))
            now = []
    if now or not out:
        out.append(tuple(now))
    return out


def test_segments_end_where_the_words_say():
    rng = np.random.default_rng(2)
    texts = [" ".join(map(str, rng.integers(0, 900, n))) for n in (400, 0, 1, 700, 5)] + ["same " * 300]
    texts.append("new start " + texts[0])
    out, h, n, _ = lm.normal(texts)
    per, first, size = lm.segments(h, n)
    want = [cut(zip(t.split(" "), x.tolist(), strict=True)) if t else [()] for t, x in zip(out, np.split(h, np.cumsum(n)[:-1]), strict=True)]
    assert per.tolist() == list(map(len, want)) and size.tolist() == [len(s) for w in want for s in w]
    before, both = lm.segment_keys(h, per, first, size)
    ends = np.cumsum(per)
    shared = set(both[: ends[0]]) & set(both[ends[-2] :])
    assert len(shared) >= per[0] - 2 and (both % 2 == 1).all() and (h % 2 == 0).all()


def test_scores_remember_other_documents(corpus_rows, corpus):
    """The score from its parts, by dictionaries: no text is evidence for itself."""
    got = {r.doc_id: r for r in lm.score(corpus).collect()}
    texts = [lm.normal([r[1]]) for r in corpus_rows]
    pieces = [[*cut(zip(t[0][0].split(" "), t[1].tolist(), strict=True))] for t in texts]
    pieces = [[("<s>",), *p[:-1], (*p[-1], "</s>")] for p in pieces]
    held = [got[i].held_out for i in range(len(pieces))]
    pairs, contexts = Counter(), Counter()
    for p, h in zip(pieces, held, strict=True):
        if not h:
            pairs.update(zip(p, p[1:], strict=False))
            contexts.update(p[:-1])
    twins = Counter(r[1] for r in corpus_rows)
    for i, p in enumerate(pieces):
        own, mine = Counter(zip(p, p[1:], strict=False)), Counter(p[:-1])
        seen = [pairs[x] - (0 if held[i] else own[x]) for x in zip(p, p[1:], strict=False)]
        context = [contexts[x] - (0 if held[i] else mine[x]) for x in p[:-1]]
        if not any(seen):  # attention alone, less what the contexts take
            want = got[i].attention_score - sum(math.log10(c + lm.NEW) for c in context)
            assert abs(got[i].score - want) < 1e-6 * abs(want)
        else:
            assert got[i].score > got[i].attention_score - sum(math.log10(c + lm.NEW) for c in context)
        if twins[corpus_rows[i][1]] > 1 and sum(not held[j] for j, r in enumerate(corpus_rows) if r[1] == corpus_rows[i][1] and j != i):
            assert all(seen) and got[i].score > 0.5 * got[i].attention_score
    assert any(sum(pairs.values()) and s > 1 for s in twins.values())


def base_scores(rows):
    docs = [([w for w in WORD.findall((r[1] or "").translate(LOW))], zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0) for r in rows]
    c = Counter(w for words, held in docs if not held for w in (*words, "\n"))
    n, v = sum(c.values()), len(c)
    out = []
    for (words, held), r in zip(docs, rows, strict=True):
        tokens = [*words, "\n"]
        out.append((str(r[0]), held, len(tokens), sum(t in c for t in tokens), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), 5)))
    return out


def test_score_operator(corpus, corpus_rows, monkeypatch):
    got = lm.score(corpus).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(base_scores(corpus_rows))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # syllables beat words on unseen texts
    by_text = {}
    for r in got:
        by_text.setdefault(corpus_rows[r.doc_id][1], []).append(r.attention_score)
    assert all(max(s) - min(s) < 1e-2 for s in by_text.values())


def test_fit_learns_from_all_training_documents(corpus, monkeypatch):
    """Without a sample to start from, the model still learns, from its share of every document's windows."""
    monkeypatch.setattr(lm, "training_sample", lambda *a: (np.zeros(0, np.int16), np.zeros(0, np.int64)))
    chunks_ = lm.prepared(corpus)
    start = lm.Attention(lm.bigram_counts(chunks_, lm.Spelling(lm.id_counts(chunks_))), 0)
    got, spelling = lm.fit(chunks_)
    seen, loss = 0, [0.0, 0.0]
    for b in chunks_.toArrow().to_batches():
        for _, held, ids, n in lm._documents(b):
            x, y, m = lm.inputs_and_targets(*spelling(ids[np.repeat(~held, n)], n[~held]), spelling.end)
            seen += len(lm.windows(m)[0])
            for i, a in enumerate((start, got)):
                loss[i] -= a.score(x, y, m).sum()
    assert loss[1] < loss[0]
    monkeypatch.setattr(lm, "EVERY", 1)
    every = lm.Attention(np.zeros((lm.KEPT_IDS,) * 2), 0)
    x, y, m = lm.inputs_and_targets(*spelling(np.arange(1000), np.array([900, 100])), spelling.end)
    assert every.learn(x, y, m, lm.Adam(every.p), np.random.default_rng(0)) == len(x)


def test_every_token_of_training_documents_is_learned(corpus, monkeypatch):
    """All rounds together learn from each token of every training document once; what the driver learns from is whole or nothing."""
    chunks_ = lm.prepared(corpus)
    counts = lm.id_counts(chunks_)
    spelling, total, tokens, n_texts = lm.Spelling(counts), int(counts.sum()), 0, 0
    for b in chunks_.toArrow().to_batches():
        for _, held, ids, n in lm._documents(b):
            tokens += int(lm.inputs_and_targets(*spelling(ids[np.repeat(~held, n)], n[~held]), spelling.end)[2].sum())
            n_texts += int((~held).sum())
    ids, per = lm.training_sample(chunks_, spelling, total)
    assert (len(ids), len(per)) == (tokens - n_texts, n_texts)
    ids, per = lm.training_sample(chunks_, spelling, total, total // 2)
    assert len(ids) == len(per) == 0
    taught, real = [], lm.corpus_pass
    monkeypatch.setattr(lm, "corpus_pass", lambda *a: (out := real(*a), taught.append(out[1]))[0])
    monkeypatch.setattr(lm, "training_sample", lambda *a: (np.zeros(0, np.int16), np.zeros(0, np.int64)))
    monkeypatch.setattr(lm, "MANY", 0, raising=False)  # as of a corpus that is gone over once
    lm.fit(chunks_)
    assert sum(taught) == tokens


def test_score_edges(edge, nothing):
    got = lm.score(edge).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(base_scores(edge_rows()))
    assert all(math.isfinite(r.score) for r in got)
    assert lm.score(nothing).count() == 0
    assert lm.score(edge.where("doc_id = 999")).count() == 0


# --- language identification -----------------------------------------------------------------------


def test_symbols():
    x, owner, counts, letters = langid.symbols(["Ab 1-2 c!", "", "9"])
    assert "".join(map(chr, x[counts & (owner == 0)])) == "ab c " and letters.tolist() == [3, 0, 0]
    assert (owner == 1).sum() == langid.ORDER - 1


def kneser_ney(texts):
    """Interpolated Kneser-Ney with absolute discounts, by dictionaries."""
    order = langid.ORDER
    grams = [Counter() for _ in range(order)]
    for t in texts:
        x, owner, counts, _ = langid.symbols([t])
        s = "".join(map(chr, x))
        for i in np.flatnonzero(counts):
            grams[order - 1][s[i - order + 1 : i + 1]] += 1
    for n in range(order - 1, 0, -1):
        for g in grams[n]:
            grams[n - 1][g[1:]] += 1
    alphabet = {c for g in grams[0] for c in g} | {" "}

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (len(alphabet) + 1)
        c = grams[n - 1]
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = ones / (ones + 2 * twos) if ones else 0.5
        mine = {k: v for k, v in c.items() if k[:-1] == g[:-1]}
        total = sum(mine.values())
        if not total:
            return p(g[1:])
        return max(c.get(g, 0) - d, 0) / total + d * len(mine) / total * p(g[1:])

    return p


def test_models_are_kneser_ney():
    train = ["the cat sat on the mat", "a hat and a bat", "that cat"]
    m = langid.Models({"en": train})
    p = kneser_ney(train)
    for text in ("the hat", "zzz q", "at", "cat bat mat sat"):
        x, _, counts, _ = langid.symbols([text])
        s = "".join(map(chr, x))
        want = -np.mean([np.log2(p(s[i - langid.ORDER + 1 : i + 1])) for i in np.flatnonzero(counts)])
        assert abs(m.entropies([text])[0][0, 0] - want) < 1e-4


def test_held_out_accuracy(spark, corpus, corpus_rows):
    docs = corpus.select("doc_id", "text", "lang", "label")
    models = langid.fit(docs.where("doc_id % 3 != 0"))
    got = langid.identify(docs, models, ["doc_id"]).collect()
    right = [r.lang_pred == corpus_rows[r.doc_id][2] for r in got if r.doc_id % 3 == 0]
    assert sum(right) >= 0.98 * len(right)
    assert all(0 <= r.score <= 1 for r in got)
    odd = langid.identify(documents_of(spark, ["ЖЩЮ ЫЪЭ ЖЩЮЯ ЩЖЫ ЭЮЯ ЖЫЩ ЪЭЮ ЯЖЩ"]), models, ["doc_id"]).first()
    assert odd.rejected and odd.score < 0.5


def test_long_documents_teach(spark):
    """A language with long documents alone is learned; the sample is bounded per language."""
    rng = np.random.default_rng(1)
    text = lambda sounds, n: " ".join("".join(rng.choice(sounds, 3)) for _ in range(n))
    rows = [(i, text(["ka", "lo", "mi"], 30), "en") for i in range(40)] + [(100 + i, text(["sch", "ung", "ein"], 9000), "zz") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.fit(docs)
    assert models.langs == ["en", "zz"]
    assert models.predict([text(["sch", "ung", "ein"], 20), text(["ka", "lo", "mi"], 20)])[0] == ["zz", "en"]
    seen = []
    real = langid.Models
    try:
        langid.Models = lambda texts: (seen.append(texts), real(texts))[1]
        langid.fit(docs, per_lang=10)
    finally:
        langid.Models = real
    assert all(len(v) <= 10 for v in seen[0].values()) and max(len(t) for t in seen[0]["zz"]) == langid.MAX_SAMPLE_CHARS


def documents_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_langid_edges(edge, nothing):
    models = langid.fit(edge)
    got = {(str(r.doc_id), r.text): r for r in langid.identify(edge, models).collect()}
    for (_, text), r in got.items():
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr")
    assert langid.identify(edge, models).columns[: len(edge.columns)] == edge.columns
    assert langid.fit(nothing) is None
    assert {r.lang_pred for r in langid.identify(edge, None).collect()} == {"und"}
    assert langid.identify(nothing, models).count() == 0
