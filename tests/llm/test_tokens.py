"""Pieces, prefix tables and the binary format, against the library and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from slotweave.llm import pieces, rans, tokencount
from tests.llm.conftest import edge_rows, prose


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def samples():
    rng = random.Random(7)
    signs = ["a", "B", "é", "ß", "東", "🙂", " ", "  ", "\n", "\t", " ", "　", "'s", "'", "'re", "'LL", "'ll", "1", "23", "½", "_", "-", "…", "<|endoftext|>", "<|endof", "don't", "\r\n", "é"]
    out = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 25))) for _ in range(600)]
    return [*out, "", " ", "'", "''s", " 's", "a's's", "x 'll", "   a", "a   ", prose(rng, 300), "é" * 500, "<|endoftext|>" * 3, "x" * 3000]


def test_ids_are_the_librarys(library):
    texts = samples()
    ids, n = pieces.encode_texts(texts)
    ends = np.cumsum(n)
    for t, e, k in zip(texts, ends, n, strict=True):
        assert ids[e - k : e].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def thue_morse(n):
    """Two words that every sum of powers modulo 2**64 takes for equal."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_thue_morse_words_are_told_apart(library):
    for n in (1024, 4096):
        texts = list(thue_morse(n))
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        ids, per = pieces.encode_texts(texts)
        assert ids.tolist() == [*want[0], *want[1]] and per.tolist() == list(map(len, want))
        assert tokencount.count_texts(texts).tolist() == list(map(len, want))


def test_results_do_not_rest_on_the_hash(library, monkeypatch):
    """With three hash values for all pieces, within a batch and in the store, ids and counts stay right."""
    monkeypatch.setattr(pieces, "span_hashes", lambda v, s, e: ((e - s) % 3).astype(np.uint64))
    texts = samples()[:300]
    for store in (pieces.Pieces(), tokencount.PrefixTable()):
        for part in (texts[:200], texts[100:]):
            part = [t.replace("<|endoftext|>", "") for t in part]
            assert store.count(part).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in part]


def test_signs_of_newer_unicode(library):
    texts = [f"a{chr(c)}b 1{chr(c)} {chr(c)}{chr(c)}" for c in (0x558, 0x88F, 0xC5C, 0x2EBF0, 0x10D40, 0x1C89, 0x1E900, 0x31350, 0x10FFFF, 0x180E, 0x85)]
    ids, _ = pieces.encode_texts(texts)
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
    for t in texts:
        want = [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert tokencount.prefix_table().of_text(t).tolist() == want, repr(t)


def test_counts_are_the_librarys(library):
    texts = samples()
    assert tokencount.count_texts([*texts, None]).tolist() == [*(len(library.encode(t, add_special_tokens=False).ids) for t in texts), 0]


def test_every_prefix(library):
    table = tokencount.prefix_table()
    for t in samples()[:250]:
        want = [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert table.of_text(t).tolist() == want, repr(t)


def test_truncation(library):
    table = tokencount.prefix_table()
    text = prose(random.Random(1), 40)
    for budget in (0, 1, 5, 20, 10_000):
        got = table.truncate(text, budget)
        fits = [i for i in range(len(text) + 1) if len(library.encode(text[:i], add_special_tokens=False).ids) <= budget]
        assert got == text[: fits[-1]]


def test_count_operator(edge, nothing, library):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count(edge).collect())
    want = []
    for r in edge_rows():
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        want.append((str(r[0]), len((r[1] or "").encode()), n, n > 1024))
    assert got == sorted(want)
    assert tokencount.count(nothing).count() == 0


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 16_384, 16_385, 65_536, 65_537, 150_000])
def test_shard_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50_257).astype(np.uint16)
    counts = np.bincount(ids, minlength=rans.SYMBOLS)
    t = rans.Table.unpack(rans.Table.of_counts(counts).pack())
    lengths = np.array([n], np.int64)
    data = rans.encode_shard(np.array([7]), np.array([False]), lengths, ids, 5, t)
    doc_ids, nulls, got_lengths, got, first = rans.decode_shard(data, t)
    assert (got == ids).all() and got_lengths.tolist() == [n] and doc_ids.tolist() == [7] and first == 5 and not nulls.any()
    if n > 1000:
        p = counts[counts > 0] / n
        assert len(data) * 8 < n * (-(p * np.log2(p)).sum() + 0.2) + 80_000  # near the entropy
        for at in (10, len(data) // 2, len(data) - 3):
            bad = bytearray(data)
            bad[at] ^= 1
            with pytest.raises(ValueError):
                rans.decode_shard(bytes(bad), t)


def test_one_checkpoint_is_enough():
    rng = np.random.default_rng(3)
    for n in (70_000, 16_384, 100, 131_072):
        ids = (rng.zipf(1.3, n) % 50_257).astype(np.uint16)
        t = rans.Table.of_counts(np.bincount(ids, minlength=rans.SYMBOLS))
        data = rans.encode_shard(np.array([7]), np.array([False]), np.array([n]), ids, 0, t)
        size = rans.LANES * rans.TURNS
        for k in range(-(-n // size)):
            assert (rans.decode_stretch(data, t, k) == ids[k * size : (k + 1) * size]).all()
        with pytest.raises(IndexError):
            rans.decode_stretch(data, t, -(-n // size))


def brute(rows, library):
    coded = [(r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows]
    coded.sort(key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    out, start = [], 0
    for doc_id, ids in coded:
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_rans_operator(edge, nothing, library, monkeypatch):
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    shards, packed = rans.encode(edge)
    got = sorted(map(tuple, rans.decode(shards, packed).collect()), key=key)
    assert got == sorted(brute(edge_rows(), library), key=key)
    with_ids = rans.decode(shards, packed, with_ids=True).where("doc_id = 8").first()
    assert with_ids.ids == [*library.encode("one", add_special_tokens=False).ids, 0]
    assert rans.decode(*rans.encode(nothing)).count() == 0


def test_export(edge, tmp_path):
    shards, packed = rans.encode(edge)
    rans.export(shards, packed, str(tmp_path / "out"))
    t = rans.Table.unpack((tmp_path / "out/table.rans").read_bytes())
    n = sum(len(rans.decode_shard(p.read_bytes(), t)[0]) for p in (tmp_path / "out").glob("part-*"))
    assert n == len(edge_rows())
    assert shards.select(F.sum("docs")).first()[0] == n
