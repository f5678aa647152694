"""Archives, extraction and decontamination."""

import hashlib
import random
import struct

import numpy as np
import pytest
import zstandard

from slotweave.llm import decontaminate, extract, warc
from tests.llm.conftest import edge_rows, prose

PAGES = "page_id long, url string, html string, _d string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES).repartition(3)


def page_rows():
    rng = random.Random(6)
    big = [f"<p>{prose(rng, 200)}</p>é" for _ in range(3)]
    rows = [(i, f"http://x/{i}", big[i % 3] if i % 4 else f"<p>{prose(rng, 200)}</p>") for i in range(40)]
    return [*rows, (50, None, None), (51, "u\r\nv", ""), (52, "u", "short"), (53, "u", "short"), (None, "n", big[0]), (2**60 + 1, "l", big[1]), (-5, "m", big[1])]


def brute(rows):
    best = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and page_id is not None:
            best[body] = max(best.get(body, page_id), page_id)
    count = {}
    for r in rows:
        count[(r[2] or "").encode()] = count.get((r[2] or "").encode(), 0) + 1
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        revisit = len(body) >= 1000 and count[body] > 1 and page_id != best.get(body)
        out.append((str(page_id), len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", str(best[body]) if revisit else "None"))
    return sorted(out)


def test_archives(spark, monkeypatch):
    rows = page_rows()
    archives = warc.write(pages(spark, rows))
    got = warc.read(archives).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == brute(rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r.body) == html[r.page_id] for r in got if r.record_type == "response")
    assert all(r.body is None for r in got if r.record_type == "revisit")


def test_layout(tmp_path, spark):
    rng = random.Random(1)
    records = [warc.record(i, f"http://x/{i}", b"<html>" + prose(rng, 150).encode(), 5, "0" * 40, None, False) for i in range(60)]
    data = warc.pack(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and size > 1000  # a dictionary leads, in a frame that plain readers skip
    d = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    at, seen = 8 + size, 0
    while at < len(data) - 16:  # every record is a frame of its own
        o = zstandard.ZstdDecompressor(dict_data=d).decompressobj()
        assert o.decompress(data[at:]) == records[seen]
        at, seen = len(data) - len(o.unused_data), seen + 1
    assert seen == 60
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(data) - 8 - size < plain
    assert [f["WARC-Target-URI"] for f, _ in warc.unpack(data)] == [f"http://x/{i}" for i in range(60)]
    assert list(warc.unpack(warc.pack([]))) == []
    for bad in (data[:-5], data[:-50], data[: len(data) // 2], b"x" * 40, b""):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.unpack(bad))


def test_ids():
    for i in (0, 1, 2**62, -1 << 62, 12345, None):
        assert warc.id_of(warc.record_id(i)) == i


def test_damage_is_found(spark):
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabX"
    r = warc.record(1, "u", b"abc", 3, hashlib.sha1(b"abc").hexdigest(), None, False)
    bad = r.replace(b"\r\n\r\nabc", b"\r\n\r\nabX")
    assert bad != r and body
    df = spark.createDataFrame([(warc.pack([bad]),)], "payload binary")
    with pytest.raises(Exception, match="damaged"):
        warc.read(df).collect()


def test_archive_edges(spark, tmp_path):
    assert warc.write(pages(spark, [])).count() == 0 and warc.read(warc.write(pages(spark, []))).count() == 0
    archives = warc.write(pages(spark, page_rows()))
    warc.export(archives, str(tmp_path / "out"))
    n = sum(1 for p in (tmp_path / "out").glob("*.warc.zst") for _ in warc.unpack(p.read_bytes()))
    assert n == len(page_rows())


# --- extraction -----------------------------------------------------------------------------------------

LONG = "A long paragraph of running text that says a good deal about nothing in particular, with commas, and ends here."


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""), ("", ""), ("<html></html>", ""), ("plain", "plain"),
        (f"<nav><a>x</a></nav><article><h1>T</h1><p>{LONG}</p><p>Hi.</p></article><footer>f</footer>", f"T {LONG} Hi."),
        (f"<body><div class='sidebar'>s</div><p>{LONG}</p><p>wor<b>ld</b> &amp; &eacute;<br>n</p><div id=comments>c</div></body>", f"{LONG} world & é n"),
        (f"<main><article><p>{LONG}</p></article><aside>a</aside><article><p>{LONG}</p></article></main>", f"{LONG} {LONG}"),
        (f"<article><p>{LONG}<script>var a='</p>';</script><style>p{{}}</style><form>q</form><p>x", f"{LONG} x"),
        (f"<article><div class='ad-box'>buy</div><div class='cookieNotice'>ok</div><p> {LONG} \n\t x </p></article>", f"{LONG} x"),
        (f"</div></p><article><ul><li>a<li>b</ul><p>{LONG}</article></article>", f"a b {LONG}"),
        (f"<article class='no-sidebar'><p>{LONG}</p><!-- <p>no</p> --></article>", LONG),
        (f"<div role=navigation>n</div><section><p>{LONG}</p><p>{LONG}</p></section>", f"{LONG} {LONG}"),
        ("<article><p>&lt;b&gt; 1 &lt; 2 &#8212; &unknown;</p></article>", "<b> 1 < 2 — &unknown;"),
    ],
)
def test_extraction(html, want):
    assert extract.extract_text(html) == want


def test_very_long_and_odd_pages():
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(20_000))
    assert extract.extract_text(f"<article>{body}</article>").count("long paragraph") == 20_000
    for bad in ("<" * 5000, "<article>" * 3000 + "x", "<!--", "<script>" + "x" * 1000, "&" * 3000, "<p a='", "</" * 2000):
        assert isinstance(extract.extract_text(bad), str)


def test_random_markup_never_raises():
    rng = random.Random(8)
    bits = ["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "text here", "&amp;", "<br/>", "<script>", "</script>", "<", ">", "<!--", "-->", "<nav>", "</nav>"]
    for _ in range(400):
        extract.extract_text("".join(rng.choice(bits) for _ in range(30)))


def test_smoothing():
    import numpy as np

    s = extract.smoothed(np.array([0.0] * 10 + [100.0] + [0.0] * 10))
    assert abs(s.sum() - 100) < 1e-9 and s.argmax() == 10
    assert np.allclose(extract.smoothed(np.full(3, 5.0)), 5)


def wide(n, word="word"):
    return " ".join([word] * n)


@pytest.mark.parametrize(
    "html, want",
    [
        # wrappers whose names say boilerplate, and forms around the page
        (f"<div class='layout with-sidebar'><nav><a>Home</a></nav><article><h1>T</h1><p>{LONG}</p><p>tiny</p></article><div class=sidebar>About us here</div></div>", f"T {LONG} tiny"),
        (f"<body><form><nav><a>Home</a></nav><h1>Title</h1><p>{LONG}</p><p>tiny</p><button>Go</button></form></body>", f"Title {LONG} tiny"),
        (f"<div class='search-results'><h2>Found</h2><p>{LONG}</p></div>", f"Found {LONG}"),
        (f"<div id=header-less><div class=comments><p>{LONG}</p></div></div>", LONG),
        # no article: what the ratios tell apart
        (f"<ul><li><a>One</a><li><a>Two</a></ul><h1>Title</h1><p>{LONG}</p><p>tiny</p><p>{LONG}</p><ul><li><a>Back</a><li><a>Top of page</a></ul>", f"Title {LONG} tiny {LONG}"),
        (f"<div><p>{LONG}</p></div><ul><li><a>Next page</a><li><a>Home page</a></ul><div><p>{LONG}</p><p>end</p></div>", f"{LONG} {LONG} end"),
        # comments that outweigh a short article, and articles that share a page
        (f"<article><h1>T</h1><p>{wide(40)}</p></article><div class=comments>{''.join(f'<div class=comment><b>me</b><p>{wide(30, w)}</p></div>' for w in ('aa', 'bb', 'cc'))}</div>", f"T {wide(40)}"),
        (f"<nav><a>x</a></nav><article><h2>A</h2><p>{LONG}</p></article><article><h2>B</h2><p>{LONG}</p><p>c</p></article><footer>f</footer>", f"A {LONG} B {LONG} c"),
    ],
)
def test_regions_come_from_content(html, want):
    assert extract.extract_text(html) == want


def test_results_come_through_the_ratios(monkeypatch):
    """With all lines, random ones or the same ratios dealt to other lines for content, other text comes out."""
    rng, real = random.Random(8), extract.content_lines
    menu = "<nav><ul>" + "".join(f"<li><a>{w}</a></li>" for w in "abcdef") + "</ul></nav><div class=ad>Buy this now or later</div>"
    made = [f"<body>{menu}<article><h1>T</h1>{''.join(f'<p>{prose(rng, rng.randrange(5, 80))}</p>' for _ in range(5))}</article><footer>Some rights are reserved</footer></body>" for _ in range(40)]
    texts = [extract.extract_text(x) for x in made]
    import re

    assert texts == [" ".join(" ".join(re.sub("<.*?>", " ", x.split("<article>")[1].split("</article>")[0]).split()).split()) for x in made]
    for other in (lambda t, g, w=None: np.ones(len(t), bool), lambda t, g, w=None: np.array([rng.random() < 0.5 for _ in t]), lambda t, g, w=None: np.array(rng.sample(real(t, g, w).tolist(), len(t)))):
        monkeypatch.setattr(extract, "content_lines", other)
        assert sum(extract.extract_text(x) != t for x, t in zip(made, texts, strict=True)) > 15
    monkeypatch.setattr(extract, "content_lines", real)


def test_lines_by_brute_force():
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randrange(1, 30)
        texts, tags, weights = ["x" * rng.randrange(1, 300) for _ in range(n)], [rng.randrange(0, 6) for _ in range(n)], [rng.choice([1, 1 / 4, 1 / 16]) for _ in range(n)]
        ratio = [len(t) / max(1, g) for t, g in zip(texts, tags, strict=True)]
        s = []
        for i in range(n):
            near = [(2.718281828459045 ** (-0.5 * ((i - j) / extract.SIGMA) ** 2), ratio[j]) for j in range(n) if abs(i - j) <= extract.RADIUS]
            s.append(weights[i] * sum(w * r for w, r in near) / sum(w for w, _ in near))
        mean = sum(s) / n
        limit = min((sum((x - mean) ** 2 for x in s) / n) ** 0.5, max(s))
        got = extract.content_lines(texts, tags, np.array(weights))
        assert [bool(x) for x in got] == [x >= limit for x in s] or any(abs(x - limit) < 1e-9 * limit for x in s)


def test_deep_pages_take_linear_time():
    import time

    for tail in ("", "</section></form>"):
        start = time.time()
        text = extract.extract_text("<article>" + f"<div><p>some text here to read{tail}" * 20_000)
        assert len(text) == 20_000 * len("some text here to read ") - 1 and time.time() - start < 2


def test_extract_operator(spark):
    rows = [(1, "u", f"<article>{LONG}</article>"), (None, None, None), (2**60 + 1, "v", ""), (1, "u", f"<article>{LONG}</article>")]
    got = extract.extract(pages(spark, rows)).collect()
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in got) == sorted([("1", "u", LONG, len(LONG))] * 2 + [("None", "None", "", 0), (str(2**60 + 1), "v", "", 0)])
    assert extract.extract(pages(spark, [])).count() == 0


# --- decontamination ---------------------------------------------------------------------------------------


def distance(item, text):
    """Least edit distance of ``item`` to any passage of ``text``, by the plain recurrence."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        before, row[0] = row[0], 0
        for i, d in enumerate(item, 1):
            before, row[i] = row[i], min(before + (d != c), row[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        i = rng.randrange(len(s))
        rng.choice([lambda: s.__setitem__(i, "q"), lambda: s.insert(i, "q"), lambda: s.pop(i)])()
    return "".join(s)


def test_myers_is_the_recurrence():
    rng = random.Random(1)
    for _ in range(150):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 150)))
        assert decontaminate.Pattern(item).best(text)[0] == distance(item, text)


def test_nothing_within_the_budget_is_missed():
    rng = random.Random(2)
    items = [(i, decontaminate.normal(prose(rng, 25))) for i in range(12)]
    m = decontaminate.Matcher(items)
    for _ in range(120):
        i, item = rng.choice(items)
        k = decontaminate.budget(len(item))
        text = f"{prose(rng, 30)} {edited(rng, item, rng.randrange(0, 2 * k + 2))} {prose(rng, 30)}"
        plain = decontaminate.normal(text)
        got = {h[0]: h for h in m.search(text)}
        for j, other in items:
            d = distance(other, plain)
            assert (j in got) == (d <= decontaminate.budget(len(other)))
            if j in got:
                _, found, a, b = got[j]
                assert found == d == distance(other, plain[a:b])
        assert i in dict(items)


def test_decontamination_operators(spark, edge, nothing):
    rng = random.Random(3)
    item = prose(rng, 30)
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "tiny", "x"), (None, prose(rng, 20), "x"), (6, edge_rows()[0][1], "x")], "item_id long, text string, doc_id string")
    extra = edge.union(edge.where("doc_id = 8").selectExpr("77L", f"'{item.replace(chr(10), ' ').upper()}'", "lang", "source", "n_chars", "_h", "row", "doc", "label"))
    hits = sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(extra, bench).collect())
    assert hits == [(1, 6, 0), (1, 6, 0), (5, 6, 0), (77, 1, 0)]
    kept = decontaminate.clean(extra, bench)
    assert kept.columns == extra.columns and kept.count() == len(edge_rows()) - 3
    assert decontaminate.matches(nothing, bench).count() == 0
    assert decontaminate.matches(edge, bench.limit(0)).count() == 0 and decontaminate.clean(edge, bench.limit(0)).count() == len(edge_rows())


def test_benchmark_blocks(spark):
    bench = spark.createDataFrame([(i, "word " * 10 + str(i)) for i in range(10)], "item_id long, text string")
    assert [len(b) for b in decontaminate.blocks(bench, most=120)] == [2] * 5


def test_short_items_are_whole_words(spark):
    m = decontaminate.Matcher([("s", decontaminate.normal("2 + 2 = 4")), ("w", "cat"), ("l", decontaminate.normal(LONG))])
    assert sorted(m.search("what is 2+2=4?")) == [("s", 0, 8, 13)] and m.search("concatenate 12 2 45") == []
    assert sorted(m.search("Cat")) == [("w", 0, 0, 3)] and m.search("a cat, a CAT")[0][:3] == ("w", 0, 2)
    assert {h[0] for h in m.search(f"cat {LONG.replace('deal', 'dael')} cat")} == {"w", "l"}
    docs = spark.createDataFrame([(1, "a cat sat"), (2, LONG), (3, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([("w", "cat"), ("l", LONG), ("e", "!?"), ("n", None)], "item_id string, text string")
    assert sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(docs, bench).collect()) == [(1, "w", 0), (2, "l", 0)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [1, 3]


def test_marks_are_parts_of_words():
    assert decontaminate.normal("कि की") == "कि की" and decontaminate.normal("A_b--C") == "a b c"


@pytest.mark.parametrize("records", [[b"x" * 50], [b"", b"ab"], [b"one record" * 9000] * 3, [bytes([i]) * 40 for i in range(40)]])
def test_every_archive_has_a_dictionary(records):
    whole = [warc.record(i, "u", r, len(r), hashlib.sha1(r).hexdigest(), None, False) for i, r in enumerate(records)]
    archive = warc.pack(whole)
    assert 0 < struct.unpack_from("<II", archive)[1] <= warc.DICT_BYTES
    assert [b.partition(b"\r\n\r\n")[2] for _, b in warc.unpack(archive)] == records
