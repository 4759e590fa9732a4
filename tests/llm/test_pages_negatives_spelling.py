"""HTML extraction, hard-negative mining and spelling variants against plain twins and planted cases."""

import random
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.llm import negatives, pages, queries, spelling

SF = "/root/testdata/sf0.001"
PROSE = "The committee said on Monday that the plan for the new bridge is to be put to a vote in the autumn, and that it would not be changed before then."

# ---------------------------------------------------------------- HTML extraction


def article_blocks(page):
    """What stands in the article of a page of the given tables, by its tags alone."""
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    found = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inside).replace("<br>", " "))
    return "\n".join(b for b in (" ".join(unescape(x).split()) for x in found) if b)


def test_pages_of_the_table(spark):
    given = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op11_pages(spark, SF).collect()
    assert len(got) == len(given)
    for r in got:
        assert r.text == article_blocks(given[r.page_id]) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        (None, ""),
        ("<p>Hello", "Hello"),
        ("<nav><a href=x>Home</a></nav><p>Breaking: it rains.</p><div class=footer>(c) x</div>", "Breaking: it rains."),
        ("<article>a &lt;b&gt; &amp c &am &#x41;&nbsp;\n z</article>", "a <b> & c &am A z"),
        ("<!--x--><p>one<p>two<!-->three--><script>if(a<b)\"</p>\"</script>!", "one\ntwothree-->!"),
        ("a < b <3 </>c<p title=\"a>b\">d</é>e<p", "a < b <3 c\nde"),
        ("<article><p>a<b>b</b>c <i>d</i>\n e</p><pre>x\n  y</pre><ul><li>one<li>two</ul><table><tr><td>1<td>2</table></article>", "abc d e\nx y\none\ntwo\n1\n2"),
        # no article element: menus, sidebars, comments, notices and footers are told by their containers and links
        (
            f'<div id="header"><a href=/>Site</a></div><div class="nav"><a>x</a></div><div class="content"><h2>Bridge</h2><p>{PROSE}</p><p>Short one.</p>'
            f'<blockquote>{PROSE}</blockquote></div><div class="sidebar"><p>{PROSE}</p></div><div id="comments"><p>{PROSE} I agree</p></div>'
            f'<div class="cookie-notice">{PROSE}</div><form>{PROSE}<input></form><div id="footer">&copy; 2020. All rights reserved.</div>',
            f"Bridge\n{PROSE}\nShort one.\n{PROSE}",
        ),
        # no hints at all: density, length and links decide, short blocks follow their neighbours
        (
            f"<table><tr><td><a href=a>Home</a> | <a href=b>News</a></td><td><h1>Bridge</h1>{PROSE}<p>{PROSE}<p>Yes.<p>{PROSE}</td></tr></table><p>Copyright 2020 me</p>",
            f"Bridge\n{PROSE}\n{PROSE}\nYes.\n{PROSE}",
        ),
        # parts of an article element that are no article text, and articles that are comments
        (
            f"<main><article><header><h1>Bridge</h1><p class=byline>By Jo</p></header><p>{PROSE}</p><aside><p>{PROSE} aside</p></aside><div class='ad'>Buy</div><p>Ende.</p>"
            f"<footer>Tags</footer></article><section class=comments><article>{PROSE} c</article></section></main>",
            f"Bridge\n{PROSE}\nEnde.",
        ),
        (f"<body class='has-sidebar'><main><p>{PROSE}</p><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p hidden>{PROSE}</p></main></body>", PROSE),
        # a line of rights or without stop words inside an article stays
        (f"<article><p>{PROSE}</p><p>All rights reserved.</p><p>{'Xyzzy ' * 40}</p></article><p>All rights reserved.</p>", f"{PROSE}\nAll rights reserved.\n{('Xyzzy ' * 40).strip()}"),
        ("<div>" * 3000 + "x" + "</div>" * 3000, "x"),
    ],
)
def test_main_text(page, text):
    assert pages.main_text(page) == text


def test_pages_with_odd_rows(spark):
    long = "<article>" + f"<p>{PROSE}</p>" * 5000 + "</article>"
    rows = [(1, "u", None, 7, "t"), (None, None, "", 7, "t"), (2, "u", long, 7, "t"), (2, "u", "<p>a", 7, "t"), (2, "u", "<p>a", 7, "t"), (3, "u", "<b>\x00&#0;&#xD800;", 7, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    out = pages.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and dict(out.dtypes)["n_chars"] == "bigint"
    got = Counter((r.page_id, r.text) for r in out.collect())
    assert got == Counter([(1, ""), (None, ""), (2, "\n".join([PROSE] * 5000)), (2, "a"), (2, "a"), (3, "\x00��")])
    assert pages.extract(df.where("page_id > 9")).collect() == []
    found = pages.page_blocks(df, F.col("page_id")).collect()
    assert len(found) == 5003 and all(r.good for r in found)


# ---------------------------------------------------------------- hard negatives


def mined(rows, every=100):
    """All pairs, plainly. rows: (id, label, vector)."""
    first = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) or abs(x) >= 2**19 for x in v):
            continue
        first[i] = min(first.get(i, (label, v)), (label, v))
    q = {i: (label, [int(np.floor(256 * float(x))) for x in v]) for i, (label, v) in first.items()}
    out = []
    for a, (label, x) in q.items():
        if a % every:
            continue
        score = {b: sum(p * r for p, r in zip(x, y, strict=True)) for b, (_, y) in q.items() if b != a and len(y) == len(x)}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if q[b][0] == label][:5]:
            fit = [b for b in order if q[b][0] != label and 80 * score[p] <= 100 * score[b] <= 100 * score[p]]
            out += [(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(fit[:5])]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>, id string, q int, block string"


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        points = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims), -1).reshape(-1, dims)
        keys = [k.tobytes() for k in negatives.hilbert_keys(points, bits)]
        path = points[sorted(range(len(points)), key=keys.__getitem__)]
        assert len(set(keys)) == len(points) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_score_bounds_hold():
    r = np.random.default_rng(3)
    a, x = r.integers(-200, 200, (20, 16)), r.integers(-200, 200, (50, 16))
    low, high = negatives.score_bounds(a, x.min(axis=0)[None], x.max(axis=0)[None])
    assert (low <= a @ x.T).all() and (a @ x.T <= high).all()


@pytest.mark.parametrize("block_rows", [4, 512])
def test_hard_negatives(spark, block_rows):
    r = random.Random(5)
    rows = []
    for i in range(400):
        centre = [r.choice((-1.0, 1.0)) for _ in range(4)]
        rows.append((i, i % 3, [c + r.gauss(0, 0.2) for c in centre]))
    rows += [(500 + i, i % 2, [0.5, 0.5, 0.5, 0.5]) for i in range(60)]  # ties
    rows += [(700, 1, None), (800, None, [1.0] * 4), (900, 1, [1.0, None, 1.0, 1.0]), (1000, 1, [1.0, float("nan"), 1.0, 1.0]), (1100, 0, [float("inf")] * 4), (None, 1, [1.0] * 4)]
    rows += [(1200 + 10 * i, i % 2, [1e5, -1e5 + i]) for i in range(12)] + [(1400 + i, i % 2, []) for i in range(9)] + [(1500, 0, [1e6] * 4)]
    rows += [(0, 2, [9.0] * 4), (0, 2, [9.0] * 4), (1600, 5, [1.0] * 4)]
    df = spark.createDataFrame([(*row, "i", 1, "b") for row in rows], VECTORS).repartition(4)
    got = sorted(tuple(x) for x in negatives.hard_negatives(df, block_rows=block_rows).collect())
    want = mined(rows)
    assert got == want and len(want) > 50 and {1200, 1400} <= {w[0] for w in want}


def test_zone_maps_spare_blocks(spark):
    """Far clusters are not read: anchors of a cluster ask for its blocks alone."""
    r = random.Random(6)
    rows = [(i, i % 2, [(3.0 if d == i // 500 else 0.0) + r.gauss(0, 0.02) for d in range(8)]) for i in range(4000)]
    df = spark.createDataFrame([(*row, "i", 1, "b") for row in rows], VECTORS)
    blocks = negatives.staged(negatives.candidate_blocks(negatives._usable(df, "vec_id", "label", "embedding"), 50))
    anchors = negatives._anchors(blocks, lambda ids: ids % 100 == 0)
    asked = negatives._requests(negatives._groups(negatives._near_each_other(negatives._first_asking(anchors))), blocks, False).agg(F.sum("n")).first()[0]
    assert asked < 0.3 * anchors.count() * blocks.count()
    assert sorted(tuple(x) for x in negatives.hard_negatives(df, block_rows=50).collect()) == mined(rows)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], VECTORS)
    out = negatives.hard_negatives(df)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and out.collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(100, 1, [1.0], "i", 1, "b"), (1, 2, [1.0], "i", 1, "b")], VECTORS)).collect() == []


# ---------------------------------------------------------------- spelling variants


def grouped(rows, every=199):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= 5}
    letters = sorted({c for w in n for c in w})
    near = {}
    for w in n:
        cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        edits = {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}
        near[w] = {e for e in edits if e in n and e != w}
    form = {w: min(near[w], key=lambda e: (-n[e], e)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=lambda r: r[0])


def found(df, **how):
    return sorted((tuple(r) for r in spelling.variants(df, **how).collect()), key=lambda r: r[0])


def test_spelling_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op13_spelling(spark, SF).collect()), key=lambda r: r[0])
    assert got == grouped(rows)
    assert found(docs, every=7, round_bytes=640) == grouped(rows, 7)


def test_spelling_of_planted_words(spark):
    words = {"colour": 700, "colours": 130, "colouur": 20, "colqur": 5, "kolour": 140, "xcolour": 139, "colou": 900, "straße": 30, "strasse": 30, "strase": 150, "straÙe": 6, "aaaaaaa": 6, "aaaaaa": 30, "aaaaaaaa": 5}
    text = " ".join(f"{w} {w.upper() if w.isascii() else w}" * (n // 2) + (f" {w}" if n % 2 else "") for w, n in words.items())
    rows = [(1, None), (None, "colour Colour, COLOUR;colour1colour"), (2, ""), (2, text), (2, text), (3, "word×mark ÀÉÎÕÜÝ " * 6), (4, "no word of six " * 1000)]
    df = spark.createDataFrame([(d, t, "w", 1, "r") for d, t in rows], "doc_id long, text string, word string, n int, root string").repartition(3)
    assert found(df) == grouped(rows, 0)
    assert found(df, every=3, round_bytes=64) == grouped(rows, 3)


def test_long_chains_of_forms_end_at_their_root(spark):
    chain = ["aaaaaa" + "b" * k for k in range(6)]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(5 ** (6 - k)))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = found(df)
    assert got == grouped([(1, text)], 0) and {r[2] for r in got} == {"aaaaaa"}


def test_spelling_of_nothing(spark):
    df = spark.createDataFrame([(1, "too few words"), (2, None)], "doc_id long, text string")
    assert spelling.variants(df).collect() == [] and spelling.variants(df.where("doc_id > 5")).collect() == []
