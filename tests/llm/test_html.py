import html
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import htmltext as H

SF = "/root/testdata/sf0.01"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=/>Home</a> <a href=/b>About</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; more</h1><p>First <b>para</b>{i}<br>on &lt;two&gt; lines<p>Second &eacute; para<script>if (a<b) "</p>"</script></p><aside>side</aside><div class="comments"><p>reader says</p></div></article>
<form>Search <input></form><footer>&copy; host</footer></body></html>"""


def texts(spark, rows, **kw):
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    return H.extract(d, **kw).collect()


def test_article_of_a_page():
    kinds = [(b[0], b[1]) for b in H.blocks_of(PAGE.format(i=1))]
    assert [t for t, k in kinds if k == H.ARTICLE] == ["Head & more", "First para1 on <two> lines", "Second é para"]
    assert ("We use cookies", H.DOUBTED) in kinds and ("reader says", H.OUT) in kinds


def brute(streams):
    """Longest common prefix, up to 48 tokens, of every suffix with one of another stream."""
    out = {}
    for p, s in enumerate(streams):
        for i in range(len(s)):
            best = 0
            for q, t in enumerate(streams):
                if q == p:
                    continue
                for j in range(len(t)):
                    k = 0
                    while k < 48 and i + k < len(s) and j + k < len(t) and s[i + k] == t[j + k]:
                        k += 1
                    best = max(best, k)
            out[p, i] = best
    return out


def test_suffix_array_against_brute_force():
    rng = np.random.default_rng(5)
    shared = [list(rng.integers(1, 9, n)) for n in (6, 9, 13, 30, 60)]
    streams = []
    for p in range(7):
        s = list(rng.integers(1, 5, 20))
        for k in rng.permutation(5)[:3]:
            s += shared[k] + list(rng.integers(100 * p, 100 * p + 90, int(rng.integers(3, 12))))
        streams.append(s)
    want = brute(streams)
    units, pages, at = [], [], []
    for p, s in enumerate(streams):
        i = np.arange(len(s) - H.FIRST + 1)
        n = np.full(len(i), len(s))
        u = H.suffix_keys(np.array(s, dtype=np.uint64), i, i, n)
        units.append(u)
        pages += [p] * len(i)
        at += i.tolist()
    units, pages, at = np.concatenate(units), np.array(pages), np.array(at)
    order = np.lexsort((pages, *(units[:, k] for k in range(H.WIDTH - 1, -1, -1))))
    units, pages, at = units[order], pages[order], at[order]
    host = np.zeros(len(at), dtype=np.int64)
    rows, pieces, n = H.repeats(host, units, pages, pages, np.ones(len(at), dtype=np.int64))
    length = {}
    names = {u.tobytes(): k for u, k in zip(units[rows], pieces, strict=True)}
    for u, p, i in zip(units, pages, at, strict=True):
        k = names.get(u.tobytes(), 0)
        length[p, i] = (0, H.FIRST, *H.ENDS)[k]
    for (p, i), best in want.items():
        left = len(streams[p]) - i
        found = length.get((p, i), 0)
        if left >= 48:  # beyond, a piece may end with its stream
            assert found == max([0, *[e for e in (H.FIRST, *H.ENDS) if e <= best]]), (p, i, best)
    for p, s in enumerate(streams):
        cover = lambda by: {i + k for i in range(len(s)) for k in range(by(p, i)) if i + k < len(s)}
        assert cover(lambda p, i: length.get((p, i), 0)) >= cover(lambda p, i: want[p, i] if want[p, i] >= H.FIRST else 0)
    assert max(want.values()) == 48  # the longest planted run reaches the last piece


def test_repeats_decide_on_pages_without_article(spark):
    plate = "<div>Home About Contact Privacy Imprint Terms Press Jobs Help Map</div>"
    pages = [(i, f"http://h.example/{i}", f"<body>{plate}<div>{' '.join(f'u{i}x{k}' for k in range(20))}</div>{plate}</body>") for i in range(6)]
    pages += [(10, None, None), (11, "http://h.example/z", ""), (12, "http://other.example", f"<body>{plate}</body>"), (13, "http://h.example/p", PAGE.format(i=2)), (13, "http://h.example/p", PAGE.format(i=2))]
    rows = texts(spark, pages)
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(pages)
    assert got[3].text == " ".join(f"u3x{k}" for k in range(20)) and got[3].n_chars == len(got[3].text)
    assert got[10].text == got[11].text == "" and got[12].text.startswith("Home")  # one page repeats nothing
    assert got[13].text == "Head & more\n\nFirst para2 on <two> lines\n\nSecond é para"
    assert texts(spark, [(7, "http://x.example", None)])[0].text == "" and texts(spark, pages[:0]) == []


def test_regions_and_host_wide_passages(spark):
    def page(i):
        box = f"<div class=box>Buy now and save on offer {i % 3} today only here</div>"
        date = f"<div class=when>written day{i} a{i} b{i} c{i} d{i} e{i} f{i}</div>"
        quote = "<p>a well known passage that some of the pages quote in full</p>" if i % 3 == 0 else ""
        return (i, f"http://h.example/{i}", f"<body>{box}{date}<article><p>own text {i}</p>{quote}<p>please share this article with all of your friends</p></article></body>")

    pages = [page(i) for i in range(40)]
    for kw in ({}, {"regions_at_once": 0}):  # sent to tasks, and joined
        got = {r.page_id: r.text.split("\n\n") for r in texts(spark, pages, **kw)}
        assert got[1] == ["written day1 a1 b1 c1 d1 e1 f1", "own text 1"]  # a unique region stays, a template and a host-wide passage go
        assert got[3][1:] == ["own text 3", "a well known passage that some of the pages quote in full"]  # a passage that some pages share stays
    few = {r.page_id: r.text for r in texts(spark, pages[:5])}
    assert few[1] == "own text 1\n\nplease share this article with all of your friends"  # too few pages to tell


def articles(sf):
    out = {}
    for i, page in duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall():
        m = re.search(r"<article>(.*?)</article>", page or "", re.S)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)\b[^>]*>", m[1] if m else "")]
        out[i] = "\n\n".join(p for p in parts if p)
    return out


def test_articles_of_the_given_pages_and_the_array_matters(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert got == articles(SF)
    # each page a host of its own: no substring is repeated, so the array shows no region to be a template
    alone = pages.withColumn("url", F.concat(F.lit("http://h"), F.col("page_id").cast("string"), F.lit(".example/")))
    off = {r.page_id: r.text for r in H.extract(alone, telling_pages=1).collect()}
    assert sum(off[i] != got[i] for i in got) > len(got) / 2


@pytest.mark.parametrize("page", ["<b>x</i>" * 120_000, "<b>" * 60_000 + "<h1>x" * 60_000, '<a "' * 200_000, "<" * 300_000 + ">", "<p>" + "wort " * 200_000])
def test_long_pages_take_seconds(page):
    start = time.perf_counter()
    H.blocks_of(page)
    assert time.perf_counter() - start < 6


@pytest.mark.parametrize("page, want", [("a < b", ["a < b"]), ("<p>x<p>y", ["x", "y"]), ("<a title='x>y'>z</a>", ["z"]), ("<!-- c --><b>k", ["k"]), ("<", ["<"]), ("<script>never ends", [])])
def test_odd_markup(page, want):
    assert [b[0] for b in H.blocks_of(page)] == want
