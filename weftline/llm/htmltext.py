"""Main text of web pages by a suffix array over each host's token streams.

Structure parses a page into blocks with a region each, the path of elements and
class names that they stand in, and settles only what HTML itself settles:
scripts, styles, forms, navigation, footers and asides are no text, an article
is. Everything else is open, and the host decides.

The token streams of a host's pages form one suffix array. A suffix is written
as FIRST tokens and the names of the pieces behind them, each twice as long, so
that sorted neighbours share as many leading units as their common prefix is
long. Suffixes begin at every token of an open block and where any other block
begins; those of other blocks end with their block. Equal suffixes of a task are
one row from the start. Rows meet by host
and first tokens, so a host is sliced by prefix and never sits in one task; in a
slice the sorted rows and the common prefixes of neighbours (the LCP array) give
the intervals of suffixes that distinct pages share, and how long they are.

Repeats decide in three ways. An open region whose tokens are covered by repeats
for the greater part, on hosts with enough pages to tell, is a template: its
blocks go, wherever they stand; one that is hardly ever covered keeps them. On
pages without an article, blocks that repeats cover go and unique runs stay.
Inside an article a passage may repeat, as copies and quotations do, and stays,
unless it stands on nearly every page of its host. Where no host is large enough
to tell, or the share lies between, class names decide about a region.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.runtime import BROADCAST_ROWS, checked_broadcast, kept, small_batches
from weftline.llm.textvec import mix64

#: Tokens of the shortest repeated substring that counts: as many stand at the head of a suffix, one unit each.
FIRST = 6
#: Where the pieces behind the first tokens end. The last one goes on to the end of its block.
ENDS = (12, 24, 48)
#: A suffix as numbers of 16 bits: one for each of the first tokens, two for the name of each piece.
WIDTH = FIRST + 2 * len(ENDS)

#: Share of a block's tokens that repeats must cover; a host tells about regions from so many pages on.
COVERED, TELLING_PAGES = 0.8, 20
#: A region is a template from this covered share of its tokens on, and differs from page to page below that one.
TEMPLATE, UNIQUE = 0.5, 0.05
#: Share of a host's pages that an article's passage must stand on to be the host's and not the article's.
HOST_WIDE = 0.8

#: Elements deeper than this are treated as their parents, as browsers do (fixed value).
DEEPEST = 512

#: Suffixes that a task holds before it merges equal ones.
HELD = 200_000

#: Element names by what they mean for text (fixed values).
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
GONE = frozenset("head nav footer aside form button select option menu dialog svg math canvas object audio video map datalist".split()) | RAW
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr blockquote pre figure figcaption address hr header footer nav aside form fieldset legend details summary center hgroup menu dialog".split()
)
CELLS = frozenset({"td", "th", "br"})
SOLID = BLOCK - {"p", "li", "dt", "dd", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class, id and role for what differs from page to page and is no article text: repeats can't show it (fixed values).
READERS = frozenset("comment comments disqus reply replies respond related recommended recommendations form search login".split())
#: Words for what a site repeats: they count only where no host is large enough to tell (fixed values).
SITE = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets footer masthead cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup sharing share social pagination pager toolbar contentinfo complementary alert dialog".split()
)
IS_ARTICLE = frozenset("articlebody article post entry story content main".split())

#: What a block is before repeats are asked: text of an article, gone, or open; open with a class name that a site's own parts have.
ARTICLE, OUT, OPEN, DOUBTED = 1, 0, -1, -2

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|([^<]+|<)", re.S)
_LOOSE = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)([^<>]*+)>|<[!?][^>]*>|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")
_WORDS = re.compile(r"[a-z]+")
#: The host of an address.
HOST = r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _marks(tag: str, attributes: str) -> tuple[int, bool, str]:
    """(-1 for an element that holds no article text, 1 for an article, 0 else; whether its names are those of a site's own parts; its names)."""
    if tag in GONE:
        return -1, False, ""
    found, doubted, names = 1 if tag in ("article", "main") else 0, False, ""
    if attributes and not attributes.isspace():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                words = _WORDS.findall(value)
                if name == "class":
                    names = ".".join(words)
                if tag not in ("html", "body", "article", "main"):
                    if not READERS.isdisjoint(words):
                        return -1, False, names
                    doubted = doubted or not SITE.isdisjoint(words)
                if not doubted and tag in SOLID and tag not in ("html", "body") and not IS_ARTICLE.isdisjoint(words):
                    found = max(found, 1)
            elif name == "itemprop" and value == "articlebody":
                found = 1
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                return -1, False, names
    return (0 if doubted else found), doubted, names


class _State:
    """An open element and what holds for the text in it."""

    __slots__ = ("tag", "inside", "gone", "doubted", "link", "path")

    def __init__(self, tag: str, inside: bool, gone: bool, doubted: bool, link: bool, path: int):
        self.tag, self.inside, self.gone, self.doubted, self.link, self.path = tag, inside, gone, doubted, link, path


_ROOT = _State("", False, False, False, False, 0)


def blocks_of(page: str | None) -> list[tuple[str, int, int, float]]:
    """(text, kind, region, share of it inside links) of each block with text, in page order. Linear in the page's length."""
    out: list[tuple[str, bool, bool, bool, int, float]] = []
    stack: list[_State] = []
    counts: dict[str, int] = {}
    parts: list[str] = []
    linked: list[str] = []
    page = page or ""

    def end_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                size = len(" ".join("".join(linked).split()))
                out.append((text, now.inside, now.gone, now.doubted, now.path, size / len(text)))
            parts.clear()
            linked.clear()

    now, scan = _ROOT, _TOKEN
    at, end, last_bracket = 0, len(page), page.rfind(">")
    while at < end:
        m = scan.match(page, at)
        if m is None or (m[4] == "<" and scan is _TOKEN and at < last_bracket and page[at + 1 : at + 2].isalpha()):
            scan = _LOOSE  # a quotation mark that never closes: tags end at the next bracket from here on
            m = scan.match(page, at)
        if m is None:
            parts.append("&lt;" if page[at] == "<" else page[at])
            at += 1
            continue
        at = m.end()
        text = m[4]
        if text is not None:
            text = html.unescape(text)
            parts.append(text)
            if now.link:
                linked.append(text)
            continue
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in CELLS:
            parts.append(" ")
            if tag == "br":
                continue
        if m[1]:
            if counts.get(tag):
                closing, before = tag in BLOCK, now
                k = len(stack) - 1
                while stack[k].tag != tag:
                    closing = closing or stack[k].tag in BLOCK
                    k -= 1
                after = stack[k - 1] if k else _ROOT
                if closing or before.gone != after.gone:
                    end_block()
                for s in stack[k:]:
                    counts[s.tag] -= 1
                del stack[k:]
            elif tag in BLOCK:
                end_block()
        else:
            if tag in BLOCK:
                end_block()
                if counts.get("p") or (tag in ("li", "dt", "dd", "tr", "option") and counts.get(tag)):
                    for k in range(len(stack) - 1, -1, -1):  # a paragraph ends where the next block starts
                        if stack[k].tag == "p" or (stack[k].tag == tag and tag in ("li", "dt", "dd", "tr", "option")):
                            for s in stack[k:]:
                                counts[s.tag] -= 1
                            del stack[k:]
                            break
                        if stack[k].tag in SOLID:
                            break
            now = stack[-1] if stack else _ROOT
            if tag in VOID:
                continue
            mark, doubted, names = _marks(tag, m[3])
            gone = mark < 0 or (tag == "header" and not now.inside)
            if gone and not now.gone:
                end_block()
            if tag in RAW and not m[3].endswith("/"):
                close = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
                at = close.end() if close else end
                continue
            if len(stack) >= DEEPEST:
                continue
            inside = now.inside or (mark > 0 and not now.doubted)
            path = now.path
            if tag in BLOCK and tag not in ("html", "body"):
                path = xxhash.xxh64_intdigest(f"{path:x}/{tag}.{names}") >> 1
            # names of a site's own parts inside an article are believed: an article isn't measured by region
            stack.append(_State(tag, inside, now.gone or gone or (doubted and now.inside), now.doubted or doubted, now.link or tag == "a", path))
            counts[tag] = counts.get(tag, 0) + 1
        now = stack[-1] if stack else _ROOT
    end_block()
    return [(text, OUT if gone else ARTICLE if inside else DOUBTED if doubted else OPEN, path, links) for text, inside, gone, doubted, path, links in out]


def _ids(text: str) -> list[int]:
    return [xxhash.xxh32_intdigest(w) or 1 for w in text.split()]


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def suffix_keys(tokens: np.ndarray, at: np.ndarray, block_end: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The suffixes that begin at ``at`` and end at ``limit``, as n x WIDTH numbers.

    Two suffixes share their first tokens, or a piece, exactly if they share the
    numbers that stand for them (but for a hash collision); numbers past the
    limit are 0. A suffix has FIRST tokens at least.
    """
    n, size = len(tokens), len(at)
    units = np.zeros((size, WIDTH), dtype=">u2")
    for k in range(FIRST):
        units[:, k] = (tokens[at + k] & np.uint64(0xFFFF)).astype(np.uint16)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(tokens.astype(np.uint64)) * _powers(_STEP, n), dtype=np.uint64)])
    back = _powers(_BACK, n + 1)
    start = at + FIRST
    for k, reach in enumerate(ENDS):
        stop = np.minimum(at + reach, limit)
        if k == len(ENDS) - 1:
            stop = np.maximum(stop, block_end)
        name = np.where(stop > start, mix64((sums[stop] - sums[start]) * back[start] + np.uint64(1)) >> np.uint64(32) | np.uint64(1), np.uint64(0))
        units[:, FIRST + 2 * k] = (name >> np.uint64(16)).astype(np.uint16)
        units[:, FIRST + 2 * k + 1] = (name & np.uint64(0xFFFF)).astype(np.uint16)
        start = stop
    return units


def _stream(found: list[tuple[str, int, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, where suffixes begin, where their blocks end, where they end, their blocks' numbers) of a page; none of fewer than FIRST tokens."""
    tokens: list[int] = []
    at: list[int] = []
    stop: list[int] = []
    block: list[int] = []
    for i, (text, kind, _, _) in enumerate(found):
        ids = _ids(text)
        n, size = len(tokens), len(ids)
        tokens += ids
        begins = range(n, n + size) if kind < 0 else (n,)
        at += begins
        stop += [n + size] * len(begins)
        block += [i] * len(begins)
    a, stops, blocks = (np.array(x, dtype=np.int64) for x in (at, stop, block))
    limit = np.where(np.array([b[1] for b in found] or [0])[blocks] < 0, len(tokens), stops)
    keep = a + FIRST <= limit
    return np.array(tokens, dtype=np.uint64), a[keep], stops[keep], limit[keep], blocks[keep]


def _names(units: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row of units."""
    out = np.zeros(len(units), dtype=np.uint64)
    for k in range(0, WIDTH, 2):
        pair = units[:, k].astype(np.uint64) << np.uint64(16) | units[:, k + 1].astype(np.uint64)
        out = mix64(out * _STEP + pair + np.uint64(k + 1))
    return out.view(np.int64)


_PARSED = "struct<blocks:array<string>, kinds:array<tinyint>, regions:array<bigint>, units:binary, begins:array<int>, lefts:array<int>, rests:array<int>, places:array<int>>"


def _parse(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Pages as blocks, and their suffixes. The texts of blocks that are gone aren't kept."""
    for pages in series:
        rows = []
        for page in pages:
            found = blocks_of(page)
            if not any(b[1] == ARTICLE for b in found):  # no article: long runs of links are no text
                found = [(text, OUT if links > 0.9 else kind, region, links) for text, kind, region, links in found]
            tokens, at, stop, limit, block = _stream(found)
            units = suffix_keys(tokens, at, stop, limit)
            open_ = np.array([b[1] for b in found] or [0])[block] < 0  # elsewhere only names are asked for
            left, rest = np.where(open_, np.minimum(limit - at, ENDS[-1]), 0), np.where(open_, stop - at, 0)
            rows.append(([b[0] if b[1] else "" for b in found], [b[1] for b in found], [b[2] for b in found], units.tobytes(), np.where(open_, at, 0).tolist(), left.tolist(), rest.tolist(), block.tolist()))
        yield pd.DataFrame(rows, columns=["blocks", "kinds", "regions", "units", "begins", "lefts", "rests", "places"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, units) -> the suffixes, equal ones of a task once, with the least and greatest page and the number of pages."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> pa.RecordBatch:
        host, page, units = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((page, *(units[:, k] for k in range(WIDTH - 1, -1, -1)), host))
        host, page, units = host[order], page[order], units[order]
        first = np.r_[True, (host[1:] != host[:-1]) | (units[1:] != units[:-1]).any(axis=1)]
        other = first | np.r_[True, page[1:] != page[:-1]]
        begin = np.flatnonzero(first)
        last = np.r_[begin[1:], len(host)] - 1
        key = pa.array([u.tobytes() for u in units[begin].astype(">u2")], pa.binary())  # sorts as the numbers do
        return pa.RecordBatch.from_arrays(
            [pa.array(host[begin]), key, pa.array(page[begin]), pa.array(page[last]), pa.array(np.add.reduceat(other, begin).astype(np.int64))], names=["host", "key", "low", "high", "pages"]
        )

    for batch in batches:
        found = [np.frombuffer(u or b"", dtype=">u2").reshape(-1, WIDTH) for u in batch.column(2).to_pylist()]
        n = [len(u) for u in found]
        if not sum(n):
            continue
        held.append((np.repeat(batch.column(0).to_numpy(), n), np.repeat(batch.column(1).to_numpy(), n), np.concatenate(found)))
        size += sum(n)
        if size >= HELD:
            yield merged()
            held, size = [], 0
    if size:
        yield merged()


def repeats(host: np.ndarray, units: np.ndarray, low: np.ndarray, high: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, pieces, pages) of sorted suffixes that distinct pages share: one row of each that is repeated.

    pieces counts what is shared: 1 for the first tokens, one more for each
    piece behind them; pages is on how many the whole suffix stands.
    """
    same = np.zeros(len(host), dtype=np.int64)  # the LCP array, in numbers
    equal = np.logical_and.accumulate((units[1:] == units[:-1]) & (host[1:] == host[:-1])[:, None], axis=1)
    same[1:] = equal.sum(axis=1)
    pieces = np.zeros(len(host), dtype=np.int64)
    for piece, k in enumerate(range(FIRST, WIDTH + 1, 2), start=1):
        begin = np.flatnonzero(same < k)
        shared = np.minimum.reduceat(low, begin) != np.maximum.reduceat(high, begin)
        of = np.cumsum(same < k) - 1
        pieces[shared[of]] = piece
    begin = np.flatnonzero(same < WIDTH)
    rows = begin[pieces[begin] > 0]
    return rows, pieces[rows], np.add.reduceat(pages, begin)[pieces[begin] > 0]


def _array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes of a slice -> (host, name, pieces, pages) of those that distinct pages share. Suffixes of one host and first tokens stay together."""
    rest: list[pa.RecordBatch] = []

    def found(table: pa.Table) -> pa.RecordBatch:
        host, low, high, pages = (table.column(c).to_numpy() for c in ("host", "low", "high", "pages"))
        units = np.frombuffer(b"".join(table.column("key").to_pylist()), dtype=">u2").reshape(-1, WIDTH)
        rows, pieces, n = repeats(host, units, low, high, pages)
        return pa.RecordBatch.from_arrays([pa.array(host[rows]), pa.array(_names(units[rows])), pa.array(pieces), pa.array(n)], names=["host", "name", "pieces", "pages"])

    for batch in batches:
        if not batch.num_rows:
            continue
        host, head = batch.column(0).to_numpy(), np.array([k[: 2 * FIRST] for k in batch.column(1).to_pylist()], dtype=object)
        cut = np.flatnonzero((host[1:] != host[:-1]) | (head[1:] != head[:-1]))
        if rest and (rest[-1].column(0)[-1].as_py(), rest[-1].column(1)[-1].as_py()[: 2 * FIRST]) != (host[0], head[0]):
            yield found(pa.Table.from_batches(rest))
            rest = []
        if len(cut):
            yield found(pa.Table.from_batches([*rest, batch.slice(0, cut[-1] + 1)]))
            rest = [batch.slice(cut[-1] + 1)]
        else:
            rest.append(batch)
    if rest:
        yield found(pa.Table.from_batches(rest))


_PLACES = "row bigint, host bigint, name bigint, region bigint, block int, start int, left int, rest int"


def _places(article: bool):
    """(row, host, kinds, regions, units, begins, lefts, rests, places) -> where the suffixes of open blocks begin, or of an article's, with their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out = []
            for i in range(batch.num_rows):
                place = np.array(columns["places"][i].as_py(), dtype=np.int64)
                if not len(place):
                    continue
                kinds = np.array(columns["kinds"][i].as_py(), dtype=np.int64)[place]
                want = kinds == ARTICLE if article else kinds < 0
                if not want.any():
                    continue
                units = np.frombuffer(columns["units"][i].as_py(), dtype=">u2").reshape(-1, WIDTH)[want]
                start, left, rest = (np.array(columns[c][i].as_py(), dtype=np.int32)[want] for c in ("begins", "lefts", "rests"))
                region = np.array(columns["regions"][i].as_py(), dtype=np.int64)[place[want]]
                n = len(start)
                out.append((np.full(n, columns["row"][i].as_py()), np.full(n, columns["host"][i].as_py()), _names(units), region, place[want].astype(np.int32), start, left, rest))
            if out:
                arrays = [np.ascontiguousarray(np.concatenate(c)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=[c.split()[0] for c in _PLACES.split(", ")])

    return run


def _shown(found: list[tuple[str, int, int]], covered: dict[int, float], templates: frozenset, unique: frozenset, wide: frozenset) -> str:
    """The text of a page: which of its (text, kind, region) stay, given what repeats say."""
    article = any(kind == ARTICLE for _, kind, _ in found)
    keep = []
    for i, (text, kind, region) in enumerate(found):
        if kind == ARTICLE:
            stays = i not in wide
        elif kind == OUT or region in templates:
            stays = False
        elif region in unique:
            stays = article or covered.get(i, 0.0) < COVERED
        else:
            stays = not article and kind != DOUBTED and covered.get(i, 0.0) < COVERED
        if stays:
            keep.append(text)
    return "\n\n".join(keep)


def _verdicts(evidence) -> tuple[frozenset, frozenset]:
    """(regions that are templates, regions that differ from page to page) of (region, tokens, covered tokens)."""
    rows = list(evidence)
    return frozenset(r for r, n, covered in rows if covered >= TEMPLATE * n), frozenset(r for r, n, covered in rows if covered < UNIQUE * n)


def extract(pages: DataFrame, regions_at_once: int = BROADCAST_ROWS, telling_pages: int = TELLING_PAGES) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    A null html gives an empty text, a null url the host ''. Rows that repeat a
    page_id are one page when repeats are counted, and one row each in the
    result. Very long pages are read in linear time. An empty table gives an
    empty result; further columns are ignored. What repeats say about regions is
    sent to tasks if it has no more than ``regions_at_once`` rows, and joined
    otherwise; the result is the same.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    @F.pandas_udf(_PARSED)
    def parse(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _parse(series)

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    parsed = rows.select("page_id", "url", F.xxhash64(host).alias("host"), parse("html").alias("p")).select("page_id", "url", "host", F.xxhash64("page_id", "url", "p.blocks", "p.units").alias("row"), "p.*")
    parsed = kept(parsed, "html-parsed", "gzip")  # mostly text
    one_page = F.coalesce("page_id", F.lit(-1))
    suffixes = parsed.select("host", one_page.alias("page"), "units").mapInArrow(_suffixes, "host bigint, key binary, low bigint, high bigint, pages bigint")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    head = F.substring("key", 1, 2 * FIRST)
    array = suffixes.repartition(n_parts, F.col("host"), head).sortWithinPartitions("host", "key")
    found = kept(array.mapInArrow(_array, "host bigint, name bigint, pieces bigint, pages bigint"), "html-repeats")
    hosts = kept(parsed.groupBy("host").agg(F.count_distinct(one_page).alias("host_pages")), "html-hosts")

    # how much of each open block is covered, from the repeats that begin in it
    streams = parsed.select("row", "host", "kinds", "regions", "units", "begins", "lefts", "rests", "places")
    open_ = streams.where(F.exists("kinds", lambda k: k < 0)).mapInArrow(_places(False), _PLACES)
    hits = open_.join(found.select("host", "name", "pieces"), ["host", "name"], "left").dropDuplicates(["row", "block", "start"])
    ends = [F.lit(FIRST), *[F.least(F.lit(e), "left") for e in ENDS[:-1]], F.greatest(F.least(F.lit(ENDS[-1]), "left"), "rest")]
    reach = F.element_at(F.array(*ends), F.col("pieces").cast("int"))
    span = F.when(F.col("pieces").isNotNull(), F.struct("start", (F.col("start") + reach).alias("stop")))
    spans = hits.groupBy("row", "host", "region", "block").agg(F.min("start").alias("first"), (F.max("start") + 1).alias("last"), F.sort_array(F.collect_list(span)).alias("spans"))
    step = lambda done, s: F.struct((done.n + F.greatest(F.least(s.stop, F.col("last")) - F.greatest(s.start, done.upto), F.lit(0))).alias("n"), F.greatest(done.upto, s.stop).alias("upto"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), step).n
    spans = kept(spans.select("row", "host", "region", "block", (F.col("last") - F.col("first")).alias("tokens"), covered.alias("covered")), "html-spans")
    telling = hosts.where(F.col("host_pages") >= telling_pages)
    evidence = spans.where(F.col("tokens") >= FIRST).join(checked_broadcast(telling, regions_at_once), "host")
    evidence = kept(evidence.groupBy("region").agg(F.sum("tokens").alias("tokens"), F.sum("covered").alias("covered")), "html-regions")

    # passages of articles that stand on nearly all pages of their host
    wide = kept(found.join(telling, "host").where(F.col("pages") >= HOST_WIDE * F.col("host_pages")).select("host", "name").distinct(), "html-wide")
    has_article = F.exists("kinds", lambda k: k == ARTICLE)
    parts = parsed.select("page_id", "url", "row", "blocks", "kinds", "regions", has_article.alias("article"))
    none = F.lit(None)
    if wide.isEmpty():
        parts = parts.withColumn("wide", none.cast("array<int>"))
    else:
        of_articles = streams.mapInArrow(_places(True), _PLACES).join(checked_broadcast(wide, regions_at_once), ["host", "name"])
        parts = parts.join(checked_broadcast(kept(of_articles.groupBy("row").agg(F.collect_set("block").alias("wide")), "html-wide-rows"), regions_at_once), "row", "left")
    shares = spans.join(parsed.where(~has_article).select("row").distinct(), "row").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("block", (F.col("covered") / F.col("tokens")).alias("share")))).alias("covered"))
    whole = parts.where("article").withColumn("covered", none.cast("map<int,double>")).unionByName(parts.where("NOT article").join(shares, "row", "left"))
    if evidence.limit(regions_at_once + 1).count() <= regions_at_once:
        templates, unique = _verdicts((r["region"], r["tokens"], r["covered"]) for r in evidence.collect())  # bounded by regions_at_once
        known = whole.withColumn("said", none.cast("array<struct<region:bigint,tokens:bigint,covered:bigint>>"))
    else:
        templates, unique = frozenset(), frozenset()
        asked = streams.select("row", F.explode(F.array_distinct("regions")).alias("region")).distinct().join(evidence, "region")
        known = whole.join(asked.groupBy("row").agg(F.collect_list(F.struct("region", "tokens", "covered")).alias("said")), "row", "left")

    def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for texts, kinds, regions, wide_ones, shares_, said in zip(b["blocks"], b["kinds"], b["regions"], b["wide"], b["covered"], b["said"], strict=True):
                t, k = (templates, unique) if said is None else _verdicts((r["region"], r["tokens"], r["covered"]) for r in said)
                out.append(_shown(list(zip(texts, kinds, regions, strict=True)), dict(shares_ or ()), t, k, frozenset(() if wide_ones is None else wide_ones)))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": out})

    shown = known.select("page_id", "url", "blocks", "kinds", "regions", "wide", "covered", "said").mapInPandas(show, "page_id bigint, url string, text string")
    return shown.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
