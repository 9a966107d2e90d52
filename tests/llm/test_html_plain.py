"""op5's whole decision against a plain version that compares every suffix with every other one of its host."""

import random
from urllib.parse import urlsplit

import pytest

from weftline.llm import htmltext as H


def parts_of(page):
    """(text, kind, region) of a page's blocks; long runs of links go where there is no article."""
    found = H.blocks_of(page or "")
    article = any(b[1] == H.ARTICLE for b in found)
    return [(t, H.OUT if not article and links > 0.9 else kind, region) for t, kind, region, links in found]


def suffixes(parts):
    """(start, block, end of the block, limit, pieces) of a page: pieces are the words of the head and of what follows it."""
    words, spans = [], []
    for text, kind, _ in parts:
        spans.append((len(words), len(words) + len(text.split()), kind))
        words += text.split()
    out = []
    for b, (first, last, kind) in enumerate(spans):
        for at in range(first, last) if kind < 0 else [first]:
            limit = len(words) if kind < 0 else last
            if at + H.FIRST > limit:
                continue
            cuts = [at + H.FIRST, *[min(at + e, limit) for e in H.ENDS]]
            cuts[-1] = max(cuts[-1], last)
            pieces = [tuple(words[at : at + H.FIRST])]
            for k in range(1, len(cuts)):
                pieces.append(tuple(words[cuts[k - 1] : cuts[k]]))
            out.append((at, b, last, limit, tuple(pieces)))
    return out


def plain(pages, telling):
    parsed = [(i, (urlsplit(url or "").hostname or "").lower(), parts_of(page)) for i, url, page in pages]
    all_ = [(i, host, parts, suffixes(parts)) for i, host, parts in parsed]
    n_pages = {h: len({i for i, g, *_ in all_ if g == h}) for _, h, *_ in all_}
    on = {}
    for i, host, _, found in all_:
        for *_, pieces in found:
            for k in range(1, len(pieces) + 1):
                on.setdefault((host, pieces[:k]), set()).add(i)
    covered, evidence = [], {}
    for i, host, parts, found in all_:
        mine = {}
        for at, b, last, limit, pieces in found:
            if parts[b][1] >= 0:
                continue
            shared = max([k for k in range(1, len(pieces) + 1) if len(on[host, pieces[:k]]) > 1], default=0)
            left = min(limit - at, H.ENDS[-1])
            reach = [0, H.FIRST, *[min(e, left) for e in H.ENDS[:-1]], max(min(H.ENDS[-1], left), last - at)][shared]
            starts, cover = mine.setdefault(b, ([], set()))
            starts.append(at)
            cover.update(range(at, at + reach))
        shares = {}
        for b, (starts, cover) in mine.items():
            inside = set(range(min(starts), max(starts) + 1))
            n, c = len(inside), len(inside & cover)
            shares[b] = c / n
            if n >= H.FIRST and n_pages[host] >= telling:
                x = evidence.setdefault(parts[b][2], [0, 0])
                x[0] += n
                x[1] += c
        covered.append(shares)
    out = []
    for (i, host, parts, found), shares in zip(all_, covered, strict=True):
        article = any(kind == H.ARTICLE for _, kind, _ in parts)
        wide = {b for at, b, _, _, pieces in found if parts[b][1] == H.ARTICLE and n_pages[host] >= telling and len(on[host, pieces]) >= H.HOST_WIDE * n_pages[host] and len(on[host, pieces]) > 1}
        keep = []
        for b, (text, kind, region) in enumerate(parts):
            n, c = evidence.get(region, (0, None))
            template, unique = c is not None and c >= H.TEMPLATE * n, c is not None and c < H.UNIQUE * n
            repeated = not article and shares.get(b, 0.0) >= H.COVERED
            if kind == H.ARTICLE:
                stays = b not in wide
            elif kind == H.OUT or template:
                stays = False
            elif unique:
                stays = not repeated
            else:
                stays = not article and kind != H.DOUBTED and not repeated
            if stays:
                keep.append(text)
        out.append((i, "\n\n".join(keep)))
    return sorted(out)


def site(seed):
    """Pages of a large and a small host: boxes that repeat, dates that don't, copied passages of many lengths, with and without an article."""
    rng = random.Random(seed)
    say = lambda n, of=4000: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    passages = [say(n) for n in (5, 7, 12, 20, 40, 70)]
    boxes = [say(n) for n in (6, 9, 30)]
    foot, everywhere = say(15), say(11)
    pages = []
    for i in range(34):
        host = "big.example" if i < 27 else "small.example"
        body = [f"<div class=promo>{rng.choice(boxes)}</div>", f"<div class=when>{say(8)}</div>"]
        text = [f"<p>{say(rng.randint(3, 40))}</p>" for _ in range(rng.randint(1, 4))] + [f"<p>{rng.choice(passages)} {say(3)}</p>" for _ in range(rng.randint(0, 2))] + [f"<p>{everywhere}</p>"] * (rng.random() < 0.9)
        rng.shuffle(text)
        body.append(f"<article>{''.join(text)}</article>" if i % 3 else f"<div class=box{i % 2}>{''.join(text)}</div>")
        body += [f"<div>{foot}</div>", "<ul>" + "".join(f"<li><a href=x>{say(2, 9)}</a>" for _ in range(5)) + "</ul>"]
        pages.append((i, f"http://{host}/{i}", f"<html><body>{''.join(body)}</body></html>"))
    return pages + [(100, "http://big.example/n", None), (101, None, f"<div>{foot}</div>"), (5, "http://big.example/5", pages[5][2])]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("telling", [20, 5])
def test_the_whole_decision_against_brute_force(spark, seed, telling):
    pages = site(seed)
    want = plain(pages, telling)
    got = sorted((r.page_id, r.text) for r in H.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), telling_pages=telling).collect())
    assert got == want
    texts = [t for _, t in want if t]
    assert len(set(texts)) > 20 and plain(pages, 1000) != want  # repeats decide something
