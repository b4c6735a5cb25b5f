"""HTML extraction: neighbours and differencing against plain loops over whole tables, and markup that is broken."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from acopio.llm import html_extract as hx


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, rest = rest[:cut].lower(), rest[cut:]
    return host, rest[:min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]


def brute(rows):
    """(page_id, text) of each row, page by page."""
    parsed = [[b for b in hx.blocks(h or "") if b[0] >= 0] for _, _, h in rows]
    hosts = defaultdict(dict)
    for (_, url, _), page in zip(rows, parsed):
        host, path = host_path(url)
        if host and page:
            key = tuple(page)
            hosts[host][key] = min(hosts[host].get(key, (path, url)), (path, url))
    gone = {}
    number = {}
    lines = lambda page: np.array([number.setdefault(t, len(number)) for _, t in page], dtype=np.int64)
    words = lambda page, flags=None: sum(len(t.split()) for i, (_, t) in enumerate(page) if flags is None or flags[i])
    for host, pages in hosts.items():
        order = sorted(pages, key=lambda p: pages[p])
        run, first = [], 0
        for i, p in enumerate(order):
            if i:
                q = order[i - 1]
                if words(q, hx.shared(lines(q), lines(p))) < .9 * min(words(q), words(p)):
                    first = i
            run.append(first)
        last = {f: max(i for i, g in enumerate(run) if g == f) for f in run}
        same = []
        for i, p in enumerate(order):
            parts = pages[p][0].split("/")
            best = None
            for j in (run[i] - 1, last[run[i]] + 1):
                if 0 <= j < len(order):
                    other = pages[order[j]][0].split("/")
                    n = next((k for k, (a, b) in enumerate(zip(parts, other)) if a != b), None)
                    n = n if n is not None else max(len(parts), len(other)) if len(parts) == len(other) else min(len(parts), len(other))
                    if best is None or n > best[0]:
                        best = n, j
            same.append(hx.shared(lines(p), lines(order[best[1]])) if best else np.zeros(len(p), dtype=bool))
        seen = defaultdict(set)
        for i, p in enumerate(order):
            for (r, t), s in zip(p, same[i]):
                if r > 0 and s:
                    seen[t].add(run[i])
        runs = len(set(run))
        site = {t for t, at in seen.items() if len(at) >= hx.SITE and len(at) >= hx.SHARE * runs}
        for i, p in enumerate(order):
            marked = any(r > 0 for r, _ in p)
            gone[(host, p)] = [bool(s) and (not marked or (r > 0 and t in site)) for (r, t), s in zip(p, same[i])]
    out = []
    for (i, url, _), page in zip(rows, parsed):
        least = 1 if any(r > 0 for r, _ in page) else 0
        drop = gone.get((host_path(url)[0], tuple(page)), [False] * len(page))
        out.append((i, "\n\n".join(t for (r, t), d in zip(page, drop) if r >= least and not d)))
    return out


@pytest.mark.parametrize("few", [True, False])
def test_whole_tables_as_page_by_page(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(hx, "fits_broadcast", lambda df: False)
    rng = random.Random(9)
    rows = []
    for h in range(6):
        top, notice = f"<div>Welcome to site {h}</div>", f"<p>Letter of {h} for ten a year.</p>"
        for k in range(14):
            body = "".join(f"<p>h{h} page {k} line {i} tells {rng.randrange(10 ** 6)} things.</p>" for i in range(rng.randrange(2, 9)))
            if rng.random() < .3:
                body += f"<p>{rng.choice(['A common line of two.', 'Another common line.'])}</p>"
            page = top + (f"<article>{notice}{body}</article>" if h % 2 else notice * (rng.random() < .6) + body) + "<p>About us all</p>"
            path = "/".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) + f"/{k}"
            rows.append((len(rows), f"http://Host{h}.org/{path}?q={k}", page))
            for c in range(rng.choice([0, 0, 0, 2])):      # copies and near copies
                rows.append((len(rows), f"http://host{h}.org/{path}-{c}", page + "<p>Printed.</p>" * c))
    rows += [(900, None, rows[0][2]), (901, "no host", "<p>x</p>"), (902, "http://host0.org/a", None), (903, "http://host0.org/b", ""), (None, *rows[3][1:]), (904, *rows[5][1:])]
    df = spark.createDataFrame([(*r, 1, "x", "x") for r in rows], "page_id bigint, url string, html string, at int, key string, gone string").repartition(6)
    got = hx.extract(df)
    assert got.columns == ["page_id", "url", "text"]
    want = brute(rows)
    assert Counter((r.page_id, r.text) for r in got.collect()) == Counter(want)
    raw = sum(len([b for b in hx.blocks(h or "") if b[0] >= 0]) for _, _, h in rows)
    assert sum(len(t.split("\n\n")) for _, t in want) < raw - 100          # lines went


def text_of(page):
    found = hx.blocks(page)
    least = 1 if any(r > 0 for r, _ in found) else 0
    return [t for r, t in found if r >= least]


def test_class_words_inside_an_article():
    for keeps in ("section-header", "side-note", "share-price", "search-engine-history", "menu-of-the-day", "comment-worthy", "footnote", "ads-history"):
        assert text_of(f"<article><h1>Head</h1><div class='{keeps} wide'><h2>Two</h2><p>Three</p></div></article>") == ["Head", "Two", "Three"], keeps
    for drops in ("ad", "share-buttons", "sidebar", "comments-list", "related_posts", "newsletter-signup", "box social"):
        assert text_of(f"<article><h1>Head</h1><div class='{drops}'><p>Three</p></div><p>Four</p></article>") == ["Head", "Four"], drops
    assert text_of("<div class='site-header'>top</div><p>Text</p>") == ["Text"]


def test_raw_elements_without_an_end():
    for name in ("object", "noscript", "iframe", "svg", "template", "textarea"):
        assert text_of(f"<p>a</p><{name} data=x><p>b</p><p>c</p>") == ["a", "b", "c"], name
        assert text_of(f"<p>a</p><{name}>no</{name}><p>b</p><{name}><p>c</p>") == ["a", "b", "c"], name
    assert text_of("<p>a</p><script>var x = '<p>no</p>'") == ["a"] and text_of("<p>a</p><style>p {}</sty") == ["a"]
    assert text_of("<p>a</p><script>1</scripts>2</script ><p>b</p>") == ["a", "b"]


def test_broken_tags_are_text():
    assert text_of("<p>a < b and c > d <3") == ["a < b and c > d <3"]
    assert text_of("<p title='x > y'>one</p><p title=\"it's\">two</p>") == ["one", "two"]
    assert text_of("<p class=\"open>one</p><p>two</p>") == ["one", "two"]
    assert text_of("text <a href=") == ["text <a href="] and text_of("a<!-- b") == ["a"] and text_of("a<!doctype x>b<?y?>c") == ["abc"]


@pytest.mark.parametrize("piece", ["<a ", "<a b=\"", "<a b='", "<p ", "</", "</p", "<object>", "</object ", "<script", "<div>", "<div></section>", "<form>", "<!--", "<!",
                                   "<a \"> \" ", "<li>", "<svg><p>", "<b class=ad>", "&amp", "<span class=ad></b>"])
def test_time_follows_the_page(piece):
    took = []
    for n in (4000, 16000):
        t = time.perf_counter()
        hx.blocks(piece * n + "<h1>end")
        took.append(time.perf_counter() - t)
    assert took[1] < 8 * took[0] + .25, took
