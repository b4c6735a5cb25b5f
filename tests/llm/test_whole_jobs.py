"""Cases in which an operator once did less than its whole job."""

import random
import re
from collections import defaultdict
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from acopio.llm import html_extract, quality, simhash, url_filters


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def kept_by_hand(rows, bits=2):
    """The rows (doc_id, text, ...) that stay, each group's smallest ids only; all candidates of a tie."""
    prints = [plain_print(r[1]) for r in rows]
    known = sorted(set(prints))
    root = {p: p for p in known}
    for _ in known:
        new = {p: min(root[q] for q in known if bin(p ^ q).count("1") <= bits) for p in known}
        if new == root:
            break
        root = new
    groups = defaultdict(list)
    for r, p in zip(rows, prints):
        groups[root[p]].append(r)
    least = lambda g: min(((r[0] is None, r[0] or 0) for r in g))
    return [{r for r in g if (r[0] is None, r[0] or 0) == least(g)} for g in groups.values()]


def stays(got, groups):
    """Exactly one of each group's candidates is in ``got``."""
    return len(got) == len(groups) and all(sum(r in g for r in got) == 1 for g in groups)


def test_rows_that_share_an_id_are_judged_each(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 40
    rows = [(1, "one two three four", "u"), (1, "entirely other words stand here", "v"), (1, "one two three four", "u"), (2, "One two THREE four", "w"),
            (None, "no id here at all", None), (None, None, "x"), (5, "", "y"), (5, " \n", "y"), (7, near + "end", None), (6, near + "End", None), (8, "one two three four", "u")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row_1 string").selectExpr("*", "row_1 AS fp", "doc_id AS root", "text AS row")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    got = [tuple(r)[:3] for r in got.collect()]
    assert stays(got, kept_by_hand(rows)) and {(1, "entirely other words stand here", "v"), (6, near + "End", None)} <= set(got)
    assert len([r for r in got if r[0] == 1]) == 2
    assert simhash.one_of_each(df.limit(0)).collect() == []


def test_pipeline_stage_keeps_one_of_each_group(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    near = corpus_pipeline.near_dedup(spark, docs, "")
    assert near.columns == docs.columns
    assert stays([tuple(r) for r in near.collect()], kept_by_hand([tuple(r) for r in docs.collect()]))


def test_pipeline_on_awkward_rows_and_none(spark, tmp_path):
    body = "\n".join(f"Line{i} tells of river{i} and mountain{i} with {i} boats under bridge{i} on a day{i} in spring{i}." for i in range(12))
    rows = [(1, body, "en", "a", 5), (1, body.replace("river", "lakes and longer rivers").replace("boats", "carts"), "en", "a", 5), (None, body.replace("mountain", "hill").replace("bridge", "old bridge"), None, None, None),
            (2, None, None, "b", 0), (3, "", "en", None, 0), (4, body, "en", "a", 5), (4, body, "en", "a", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("ids", F.lit("clash"))
    for name, table in (("some", df), ("none", df.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert got.columns == ["doc_id", "ids", "decoded"]
        assert (got.count() > 0) == (name == "some") and got.where("size(ids) = 0").isEmpty()
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, df, "").columns == corpus_pipeline.COLUMNS


def text_of(page):
    found = html_extract.blocks(page)
    least = 1 if any(r > 0 for r, _ in found) else 0
    return [t for r, t in found if r >= least]


def test_wrappers_do_not_take_the_article_away():
    body = "<article><h1>Head</h1><p>One two three</p></article>"
    assert text_of(f"<form action=x><nav>n</nav>{body}<input></form>") == ["Head", "One two three"]
    assert text_of("<body><form><div class=menu>m</div><h1>Head</h1><p>One</p></form></body>") == ["Head", "One"]
    for wrapper in ("layout has-sidebar", "page sidebar", "banner"):
        assert text_of(f"<div class='{wrapper}'>{body}<div class=ads>x</div></div>") == ["Head", "One two three"]
    assert text_of("<article><div class='article-header'><h1>Head</h1></div><p>One</p></article>") == ["Head", "One"]
    assert text_of("<p>a <svg class='x'/>b</p><p>c</p><svg><text>no</text></svg>d") == ["a b", "c", "d"]
    # what stays beside: teasers next to an article or to more text, search forms, hidden parts
    assert text_of(f"{body}<div class=related><article>Other</article></div>") == ["Head", "One two three"]
    assert text_of("<p>plain text of the page</p><div class=related><article>Other</article></div>") == ["plain text of the page"]
    assert text_of("<h1>Head</h1><form>search <input></form><div style='display:none'><article>no</article></div>") == ["Head"]


def extracted(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id bigint, url string, html string")
    return [r.text for r in html_extract.extract(df).orderBy("page_id").collect()]


def prose(name, n=12):
    return "".join(f"<p>{name} line {i} tells {name}{i} about {i}{name}.</p>" for i in range(n))


def test_copied_pages_keep_their_article(spark):
    top, end = "<div>Welcome to our site</div>", "<div>All about us</div>"
    page = lambda body: top + body + end
    rows = [("http://a.b/news/1?q=%d" % k, page(prose("x"))) for k in range(3)] + [("http://a.b/news/1b", page(prose("x") + "<p>Printed today.</p>"))]
    rows += [("http://a.b/news/2", page(prose("y"))), ("http://c.d/1", page(prose("z"))), ("http://c.d/2", page(prose("z")))]
    got = extracted(spark, rows)
    assert all("Welcome" not in t and len(t.split("\n\n")) == 12 for t in got[:3]) and "Printed today." in got[3] and "x line 11" in got[3]
    assert "y line 0" in got[4] and "Welcome" not in got[4]
    assert "z line 3" in got[5] and got[5] == got[6]


def test_what_stands_in_every_article_of_a_host_is_the_sites(spark):
    notice = "<p>Order our letter for ten a year.</p>"
    rows = [(f"http://a.b/{k}", f"<article>{notice}{prose('abcdef'[k])}{'<p>A quote of two.</p>' if k < 2 else ''}</article>") for k in range(6)]
    rows += [("http://c.d/1", f"<article>{notice}{prose('k')}</article>"), ("http://c.d/2", f"<article>{notice}{prose('m')}</article>")]
    got = extracted(spark, rows)
    assert all("letter" not in t and "line 11" in t for t in got[:6]) and "A quote of two." in got[0] and "A quote of two." in got[1]
    assert all("letter" in t for t in got[6:])      # two pages are no sign of a site


def test_ten_blocked_urls_bear_a_rule_out_in_a_large_table_too(spark):
    rows = [(i, f"http://{'bad.org' if i < 12 else 'good%d.org' % (i % 50)}/p{i % 9}/{i}") for i in range(6000)]
    labels = spark.createDataFrame([(i, int(i >= 10), 0) for i in range(6000) if i not in (10, 11)], "doc_id bigint, quality int, toxic int")
    got = url_filters.judge(spark.createDataFrame(rows, "page_id bigint, url string"), labels)
    assert [r.page_id for r in got.where("verdict = 'block'").orderBy("page_id").collect()] == list(range(12))


def test_rules_of_any_length_as_brute_force(spark):
    rng = random.Random(8)
    baskets = []
    for _ in range(1200):
        tokens = sorted(x for x in "abcdef" if rng.random() < .6)
        if tokens:
            baskets.append((tokens + ["x", "y"], set("abcd") <= set(tokens) or rng.random() < .3))
    count, hit = defaultdict(int), defaultdict(int)
    for tokens, blocked in baskets:
        for k in range(1, len(tokens) + 1):
            for c in combinations(tokens, k):
                count[c] += 1
                hit[c] += blocked
    conf = {c: hit[c] / count[c] for c in count if hit[c] >= 10}
    want = {c: hit[c] for c, v in conf.items() if v >= .6 and not any(conf[p] >= v for k in range(1, len(c)) for p in combinations(c, k))}
    got = url_filters.mine_rules(spark.createDataFrame(baskets, "tokens array<string>, blocked boolean")).collect()
    assert {tuple(r.tokens): r.support for r in got} == want and ("a", "b", "c", "d") in want


def plain_rules(baskets, least=10, confidence=.6):
    """token set -> (support, confidence) of the rules no part of which says as much; equal tokens count as the first."""
    at = defaultdict(set)
    for i, (tokens, _) in enumerate(baskets):
        for t in tokens:
            at[t].add(i)
    named = {}
    for t in sorted(at):
        named.setdefault(frozenset(at[t]), t)
    kinds = set(named.values())
    count, hit = defaultdict(int), defaultdict(int)
    for tokens, blocked in baskets:
        own = sorted(set(tokens) & kinds)
        for k in range(1, len(own) + 1):
            for c in combinations(own, k):
                count[c] += 1
                hit[c] += blocked
    conf = {c: hit[c] / count[c] for c in count if hit[c] >= least}
    return {c: (hit[c], v) for c, v in conf.items() if v >= confidence and not any(conf[p] >= v for k in range(1, len(c)) for p in combinations(c, k))}


def test_fp_growth_and_level_by_level_give_the_plain_rules(spark):
    rng = random.Random(3)
    baskets = []
    for i in range(900):
        host = rng.choice(["bad", "good", "mixed"])
        tokens = sorted({f"domain:{host}.org", f"host:{host}", "domain:org", *(f"path:{x}" for x in "uvwxyz" if rng.random() < .35)})
        baskets.append((tokens, (host == "bad" and rng.random() < .9) or (host == "mixed" and {"path:u", "path:v"} <= set(tokens)) or rng.random() < .05))
    baskets += [(["only", "pair"], True)] * 40 + [(["few"], True)] * 9
    df = spark.createDataFrame(baskets, "tokens array<string>, blocked boolean")
    want = plain_rules(baskets)
    for wide in (14, 1):
        got = url_filters.mine_rules(df, url_filters.Mining(wide=wide)).collect()
        assert {tuple(r.tokens): (r.support, r.confidence) for r in got} == want, wide
    assert ("only",) in want and ("domain:bad.org",) in want and any(len(c) == 3 for c in want)
    assert url_filters.mine_rules(df.where("NOT blocked")).collect() == [] == url_filters.mine_rules(df.limit(0)).collect()


def test_verdicts_as_plain_matching(spark):
    """Every page against every plain rule, hot hosts and repeated rows included."""
    rng = random.Random(12)
    urls = [None, "nourl", "http://", "http://a.com/x", "HTTP://Net/es/1"]
    for i in range(700):
        host = rng.choice(["spam.org", "spam.org", "www.fine.net", "news.example.com", "x.example.com", "shop.info"])
        urls.append(f"http://{host}/{rng.choice(['en', 'es', 'fr', 'win'])}/{rng.choice(['win', 'read', 'cash'])}/{i % 40}")
    urls += urls[5:60]
    pages = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(urls)], "page_id bigint, url string, tokens string, mined string")
    labels = [(i, int(not ("spam" in u or "cash" in u)), rng.choice([0, None])) for i, u in enumerate(urls) if u and i % 3 and i < 600]
    got = {r.page_id: r for r in url_filters.judge(pages, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}

    def host_path(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        return (m[1].lower(), m[2]) if m else ("", "")

    def tokens(u):
        host, path = host_path(u)
        names = [x for x in host.split(".") if x]
        out = {"domain:" + ".".join(names[i:]) for i in range(len(names))} | {f"host:{x}" for x in names}
        return out | {"path:" + ("#" if x.isdigit() and x.isascii() else x) for x in re.split(r"[/._\-=&+~]+", path.lower()) if x}
    rules = plain_rules([(sorted(tokens(urls[i])), not q) for i, q, _ in labels if tokens(urls[i])])
    assert len(rules) > 1
    for i, u in enumerate(urls):
        host, path = host_path(u)
        fits = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if any(set(c) <= tokens(u) for c in rules) else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
    assert {r.verdict for r in got.values() if r.rule is None} == {"allow", "block"}


def test_quality_rules_by_class(spark):
    gone = ["??? ~~~ === ---", "Home · News · Sport · Weather", "a / b / c / d", "Home - News - Sport - Weather", "one › two › three", "WIN!! BIG!! CASH!!",
            "why?? how?? when??", "w^^ x~~ y==", "a~b~c~d~e~f~g", "★★★ ★★ deal ★★★", "==========", "Home\nNews\nSport\nWeather", "Home\nAll news\nOur best sport\nWeather\nShop"]
    stays = ["He said: “Stop!” – and then, they left (quickly).", "word – another word – more here it goes", "Call +1 (243) 555-5526 or 10.0.0.30 now", "A.", "Í.",
             "Home\nNews\nSport", "Home.\nNews.\nSport.\nWeather.", "Home\nNews\n\nSport\nWeather", "Is it so?! Yes, it is.", "", "  ", "The sum x = y holds for every z that we tried here."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(gone + stays)], "doc_id bigint, text string")
    left = {r.doc_id: r.clean_text for r in quality.judge_rows(df).collect()}
    assert [left[i] for i in range(len(gone))] == [""] * len(gone)
    assert [left[len(gone) + i] for i in range(len(stays))] == stays


def test_runs_of_flags(spark):
    rng = random.Random(2)
    rows = [[rng.random() < .7 for _ in range(rng.randrange(0, 30))] for _ in range(200)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, f array<boolean>")
    got = {r.i: r.g for r in df.select("i", quality.in_runs(F.col("f"), 4).alias("g")).collect()}
    for i, r in enumerate(rows):
        want, at = [], 0
        while at < len(r):
            end = at
            while end < len(r) and r[end] == r[at]:
                end += 1
            want += [r[at] and end - at >= 4] * (end - at)
            at = end
        assert got[i] == want
