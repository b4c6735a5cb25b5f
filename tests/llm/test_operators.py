"""The operators on small tables with every awkward row, against plain Python or the libraries."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from acopio.llm import (bpe, exact_search, html_extract, line_dedup, mixing, pii, quality, simhash, token_counts,
                        url_filters)
from acopio.llm.graph import components
from acopio.llm.queries import ORACLE, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word " * 30_000 + "é" * 5000
DOCS = "doc_id bigint, text string, source string, lang string, n_chars bigint, fp string, row string, mask int"
TEXTS = [(1, None, None), (2, "", "a"), (3, "  \n\t ", "b"), (4, "Same line here that has more than forty code points.\nx", "a"),
         (4, "Same line here that has more than forty code points.\nx", "a"), (None, "no id\n" + "z" * 50, None), (5, LONG, "b"),
         (6, "Tie a b c d", "c"), (7, "tie A b C d", "c"), (8, "mail me.x@ex.com or +1 (243) 555-5526, 10.0.0.300 or 10.0.0.30 now", "c")]
TEXTS += [(10 + i, "\tSAME line here that has more than forty code points. \nown line %d" % i, "abc"[i % 3]) for i in range(5)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, "en", 0, "clash", "clash", 1) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, DOCS).cache()


def split(text):
    return WORD.findall(text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n != "pipeline"))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


def test_fingerprints_and_components(docs):
    def brute(t):
        w = split(low(t))
        grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    want = [(i, brute(t)) for i, t, _ in TEXTS]
    least = {}
    for i, f in want:
        for j, g in want:
            if j is not None and bin(f ^ g).count("1") <= 2:
                least[(i, f)] = min(least.get((i, f), 1 << 60), j)
    assert Counter(got) == Counter((i, format(f, "016x"), least.get((i, f))) for i, f in want)


@pytest.mark.parametrize("leaf", [8, 4096])
def test_trie_join_finds_what_all_pairs_find(spark, leaf):
    rng, prints = random.Random(4), set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(x - (x >> 63 << 64) for x in prints)
    root = {x: x for x in prints}
    for _ in prints:
        new = {x: min(root[y] for y in prints if bin((x ^ y) & (1 << 64) - 1).count("1") <= 2) for x in prints}
        if new == root:
            break
        root = new
    df = spark.createDataFrame([(x,) for x in prints], "fp bigint")
    got = {r.node: r.root for r in components(simhash.links(df, 2, leaf)).collect()}
    assert {x: got.get(x, x) for x in prints} == root


def test_components_of_a_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components(edges).collect()} == {0}


def test_mix(docs):
    rows = mixing.plan(docs).collect()
    size = defaultdict(int)
    for r in rows:
        assert r.mix_size == len(split(r.text)) and 0 <= r.mix_taken <= 2 * r.mix_size
        size[r.source] += r.mix_size
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(size), 1.5 * sum(size.values())
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    target |= share
    taken = defaultdict(int)
    for r in rows:
        assert r.mix_target == pytest.approx(target[r.source]) and r.mix_source_size == size[r.source]
        taken[r.source] += r.mix_taken
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in size)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan(docs.repartition(3)).collect()))
    mixed = mixing.mixed_texts(mixing.plan(docs)).collect()
    assert sum(len(split(r.text)) for r in mixed) == sum(r.mix_taken for r in rows)


def test_apportionment_by_highest_quotients(spark):
    votes = [100.0, 5.0, 5.0, 0.0, 10.5, 1.0, 5.0]
    df = spark.createDataFrame(list(enumerate(votes)), "party int, votes double")
    for seats in (0, 1, 3, 50):
        best = sorted((-v / (k - .5), i) for i, v in enumerate(votes) if v for k in range(1, seats + 1))[:seats]
        got = {r.party: r.seats for r in mixing.apportion(df, seats).collect()}
        assert got == {i: sum(j == i for _, j in best) for i in range(len(votes))}


def test_tokens_as_the_library_counts_them(spark, docs):
    lib = Tokenizer.from_file(token_counts.byte_vocabulary())
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "é", "'s", "'ll", "12", "!", "...", "<|endoftext|>", "\xa0", "日本", "😀", "\u0301", "\x1c", "\r\n"]
    more = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = docs.select("doc_id", "text", "fp").union(spark.createDataFrame([(i, t, "") for i, t in enumerate(more)], "a bigint, b string, c string"))
    got = Counter(tuple(r) for r in token_counts.count_tokens(df, token_counts.byte_vocabulary()).collect())
    want = Counter()
    for i, t in [(i, t or "") for i, t, _ in TEXTS] + list(enumerate(more)):
        n = len(lib.encode(t, add_special_tokens=False).ids)
        want[(i, len(t.encode()), n, n > 512)] += 1
    assert got == want


def test_encoding_and_decoding_as_the_library(spark, docs):
    path = bpe.word_vocabulary()
    lib, rng = Tokenizer.from_file(path), random.Random(3)
    more = ["".join(rng.choice("aeithnsor") for _ in range(n)) for n in (700, 3000)] + ["a" * 2000, "ǅ Σς ẞ İ <|endoftext|>x\xa0y\x1cz e\u0301", "\x85\u3000"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(more)), "a bigint, b string"))
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.round_trip(df, path).collect())
    want = Counter()
    for i, t in [(i, t or "") for i, t, _ in TEXTS] + list(enumerate(more)):
        ids = lib.encode(t, add_special_tokens=False).ids
        want[(i, tuple(ids), lib.decode(ids, skip_special_tokens=False))] += 1
    assert got == want


def test_stream_of_a_long_run_is_the_whole_runs_encoding():
    merges = bpe.codec(bpe.word_vocabulary()).merges
    run = "".join(random.Random(5).choice("thereing") for _ in range(5000))
    whole = merges._merge([*run[:-1], run[-1] + merges.suffix])
    assert list(merges.tokens(run)) == whole and merges.proper and len(run) > merges.lookahead


def test_byte_level_decoding_holds_back_unfinished_characters():
    path = token_counts.byte_vocabulary()
    lib, c = Tokenizer.from_file(path), bpe.Codec(path)
    ids = lib.encode("日本 😀 é<|endoftext|>", add_special_tokens=False).ids
    assert "".join(c.decode(ids)) == lib.decode(ids, skip_special_tokens=False)
    assert "�" not in "".join(c.decode(ids))


def test_quality_counts(docs):
    for r in quality.judge(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        w = split(r.text)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i:i + 3])].append(i)
        repeat = {p for v in at.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
        lines = [x for x in (r.text or "").split("\n") if split(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(repeat))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))


def test_quality_lines(spark):
    prose = "This is a plain sentence with quite a few words in it, which nobody should lose.\n"
    bad = ["home | news | sport | mail | more", "BUY!! NOW!! BEST!! PRICE!!", "ja ja ja ja ja ja ja", "we use cookies on this site"]
    rng = random.Random(6)
    body = "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(9)) + "." for _ in range(12))
    rows = [(1, prose + body + "\n" + bad[0]), (2, "\n".join(bad * 20)), (3, body)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].kept and got[1].clean_text == prose + body and not got[2].kept and got[3].kept and got[3].lost_words == 0


def clean_by_hand(rows, least=5):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 40:
                held[key(x)].add(i)
    gone = lambda i, x: len(held[key(x)]) >= least and i != max(held[key(x)])
    return Counter((i, "\n".join(x for x in (t or "").split("\n") if not gone(i, x))) for i, t in rows)


def test_line_dedup_and_taking_it_back(docs):
    rows = [(i, t) for i, t, _ in TEXTS]
    got = line_dedup.dedup(docs)
    assert got.columns == [*docs.columns, "kept_text", "n_dropped"]
    assert Counter((r.doc_id, r.kept_text) for r in got.collect()) == clean_by_hand(rows)
    index = line_dedup.empty_index(docs.sparkSession).insert(docs)
    later = index.delete(docs.where("doc_id >= 13"))
    left = [(i, t) for i, t in rows if i is None or i < 13]
    rest = docs.where("doc_id < 13 OR doc_id IS NULL")
    assert Counter((r.doc_id, r.kept_text) for r in later.clean(rest).collect()) == clean_by_hand(left)
    again = later.insert(docs.where("doc_id >= 13"))
    assert Counter((r.doc_id, r.kept_text) for r in again.clean(docs).collect()) == clean_by_hand(rows)


def test_cuckoo_filter_holds_what_it_was_given():
    rng = random.Random(1)
    places = [(rng.randint(1, 65535), rng.getrandbits(31)) for _ in range(5000)]
    c = line_dedup.build(places)
    assert all(c.holds(*p) for p in places)
    assert all(c.remove(*p) for p in places[:2500]) and all(c.holds(*p) for p in places[2500:])
    assert sum(c.holds(rng.randint(1, 65535), rng.getrandbits(31)) for _ in range(5000)) < 50


def test_personal_data(docs):
    got = {r.doc_id: r for r in pii.find(docs.where("doc_id = 8")).collect()}
    text = TEXTS[9][1]
    assert [text[s["start"]:s["end"]] for s in got[8].spans] == ["me.x@ex.com", "+1 (243) 555-5526", "10.0.0.30"]
    for t in ("a@b@c.de", "x@y", "4111 1111 1111 1111", "4111 1111 1111 1112", "1.2.3.4.5.6.7.8", "999.1.1.1", "+1-2", "a.b@c.d.e. é@x.yz"):
        mail = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
        spans = pii.base_spans(t)
        assert [[(a, b) for a, k, b in spans if k == n] for n in range(3)] == [mail, ip, card]


def test_terms_that_reveal(spark):
    rows = [(i, f"Item {w} saw Quixotl near the {w} of jane@corp.org and {w} left again today") for i, w in enumerate(("apple", "berry", "cedar", "daisy", "elder"))]
    rows += [(100 + i, f"the and left again today of near item saw {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    words = {rows[0][1][s["start"]:s["end"]].lower() for s in got[0].terms}
    assert "quixotl" in words and not words & {"the", "and", "again", "apple"} and got[100].terms == []
    clean = pii.find(df).where("doc_id = 0").select(pii.sanitise(F.col("text"), F.col("spans"), F.col("terms"))).first()[0]
    assert "Quixotl" not in clean and "[email]" in clean


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div>
<article><h1>Head &amp; more</h1><p>One<br>two <b>three</p><p>Four<p>Five<script>x()</script></p><div class="comments">hm</div>
<form>f</form></article><footer>foot</footer></body></html>"""


def test_html(spark):
    site = "<p>Shared top line</p><div>%s</div><p>Shared end</p>"
    rows = [(1, "http://a.b/x/1", PAGE), (2, None, None), (3, "http://c.d/x/1", site % "mine"), (4, "http://c.d/x/2", site % "yours"),
            (5, "http://e.f/", "<p>alone &lt;b&gt; a < b"), (1, "http://a.b/x/1", PAGE), (None, "nourl", "<main>m<span class=ad>no</span> n</main>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("at", F.lit(1))
    got = Counter((r.page_id, r.text) for r in html_extract.extract(df).collect())
    assert got == Counter([(1, "Head & more\n\nOne two three\n\nFour\n\nFive")] * 2 + [(2, ""), (3, "mine"), (4, "yours"), (5, "alone <b> a < b"), (None, "m\n\nn")])


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(7)
    for _ in range(60):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        flags = html_extract.shared(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
        it = iter(b)
        assert flags.sum() == best[-1][-1] and all(any(x == y for y in it) for x in np.array(a)[flags])


def test_exact_search(spark):
    rng = np.random.default_rng(3)
    data = rng.integers(-3, 4, (300, 4)).astype(float)
    rows = [(i, list(map(float, v)), "c") for i, v in enumerate(data)]
    rows += [(i + 400, rows[5][1], "c") for i in range(30)] + [(40, rows[40][1], "c"), (900, None, "c"), (901, [1.0, None, 2.0, 3.0], "c"),
                                                             (902, [float("nan")] * 4, "c"), (903, [float("inf")] * 4, "c"), (None, [1.0] * 4, "c"), (920, [], "c")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, leaf string")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in exact_search.top_k(exact_search.scaled(df), F.col("vec_id") % 20 == 0).collect()}
    sound = {i: np.floor(64 * np.array(v)).astype(int) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in sound if i % 20 == 0):
        best = sorted((-int(sound[q] @ v), i) for i, v in sound.items() if i != q)[:20]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert got == want


def test_urls(spark):
    urls = ["http://a.COM/x?q", "https://example.com/en/1", "https://www.example.com/en/1", "https://m.example.com/en/1#t", "http://x.net/es/",
            "http://x.net/de/", "http://examplecom/en/", None, "nothing", "x://y.org/a://b", "http://h.net?x", "http://spam.org/a"]
    want = [("a.com", "/x", "com/", "allow"), ("example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
            ("m.example.com", "/en/1", "example.com/en/", "block"), ("x.net", "/es/", "net/es/", "block"), ("x.net", "/de/", None, "allow"),
            ("examplecom", "/en/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("y.org", "/a://b", None, "allow"), ("h.net", "", None, "allow"),
            ("spam.org", "/a", None, "allow")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("tokens", F.lit(1))
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, labels).collect()}
    assert got == dict(enumerate(want))


def test_mined_rules(spark):
    rows = [(i, f"http://{'spam' if i % 3 == 0 else 'good'}{i % 7}.org/{'win' if i % 3 == 0 else 'news'}/{i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1, None) for i in range(200)] + [(None, 0, 0), (1, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_filters.judge(pages, labels).collect()}
    assert got == {i: "block" if i % 3 == 0 else "allow" for i in range(300)}


def test_queries_match_their_sql(spark):
    import duckdb

    from tools.check import rows_of
    con, base = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    for name, sql in ORACLE.items():
        df, res = QUERIES[name](spark, base), con.execute(sql)
        cols = [d[0] for d in res.description]
        assert sorted(cols) == sorted(df.columns)
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall()), name


def test_pipeline_against_plain_python(spark):
    base = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{base}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, rows, base).cache()
    judged = {r.doc_id: r.clean_text for r in quality.judge(rows).where("kept").collect()}
    assert {r.doc_id: r.text for r in kept.collect()} == judged and kept.columns == rows.columns
    lines = corpus_pipeline.line_dedup_stage(spark, kept, base).cache()
    want = Counter({k: n for k, n in clean_by_hand([(i, t) for i, t in judged.items()]).items() if split(k[1])})
    assert Counter((r.doc_id, r.text) for r in lines.collect()) == want
    near = corpus_pipeline.near_dedup(spark, lines, base).cache()
    firsts = {r.component_id for r in simhash.near_duplicates(lines).collect()}
    assert sorted(r.doc_id for r in near.collect()) == sorted(firsts)
    mix = corpus_pipeline.source_mix(spark, near, base).cache()
    have = {r.doc_id: r.text for r in near.collect()}
    plan = mixing.plan(near, block=corpus_pipeline.MIX_BLOCK).collect()
    n = Counter()
    for r in mix.collect():
        n[r.doc_id] += len(split(r.text))
        assert all(run in have[r.doc_id] for run in r.text.split("\n"))
    assert n == Counter({r.doc_id: r.mix_taken for r in plan if r.mix_taken})
    lib = Tokenizer.from_file(bpe.word_vocabulary())
    for r in corpus_pipeline.encode(spark, mix.limit(40), base).collect():
        assert r.decoded == lib.decode(list(r.ids), skip_special_tokens=False)


def test_digests(docs):
    r = bpe.digests(bpe.round_trip(docs.where("doc_id = 2"), bpe.word_vocabulary())).first()
    assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())
