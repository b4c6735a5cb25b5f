"""Personal data and revealing terms against plain regexes and plain counting, over whole results."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from acopio.llm import pii
from acopio.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, spans string, terms string, key string, share int, row string, n string"
TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        total += int(d) if k % 2 == 0 else sum(divmod(int(d) * 2, 10))
    return total % 10 == 0


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return sorted(found)


def plain_terms(text, spans):
    return [m.span() for m in TERM.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b in spans)]


def plain_find(rows, rules=pii.Disclosure()):
    """(doc_id, base spans, term spans) of each row."""
    texts = {t or "" for _, t in rows}
    n, spans = len(texts), {t: plain_spans(t) for t in texts}
    terms = {t: {t[a:b].lower() for a, b in plain_terms(t, spans[t])} for t in texts}
    entities = {t: {(k, t[a:b].lower() if k < 2 else re.sub("[^0-9]", "", t[a:b])) for a, k, b in spans[t]} for t in texts}
    n_term, n_entity, n_both = Counter(), Counter(), Counter()
    for t in texts:
        n_term.update(terms[t])
        n_entity.update(entities[t])
    for t in texts:
        n_both.update((e, w) for e in entities[t] if n_entity[e] >= rules.min_texts for w in terms[t])
    strong = set()
    for (e, w), both in n_both.items():
        info = math.log(n / n_entity[e])
        if both >= rules.min_texts and info > 0:
            if math.log(n * both / (n_entity[e] * (n_term[w] + rules.prior))) / info >= rules.threshold:
                strong.add(w)
    return [(i, spans[t or ""], [(a, b) for a, b in plain_terms(t or "", spans[t or ""]) if (t or "")[a:b].lower() in strong]) for i, t in rows]


def documents(n=260):
    rng = random.Random(6)
    common = ["alpha", "beta", "gamma", "delta", "naïve", "straße", "İzmir", "of", "x1y"]
    people = [(f"p{k}@mail.org", f"Secretname{'abcdef'[k]}") for k in range(5)] + [("+1 (243) 555-5526", "Übername"), ("4111 1111 1111 1111", "Cardholder"), ("10.0.0.30", "Hostname")]
    rows = []
    for i in range(n):
        words = [rng.choice(common) + ("" if rng.random() < .8 else rng.choice("abcdefgh") * 2) for _ in range(rng.randrange(1, 60))]
        if rng.random() < .2:
            entity, name = rng.choice(people)
            words.insert(0, entity)
            words += ["filler"] * rng.randrange(40) + [rng.choice([name, name.upper()])]
        elif rng.random() < .04:
            words.append(rng.choice(people)[1])         # the term without its entity
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(None, None), (2000, ""), (2001, "no@mail, 1.2.3, +12, 4111 1111 1111 1112"), (2002, "a@b@c.de " * 50)]
    return rows + [(2003, "word " * 20_000 + "p0@mail.org " + "Secretnamea")]


def key(r):
    return r[0] is not None, r


@pytest.mark.parametrize("few", [True, False])
def test_every_row_as_plain_counting(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(pii, "fits_broadcast", lambda df: False)
    rows = documents()
    df = spark.createDataFrame([(i, t, "x", "x", "x", 1, "x", "x") for i, t in rows], SCHEMA).repartition(5)
    got = [(r.doc_id, [tuple(s) for s in r.spans], [(s["start"], s["end"]) for s in r.terms]) for r in pii.find(df).collect()]
    want = plain_find(rows)
    assert sorted(((i, [(a, k, b) for a, k, b in s], t) for i, s, t in got), key=key) == sorted(want, key=key)
    assert sum(len(t) for _, _, t in want) > 30
    held = {t.lower() for (i, _, at), (_, text) in zip(want, rows) for t in [text[a:b] for a, b in at]}
    assert "übername" in held and "secretnamea" in held and not held & {"alpha", "filler"}
    assert any(at and not spans for _, spans, at in want)        # marked where the entity is not
    assert pii.find(df.limit(0)).collect() == []


def test_copies_change_nothing(spark):
    rows = [(i, f"case {w} has Quixotl and mail jane@corp.org {w}") for i, w in enumerate(("one", "two", "three", "four"))]
    rows += [(50 + i, f"other text number {i} with has and case") for i in range(80)]
    many = rows + [(500 + i, rows[0][1]) for i in range(200)] + [(900 + i, rows[10][1]) for i in range(300)]
    found = []
    for r in (rows, many):
        got = pii.revealing(spark.createDataFrame(r, "doc_id bigint, text string")).collect()
        found.append(sorted((x.entity, x.term, x.n_entity, x.n_term, x.n_both, x.disclosure) for x in got))
    assert found[0] == found[1] and [x[1] for x in found[0]] == ["mail", "quixotl"]


def test_many_spans_take_time_in_proportion():
    took = []
    for n in (2000, 8000):
        text = "".join(f"user{i}@host.org says something " for i in range(n))
        t = time.perf_counter()
        pii.term_set(text, pii.base_spans(text))
        took.append(time.perf_counter() - t)
    assert took[1] < 10 * took[0] + .2


def test_query_on_a_whole_table(spark):
    base = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    names, want = ("email", "ip", "card", "phone"), {}
    for i, spans, terms in plain_find(rows):
        n = defaultdict(int, Counter(k for _, k, _ in spans))
        listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        every = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted([(a, k, names[k], b) for a, k, b in spans] + [(a, 4, "term", b) for a, b in terms]))
        want[i] = (i, n[0], n[1], n[2], n[3], hashlib.sha256(listed.encode()).hexdigest(), every)
    assert {r.doc_id: tuple(r) for r in QUERIES["op9_pii"](spark, base).collect()} == want
