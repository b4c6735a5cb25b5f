"""Sketches against plain multisets of passages."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

from acopio.llm import doc_sketch
from acopio.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, n_chars bigint, fingerprint string, part int, kind int, h string, row string"


def passages(text):
    return Counter(re.findall(r"[^.!?\n]+[.!?\n ]*|[.!?\n ]+", text))


def jaccard(a, b):
    a, b = passages(a), passages(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def brute(rows):
    """In order of the rows as given."""
    out = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        k = len(t) // 2
        e = t[:len(t) - k] + u[:k]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), jaccard(t, e), jaccard(t, u), e))
    return out


def got(df):
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in doc_sketch.versions(df).collect()]


def documents(n=240):
    rng = random.Random(4)
    out = []
    for i in range(n):
        kind = rng.randrange(8)
        if kind == 0:
            t = rng.choice(["", None, "\n", ".", "é", "one", "no end\n\n", "?!? "])
        elif kind == 1 and out:
            t = out[-1][1]
        elif kind == 2:
            t = "Same. " * rng.randrange(1, 90) + "Other.\n" * rng.randrange(4)
        else:
            t = "".join("w%d é漢😀%s" % (rng.randrange(30), rng.choice([". ", "\n", "! ", ", ", "..\n"])) for _ in range(rng.randrange(1, 80)))
        out.append((i * 3 - 20, t))
    return out


def test_rows_as_brute_force(spark):
    rows = documents()
    rows.insert(100, (rows[99][0] + 1, "".join(f"Line {i} of it.\n" for i in range(20_000))))
    df = spark.createDataFrame([(i, t, 1, "clash", 2, 3, "clash", "clash") for i, t in rows], SCHEMA).repartition(7)
    want = [r[:5] for r in brute(rows)]
    assert sorted(got(df)) == sorted(want)


def test_repeated_rows_null_ids_and_small_tables(spark):
    same = [(None, "no id. at all\n"), (1, "a. b. c"), (1, "a. b. c"), (1, "a. b. c"), (2, None), (3, "")]
    df = spark.createDataFrame([(i, t, 1, "x", 2, 3, "x", "x") for i, t in same], SCHEMA)
    key = lambda r: (r[0] is not None, *r[:1], *r[1:])
    assert sorted(got(df), key=key) == sorted((r[:5] for r in brute(same)), key=key)
    assert got(df.where("doc_id = 2")) == [(2, 0, hashlib.sha256(b"").hexdigest(), 1.0, 1.0)]
    assert got(df.limit(0)) == []


def test_fingerprints_of_equal_and_edited_texts(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string")
    texts = {i: t or "" for i, t in rows}
    change = {r[0]: r[5] for r in brute(rows)}
    made = doc_sketch.versions(df).collect()
    alone = {r.doc_id: r.f.hex() for r in df.select("doc_id", doc_sketch.fingerprint(doc_sketch.F.col("text")).alias("f")).collect()}
    first = {}
    for r in made:
        assert r.fingerprint == alone[r.doc_id]
        for t, f in ((texts[r.doc_id], r.fingerprint), (change[r.doc_id], r.edited_fingerprint)):
            assert first.setdefault(t, f) == f and int(f[:8], 16) == sum(passages(t).values())
    assert len(set(first.values())) == len({frozenset(passages(t).items()) for t in first})


def test_peeling_recovers_the_differing_hashes(spark):
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 1, 5, 40, 3000)]
    extra = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (3, 0, 2, 700, 1)]
    a, b = sets, [np.concatenate([s[len(s) // 3:], x]) for s, x in zip(sets, extra)]
    found = Counter()
    for owner, h, sign in doc_sketch.differing(a, b):
        found.update(zip(owner.tolist(), h.tolist(), sign.tolist()))
    want = Counter((i, int(h), 1) for i, s in enumerate(sets) for h in s[:len(s) // 3]) + Counter((i, int(h), -1) for i, x in enumerate(extra) for h in x)
    assert found == want
    # a fingerprint alone gives small differences away, a large one not
    left = doc_sketch.Cells.of(a, doc_sketch.CELLS).minus(doc_sketch.Cells.of(b, doc_sketch.CELLS))
    assert doc_sketch.peel(left)[3].tolist() == [True, True, True, False, False]
    df = spark.createDataFrame([("A. B. C.\nA. ", "A. C.\nD"), (None, "x")], "a string, b string")
    got = df.select(doc_sketch.recovered(doc_sketch.F.col("a"), doc_sketch.F.col("b")).alias("r")).select("r.*").collect()
    assert [(len(r.only_a), len(r.only_b)) for r in got] == [(2, 1), (0, 1)]


def test_query_on_a_whole_table(spark):
    base = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").collect())
    made = sorted((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in QUERIES["op12_fingerprints"](spark, base).collect())
    assert made == [r[:5] for r in brute(rows)]
    assert sum(r[3] for r in made) / len(made) > .2 > sum(r[4] for r in made) / len(made)
