"""Fill-in-middle against a plain loop over lines, and the marked words against plain bytes."""

import hashlib
import random
import re

import numpy as np

from acopio.llm import fill_middle
from acopio.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, n bigint, form string, h1 bigint, digest string, output string"


def brute(doc_id, text, cut=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    hexed = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k:8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= cut:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    rng = random.Random(5)
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "é\nßx", "no <P> here\n", "half <S\nend <", "<\nS>\n<M", "\x8a\x0b\n x\n", "𝄞\n" * 9]
    texts += ["".join(rng.choice("ab\n\né漢😀\r<>PSM\x00\x0b") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["line of some words é\n" * 40_000, "x" * 300_000, "\n" * 100_000]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [(None, "no id\nat all"), (3, "twice\nthe id"), (3, "twice\nthe id"), (-5, "b\nc\nd\ne")]


def test_every_row_as_the_plain_loop(spark):
    df = spark.createDataFrame([(i, t, 1, "clash", 2, "clash", "clash") for i, t in rows()], SCHEMA)
    for rates in (fill_middle.Rates(), fill_middle.Rates(cut=40, spm=20)):
        made = fill_middle.transform(df, rates).withColumn("back", fill_middle.restore(fill_middle.F.col("output"), fill_middle.F.col("form")))
        key = lambda r: tuple((x is not None, x) for x in r)
        got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.collect()), key=key)
        want = sorted(((i, *brute(i, t, rates.cut, rates.spm), t or "") for i, t in rows()), key=key)
        assert got == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_parts_of_a_batch_and_marked_bytes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 256, 5000).astype(np.uint8)
    raw[rng.random(5000) < .3] = 10
    marks = fill_middle.Marks(fill_middle.unit_marks(fill_middle.words_of(raw)))
    at = np.flatnonzero(raw == 10)
    assert (marks.select(np.arange(len(at))) == at).all()
    assert (marks.rank(np.arange(5001)) == np.concatenate([[0], np.cumsum(raw == 10)])).all()
    later = fill_middle.Marks(fill_middle.later_bytes(fill_middle.words_of(raw)))
    assert later.rank(np.array([5000]))[0] == ((raw & 0xC0) == 0x80).sum()


def test_query_on_a_whole_table(spark):
    base = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in QUERIES["op13_fill_middle"](spark, base).collect():
        n, form, p, m, out = brute(r.doc_id, docs[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, p, m, sha(out), sha(docs[r.doc_id] or ""))
