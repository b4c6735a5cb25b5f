"""What a task holds in Python: one worker per task, links computed once, texts in slices."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from acopio.llm import graph, line_dedup, mixing, simhash

LINE = "this line stands in very many of the documents here"


def _docs(spark, n):
    rows = [(i, None if i % 97 == 0 else f"own words {i} of a line that is long enough\n{LINE}\nend {i}", "en", "web", 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1), rows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_computes_the_kept_lines_once(spark):
    docs, rows = _docs(spark, 1203)
    out = cp.line_dedup_stage(spark, docs, "")
    assert sum("ArrowEvalPython [kept(" in x for x in _plan(out).split("\n")) == 1
    last = max(r[0] for r in rows if r[1])
    want = {r[0]: r[1] if r[0] == last else r[1].replace(LINE + "\n", "") for r in rows if r[1]}
    assert {r.doc_id: r.text for r in out.collect()} == want


def test_keys_and_copies_of_batches_longer_than_a_slice(spark):
    docs, rows = _docs(spark, 1203)
    keys = {r.doc_id: [bytes(k) for k in r.k] for r in docs.select("doc_id", line_dedup.keys_of(F.col("text")).alias("k")).collect()}
    for i, text, *_ in rows:
        lines = [line_dedup.line_key(x) for x in (text or "").split("\n")]
        assert keys[i] == [line_dedup._digest(k) for k in lines if len(k) >= 40]
    held = docs.selectExpr("doc_id", "text", "CAST(0 AS bigint) AS mix_start", "CAST(1 AS bigint) AS mix_blocks", "CAST(2 AS bigint) AS mix_whole",
                           "CAST(0 AS bigint) AS mix_extra", "CAST(0 AS bigint) AS mix_phase")
    got = sorted(map(tuple, mixing.mixed_texts(held).collect()))
    assert got == sorted((i, text) for i, text, *_ in rows if text for _ in range(2))


@pytest.mark.parametrize("leaf", [4, 2048])
def test_links_are_computed_once(spark, monkeypatch, leaf):
    plans, stage = {}, graph.stage

    def seen(df, label="stage", **more):
        plans.setdefault(label, _plan(df))
        return stage(df, label, **more)

    monkeypatch.setattr(graph, "stage", seen)
    prints = spark.createDataFrame([(x << 20,) for x in (0, 1, 3, 7, 0xFFF0, 0xFFF1)], "fp bigint")
    got = {r.node: r.root for r in graph.components(simhash.links(prints, 2, leaf)).collect()}
    assert got == {x << 20: (0 if x < 8 else 0xFFF0 << 20) for x in (0, 1, 3, 7, 0xFFF0, 0xFFF1)}
    assert plans["edges"].count("FlatMapGroupsInPandas") == 1
