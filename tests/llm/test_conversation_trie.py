"""The conversation trie against plain prefixes of plain lists, and the double arrays against sets."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from acopio.llm import conversation_trie as ct

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth bigint, n string, k1 string, at string, up int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes, kids = defaultdict(list), defaultdict(set)
    for c, s in made.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
            if d:
                kids[s[:d - 1]].add(s[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in nodes:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(made[c]) == len(p)).encode()).hexdigest())
                  for p, cs in nodes.items())


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", "x", "x", 2) for r in rows], SCHEMA).repartition(5)
    got = ct.trie(df, **options)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()))


def conversations(n, rng, long=()):
    rows = []
    for c in range(n):
        if rng.random() < .1:
            continue
        size = long[c] if c < len(long) else rng.randrange(1, 12)
        for turn in range(size):
            text = rng.choice(["a", "b"]) if rng.random() < .5 else "hello" if turn < 2 else "é%d" % rng.randrange(5)
            rows.append((c - 7, turn, rng.choice(["user", "user", None]), text))
    # copies, nulls, ties, repeated rows, turnless ones
    rows += [(1000 + c, t, "user", f"copy {t}") for c in range(60) for t in range(14)]
    rows += [(2001, None, None, None), (2001, None, "r", None), (2001, 3, "b", "z"), (2001, 3, "b", "a"), (2001, 3, "b", "a"), (None, 0, "user", "lost")]
    rows += [(c, 0, "user", "alone") for c in range(3001, 3040, 3)]
    return rows


@pytest.mark.parametrize("segment,shard", [(256, 40), (6, 25)])
def test_every_node_as_plain_prefixes(spark, monkeypatch, segment, shard):
    monkeypatch.setattr(ct, "SEGMENT", segment)
    rows = conversations(150, random.Random(segment + shard), long=(20, 1, 17, 19))
    assert run(spark, rows, shard=shard) == brute(rows)


def test_a_hot_conversation_and_small_tables(spark, monkeypatch):
    monkeypatch.setattr(ct, "SEGMENT", 256)
    rows = [(5, t, "user", f"turn {t % 7}") for t in range(500)] + [(6, t, "user", f"turn {t % 7}") for t in range(300)] + [(7, 0, None, "x")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[-1:]) == brute(rows[-1:])
    assert run(spark, [(None, 1, "a", "b")]) == [] and run(spark, []) == []


def test_double_arrays_hold_exactly_their_sequences():
    rng = np.random.default_rng(1)
    for width, n in ((3, 200), (50, 400), (4000, 4000)):
        seqs = sorted({tuple(rng.integers(0, width, rng.integers(1, 9)).tolist()) for _ in range(n)}, key=lambda s: -len(s))
        steps = [np.array([s[d] for s in seqs if len(s) > d], dtype=np.int64) for d in range(len(seqs[0]))]
        trie = ct.DoubleArray.of(steps)
        prefixes = {s[:d] for s in seqs for d in range(1, len(s) + 1)}
        assert sum(c >= 0 for c in trie.check) == len(prefixes)
        seen = set()
        for s in seqs:
            state = 0
            for d, c in enumerate(s):
                then = trie.base[state] + c
                assert trie.check[then] == state
                state = then
                seen.add((s[:d + 1], state))
        assert len(seen) == len({x for _, x in seen}) == len(prefixes)
