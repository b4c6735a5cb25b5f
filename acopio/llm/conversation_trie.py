"""The prefix trie of rebuilt conversations, as double arrays per prefix shard.

A conversation is a sequence of turns; equal sequences are kept once, with how many they are. Sequences are cut
into segments of bounded length, and the segments below one prefix are dealt to shards by their first turns: one
turn, or more where very many sequences share it. A task numbers its turns densely, packs its segments into BASE
and CHECK arrays, and walks them through for the aggregates of every node. Nodes above the cut stand in several
shards; their aggregates are merged over all. Deeper segments go first and hand their sums to the node they hang at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.aggregates import number_rows
from ..operators.joins import attach
from ..session import pin, stage
from .common import table
from .registry import query

GROUP, HEADS = 5, 9     # conversations c - c % GROUP lend their first crc32(c) % HEADS turns
SEGMENT = 256           # turns of a segment
SHARD = 100_000         # turns of a shard; more below one prefix are dealt by a longer one
NOBODY = hashlib.sha256(b"").hexdigest()
_KEYS = ("k1", "k2")


# --- conversations as sequences -----------------------------------------------------------------------------

def _numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, k1, k2, size): all turns numbered in order of conversation and turn. Only the texts of turns
    that share their number with another are moved to put them in order."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = ["conv_id", "known", "turn"]
    ties = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*place, F.lit(True).alias("tied"))
    rows = attach(rows, ties, place, "left").select(
        *place, F.when(F.col("tied"), F.col("role")).alias("role"), F.when(F.col("tied"), F.col("text")).alias("text"),
        F.xxhash64(F.lit(1), "role", "text").alias("k1"), F.xxhash64(F.lit(2), "role", "text").alias("k2"),
        F.octet_length("text").cast("bigint").alias("size"))
    return number_rows(rows, [*place, "role", "text", "k1"], "at", 0).select("conv_id", "at", *_KEYS, "size")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, len) of every conversation and (conv_id, pos, k1, k2, size) of its rebuilt turns, from 0."""
    turns = _numbered(conversations)
    convs = stage(turns.groupBy("conv_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "conversations")
    base = (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")
    heads = (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("heads")
    lent = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("have"))
    plan = convs.select("conv_id", "first", "n", base, heads).join(lent, "base", "left").withColumn(
        "taken", F.least("heads", F.coalesce("have", F.lit(0))))
    plan = stage(plan.withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("heads"), F.lit(0))), "rebuilding")
    own = turns.join(plan.select("conv_id", "first", "heads", "taken"), "conv_id").withColumn("at", F.col("at") - F.col("first"))
    own = own.where("at >= heads").select("conv_id", (F.col("at") - F.col("heads") + F.col("taken")).alias("pos"), *_KEYS, "size")
    first = turns.where(F.col("conv_id") % GROUP == 0).join(convs.select("conv_id", "first"), "conv_id")
    first = first.withColumn("pos", F.col("at") - F.col("first")).where(F.col("pos") < HEADS - 1).select(
        F.col("conv_id").alias("base"), "pos", *_KEYS, "size")
    lent = plan.where("taken > 0").select("conv_id", "base", "taken").join(first, "base").where("pos < taken")
    return plan.select("conv_id", "len"), own.union(lent.select("conv_id", "pos", *_KEYS, "size"))


def _ends(rows: DataFrame) -> DataFrame:
    """(conv_id, len, w, ends): each sequence once, under its smallest conversation, with how many have it and the
    hash of all their ids. ``rows``: (s1, s2, len, conv_id). A task reads its ids in order and keeps one hash."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            out = []
            for *of, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if of != key:
                    if key is not None:
                        out.append((least, key[2], n, state.hexdigest()))
                    key, least, n, state = of, conv, 1, hashlib.sha256(str(conv).encode())
                else:
                    n += 1
                    state.update(b",%d" % conv)
            yield made(out)
        if key is not None:
            yield made([(least, key[2], n, state.hexdigest())])

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["conv_id", "len", "w", "ends"])

    key = ["s1", "s2", "len"]
    return rows.repartition(*key).sortWithinPartitions(*key, "conv_id").select(*key, "conv_id").mapInArrow(
        listed, "conv_id bigint, len bigint, w bigint, ends string")


def segments(conversations: DataFrame) -> tuple[DataFrame, int]:
    """(seg, p1, p2, q1, q2, turns, least, w, ends) of the distinct sequences, and the number of levels. p names the
    prefix before the segment and q the one after it; ends is null unless the sequence ends there."""
    lens, turns = rebuilt(conversations)
    cut = turns.withColumn("seg", F.floor(F.col("pos") / SEGMENT).cast("int")).groupBy("conv_id", "seg").agg(
        F.sort_array(F.collect_list(F.struct("pos", *_KEYS, "size"))).alias("turns"),
        F.bit_xor(F.xxhash64("k1", "k2", "pos")).alias("x1"), F.bit_xor(F.xxhash64("k2", "pos", "k1")).alias("x2"))
    cut = stage(cut, "segments")
    whole = cut.groupBy("conv_id").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    named = lens.join(whole, "conv_id", "left").select(
        F.coalesce("s1", F.lit(0)).alias("s1"), F.coalesce("s2", F.lit(0)).alias("s2"), "len", "conv_id")
    once = stage(_ends(named), "sequences")
    levels = -(-(once.agg(F.max("len")).first()[0] or 0) // SEGMENT)
    kept = once.join(cut, "conv_id", "left").withColumns({
        "seg": F.coalesce("seg", F.lit(0)), "x1": F.coalesce("x1", F.lit(0)), "x2": F.coalesce("x2", F.lit(0)),
        "turns": F.coalesce("turns", F.array().cast(cut.schema["turns"].dataType))})
    zero = F.lit(0).cast("bigint")
    if levels > 1:
        before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
        p = [F.coalesce(F.bit_xor(x).over(before), zero) for x in ("x1", "x2")]
    else:
        p = [zero, zero]
    last = (F.col("seg") + 1) * SEGMENT >= F.col("len")
    kept = kept.select("seg", p[0].alias("p1"), p[1].alias("p2"), "x1", "x2", "turns", F.col("conv_id").alias("least"), "w",
                       F.when(last, F.col("ends")).alias("ends"))
    q = [F.col(f"p{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"q{i}") for i in (1, 2)]
    return stage(kept.select("seg", "p1", "p2", *q, "turns", "least", "w", "ends"), "distinct-segments"), max(levels, 1)


# --- double arrays ------------------------------------------------------------------------------------------

class DoubleArray:
    """A trie as two arrays: the child of state s by symbol c is BASE[s] + c, if CHECK there is s. State 0 is the root."""

    def __init__(self):
        self.base, self.check, self._next, self._top = [0], [-1], [1], 1

    def _free(self, at: int) -> int:
        """The first slot from ``at`` on that is not taken."""
        nxt = self._next
        if at >= len(nxt):
            nxt.extend(range(len(nxt), at + 1))
        end = at
        while end < len(nxt) and nxt[end] != end:
            end = nxt[end]
        if end == len(nxt):
            nxt.append(end)
        while nxt[at] != end and at != end:
            nxt[at], at = end, nxt[at]
        return end

    def add(self, state: int, symbols: list[int]) -> list[int]:
        """Give a state its children, by ascending symbols; their states."""
        first, nxt = symbols[0], self._next
        at, tries = self._free(max(first, self._top) if len(symbols) > 64 else first), 0
        while any(at - first + c < len(nxt) and nxt[at - first + c] != at - first + c for c in symbols[1:]):
            tries += 1
            at = self._free(at + 1 if tries < 64 else max(at + 1, self._top))
        slots = [at - first + c for c in symbols]
        last = slots[-1]
        if last + 1 >= len(nxt):
            nxt.extend(range(len(nxt), last + 2))
        if last >= len(self.base):
            more = last + 1 - len(self.base)
            self.base += [0] * more
            self.check += [-1] * more
        self.base[state] = at - first
        for s in slots:
            nxt[s], self.check[s] = s + 1, state
        self._top = max(self._top, last + 1)
        return slots

    @classmethod
    def of(cls, steps: list[np.ndarray]) -> DoubleArray:
        """The trie of sequences; ``steps[d]`` has the d-th symbols of those that are long enough, which come first."""
        out, width = cls(), int(max((s.max() for s in steps if len(s)), default=0)) + 1
        state = np.zeros(len(steps[0]), dtype=np.int64)
        for symbols in steps:
            pairs, of = np.unique(state[:len(symbols)] * width + symbols, return_inverse=True)
            parents, symbol = pairs // width, pairs % width
            cuts = [0, *(np.flatnonzero(np.diff(parents)) + 1).tolist(), len(parents)]
            slots: list[int] = []
            for i, j in zip(cuts, cuts[1:]):
                slots += out.add(int(parents[i]), symbol[i:j].tolist())
            state[:len(symbols)] = np.array(slots, dtype=np.int64)[of]
        return out


def _dense(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A dense number for each pair, and where each number stands first."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    ids = np.empty(len(a), dtype=np.int64)
    ids[order] = np.cumsum(new) - 1
    return ids, order[new]


def _chained(name: np.ndarray, key: np.ndarray, by: int) -> np.ndarray:
    x = name * np.uint64(by) + key
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_OUT = [("upper", pa.bool_()), ("depth", pa.int64()), ("id1", pa.int64()), ("id2", pa.int64()), ("par1", pa.int64()), ("par2", pa.int64()),
        ("below_cut", pa.bool_()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("size", pa.int64()), ("ends", pa.string()), ("q1", pa.int64()), ("q2", pa.int64()),
        ("up", pa.list_(pa.struct([("a1", pa.int64()), ("a2", pa.int64())])))]
_OUT_DDL = ("upper boolean, depth bigint, id1 bigint, id2 bigint, par1 bigint, par2 bigint, below_cut boolean, conv_id bigint, parent_conv_id bigint, "
            "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, size bigint, ends string, q1 bigint, q2 bigint, "
            "up array<struct<a1:bigint,a2:bigint>>")


def shard_nodes(rows: pa.Table) -> pa.Table:
    """The nodes of one shard's trie, from its segments.

    Nodes at or below the cut are whole here; the first of them name the node they hang at (``below_cut``). Nodes
    above it carry what this shard adds, and their ancestors.
    """
    turns = rows["turns"].combine_chunks()
    size = turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(-size, kind="stable")
    column = lambda name: rows[name].combine_chunks().to_numpy(zero_copy_only=False)[order]
    flat = turns.flatten()
    key = [flat.field(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in _KEYS]
    nbytes = flat.field("size").to_numpy(zero_copy_only=False)
    code, shown = _dense(*key)
    prefix, first = _dense(column("p1"), column("p2"))
    start, size = (np.cumsum(size) - size)[order], size[order]
    longest = int(size[0]) if len(size) else 0
    steps = [prefix + len(shown)]
    for d in range(longest):
        steps.append(code[start[:np.searchsorted(-size, -d, side="left")] + d])
    trie = DoubleArray.of(steps)
    base, check = np.array(trie.base, dtype=np.int64), np.array(trie.check, dtype=np.int64)
    n = len(base)

    # walk all segments through the arrays
    w, least, cut = column("w").astype(np.int64), column("least").astype(np.int64), column("cut").astype(np.int64)
    convs, conv, cuts = np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)
    names, last = [np.zeros(n, dtype=np.uint64) for _ in range(2)], np.zeros(n, dtype=np.int64)
    state, by_depth = np.zeros(len(w), dtype=np.int64), []
    for d, symbols in enumerate(steps):
        m = len(symbols)
        then = base[state[:m]] + symbols
        if not (check[then] == state[:m]).all():
            raise AssertionError("a segment is not in its trie")
        np.add.at(convs, then, w[:m])
        np.minimum.at(conv, then, least[:m])
        np.maximum.at(cuts, then, cut[:m])
        nodes, at = np.unique(then, return_index=True)
        if d == 0:
            for i, p in enumerate(("p1", "p2")):
                names[i][nodes] = column(p).astype(np.int64).view(np.uint64)[at]
        else:
            k = shown[symbols[at]]
            last[nodes] = nbytes[k]
            for i, by in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                names[i][nodes] = _chained(names[i][check[nodes]], key[i][k], by)
        state[:m] = then
        by_depth.append(nodes)

    kids, leaves, saved = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), (convs - 1) * last
    for c, into in (("c_kids", kids), ("c_leaves", leaves), ("c_saved", saved)):
        np.add.at(into, state, column(c).astype(np.int64))
    for nodes in by_depth[1:]:
        np.add.at(kids, check[nodes], 1)
    for nodes in by_depth:
        leaves[nodes] += kids[nodes] == 0
    for nodes in reversed(by_depth[1:]):
        np.add.at(leaves, check[nodes], leaves[nodes])
        np.add.at(saved, check[nodes], saved[nodes])

    ends, q = np.full(n, None, dtype=object), [np.full(n, None, dtype=object) for _ in range(2)]
    done = column("ends")
    closed = np.array([e is not None for e in done], dtype=bool)
    ends[state[closed]] = done[closed]
    for i, name in enumerate(("q1", "q2")):
        q[i][state[~closed]] = column(name)[~closed]
    depth = np.concatenate([np.full(len(x), d) for d, x in enumerate(by_depth)])
    nodes = np.concatenate(by_depth)
    signed = [x.view(np.int64) for x in names]
    upper = depth < cuts[nodes]
    top, par = depth == cuts[nodes], check[nodes]
    inner = depth > cuts[nodes]
    up = np.full(len(nodes), None, dtype=object)
    for i in np.flatnonzero(upper).tolist():
        path, s = [], int(nodes[i])
        for _ in range(int(depth[i]) + 1):
            path.append({"a1": int(signed[0][s]), "a2": int(signed[1][s])})
            s = int(check[s])
        up[i] = path
    hide = lambda x, show: pa.array(x, pa.int64(), mask=~show)
    whole, hung = ~upper, depth > 0
    arrays = [pa.array(upper), pa.array(depth), pa.array(signed[0][nodes]), pa.array(signed[1][nodes]), hide(signed[0][par], hung),
              hide(signed[1][par], hung), pa.array(top), pa.array(conv[nodes]), hide(conv[par], inner), pa.array(convs[nodes]),
              hide(kids[nodes], whole), hide(leaves[nodes], whole), hide(saved[nodes], whole), pa.array(last[nodes]),
              pa.array(ends[nodes], pa.string()), pa.array(q[0][nodes], pa.int64()), pa.array(q[1][nodes], pa.int64()),
              pa.array(up, _OUT[-1][1])]
    return pa.table(arrays, schema=pa.schema(_OUT))


# --- levels of segments ---------------------------------------------------------------------------------------

def _prefix(turns: Column, n: Column | int) -> Column:
    """What names the first ``n`` turns below p."""
    return F.xxhash64("p1", "p2", F.transform(F.slice(turns, F.lit(1), F.lit(n) if isinstance(n, int) else n), lambda t: F.struct(t["k1"], t["k2"])))


def dealt(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """Add ``cut`` and ``bucket``: segments with the same first ``cut`` turns below one prefix share a bucket. The cut
    is doubled where more than ``shard`` turns would meet, up to a whole segment."""
    length = F.size("turns").cast("bigint") + 1
    total = rows.agg(F.sum(length)).first()[0] or 0
    rows, cut = rows.withColumn("cut", F.lit(1)), 1
    while cut < SEGMENT:
        keyed = rows.withColumn("_key", _prefix(F.col("turns"), cut))
        crowded = keyed.where(F.col("cut") == cut).groupBy("_key").agg(F.sum(length).alias("n"), F.count(F.lit(1)).alias("rows"))
        crowded = pin(crowded.where((F.col("n") > shard) & (F.col("rows") > 1)).select("_key", F.lit(True).alias("_crowded")))
        if crowded.isEmpty():
            break
        twice = min(2 * cut, SEGMENT)     # a segment's last node names what goes on below it, so it is never above the cut
        longer = F.when(F.col("_crowded") & (F.col("cut") == cut), F.lit(twice)).otherwise(F.col("cut"))
        rows = stage(attach(keyed, crowded, ["_key"], "left", ready=True).withColumn("cut", longer).drop("_key", "_crowded"), "dealt")
        cut = twice
    return rows.withColumn("bucket", F.pmod(_prefix(F.col("turns"), F.col("cut")), F.lit(total // shard + 1)))


def _level(rows: DataFrame, below: DataFrame | None, seg: int, shard: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, top) of one level: all its nodes but those it hangs at, and the sums of the latter.

    ``below``: the sums of the next level, (p1, p2, c_kids, c_leaves, c_saved).
    """
    sums = ["c_kids", "c_leaves", "c_saved"]
    if below is None:
        rows = rows.withColumns({c: F.lit(0).cast("bigint") for c in sums})
    else:
        # sequences that go on may share this whole segment
        rows = rows.groupBy("p1", "p2", "q1", "q2", F.col("ends").isNull().alias("on")).agg(
            F.any_value("turns").alias("turns"), F.min("least").alias("least"), F.sum("w").alias("w"), F.max("ends").alias("ends"))
        below = below.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.lit(True).alias("on"), *sums)
        rows = stage(rows.join(below, ["q1", "q2", "on"], "left").withColumns(
            {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in sums}).drop("on"), "level")
    found = dealt(rows, shard).groupBy("bucket").applyInArrow(shard_nodes, _OUT_DDL)
    found = stage(found.withColumn("depth", F.col("depth") + seg * SEGMENT), "trie-nodes")
    own, par = ["id1", "id2"], ["par1", "par2"]
    as_par = {"id1": "par1", "id2": "par2"}
    zero = F.lit(0)
    upper = found.where("upper").groupBy(*own).agg(
        F.first("depth").alias("depth"), F.first("par1").alias("par1"), F.first("par2").alias("par2"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.first("size").alias("size"), F.max("ends").alias("ends"), F.first("up").alias("up"))
    upper = stage(upper, "upper-nodes")
    tops = found.where("below_cut").groupBy(*par).agg(
        F.sum("n_leaves").alias("t_leaves"), F.sum("saved_tokens").alias("t_saved"), F.count(F.lit(1)).alias("t_kids"))
    between = upper.where("par1 IS NOT NULL").groupBy(*par).agg(F.count(F.lit(1)).alias("u_kids"))
    joined = upper.join(tops.withColumnsRenamed({v: k for k, v in as_par.items()}), own, "left").join(
        between.withColumnsRenamed({v: k for k, v in as_par.items()}), own, "left")
    kids = F.coalesce("t_kids", zero) + F.coalesce("u_kids", zero)
    joined = stage(joined.withColumns({
        "n_children": kids, "a_leaves": F.coalesce("t_leaves", zero) + F.when(kids == 0, 1).otherwise(0),
        "a_saved": F.coalesce("t_saved", zero) + (F.col("n_convs") - 1) * F.col("size")}), "upper-sums")
    total = joined.select(F.explode("up").alias("a"), "a_leaves", "a_saved").groupBy("a.a1", "a.a2").agg(
        F.sum("a_leaves").alias("n_leaves"), F.sum("a_saved").alias("saved_tokens")).withColumnsRenamed({"a1": "id1", "a2": "id2"})
    merged = stage(joined.join(total, own).select(*own, *par, "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"), "upper-merged")
    top = merged.where(F.col("depth") == seg * SEGMENT)
    fields = [*par, "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    none = F.lit(None).cast("bigint")
    parents = merged.select(F.col("id1").alias("par1"), F.col("id2").alias("par2"), F.col("conv_id").alias("parent_conv_id"))
    lone = found.where("NOT upper AND NOT below_cut").select(*fields, "parent_conv_id", "q1", "q2")
    hung = attach(found.where("below_cut").select(*fields, "q1", "q2"), parents, par, "left", ready=True).select(*fields, "parent_conv_id", "q1", "q2")
    inner = attach(merged.where(F.col("depth") > seg * SEGMENT).select(*fields), parents, par, "left", ready=True).select(
        *fields, "parent_conv_id", none.alias("q1"), none.alias("q2"))
    nodes = lone.union(hung).union(inner)
    if seg == 0:
        nodes = nodes.union(top.select(*fields, none.alias("parent_conv_id"), none.alias("q1"), none.alias("q2")))
    return nodes, top.select(F.col("id1").alias("p1"), F.col("id2").alias("p2"), F.col("n_children").alias("c_kids"),
                             F.col("n_leaves").alias("c_leaves"), F.col("saved_tokens").alias("c_saved"))


def trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row per node of the trie of rebuilt conversations, from ``conversations`` (conv_id, turn, role, text; the rest
    stays out): conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256.

    Turns stand in order of their number, null first; those with one number in order of role and text, repeats
    behind each other. Null role and text are empty. Rows without conv_id belong to no conversation. A conversation
    left without turns ends at the root; an empty table has no node. The number of rounds grows with the longest
    conversation, by one for every 256 turns; every step else is spread over the cluster.
    """
    rows, levels = segments(conversations)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    done, waiting, below = [], None, None
    for seg in range(levels - 1, -1, -1):
        nodes, below = _level(rows.where(F.col("seg") == seg), below, seg, shard)
        if levels > 1:
            nodes = stage(nodes, "level-nodes")
        if waiting is not None:     # the first nodes of the level below hang at nodes of this one
            ends = nodes.where("q1 IS NOT NULL").select(F.col("q1").alias("par1"), F.col("q2").alias("par2"), F.col("conv_id").alias("parent_conv_id"))
            done.append(waiting.drop("parent_conv_id").join(ends, ["par1", "par2"]).select(*columns, "ends"))
        first = F.col("depth") == seg * SEGMENT + 1
        waiting = nodes.where(first) if seg else None
        done.append((nodes.where(~first) if seg else nodes).select(*columns, "ends"))
    return reduce(DataFrame.union, done).select(*columns, F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"))


_SQL = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM o),
-- crc32: the bytes of the decimal id, each followed by eight shifts
crc AS (SELECT conv_id, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
  lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM ids),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS b, xor(c, 4294967295) % 9 AS h FROM crc),
x AS (SELECT c.conv_id, 0 AS part, o.pos, r, t FROM c JOIN o ON o.conv_id = c.b AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, r, t FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, sha256(r || chr(1) || t) AS k, strlen(t) AS size FROM x),
l AS (SELECT conv_id, list(k ORDER BY d) AS ks, list(size ORDER BY d) AS sizes FROM s GROUP BY 1),
f AS (SELECT ids.conv_id, coalesce(ks, []) AS ks, coalesce(sizes, []) AS sizes FROM ids LEFT JOIN l USING (conv_id)),
m AS (SELECT conv_id, d, array_to_string(ks[1:d], ',') AS key, array_to_string(ks[1:d - 1], ',') AS up, len(ks) AS n, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
  FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM f)),
nodes AS (SELECT d, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM m GROUP BY d, key),
kids AS (SELECT d - 1 AS d, up AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
k AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.d = nodes.d AND kids.key = nodes.key),
sums AS (SELECT m.d, m.key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * k.size) AS BIGINT) AS saved_tokens
  FROM k JOIN m ON m.conv_id = k.conv_id AND m.d <= k.d GROUP BY m.d, m.key)
SELECT k.conv_id, k.d AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, sums.n_leaves, sums.saved_tokens, k.ends_sha256
FROM k JOIN sums ON sums.d = k.d AND sums.key = k.key LEFT JOIN k p ON k.d > 0 AND p.d = k.d - 1 AND p.key = k.up
"""


@query("op11_conversation_trie", _SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))
