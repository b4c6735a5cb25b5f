"""SimHash near-duplicates by a self-join of the fingerprints' binary trie.

Pairs of trie nodes are traversed together from the root. A pair whose prefixes differ in more bits
than the budget is pruned; a pair of small nodes is handed to a task, which goes on down to the
fingerprints; larger ones are taken apart by the next bits in a join. Equal fingerprints are one leaf.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .common import table
from .graph import components
from .registry import query

WORDS, SEED, BUDGET = 3, 42, 2
LEAF = 2048      # a pair of nodes with at most so many fingerprints each goes to one task
STEP = 4         # bits by which larger nodes are taken apart
WINDOWS = 65_536  # shingles whose bits are held at once
PAIRS = 32_768   # node pairs that a task splits at once


def fingerprint_of(text: str, words: int = WORDS, seed: int = SEED) -> int:
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = ends - [len(p) for p in parts]
    n = max(1, len(parts) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(parts)) - 1:].tolist()
    h = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, WINDOWS):
        got = np.fromiter((h(joined[a:b], seed) for a, b in zip(first[at:at + WINDOWS], last[at:at + WINDOWS])),
                          dtype=">u8")
        ones += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint(text: Column) -> Column:
    """BIGINT fingerprint; null and wordless texts have 0. A-Z count as a-z; words end at ASCII space."""
    @F.arrow_udf("bigint")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(x.as_py() or "") for x in texts], pa.int64())
    return fp(text)


def _prefix(column: str, depth: int) -> Column:
    return F.lit(0).cast("bigint") if depth == 0 else F.shiftrightunsigned(F.col(column), 64 - depth)


def node_pairs(prints: DataFrame, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """(depth, a, b, err): the pairs of trie nodes that tasks go on with, a <= b, at most ``budget`` bits
    apart. Each pair of fingerprints within the budget lies below exactly one of them."""
    spark = prints.sparkSession
    zero = F.lit(0).cast("bigint")
    pairs = spark.range(1).select(zero.alias("a"), zero.alias("b"), F.lit(0).alias("err"))     # starts no Python worker
    done = None
    for depth in range(0, 65, STEP):
        nodes = prints.groupBy(_prefix("fp", depth).alias("node")).agg(F.count(F.lit(1)).alias("n"))
        sized = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(
            nodes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        sized = stage(sized.withColumn("small", (F.greatest("na", "nb") <= leaf) | F.lit(depth == 64)), "pairs")
        here = sized.where("small").select(F.lit(depth).alias("depth"), "a", "b", "err")
        done = here if done is None else done.union(here)
        large = sized.where("NOT small").select("a", "b", "err")
        if depth == 64 or large.isEmpty():
            return done
        kids = prints.select(_prefix("fp", depth + STEP).alias("kid")).distinct().select(
            F.shiftrightunsigned("kid", STEP).alias("node"), "kid")
        left = kids.select(F.col("node").alias("a"), F.col("kid").alias("ka"))
        right = kids.select(F.col("node").alias("b"), F.col("kid").alias("kb"))
        new_bits = F.col("ka").bitwiseXOR(F.col("kb")).bitwiseAND(F.lit((1 << STEP) - 1))
        err = F.col("err") + F.bit_count(new_bits)
        pairs = (large.join(left, "a").join(right, "b").where((err <= budget) & (F.col("ka") <= F.col("kb")))
                 .select(F.col("ka").alias("a"), F.col("kb").alias("b"), err.cast("int").alias("err")))
    return done


def traverse(a: np.ndarray, b: np.ndarray, start: np.ndarray, bit: int, budget: int):
    """Yield index pairs (into ``a`` and ``b``, both sorted) at most ``budget`` bits apart.

    ``start``: node pairs as rows (a from, a to, b from, b to, bits differing so far), whose members agree
    on the bits above ``bit``. The pairs of one level are split together; many are worked off in parts.
    """
    stack = [(start, bit)]
    while stack:
        pairs, bit = stack.pop()
        if len(pairs) > PAIRS:
            stack += [(pairs[:len(pairs) // 2], bit), (pairs[len(pairs) // 2:], bit)]
            continue
        na, nb = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        few = (na * nb <= 16) | (bit < 0)
        if few.any():
            p, m = pairs[few], (na * nb)[few]
            of = np.repeat(np.arange(len(p)), m)
            k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            w = nb[few][of]
            i, j = p[of, 0] + k // w, p[of, 2] + k % w
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            yield i[near], j[near]
        pairs = pairs[~few]
        if not len(pairs):
            continue
        mid = [np.concatenate([[0], np.cumsum(((x >> np.uint64(bit)) & np.uint64(1)).astype(np.int64))]) for x in (a, b)]
        ma = pairs[:, 1] - (mid[0][pairs[:, 1]] - mid[0][pairs[:, 0]])
        mb = pairs[:, 3] - (mid[1][pairs[:, 3]] - mid[1][pairs[:, 2]])
        kids = []
        for x, y in ((0, 0), (0, 1), (1, 0), (1, 1)):
            lo, hi = (pairs[:, 0], ma) if x == 0 else (ma, pairs[:, 1])
            lo2, hi2 = (pairs[:, 2], mb) if y == 0 else (mb, pairs[:, 3])
            err = pairs[:, 4] + (x != y)
            ok = (hi > lo) & (hi2 > lo2) & (err <= budget)
            kids.append(np.stack([lo, hi, lo2, hi2, err], axis=1)[ok])
        stack.append((np.concatenate(kids), bit - 1))


def _links(group: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Links below one node and between it and its partners, as a star per linked set."""
    depth = int(group["depth"].iloc[0])
    home = np.sort(group.loc[group["err"] < 0, "fp"].to_numpy().view(np.uint64))
    away = group[group["err"] >= 0]
    guest = away["fp"].to_numpy().view(np.uint64)
    order = np.argsort(guest)
    guest, err = guest[order], away["err"].to_numpy()[order]
    both = np.concatenate([home, guest])
    root = np.arange(len(both))

    def hook(i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            ri, rj = root[i], root[j]
            apart = ri != rj
            i, j = i[apart], j[apart]
            np.minimum.at(root, np.maximum(ri, rj)[apart], np.minimum(ri, rj)[apart])
            while (root[root] != root).any():
                root[:] = root[root]

    bit = 63 - depth
    if len(home):
        inner = np.array([[0, len(home), 0, len(home), 0]])
        for i, j in traverse(home, home, inner, bit, budget):
            hook(i[i < j], j[i < j])
    if len(home) and len(guest):
        shift = np.uint64(64 - depth)
        cuts = np.flatnonzero(np.diff(guest >> shift)) + 1
        lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(guest)]])
        outer = np.stack([np.zeros_like(lo), np.full_like(lo, len(home)), lo, hi, err[lo]], axis=1)
        for i, j in traverse(home, guest, outer, bit, budget):
            hook(i, j + len(home))
    moved = np.flatnonzero(root != np.arange(len(both)))
    return pd.DataFrame({"a": both[root[moved]].view(np.int64), "b": both[moved].view(np.int64)})


def links(prints: DataFrame, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """(a, b) edges that connect exactly the fingerprints that links of at most ``budget`` bits connect.

    ``prints`` (fp) has distinct fingerprints. Each node's task gets its own and those of its larger
    partners, never more than a node may hold times the partners within the budget.
    """
    pairs = stage(node_pairs(prints, budget, leaf), "node-pairs")
    depths = [r.depth for r in pairs.select("depth").distinct().collect()]   # 17 at most
    placed = None
    for d in sorted(depths):
        at = prints.select(F.lit(d).alias("depth"), _prefix("fp", d).alias("node"), "fp")
        placed = at if placed is None else placed.union(at)
    if placed is None:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    meets = pairs.where("a < b").select("depth", F.col("b").alias("node"), F.col("a").alias("home"), "err")
    stays = pairs.select("depth", F.col("a").alias("node"), F.col("a").alias("home"), F.lit(-1).alias("err")).distinct()
    members = meets.union(stays).join(placed, ["depth", "node"]).select("depth", "home", "fp", "err")
    return members.groupBy("depth", "home").applyInPandas(lambda g: _links(g, budget), "a bigint, b bigint")


def _roots(prints: DataFrame, budget: int, leaf: int) -> DataFrame:
    """(fp, root) for each of the distinct fingerprints ``prints`` (fp): one fingerprint names its component."""
    parts = stage(components(links(prints, budget, leaf)), "components")
    return prints.join(parts.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text; the rest stays out).

    component_id is the smallest id reachable over links of at most ``budget`` differing bits, null only
    if no row there has an id. Null, empty and wordless texts have fingerprint 0 and link like any other;
    repeated rows share their fingerprint; an empty table gives an empty result.
    """
    rows = stage(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "fingerprints")
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    rooted = prints.join(_roots(prints.select("fp"), budget, leaf), "fp")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    final = stage(rooted.join(least, "root").select("fp", "component_id"), "component-ids")
    return rows.join(final, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) of which each component of near-duplicates keeps one: that
    with the smallest doc_id, null last, and of several the one whose columns hash lowest.

    Rows are told apart by all their columns, so rows of one id with different texts are judged each; of rows
    that are equal throughout one stays. Null and empty texts are alike. Whole rows are moved once.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    marked = [x for c in names for x in (c, c.isNull())]
    rows = docs.select(F.struct(*names).alias("row"), F.xxhash64(*marked).alias("row_1"), F.xxhash64(F.lit(1), *marked).alias("row_2"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_1", "row_2")).alias("first")
    slim = stage(rows.select("row.doc_id", "row_1", "row_2", fingerprint(F.col("row.text")).alias("fp")), "fingerprints")
    prints = stage(slim.groupBy("fp").agg(first), "prints")
    rooted = prints.join(_roots(prints.select("fp"), budget, leaf), "fp")
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.row_1", "first.row_2")
    return rows.dropDuplicates(["row_1", "row_2"]).join(stage(kept, "kept-rows"), ["row_1", "row_2"], "left_semi").select("row.*")


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
