"""Exact top-k by inner product: a dual-tree search over one cover tree of queries and data.

The tree is fitted on a bounded sample; every row is routed to a leaf and the covering radii are measured over
all rows, so no bound depends on the sample. The sample also gives each query a first kth score, and each query
leaf its worst one. Node pairs are traversed from the root: a pair whose largest possible product is below the
query side's worst kth score is pruned. What is left is scored leaf by leaf in blocks, and merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import table
from .registry import query

K, EVERY, SCALE = 20, 20, 64.0
SAMPLE = 4096        # rows the tree is fitted on, at most
LEAF, FANOUT = 128, 16
SHRINK = 1.3         # a child's nominal radius is its parent's by this
ROWS, QUERIES = 8192, 4096   # of data and queries that meet in one task


@dataclass
class CoverTree:
    """Centres, each node's children and parent; node 0 is the root. Leaves have no children."""

    centres: np.ndarray
    children: list[list[int]]
    parent: list[int]

    def route(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's leaf, by the nearest child from the root on, and its distance to the leaf's centre."""
        leaf = np.zeros(len(rows), dtype=np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, mine = todo.pop()
            kids = self.children[node]
            if not kids or not len(mine):
                leaf[mine] = node
                continue
            best = _distances(rows[mine], self.centres[kids]).argmin(axis=1)
            todo += [(kid, mine[best == i]) for i, kid in enumerate(kids)]
        return leaf, np.sqrt(((rows - self.centres[leaf]) ** 2).sum(axis=1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None] - 2 * a @ b.T, 0))


def fit(sample: np.ndarray) -> CoverTree:
    """Children of a node are centres more than its shrunken radius apart; the first is the node's own. A node
    has at most ``FANOUT`` children, rows none of them covers go to the nearest."""
    tree = CoverTree(sample[:1].copy(), [[]], [-1])
    centres = [sample[0]]
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, mine = todo.pop()
        far = np.sqrt(((sample[mine] - centres[node]) ** 2).sum(1))
        if len(mine) <= LEAF or far.max() == 0:
            continue
        kids, near = [centres[node]], far.copy()
        while len(kids) < FANOUT and near.max() > far.max() / SHRINK:
            kids.append(sample[mine[int(near.argmax())]])
            near = np.minimum(near, np.sqrt(((sample[mine] - kids[-1]) ** 2).sum(1)))
        owner = _distances(sample[mine], np.array(kids)).argmin(axis=1)
        for i, c in enumerate(kids):
            if (owner == i).any():
                tree.children.append([])
                tree.parent.append(node)
                tree.children[node].append(len(centres))
                todo.append((len(centres), mine[owner == i]))
                centres.append(c)
        if len(tree.children[node]) == 1:   # nothing was split off: a leaf after all
            tree.children[tree.children[node].pop()] = []
            todo.pop()
    tree.centres = np.array(centres)
    return tree


def radii(tree: CoverTree, leaf_radius: dict[int, float]) -> np.ndarray:
    """Covering radius of every node from those measured at the leaves; -1 for a node without rows."""
    out = np.full(len(tree.centres), -1.0)
    for n in range(len(out) - 1, -1, -1):   # children come after their parents
        if n in leaf_radius:
            out[n] = max(out[n], leaf_radius[n])
        for kid in tree.children[n]:
            if out[kid] >= 0:
                out[n] = max(out[n], out[kid] + float(np.linalg.norm(tree.centres[kid] - tree.centres[n])))
    return out


def surviving(tree: CoverTree, data: dict[int, float], queries: dict[int, tuple[float, float]]) -> list[tuple[int, int]]:
    """(query leaf, data leaf) pairs that may hold one of the k best. ``data``: leaf radii; ``queries``: leaf
    radii and worst kth scores. Both sides of a pair are taken apart together."""
    rd, rq = radii(tree, data), radii(tree, {n: r for n, (r, _) in queries.items()})
    worst = np.full(len(rd), np.inf)
    for n in range(len(rd) - 1, -1, -1):
        if n in queries:
            worst[n] = queries[n][1]
        worst[n] = min([worst[n], *worst[tree.children[n]]])
    norm = np.linalg.norm(tree.centres, axis=1)
    out, todo = [], [(0, 0)]
    while todo:
        q, d = todo.pop()
        if rq[q] < 0 or rd[d] < 0:
            continue
        top = tree.centres[q] @ tree.centres[d] + rq[q] * norm[d] + rd[d] * norm[q] + rq[q] * rd[d]
        if top + 1e-6 * (1 + abs(top)) < worst[q]:
            continue
        qs, ds = tree.children[q] or [q], tree.children[d] or [d]
        if qs == [q] and ds == [d]:
            out.append((q, d))
        else:
            todo += [(x, y) for x in qs for y in ds]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while they can hold every sum, else in 64-bit integers."""
    if len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2 ** 52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(x, dtype=np.float64) for x in column])


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple]:
    """(query row, ids, scores) of each query's k best, ties to the smaller id, none below its floor."""
    for i in range(len(scores)):
        row = scores[i]
        ok = np.flatnonzero((row >= floor[i]) & (ids != own[i]))
        if len(ok) > k:
            cut = -np.partition(-row[ok], k - 1)[k - 1]
            ok = ok[row[ok] >= cut]
            ok = ok[np.lexsort((ids[ok], -row[ok]))[:k]]
        yield i, ids[ok], row[ok]


def _score(group: pd.DataFrame, pairs: dict[int, list[int]], k: int) -> pd.DataFrame:
    asked, data = group[group["is_query"]], group[~group["is_query"]]
    out = {"query_id": [], "vec_id": [], "score": []}
    if not len(asked) or not len(data):
        return pd.DataFrame(out).astype("int64")
    blocks = {leaf: (_matrix(g["v"]), g["vec_id"].to_numpy()) for leaf, g in data.groupby("leaf")}
    for leaf, g in asked.groupby("leaf"):
        near = [blocks[d] for d in pairs.get(leaf, ()) if d in blocks]
        if not near:
            continue
        rows, ids = np.concatenate([x for x, _ in near]), np.concatenate([y for _, y in near])
        own = g["vec_id"].to_numpy()
        for i, found, score in _best(_products(_matrix(g["v"]), rows), ids, own, g["floor"].to_numpy(), k):
            out["query_id"].append(np.full(len(found), own[i]))
            out["vec_id"].append(found)
            out["score"].append(score)
    return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for c, x in out.items()})


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` (vec_id, v: array of whole doubles) for which
    ``is_query`` (a Column over vec_id) holds, against all rows but those of the query's id.

    Rows without id or vector are left out; equal rows count once; vectors of different lengths never meet.
    An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    base = stage(vectors.where("vec_id IS NOT NULL AND v IS NOT NULL").select("vec_id", "v").distinct(), "vectors")
    results = None
    for row in base.select(F.size("v").alias("dim")).distinct().orderBy("dim").toLocalIterator():
        part = _search(spark, base.where(F.size("v") == row["dim"]), is_query, k)
        results = part if results is None else results.union(part)
    if results is None:
        results = spark.createDataFrame([], "query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(spark: SparkSession, rows: DataFrame, is_query, k: int) -> DataFrame:
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    points, ids = _matrix(picked["v"]), picked["vec_id"].to_numpy()
    tree = fit(points)
    shared = spark.sparkContext.broadcast((tree, points, ids))    # at most SAMPLE vectors

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, points, ids = shared.value
        for batch in batches:
            m = _matrix(batch.column("v").to_pylist())
            if not len(m):
                continue
            leaf, far = tree.route(m)
            floor = np.full(len(m), np.iinfo(np.int64).min)
            ask = np.flatnonzero(batch.column("is_query").to_numpy(zero_copy_only=False))
            own = batch.column("vec_id").to_numpy()
            for at in range(0, len(ask), 256):
                of = ask[at:at + 256]
                for i, _, score in _best(_products(m[of], points), ids, own[of], floor[of], k):
                    if len(score) >= k:
                        floor[of[i]] = score.min()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(far), pa.array(floor)],
                                             ["vec_id", "v", "is_query", "leaf", "far", "floor"])

    routed = rows.select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("is_query")).mapInArrow(
        route, "vec_id bigint, v array<double>, is_query boolean, leaf bigint, far double, floor bigint")
    routed = stage(routed, "routed")
    # one row per leaf: at most SAMPLE
    leaves = routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r"), F.count_if("is_query").alias("nq"),
                                        F.max(F.when(F.col("is_query"), F.col("far"))).alias("rq"),
                                        F.min(F.when(F.col("is_query"), F.col("floor"))).alias("worst")).collect()
    live = surviving(tree, {x.leaf: x.r for x in leaves}, {x.leaf: (x.rq, float(x.worst)) for x in leaves if x.nq})
    pairs: dict[int, list[int]] = {}
    for q, d in live:
        pairs.setdefault(q, []).append(d)
    # leaves fill bins of ROWS rows; one larger than that has several bins
    bins, at = {}, 0
    for x in sorted(leaves, key=lambda x: x.leaf):
        bins[x.leaf] = (at // ROWS, max(1, -(-x.n // ROWS)))
        at += x.n if x.n <= ROWS else bins[x.leaf][1] * ROWS
    blocks = max(1, -(-sum(x.nq for x in leaves) // QUERIES))
    asks: dict[int, set[int]] = {}
    for q, ds in pairs.items():
        asks[q] = {b for d in ds for b in range(bins[d][0], bins[d][0] + bins[d][1])}
    to_bins = spark.createDataFrame([(q, sorted(b)) for q, b in asks.items()], "leaf bigint, bins array<int>")
    of_leaf = spark.createDataFrame([(n, *b) for n, b in bins.items()], "leaf bigint, first int, n int")
    spread = F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int")
    data = (routed.join(of_leaf, "leaf").withColumn("bin", F.col("first") + spread)
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("is_query", F.lit(False)))
    asked = (routed.where("is_query").join(to_bins, "leaf").withColumn("bin", F.explode("bins"))
             .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")))
    cols = ["bin", "block", "vec_id", "v", "is_query", "leaf", "floor"]
    both = data.select(*cols).unionByName(asked.select(*cols))
    return both.groupBy("bin", "block").applyInPandas(
        lambda g: _score(g, pairs, k), "query_id bigint, vec_id bigint, score bigint")


def scaled(embeddings: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; null without a vector of finite components."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    sound = F.forall("embedding", lambda x: F.coalesce(
        ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return embeddings.select("vec_id", F.when(sound & (F.size("embedding") > 0), whole).alias("v"))


_SQL = """WITH d AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score FROM d q, d
  WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""


@query("op7_exact_search", _SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(scaled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % EVERY == 0)
