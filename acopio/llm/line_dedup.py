"""Line deduplication that can be taken back: sharded cuckoo filters over exact reference counts.

The exact tables say which documents hold a line's key, and how many. The filters hold the frequent keys,
a shard's buckets as rows, so that of a batch's lines only those whose fingerprint sits in one of their
two buckets go on to the exact table. Inserting or deleting documents changes the references, and the keys
that become or cease to be frequent enter or leave the filters.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .common import table
from .registry import query

MIN_CHARS, MIN_DOCS = 40, 5
SHARDS = 64
SLOTS, KICKS = 4, 500
SLICE = 500      # texts whose lines a task holds at once
_BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: str) -> str:
    """ASCII white space stripped at both ends, A-Z as a-z."""
    bare = line.strip(_BLANKS)
    return bare.lower() if bare.isascii() else bare.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _digest(key: str) -> bytes:
    return hashlib.sha256(key.encode("utf-8", "surrogatepass")).digest()[:16]


def keys_of(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """Digests (first 128 bits of SHA-256) of a text's distinct line keys with at least ``min_chars`` code points."""
    @F.arrow_udf("array<binary>")
    def keys(texts: pa.Array) -> pa.Array:
        pa.default_memory_pool().release_unused()     # what the last batch left
        parts = [pa.array([], pa.list_(pa.binary()))]
        for at in range(0, len(texts), SLICE):
            flat, ends = [], [0]
            for x in texts.slice(at, SLICE):
                lines = (line_key(y) for y in (x.as_py() or "").split("\n"))
                flat.extend(_digest(k) for k in dict.fromkeys(lines) if len(k) >= min_chars)
                ends.append(len(flat))
            parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.binary())))
        return pa.concat_arrays(parts)
    return keys(text)


def without(text: Column, dropped: Column) -> Column:
    """struct(kept_text, n_dropped): the text less the lines whose digest is in ``dropped``.

    It is called non-deterministic only so that Spark computes it once: a filter on its result would else be moved below
    the projection and compute it a second time, in a second Python worker of the same task.
    """
    @F.arrow_udf("struct<kept_text:string,n_dropped:bigint>")
    def kept(texts: pa.Array, gone: pa.Array) -> pa.Array:
        pa.default_memory_pool().release_unused()     # what the last batch left
        parts, n = [pa.array([], pa.string())], []
        for at in range(0, len(texts), SLICE):
            out = []
            for x, g in zip(texts.slice(at, SLICE), gone.slice(at, SLICE)):
                text, keys = x.as_py() or "", set(g.as_py() or ())
                lines = text.split("\n") if keys else []
                stay = [y for y in lines if _digest(line_key(y)) not in keys]
                out.append("\n".join(stay) if keys else text)
                n.append(len(lines) - len(stay))
            parts.append(pa.array(out, pa.string()))
        return pa.StructArray.from_arrays([pa.concat_arrays(parts), pa.array(n, pa.int64())], ["kept_text", "n_dropped"])
    return kept.asNondeterministic()(text, dropped)


# a key's place: shard, fingerprint (16 bits, not 0) and first bucket come from its hash, the second bucket
# from the first and the fingerprint, either way round
def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def _print(h: Column) -> Column:
    return (h.bitwiseAND(F.lit(0xFFFF)) % 65_535 + 1).cast("int")


def _home(h: Column) -> Column:
    return F.shiftrightunsigned(h, 33).cast("bigint")


def _jump(fp: int) -> int:
    return fp * 0x5BD1E995 & 0x7FFFFFFF


class Cuckoo:
    """One shard's filter; ``size`` buckets, a power of two."""

    def __init__(self, size: int, buckets: dict[int, list[int]] | None = None):
        self.size, self.buckets = size, buckets or {}

    def add(self, fp: int, home: int) -> bool:
        i = home & (self.size - 1)
        for _ in range(KICKS):
            for b in (i, (i ^ _jump(fp)) & (self.size - 1)):
                slots = self.buckets.setdefault(b, [])
                if len(slots) < SLOTS:
                    slots.append(fp)
                    return True
            i = (i ^ _jump(fp)) & (self.size - 1)
            slots = self.buckets[i]
            fp, slots[home % SLOTS] = slots[home % SLOTS], fp
            i = (i ^ _jump(fp)) & (self.size - 1)
            home = home * 31 + 7 & 0x7FFFFFFF
        return False

    def remove(self, fp: int, home: int) -> bool:
        i = home & (self.size - 1)
        for b in (i, (i ^ _jump(fp)) & (self.size - 1)):
            if fp in self.buckets.get(b, ()):
                self.buckets[b].remove(fp)
                return True
        return False

    def holds(self, fp: int, home: int) -> bool:
        i = home & (self.size - 1)
        return any(fp in self.buckets.get(b, ()) for b in (i, (i ^ _jump(fp)) & (self.size - 1)))


def build(places: list[tuple[int, int]]) -> Cuckoo:
    """A filter of these (fingerprint, home), doubled until all fit. Only nine keys that agree in all 47 bits
    of their places could not be told apart by doubling."""
    size = 1
    while size * SLOTS * 0.8 < len(places):
        size *= 2
    while size <= 1 << 31:
        c = Cuckoo(size)
        if all(c.add(fp, home) for fp, home in places):
            return c
        size *= 2
    raise ValueError("keys that no filter can tell apart")


_BUCKETS = "shard int, size bigint, bucket bigint, slots array<int>"


def _rows(shard: int, c: Cuckoo) -> pd.DataFrame:
    full = [(b, s) for b, s in sorted(c.buckets.items()) if s]
    return pd.DataFrame({"shard": [shard] * len(full), "size": [c.size] * len(full), "bucket": [b for b, _ in full],
                         "slots": pd.Series([s for _, s in full], dtype=object)})


def _placed(keys: DataFrame, shards: int) -> DataFrame:
    h = _hash(F.col("key"))
    return keys.withColumns({"shard": F.pmod(F.xxhash64(h), F.lit(shards)).cast("int"), "fp": _print(h), "home": _home(h)})


def _change(shard: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """Apply a shard's changes; a filter that has no room left, or lost a place, comes back as one row without
    bucket and is built anew from the exact table."""
    if len(old) == 0:
        return _rows(shard[0], build(list(zip(new["fp"].tolist(), new["home"].tolist()))))
    c = Cuckoo(int(old["size"].iloc[0]), {int(b): list(s) for b, s in zip(old["bucket"], old["slots"])})
    ok = all((c.add if up else c.remove)(fp, home) for fp, home, up in
             zip(new["fp"].tolist(), new["home"].tolist(), new["up"].tolist()))
    if not ok:
        return pd.DataFrame({"shard": [shard[0]], "size": [0], "bucket": [-1], "slots": [[]]})
    return _rows(shard[0], c)


@dataclass(frozen=True)
class LineIndex:
    """references (key, doc_id, n rows), counts (key, n_docs, keeper) and filters (a shard's buckets)."""

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS
    shards: int = SHARDS

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._apply(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take back rows that were inserted before."""
        return self._apply(docs, -1)

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)

    def _apply(self, docs: DataFrame, sign: int) -> LineIndex:
        held = docs.where("doc_id IS NOT NULL").select("doc_id", F.explode(keys_of(F.col("text"), self.min_chars)).alias("key"))
        delta = held.groupBy("key", "doc_id").agg((F.count(F.lit(1)) * sign).alias("n"))
        refs = self.references.unionByName(delta).groupBy("key", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")
        refs = stage(refs, "references")
        counts = stage(refs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")), "counts")
        was = self.frequent().select("key", F.lit(True).alias("was"))
        now = counts.where(F.col("n_docs") >= self.min_docs).select("key", F.lit(True).alias("up"))
        changed = now.join(was, "key", "full").where("up IS NULL OR was IS NULL").select("key", F.coalesce("up", F.lit(False)).alias("up"))
        changed = _placed(changed, self.shards)
        touched = self.filters.groupBy("shard").cogroup(changed.groupBy("shard")).applyInPandas(_change, _BUCKETS)
        touched = stage(touched, "filters")
        broken = touched.where("bucket < 0").select("shard")
        places = _placed(now.select("key"), self.shards).join(broken, "shard")
        again = places.groupBy("shard").applyInPandas(
            lambda k, g: _rows(k[0], build(list(zip(g["fp"].tolist(), g["home"].tolist())))), _BUCKETS)
        filters = stage(touched.where("bucket >= 0").unionByName(again), "filters")
        return LineIndex(refs, counts, filters, self.min_docs, self.min_chars, self.shards)

    def probe(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` (key and more) whose key the filters may hold; none that they hold is missed."""
        sizes = self.filters.groupBy("shard").agg(F.max("size").alias("size"))
        asked = _placed(keys, self.shards).join(sizes, "shard")
        jump = (F.col("fp").cast("bigint") * F.lit(0x5BD1E995)).bitwiseAND(F.lit(0x7FFFFFFF))
        mask = F.col("size") - 1
        first = F.col("home").bitwiseAND(mask)
        both = F.array_distinct(F.array(first, first.bitwiseXOR(jump).bitwiseAND(mask)))
        hits = asked.withColumn("bucket", F.explode(both)).join(self.filters.drop("size"), ["shard", "bucket"])
        hits = hits.where(F.array_contains("slots", F.col("fp")))
        return hits.select(*keys.columns).distinct()

    def clean(self, docs: DataFrame) -> DataFrame:
        """``docs`` (doc_id, text and any others) with kept_text and n_dropped: lines whose key at least
        ``min_docs`` documents hold go, but stay in the document of the largest id that holds it.

        Null text counts as one empty line. A row without id counts as no document: it gives no reference
        and keeps no frequent line. Repeated rows count as one document and are cleaned each.
        """
        names = docs.columns
        rows = docs.withColumn("_line_row", F.xxhash64("doc_id", "text"))
        asked = rows.select("doc_id", "_line_row", F.explode(keys_of(F.col("text"), self.min_chars)).alias("key")).distinct()
        gone = (self.probe(asked).join(self.frequent().select("key", "keeper"), "key")
                .where(~F.col("doc_id").eqNullSafe(F.col("keeper"))))
        per_row = gone.groupBy(F.col("doc_id").alias("_line_id"), F.col("_line_row").alias("_line_of")).agg(F.collect_list("key").alias("_line_gone"))
        joined = rows.join(per_row, (F.col("_line_row") == F.col("_line_of")) & F.col("doc_id").eqNullSafe(F.col("_line_id")), "left")
        return joined.withColumn("_line_left", without(F.col("text"), F.col("_line_gone"))).select(*names, "_line_left.kept_text", "_line_left.n_dropped")


def empty_index(spark: SparkSession, id_type: str = "bigint", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                shards: int = SHARDS) -> LineIndex:
    def none(columns: str) -> DataFrame:     # without the Python workers that an empty list would start
        kinds = (c.split() for c in columns.split(", "))
        return spark.range(0).select(*[F.lit(None).cast(kind).alias(c) for c, kind in kinds])

    return LineIndex(none(f"key binary, doc_id {id_type}, n bigint"), none(f"key binary, n_docs bigint, keeper {id_type}"),
                     none(_BUCKETS), min_docs, min_chars, shards)


def dedup(docs: DataFrame) -> DataFrame:
    """Insert all of ``docs`` into an empty index and clean them by it. The number of shards follows the rows."""
    spark = docs.sparkSession
    shards = max(SHARDS, docs.count() // 100_000)
    held = docs.select("doc_id", "text")
    index = empty_index(spark, docs.schema["doc_id"].dataType.simpleString(), shards=shards).insert(held)
    return index.clean(docs)


_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, rid,
    unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos
    FROM (SELECT doc_id, text, row_number() OVER () AS rid FROM documents) d),
k AS (SELECT rid, doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, f.key IS NOT NULL AND (k.doc_id IS NULL OR k.doc_id <> keeper) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id
"""


@query("op8_line_dedup", _SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    return cleaned.select("doc_id", n.cast("bigint").alias("n_lines"), F.col("n_dropped"), F.sha2("kept_text", 256).alias("kept_sha256"))
