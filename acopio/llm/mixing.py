"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

A source's documents are dealt to shards and laid end to end in a seeded order; a shard's tokens are cut
into blocks of equal length. Shards get blocks by highest quotients, votes being the blocks their source's
target comes to, and each then takes its quota of blocks by a seeded, evenly spaced choice. A quota above
the shard's blocks takes all of them once and the rest again.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.aggregates import number_rows
from ..operators.joins import attach
from ..session import stage
from .common import table
from .registry import query

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2     # of all tokens; of a source's own tokens
BLOCK = 8                # tokens of a block
SHARD_ROWS = 20_000      # documents that a shard has on average
SLICE = 500              # documents whose words a task holds at once
SEED = 42
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add ``target`` to (source, source_size, ...): ``share`` of all tokens by weight, in order of the sources
    (code points, null last) and the weights repeating; a target stops at ``most`` times the source's size and
    the excess is shared again by weight until none is above."""
    ordered = number_rows(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_rank", 0).drop("_null")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int")).cast("double")
    weighted = stage(ordered.withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(most)), "weighted")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, below = 0.0, None
    while True:
        full = F.col("_w") * level > F.col("_cap")
        got = weighted.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0.0)).alias("c"),
                           F.sum(F.when(full, 0.0).otherwise(F.col("_w"))).alias("w"), F.count_if(full).alias("n")).first()
        if got["n"] == below or not got["w"]:
            break
        level, below = (share * total - got["c"]) / got["w"], got["n"]
    return weighted.withColumn("target", F.least(F.col("_w") * level, F.col("_cap"))).drop("_w", "_cap", "_rank")


def apportion(parties: DataFrame, seats: int) -> DataFrame:
    """Add ``seats`` to (party, votes): Sainte-Laguë by highest quotients votes / (k - 1/2), ties to the smaller
    party. The quotient that divides takers from the rest is narrowed by counting seats for many candidates in
    one pass; only the few quotients inside the last interval are ranked."""
    live = parties.where("votes > 0")
    stats = live.agg(F.sum("votes").alias("v"), F.count(F.lit(1)).alias("n")).first()
    if not stats["n"] or seats <= 0:
        return parties.withColumn("seats", F.lit(0).cast("bigint"))

    def won(q: float) -> Column:
        return F.floor(F.col("votes") / F.lit(q) + 0.5).cast("bigint")

    low, high = stats["v"] / (seats + stats["n"]), 2.0 * stats["v"] + 1.0
    for _ in range(6):
        step = (high / low) ** (1 / 33)
        grid = [low * step ** i for i in range(1, 33)]
        counts = live.agg(*[F.sum(won(q)).alias(f"s{i}") for i, q in enumerate(grid)]).first()
        for q, n in zip(grid, counts):
            if n > seats:
                low = max(low, q)
            else:
                high = min(high, q)
                break
    base = live.withColumn("_base", won(high)).withColumn("_next", won(low))
    left = seats - base.agg(F.sum("_base")).first()[0]
    more = base.where("_next > _base").select("party", "votes", F.explode(F.sequence(F.col("_base") + 1, F.col("_next"))).alias("k"))
    last = more.orderBy(F.desc(F.col("votes") / (F.col("k") - 0.5)), "party").limit(left).groupBy("party").agg(F.count(F.lit(1)).alias("_more"))
    won_all = base.join(last, "party", "left").select("party", (F.col("_base") + F.coalesce("_more", F.lit(0))).alias("seats"))
    return parties.join(won_all, "party", "left").withColumn("seats", F.coalesce("seats", F.lit(0)).cast("bigint"))


def chosen_before(at: Column, n_blocks: Column, extra: Column, phase: Column, block: int) -> Column:
    """Tokens of the chosen blocks before token ``at`` of a shard: block k is chosen if the whole part of
    (k * extra + phase) / n_blocks steps up behind it; the last block also takes the remainder."""
    k = F.least(F.expr("0L") + F.floor(at / block), n_blocks - 1)
    before = F.floor((k * extra + phase) / n_blocks)
    this = F.floor(((k + 1) * extra + phase) / n_blocks) - before
    return (before * block + this * (at - k * block)).cast("bigint")


def plan(docs: DataFrame, block: int = BLOCK, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS,
         share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source; others stay and must not start with ``mix_``): mix_size,
    mix_source_size, mix_target, mix_taken and the choice behind it (mix_start, mix_blocks, mix_whole, mix_extra,
    mix_phase).

    A null text has no tokens and nothing is taken of it; a null source is a source of its own, the last; rows
    that repeat are mixed each; an empty table stays empty. The same rows always give the same result.
    """
    names = docs.columns
    rows = docs.withColumns({"mix_size": n_tokens(F.col("text")), "mix_null": F.col("source").isNull(),
                             "mix_source": F.coalesce(F.col("source"), F.lit(""))})
    sizes = rows.groupBy("mix_null", "mix_source", "source").agg(F.sum("mix_size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goals = stage(targets(sizes, weights, share, most), "targets").select(
        "mix_null", "mix_source", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
        F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("mix_shards"))
    dealt = attach(rows, goals, ["mix_null", "mix_source"], "left", ready=True).withColumn(
        "mix_shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("mix_shards")).cast("int"))
    key = ["mix_null", "mix_source", "mix_shard"]
    shards = dealt.groupBy(*key).agg(F.sum("mix_size").alias("shard_size"), F.first("mix_target").alias("t"),
                                     F.first("mix_source_size").alias("s"))
    blocks = F.greatest(F.lit(1), F.floor(F.col("shard_size") / block)).cast("bigint")
    votes = F.when(F.col("s") > 0, F.col("t") / F.col("s") * F.col("n_blocks")).otherwise(0.0)
    # the party is the shard's place in order: its source, then its number
    shards = stage(shards.withColumn("n_blocks", blocks).withColumn("votes", votes).withColumn(
        "party", F.struct(*key)), "shards")
    seats = round(shards.agg(F.sum("votes")).first()[0] or 0)
    quota = F.least(F.col("seats"), most * F.col("n_blocks"))
    quotas = apportion(shards, seats).select(
        *key, F.col("n_blocks").alias("mix_blocks"), F.floor(quota / F.col("n_blocks")).cast("bigint").alias("mix_whole"),
        (quota % F.col("n_blocks")).alias("mix_extra"),
        F.pmod(F.xxhash64(F.lit(seed), "mix_source", "mix_shard"), F.col("n_blocks")).alias("mix_phase"))
    order = Window.partitionBy(*key).orderBy("mix_order", "doc_id", "mix_size").rowsBetween(Window.unboundedPreceding, 0)
    slim = dealt.withColumn("mix_order", F.xxhash64(F.lit(seed), "doc_id"))
    laid = slim.withColumn("mix_start", F.sum("mix_size").over(order) - F.col("mix_size"))
    out = attach(laid, stage(quotas, "quotas"), key, "left", ready=True)
    chosen = [chosen_before(x, F.col("mix_blocks"), F.col("mix_extra"), F.col("mix_phase"), block)
              for x in (F.col("mix_start"), F.col("mix_start") + F.col("mix_size"))]
    out = out.withColumn("mix_taken", F.col("mix_whole") * F.col("mix_size") + chosen[1] - chosen[0])
    return out.select(*names, "mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_start", "mix_blocks",
                      "mix_whole", "mix_extra", "mix_phase")


def _chosen_text(text: str, start: int, n: int, extra: int, phase: int, block: int) -> str:
    """The runs of words of ``text``, whose first word is token ``start`` of its shard, that chosen blocks hold."""
    runs: list[list[int]] = []
    for i, m in enumerate(_WORD.finditer(text)):
        k = min((start + i) // block, n - 1)
        if ((k + 1) * extra + phase) // n > (k * extra + phase) // n:
            if runs and runs[-1][2] == i - 1:
                runs[-1][1:] = [m.end(), i]
            else:
                runs.append([m.start(), m.end(), i])
    return "\n".join(text[a:b] for a, b, _ in runs)


def mixed_texts(planned: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of the mix from ``plan``'s result: each document as often as all blocks are taken, and once
    more with the words of its blocks that are taken again; documents of which nothing is taken are absent."""
    @F.arrow_udf("array<string>")
    def copies(text: pa.Array, start: pa.Array, n: pa.Array, whole: pa.Array, extra: pa.Array, phase: pa.Array) -> pa.Array:
        pa.default_memory_pool().release_unused()     # what the last batch left
        parts = [pa.array([], pa.list_(pa.string()))]
        for at in range(0, len(text), SLICE):
            out = []
            for row in zip(*(c.slice(at, SLICE) for c in (text, start, n, whole, extra, phase))):
                t, s, b, w, e, p = (x.as_py() for x in row)
                part = _chosen_text(t or "", s, b, e, p, block) if e else ""
                out.append([t] * (w if t and _WORD.search(t) else 0) + [part] * bool(part))
            parts.append(pa.array(out, pa.list_(pa.string())))
        return pa.concat_arrays(parts)

    names = [c for c in planned.columns if not c.startswith("mix_")]
    made = copies("text", "mix_start", "mix_blocks", "mix_whole", "mix_extra", "mix_phase")
    return planned.withColumn("text", F.explode(made)).select(*names)


@query("op3_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                             F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))
