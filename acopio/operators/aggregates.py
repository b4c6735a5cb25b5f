"""Aggregates, rankings and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def first_non_empty(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Per key, each column's first value that is not null, in ``order`` (a BIGINT).

    Equal (key, values) rows collapse to their smallest order in a hash aggregate with map-side
    combine; only the distinct combinations reach the per-column choice.
    """
    combos = df.groupBy(key, *columns).agg(F.min(order).alias("_ord"))
    first = [F.min(F.when(_c(c).isNotNull(), F.struct("_ord", _c(c).alias("v")))).getField("v").alias(c)
             for c in columns]
    return combos.groupBy(key).agg(*first)


def distinct_first(df: DataFrame, column: str, order: str, collation: str = "UNICODE_CI_AI_RTRIM",
                   by: list[str] | None = None) -> DataFrame:
    """Distinct texts, first spelling wins among texts equal but for case, accents and tail blanks.

    Result: (by..., column, _ord) with the order of the first appearance.
    """
    by = by or []
    exact = df.where(_c(column).isNotNull()).groupBy(*by, column).agg(F.min(order).alias("_ord"))
    best = F.min(F.struct("_ord", _c(column).alias("v"))).alias("_best")
    return (exact.groupBy(*by, F.collate(_c(column), collation).alias("_ci")).agg(best)
            .select(*by, F.col("_best.v").alias(column), F.col("_best._ord").alias("_ord")))


def number_rows(df: DataFrame, order: list[str], id_col: str = "id", start: int = 1) -> DataFrame:
    """Dense ids in the given order.

    Rows are dealt into ranges of the whole order, so rows that share its first column are split
    too, sorted inside each range and stored once; a row's id is its place in its range plus the
    rows of the ranges before it. No task holds more than one range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(ranged.withColumns({
        "_part": F.spark_partition_id(),
        "_at": F.expr("monotonically_increasing_id() & 8589934591")}), "numbered")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    numbered = placed.join(F.broadcast(shifts), "_part").withColumn(
        id_col, (F.col("_shift") + F.col("_at") + start).cast("bigint"))
    return numbered.select(*df.columns, id_col)


def unpivot_text(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., columna, valor) with one row per cell."""
    keep = keep or []
    return df.select(*keep, *[_c(c).cast("string").alias(c) for c in columns]).unpivot(
        keep, columns, "columna", "valor")


def value_counts(df: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """(columna, valor, frecuencia[, primera]) for all columns in one pass; nulls not counted."""
    cells = unpivot_text(df, columns, [order] if order else None).where("valor IS NOT NULL")
    aggs = [F.count(F.lit(1)).alias("frecuencia")]
    if order:
        aggs.append(F.min(order).alias("primera"))
    return cells.groupBy("columna", "valor").agg(*aggs)


def column_cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    return value_counts(df, columns).groupBy("columna").agg(F.count(F.lit(1)).alias("distintos"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(columna, nulos), one scan."""
    row = df.agg(*[F.count_if(_c(c).isNull()).alias(c) for c in columns])
    return row.unpivot([], columns, "columna", "nulos")


def top_n(df: DataFrame, partition: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First n rows per group; the limit is applied per task before the shuffle."""
    name = rank or "_rank"
    w = Window.partitionBy(*partition).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def n_largest(df: DataFrame, measure: str, position: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(measure), F.asc(position)).limit(n)


def top_values(df: DataFrame, columns: list[str], order: str, k: int, rank: str = "pos") -> DataFrame:
    """The k most frequent values per column, ties by first appearance."""
    counts = value_counts(df, columns, order)
    return top_n(counts, ["columna"], [F.desc("frecuencia"), F.asc("primera"), F.asc("valor")], k, rank)


SPLITS = 1024     # parts that an interval of values is cut into per pass, ten bits


def _binade(v: Column) -> Column:
    """Which power of two a double is of, in the order of the doubles; NaN is the largest."""
    of = lambda x: 2000 + F.floor(F.log2(x)).cast("int")
    inf = F.lit(float("inf"))
    return (F.when(F.isnan(v), 5000).when(v == inf, 4000).when(v == -inf, -4000).when(v > 0, of(v))
            .when(v < 0, -of(-v)).otherwise(0))


def quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: (columna, prob, valor).

    Radix selection: the values are counted by their power of two, then, inside the intervals that hold a wanted
    rank, by ten more bits a pass, until each interval is one value. A pass reads the columns and brings back a
    bounded number of counts; values are neither ordered nor stored.
    """
    nums = df.select(*[_c(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "columna", "v").where("v IS NOT NULL")
    counts = [F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    spark, keys = df.sparkSession, "columna string, low double, high double"
    # per column at most one row for each power of two
    cells = nums.groupBy("columna", _binade(F.col("v")).alias("at")).agg(*counts).collect()
    by_column: dict[str, list] = {}
    for r in sorted(cells, key=lambda r: (r["columna"], r["at"])):
        by_column.setdefault(r["columna"], []).append(r)
    wanted, found, open_ = [], {}, {}
    for c, parts in by_column.items():
        total = sum(r["n"] for r in parts)
        for p in probs:
            at = float(p) * (total - 1)
            wanted.append((c, float(p), int(at), -int(-at // 1), at - int(at)))
        for rank in {x for w in wanted if w[0] == c for x in w[2:4]}:
            open_[(c, rank)] = (parts, 0)
    while open_:
        spans: dict[tuple, list] = {}
        for (c, rank), (parts, base) in open_.items():
            for r in parts:
                if rank < base + r["n"]:
                    break
                base += r["n"]
            if r["lo"] == r["hi"] or r["lo"] != r["lo"]:
                found[(c, rank)] = r["lo"]
            else:
                spans.setdefault((c, r["lo"], r["hi"]), []).append((rank, base))
        open_ = {}
        if not spans:
            break
        # at most two intervals for each wanted quantile
        table = F.broadcast(spark.createDataFrame(list(spans), keys))
        inside = nums.join(table.withColumnRenamed("columna", "_c"), (F.col("columna") == F.col("_c")) & F.col("v").between(F.col("low"), F.col("high")))
        part = F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * (SPLITS - 1)).cast("int").alias("at")
        cut: dict[tuple, list] = {}
        for r in inside.groupBy("columna", "low", "high", part).agg(*counts).collect():
            cut.setdefault((r["columna"], r["low"], r["high"]), []).append(r)
        for key, ranks in spans.items():
            parts = sorted(cut[key], key=lambda r: r["at"])
            for rank, base in ranks:
                open_[(key[0], rank)] = (parts, base)
    rows = [(c, p, found[(c, lo)] if lo == hi else found[(c, lo)] * (1 - part) + found[(c, hi)] * part) for c, p, lo, hi, part in wanted]
    return spark.createDataFrame(rows, "columna string, prob double, valor double")


def describe(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, rounded."""
    nums = df.select(*[_c(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "columna", "v")
    basic = nums.groupBy("columna").agg(
        F.count("v").alias("count"), F.round(F.avg("v"), digits).alias("mean"),
        F.round(F.stddev_samp("v"), digits).alias("std"), F.round(F.min("v"), digits).alias("min"),
        F.round(F.max("v"), digits).alias("max"))
    q = quantiles(df, columns, [0.25, 0.5, 0.75])
    wide = q.groupBy("columna").agg(*[
        F.round(F.max(F.when(F.col("prob") == p, F.col("valor"))), digits).alias(name)
        for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return basic.join(wide, "columna", "left")
