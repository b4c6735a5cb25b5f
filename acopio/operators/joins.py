"""Lookups and referential checks.

A lookup side is broadcast only after its size has been measured. Past that size the lookup is
copied once per salt and the large side spread over the salts, so one hot key is shared by many
tasks and the result stays whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_key
from ..session import pin, stage
from .aggregates import number_rows
from .counts import Counts

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALTS = 32


def fits_broadcast(df: DataFrame, rows: int | None = None, nbytes: int | None = None) -> bool:
    """Measure: at most ``rows`` rows and ``nbytes`` bytes of text."""
    rows = BROADCAST_ROWS if rows is None else rows
    nbytes = BROADCAST_BYTES if nbytes is None else nbytes
    width = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in df.columns]
    total = reduce(lambda a, b: a + b, width)
    got = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("b")).first()
    return got["n"] <= rows and (got["b"] or 0) <= nbytes


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", salts: int = SALTS,
           ready: bool = False) -> DataFrame:
    """Equi-join of a large side with a lookup that has one row per key.

    The lookup is computed once (``ready=True`` says it already is a table), measured, and then
    broadcast or salted.
    """
    small = small if ready else pin(small)
    if fits_broadcast(small):
        return big.join(F.broadcast(small), on, how)
    return salted(big, small, on, how, salts)


def salted(big: DataFrame, small: DataFrame, on: list[str], how: str, salts: int = SALTS) -> DataFrame:
    """Join that spreads each key of the large side over ``salts`` tasks.

    It is merged by hint: Spark takes the copies for as small as the lookup and would broadcast them all.
    """
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", spread).join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def _parent_keys(column: str, parent: DataFrame, parent_key: str, ready: bool) -> DataFrame:
    """Key column of the parent; a ready parent is a stored dimension with unique keys."""
    keys = parent.select(F.col(parent_key).alias(column)).where(F.col(column).isNotNull())
    return keys if ready else keys.distinct()


def _known(df: DataFrame, column: str, parent: DataFrame, parent_key: str, ready: bool) -> DataFrame:
    """Add ``_known``: true if the key exists in the parent, else null."""
    keys = _parent_keys(column, parent, parent_key, ready).withColumn("_known", F.lit(True))
    return attach(df, keys, [column], "left", ready=ready)


def fk_semi(df: DataFrame, column: str, parent: DataFrame, parent_key: str, ready: bool = False,
            counts: Counts | None = None, among: DataFrame | None = None) -> DataFrame:
    """Rows whose key exists in the parent. ``counts`` gets the rows left out as ``descartadas``.

    ``among`` has, in its one column, every key of ``df``, if they are known, nulls aside, each once; others may be
    there too. Then only the keys that the parent lacks meet the rows.
    """
    if counts is None and among is not None:
        keys = _parent_keys(column, parent, parent_key, ready)
        lacking = among.toDF(column).where(F.col(column).isNotNull()).join(keys.hint("merge"), column, "left_anti")
        return attach(df.where(F.col(column).isNotNull()), lacking, [column], "left_anti")
    if counts is None:
        return attach(df, _parent_keys(column, parent, parent_key, ready), [column], "left_semi", ready=ready)
    out = counts.watch(_known(df, column, parent, parent_key, ready), descartadas=F.col("_known").isNull())
    return out.where("_known").select(*[f"`{c}`" for c in df.columns])


def fk_missing(df: DataFrame, column: str, parent: DataFrame, parent_key: str, ready: bool = False) -> DataFrame:
    """Rows ``fk_semi`` drops (null keys included)."""
    return attach(df, _parent_keys(column, parent, parent_key, ready), [column], "left_anti", ready=ready)


def fk_nullify(df: DataFrame, column: str, parent: DataFrame, parent_key: str, ready: bool = False,
               counts: Counts | None = None) -> DataFrame:
    """Every row kept; a key that does not exist in the parent becomes null. ``counts`` gets those as ``anuladas``."""
    out = _known(df, column, parent, parent_key, ready)
    if counts is not None:
        out = counts.watch(out, anuladas=F.col(column).isNotNull() & F.col("_known").isNull())
    return out.withColumn(column, F.when(F.col("_known"), F.col(column))).select(*df.columns)


def text_lookup(dim: DataFrame, name: str = "nombre", id_col: str = "id",
                parents: list[str] | None = None) -> DataFrame:
    """One id per match key (the largest); a name without letters or digits never matches."""
    parents = parents or []
    keyed = dim.select(match_key(F.col(name)).alias("_key"), *parents, id_col)
    return keyed.where(F.col("_key") != "").groupBy("_key", *parents).agg(F.max(id_col).alias(id_col))


def fk_text(df: DataFrame, source: str, dim: DataFrame, out: str, name: str = "nombre",
            id_col: str = "id", parent: tuple[str, str] | None = None, ready: bool = False,
            texts: DataFrame | None = None) -> DataFrame:
    """Add the id of the dimension row whose name has the same match key; a miss is null.

    ``parent=(column of df, column of dim)`` makes it a lookup on (name, parent id). ``texts`` (source) are the
    distinct texts of ``df``, if they are known: then only those get a key, and the rows are looked up by text.
    """
    lookup = text_lookup(dim, name, id_col, [parent[1]] if parent else None)
    lookup = lookup.withColumnRenamed(id_col, out)
    on = ["_key"]
    if parent:
        lookup = lookup.withColumnRenamed(parent[1], parent[0])
        on.append(parent[0])
    elif texts is not None:
        keyed = texts.select(source, match_key(F.col(source)).alias("_key")).where(F.col(source).isNotNull())
        return attach(df, keyed.join(lookup, "_key").select(source, out), [source], "left").select(*df.columns, out)
    joined = attach(df.withColumn("_key", match_key(F.col(source))), lookup, on, "left", ready=ready)
    return joined.select(*df.columns, out)


def fk_hierarchy(df: DataFrame, levels: list[tuple[str, DataFrame, str | None]], out: str,
                 ready: bool = False) -> DataFrame:
    """Chained lookups down a hierarchy; a miss at any level gives null.

    ``levels`` holds (column of df, dimension, parent column of that dimension or None).
    """
    cur, prev = df, None
    for i, (source, dim, parent_col) in enumerate(levels):
        step = out if i == len(levels) - 1 else f"_level{i}"
        cur = fk_text(cur, source, dim, step, parent=(prev, parent_col) if parent_col else None,
                      ready=ready)
        prev = step
    return cur.select(*df.columns, out)


def outer_merge(frames: list[tuple[DataFrame, str]], keys: list[str]) -> DataFrame:
    """Null-safe full outer merge of measure frames: union, then one sum per key.

    Keys that are null meet each other, a missing measure is 0, and it costs one shuffle however
    many frames there are; partial sums keep a hot key cheap.
    """
    measures = [m for _, m in frames]
    parts = [df.select(*keys, *[(F.col(m) if m == mine else F.lit(None)).cast("bigint").alias(m)
                                for m in measures]) for df, mine in frames]
    merged = reduce(DataFrame.unionByName, parts)
    return merged.groupBy(*keys).agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])


def left_minus(df: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``seen``."""
    return attach(df, seen.select(*on).distinct(), on, "left_anti")


def resolved_corrections(corrections: DataFrame, salts: int = SALTS) -> DataFrame:
    """(columna, _old, _new): what each value becomes when all corrections are applied one after another.

    ``corrections``: columna, valor_actual, valor_canonico, and optionally pos (order), aplicar, invertir; those
    without a value on either side say nothing. A correction hands its result to the next one of its column that
    starts from it, so the corrections form chains that only lead on; every one finds the end of its chain by
    doubling its pointer, in as many rounds as the logarithm of the longest chain. Nothing reaches the driver.
    """
    have = set(corrections.columns)
    wanted = corrections.where(F.col("aplicar")) if "aplicar" in have else corrections
    turned = F.coalesce(F.col("invertir"), F.lit(False)) if "invertir" in have else F.lit(False)
    rules = wanted.where("columna IS NOT NULL AND valor_actual IS NOT NULL AND valor_canonico IS NOT NULL").select(
        F.col("pos") if "pos" in have else F.monotonically_increasing_id().alias("pos"), "columna",
        F.when(turned, F.col("valor_canonico")).otherwise(F.col("valor_actual")).alias("src"),
        F.when(turned, F.col("valor_actual")).otherwise(F.col("valor_canonico")).alias("dst")).where("src <> dst")
    rules = stage(number_rows(rules, ["pos", "columna", "src", "dst"], "i"), "corrections")
    # per value, what ends in it meets what starts from it, latest first; a value many end in is spread over salts
    ends = rules.select("columna", F.col("dst").alias("value"), "i", F.lit(None).cast("bigint").alias("start"),
                        F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int").alias("salt"))
    starts = rules.select("columna", F.col("src").alias("value"), "i", F.col("i").alias("start"),
                          F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    later = Window.partitionBy("columna", "value", "salt").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    led = ends.union(starts).withColumn("next", F.last("start", ignorenulls=True).over(later)).where("start IS NULL")
    at = stage(led.select("i", F.coalesce("next", "i").alias("last")), "chains")
    while True:
        onward = at.select(F.col("i").alias("last"), F.col("last").alias("further"))
        at = stage(at.join(onward, "last").select("i", F.col("further").alias("last"), (F.col("further") != F.col("last")).alias("moved")), "chains")
        if at.where("moved").isEmpty():
            break
        at = at.select("i", "last")
    first = rules.groupBy("columna", "src").agg(F.min("i").alias("i"))
    end = rules.select(F.col("i").alias("last"), F.col("dst").alias("_new"))
    found = first.join(at.select("i", "last"), "i").join(end, "last")
    return found.where("src <> _new").select("columna", F.col("src").alias("_old"), "_new")


def apply_corrections(df: DataFrame, corrections: DataFrame, scope: Column | None = None) -> DataFrame:
    """Replace values by the reviewed corrections (see ``resolved_corrections``), in report order, only inside the
    scope."""
    mapping = pin(resolved_corrections(corrections))
    # columns of the table, at most
    touched = {r[0] for r in mapping.where(F.col("columna").isin(df.columns)).select("columna").distinct().collect()}
    out = df
    for c in [c for c in df.columns if c in touched]:
        table = mapping.where(F.col("columna") == c).select(F.col("_old").alias("_match"), "_new")
        out = attach(out.withColumn("_match", F.col(f"`{c}`")), table, ["_match"], "left", ready=True)
        new = F.coalesce(F.col("_new"), F.col(f"`{c}`"))
        if scope is not None:
            new = F.when(scope, new).otherwise(F.col(f"`{c}`"))
        out = out.withColumn(c, new).drop("_match", "_new")
    return out.select(*[f"`{c}`" for c in df.columns])
