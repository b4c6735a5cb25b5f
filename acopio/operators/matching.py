"""Matching of headers to a canonical schema, and spelling variants inside a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.fold import match_key_text
from ..functions.similarity import key_ratio_at_least, key_similarity
from ..functions.text import clean_header, clean_header_text, match_key
from ..session import pin, stage
from .aggregates import column_cardinality, top_n, top_values, value_counts
from .joins import attach


def _has_any(key: Column, words: list[str]) -> Column:
    return key.rlike("|".join(words))


def _both_sex(a: Column, b: Column) -> Column:
    ids = F.startswith(a, F.lit("id")) | F.startswith(b, F.lit("id"))
    return ~ids & _has_any(a, K.SEX_HEADER_WORDS) & _has_any(b, K.SEX_HEADER_WORDS)


def _alias(a: Column, b: Column) -> Column:
    hit = F.lit(False)
    for x, y in K.HEADER_STEM_PAIRS:
        hit = hit | (F.contains(a, F.lit(x)) & F.contains(b, F.lit(y)))
        hit = hit | (F.contains(b, F.lit(x)) & F.contains(a, F.lit(y)))
    for group in K.HEADER_ALIAS_GROUPS:
        hit = hit | (a.isin(group) & b.isin(group))
    return hit


def header_score(canon_key: Column, new_key: Column, new_name: Column) -> Column:
    """Exact key, then sex/gender pair, then alias, then similarity; a lone ``id`` word costs."""
    base = (F.when(canon_key == new_key, K.SCORE_EXACT)
            .when(_both_sex(canon_key, new_key), K.SCORE_SEX)
            .when(_alias(canon_key, new_key), K.SCORE_ALIAS)
            .otherwise(key_similarity(canon_key, new_key)))
    return F.when(new_name.rlike("(?U)\\bid\\b"), base * K.ID_PENALTY).otherwise(base)


def match_scores(headers: DataFrame, canonical: list[str], by: list[str],
                 threshold: float = K.MATCH_THRESHOLD) -> DataFrame:
    """(by..., canon_idx, src_idx, canon, name, sim) for pairs at or above the threshold.

    ``headers``: (by..., pos, name). Each distinct header text unfolds against the fixed canonical
    list (a few dozen names) and is scored once, then scores go back to the files by text; there
    is no cross join, and files that share headers share the work.
    """
    canon = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.lit(match_key_text(c)).alias("k"))
                      for i, c in enumerate(clean_header_text(h) for h in canonical)])
    src = headers.select(*by, F.col("pos").alias("src_idx"), clean_header(F.col("name")).alias("name"))
    names = src.select("name").distinct().withColumn("_key", match_key(F.col("name")))
    pairs = names.select("name", "_key", F.explode(canon).alias("_c"))
    scored = pairs.select("name", F.col("_c.i").alias("canon_idx"), F.col("_c.c").alias("canon"),
                          header_score(F.col("_c.k"), F.col("_key"), F.col("name")).alias("sim"))
    kept = pin(scored).where(F.col("sim") >= threshold)
    return attach(src, kept, ["name"], "inner", ready=True).select(
        *by, "canon_idx", "src_idx", "canon", "name", "sim")


def match_columns(scores: DataFrame, by: list[str], n_canonical: int) -> DataFrame:
    """Greedy one-to-one assignment by falling score, ties in (canonical, source) order.

    At most ``n_canonical`` source columns can ever be assigned, so a canonical column's best
    ``n_canonical`` candidates contain its final partner whatever the others take. Keeping those
    bounds a file's list by n_canonical squared, and one fold over it settles the assignment.
    """
    pruned = top_n(scores.select(*by, "canon_idx", "src_idx", "sim"), [*by, "canon_idx"],
                   [F.desc("sim"), F.asc("src_idx")], n_canonical)
    pair = F.struct((-F.col("sim")).alias("s"), F.col("canon_idx").alias("i"), F.col("src_idx").alias("j"))
    empty = F.array().cast("array<struct<s:double,i:int,j:int>>")
    taken = F.aggregate(
        F.array_sort(F.collect_list(pair)), empty,
        lambda acc, p: F.when(F.exists(acc, lambda q: (q["i"] == p["i"]) | (q["j"] == p["j"])), acc)
        .otherwise(F.concat(acc, F.array(p))))
    return pruned.groupBy(*by).agg(taken.alias("m")).select(*by, F.explode("m").alias("p")).select(
        *by, F.col("p.i").alias("canon_idx"), F.col("p.j").alias("src_idx"), (-F.col("p.s")).alias("sim"))


def mapping_arrays(assigned: DataFrame, by: list[str], n_canonical: int) -> DataFrame:
    """(by..., mapping): source index per canonical position, null where nothing matched."""
    as_map = F.map_from_entries(F.collect_list(F.struct("canon_idx", "src_idx")))
    places = F.array(*[F.lit(i) for i in range(n_canonical)])
    return assigned.groupBy(*by).agg(as_map.alias("_m")).select(
        *by, F.transform(places, lambda i: F.try_element_at("_m", i)).alias("mapping"))


def _variant_values(df: DataFrame, columns: list[str], order: str, max_distinct: int | None, top: int | None) -> DataFrame:
    """(columna, valor, frecuencia, k, o): every value with its match key and its rank, the most frequent and then
    the first seen smallest. Only a caller's own limits leave values out."""
    counts = value_counts(df, columns, order) if top is None else top_values(df, columns, order, top)
    if max_distinct is not None:
        few = column_cardinality(df, columns).where(F.col("distintos") <= max_distinct).select("columna")
        counts = counts.join(F.broadcast(few), "columna", "left_semi")    # one row per column
    rank = F.struct((-F.col("frecuencia")).alias("f"), F.col("primera").alias("p"), F.col("valor").alias("v"))
    return stage(counts.select("columna", "valor", "frecuencia", match_key(F.col("valor")).alias("k"), rank.alias("o")), "values")


SPARE = (1, 2, 4, 8)    # segments that must agree; a column takes the fewest that keep its keys from crowding
CROWD = 20              # meetings per key from which on another number is tried


def similar_keys(keys: DataFrame, threshold: float) -> DataFrame:
    """(columna, a, b): each pair of different keys of a column with a ratio from the threshold on, once.

    ``keys`` (columna, k) are distinct. Only pairs that ``meeting_keys`` finds are verified.
    """
    met = meeting_keys(keys, threshold).where(key_ratio_at_least(F.col("a"), F.col("b"), threshold))
    return met.select("columna", "a", "b").distinct()


def meeting_keys(keys: DataFrame, threshold: float) -> DataFrame:
    """(columna, a, b): the pairs of keys that can be similar enough, some more than once.

    The longer key is cut into d + s segments, d being the distance allowed: at least s of them stand in the shorter
    one, moved by no more than the errors allow. So one of its d + 1 rarest segments does, and keys meet on those
    alone, on the segment, its number and the longer key's length. With s = 1 all segments are used; a column in
    which many keys share a segment (a common first word) takes a larger s, and with it leaves out its s - 1 most
    common segments of each key, until its keys meet few others.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")

    def errors(n: Column) -> Column:
        return F.floor(n * F.lit(1 - threshold) + F.lit(1e-9)).cast("int")

    def cut(rows: DataFrame) -> DataFrame:
        """Rows (n, s, ...) with a row for each segment of a key of length n."""
        d = errors(F.col("n"))
        parts = rows.withColumns({"d": d, "parts": d + F.greatest(F.lit(1), F.least("s", F.col("n") - d))})
        each = parts.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        start = lambda i: F.floor(i * F.col("n") / F.col("parts")).cast("int")
        return each.withColumn("at", start(F.col("i"))).withColumn("size", start(F.col("i") + 1) - F.col("at"))

    def posted(sized: DataFrame, s: int) -> DataFrame:
        """The d + 1 rarest segments of each key, with how many keys share each."""
        place = ["columna", "s", "n", "i", "seg"]
        held = cut(sized.withColumn("s", F.lit(s)).select("columna", "s", F.col("k").alias("b"), F.col("m").alias("n"))).select(
            "columna", "s", "n", "i", F.substring("b", F.col("at") + 1, F.col("size")).alias("seg"), "b", "d", "parts")
        shared = held.join(held.groupBy(*place).agg(F.count(F.lit(1)).alias("shared")), place)
        if s > 1:
            rank = F.row_number().over(Window.partitionBy("columna", "b").orderBy("shared", "i"))     # segments of one key
            shared = shared.withColumn("rank", rank).where(F.col("rank") <= F.col("d") + 1)
        return shared.select(*place, "b", "shared")

    sized = keys.where("k <> ''").select("columna", "k", F.char_length("k").alias("m"))
    held = stage(posted(sized, SPARE[0]), "segments")
    for last, s in zip(SPARE, SPARE[1:]):
        # per column, the meetings that its segments make
        load = held.where(F.col("s") == last).groupBy("columna", "s").agg(F.sum(F.col("shared").cast("double")).alias("met"), F.count_distinct("b").alias("keys"))
        crowded = pin(load.where(F.col("met") > CROWD * F.col("keys")).select("columna"))
        if crowded.isEmpty():
            break
        more = sized.join(F.broadcast(crowded), "columna", "left_semi")       # one row per column
        held = stage(held.unionByName(posted(more, s)), "segments")
    load = held.groupBy("columna", "s").agg(F.sum(F.col("shared").cast("double")).alias("met"))
    best = pin(load.groupBy("columna").agg(F.min(F.struct("met", "s")).getField("s").alias("s")))
    held = held.join(F.broadcast(best), ["columna", "s"], "left_semi").select("columna", "n", "i", "seg", "b")
    reach = F.floor(F.col("m") / F.lit(threshold) + F.lit(1e-9)).cast("int")
    asked = cut(sized.join(F.broadcast(best), "columna").withColumn("n", F.explode(F.sequence("m", reach))))
    moved, after = F.col("m") - F.col("n"), F.col("d") - F.col("i")
    # with d + 1 segments one has its number of errors at most before it; with more, errors before and behind add up to d
    alone = F.col("parts") == F.col("d") + 1
    low = F.greatest(F.lit(0), F.when(alone, F.greatest(F.col("at") - F.col("i"), F.col("at") + moved - after)).otherwise(
        F.col("at") + F.ceil((moved - F.col("d")) / 2)))
    high = F.least(F.col("m") - F.col("size"), F.when(alone, F.least(F.col("at") + F.col("i"), F.col("at") + moved + after)).otherwise(
        F.col("at") + F.floor((moved + F.col("d")) / 2)))
    asked = asked.withColumns({"low": low.cast("int"), "high": high.cast("int")}).where("low <= high").withColumn(
        "p", F.explode(F.sequence("low", "high"))).select(
        "columna", "n", "i", F.substring("k", F.col("p") + 1, F.col("size")).alias("seg"), F.col("k").alias("a"), "m")
    once = (F.col("m") < F.col("n")) | (F.col("a") < F.col("b"))
    return asked.join(held, ["columna", "n", "i", "seg"]).where((F.col("a") != F.col("b")) & once).select("columna", "a", "b")


def _leaders(keys: DataFrame, earlier: DataFrame) -> DataFrame:
    """(columna, k, lead) of every key: a key leads unless an earlier similar key does.

    ``earlier`` (columna, k, e): the similar keys before a key. A round settles the keys whose earlier ones
    are all settled or one of which leads; the first open key of a column always is among them.
    """
    state = stage(keys.join(earlier.select("columna", "k").distinct().withColumn("late", F.lit(True)), ["columna", "k"], "left")
                  .select("columna", "k", F.when(F.col("late").isNull(), F.lit(True)).alias("lead")), "leaders")
    while not state.where("lead IS NULL").isEmpty():
        before = state.select("columna", F.col("k").alias("e"), "lead")
        seen = earlier.join(before, ["columna", "e"]).groupBy("columna", "k").agg(
            F.count_if("lead").alias("leading"), F.count_if(F.col("lead").isNull()).alias("open"))
        settled = F.coalesce("lead", F.when(F.col("leading") > 0, False).when(F.col("open") == 0, True))
        state = stage(state.join(seen, ["columna", "k"], "left").select("columna", "k", settled.alias("lead")), "leaders")
    return state


def variant_report(df: DataFrame, columns: list[str], order: str, threshold: float = K.VARIANT_THRESHOLD,
                   max_distinct: int | None = None, top: int | None = None) -> DataFrame:
    """Spelling variants per column: a value joins the first leader it is similar enough to.

    All values of all columns are compared unless the caller limits them. Values with one key share
    their neighbours, so the first of them stands for all.
    """
    values = _variant_values(df, columns, order, max_distinct, top)
    keys = stage(values.groupBy("columna", "k").agg(F.min("o").alias("o")), "keys")
    pairs = similar_keys(keys.select("columna", "k"), threshold)
    ranked = (pairs.join(keys.select("columna", F.col("k").alias("a"), F.col("o").alias("oa")), ["columna", "a"])
              .join(keys.select("columna", F.col("k").alias("b"), F.col("o").alias("ob")), ["columna", "b"]))
    first = F.col("oa") < F.col("ob")
    earlier = stage(ranked.select("columna", F.when(first, F.col("b")).otherwise(F.col("a")).alias("k"),
                                  F.when(first, F.col("a")).otherwise(F.col("b")).alias("e"), F.least("oa", "ob").alias("o")), "earlier")
    state = _leaders(keys.select("columna", "k"), earlier.select("columna", "k", "e"))
    leading = state.where("lead").select("columna", "k")
    joined = earlier.join(leading.withColumnRenamed("k", "e"), ["columna", "e"]).groupBy("columna", "k").agg(F.min("o").alias("to"))
    joined = joined.join(leading, ["columna", "k"], "left_anti").unionByName(
        keys.join(leading, ["columna", "k"]).select("columna", "k", F.col("o").alias("to")))
    return values.join(joined, ["columna", "k"]).where(F.col("valor") != F.col("to.v")).select(
        "columna", F.col("valor").alias("valor_actual"), F.col("to.v").alias("valor_canonico"),
        F.col("frecuencia").alias("frecuencia_actual"), (-F.col("to.f")).alias("frecuencia_canonico"))


def fuzzy_pairs(df: DataFrame, columns: list[str], order: str, threshold: float = K.VARIANT_THRESHOLD,
                max_distinct: int | None = None, top: int | None = None) -> DataFrame:
    """All similar pairs of values: (columna, a, b), the more frequent first."""
    values = _variant_values(df, columns, order, max_distinct, top).select("columna", "k", "o")
    x = values.select("columna", F.col("k").alias("a"), F.col("o").alias("x"))
    y = values.select("columna", F.col("k").alias("b"), F.col("o").alias("y"))
    near = similar_keys(values.select("columna", "k").distinct(), threshold)
    apart = near.join(x, ["columna", "a"]).join(y, ["columna", "b"]).select("columna", "x", "y")
    alike = x.join(y.withColumnRenamed("b", "a"), ["columna", "a"]).where("x < y").select("columna", "x", "y")
    both = apart.unionByName(alike)
    return both.select("columna", F.least("x", "y").getField("v").alias("a"), F.greatest("x", "y").getField("v").alias("b"))
