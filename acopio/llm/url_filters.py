"""URL filters: given prefix rules first, then association rules mined from labelled URLs.

Mining: a labelled URL is a basket of its tokens and its label; Spark's FP-growth finds the frequent token
combinations of the blocked ones, rules ``tokens -> block`` are kept by support and confidence, and a rule that a
part of it already states at least as confidently is pruned. Matching: each rule is posted under its
rarest token only; a URL looks up its tokens in that index and keeps the rules all of whose tokens
it has. No Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import attach
from ..session import stage
from .common import ascii_lower, table
from .registry import query

#: (host, path, verdict). Fixed values of the query's contract.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


@dataclass(frozen=True)
class Mining:
    """Production parameters: least number of labelled URLs that bear a rule out, at every size of the table,
    and its least share of blocked ones."""

    min_count: int = 10
    min_confidence: float = 0.6
    wide: int = 14      # frequent tokens of a blocked basket beyond which FP-growth would list too much


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for none."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: every domain suffix of the host, its labels, and the path's words and depth."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    at = F.sequence(F.lit(1), F.size(labels))
    suffixes = F.when(F.size(labels) > 0, F.transform(
        at, lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    parts = F.filter(F.split(ascii_lower(path), r"[/._\-=&+~]+"), lambda x: x != "")
    named = F.transform(parts, lambda x: F.concat(F.lit("path:"), F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x)))
    return F.array_distinct(F.concat(
        F.coalesce(suffixes, F.array().cast("array<string>")),
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)), named))


def judge_by_rules(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` to rows with ``host`` and ``path``: the longest rule that fits."""
    fits = [F.when(((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p),
                   F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for h, p, v in rules]
    best = fits[0] if len(fits) == 1 else F.greatest(*fits)
    return (pages.withColumn("_best", best).withColumn("rule", F.col("_best.rule"))
            .withColumn("rule_verdict", F.col("_best.verdict")).drop("_best"))


def _kinds(rows: DataFrame, least: int) -> DataFrame:
    """(token, kind): the tokens that stand in at least ``least`` blocked baskets; tokens that always stand together
    are one kind, named by the first of them. ``rows`` (row, tokens, n, b) has each token set once."""
    each = rows.select("row", "n", "b", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(
        F.sum("n").alias("n"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("sets"), F.bit_xor(F.xxhash64("row")).alias("x1"),
        F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("x2")).where(F.col("b") >= least)
    first = seen.groupBy("n", "b", "sets", "x1", "x2").agg(F.min("token").alias("kind"))
    return seen.join(first, ["n", "b", "sets", "x1", "x2"]).select("token", "kind")


def _frequent(rows: DataFrame, least: int) -> DataFrame:
    """(tokens, b): every token combination that stands in at least ``least`` blocked baskets, by Spark's FP-growth.

    ``rows`` (tokens, b) has each token set once with its blocked baskets; each of those is one transaction.
    """
    block = 4096
    some = rows.where("b > 0").select("tokens", "b", F.explode(F.sequence(F.lit(0), F.floor((F.col("b") - 1) / block))).alias("k"))
    baskets = stage(some.select("tokens", F.explode(F.sequence(F.lit(1), F.least(F.lit(block), F.col("b") - F.col("k") * block)))).select("tokens"), "baskets-blocked")
    n = baskets.count()
    if n < least:
        return rows.select("tokens", "b").limit(0)
    # half a basket less, so that rounding cannot ask for one more
    model = FPGrowth(itemsCol="tokens", minSupport=(least - 0.5) / n).fit(baskets)
    return model.freqItemsets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("b"))


def _counted(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """Add ``n``, the baskets that hold all tokens of a set; a set is looked up under its rarest token only."""
    each = rows.select("row", "tokens", "n", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.sum("n").alias("seen"))
    named = sets.withColumn("set", F.array_join("tokens", "\x01"))
    posted = named.select("set", F.explode("tokens").alias("token")).join(seen, "token").groupBy("set").agg(
        F.min(F.struct("seen", "token")).getField("token").alias("token"))
    posted = named.join(posted, "set").select("set", F.col("tokens").alias("body"), "token")
    held = each.join(posted, "token").where(F.size(F.array_except("body", "tokens")) == 0)
    return named.join(held.groupBy("set").agg(F.sum("n").alias("n")), "set").drop("set")


def mine_rules(baskets: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(rule_id, tokens, support, confidence) from ``baskets`` (tokens array, sorted; blocked boolean).

    Support counts baskets that hold the tokens and are blocked; FP-growth finds the combinations among the blocked
    baskets, and their confidence is counted over all of them. A rule stays if it is confident enough and no part
    of it is as confident. Tokens that always stand together count as one, the first of them. Equal baskets are
    kept once with their number until FP-growth takes them.

    FP-growth lists every frequent combination, so a basket of k frequent tokens can give 2 ** k of them: tables with
    baskets of more than ``wide`` such tokens are mined level by level (``grow_rules``), with the same rules.
    """
    rows = baskets.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("blocked").cast("bigint")).alias("b"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "token-sets")
    kinds = stage(_kinds(rows, mining.min_count).where("token = kind").select("token"), "kinds")
    if kinds.isEmpty():
        return _rules(rows.select("tokens", "b", F.lit(1.0).alias("confidence")).limit(0))
    each = rows.select("row", "n", "b", F.explode("tokens").alias("token")).join(kinds, "token", "left_semi")
    rows = stage(each.groupBy("row", "n", "b").agg(F.array_sort(F.collect_list("token")).alias("tokens")), "token-kinds")
    if rows.where("b > 0").agg(F.max(F.size("tokens"))).first()[0] > mining.wide:
        return grow_rules(rows, mining)
    frequent = stage(_frequent(rows, mining.min_count), "frequent-sets")
    sets = stage(_counted(frequent, rows).withColumn("confidence", F.col("b") / F.col("n")), "itemsets")
    # what the parts of a set say: all parts are frequent too, so each size takes it from the one before
    longest = sets.agg(F.max(F.size("tokens"))).first()[0] or 0
    below = sets.where(F.size("tokens") == 1).withColumn("below", F.lit(0.0))
    rules = below
    for size in range(2, longest + 1):
        said = below.select(F.col("tokens").alias("part"), F.greatest("confidence", "below").alias("said"))
        part = F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("part")
        parts = sets.where(F.size("tokens") == size).select("tokens", "b", "n", "confidence", part).join(said, "part")
        below = stage(parts.groupBy("tokens", "b", "n", "confidence").agg(F.max("said").alias("below")), "itemsets-below")
        rules = rules.unionByName(below)
    return _rules(rules.where((F.col("confidence") >= mining.min_confidence) & (F.col("confidence") > F.col("below"))))


def _rules(found: DataFrame) -> DataFrame:
    return stage(found.select("tokens", F.col("b").alias("support"), "confidence", F.array_join("tokens", "\x01").alias("rule_id")), "rules")


def grow_rules(rows: DataFrame, mining: Mining) -> DataFrame:
    """``mine_rules`` without listing all frequent combinations, from ``rows`` (row, tokens, n, b).

    Combinations grow by one token a round, to any length. One goes on only while each of its tokens narrows it
    down and some of its baskets are not blocked: beyond that no longer one could be more confident than its part.
    """
    held = rows.select("row", "n", "b", F.explode("tokens").alias("token")).select(
        "row", "n", "b", F.array("token").alias("tokens"))
    ones = rules = live = None
    while True:
        sets = held.groupBy("tokens").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).where(F.col("b") >= mining.min_count)
        sets = sets.withColumn("confidence", F.col("b") / F.col("n"))
        if live is None:
            sets = sets.withColumn("below", F.lit(0.0))
        else:
            part = F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("part")
            known = live.select(F.col("tokens").alias("part"), F.col("n").alias("pn"), F.greatest("confidence", "below").alias("said"))
            of = sets.select("tokens", "n", "b", "confidence", part).join(known, "part").where("pn > n")
            sets = (of.groupBy("tokens", "n", "b", "confidence").agg(F.max("said").alias("below"), F.count(F.lit(1)).alias("parts"))
                    .where(F.col("parts") == F.size("tokens")).drop("parts"))
        sets = stage(sets, "itemsets")
        found = sets.where((F.col("confidence") >= mining.min_confidence) & (F.col("confidence") > F.col("below")))
        rules = found if rules is None else rules.unionByName(found)
        live = sets.where("confidence < 1")
        if live.isEmpty():
            break
        held = held.join(live.select("tokens"), "tokens", "left_semi")
        if ones is None:
            held = ones = stage(held, "held")
        else:
            held = stage(held, "held")
        more = ones.select("row", F.col("tokens")[0].alias("token"))
        held = held.join(more, "row").where(F.col("token") > F.element_at("tokens", -1)).select(
            "row", "n", "b", F.concat("tokens", F.array("token")).alias("tokens"))
    return _rules(rules)


def post_rules(rules: DataFrame, baskets: DataFrame) -> DataFrame:
    """The inverted index: (token, tokens, confidence, support), each rule under its rarest token."""
    seen = baskets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    each = rules.select("rule_id", "tokens", "support", "confidence", F.explode("tokens").alias("token")).join(seen, "token")
    return each.groupBy("rule_id").agg(F.min(F.struct("n", "token")).getField("token").alias("token"),
                                       F.first("tokens").alias("tokens"), F.max("confidence").alias("confidence"),
                                       F.max("support").alias("support"))


def match_rules(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(tokens, mined, confidence): the strongest matching rule of each distinct token set that has one.

    ``urls`` has ``tokens``; equal token sets are looked up once, so a hot host costs no more than its
    distinct paths.
    """
    sets = urls.select("tokens").distinct()
    asked = sets.select("tokens", F.explode("tokens").alias("token"))
    hits = (asked.join(index.withColumnRenamed("tokens", "body"), "token")
            .where(F.size(F.array_except("body", "tokens")) == 0))
    best = F.max(F.struct("confidence", "support", "rule_id"))
    return hits.groupBy("tokens").agg(best.alias("b")).select(
        "tokens", F.regexp_replace("b.rule_id", "\x01", " & ").alias("mined"), F.col("b.confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES,
          mining: Mining = Mining()) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, confidence), one row per row of ``pages``.

    ``labels`` (doc_id, quality, toxic) label the page of that id: block for quality 0 or toxic 1; a
    label with both null says nothing, one with several rows blocks if any does. A url that is null
    or has no ``://`` has empty host and path and no tokens: no rule can match it, it is allowed. Rows
    that repeat are judged each; pages without id keep their row. Without labels nothing is mined.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = stage(urls.withColumn("tokens", F.array_sort(url_tokens(F.col("host"), F.col("path")))), "urls")
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = (labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
             .groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("blocked")))
    baskets = stage(urls.where(F.size("tokens") > 0).join(known, "page_id").select("tokens", "blocked"), "baskets")
    found = match_rules(urls, stage(post_rules(mine_rules(baskets, mining), baskets), "index"))
    # only token sets with a rule are looked up; a hot set's rows stay where they are, or are spread
    judged = attach(judge_by_rules(urls, rules), found, ["tokens"])
    method = F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"),
                         "mined", "confidence")


@query("op1_url_filters")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
