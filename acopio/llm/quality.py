"""Quality rules, line first: lines are judged by punctuation, navigation and boilerplate rules, failing
lines go, and a document that loses too much of its text is rejected. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, table, words
from .registry import query

#: Phrases of notices around a text, matched in the lower-cased line. Fixed values.
BOILERPLATE = ["all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
               "enable javascript", "accept cookies", "use cookies", "click here", "read more", "sign up", "log in",
               "subscribe to", "follow us", "share this", "lorem ipsum", "tous droits réservés", "mentions légales",
               "alle rechte vorbehalten", "impressum", "todos los derechos reservados", "aviso legal"]


@dataclass(frozen=True)
class Rules:
    """Production parameters."""

    min_words: int = 50           # base rule of the contract
    max_repeat_percent: int = 50  # base rule of the contract
    max_marked: float = 0.3       # share of a line's words that end in two or more signs
    max_separators: float = 0.2   # share of a line's words without a letter or digit, but for single dashes
    max_dashes: float = 0.3       # the same with them
    max_signs: float = 0.3        # share of a line's characters that are punctuation or symbols, if there are as many as
    min_signs: int = 5
    entry_words: int = 3          # a line of at most so many words that nothing closes is an entry, and
    entries: int = 4              # so many entries in a row are a menu
    boilerplate_words: int = 25   # a longer line is no notice
    max_lost: float = 0.5         # share of the words that may go with failing lines


def base_counts(text: Column) -> dict[str, Column]:
    """The base figures of a text; a null text has no words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": F.when(F.size("_words") < 4, F.lit(0)).otherwise(
            bind(F.col("_words"), repeated)).cast("bigint"),
    }


def repeated(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice.

    A window becomes one number: its hash above, its position below. Sorted, equal windows are
    neighbours; neighbours with equal hashes count when their words are equal.
    """
    n = F.size(w)
    bits = F.length(F.bin(n.cast("bigint")))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1

    def at(x: Column, k: int) -> Column:
        return F.get(w, x.cast("int") + k)

    def windows() -> Column:
        return F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.call_function(
            "shiftleft", F.xxhash64(at(i, 0), at(i, 1), at(i, 2)), bits).bitwiseOR(i.cast("bigint")))

    def starts(s: Column) -> Column:
        def pair(x: Column, y: Column) -> Column:
            p, q = x.bitwiseAND(mask), y.bitwiseAND(mask)
            same = F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)
            equal = (at(p, 0) == at(q, 0)) & (at(p, 1) == at(q, 1)) & (at(p, 2) == at(q, 2))
            return F.when(same, F.when(equal, F.array(p, q)))
        both = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), pair)
        return F.flatten(F.filter(both, lambda x: x.isNotNull()))

    covered = bind(F.sort_array(windows()), lambda s: F.array_distinct(starts(s)))
    return F.size(F.array_distinct(F.flatten(F.transform(covered, lambda p: F.array(p, p + 1, p + 2)))))


def n_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


_GAP = r"[\x20\x09-\x0D]"
_SIGN = r"[\p{P}\p{S}]"
#: A word's end of two signs that no sentence has, and the end of a line that is closed.
_MARKED = r"(?:[!?]{2}|[\p{S}#*%&@/\\_]{2})"
_CLOSED = r"""[.!?…:;,"”»)\]]""" + _GAP + "*"


def measured(line: Column) -> Column:
    """struct(n, signs): a line's words, and its characters that are punctuation or symbols."""
    return F.struct(n_words(line).alias("n"), F.regexp_count(line, F.lit(_SIGN)).alias("signs"))


def line_fails(line: Column, of: Column, rules: Rules = Rules()) -> Column:
    """True for a line with a word that breaks a rule on the line alone (``of``: its ``measured``); blank lines never fail.

    Punctuation: many words end in two signs (``!!``, ``??`` or any two symbols), or many of the characters are
    punctuation and symbols. Navigation: many words have no letter or digit, whatever sign they are (separators,
    rulers). Boilerplate: a short line with a phrase of a notice, or one word over and over (six or more times).
    Lines with few signs cannot break the first two and are not looked at for them.
    """
    n, signs = of["n"], of["signs"]
    marked = F.regexp_count(line, F.lit(rf"{_MARKED}(?={_GAP}|\z)"))
    lone = F.regexp_count(line, F.lit(rf"(?:^|(?<={_GAP})){_SIGN}+(?={_GAP}|\z)"))
    dashes = F.regexp_count(line, F.lit(rf"(?:^|(?<={_GAP}))[-–—](?={_GAP}|\z)"))
    dense = (signs >= rules.min_signs) & (signs > rules.max_signs * F.length(F.translate(line, " \t\x0b\x0c\r", "")))
    signed = dense | (marked > rules.max_marked * n) | (lone - dashes > rules.max_separators * n) | (lone > rules.max_dashes * n)
    # a marked word has two signs, a lone one has one, and no line has more words than characters
    few = min(2 * rules.max_marked, rules.max_separators, rules.max_dashes, rules.max_signs)
    notice = (n <= rules.boilerplate_words) & F.lower(line).rlike("|".join(BOILERPLATE))
    drone = (n >= 6) & line.rlike(r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]+)(?:[\x20\x09-\x0D]+\1){5}(?:[\x20\x09-\x0D]|$)")
    return (n > 0) & (F.when(signs > few * n, signed).otherwise(False) | notice | drone)


def is_entry(line: Column, n: Column, rules: Rules = Rules()) -> Column:
    """True for a line of few words that no punctuation closes, as menus have them one below the other."""
    return (n > 0) & (n <= rules.entry_words) & ~line.rlike(rf"{_CLOSED}\z")


def in_runs(flags: Column, length: int) -> Column:
    """Per place of an array of flags, whether it lies in a run of at least ``length`` true ones."""
    def some(x: Column, i: Column, step: int, both) -> Column:
        return reduce(both, [F.coalesce(F.get(x, i + step * k), F.lit(False)) for k in range(length)])
    begins = bind(flags, lambda f: F.transform(f, lambda _, i: some(f, i, 1, lambda a, b: a & b)))
    return bind(begins, lambda b: F.transform(b, lambda _, i: some(b, i, -1, lambda x, y: x | y)))


def judged_lines(text: Column, rules: Rules = Rules()) -> Column:
    """array of struct(line, n, fails): the lines of a text, their words, and whether a rule takes them out. One
    expression in which everything is computed once, so that a filter on it costs no more than it must."""
    each = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: bind(measured(x), lambda of: F.struct(
        x.alias("line"), of["n"].alias("n"), line_fails(x, of, rules).alias("fails"), is_entry(x, of["n"], rules).alias("entry"))))

    def with_menus(lines: Column) -> Column:
        some = F.exists(lines, lambda x: x["entry"])
        menus = F.when(some, in_runs(F.transform(lines, lambda x: x["entry"]), rules.entries))
        return bind(menus, lambda menu: F.transform(lines, lambda x, i: F.struct(
            x["line"].alias("line"), x["n"].alias("n"), (x["fails"] | F.coalesce(F.get(menu, i), F.lit(False))).alias("fails"))))
    return bind(each, with_menus)


def judge_rows(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the base figures, ``base_failed``, ``lost_words``, ``kept`` and ``clean_text`` (the text
    without failing lines); a column of one of these names is replaced.

    A null or empty text has no words and fails the base rules. Rows that repeat are judged each; a
    null id is kept. A text over sixteen million words is judged whole like any other.
    """
    counts = base_counts(F.col("text"))
    made = [*counts, "base_failed", "lost_words", "kept", "clean_text"]
    names = [c for c in docs.columns if c not in made]
    rows = docs.select(*names).withColumn("_words", words(F.col("text")))
    rows = rows.select(*names, *[c.alias(name) for name, c in counts.items()])
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("_lines", judged_lines(F.col("text"), rules))
    rows = rows.withColumn("lost_words", F.aggregate(
        "_lines", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["fails"], x["n"]).otherwise(0)))
    kept = ~F.col("base_failed") & (F.col("lost_words") <= rules.max_lost * F.col("n_words"))
    left = F.array_join(F.transform(F.filter("_lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
    return rows.withColumn("kept", kept).withColumn("clean_text", left).drop("_lines")


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``judge_rows`` of (doc_id, text) alone, whatever else ``docs`` holds, without the text."""
    return judge_rows(docs.select("doc_id", "text"), rules).drop("text")


_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS rid FROM documents),
win AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
dup AS (SELECT rid, g FROM win GROUP BY ALL HAVING count(*) > 1),
pos AS (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM win SEMI JOIN dup USING (rid, g)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM pos GROUP BY rid),
lin AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
cnt AS (SELECT rid, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS v, len(v) AS n,
    len(list_filter(v, lambda x: regexp_matches(x, '([!?]{{2}}|[\p{{S}}#*%&@/\\_]{{2}})$'))) AS marked,
    len(list_filter(v, lambda x: regexp_full_match(x, '[\p{{P}}\p{{S}}]+'))) AS lone, len(list_filter(v, lambda x: x IN ('-', '–', '—'))) AS dashes,
    len(regexp_extract_all(line, '[\p{{P}}\p{{S}}]')) AS signs, length(array_to_string(v, '')) AS chars,
    len(v) BETWEEN 1 AND 3 AND NOT regexp_matches(line, '[.!?…:;,"”»)\]][\x20\x09-\x0D]*$') AS entry FROM lin),
beg AS (SELECT *, sum(CAST(entry AS INTEGER)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) = 4 AS begins FROM cnt),
run AS (SELECT * FROM (SELECT *, max(CAST(begins AS INTEGER)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 1 AS menu FROM beg) m WHERE n > 0),
jud AS (SELECT rid, line, n, marked > 0.3 * n OR lone - dashes > 0.2 * n OR lone > 0.3 * n OR (signs >= 5 AND signs > 0.3 * chars) OR menu OR (n <= 25 AND regexp_matches(lower(line), '{phrases}'))
    OR len(list_filter(generate_series(1, len(v) - 5), lambda i: v[i] = v[i+1] AND v[i] = v[i+2] AND v[i] = v[i+3] AND v[i] = v[i+4] AND v[i] = v[i+5])) > 0 AS fails FROM run),
los AS (SELECT rid, sum(CASE WHEN fails THEN n ELSE 0 END) AS lost, count(*) - count(DISTINCT line) AS dups FROM jud GROUP BY rid),
base AS (SELECT d.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost FROM d LEFT JOIN rep ON rep.rid = d.rid LEFT JOIN los ON los.rid = d.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.5 * n_words AS kept FROM base
""".replace("{phrases}", "|".join(BOILERPLATE)).replace("{{", "{").replace("}}", "}")


@query("op6_quality_rules", _SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
