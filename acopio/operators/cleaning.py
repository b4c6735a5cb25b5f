"""Cleaning of master tables. Columns whose name starts with ``_`` are technical and left alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.fold import match_key_text, strip_accents_text
from ..functions.similarity import sex_of_key
from ..functions.text import (is_null_token, looks_numeric, match_key, normalize_text, nullified,
                              to_int_or_zero, trimmed)
from ..functions.years import is_year_cell
from .counts import Counts
from .joins import attach


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def text_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t == "string" and not n.startswith("_")]


# --- which columns a rule aims at ---------------------------------------------------------------

def columns_named(columns: list[str], words: list[str]) -> list[str]:
    return [c for c in columns if any(w in strip_accents_text(c.lower()) for w in words)]


def institution_columns(columns: list[str]) -> list[str]:
    return columns_named(columns, ["institucion"])


def sex_columns(columns: list[str]) -> list[str]:
    return columns_named(columns, K.SEX_COLUMN_WORDS)


def name_columns(columns: list[str]) -> list[str]:
    return columns_named(columns, K.NAME_COLUMN_WORDS)


def year_column(columns: list[str]) -> str | None:
    return next((c for c in columns if match_key_text(c) == K.YEAR_KEY), None)


# --- null tokens ----------------------------------------------------------------------------------

def nullify_tokens(df: DataFrame, columns: list[str] | None = None, counts: Counts | None = None) -> DataFrame:
    """``counts`` gets the blank cells as ``n_vacias`` and those that say there is no information as ``n_sin_info``."""
    cols = columns or text_columns(df)
    if counts is not None:
        blank, empty = _cell_counts(cols)
        df = counts.watch_sums(df.withColumns({"_b": blank, "_e": empty}), n_vacias=F.col("_b"), n_sin_info=F.col("_e") - F.col("_b")).drop("_b", "_e")
    return df.withColumns({c: nullified(_c(c)) for c in cols})


def _cell_counts(cols: list[str]) -> tuple[Column, Column]:
    blank = sum((F.coalesce(trimmed(_c(c)) == "", F.lit(False)).cast("bigint") for c in cols), F.lit(0))
    empty = sum((is_null_token(_c(c)).cast("bigint") for c in cols), F.lit(0))
    return blank, empty


def nullify_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: blank cells, and cells that say there is no information."""
    blank, empty = _cell_counts(columns or text_columns(df))
    per_row = df.select(blank.alias("b"), empty.alias("e"))
    return per_row.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("n_vacias"),
                       F.coalesce(F.sum(F.col("e") - F.col("b")), F.lit(0)).alias("n_sin_info"))


def drop_all_null_rows(df: DataFrame) -> DataFrame:
    some = reduce(lambda a, b: a | b, [_c(c).isNotNull() for c in data_columns(df)])
    return df.where(some)


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """One scan counts every column; the schema then follows from that single row."""
    cols = data_columns(df)
    seen = df.agg(*[F.max(_c(c).isNotNull()).alias(c) for c in cols]).first()
    return df.select(*[_c(c) for c in df.columns if c.startswith("_") or seen[c]])


# --- footers ----------------------------------------------------------------------------------------

def with_footer_flag(df: DataFrame, columns: list[str] | None = None, year: str | None = None,
                     out: str = "_footer") -> DataFrame:
    """Add a flag for rows that look like notes under a table rather than data."""
    cols = columns or data_columns(df)
    year = year or year_column(cols)
    filled = F.filter(F.array(*[trimmed(_c(c).cast("string")) for c in cols]),
                      lambda v: v.isNotNull() & (v != ""))
    has_year = is_year_cell(_c(year).cast("string")) if year else F.lit(False)
    step = df.withColumn("_filled", F.when(~has_year, filled))
    step = step.withColumn("_joined", match_key(F.array_join("_filled", " ")))
    n = F.size("_filled")
    few = (n <= 2) & (F.exists("_filled", lambda v: F.char_length(v) >= 25)
                      | ~F.exists("_filled", looks_numeric))
    total = (n <= 4) & F.contains(F.col("_joined"), F.lit("total"))
    flag = (F.when(F.col("_filled").isNull(), F.lit(False))
            .when(n == 0, F.lit(True))
            .when(F.col("_joined").rlike("|".join(K.FOOTER_HINTS)), F.lit(True))
            .otherwise(few | total))
    return step.withColumn(out, flag).drop("_filled", "_joined")


def trim_footer(df: DataFrame, order: str, file: str | None = None,
                columns: list[str] | None = None, year: str | None = None, counts: Counts | None = None) -> DataFrame:
    """Drop the run of footer rows at the end of each file.

    Per file one number, the last row that is not a footer, decides; a file is never brought
    together in one task. ``counts`` gets the rows dropped as ``recortadas``.
    """
    flagged = with_footer_flag(df, columns, year)
    keep = [_c(c) for c in df.columns]
    last = F.max(F.when(~F.col("_footer"), _c(order))).alias("_last")
    if file is None:
        bound = flagged.agg(last).first()["_last"]
        rows = df.withColumn("_last", F.lit(None).cast("bigint") if bound is None else F.lit(bound))
    else:
        ends = flagged.groupBy(file).agg(last).where("_last IS NOT NULL")
        rows = attach(df, ends, [file], "inner" if counts is None else "left")
    if counts is not None:
        rows = counts.watch(rows, recortadas=F.coalesce(_c(order) > F.col("_last"), F.lit(True)))
    return rows.where(_c(order) <= F.col("_last")).select(*keep)


# --- value normalisation ---------------------------------------------------------------------------

def normalize_institutions(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = institution_columns(text_columns(df)) if columns is None else columns
    return df.withColumns({c: normalize_text(_c(c)) for c in cols}) if cols else df


def normalize_sex(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fuzzy category on the targeted columns: one projection, no shuffle.

    The key is its own projected column so that it is built once per cell.
    """
    cols = sex_columns(text_columns(df)) if columns is None else columns
    if not cols:
        return df
    keyed = df.withColumns({f"_key{i}": match_key(_c(c)) for i, c in enumerate(cols)})
    mapped = keyed.withColumns({
        c: F.when(_c(c).isNotNull(), sex_of_key(_c(c), F.col(f"_key{i}"))) for i, c in enumerate(cols)})
    return mapped.select(*[_c(c) for c in df.columns])


def convert_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = [c for c in ["Año", *K.NUMERIC_HEADERS] if c in df.columns] if columns is None else columns
    return df.withColumns({c: to_int_or_zero(_c(c)) for c in cols}) if cols else df


def base_clean(df: DataFrame, order: str = "_ord", file: str | None = "_path",
               institutions: list[str] | None = None, counts: Counts | None = None) -> DataFrame:
    """Footer trim, null tokens, empty rows, institution names, sex, numeric types. ``counts`` gets the rows trimmed
    and the cells emptied."""
    file = file if file in df.columns else None
    if order in df.columns:
        df = trim_footer(df, order, file, counts=counts)
    return (df.transform(nullify_tokens, None, counts)
            .transform(drop_all_null_rows)
            .transform(normalize_institutions, institutions)
            .transform(normalize_sex)
            .transform(convert_types))


# --- year scope --------------------------------------------------------------------------------------

def in_year(column: str, year: int) -> Column:
    return to_int_or_zero(_c(column)) == year


def scoped(df: DataFrame, clean, scope: Column | None) -> DataFrame:
    """Apply ``clean`` to the rows in scope only, then drop rows that ended up empty."""
    if scope is None:
        return clean(df)
    inside = F.coalesce(scope, F.lit(False))
    done = clean(df.where(inside))
    rest = df.where(~inside)
    # rows outside the scope stay exactly as they are, so cleaned numbers go back to their old type
    done = done.select(*[_c(c).cast(t).alias(c) for c, t in df.dtypes])
    return drop_all_null_rows(done.unionByName(rest))
