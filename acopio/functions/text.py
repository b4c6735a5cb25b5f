"""Scalar text expressions. Every function maps Columns to a Column, inside codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .fold import fold_to_ascii, is_ascii, key_fold

# White space as the cleaning rules see it: more than the plain blank that trim() removes.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                           *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_WS = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
# Runs of white space that are not already one plain blank: only these need rewriting.
_RUNS = "[" + _WS.replace("\\x20", "\\x1F") + f"][{_WS}]*| [{_WS}]+"

_ASCII_RUNS = "[\\x09-\\x0D\\x1C-\\x1F][\\x09-\\x0D\\x1C-\\x20]*| [\\x09-\\x0D\\x1C-\\x20]+"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return c.isNull() | (trimmed(c) == "")


def clean_value(c: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(trimmed(c), F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _RUNS, " "))


def match_key(c: Column) -> Column:
    """Lower case, no accents, only letters, digits and single spaces; null becomes empty."""
    return F.trim(F.regexp_replace(key_fold(F.lower(F.coalesce(c, F.lit("")))), " {2,}", " "))


def normalize_text(c: Column) -> Column:
    """Upper-case ASCII with single spaces and the punctuation kept; null and empty stay."""
    ascii_only = F.regexp_replace(fold_to_ascii(c), "[^\\x00-\\x7F]+", "")
    single = F.regexp_replace(F.upper(ascii_only), _ASCII_RUNS, " ")
    return F.when(c == "", c).otherwise(F.trim(single))


def clean_header(c: Column) -> Column:
    """One-line header: trim, then double quotes, then single quotes, then single spaces."""
    c = trimmed(F.replace(c, F.lit("\n"), F.lit(" ")))
    c = F.btrim(F.btrim(c, F.lit('"')), F.lit("'"))
    return F.regexp_replace(c, _RUNS, " ")


def clean_header_text(name: str) -> str:
    """``clean_header`` for a name on the driver."""
    return re.sub(r"\s+", " ", name.replace("\n", " ").strip().strip('"').strip("'"))


def is_null_token(c: Column) -> Column:
    """True for text that only says there is no information (blank text included).

    All tokens begin with d, n or s, so most values are ruled out before a key is built.
    """
    maybe = ~is_ascii(c) | c.rlike("^[^a-zA-Z0-9]*[dnsDNS]")
    return F.coalesce((trimmed(c) == "") | (maybe & match_key(c).isin(K.NULL_TOKENS)), F.lit(False))


def nullified(c: Column) -> Column:
    return F.when(~is_null_token(c), c)


def looks_numeric(c: Column) -> Column:
    digits = F.translate(trimmed(c), ".,", "")
    return F.coalesce(digits.rlike("^-*[0-9]+$"), F.lit(False))


def strip_float_suffix(c: Column) -> Column:
    return F.regexp_replace(c, "^(-?[0-9]+)\\.0$", "$1")


def numeric_code(c: Column, allow_zero: bool = False) -> Column:
    """Digits of an identifier, without a ``.0`` tail; leading zeros kept, zero itself refused."""
    some = "" if allow_zero else "(?=0*[1-9])"
    return F.nullif(F.regexp_extract(trimmed(c), f"^{some}([0-9]+)(?:\\.0+)?$", 1), F.lit(""))


_NUMBER = "^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$"


def to_number(c: Column) -> Column:
    """Double of a plain decimal text, else null (``1d`` or ``1,000`` are not numbers)."""
    t = c.cast("string")
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def to_int_or_zero(c: Column) -> Column:
    """Whole part of a number as BIGINT; whatever is not a number counts as 0.

    Patterns decide first: a cast that fails costs far more than a pattern that does not match.
    """
    t = c.cast("string")
    whole = F.when(t.rlike("^\\s*[+-]?[0-9]{1,18}\\s*$"), t.try_cast("bigint")).when(
        t.rlike(_NUMBER), t.try_cast("double").try_cast("bigint"))
    return F.coalesce(whole, F.lit(0).cast("bigint"))


def sanitize_name(c: Column) -> Column:
    clean = trimmed(F.regexp_replace(c, '[\\\\/:*?"<>|]', "_"))
    return F.when(clean == "", "archivo").otherwise(clean)


def category_file(c: Column) -> Column:
    return F.concat(F.replace(c, F.lit(" "), F.lit("_")), F.lit(".csv"))
