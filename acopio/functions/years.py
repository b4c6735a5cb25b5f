"""Years in values and in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .fold import strip_accents
from .text import to_number, trimmed

# Fixed pattern: a four-digit year 1900-2100 standing alone as a word.
YEAR_PATTERN = "(?U)\\b(19\\d{2}|20\\d{2}|2100)\\b"


def parse_year(c: Column) -> Column:
    """Year of a value written as a whole number, else null."""
    whole = F.when(c.cast("string").rlike("^\\s*[0-9]{4}\\s*$"), c.cast("string").try_cast("int"))
    x = to_number(c)
    other = F.when(x == F.floor(x), x.try_cast("int"))
    year = F.coalesce(whole, other)
    return F.when(year.between(K.YEAR_MIN, K.YEAR_MAX), year)


def extract_years(c: Column) -> Column:
    """All years in a text, in order of appearance."""
    found = F.regexp_extract_all(strip_accents(c), F.lit(YEAR_PATTERN), 1)
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda y: y.cast("int"))


def is_year_cell(c: Column) -> Column:
    """A cell that holds a valid year, with or without a ``.0`` tail."""
    return F.coalesce(trimmed(c).rlike("^0*(19[0-9]{2}|20[0-9]{2}|2100)(\\.0)?$"), F.lit(False))
