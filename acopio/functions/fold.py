"""Compatibility decomposition (NFKD) as Column expressions.

Spark SQL has no normalisation function, so the mapping is generated once from ``unicodedata``:
one ``translate`` call covers every code point that decomposes to a single base character, and
the rarer ones that become several characters (ligatures, fractions) go through a lookup that is
only entered when such a character is present. Pure-ASCII values skip both.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_HANGUL = range(0xAC00, 0xD7A4)  # decomposes to letters, never to marks or ASCII


def _bare(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


@lru_cache(maxsize=None)
def _tables(ascii_only: bool) -> tuple[str, str, dict[str, str]]:
    """(from, to, several): ``to`` is shorter, so the tail of ``from`` is deleted."""
    one, gone, several = [], [], {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or cp in _HANGUL:
            continue
        ch = chr(cp)
        out = _bare(ch)
        if out == ch:
            continue
        if ascii_only:
            out = "".join(c for c in out if c.isascii())
        if out == "":
            # With an ASCII target every other character is removed afterwards anyway.
            if not ascii_only:
                gone.append(ch)
        elif len(out) == 1:
            one.append((ch, out))
        else:
            several[ch] = out
    return "".join(a for a, _ in one) + "".join(gone), "".join(b for _, b in one), several


def _regex_class(chars) -> str:
    cps = sorted(map(ord, chars))
    runs, start = [], cps[0]
    for a, b in zip(cps, cps[1:] + [None]):
        if b != a + 1:
            runs.append((start, a))
            start = b
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


@lru_cache(maxsize=None)
def _several_class(ascii_only: bool) -> str:
    return _regex_class(_tables(ascii_only)[2])


def _decompose(c: Column, ascii_only: bool) -> Column:
    src, dst, several = _tables(ascii_only)
    sep = "\x01"
    table = F.map_from_arrays(F.split(F.lit(sep.join(several)), sep),
                              F.split(F.lit(sep.join(several.values())), sep))
    spread = F.array_join(
        F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    c = F.when(c.rlike(_several_class(ascii_only)), spread).otherwise(c)
    return F.translate(c, src, dst)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def strip_accents(c: Column) -> Column:
    """NFKD without combining marks."""
    return F.when(is_ascii(c), c).otherwise(_decompose(c, ascii_only=False))


def fold_to_ascii(c: Column) -> Column:
    """NFKD keeping ASCII; characters without an ASCII form stay for the caller to drop."""
    return F.when(is_ascii(c), c).otherwise(_decompose(c, ascii_only=True))


@lru_cache(maxsize=None)
def _key_table() -> tuple[str, str]:
    """One translation for match keys: folded letters, white space to a blank, other ASCII dropped."""
    src, dst, _ = _tables(True)
    spaces = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0x1680, 0x2028, 0x2029]))
    # capitals that only appear after folding are not part of a key either
    fits = set("abcdefghijklmnopqrstuvwxyz0123456789 ")
    junk = "".join(chr(i) for i in range(0x80) if chr(i) not in fits and chr(i) not in spaces)
    keep = [(a, b) for a, b in zip(src, dst) if b in fits]
    lost = "".join(a for a, b in zip(src, dst) if b not in fits)
    return ("".join(a for a, _ in keep) + spaces + junk + lost,
            "".join(b for _, b in keep) + " " * len(spaces))


def key_fold(c: Column) -> Column:
    """Lower-case text -> letters, digits and blanks, in one pass over the characters."""
    several = _tables(True)[2]
    sep = "\x01"
    table = F.map_from_arrays(F.split(F.lit(sep.join(several)), sep),
                              F.split(F.lit(sep.join(several.values())), sep))
    spread = F.array_join(
        F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    c = F.when(~is_ascii(c) & c.rlike(_several_class(True)), spread).otherwise(c)
    src, dst = _key_table()
    return F.regexp_replace(F.translate(c, src, dst), "[^\\x00-\\x7F]+", "")


def strip_accents_text(text: str) -> str:
    """The same rule for a header name on the driver."""
    return _bare(text)


def match_key_text(text: str | None) -> str:
    """``match_key`` for a header name on the driver."""
    low = strip_accents_text((text or "").lower())
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", low)).strip()
