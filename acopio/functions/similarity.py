"""Similarity of two match keys, and the fuzzy sex/gender category."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import match_key


def key_ratio(a: Column, b: Column) -> Column:
    """Levenshtein ratio of two match keys."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return (F.when(a == b, 1.0)
            .when((a == "") | (b == ""), 0.0)
            .otherwise(1 - F.levenshtein(a, b) / longest))


def key_ratio_at_least(a: Column, b: Column, t: float) -> Column:
    """``key_ratio(a, b) >= t``; the distance stops being computed once it cannot qualify."""
    la, lb = F.char_length(a), F.char_length(b)
    longest, shortest = F.greatest(la, lb), F.least(la, lb)
    allowed = F.ceil(longest * (1 - t)).cast("int")
    d = F.call_function("levenshtein", a, b, allowed)
    return (F.when(a == b, F.lit(True))
            .when((longest - shortest) > allowed, F.lit(False))
            .when((a == "") | (b == ""), F.lit(t <= 0))
            .otherwise((d >= 0) & ((1 - d / longest) >= t)))


def _tokens(key: Column) -> Column:
    return F.array_distinct(F.split(key, " "))


def key_jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens."""
    shared = F.size(F.array_intersect(_tokens(a), _tokens(b)))
    total = F.size(F.array_union(_tokens(a), _tokens(b)))
    return (F.when((a == "") & (b == ""), 1.0)
            .when((a == "") | (b == ""), 0.0)
            .otherwise(shared / total))


def key_similarity(a: Column, b: Column) -> Column:
    return F.greatest(key_ratio(a, b), key_jaccard(a, b))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    return key_ratio(match_key(a), match_key(b))


def jaccard_similarity(a: Column, b: Column) -> Column:
    return key_jaccard(match_key(a), match_key(b))


def combined_similarity(a: Column, b: Column) -> Column:
    return key_similarity(match_key(a), match_key(b))


def sex_of_key(value: Column, key: Column) -> Column:
    """Category of a value given its match key.

    Exact patterns answer almost every row; only the rest pays for edit distances, and a key too
    long to reach the threshold against the longest pattern is passed through. Both best ratios
    are bound once, which also keeps the generated code small.
    """
    reach = int(max(map(len, K.MALE_PATTERNS + K.FEMALE_PATTERNS)) / K.SEX_THRESHOLD)

    def best(patterns):
        return F.greatest(*[1 - F.levenshtein(key, F.lit(p)) / F.greatest(F.char_length(key), F.lit(len(p)))
                            for p in patterns])

    pair = F.struct(best(K.MALE_PATTERNS).alias("m"), best(K.FEMALE_PATTERNS).alias("f"))
    fuzzy = F.transform(F.array(pair), lambda s: (
        F.when((s["m"] >= K.SEX_THRESHOLD) & (s["m"] > s["f"]), K.MALE)
        .when((s["f"] >= K.SEX_THRESHOLD) & (s["f"] > s["m"]), K.FEMALE).otherwise(value)))
    return (F.when(key.isin(K.MALE_PATTERNS), K.MALE)
            .when(key.isin(K.FEMALE_PATTERNS), K.FEMALE)
            .when((key == "") | (F.char_length(key) > reach), value)
            .otherwise(F.element_at(fuzzy, 1)))


def map_sex(value: Column) -> Column:
    """Single-expression form; the key is bound once so that it is not repeated per pattern."""
    bound = F.transform(F.array(match_key(value)), lambda k: sex_of_key(value, k))
    return F.when(value.isNotNull(), F.element_at(bound, 1))
