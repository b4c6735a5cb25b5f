"""SQL snippets the checks are written with (DuckDB)."""

from __future__ import annotations

from .. import constants as K


def key(x: str) -> str:
    low = f"strip_accents(lower(coalesce({x}, '')))"
    kept = f"regexp_replace({low}, '[^a-z0-9\\s]', '', 'g')"
    return f"trim(regexp_replace({kept}, '\\s+', ' ', 'g'))"


def clean(x: str) -> str:
    return f"nullif(trim({x}), '')"


def code(x: str) -> str:
    c = f"nullif(regexp_extract(trim({x}), '^([0-9]+)(\\.0+)?$', 1), '')"
    return f"CASE WHEN regexp_full_match({c}, '0+') THEN NULL ELSE {c} END"


NUMBER = "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"


def toint(x: str) -> str:
    return (f"coalesce(CASE WHEN regexp_full_match(trim({x}), '{NUMBER}') "
            f"THEN CAST(trunc(TRY_CAST(trim({x}) AS DOUBLE)) AS BIGINT) END, 0)")


def year(x: str) -> str:
    d = f"TRY_CAST(trim({x}) AS DOUBLE)"
    return (f"CASE WHEN regexp_full_match(trim({x}), '{NUMBER}') AND {d} = floor({d}) "
            f"AND {d} BETWEEN 1900 AND 2100 THEN CAST({d} AS INTEGER) END")


def ratio(a: str, b: str) -> str:
    return (f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE "
            f"ELSE 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END")


def jaccard(a: str, b: str) -> str:
    ta, tb = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    return (f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE "
            f"ELSE len(list_intersect({ta}, {tb}))::DOUBLE / len(list_distinct(list_concat({ta}, {tb}))) END")


def similarity(a: str, b: str) -> str:
    return f"greatest({ratio(a, b)}, {jaccard(a, b)})"


def sex(x: str, k: str) -> str:
    """Category of ``x`` with match key ``k`` (a column)."""
    m = "greatest(" + ", ".join(ratio(k, f"'{p}'") for p in K.MALE_PATTERNS) + ")"
    f = "greatest(" + ", ".join(ratio(k, f"'{p}'") for p in K.FEMALE_PATTERNS) + ")"
    return (f"CASE WHEN {k} = '' THEN {x} WHEN {m} >= 0.7 AND {m} > {f} THEN 'Masculino' "
            f"WHEN {f} >= 0.7 AND {f} > {m} THEN 'Femenino' ELSE {x} END")


def in_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def null_token(x: str) -> str:
    return f"({x} IS NOT NULL AND (trim({x}) = '' OR {key(x)} IN {in_list(K.NULL_TOKENS)}))"


def collation(x: str) -> str:
    return f"lower(strip_accents(rtrim({x})))"


def years(x: str) -> str:
    return f"regexp_extract_all(strip_accents({x}), '\\b(19\\d\\d|20\\d\\d|2100)\\b', 1)"
