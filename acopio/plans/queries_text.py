"""Queries for the scalar functions, over whole columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..functions import years as Y
from ..functions.fold import strip_accents
from . import bindings as B
from . import oracle as O
from .registry import query

_NUMBERS = """SELECT o_orderkey AS id, CASE o_orderkey % 10
  WHEN 0 THEN CAST(o_custkey AS STRING) || '.0' WHEN 1 THEN '0' || CAST(o_custkey AS STRING)
  WHEN 2 THEN '-' || CAST(o_custkey AS STRING) || '.9' WHEN 3 THEN ' ' || CAST(o_custkey AS STRING) || ' '
  WHEN 4 THEN CAST(o_custkey AS STRING) || ',5' WHEN 5 THEN '1e3' WHEN 6 THEN o_orderpriority
  WHEN 7 THEN '000' WHEN 8 THEN CAST(year(o_orderdate) AS STRING) || '.0' ELSE '-' || CAST(o_custkey AS STRING) || '.0' END AS v
FROM {orders}"""

_DOCS = "SELECT doc_id AS id, text AS v FROM {documents}"
_QUOTED = "SELECT doc_id AS id, '  \"' || text || '\"  ' AS v FROM {documents}"
_NAMES = """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '  ' || c_name WHEN 1 THEN ' ' WHEN 2 THEN ''
  ELSE c_mktsegment || '  ' END AS v FROM {customer}"""
_URLS = "SELECT page_id AS id, url AS v FROM {pages}"
_DATED = """SELECT o_orderkey AS id, 'Corte ' || CAST(year(o_orderdate) AS STRING) || ' - AÑO_2024 (' ||
  CAST(o_custkey AS STRING) || ') ' || o_orderpriority || ' 2100.0' AS v FROM {orders}"""


def _scalar(name, source, fn, sql):
    """One output column ``out`` per input row."""
    @query(name, f"SELECT id, {sql} AS out FROM ({B.sql_of(source)}) t")
    def run(spark, sf_dir):
        return B.derive(spark, sf_dir, source).select("id", fn(F.col("v")).alias("out"))
    return run


_scalar("strip_accents", _DOCS, strip_accents, "strip_accents(v)")
_scalar("match_key", _DOCS, T.match_key, O.key("v"))
_scalar("normalize_text", _DOCS, T.normalize_text,
        "trim(regexp_replace(upper(regexp_replace(strip_accents(v), '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g'))")
_scalar("clean_header", _QUOTED, T.clean_header,
        "regexp_replace(trim(trim(trim(replace(v, chr(10), ' ')), '\"'), ''''), '\\s+', ' ', 'g')")
_scalar("strip_float_suffix", _NUMBERS, T.strip_float_suffix, "regexp_replace(v, '^(-?[0-9]+)\\.0$', '\\1')")
_scalar("looks_numeric", _NUMBERS, lambda c: T.looks_numeric(c).cast("int"),
        "CAST(regexp_full_match(replace(replace(trim(v), '.', ''), ',', ''), '-*[0-9]+') AS INTEGER)")
_scalar("clean_value", _NAMES, T.clean_value, O.clean("v"))
_scalar("numeric_code", _NUMBERS, T.numeric_code, O.code("v"))
_scalar("to_int_or_zero", _NUMBERS, T.to_int_or_zero, O.toint("v"))
_scalar("sanitize_name", _URLS, T.sanitize_name,
        "CASE WHEN trim(regexp_replace(v, '[\\\\/:*?\"<>|]', '_', 'g')) = '' THEN 'archivo' "
        "ELSE trim(regexp_replace(v, '[\\\\/:*?\"<>|]', '_', 'g')) END")
_scalar("parse_year", _NUMBERS, Y.parse_year, O.year("v"))
_scalar("extract_years", _DATED, lambda c: F.array_join(Y.extract_years(c), ","),
        f"array_to_string({O.years('v')}, ',')")
_scalar("extract_years_html", "SELECT page_id AS id, html AS v FROM {pages}",
        lambda c: F.array_join(Y.extract_years(c), ","), f"array_to_string({O.years('v')}, ',')")


def _pair(name, fn, sql):
    body = (f"WITH k AS (SELECT _ord AS id, {O.key('variante')} AS a, {O.key('largo')} AS b, {O.key('programa')} AS c "
            f"FROM ({B.sql_of(B.VARIANTS)}) t) SELECT id, round({sql('a', 'c')}, 9) AS con_nombre, "
            f"round({sql('a', 'b')}, 9) AS con_largo FROM k")

    @query(name, body)
    def run(spark, sf_dir):
        keyed = B.derive(spark, sf_dir, B.VARIANTS).select(
            F.col("_ord").alias("id"), T.match_key(F.col("variante")).alias("a"),
            T.match_key(F.col("largo")).alias("b"), T.match_key(F.col("programa")).alias("c"))
        return keyed.select("id", F.round(fn(F.col("a"), F.col("c")), 9).alias("con_nombre"),
                            F.round(fn(F.col("a"), F.col("b")), 9).alias("con_largo"))
    return run


_pair("levenshtein_ratio", S.key_ratio, O.ratio)
_pair("jaccard_similarity", S.key_jaccard, O.jaccard)
_pair("combined_similarity", S.key_similarity, O.similarity)


@query("map_sex", f"WITH k AS (SELECT _ord AS id, sexo, {O.key('sexo')} AS k FROM ({B.sql_of(B.DIRTY)}) t) "
                  f"SELECT id, {O.sex('sexo', 'k')} AS out FROM k")
def map_sex(spark, sf_dir):
    """Keys are a projected column of their own, so each pattern compares a plain column."""
    keyed = B.derive(spark, sf_dir, B.DIRTY).select(F.col("_ord").alias("id"), "sexo",
                                                    T.match_key(F.col("sexo")).alias("k"))
    return keyed.select("id", S.sex_of_key(F.col("sexo"), F.col("k")).alias("out"))
