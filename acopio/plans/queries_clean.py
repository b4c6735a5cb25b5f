"""Queries for cleaning, reshaping, column reports and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import to_int_or_zero
from ..functions.years import parse_year
from ..operators import aggregates as A
from ..operators import cleaning as C
from ..operators import joins as J
from ..operators import matching as M
from ..operators.counts import Counts
from ..sources import masters
from . import bindings as B
from . import catalog
from . import oracle as O
from .registry import query

_DIRTY = B.sql_of(B.DIRTY)
_COLS = ["codigo", "institucion", "sector", "sexo", "anio", "total"]
_AS = "row_id"


def _dirty(spark, sf_dir):
    return B.derive(spark, sf_dir, B.DIRTY)


def _named(df):
    return df.withColumnRenamed("_ord", _AS)


def _nulled(x):
    return f"CASE WHEN NOT coalesce({O.null_token(x)}, false) THEN {x} END"


@query("nullify_tokens", "SELECT _ord AS row_id, " + ", ".join(f"{_nulled(c)} AS {c}" for c in _COLS)
       + f" FROM ({_DIRTY}) t")
def nullify_tokens(spark, sf_dir):
    return _named(C.nullify_tokens(_dirty(spark, sf_dir)))


@query("nullify_counts", "SELECT CAST(" + " + ".join(f"count_if(trim({c}) = '')" for c in _COLS)
       + " AS BIGINT) AS n_vacias, CAST(" + " + ".join(f"count_if({O.null_token(c)} AND trim({c}) <> '')" for c in _COLS)
       + f" AS BIGINT) AS n_sin_info FROM ({_DIRTY}) t")
def nullify_counts(spark, sf_dir):
    return C.nullify_counts(_dirty(spark, sf_dir))


_CELLS = ("SELECT " + " + ".join(f"count_if(trim({c}) = '')" for c in _COLS) + " AS b, "
          + " + ".join(f"count_if({O.null_token(c)} AND trim({c}) <> '')" for c in _COLS) + f" AS e FROM ({_DIRTY}) t")


@query("drop_all_null_rows", f"WITH n AS (SELECT _ord AS row_id, {_nulled('institucion')} AS institucion, "
       f"{_nulled('sector')} AS sector FROM ({_DIRTY}) t) SELECT * FROM n WHERE institucion IS NOT NULL OR sector IS NOT NULL")
def drop_all_null_rows(spark, sf_dir):
    df = C.nullify_tokens(_dirty(spark, sf_dir).select("_ord", "institucion", "sector"))
    return _named(C.drop_all_null_rows(df))


@query("drop_all_null_cols", "SELECT o_orderkey AS row_id, o_orderstatus AS estado, "
       "nullif(o_orderpriority, '1-URGENT') AS prioridad FROM orders")
def drop_all_null_cols(spark, sf_dir):
    df = B.tables(spark, sf_dir, ["orders"])["orders"].select(
        F.col("o_orderkey").alias("_ord"), F.col("o_orderstatus").alias("estado"),
        F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("prioridad"),
        F.when(F.col("o_totalprice") < 0, "x").alias("vacia"), F.nullif("o_orderkey", "o_orderkey").alias("nada"))
    return _named(C.drop_all_null_columns(df))


# --- footers: customers of a nation are a file, its last rows are notes ---------------------------

_FOOT = """SELECT CAST(c_nationkey AS STRING) AS _path, c_custkey AS _ord,
  CASE WHEN c_custkey % 50 = 3 THEN 'Fuente: entidad' ELSE CAST(c_custkey AS STRING) END AS codigo,
  CASE WHEN c_custkey % 50 = 7 THEN '' ELSE c_name END AS nombre,
  CASE WHEN c_custkey % 50 IN (3, 7, 9) THEN '' ELSE '2020.0' END AS anio,
  CASE WHEN c_custkey % 50 IN (3, 9) THEN '' ELSE c_mktsegment END AS sector FROM {customer}
UNION ALL SELECT CAST(c_nationkey AS STRING), max(c_custkey) + 1, 'Nota: cifras preliminares', '', '', '' FROM {customer} GROUP BY c_nationkey
UNION ALL SELECT CAST(c_nationkey AS STRING), max(c_custkey) + 2, 'Total', CAST(count(*) AS STRING), '', '10' FROM {customer} GROUP BY c_nationkey
UNION ALL SELECT CAST(c_nationkey AS STRING), max(c_custkey) + 3, '', ' ', '', '' FROM {customer} GROUP BY c_nationkey
UNION ALL SELECT CAST(c_nationkey AS STRING), max(c_custkey) + 4, 'Corte definitivo para uso interno', '', '', '' FROM {customer} GROUP BY c_nationkey"""
_FCOLS = ["codigo", "nombre", "anio", "sector"]
_FLAG = f"""SELECT *, CASE WHEN len(filled) = 0 THEN true
    WHEN regexp_full_match(trim(anio), '0*(19[0-9][0-9]|20[0-9][0-9]|2100)(\\.0)?') THEN false
    WHEN regexp_matches(k, '{"|".join(K.FOOTER_HINTS)}') THEN true
    WHEN len(filled) <= 2 AND (len(list_filter(filled, lambda v: length(v) >= 25)) > 0 OR
      len(list_filter(filled, lambda v: regexp_full_match(replace(replace(v, '.', ''), ',', ''), '-*[0-9]+'))) = 0) THEN true
    WHEN len(filled) <= 4 AND contains(k, 'total') THEN true ELSE false END AS pie
  FROM (SELECT *, {O.key("array_to_string(filled, ' ')")} AS k FROM (SELECT *,
    list_filter([trim(codigo), trim(nombre), trim(anio), trim(sector)], lambda v: v <> '') AS filled FROM ({B.sql_of(_FOOT)}) a) b) c"""


@query("footer_flag", f"SELECT _path AS archivo, _ord AS row_id, CAST(pie AS INTEGER) AS pie FROM ({_FLAG}) t")
def footer_flag(spark, sf_dir):
    df = C.with_footer_flag(B.derive(spark, sf_dir, _FOOT), _FCOLS, "anio")
    return df.select(F.col("_path").alias("archivo"), F.col("_ord").alias("row_id"), F.col("_footer").cast("int").alias("pie"))


@query("trim_footer", f"WITH f AS ({_FLAG}), e AS (SELECT _path, max(_ord) AS last FROM f WHERE NOT pie GROUP BY _path) "
       f"SELECT f._path AS archivo, f._ord AS row_id, codigo, nombre, anio, sector FROM f JOIN e ON f._path = e._path WHERE f._ord <= e.last")
def trim_footer(spark, sf_dir):
    df = C.trim_footer(B.derive(spark, sf_dir, _FOOT), "_ord", "_path", _FCOLS, "anio")
    return df.select(F.col("_path").alias("archivo"), F.col("_ord").alias("row_id"), *_FCOLS)


@query("cleaner_counts", f"WITH f AS ({_FLAG}), e AS (SELECT _path, max(_ord) AS last FROM f WHERE NOT pie GROUP BY _path), c AS ({_CELLS}) "
       "SELECT 'recortadas' AS paso, count_if(e.last IS NULL OR f._ord > e.last) AS n FROM f LEFT JOIN e ON f._path = e._path "
       "UNION ALL SELECT 'n_vacias', CAST(b AS BIGINT) FROM c UNION ALL SELECT 'n_sin_info', CAST(e AS BIGINT) FROM c")
def cleaner_counts(spark, sf_dir):
    """Rows trimmed and cells emptied, counted while the cleaned tables are written."""
    counts = Counts()
    counts.written(C.trim_footer(B.derive(spark, sf_dir, _FOOT), "_ord", "_path", _FCOLS, "anio", counts=counts))
    counts.written(C.nullify_tokens(_dirty(spark, sf_dir), counts=counts))
    return spark.createDataFrame(list(counts.get().items()), "paso string, n bigint")


_UPPER = ("trim(regexp_replace(upper(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g'))")


@query("normalize_institutions", f"SELECT _ord AS row_id, codigo, {_UPPER.format(x='institucion')} AS institucion, sector, sexo, anio, total FROM ({_DIRTY}) t")
def normalize_institutions(spark, sf_dir):
    return _named(C.normalize_institutions(_dirty(spark, sf_dir)))


@query("normalize_sex", f"WITH k AS (SELECT *, {O.key('sexo')} AS k FROM ({_DIRTY}) t) SELECT _ord AS row_id, codigo, "
       f"institucion, sector, {O.sex('sexo', 'k')} AS sexo, anio, total FROM k")
def normalize_sex(spark, sf_dir):
    return _named(C.normalize_sex(_dirty(spark, sf_dir)))


@query("convert_types", f"SELECT _ord AS row_id, codigo, institucion, sector, sexo, {O.toint('anio')} AS anio, {O.toint('total')} AS total FROM ({_DIRTY}) t")
def convert_types(spark, sf_dir):
    return _named(C.convert_types(_dirty(spark, sf_dir), ["anio", "total"]))


_CLEAN = (f"WITH n AS (SELECT _ord AS row_id, " + ", ".join(f"{_nulled(c)} AS {c}" for c in _COLS) + f" FROM ({_DIRTY}) t), "
          f"k AS (SELECT *, {O.key('sexo')} AS k FROM n) SELECT row_id, codigo, {_UPPER.format(x='institucion')} AS institucion, "
          f"sector, CASE WHEN sexo IS NOT NULL THEN {O.sex('sexo', 'k')} END AS sexo, {O.toint('anio')} AS \"Año\", {O.toint('total')} AS \"Total\" FROM k")


@query("base_clean", _CLEAN.replace('"Año"', "anio").replace('"Total"', "total"))
def base_clean(spark, sf_dir):
    df = _dirty(spark, sf_dir).withColumnsRenamed({"anio": "Año", "total": "Total"})
    return _named(C.base_clean(df)).withColumnsRenamed({"Año": "anio", "Total": "total"})


@query("year_scope_filter", f"SELECT _ord AS row_id, codigo, anio FROM ({_DIRTY}) t WHERE {O.toint('anio')} = 2020")
def year_scope_filter(spark, sf_dir):
    return _named(_dirty(spark, sf_dir).where(C.in_year("anio", 2020)).select("_ord", "codigo", "anio"))


@query("scoped_clean", f"SELECT _ord AS row_id, codigo, CASE WHEN {O.toint('anio')} = 2020 THEN {_UPPER.format(x=_nulled('institucion'))} ELSE institucion END AS institucion, "
       f"CASE WHEN {O.toint('anio')} = 2020 THEN {_nulled('sector')} ELSE sector END AS sector, "
       f"CASE WHEN {O.toint('anio')} = 2020 THEN CAST({O.toint('total')} AS VARCHAR) ELSE total END AS total FROM ({_DIRTY}) t")
def scoped_clean(spark, sf_dir):
    df = _dirty(spark, sf_dir).select("_ord", "codigo", "institucion", "sector", "anio", "total")

    def clean(d):
        return C.convert_types(C.normalize_institutions(C.nullify_tokens(d)), ["total"])
    return _named(C.scoped(df, clean, C.in_year("anio", 2020))).drop("anio")


@query("valid_years", f"SELECT DISTINCT {O.year('anio')} AS anio FROM ({B.sql_of(B.ADMIN)}) t WHERE {O.year('anio')} IS NOT NULL ORDER BY 1")
def valid_years(spark, sf_dir):
    df = B.derive(spark, sf_dir, B.ADMIN)
    return df.select(parse_year(F.col("anio")).alias("anio")).where("anio IS NOT NULL").distinct().orderBy("anio")


# --- column reports --------------------------------------------------------------------------------

_VAR = ["programa", "variante", "largo"]
_VSQL = " UNION ALL ".join(f"SELECT '{c}' AS columna, {c} AS valor, _ord FROM ({B.sql_of(B.VARIANTS)}) t" for c in _VAR)


@query("value_counts", f"SELECT columna, valor, count(*) AS frecuencia, min(_ord) AS primera FROM ({_VSQL}) u GROUP BY 1, 2")
def value_counts(spark, sf_dir):
    return A.value_counts(B.derive(spark, sf_dir, B.VARIANTS), _VAR, "_ord")


@query("column_cardinality", f"SELECT columna, count(DISTINCT valor) AS distintos FROM ({_VSQL}) u GROUP BY 1")
def column_cardinality(spark, sf_dir):
    return A.column_cardinality(B.derive(spark, sf_dir, B.VARIANTS), _VAR)


_RANKED = (f"SELECT columna, valor, frecuencia, row_number() OVER (PARTITION BY columna ORDER BY frecuencia DESC, primera, valor) AS pos "
           f"FROM (SELECT columna, valor, count(*) AS frecuencia, min(_ord) AS primera FROM ({_VSQL}) u GROUP BY 1, 2) c")
_TOP = f"SELECT columna, valor, frecuencia, pos FROM ({_RANKED}) r WHERE pos <= {K.VARIANT_TOP}"


@query("top_k_values", _TOP)
def top_k_values(spark, sf_dir):
    df = A.top_values(B.derive(spark, sf_dir, B.VARIANTS), _VAR, "_ord", K.VARIANT_TOP)
    return df.select("columna", "valor", "frecuencia", F.col("pos").cast("bigint").alias("pos"))


@query("fuzzy_pairs", f"WITH p AS (SELECT *, {O.key('valor')} AS k FROM ({_RANKED}) t) SELECT x.columna, x.valor AS a, y.valor AS b "
       f"FROM p x JOIN p y ON x.columna = y.columna AND x.pos < y.pos WHERE {O.ratio('x.k', 'y.k')} >= {K.VARIANT_THRESHOLD}")
def fuzzy_pairs(spark, sf_dir):
    return M.fuzzy_pairs(B.derive(spark, sf_dir, B.VARIANTS), _VAR, "_ord")


# The leader fold as a recursive statement: each step takes the next value of every column.
_REPORT = f"""WITH RECURSIVE p AS (SELECT *, {O.key('valor')} AS k FROM ({_RANKED}) t),
 step AS (
  SELECT columna, 0::BIGINT AS pos, []::BIGINT[] AS lead_pos, []::VARCHAR[] AS lead_key, NULL::BIGINT AS joined FROM p GROUP BY columna
  UNION ALL
  SELECT columna, pos, CASE WHEN hit IS NULL THEN list_append(lead_pos, pos) ELSE lead_pos END,
    CASE WHEN hit IS NULL THEN list_append(lead_key, k) ELSE lead_key END, lead_pos[hit]
  FROM (SELECT s.columna, p.pos, p.k, s.lead_pos, s.lead_key,
      list_position(list_transform(s.lead_key, lambda g: {O.ratio('p.k', 'g')} >= {K.VARIANT_THRESHOLD}), true) AS hit
    FROM step s JOIN p ON p.columna = s.columna AND p.pos = s.pos + 1) n)
 SELECT v.columna, v.valor AS valor_actual, c.valor AS valor_canonico, v.frecuencia AS frecuencia_actual, c.frecuencia AS frecuencia_canonico
 FROM step s JOIN p v ON v.columna = s.columna AND v.pos = s.pos JOIN p c ON c.columna = s.columna AND c.pos = s.joined"""


def _report(spark, sf_dir):
    return M.variant_report(B.derive(spark, sf_dir, B.VARIANTS), _VAR, "_ord")


@query("variant_report", _REPORT)
def variant_report(spark, sf_dir):
    return _report(spark, sf_dir)


@query("report_filter", f"SELECT * FROM ({_REPORT}) r WHERE columna = 'variante'")
def report_filter(spark, sf_dir):
    return catalog.report_filter(_report(spark, sf_dir), "variante")


@query("report_sorted", f"SELECT * FROM ({_REPORT}) r ORDER BY frecuencia_actual DESC, columna, valor_actual")
def report_sorted(spark, sf_dir):
    return catalog.report_sorted(_report(spark, sf_dir), "frecuencia_actual", descending=True)


@query("apply_corrections", f"WITH r AS ({_REPORT}) SELECT _ord AS row_id, programa, coalesce(r.valor_canonico, variante) AS variante, largo "
       f"FROM ({B.sql_of(B.VARIANTS)}) t LEFT JOIN r ON r.columna = 'variante' AND r.valor_actual = variante")
def apply_corrections(spark, sf_dir):
    report = catalog.report_filter(_report(spark, sf_dir), "variante")
    return _named(J.apply_corrections(B.derive(spark, sf_dir, B.VARIANTS), report))


# A value of every order, and corrections among those values: chains, cycles, several from one value.
_VALUED = "SELECT o_orderkey AS _ord, year(o_orderdate) AS anio, 'v' || CAST(o_custkey % 400 AS STRING) AS clave, o_orderpriority AS otra FROM {orders}"
_CHOSEN = """SELECT c_custkey * 37 % 1009 * 100000 + c_custkey AS pos, CASE WHEN c_custkey % 9 = 0 THEN 'ausente' ELSE 'clave' END AS columna,
  'v' || CAST(c_custkey % 400 AS STRING) AS valor_actual, 'v' || CAST((c_custkey * 7 + c_custkey % 13) % 400 AS STRING) AS valor_canonico,
  c_custkey % 4 <> 0 AS aplicar, c_custkey % 5 = 0 AS invertir FROM {customer}"""


@query("apply_corrections_chosen", f"""WITH RECURSIVE r AS (SELECT pos, CASE WHEN invertir THEN valor_canonico ELSE valor_actual END AS src,
  CASE WHEN invertir THEN valor_actual ELSE valor_canonico END AS dst FROM ({B.sql_of(_CHOSEN)}) c WHERE aplicar AND columna = 'clave'),
  n AS (SELECT a.pos, any_value(a.dst) AS dst, min(b.pos) AS nxt FROM r a LEFT JOIN r b ON b.src = a.dst AND b.pos > a.pos GROUP BY a.pos),
  w AS (SELECT src AS v, min(pos) AS pos FROM r GROUP BY 1 UNION ALL SELECT w.v, n.nxt FROM w JOIN n USING (pos) WHERE n.nxt IS NOT NULL),
  f AS (SELECT v, max(pos) AS pos FROM w GROUP BY 1)
  SELECT _ord AS row_id, anio, CASE WHEN anio = 1995 THEN coalesce(n.dst, clave) ELSE clave END AS clave, otra
  FROM ({B.sql_of(_VALUED)}) t LEFT JOIN f ON f.v = clave LEFT JOIN n ON n.pos = f.pos""")
def apply_corrections_chosen(spark, sf_dir):
    """Only the marked corrections, some inverted, one after another in report order, in one year."""
    df = B.derive(spark, sf_dir, _VALUED)
    out = J.apply_corrections(df, B.derive(spark, sf_dir, _CHOSEN), scope=C.in_year("anio", 1995))
    return _named(out).withColumn("anio", F.col("anio").cast("bigint"))


@query("null_counts", "SELECT columna, CAST(sum(nulo) AS BIGINT) AS nulos FROM ("
       + " UNION ALL ".join(f"SELECT '{c}' AS columna, CAST({_nulled(c)} IS NULL AS INTEGER) AS nulo FROM ({_DIRTY}) t" for c in _COLS) + ") u GROUP BY 1")
def null_counts(spark, sf_dir):
    return A.null_counts(C.nullify_tokens(_dirty(spark, sf_dir)), _COLS)


# --- staging ---------------------------------------------------------------------------------------------

def _staged_sql(text, cols, measure=None):
    picks = [f"{O.toint(c)} AS {c}" if c == measure else c for c in cols]
    return f"SELECT _ord AS row_id, {', '.join(picks)} FROM ({text}) t"


_ADMIN_COLS = K.IES_COLUMNS + ["anio", "semestre"] + K.ADMIN_MEASURES
_STAFF_COLS = K.IES_COLUMNS + K.STAFF_TEXTS + ["anio", "semestre", "num_docentes"]


@query("stage_admin", _staged_sql(B.sql_of(B.ADMIN), _ADMIN_COLS))
def stage_admin(spark, sf_dir):
    return _named(masters.stage_admin(B.under_headers(B.derive(spark, sf_dir, B.ADMIN), "Administrativos")))


@query("stage_docentes", _staged_sql(B.sql_of(B.STAFF), _STAFF_COLS))
def stage_docentes(spark, sf_dir):
    return _named(masters.stage_staff(B.under_headers(B.derive(spark, sf_dir, B.STAFF), "Docentes")))


_STUDENT_COLS = (K.IES_COLUMNS + K.PROGRAM_COLUMNS + K.OFFER_COLUMNS + ["sexo", "anio", "semestre"])


@query("stage_students", " UNION ALL ".join(
    f"SELECT _ord AS row_id, '{m}' AS marco, {', '.join('CAST(NULL AS VARCHAR) AS ' + c if m == 'matriculados' and c.startswith('cine') or m == 'graduados' and c == 'municipio_ies_codigo' else c for c in _STUDENT_COLS)}, "
    f"{O.toint('medida')} AS medida FROM ({B.sql_of(B.STUDENTS)}) t WHERE _marco = '{m}'" for m in K.STUDENT_MEASURES.values()))
def stage_students(spark, sf_dir):
    """All four frames; enrolled students have no field classification and graduates no known
    municipality header, so those columns are null there."""
    frames = B.student_frames(B.derive(spark, sf_dir, B.STUDENTS))
    out = None
    for category, m in K.STUDENT_MEASURES.items():
        one = masters.stage_students(B.under_headers(frames[m], category), m).select(
            "_ord", F.lit(m).alias("marco"), *_STUDENT_COLS, F.col(m).alias("medida"))
        out = one if out is None else out.unionByName(one)
    return _named(out)


@query("alias_rename", f"SELECT anio, semestre, count(*) AS n, CAST(sum({O.toint('total')}) AS BIGINT) AS total FROM ({B.sql_of(B.ADMIN)}) t GROUP BY 1, 2")
def alias_rename(spark, sf_dir):
    df = masters.alias_rename(B.under_headers(B.derive(spark, sf_dir, B.ADMIN), "Administrativos"))
    return df.groupBy("anio", "semestre").agg(F.count(F.lit(1)).alias("n"), F.sum(to_int_or_zero(F.col("total"))).alias("total"))


# --- metadata ---------------------------------------------------------------------------------------------

_META = """SELECT tipo, anio, count(*) AS registros FROM (
  SELECT 'Administrativos' AS tipo, year(o_orderdate) AS anio FROM orders
  UNION ALL SELECT 'Docentes', year(l_shipdate) FROM lineitem) m GROUP BY 1, 2"""


def _master(spark, sf_dir):
    t = B.tables(spark, sf_dir, ["orders", "lineitem"])
    return (t["orders"].select(F.lit("Administrativos").alias("tipo"), F.year("o_orderdate").cast("bigint").alias("anio"))
            .unionByName(t["lineitem"].select(F.lit("Docentes").alias("tipo"), F.year("l_shipdate").cast("bigint").alias("anio"))))


@query("metadata_counts", _META)
def metadata_counts(spark, sf_dir):
    return catalog.metadata_counts(_master(spark, sf_dir))


@query("metadata_totals", f"SELECT tipo, anio, CAST(sum(registros) AS BIGINT) AS registros, count(*) AS datasets FROM ({_META}) m "
       "GROUP BY GROUPING SETS ((tipo, anio), (tipo))")
def metadata_totals(spark, sf_dir):
    return catalog.metadata_totals(catalog.metadata_counts(_master(spark, sf_dir)))


@query("metadata_upsert", f"SELECT * FROM ({_META}) m WHERE tipo <> 'Docentes' UNION ALL "
       "SELECT 'Docentes', year(ts), count(*) FROM events GROUP BY 2")
def metadata_upsert(spark, sf_dir):
    old = catalog.metadata_counts(_master(spark, sf_dir))
    events = B.tables(spark, sf_dir, ["events"])["events"]
    fresh = catalog.metadata_counts(events.select(F.lit("Docentes").alias("tipo"), F.year("ts").cast("bigint").alias("anio")))
    return catalog.metadata_upsert(old, fresh, "Docentes")


@query("dataset_preview", f"SELECT _ord AS row_id, institucion_codigo, anio, total AS valor, (SELECT count(*) FROM ({B.sql_of(B.ADMIN)}) c WHERE anio = '1998') AS total "
       f"FROM ({B.sql_of(B.ADMIN)}) t WHERE anio = '1998' ORDER BY _ord LIMIT {K.PREVIEW_ROWS}")
def dataset_preview(spark, sf_dir):
    df = B.derive(spark, sf_dir, B.ADMIN).select(F.col("_ord").alias("row_id"), "institucion_codigo", "anio", F.col("total").alias("valor"))
    return catalog.dataset_preview(df, F.col("anio") == "1998", ["row_id"], K.PREVIEW_ROWS)


@query("reload_aligned", f"SELECT _ord AS row_id, {O.toint('anio')} AS anio, codigo, '' AS caracter, sector FROM ({_DIRTY}) t WHERE {O.toint('anio')} <> 0")
def reload_aligned(spark, sf_dir):
    df = catalog.reload_aligned(_dirty(spark, sf_dir), ["codigo", "caracter", "sector"], "anio")
    return df.select(F.col("_ord").alias("row_id"), F.col("_anio").alias("anio"), "codigo", "caracter", "sector")


@query("n_largest", "SELECT c_custkey AS row_id, c_name, CAST(c_acctbal * 100 AS BIGINT) AS centavos FROM customer ORDER BY centavos DESC, row_id LIMIT 10")
def n_largest(spark, sf_dir):
    df = B.tables(spark, sf_dir, ["customer"])["customer"].select(
        F.col("c_custkey").alias("row_id"), "c_name", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("centavos"))
    return A.n_largest(df, "centavos", "row_id", 10)


@query("top_n_per_group", "SELECT l_suppkey, _ord AS row_id, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY _ord, l_partkey) AS r "
       "FROM (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS _ord, l_partkey FROM lineitem) a) t WHERE r <= 5")
def top_n_per_group(spark, sf_dir):
    df = B.tables(spark, sf_dir, ["lineitem"])["lineitem"].select(
        "l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), "l_partkey")
    return A.top_n(df, ["l_suppkey"], [F.asc("row_id"), F.asc("l_partkey")], 5)


@query("surrogate_keys", "SELECT nombre, row_number() OVER (ORDER BY primera, nombre) AS id FROM (SELECT o_orderpriority || ' ' || o_orderstatus || ' ' || CAST(o_custkey AS VARCHAR) AS nombre, "
       "min(o_orderkey) AS primera FROM orders GROUP BY 1) t")
def surrogate_keys(spark, sf_dir):
    orders = B.tables(spark, sf_dir, ["orders"])["orders"]
    names = orders.select(F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string")).alias("nombre"), "o_orderkey")
    first = names.groupBy("nombre").agg(F.min("o_orderkey").alias("primera"))
    return A.number_rows(first, ["primera", "nombre"]).select("nombre", "id")


@query("surrogate_keys_ranged", "SELECT _ord AS row_id, row_number() OVER (ORDER BY _ord, l_partkey, l_suppkey, l_quantity) AS id, l_partkey, l_suppkey FROM "
       "(SELECT l_orderkey * 8 + l_linenumber AS _ord, l_partkey, l_suppkey, l_quantity FROM lineitem) t")
def surrogate_keys_ranged(spark, sf_dir):
    """Ids of a large table: numbered inside ranges, then shifted."""
    df = B.tables(spark, sf_dir, ["lineitem"])["lineitem"].select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), "l_partkey", "l_suppkey", "l_quantity")
    return A.number_rows(df, ["row_id", "l_partkey", "l_suppkey", "l_quantity"]).drop("l_quantity")
