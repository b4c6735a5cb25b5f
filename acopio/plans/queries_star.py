"""Queries for lookups, references, dimensions and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import numeric_code
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators.counts import Counts
from ..session import pin, stage
from ..sources import masters
from . import bindings as B
from . import oracle as O
from . import star as S
from .registry import query

_ADMIN, _STAFF, _STUDENTS = (B.sql_of(x) for x in (B.ADMIN, B.STAFF, B.STUDENTS))


def _admin(spark, sf_dir):
    return masters.stage_admin(B.derive(spark, sf_dir, B.ADMIN))


def _staff(spark, sf_dir):
    return masters.stage_staff(B.derive(spark, sf_dir, B.STAFF))


def _students(spark, sf_dir):
    """Measure -> staging frame."""
    frames = B.student_frames(B.derive(spark, sf_dir, B.STUDENTS))
    return {m: masters.stage_students(df, m) for m, df in frames.items()}


def _frames(spark, sf_dir):
    return [_admin(spark, sf_dir), _staff(spark, sf_dir), *_students(spark, sf_dir).values()]


# --- facts ---------------------------------------------------------------------------------------------

_FACT_ADMIN = (f"SELECT {O.code('institucion_codigo')} AS institucion_codigo, {O.toint('anio')} AS anio, {O.toint('semestre')} AS semestre, "
               + ", ".join(f"CAST(sum({O.toint(m)}) AS BIGINT) AS {m}" for m in K.ADMIN_MEASURES)
               + f" FROM ({_ADMIN}) t WHERE {O.code('institucion_codigo')} IS NOT NULL GROUP BY 1, 2, 3")
_FACT_STAFF = (f"SELECT {O.code('institucion_codigo')} AS institucion_codigo, "
               + ", ".join(f"{O.clean(c)} AS {c}" for c in K.STAFF_TEXTS)
               + f", {O.toint('anio')} AS anio, {O.toint('semestre')} AS semestre, CAST(sum({O.toint('num_docentes')}) AS BIGINT) AS num_docentes "
               f"FROM ({_STAFF}) t WHERE {O.code('institucion_codigo')} IS NOT NULL GROUP BY ALL")


def _measure_sql(m):
    return (f"SELECT {O.code('institucion_codigo')} AS institucion_codigo, {O.code('programa_codigo')} AS programa_codigo, "
            f"{O.code('municipio_programa_codigo')} AS municipio_programa_codigo, {O.clean('sexo')} AS sexo, "
            f"{O.toint('anio')} AS anio, {O.toint('semestre')} AS semestre, CAST(sum({O.toint('medida')}) AS BIGINT) AS {m} "
            f"FROM ({_STUDENTS}) t WHERE _marco = '{m}' AND {O.code('institucion_codigo')} IS NOT NULL "
            f"AND {O.code('programa_codigo')} IS NOT NULL GROUP BY ALL")


def _full_join(sqls, keys):
    """Chained full outer joins on IS NOT DISTINCT FROM, the long way round."""
    names = list(sqls)
    cur = f"SELECT * FROM ({sqls[names[0]]}) m0"
    done = [names[0]]
    for n in names[1:]:
        on = " AND ".join(f"l.{k} IS NOT DISTINCT FROM r.{k}" for k in keys)
        picks = ", ".join([f"coalesce(l.{k}, r.{k}) AS {k}" for k in keys] + [f"l.{d}" for d in done] + [f"r.{n}"])
        cur = f"SELECT {picks} FROM ({cur}) l FULL JOIN ({sqls[n]}) r ON {on}"
        done.append(n)
    return f"SELECT {', '.join(keys)}, " + ", ".join(f"coalesce({d}, 0) AS {d}" for d in done) + f" FROM ({cur}) j"


_FACT_STUDENTS = _full_join({m: _measure_sql(m) for m in K.STUDENT_MEASURES.values()}, K.STUDENT_KEYS)


@query("fact_students", _FACT_STUDENTS)
def fact_students(spark, sf_dir):
    return S.fact_students(_students(spark, sf_dir))


@query("outer_merge_nullsafe", _full_join({
    "pedidos": "SELECT nullif(o_orderstatus, 'P') AS estado, year(o_orderdate) AS anio, count(*) AS pedidos FROM orders GROUP BY 1, 2",
    "lineas": "SELECT nullif(l_linestatus, 'F') AS estado, year(l_shipdate) AS anio, count(*) AS lineas FROM lineitem GROUP BY 1, 2",
    "eventos": "SELECT CAST(NULL AS VARCHAR) AS estado, year(ts) AS anio, count(*) AS eventos FROM events GROUP BY 1, 2"}, ["estado", "anio"]))
def outer_merge_nullsafe(spark, sf_dir):
    t = B.tables(spark, sf_dir, ["orders", "lineitem", "events"])

    def counted(df, state, date, m):
        return df.groupBy(state.alias("estado"), F.year(date).cast("bigint").alias("anio")).agg(F.count(F.lit(1)).alias(m))
    return J.outer_merge([
        (counted(t["orders"], F.nullif("o_orderstatus", F.lit("P")), "o_orderdate", "pedidos"), "pedidos"),
        (counted(t["lineitem"], F.nullif("l_linestatus", F.lit("F")), "l_shipdate", "lineas"), "lineas"),
        (counted(t["events"], F.lit(None).cast("string"), "ts", "eventos"), "eventos")], ["estado", "anio"])


@query("fact_admin", _FACT_ADMIN)
def fact_admin(spark, sf_dir):
    return S.fact_admin(_admin(spark, sf_dir))


@query("fact_staff", _FACT_STAFF)
def fact_staff(spark, sf_dir):
    return S.fact_staff(_staff(spark, sf_dir))


# --- dimensions ------------------------------------------------------------------------------------------

_SOURCES = [("admin", _ADMIN, None), ("staff", _STAFF, None)] + [("students", _STUDENTS, m) for m in K.STUDENT_MEASURES.values()]


def _rows(spec, only_students=False):
    """UNION ALL of projections in source order, with (src, _ord) as the reading order."""
    parts, pos = [], 0
    for name, text, marco in _SOURCES:
        if only_students and name != "students":
            continue
        for cols, needs_offer in spec:
            if needs_offer and name != "students":
                continue
            where = f" WHERE _marco = '{marco}'" if marco else ""
            parts.append(f"SELECT {pos} AS src, _ord, {', '.join(f'{v} AS {k}' for k, v in cols.items())} FROM ({text}) t{where}")
            pos += 1
    return " UNION ALL ".join(parts)


def _first(key, cols, rows):
    """First non-null per column by (src, _ord, value)."""
    picks = ", ".join(f"arg_min({c}, (src, _ord, {c})) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in cols)
    return f"SELECT * FROM (SELECT {key}, {picks} FROM ({rows}) u WHERE {key} IS NOT NULL GROUP BY {key}) g WHERE nombre IS NOT NULL"


_DEPARTMENT = _first("codigo", ["nombre"], _rows([
    ({"codigo": O.code("departamento_ies_codigo"), "nombre": O.clean("departamento_ies_nombre")}, False),
    ({"codigo": O.code("departamento_programa_codigo"), "nombre": O.clean("departamento_programa_nombre")}, True)]))
_MUNICIPALITY = _first("codigo", ["nombre", "departamento_codigo"], _rows([
    ({"codigo": O.code("municipio_ies_codigo"), "nombre": O.clean("municipio_ies_nombre"), "departamento_codigo": O.code("departamento_ies_codigo")}, False),
    ({"codigo": O.code("municipio_programa_codigo"), "nombre": O.clean("municipio_programa_nombre"), "departamento_codigo": O.code("departamento_programa_codigo")}, True)]))
_PARENT = f"nullif({O.code('ies_padre_codigo')}, {O.code('institucion_codigo')})"
_INST_RAW = _first("codigo", ["nombre", "sector", "caracter", "tipo", "municipio_codigo", "ies_padre_codigo"], _rows([({
    "codigo": O.code("institucion_codigo"), "nombre": O.clean("institucion_nombre"), "sector": O.clean("sector_ies"),
    "caracter": O.clean("caracter_ies"), "tipo": O.clean("principal_seccional"), "municipio_codigo": O.code("municipio_ies_codigo"),
    "ies_padre_codigo": _PARENT}, False)]))
_INSTITUTION = (f"WITH i AS ({_INST_RAW}), m AS ({_MUNICIPALITY}) SELECT i.codigo, i.nombre, i.sector, i.caracter, i.tipo, m.codigo AS municipio_codigo, "
                f"p.codigo AS ies_padre_codigo FROM i LEFT JOIN m ON m.codigo = i.municipio_codigo LEFT JOIN i p ON p.codigo = i.ies_padre_codigo")
_PROG_COLS = {"nombre": "programa_nombre", "nivel_academico": "nivel_academico", "nivel_formacion": "nivel_formacion_programa",
              "metodologia": "metodologia", "area_conocimiento": "area_conocimiento", "nbc": "nbc",
              "cine_campo_amplio": "cine_campo_amplio", "cine_campo_especifico": "cine_campo_especifico", "cine_detallado": "cine_detallado"}
_PROG_RAW = _first("codigo", list(_PROG_COLS), _rows([({"codigo": O.code("programa_codigo"), **{k: O.clean(v) for k, v in _PROG_COLS.items()}}, False)], only_students=True))


def _text_dim(column, only_students=True):
    rows = _rows([({"nombre": O.clean(column)}, False)], only_students=only_students)
    return (f"SELECT row_number() OVER (ORDER BY src, ord, nombre) AS id, nombre FROM (SELECT arg_min(nombre, (src, _ord, nombre)) AS nombre, "
            f"arg_min(src, (src, _ord, nombre)) AS src, arg_min(_ord, (src, _ord, nombre)) AS ord FROM ({rows}) u WHERE nombre IS NOT NULL GROUP BY {O.collation('nombre')}) g")


_BROAD = _text_dim("cine_campo_amplio")
_LOOK = "(SELECT k, max(id) AS id FROM (SELECT {key} AS k, id FROM {dim}) q WHERE k <> '' GROUP BY k)"


def _look(dim):
    return _LOOK.format(key=O.key("nombre"), dim=dim)


_SPECIFIC = f"""SELECT row_number() OVER (ORDER BY cod, nombre, campo_amplio_id) AS id, nombre, campo_amplio_id FROM (
  SELECT b.id AS campo_amplio_id, arg_min(cine_campo_especifico, (CAST(p.codigo AS BIGINT), cine_campo_especifico)) AS nombre, min(CAST(p.codigo AS BIGINT)) AS cod
  FROM prog p JOIN {_look('broad')} b ON b.k = {O.key('p.cine_campo_amplio')} WHERE cine_campo_especifico IS NOT NULL
  GROUP BY b.id, {O.collation('cine_campo_especifico')}) g"""
_DETAIL = f"""SELECT row_number() OVER (ORDER BY cod, nombre, campo_especifico_id) AS id, nombre, nombre AS codigo, campo_especifico_id FROM (
  SELECT s.id AS campo_especifico_id, arg_min(cine_detallado, (CAST(p.codigo AS BIGINT), cine_detallado)) AS nombre, min(CAST(p.codigo AS BIGINT)) AS cod
  FROM prog p JOIN {_look('broad')} b ON b.k = {O.key('p.cine_campo_amplio')}
  JOIN specific s ON {O.key('s.nombre')} = {O.key('p.cine_campo_especifico')} AND s.campo_amplio_id = b.id
  WHERE cine_detallado IS NOT NULL GROUP BY s.id, {O.collation('cine_detallado')}) g"""
_HIER = f"prog AS MATERIALIZED ({_PROG_RAW}), broad AS MATERIALIZED ({_BROAD}), specific AS MATERIALIZED ({_SPECIFIC})"
_HIER3 = f"{_HIER}, detail AS MATERIALIZED ({_DETAIL})"


def _hierarchy(spark, sf_dir):
    scan = stage(S.dimension_scan(list(_students(spark, sf_dir).values()), ["PROGRAMA"], ["area_conocimiento", "nbc", "cine_campo_amplio"]), "scan")
    programs, broad = pin(S.dim_program_texts(scan)), S.dim_text(scan, "cine_campo_amplio")
    return programs, scan, broad, S.dim_cine_specific(programs, broad)


@query("first_non_empty", _first("codigo", ["nombre", "sector"], _rows([({"codigo": O.code("institucion_codigo"), "nombre": O.clean("institucion_nombre"),
       "sector": O.clean("sector_ies")}, False)]).split(" UNION ALL ")[0]))
def first_non_empty(spark, sf_dir):
    df = _admin(spark, sf_dir).select(
        numeric_code(F.col("institucion_codigo")).alias("codigo"), S.clean_value(F.col("institucion_nombre")).alias("nombre"),
        S.clean_value(F.col("sector_ies")).alias("sector"), "_ord").where("codigo IS NOT NULL")
    return A.first_non_empty(df, "codigo", ["nombre", "sector"], "_ord").where("nombre IS NOT NULL")


@query("dim_department", _DEPARTMENT)
def dim_department(spark, sf_dir):
    return S.dim_department(_frames(spark, sf_dir))


@query("dim_municipality", _MUNICIPALITY)
def dim_municipality(spark, sf_dir):
    return S.dim_municipality(_frames(spark, sf_dir))


@query("dim_institution", _INSTITUTION)
def dim_institution(spark, sf_dir):
    scan = stage(S.dimension_scan(_frames(spark, sf_dir), ["INSTITUCION", "MUNICIPIO"]), "scan")
    inst = S.fk_nullify(S.dim_institution(scan), "municipio_codigo", S.dim_municipality(scan), "codigo")
    return S.with_valid_parents(pin(inst))


@query("parent_links", f"WITH i AS ({_INST_RAW}) SELECT c.codigo, c.ies_padre_codigo FROM i c JOIN i p ON p.codigo = c.ies_padre_codigo")
def parent_links(spark, sf_dir):
    return S.valid_parent_links(pin(S.dim_institution(_frames(spark, sf_dir))))


@query("dim_program", f"WITH {_HIER3}, area AS MATERIALIZED ({_text_dim('area_conocimiento')}), nbc AS MATERIALIZED ({_text_dim('nbc')}) "
       f"SELECT p.codigo, p.nombre, p.nivel_academico, p.nivel_formacion, p.metodologia, a.id AS area_id, n.id AS nbc_id, d.id AS cine_detallado_id FROM prog p "
       f"LEFT JOIN {_look('area')} a ON a.k = {O.key('p.area_conocimiento')} LEFT JOIN {_look('nbc')} n ON n.k = {O.key('p.nbc')} "
       f"LEFT JOIN {_look('broad')} b ON b.k = {O.key('p.cine_campo_amplio')} "
       f"LEFT JOIN specific s ON s.campo_amplio_id = b.id AND {O.key('s.nombre')} = {O.key('p.cine_campo_especifico')} "
       f"LEFT JOIN detail d ON d.campo_especifico_id = s.id AND {O.key('d.nombre')} = {O.key('p.cine_detallado')}")
def dim_program(spark, sf_dir):
    programs, scan, broad, specific = _hierarchy(spark, sf_dir)
    detail = S.dim_cine_detail(programs, broad, specific)
    dims = S.text_dims(scan, ["area_conocimiento", "nbc"])
    out = S.dim_program(programs, dims["area_conocimiento"], dims["nbc"], broad, specific, detail)
    return out.withColumnRenamed(K.PROGRAM_KEY, "codigo")


@query("dim_text", _text_dim("area_conocimiento"))
def dim_text(spark, sf_dir):
    return S.dim_text(list(_students(spark, sf_dir).values()), "area_conocimiento")


_SEX_ROWS = " UNION ALL ".join([f"SELECT 0 AS src, _ord, sexo FROM ({_STAFF}) t"] + [
    f"SELECT {i + 1}, _ord, sexo FROM ({_STUDENTS}) t WHERE _marco = '{m}'" for i, m in enumerate(K.STUDENT_MEASURES.values())])
_SEX_DIM = f"""WITH v AS (SELECT sexo, {O.key('sexo')} AS k, min((src, _ord)) AS o FROM ({_SEX_ROWS}) u GROUP BY 1, 2),
  m AS (SELECT {O.clean(O.sex('sexo', 'k'))} AS nombre, o FROM v)
  SELECT row_number() OVER (ORDER BY o, nombre) AS id, nombre FROM (SELECT arg_min(nombre, (o, nombre)) AS nombre, min(o) AS o FROM m
  WHERE nombre IS NOT NULL GROUP BY {O.collation('nombre')}) g"""


@query("dim_sex", _SEX_DIM)
def dim_sex(spark, sf_dir):
    return S.dim_sex([_staff(spark, sf_dir), *_students(spark, sf_dir).values()])


@query("dim_cine_specific", f"WITH {_HIER} SELECT * FROM specific")
def dim_cine_specific(spark, sf_dir):
    return _hierarchy(spark, sf_dir)[3]


@query("dim_cine_detail", f"WITH {_HIER3} SELECT * FROM detail")
def dim_cine_detail(spark, sf_dir):
    programs, _, broad, specific = _hierarchy(spark, sf_dir)
    return S.dim_cine_detail(programs, broad, specific)


# --- lookups and references ----------------------------------------------------------------------------------

@query("fk_text_lookup", f"WITH dim AS MATERIALIZED ({_text_dim('area_conocimiento')}) SELECT _ord AS row_id, institucion_codigo, programa_codigo, area_conocimiento, l.id AS area_id "
       f"FROM ({_STUDENTS}) t LEFT JOIN {_look('dim')} l ON l.k = {O.key('area_conocimiento')}")
def fk_text_lookup(spark, sf_dir):
    scan = stage(S.dimension_scan(list(_students(spark, sf_dir).values()), [], ["area_conocimiento"]), "scan")
    dim = S.dim_text(scan, "area_conocimiento")
    df = B.derive(spark, sf_dir, B.STUDENTS).select(F.col("_ord").alias("row_id"), "institucion_codigo", "programa_codigo", "area_conocimiento")
    return J.fk_text(df, "area_conocimiento", dim, "area_id", texts=S.texts_of(scan, "area_conocimiento"))


@query("fk_hierarchy_lookup", f"WITH {_HIER3} SELECT p.codigo, d.id AS cine_detallado_id FROM prog p "
       f"LEFT JOIN {_look('broad')} b ON b.k = {O.key('p.cine_campo_amplio')} "
       f"LEFT JOIN specific s ON s.campo_amplio_id = b.id AND {O.key('s.nombre')} = {O.key('p.cine_campo_especifico')} "
       f"LEFT JOIN detail d ON d.campo_especifico_id = s.id AND {O.key('d.nombre')} = {O.key('p.cine_detallado')}")
def fk_hierarchy_lookup(spark, sf_dir):
    programs, _, broad, specific = _hierarchy(spark, sf_dir)
    detail = S.dim_cine_detail(programs, broad, specific)
    out = J.fk_hierarchy(programs, [("cine_campo_amplio", broad, None), ("cine_campo_especifico", specific, "campo_amplio_id"),
                                    ("cine_detallado", detail, "campo_especifico_id")], "cine_detallado_id")
    return out.select(F.col(K.PROGRAM_KEY).alias("codigo"), "cine_detallado_id")


# Lines referring to large parts only: some references dangle.
_PARTS = "SELECT p_partkey FROM part WHERE p_size > 10"
_LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem"


def _lines(spark, sf_dir):
    t = B.tables(spark, sf_dir, ["lineitem", "part"])
    return (t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
            t["part"].where("p_size > 10").select("p_partkey"))


@query("fk_semi", f"SELECT * FROM ({_LINES}) t WHERE l_partkey IN ({_PARTS})")
def fk_semi(spark, sf_dir):
    df, parents = _lines(spark, sf_dir)
    return J.fk_semi(df, "l_partkey", parents, "p_partkey")


@query("fk_semi_salted", f"SELECT * FROM ({_LINES}) t WHERE l_partkey IN ({_PARTS})")
def fk_semi_salted(spark, sf_dir):
    """The form beyond the broadcast bound: the parent side copied per salt."""
    df, parents = _lines(spark, sf_dir)
    keys = parents.select(F.col("p_partkey").alias("l_partkey")).distinct()
    return J.salted(df, keys, ["l_partkey"], "left_semi")


@query("fk_anti_count", f"SELECT count(*) AS descartadas FROM ({_LINES}) t WHERE l_partkey NOT IN ({_PARTS})")
def fk_anti_count(spark, sf_dir):
    df, parents = _lines(spark, sf_dir)
    return J.fk_missing(df, "l_partkey", parents, "p_partkey").agg(F.count(F.lit(1)).alias("descartadas"))


@query("fk_nullify", f"SELECT l_orderkey, l_linenumber, p.p_partkey AS l_partkey, l_suppkey FROM ({_LINES}) t LEFT JOIN ({_PARTS}) p ON p.p_partkey = t.l_partkey")
def fk_nullify(spark, sf_dir):
    df, parents = _lines(spark, sf_dir)
    return J.fk_nullify(df, "l_partkey", parents, "p_partkey")


@query("reference_counts", f"WITH i AS ({_INST_RAW}) SELECT 'descartadas' AS paso, count(*) AS n FROM ({_LINES}) t WHERE l_partkey NOT IN ({_PARTS}) "
       f"UNION ALL SELECT 'anuladas', count(*) FROM ({_LINES}) t WHERE l_partkey NOT IN ({_PARTS}) "
       "UNION ALL SELECT 'omitidas', count(*) FROM i WHERE ies_padre_codigo IS NOT NULL AND ies_padre_codigo NOT IN (SELECT codigo FROM i)")
def reference_counts(spark, sf_dir):
    """Rows dropped, keys made null and parent links left out, counted while the results are written."""
    counts = Counts()
    df, parents = _lines(spark, sf_dir)
    counts.written(J.fk_semi(df, "l_partkey", parents, "p_partkey", counts=counts))
    counts.written(J.fk_nullify(df, "l_partkey", parents, "p_partkey", counts=counts))
    inst = pin(S.dim_institution(_frames(spark, sf_dir)))
    counts.written(S.valid_parent_links(inst, counts=counts))
    return spark.createDataFrame(list(counts.get().items()), "paso string, n bigint")


# --- loading and constraints ---------------------------------------------------------------------------------

# Existing dimension: spellings with an upper-case first part; incoming: all spellings.
_SPELL = """SELECT o_orderkey AS _ord, CASE o_orderkey % 3 WHEN 0 THEN 'Institución ' || CAST(o_custkey AS STRING)
  WHEN 1 THEN 'INSTITUCION ' || CAST(o_custkey AS STRING) ELSE 'institución ' || CAST(o_custkey AS STRING) || ' ' END AS nombre FROM {orders}"""
_HAVE = "SELECT 'INSTITUCIÓN ' || CAST(c_custkey AS STRING) AS nombre FROM {customer} WHERE c_nationkey < 10"


@query("dim_collation_dedupe", f"SELECT arg_min(nombre, (_ord, nombre)) AS nombre, min(_ord) AS primera FROM ({B.sql_of(_SPELL)}) t GROUP BY {O.collation('nombre')}")
def dim_collation_dedupe(spark, sf_dir):
    return A.distinct_first(B.derive(spark, sf_dir, _SPELL), "nombre", "_ord").withColumnRenamed("_ord", "primera")


@query("insert_ignore", f"SELECT arg_min(nombre, (_ord, nombre)) AS nombre, min(_ord) AS primera FROM ({B.sql_of(_SPELL)}) t "
       f"WHERE {O.collation('nombre')} NOT IN (SELECT {O.collation('nombre')} FROM ({B.sql_of(_HAVE)}) h) GROUP BY {O.collation('nombre')}")
def insert_ignore(spark, sf_dir):
    have = B.derive(spark, sf_dir, _HAVE)
    new = B.derive(spark, sf_dir, _SPELL).withColumnRenamed("_ord", "primera")
    return S.insert_ignore(have, new, ["nombre"], "primera")


@query("insert_if_empty", "SELECT 'vacia' AS destino, o_custkey AS k, count(*) AS n FROM orders GROUP BY 2")
def insert_if_empty(spark, sf_dir):
    """Into an empty target everything goes, into a filled one nothing."""
    fact = B.tables(spark, sf_dir, ["orders"])["orders"].groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    empty = S.insert_if_empty(fact.where("n < 0"), fact).select(F.lit("vacia").alias("destino"), "k", "n")
    return empty.unionByName(S.insert_if_empty(fact, fact).select(F.lit("llena").alias("destino"), "k", "n"))


def _staged(spark, sf_dir):
    out = {"Administrativos": _admin(spark, sf_dir), "Docentes": _staff(spark, sf_dir)}
    by_measure = {m: c for c, m in K.STUDENT_MEASURES.items()}
    out.update({by_measure[m]: df for m, df in _students(spark, sf_dir).items()})
    return out


_N = "SELECT '{t}' AS tabla, count(*) AS filas FROM ({q}) x"
_STAR_COUNTS = f"WITH {_HIER3}, inst AS MATERIALIZED ({_INSTITUTION}), muni AS MATERIALIZED ({_MUNICIPALITY}) " + " UNION ALL ".join([
    _N.format(t="DEPARTAMENTO", q=_DEPARTMENT), _N.format(t="MUNICIPIO", q="SELECT * FROM muni"), _N.format(t="INSTITUCION", q="SELECT * FROM inst"),
    _N.format(t="SEXO", q=_SEX_DIM), _N.format(t="AREA_CONOCIMIENTO", q=_text_dim("area_conocimiento")), _N.format(t="NBC", q=_text_dim("nbc")),
    _N.format(t="CINE_CAMPO_AMPLIO", q="SELECT * FROM broad"), _N.format(t="CINE_CAMPO_ESPECIFICO", q="SELECT * FROM specific"),
    _N.format(t="CINE_DETALLADO", q="SELECT * FROM detail"), _N.format(t="PROGRAMA", q="SELECT * FROM prog")] + [
    _N.format(t=t, q=f"SELECT DISTINCT {O.collation(O.clean(c))} FROM ({_STAFF}) s WHERE {O.clean(c)} IS NOT NULL") for t, c in (
        ("NIVEL_FORMACION_DOCENTE", "nivel_formacion_docente"), ("TIEMPO_DEDICACION", "tiempo_dedicacion"), ("TIPO_CONTRATO", "tipo_contrato"))] + [
    _N.format(t="HECHO_ADMINISTRATIVOS", q=f"SELECT * FROM ({_FACT_ADMIN}) f WHERE institucion_codigo IN (SELECT codigo FROM inst)"),
    _N.format(t="HECHO_DOCENTES", q=f"SELECT * FROM ({_FACT_STAFF}) f WHERE institucion_codigo IN (SELECT codigo FROM inst)"),
    _N.format(t="HECHO_ESTUDIANTES", q=f"SELECT * FROM ({_FACT_STUDENTS}) f WHERE institucion_codigo IN (SELECT codigo FROM inst) AND programa_codigo IN (SELECT codigo FROM prog)")])


@query("build_star", _STAR_COUNTS)
def build_star(spark, sf_dir):
    """Row counts of all 16 tables of one build."""
    return S.table_counts(S.build_star(_staged(spark, sf_dir)))


_SEXO_ID = f"(SELECT k, max(id) AS id FROM (SELECT {O.key('nombre')} AS k, id FROM sx) q WHERE k <> '' GROUP BY k)"


@query("star_facts_by_name", f"WITH inst AS MATERIALIZED ({_INSTITUTION}), prog AS MATERIALIZED ({_PROG_RAW}), muni AS MATERIALIZED ({_MUNICIPALITY}), sx AS MATERIALIZED ({_SEX_DIM}), "
       f"f AS ({_FACT_STUDENTS}) SELECT f.institucion_codigo, f.programa_codigo, m.codigo AS municipio_programa_codigo, s.nombre AS sexo, anio, semestre, admitidos, inscritos, matriculados, graduados "
       f"FROM f JOIN inst i ON i.codigo = f.institucion_codigo JOIN prog p ON p.codigo = f.programa_codigo LEFT JOIN muni m ON m.codigo = f.municipio_programa_codigo "
       f"LEFT JOIN {_SEXO_ID} l ON l.k = {O.key('f.sexo')} LEFT JOIN sx s ON s.id = l.id")
def star_facts_by_name(spark, sf_dir):
    """Student facts of a built star, read back through the names of its dimensions."""
    star = S.build_star(_staged(spark, sf_dir))
    sex = star["SEXO"].select(F.col("id").alias("sexo_id"), F.col("nombre").alias("sexo"))
    fact = J.attach(star["HECHO_ESTUDIANTES"], sex, ["sexo_id"], ready=True)
    return fact.drop("sexo_id")


_BROKEN = {
    "DEPARTAMENTO": "SELECT CAST(n_regionkey AS STRING) AS codigo, CASE WHEN n_nationkey % 5 = 0 THEN CAST(NULL AS STRING) ELSE n_name END AS nombre FROM {nation}",
    "MUNICIPIO": "SELECT CAST(c_custkey * 97 AS STRING) AS codigo, c_name AS nombre, CAST(c_nationkey AS STRING) AS departamento_codigo FROM {customer}",
    "NBC": "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS nombre FROM {part}",
}
_V = "SELECT '{t}' AS tabla, '{r}' AS regla, CAST(({q}) AS BIGINT) AS n"
_D, _M, _NB = (B.sql_of(_BROKEN[t]) for t in ("DEPARTAMENTO", "MUNICIPIO", "NBC"))


@query("validate_constraints", " UNION ALL ".join([
    _V.format(t="DEPARTAMENTO", r="not_null(codigo)", q=f"SELECT count_if(codigo IS NULL) FROM ({_D}) d"),
    _V.format(t="DEPARTAMENTO", r="length(codigo)", q=f"SELECT count_if(length(codigo) > 5) FROM ({_D}) d"),
    _V.format(t="DEPARTAMENTO", r="not_null(nombre)", q=f"SELECT count_if(nombre IS NULL) FROM ({_D}) d"),
    _V.format(t="DEPARTAMENTO", r="length(nombre)", q=f"SELECT count_if(length(nombre) > 255) FROM ({_D}) d"),
    _V.format(t="DEPARTAMENTO", r="primary(codigo)", q=f"SELECT count(*) - count(DISTINCT codigo) FROM ({_D}) d"),
    _V.format(t="MUNICIPIO", r="not_null(codigo)", q=f"SELECT count_if(codigo IS NULL) FROM ({_M}) d"),
    _V.format(t="MUNICIPIO", r="length(codigo)", q=f"SELECT count_if(length(codigo) > 5) FROM ({_M}) d"),
    _V.format(t="MUNICIPIO", r="not_null(nombre)", q=f"SELECT count_if(nombre IS NULL) FROM ({_M}) d"),
    _V.format(t="MUNICIPIO", r="length(nombre)", q=f"SELECT count_if(length(nombre) > 255) FROM ({_M}) d"),
    _V.format(t="MUNICIPIO", r="length(departamento_codigo)", q=f"SELECT count_if(length(departamento_codigo) > 5) FROM ({_M}) d"),
    _V.format(t="MUNICIPIO", r="primary(codigo)", q=f"SELECT count(*) - count(DISTINCT codigo) FROM ({_M}) d"),
    _V.format(t="MUNICIPIO", r="foreign(departamento_codigo->DEPARTAMENTO)", q=f"SELECT count(*) FROM ({_M}) m WHERE departamento_codigo NOT IN (SELECT codigo FROM ({_D}) d)"),
    _V.format(t="NBC", r="not_null(id)", q=f"SELECT count_if(id IS NULL) FROM ({_NB}) d"),
    _V.format(t="NBC", r="not_null(nombre)", q=f"SELECT count_if(nombre IS NULL) FROM ({_NB}) d"),
    _V.format(t="NBC", r="length(nombre)", q=f"SELECT count_if(length(nombre) > 255) FROM ({_NB}) d"),
    _V.format(t="NBC", r="primary(id)", q=f"SELECT count(*) - count(DISTINCT id) FROM ({_NB}) d"),
    _V.format(t="NBC", r="unique(nombre)", q=f"SELECT count(*) - count(DISTINCT lower(nombre)) FROM ({_NB}) d")]))
def validate_constraints(spark, sf_dir):
    return S.constraint_violations({t: B.derive(spark, sf_dir, q) for t, q in _BROKEN.items()})
