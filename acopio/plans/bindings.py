"""Stand-ins for institutional deliveries, derived from the supplied tables.

Each text is SQL that Spark and DuckDB both accept, over whole tables; ``{orders}`` and the like
name the tables. The dirt (blanks, float tails, spellings) is a function of the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import constants as K
from ..sources.masters import alias_names

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

_PLACE = """
  CAST(n_regionkey AS STRING) AS departamento_ies_codigo, r_name AS departamento_ies_nombre,
  CAST(n_nationkey AS STRING) || '.0' AS municipio_ies_codigo, n_name AS municipio_ies_nombre"""

ADMIN = f"""SELECT o_orderkey AS _ord,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS STRING) || '.0' ELSE CAST(o_custkey AS STRING) END AS institucion_codigo,
  CAST(o_custkey - o_custkey % 3 AS STRING) AS ies_padre_codigo,
  CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN upper(c_name) ELSE c_name || ' ' END AS institucion_nombre,
  CASE WHEN o_custkey % 3 = 0 THEN 'Principal' ELSE 'Seccional' END AS principal_seccional,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE c_mktsegment END AS sector_ies,
  CASE o_orderstatus WHEN 'F' THEN 'Universidad' WHEN 'O' THEN 'Institución Tecnológica' ELSE '' END AS caracter_ies,
  {_PLACE},
  CAST(year(o_orderdate) AS STRING) AS anio,
  CAST(CASE WHEN month(o_orderdate) > 6 THEN 2 ELSE 1 END AS STRING) || '.0' AS semestre,
  CAST(o_orderkey % 11 AS STRING) AS auxiliar,
  CAST(o_orderkey % 5 AS STRING) || '.0' AS tecnico,
  CASE WHEN o_orderkey % 13 = 0 THEN 'n/d' ELSE CAST(o_orderkey % 17 AS STRING) END AS profesional,
  CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE CAST(o_orderkey % 3 AS STRING) || '.7' END AS directivo,
  CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS total
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey"""

_SEX = """CASE {k} % 12 WHEN 0 THEN 'Hombre' WHEN 1 THEN 'm' WHEN 2 THEN 'Mujeres' WHEN 3 THEN 'F'
  WHEN 4 THEN 'No binario' WHEN 5 THEN 'Varón' WHEN 6 THEN 'fmale' WHEN 7 THEN '' WHEN 8 THEN 'Masculino'
  WHEN 9 THEN 'FEMENINO' WHEN 10 THEN 'Masculino/Femenino' ELSE 'Sin información' END"""

_SUPPLIER_IES = f"""
  CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_suppkey AS STRING) || '.00' ELSE CAST(l_suppkey AS STRING) END AS institucion_codigo,
  CAST(l_suppkey - l_suppkey % 4 AS STRING) AS ies_padre_codigo,
  CASE WHEN l_orderkey % 6 = 0 THEN ' ' ELSE s_name END AS institucion_nombre,
  CASE WHEN l_suppkey % 4 = 0 THEN 'Principal' ELSE 'Seccional' END AS principal_seccional,
  CASE WHEN s_acctbal < 0 THEN 'Oficial' ELSE 'Privado' END AS sector_ies,
  '' AS caracter_ies,
  {_PLACE}"""
_SUPPLIER_JOIN = """JOIN {supplier} ON l_suppkey = s_suppkey
JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""

STAFF = f"""SELECT l_orderkey * 8 + l_linenumber AS _ord, {_SUPPLIER_IES},
  {_SEX.format(k='l_partkey')} AS sexo,
  CASE l_returnflag WHEN 'A' THEN 'Maestría' WHEN 'R' THEN 'MAESTRIA ' ELSE 'Doctorado' END AS nivel_formacion_docente,
  CASE l_linestatus WHEN 'F' THEN 'Tiempo completo' ELSE ' ' END AS tiempo_dedicacion,
  CASE WHEN l_partkey % 9 = 0 THEN '' WHEN l_partkey % 2 = 0 THEN 'Término fijo' ELSE 'TERMINO FIJO' END AS tipo_contrato,
  CAST(year(l_shipdate) AS STRING) AS anio,
  CAST(CASE WHEN month(l_shipdate) > 6 THEN 2 ELSE 1 END AS STRING) AS semestre,
  CASE WHEN l_partkey % 17 = 0 THEN 'n/d' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) || '.0' END AS num_docentes
FROM {{lineitem}} {_SUPPLIER_JOIN}"""

STUDENTS = f"""SELECT l_orderkey * 8 + l_linenumber AS _ord,
  CASE WHEN l_linenumber <= 2 THEN 'admitidos' WHEN l_linenumber <= 4 THEN 'inscritos'
       WHEN l_linenumber <= 6 THEN 'matriculados' ELSE 'graduados' END AS _marco,
  {_SUPPLIER_IES},
  CASE WHEN l_orderkey % 5 = 0 THEN CAST(l_partkey AS STRING) || '.0' ELSE CAST(l_partkey AS STRING) END AS programa_codigo,
  CASE WHEN l_orderkey % 6 = 0 THEN ' ' WHEN l_orderkey % 6 = 1 THEN upper(p_name) ELSE p_name END AS programa_nombre,
  CASE WHEN p_size > 40 THEN 'Posgrado' ELSE 'Pregrado' END AS nivel_academico,
  CASE WHEN p_size > 25 THEN 'Universitaria' ELSE 'Tecnológica' END AS nivel_formacion_programa,
  CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE 'Presencial' END AS metodologia,
  CASE l_orderkey % 3 WHEN 0 THEN 'Área ' || p_type WHEN 1 THEN 'AREA ' || p_type ELSE 'área ' || p_type || ' ' END AS area_conocimiento,
  p_brand AS nbc,
  CASE WHEN l_orderkey % 11 = 0 THEN '' ELSE 'Campo ' || p_type END AS cine_campo_amplio,
  p_brand AS cine_campo_especifico,
  p_name AS cine_detallado,
  CAST(n_regionkey AS STRING) AS departamento_programa_codigo,
  'Depto ' || r_name AS departamento_programa_nombre,
  CAST(l_partkey % 30 AS STRING) AS municipio_programa_codigo,
  CASE WHEN l_partkey % 30 < 27 THEN 'Sede ' || CAST(l_partkey % 30 AS STRING) ELSE '' END AS municipio_programa_nombre,
  CASE WHEN l_returnflag = 'N' THEN '' ELSE {_SEX.format(k='l_orderkey')} END AS sexo,
  CAST(year(l_shipdate) AS STRING) || '.0' AS anio,
  CAST(CASE WHEN month(l_shipdate) > 6 THEN 2 ELSE 1 END AS STRING) AS semestre,
  CASE WHEN l_partkey % 23 = 0 THEN '1,000' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS medida
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey {_SUPPLIER_JOIN}"""

# Customers as a small dirty master: null tokens, sex values, name variants.
DIRTY = f"""SELECT c_custkey AS _ord,
  CAST(c_custkey AS STRING) AS codigo,
  CASE c_custkey % 10 WHEN 0 THEN 'Sin información' WHEN 1 THEN '  ' WHEN 2 THEN 'N/A' WHEN 3 THEN 'n.d.'
    WHEN 4 THEN ' No Aplica ' WHEN 5 THEN '' WHEN 6 THEN 'sin' ELSE 'Institución ' || c_name END AS institucion,
  CASE WHEN c_custkey % 13 = 0 THEN 'NINGUNO' WHEN c_custkey % 17 = 0 THEN ' ' ELSE c_mktsegment END AS sector,
  {_SEX.format(k='c_custkey')} AS sexo,
  CASE c_custkey % 4 WHEN 0 THEN '2019' WHEN 1 THEN '2020' WHEN 2 THEN '2020.0' ELSE '' END AS anio,
  CASE c_custkey % 6 WHEN 0 THEN '12.7' WHEN 1 THEN '1,000' WHEN 2 THEN '-3.9' WHEN 3 THEN '1e3' WHEN 4 THEN ' 5 '
    ELSE CAST(c_custkey AS STRING) END AS total
FROM {{customer}}"""

# Yearly files as raw grids: two title rows, a header, order rows, two notes at the end.
GRID = """SELECT 'Docentes/corte ' || CAST(year(o_orderdate) AS STRING) || ' ' || o_orderstatus || '.csv' AS path,
    o_orderkey AS ord, CAST(o_custkey AS STRING) AS c0, 'Sede ' || o_orderpriority AS c1,
    CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE CAST(year(o_orderdate) AS STRING) END AS c2,
    CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS c3
  FROM {orders}
UNION ALL
SELECT 'Docentes/corte ' || CAST(year(o_orderdate) AS STRING) || ' ' || o_orderstatus || '.csv', CAST(-3 AS BIGINT),
    'Informe', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {orders} GROUP BY 1
UNION ALL
SELECT 'Docentes/corte ' || CAST(year(o_orderdate) AS STRING) || ' ' || o_orderstatus || '.csv', CAST(-2 AS BIGINT),
    CASE WHEN max(o_orderstatus) = 'O' THEN 'Corte ' || CAST(max(year(o_orderdate)) AS STRING) ELSE 'Corte anual' END,
    CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {orders} GROUP BY 1
UNION ALL
SELECT 'Docentes/corte ' || CAST(year(o_orderdate) AS STRING) || ' ' || o_orderstatus || '.csv', CAST(-1 AS BIGINT),
    'Código de la Institución', 'Institución de Educación Superior (IES)', 'Año', 'No. de Docentes' FROM {orders} GROUP BY 1
UNION ALL
SELECT 'Docentes/corte ' || CAST(year(o_orderdate) AS STRING) || ' ' || o_orderstatus || '.csv', max(o_orderkey) + 1,
    'Fuente: entidad oficial', '', '', '' FROM {orders} GROUP BY 1
UNION ALL
SELECT 'Docentes/corte ' || CAST(year(o_orderdate) AS STRING) || ' ' || o_orderstatus || '.csv', max(o_orderkey) + 2,
    '', '', '', '' FROM {orders} GROUP BY 1"""

GRID_COLUMNS = ["c0", "c1", "c2", "c3"]

# Institution totals: one row per supplier from its line items.
TOTALS = """SELECT s_suppkey AS id, s_name AS Nombre_IES, s_nationkey AS Departamento,
  sum(CASE WHEN l_linenumber <= 2 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS Total_Admitidos,
  sum(CASE WHEN l_linenumber > 2 AND l_linenumber <= 4 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS Total_Inscritos,
  sum(CASE WHEN l_linenumber > 4 AND l_linenumber <= 6 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS Total_Matriculados,
  sum(CASE WHEN l_linenumber > 6 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS Total_Graduados,
  count(*) AS Total_Docentes
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name, s_nationkey"""

# Part names with spellings that differ by key.
VARIANTS = """SELECT p_partkey AS _ord, p_name AS programa,
  CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, 'i', 'í') || '.'
    ELSE substring(p_name, 1, length(p_name) - 1) END AS variante,
  p_type || ' ' || p_name AS largo
FROM {part}"""


def tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a stand-in over the tables it names."""
    used = [t for t in TABLES if "{" + t + "}" in text]
    return spark.sql(text, **tables(spark, sf_dir, used))


def sql_of(text: str) -> str:
    """The same stand-in for DuckDB."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def under_headers(df: DataFrame, category: str) -> DataFrame:
    """Staging columns put back under the canonical headers of a category."""
    headers = K.CANONICAL_HEADERS[category]
    names = alias_names(headers)
    tech = [c for c in df.columns if c.startswith("_")]
    # a header without a staging name (one category has such a municipality header) stays empty
    from pyspark.sql import functions as F
    return df.select(*tech, *[F.col(names[h]).alias(h) if names.get(h) in df.columns else F.lit("").alias(h)
                              for h in headers])


def student_frames(df: DataFrame) -> dict[str, DataFrame]:
    """Measure -> frame of that measure."""
    return {m: df.where(df["_marco"] == m).withColumnRenamed("medida", m).drop("_marco")
            for m in K.STUDENT_MEASURES.values()}
