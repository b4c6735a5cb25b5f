"""Queries for raw grids: heads, headers, sheets, years, column matching, ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import grid as G
from ..operators import matching as M
from . import bindings as B
from . import ingest as I
from . import oracle as O
from .registry import query

_GRID = B.sql_of(B.GRID)
_CELLS = "[c0, c1, c2, c3]"
_NUM = "regexp_full_match(v, '[0-9]*\\.?[0-9]*') AND regexp_matches(v, '[0-9]')"


def _grid(spark, sf_dir):
    df = B.derive(spark, sf_dir, B.GRID)
    return df.select(F.col("path").alias("_path"), F.lit("0").alias("_sheet"), F.col("ord").alias("_ord"),
                     F.array(*B.GRID_COLUMNS).alias("cells"))


def _flat(df, *cols):
    return df.select(F.col("_path").alias("archivo"), *cols)


def _cells_text(c="cells"):
    return F.array_join(F.transform(c, lambda v: F.coalesce(v, F.lit("~"))), "|")


_HEAD = f"SELECT * FROM (SELECT path, ord, {_CELLS} AS cells, row_number() OVER (PARTITION BY path ORDER BY ord) - 1 AS row_idx FROM ({_GRID}) g) h WHERE row_idx < {{n}}"
_TEXT = "array_to_string(list_transform(cells, lambda v: coalesce(v, '~')), '|')"


@query("raw_grid_head", f"SELECT path AS archivo, row_idx, {_TEXT} AS celdas FROM ({_HEAD.format(n=K.YEAR_ROWS)}) t")
def raw_grid_head(spark, sf_dir):
    return _flat(G.head_rows(_grid(spark, sf_dir), K.YEAR_ROWS), F.col("row_idx").cast("bigint").alias("row_idx"), _cells_text().alias("celdas"))


@query("pad_truncate_cells", f"SELECT path AS archivo, ord, array_to_string(list_transform([c0, c1, c2, c3, '', ''], lambda v: coalesce(v, '~')), '|') AS seis, "
       f"coalesce(c0, '~') || '|' || coalesce(c1, '~') AS dos FROM ({_GRID}) g")
def pad_truncate_cells(spark, sf_dir):
    df = _grid(spark, sf_dir)
    return _flat(df, F.col("_ord").alias("ord"), _cells_text(G.pad_cells(F.col("cells"), 6)).alias("seis"),
                 _cells_text(G.pad_cells(F.col("cells"), 2)).alias("dos"))


@query("grid_title", f"SELECT path AS archivo, coalesce(max(CASE WHEN row_idx = 1 THEN cells[1] END), '') AS titulo FROM ({_HEAD.format(n=2)}) t GROUP BY path")
def grid_title(spark, sf_dir):
    return _flat(G.grid_title(_grid(spark, sf_dir)), "titulo")


_SCORED = (f"SELECT path, row_idx, ord, len(seen) - 3 * len(list_filter(seen, lambda v: {_NUM})) + "
           f"coalesce(list_sum(list_transform(seen, lambda v: length(v))), 0) / 10.0::DOUBLE AS score FROM "
           f"(SELECT *, list_filter(cells, lambda v: v IS NOT NULL) AS seen FROM ({_HEAD.format(n=K.HEADER_ROWS)}) h) s WHERE len(seen) > 0")
_HEADER = f"SELECT path, arg_max(row_idx, (score, -row_idx)) AS header_idx FROM ({_SCORED}) t WHERE score > -1 GROUP BY path"


@query("detect_header_row", f"SELECT p.path AS archivo, coalesce(h.header_idx, 0) AS header_idx FROM (SELECT DISTINCT path FROM ({_GRID}) g) p LEFT JOIN ({_HEADER}) h ON h.path = p.path")
def detect_header_row(spark, sf_dir):
    return _flat(G.detect_header_row(_grid(spark, sf_dir)), "header_idx")


# Sheets: each year is a workbook, each order status one of its sheets, with cells blanked unevenly.
_SHEETS = """SELECT CAST(year(o_orderdate) AS STRING) AS path, o_orderstatus AS sheet, o_orderkey AS ord,
  CAST(o_custkey AS STRING) AS c0, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN CAST(NULL AS STRING) ELSE o_orderpriority END AS c1,
  CASE WHEN o_orderstatus = 'O' AND year(o_orderdate) % 2 = 0 THEN CAST(year(o_orderdate) AS STRING) WHEN o_orderkey % 3 = 0 THEN 'x' END AS c2 FROM {orders}"""


@query("detect_data_sheet", f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY path, sheet ORDER BY ord) - 1 AS row_idx FROM ({B.sql_of(_SHEETS)}) s),
  p AS (SELECT path, sheet, sum(CASE WHEN row_idx < {K.SHEET_ROWS} THEN (c0 IS NOT NULL)::INT + (c1 IS NOT NULL)::INT + (c2 IS NOT NULL)::INT ELSE 0 END) +
    CASE WHEN max(len({O.years('coalesce(c0, $$$$)')}) + len({O.years('coalesce(c1, $$$$)')}) + len({O.years('coalesce(c2, $$$$)')})) > 0 THEN 50 ELSE 0 END AS puntaje
    FROM h WHERE row_idx <= {K.SHEET_YEAR_ROWS} GROUP BY path, sheet)
  SELECT path AS archivo, arg_max(sheet, (puntaje, -ascii(sheet))) AS hoja, CAST(max(puntaje) AS BIGINT) AS puntaje FROM p GROUP BY path""")
def detect_data_sheet(spark, sf_dir):
    df = B.derive(spark, sf_dir, _SHEETS)
    grid = df.select(F.col("path").alias("_path"), F.col("sheet").alias("_sheet"), F.col("ord").alias("_ord"), F.array("c0", "c1", "c2").alias("cells"))
    return _flat(G.detect_data_sheet(grid), F.col("_sheet").alias("hoja"), "puntaje")


# --- years ----------------------------------------------------------------------------------------------

def _votes(rows, weight=1):
    """(path, y, w, r, c, ix) for each mention in ``rows`` (path, row_idx, cells)."""
    return (f"SELECT path, CAST(ys[ix] AS INTEGER) AS y, {weight} AS w, row_idx AS r, col AS c, ix FROM (SELECT path, row_idx, col, {O.years('cell')} AS ys, "
            f"unnest(generate_series(1, len({O.years('cell')}))) AS ix FROM (SELECT path, row_idx, unnest(cells) AS cell, unnest(generate_series(1, len(cells))) AS col FROM ({rows}) a) b) d")


_NEAR = f"SELECT path, y, sum(w) AS peso, min((r, c, ix)) AS f FROM ({_votes(_HEAD.format(n=K.SCAN_ROWS))}) v GROUP BY path, y"
_ALL_CELLS = f"SELECT path, ord AS row_idx, {_CELLS} AS cells FROM ({_GRID}) g WHERE path NOT IN (SELECT path FROM near)"
_ONCE = (f"SELECT path, min(row_idx) AS row_idx, [cell] AS cells, col FROM (SELECT path, row_idx, unnest(cells) AS cell, unnest(generate_series(1, 4)) AS col FROM ({_ALL_CELLS}) a) b "
         f"WHERE cell IS NOT NULL GROUP BY path, col, cell")
_FAR_SQL = (f"SELECT path, y, count(*) AS peso, min((col, r, ix)) AS f FROM (SELECT path, col, r, ix, CAST(ys[ix] AS INTEGER) AS y FROM (SELECT path, col, row_idx AS r, "
            f"{O.years('cells[1]')} AS ys, unnest(generate_series(1, len({O.years('cells[1]')}))) AS ix FROM ({_ONCE}) o) b) q GROUP BY path, y")
_SCAN = (f"WITH near AS MATERIALIZED ({_NEAR}), far AS ({_FAR_SQL}) SELECT path, y AS anio, CAST(peso AS BIGINT) AS peso, row_number() OVER (PARTITION BY path ORDER BY peso DESC, f) AS orden FROM near "
         f"UNION ALL SELECT path, y AS anio, CAST(peso AS BIGINT) AS peso, row_number() OVER (PARTITION BY path ORDER BY peso DESC, f) AS orden FROM far")


@query("year_scan", f"SELECT path AS archivo, anio, peso, orden FROM ({_SCAN}) t")
def year_scan(spark, sf_dir):
    return _flat(G.year_scan(_grid(spark, sf_dir)), "anio", "peso", "orden")


_FORTY = f"SELECT path, arg_max(y, (peso, [-f[1], -f[2], -f[3]])) AS y FROM (SELECT path, y, sum(w) AS peso, min([r, c, ix]) AS f FROM ({_votes(_HEAD.format(n=K.YEAR_ROWS))}) v GROUP BY path, y) q GROUP BY path"
_LINES = (f"SELECT path, row_idx, line, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY path ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM "
          f"(SELECT path, row_idx, array_to_string(list_filter(cells, lambda v: v IS NOT NULL), ',') AS line FROM ({_HEAD.format(n=K.YEAR_TEXT_BYTES)}) h) l")
_CUT_YEARS = O.years(f"CASE WHEN before + strlen(line) + 1 > {K.YEAR_TEXT_BYTES} THEN left(line, CAST({K.YEAR_TEXT_BYTES} - before AS BIGINT)) ELSE line END")
_TEXT_YEAR = (f"SELECT path, arg_min(CAST(ys[1] AS INTEGER), row_idx) AS y FROM (SELECT path, row_idx, {_CUT_YEARS} AS ys "
              f"FROM ({_LINES}) l WHERE before < {K.YEAR_TEXT_BYTES}) q WHERE len(ys) > 0 GROUP BY path")
_NAME_YEARS = O.years("regexp_extract(p.path, '([^/]+)$', 1)")
_FILE_YEAR = (f"SELECT p.path, coalesce(g.y, t.y, CAST(({_NAME_YEARS})[1] AS INTEGER)) AS anio, "
              f"CASE WHEN g.y IS NOT NULL THEN 'filas' WHEN t.y IS NOT NULL THEN 'texto' WHEN len({_NAME_YEARS}) > 0 THEN 'nombre' END AS origen "
              f"FROM (SELECT DISTINCT path FROM ({_GRID}) g) p LEFT JOIN ({_FORTY}) g ON g.path = p.path LEFT JOIN ({_TEXT_YEAR}) t ON t.path = p.path")


@query("file_year", f"SELECT path AS archivo, anio, origen FROM ({_FILE_YEAR}) t")
def file_year(spark, sf_dir):
    return _flat(G.file_year(_grid(spark, sf_dir)), "anio", "origen")


# Headers: every category's canonical list, disturbed by the rows of a table.
_HEADERS = """SELECT p_partkey AS file_id, CASE p_partkey % 5 WHEN 0 THEN 'Año' WHEN 1 THEN 'AÑO ' WHEN 2 THEN 'Anio' WHEN 3 THEN 'Año de reporte' ELSE 'Periodo' END AS h0,
  CASE p_partkey % 4 WHEN 0 THEN 'Código Municipio IES' WHEN 1 THEN 'CODIGO DEL MUNICIPIO (IES)' WHEN 2 THEN '"Cód. del Municipio"' ELSE 'municipio' END AS h1,
  CASE p_partkey % 7 WHEN 0 THEN 'Género' WHEN 1 THEN 'Sexo' WHEN 2 THEN 'ID Sexo' WHEN 3 THEN 'Sexo id' WHEN 4 THEN 'sex' WHEN 5 THEN 'Sector IES' ELSE p_name END AS h2,
  CASE p_partkey % 3 WHEN 0 THEN 'Admisiones 2018' WHEN 1 THEN 'ADMITIDOS' ELSE 'Inscripciones' END AS h3,
  CASE p_partkey % 6 WHEN 0 THEN 'IES PADRE' WHEN 1 THEN 'Tipo de IES' WHEN 2 THEN 'Principal o' ELSE p_type || ' ' || p_brand END AS h4,
  'Semestre' AS h5 FROM {part}"""
_HNAMES = ["h0", "h1", "h2", "h3", "h4", "h5"]
_CANON = K.CANONICAL_HEADERS["Estudiantes admitidos"]


def _headers(spark, sf_dir):
    df = B.derive(spark, sf_dir, _HEADERS)
    return df.select("file_id", F.posexplode(F.array(*_HNAMES)).alias("pos", "name"))


_HSQL = " UNION ALL ".join(f"SELECT file_id, {i} AS src_idx, {h} AS name FROM hd" for i, h in enumerate(_HNAMES))
_CSQL = ", ".join(f"({i}, '{c}')" for i, c in enumerate(_CANON))


def _any(k, words):
    return "(" + " OR ".join(f"contains({k}, '{w}')" for w in words) + ")"


_SEX_PAIR = f"NOT starts_with(ck, 'id') AND NOT starts_with(nk, 'id') AND {_any('ck', K.SEX_HEADER_WORDS)} AND {_any('nk', K.SEX_HEADER_WORDS)}"
_ALIAS = " OR ".join([f"(contains(ck, '{a}') AND contains(nk, '{b}')) OR (contains(nk, '{a}') AND contains(ck, '{b}'))" for a, b in K.HEADER_STEM_PAIRS]
                     + [f"(ck IN {O.in_list(g)} AND nk IN {O.in_list(g)})" for g in K.HEADER_ALIAS_GROUPS])
_SCORES = f"""WITH hd AS ({B.sql_of(_HEADERS)}), src AS (SELECT file_id, src_idx, regexp_replace(trim(trim(trim(name), '"'), ''''), '\\s+', ' ', 'g') AS name FROM ({_HSQL}) x),
  dn AS MATERIALIZED (SELECT DISTINCT name, {O.key('name')} AS nk FROM src), cn AS (SELECT *, {O.key('canon')} AS ck FROM (VALUES {_CSQL}) v(canon_idx, canon)),
  sc AS MATERIALIZED (SELECT name, canon_idx, canon, (CASE WHEN ck = nk THEN 1.0::DOUBLE WHEN {_SEX_PAIR} THEN 0.98::DOUBLE WHEN {_ALIAS} THEN 0.97::DOUBLE ELSE {O.similarity('ck', 'nk')} END)
    * CASE WHEN regexp_matches(name, '\\bid\\b') THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS sim FROM dn CROSS JOIN cn)
  SELECT src.file_id, sc.canon_idx, src.src_idx, sc.canon, src.name, sc.sim FROM src JOIN sc ON sc.name = src.name WHERE sc.sim >= {K.MATCH_THRESHOLD}"""


@query("match_scores", f"SELECT file_id, canon_idx, src_idx, canon, name, round(sim, 9) AS sim FROM ({_SCORES}) t")
def match_scores(spark, sf_dir):
    return M.match_scores(_headers(spark, sf_dir), _CANON, ["file_id"]).withColumn("sim", F.round("sim", 9))


# The greedy assignment as a recursive statement: each step takes a file's next free best pair.
_MATCH = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT file_id, sim, canon_idx AS i, src_idx AS j, row_number() OVER (PARTITION BY file_id ORDER BY sim DESC, canon_idx, src_idx) AS r FROM ({_SCORES}) q),
  g AS (SELECT file_id, 0::BIGINT AS r, []::INTEGER[] AS ui, []::INTEGER[] AS uj FROM s GROUP BY file_id
   UNION ALL SELECT g.file_id, s.r, CASE WHEN list_contains(g.ui, s.i) OR list_contains(g.uj, s.j) THEN g.ui ELSE list_append(g.ui, s.i) END,
     CASE WHEN list_contains(g.ui, s.i) OR list_contains(g.uj, s.j) THEN g.uj ELSE list_append(g.uj, s.j) END FROM g JOIN s ON s.file_id = g.file_id AND s.r = g.r + 1)
  SELECT file_id, unnest(ui) AS canon_idx, unnest(uj) AS src_idx FROM (SELECT file_id, arg_max(ui, r) AS ui, arg_max(uj, r) AS uj FROM g GROUP BY file_id) e"""


@query("match_columns", _MATCH)
def match_columns(spark, sf_dir):
    scores = M.match_scores(_headers(spark, sf_dir), _CANON, ["file_id"])
    return M.match_columns(scores, ["file_id"], len(_CANON)).drop("sim")


@query("best_year_column", f"WITH hd AS ({B.sql_of(_HEADERS)}), k AS (SELECT file_id, src_idx AS pos, name, {O.key('name')} AS nk FROM ({_HSQL}) x), "
       f"s AS (SELECT *, {O.similarity('nk', chr(39) + K.YEAR_KEY + chr(39))} AS sim FROM k) SELECT file_id, arg_max(pos, (sim, -pos)) AS pos, arg_max(name, (sim, -pos)) AS name, "
       f"round(max(sim), 9) AS sim FROM s WHERE sim >= {K.YEAR_COLUMN_THRESHOLD} GROUP BY file_id")
def best_year_column(spark, sf_dir):
    return G.best_year_column(_headers(spark, sf_dir), ["file_id"]).withColumn("sim", F.round("sim", 9))


_STATED = f"SELECT path, min({O.year('c2')}) AS y FROM ({_GRID}) g GROUP BY path HAVING min({O.year('c2')}) IS NOT NULL"


@query("dataset_year", f"SELECT p.path AS archivo, coalesce(s.y, m.anio) AS anio FROM (SELECT DISTINCT path FROM ({_GRID}) g) p LEFT JOIN ({_STATED}) s ON s.path = p.path "
       f"LEFT JOIN (SELECT path, anio FROM ({_SCAN}) t WHERE orden = 1) m ON m.path = p.path WHERE coalesce(s.y, m.anio) IS NOT NULL")
def dataset_year(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    cells = grid.select("_path", F.get("cells", F.lit(2)).alias("valor"))
    return _flat(G.dataset_year(cells, G.year_scan(grid)), "anio")


# --- ingestion -------------------------------------------------------------------------------------------

_CATEGORY = "Docentes"


def _ingested(spark, sf_dir):
    return I.ingest_grid(_grid(spark, sf_dir), _CATEGORY)


_DATA = f"SELECT * FROM ({_GRID}) g WHERE ord >= 0 AND NOT (c0 = 'Fuente: entidad oficial' OR c0 = '')"
_CANONICAL = K.CANONICAL_HEADERS[_CATEGORY]
_POS = {"Código de la Institución": "c0", "Institución de Educación Superior (IES)": "c1", "Año": "c2", "No. de Docentes": "c3"}
_INGEST_YEAR = (f"SELECT p.path, coalesce(s.y, f.anio) AS anio FROM (SELECT DISTINCT path FROM ({_GRID}) g) p "
                f"LEFT JOIN ({_STATED}) s ON s.path = p.path LEFT JOIN ({_FILE_YEAR}) f ON f.path = p.path")


@query("align_canonical", f"SELECT path AS archivo, ord, c0 AS codigo, c1 AS nombre, c2 AS anio, c3 AS docentes, CAST(NULL AS VARCHAR) AS sexo FROM ({_GRID}) g WHERE ord >= 0")
def align_canonical(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    headers = I.pin(G.file_headers(grid))
    scores = M.match_scores(G.explode_headers(headers), _CANONICAL, ["_path"])
    mapping = M.mapping_arrays(M.match_columns(scores, ["_path"], len(_CANONICAL)), ["_path"], len(_CANONICAL))
    df = I.align_rows(grid, headers.join(mapping, "_path").select("_path", "_header_ord", "mapping"), _CANONICAL)
    return _flat(df, F.col("_ord").alias("ord"), F.col("`Código de la Institución`").alias("codigo"),
                 F.col("`Institución de Educación Superior (IES)`").alias("nombre"), F.col("`Año`").alias("anio"),
                 F.col("`No. de Docentes`").alias("docentes"), F.col("`Sexo del Docente`").alias("sexo"))


@query("ingest_file_year", f"SELECT path AS archivo, anio, CASE WHEN anio IS NULL THEN 'sin año' END AS motivo FROM ({_INGEST_YEAR}) t")
def ingest_file_year(spark, sf_dir):
    return _flat(_ingested(spark, sf_dir).files, "anio", "motivo")


@query("ingest_files", f"SELECT d.path AS archivo, d.ord, y.anio, c0 AS codigo, c1 AS nombre, CAST(y.anio AS VARCHAR) AS anio_texto, c3 AS docentes, '' AS sexo "
       f"FROM ({_DATA}) d JOIN ({_INGEST_YEAR}) y ON y.path = d.path WHERE y.anio IS NOT NULL")
def ingest_files(spark, sf_dir):
    df = _ingested(spark, sf_dir).rows
    return _flat(df, F.col("_ord").alias("ord"), F.col("_anio").alias("anio"), F.col("`Código de la Institución`").alias("codigo"),
                 F.col("`Institución de Educación Superior (IES)`").alias("nombre"), F.col("`Año`").alias("anio_texto"),
                 F.col("`No. de Docentes`").alias("docentes"), F.col("`Sexo del Docente`").alias("sexo"))


@query("assign_file_year", f"SELECT g.path AS archivo, ord, c0, CAST(coalesce(CAST(s.y AS VARCHAR), c2) AS VARCHAR) AS c2 FROM ({_GRID}) g LEFT JOIN ({_STATED}) s ON s.path = g.path")
def assign_file_year(spark, sf_dir):
    df = B.derive(spark, sf_dir, B.GRID).withColumnsRenamed({"path": "_path"}).select("_path", "ord", "c0", "c2")
    years = df.select("_path", G.parse_year(F.col("c2")).alias("y")).where("y IS NOT NULL").groupBy("_path").agg(F.min("y").alias("anio"))
    return _flat(I.assign_year(df, years, "c2"), "ord", "c0", "c2")


@query("latest_file_wins", f"SELECT anio, max(path) AS archivo FROM ({_INGEST_YEAR}) t WHERE anio IS NOT NULL GROUP BY anio")
def latest_file_wins(spark, sf_dir):
    files = _ingested(spark, sf_dir).files.where("motivo IS NULL")
    return I.latest_file_wins(files, ["anio"]).withColumnRenamed("_path", "archivo")


# Masters by order status whose year stands in a note: in the first rows, far down, or nowhere.
_NOTED = """SELECT o_orderstatus AS maestro, o_orderkey AS _ord, CAST(o_custkey % 90 AS STRING) AS codigo, o_orderpriority AS texto,
  CASE WHEN o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderkey < 2500) THEN 'sin fecha' ELSE 'Corte a 2017' END AS nota FROM {orders}"""


@query("master_year_column", f"SELECT maestro, CASE WHEN count_if(nota = 'Corte a 2017') > 0 THEN 'nota' END AS columna FROM ({B.sql_of(_NOTED)}) t GROUP BY 1")
def master_year_column(spark, sf_dir):
    """Year column of a table without a header for it, however far down the year is first mentioned."""
    df = B.derive(spark, sf_dir, _NOTED)
    found = [(m, G.master_year_column(df.where(F.col("maestro") == m).drop("maestro"))) for m in ("F", "O", "P")]
    return spark.createDataFrame(found, "maestro string, columna string")


# A file for every order date month: its rows name a year only beyond any prefix, or its name does, or nothing.
_FAR = """SELECT 'Docentes/m' || CAST(month(o_orderdate) AS STRING) || CASE WHEN month(o_orderdate) = 3 THEN ' 2011' ELSE '' END || '.csv' AS _path,
  o_orderkey AS _ord, CASE WHEN o_orderkey > 3000 AND month(o_orderdate) <> 4 THEN 'visto en ' || CAST(year(o_orderdate) AS STRING) || '.'
  ELSE 'una nota larga que nada dice del periodo ni del corte ni de la entidad que la hizo' END AS texto FROM {orders}"""


@query("far_file_year", f"WITH f AS ({B.sql_of(_FAR)}), y AS (SELECT _path, arg_min(CAST(regexp_extract(texto, '[0-9]{{4}}') AS INTEGER), _ord) AS anio FROM f WHERE texto LIKE 'visto%' GROUP BY 1) "
       "SELECT DISTINCT f._path AS archivo, CASE WHEN contains(f._path, '2011') THEN 2011 ELSE y.anio END AS anio, "
       "CASE WHEN contains(f._path, '2011') THEN 'nombre' WHEN y.anio IS NOT NULL THEN 'texto' END AS origen FROM f LEFT JOIN y ON f._path = y._path")
def far_file_year(spark, sf_dir):
    """Files whose first bytes say nothing: the name decides if it can, else the first year further on."""
    grid = B.derive(spark, sf_dir, _FAR).select("_path", F.lit("0").alias("_sheet"), "_ord", F.array("texto").alias("cells"))
    return G.file_year(grid).withColumnRenamed("_path", "archivo")
