"""Queries for files, masters on disk, incremental ingestion and run results.

Files are first written from the tables into the shared work folder, then read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators.aggregates import number_rows
from ..session import new_path
from ..sources import files as S
from ..streaming import incremental as R
from . import bindings as B
from . import catalog
from . import ingest as I
from .registry import query

_COLS = ["codigo", "institucion", "sector", "sexo", "anio", "total"]
_DIRTY = B.sql_of(B.DIRTY)


def _customers_csv(spark, sf_dir, label):
    path = new_path(spark, label)
    S.write_csv(B.derive(spark, sf_dir, B.DIRTY).select(*_COLS), path)
    return path


@query("scan_master", f"SELECT {', '.join(_COLS)} FROM ({_DIRTY}) t")
def scan_master(spark, sf_dir):
    """Every cell is text again and blanks are empty strings, not nulls."""
    return S.scan_master(spark, _customers_csv(spark, sf_dir, "master"))


_QUOTED = """SELECT CAST(doc_id AS STRING) AS id, lang AS idioma, text AS texto FROM {documents}"""


@query("csv_roundtrip", B.sql_of(_QUOTED))
def csv_roundtrip(spark, sf_dir):
    """Whole texts with quotes, commas and line breaks survive export and re-reading."""
    path = new_path(spark, "docs")
    S.write_csv(B.derive(spark, sf_dir, _QUOTED), path)
    return S.scan_master(spark, path)


@query("scan_encoding_fallback", "SELECT CASE WHEN c_nationkey < 12 THEN 'utf8' ELSE 'latin1' END AS grupo, CAST(c_custkey AS VARCHAR) AS codigo, "
       "'Institución ' || c_name AS nombre FROM customer")
def scan_encoding_fallback(spark, sf_dir):
    """Files in two encodings read in one go; the encoding is settled per file."""
    root = new_path(spark, "enc")
    df = B.tables(spark, sf_dir, ["customer"])["customer"].select(
        F.col("c_nationkey"), F.col("c_custkey").cast("string").alias("codigo"), F.concat(F.lit("Institución "), "c_name").alias("nombre"))
    for group, mine, enc in (("utf8", "c_nationkey < 12", "UTF-8"), ("latin1", "c_nationkey >= 12", "ISO-8859-1")):
        (df.where(mine).drop("c_nationkey").write.option("encoding", enc).csv(f"{root}/{group}"))
    grid = S.raw_grid(spark, [f"{root}/utf8", f"{root}/latin1"])
    return grid.select(F.regexp_extract("_path", "/(utf8|latin1)/", 1).alias("grupo"), F.get("cells", F.lit(0)).alias("codigo"),
                       F.get("cells", F.lit(1)).alias("nombre"))


@query("raw_grid_order", "SELECT CAST(o_orderkey AS VARCHAR) AS pedido, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders")
def raw_grid_order(spark, sf_dir):
    """One sorted file read in several splits keeps its line order in ``_ord``."""
    path = new_path(spark, "sorted")
    orders = B.tables(spark, sf_dir, ["orders"])["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    orders.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.csv(path)
    grid = S.raw_grid(spark, [path])
    # part files are numbered in key order, so file name then row order is the line order
    part = F.regexp_extract("_path", "part-(\\d+)", 1).cast("bigint")
    flat = grid.select((part * F.lit(1 << 44) + F.col("_ord")).alias("o"), F.get("cells", F.lit(0)).alias("pedido"))
    return number_rows(flat, ["o"], "pos").select("pedido", "pos")


# --- listings --------------------------------------------------------------------------------------------

def _listing(spark, sf_dir):
    """A folder per category with one csv per nation, and files of other kinds to be passed over."""
    root = new_path(spark, "lake")
    df = B.tables(spark, sf_dir, ["customer"])["customer"]
    folders = list(K.FOLDER_CATEGORY)
    pick = F.element_at(F.array(*[F.lit(f) for f in folders]), (F.col("c_nationkey") % len(folders) + 1).cast("int"))
    (df.select(pick.alias("carpeta"), "c_nationkey", "c_name").repartition("c_nationkey")
     .write.partitionBy("carpeta", "c_nationkey").csv(root))
    return root


_LIST = "SELECT c_nationkey, list_extract([" + ", ".join(f"'{f}'" for f in K.FOLDER_CATEGORY) + f"], CAST(c_nationkey % {len(K.FOLDER_CATEGORY)} + 1 AS BIGINT)) AS carpeta FROM customer GROUP BY 1"
_CAT = "CASE carpeta " + " ".join(f"WHEN '{f}' THEN '{c}'" for f, c in K.FOLDER_CATEGORY.items()) + " END"


def _listed(spark, sf_dir):
    """Listed paths put in the shape folder/file that deliveries have."""
    root = _listing(spark, sf_dir)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    tidy = F.concat(F.regexp_extract("path", "carpeta=([^/]+)", 1), F.lit("/"), F.regexp_extract("path", "c_nationkey=(\\d+)", 1),
                    S.extension(F.col("path")))
    return S.with_category(found.select(tidy.alias("path")))


@query("list_category_files", f"SELECT {_CAT} AS tipo, carpeta, CAST(c_nationkey AS VARCHAR) || '.csv' AS archivo FROM ({_LIST}) l")
def list_category_files(spark, sf_dir):
    return _listed(spark, sf_dir).select("tipo", "carpeta", "archivo").distinct()


@query("files_per_category", f"SELECT {_CAT} AS tipo, count(*) AS archivos, count_if(c_nationkey < 12) AS integrados, count_if(c_nationkey >= 12) AS fallidos FROM ({_LIST}) l GROUP BY 1")
def files_per_category(spark, sf_dir):
    files = _listed(spark, sf_dir).distinct()
    done = files.where(F.regexp_extract("archivo", "^(\\d+)", 1).cast("int") < 12)
    return S.files_per_category(files, done)


_PATHS = "SELECT DISTINCT url FROM {pages}"
_SEEN = "SELECT url FROM {pages} WHERE contains(url, '/en/')"


@query("new_files_anti", f"SELECT DISTINCT url FROM pages WHERE NOT contains(url, '/en/') ORDER BY url")
def new_files_anti(spark, sf_dir):
    return S.new_files(B.derive(spark, sf_dir, _PATHS), B.derive(spark, sf_dir, _SEEN), "url").orderBy("url")


@query("canonical_columns", "SELECT tipo, pos, name, n FROM (VALUES "
       + ", ".join(f"('{t}', {i}, '{h}')" for t, hs in K.CANONICAL_HEADERS.items() for i, h in enumerate(hs))
       + ") v(tipo, pos, name), (SELECT count(*) AS n FROM orders) o WHERE tipo = 'Administrativos'")
def canonical_columns(spark, sf_dir):
    """The columns a master of orders gets, each with the rows it would hold."""
    rows = B.under_headers(B.derive(spark, sf_dir, B.ADMIN), "Administrativos")
    filled = rows.agg(*[F.count(F.lit(1)).alias(str(i)) for i in range(len(rows.columns) - 1)])
    counts = filled.unpivot([], filled.columns, "pos", "n").withColumn("pos", F.col("pos").cast("int"))
    return I.canonical_table(spark).where("tipo = 'Administrativos'").join(F.broadcast(counts), "pos")


# --- masters ---------------------------------------------------------------------------------------------

_ROWS = """SELECT 'Administrativos' AS tipo, year(o_orderdate) AS anio, 'a_' || o_orderstatus AS archivo, o_orderkey AS id, o_orderpriority AS valor FROM {orders}"""


def _batch(spark, sf_dir):
    return B.derive(spark, sf_dir, _ROWS).withColumn("anio", F.col("anio").cast("int"))


@query("upsert_by_year", "SELECT 'Administrativos' AS tipo, year(o_orderdate) AS anio, 'a_P' AS archivo, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 2")
def upsert_by_year(spark, sf_dir):
    """Three deliveries per year in file order, then the last one again: the last one stays."""
    root = new_path(spark, "master")
    df = _batch(spark, sf_dir)
    for name in ("a_F", "a_O", "a_P", "a_P"):
        I.upsert_by_year(df.where(F.col("archivo") == name), root)
    out = I.read_master(spark, root)
    return out.groupBy("tipo", "anio", "archivo").agg(F.count(F.lit(1)).alias("n")).withColumn("anio", F.col("anio").cast("bigint"))


@query("consolidate_master", "SELECT tipo, year(o_orderdate) AS anio, o_orderstatus AS estado, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS suma FROM "
       "(SELECT 'Administrativos' AS tipo, * FROM orders) o GROUP BY 1, 2, 3")
def consolidate_master(spark, sf_dir):
    """Yearly parts with different columns stacked into one partitioned master and read back."""
    root = new_path(spark, "union")
    df = B.tables(spark, sf_dir, ["orders"])["orders"].select(
        F.lit("Administrativos").alias("tipo"), F.year("o_orderdate").alias("anio"), F.col("o_orderstatus").alias("estado"), "o_orderkey", "o_orderpriority")
    early, late = df.where("anio < 1998").drop("o_orderpriority"), df.where("anio >= 1998")
    I.upsert_by_year(early.unionByName(late, allowMissingColumns=True), root)
    return I.read_master(spark, root).groupBy("tipo", F.col("anio").cast("bigint").alias("anio"), "estado").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("suma"))


@query("delete_year", "SELECT anio, count(*) AS n FROM (SELECT year(o_orderdate) AS anio FROM orders) t WHERE anio <> 1998 GROUP BY 1")
def delete_year(spark, sf_dir):
    root = new_path(spark, "shrinking")
    I.upsert_by_year(_batch(spark, sf_dir), root)
    I.delete_stored(spark, root, "Administrativos", 1998)
    kept = I.read_master(spark, root)
    return kept.groupBy(F.col("anio").cast("bigint").alias("anio")).agg(F.count(F.lit(1)).alias("n"))


@query("metadata_scan", "SELECT 'Administrativos' AS tipo, year(o_orderdate) AS anio, count(*) AS registros FROM orders GROUP BY 2")
def metadata_scan(spark, sf_dir):
    """Counts by partition columns alone; no data column of the stored master is read."""
    root = new_path(spark, "meta")
    I.upsert_by_year(_batch(spark, sf_dir), root)
    return catalog.metadata_counts(I.read_master(spark, root)).withColumn("anio", F.col("anio").cast("bigint"))


@query("run_summary", "SELECT CASE WHEN l_linenumber > 5 THEN 'limpieza_csv' ELSE 'completado' END AS etapa, count(*) AS total, "
       "count_if(l_linenumber <= 5) AS exitos, count_if(l_linenumber > 5) AS fallos FROM lineitem GROUP BY 1")
def run_summary(spark, sf_dir):
    df = B.tables(spark, sf_dir, ["lineitem"])["lineitem"].select(
        F.when(F.col("l_linenumber") > 5, "limpieza_csv").otherwise("completado").alias("etapa"), (F.col("l_linenumber") <= 5).alias("ok"))
    return catalog.run_summary(df)


# --- streams ---------------------------------------------------------------------------------------------

def _event_files(spark, sf_dir):
    events = B.tables(spark, sf_dir, ["events"])["events"].select("event_id", "ts", "event_type", "value")
    path = new_path(spark, "arrivals")
    events.repartition(4).write.parquet(path)
    return path, events.schema


@query("stream_new_files", "SELECT 'primera' AS pasada, count(*) AS filas, CAST(sum(event_id) AS BIGINT) AS suma FROM events")
def stream_new_files(spark, sf_dir):
    """Two runs over the same folder: the second finds nothing new."""
    path, schema = _event_files(spark, sf_dir)
    out, ledger = new_path(spark, "out"), new_path(spark, "ledger")
    for name in ("primera", "segunda"):
        def sink(batch, _epoch, name=name):
            batch.select(F.lit(name).alias("pasada"), "event_id").write.mode("append").parquet(out)
        R.run_available(R.file_stream(spark, path, schema), sink, ledger)
    return spark.read.parquet(out).groupBy("pasada").agg(F.count(F.lit(1)).alias("filas"), F.sum("event_id").alias("suma"))


@query("stream_counts", "SELECT event_type, CAST(ts AS DATE) AS dia, count(*) AS registros FROM events GROUP BY 1, 2")
def stream_counts(spark, sf_dir):
    """Two files a batch; every batch writes only the keys it changed."""
    path, schema = _event_files(spark, sf_dir)
    table = new_path(spark, "counts")
    stream = R.file_stream(spark, path, schema, max_files=2)
    R.stream_counts(stream, [F.col("event_type"), F.to_date("ts").alias("dia")], new_path(spark, "ck"), table)
    return R.read_counts(spark, table)


@query("stream_upsert", "SELECT 'eventos' AS tipo, month(ts) AS anio, count(*) AS n FROM events GROUP BY 2")
def stream_upsert(spark, sf_dir):
    """Deliveries of several part files, one file a batch: a first one, a corrected one of everything of which a part
    comes late, and an older one that comes last and does not win."""
    events = B.tables(spark, sf_dir, ["events"])["events"].select("event_id", "ts", "event_type")
    path, root, ledger = new_path(spark, "in"), new_path(spark, "upsert"), new_path(spark, "ledger")
    sink = R.upsert_sink(root, F.lit("eventos"), F.month("ts"))
    late = F.col("event_id") % 3 == 0
    for delivery, part in ((1, events.where("event_type = 'view'")), (2, events.where(~late)), (2, events.where(late)), (0, events)):
        part.repartition(2).write.mode("append").parquet(f"{path}/entrega-{delivery}")
        R.run_available(R.file_stream(spark, f"{path}/*", events.schema, max_files=1), sink, ledger)
    out = I.read_master(spark, root)
    return out.groupBy("tipo", F.col("anio").cast("bigint").alias("anio")).agg(F.count(F.lit(1)).alias("n"))

