"""Raw grids: tables with no header, one array of cells per row.

Columns: ``_path`` (file), ``_sheet``, ``_ord`` (grows along the file), ``cells`` array<string>.
Everything found out about a file is an aggregate keyed by (file, sheet); rows of a file are never
gathered. Heads use ``row_number() <= n``, which Spark prunes per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.fold import match_key_text
from ..functions.similarity import key_similarity
from ..functions.text import clean_header, match_key, trimmed
from ..functions.years import extract_years, parse_year
from ..session import pin
from .aggregates import top_n
from .joins import attach

FILE = ["_path"]
SHEET = ["_path", "_sheet"]


def head_rows(grid: DataFrame, n: int, by: list[str] = FILE) -> DataFrame:
    """First n rows of each file with their 0-based position ``row_idx``."""
    out = top_n(grid, by, [F.asc("_ord")], n, rank="row_idx")
    return out.withColumn("row_idx", F.col("row_idx") - 1)


def pad_cells(cells: Column, n: int) -> Column:
    """Exactly n cells: missing ones are empty, extra ones are cut."""
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), n)), 1, n)


def grid_title(grid: DataFrame, by: list[str] = FILE) -> DataFrame:
    """First cell of the second row, empty when there is none."""
    second = F.max(F.when(F.col("row_idx") == 1, F.get("cells", F.lit(0))))
    return head_rows(grid, 2, by).groupBy(*by).agg(F.coalesce(second, F.lit("")).alias("titulo"))


def _numeric(cell: Column) -> Column:
    return cell.rlike("^(?=.*[0-9])[0-9]*\\.?[0-9]*$")


def header_score(cells: Column) -> Column:
    """Text cells + a tenth of all characters - 2 per numeric cell; null cells do not count."""
    seen = F.filter(cells, lambda v: v.isNotNull())
    numbers = F.size(F.filter(seen, _numeric))
    length = F.aggregate(seen, F.lit(0).cast("bigint"), lambda acc, v: acc + F.char_length(v))
    return (F.size(seen) - numbers) + length / F.lit(10.0) - 2 * numbers


def detect_header_row(grid: DataFrame, by: list[str] = FILE, rows: int = K.HEADER_ROWS) -> DataFrame:
    """Best-scoring row per file, the first one on a tie: (by..., header_idx, _header_ord)."""
    return _best_row(head_rows(grid, rows, by), by)


def _best_row(head: DataFrame, by: list[str]) -> DataFrame:
    filled = F.exists("cells", lambda v: v.isNotNull())
    score = F.when(filled, header_score(F.col("cells")))
    scored = head.withColumn("_score", F.when(score > -1, score))
    best = F.max_by(F.struct("row_idx", "_ord"), F.struct(F.col("_score"), -F.col("row_idx")))
    first = F.min(F.struct("row_idx", "_ord"))
    picked = F.when(F.count("_score") > 0, best).otherwise(first).alias("b")
    return scored.groupBy(*by).agg(picked).select(
        *by, F.col("b.row_idx").cast("bigint").alias("header_idx"), F.col("b._ord").alias("_header_ord"))


def detect_data_sheet(grid: DataFrame, rows: int = K.SHEET_ROWS) -> DataFrame:
    """Sheet with the most filled cells in its first rows, +50 when a year can be found in it.

    Ties go to the first sheet, by ``_sheet_pos`` if present, else by name.
    """
    pos = F.col("_sheet_pos") if "_sheet_pos" in grid.columns else F.col("_sheet")
    head = head_rows(grid.withColumn("_pos", pos), K.SHEET_YEAR_ROWS + 1, SHEET)
    filled = F.when(F.col("row_idx") < rows, F.size(F.filter("cells", lambda v: v.isNotNull()))).otherwise(0)
    has_year = F.exists("cells", lambda v: F.size(extract_years(v)) > 0)
    per_sheet = head.groupBy(*SHEET, "_pos").agg(
        (F.sum(filled) + F.when(F.max(has_year), 50).otherwise(0)).alias("puntaje"))
    w = Window.partitionBy("_path").orderBy(F.desc("puntaje"), F.asc("_pos"))
    return per_sheet.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(
        "_path", "_sheet", F.col("puntaje").cast("bigint").alias("puntaje"))


def _year_votes(src: DataFrame, by: list[str], weight: int, origin: int) -> DataFrame:
    """One row per mention, from ``cell`` at (``_row``, ``_col``)."""
    return src.select(*by, F.posexplode(extract_years(F.col("cell"))).alias("_at", "anio"),
                      F.struct(F.lit(origin).alias("o"), F.col("_row").cast("bigint").alias("r"),
                               F.col("_col").cast("int").alias("c"), F.lit(0).alias("at")).alias("_first"),
                      ).withColumn("_first", F.col("_first").withField("at", F.col("_at"))).withColumn(
                          "_w", F.lit(weight))


def _cells(rows: DataFrame, by: list[str], row: str) -> DataFrame:
    return rows.select(*by, F.col(row).alias("_row"), F.posexplode("cells").alias("_col", "cell"))


def year_scan(grid: DataFrame, by: list[str] = FILE, head: int = K.SCAN_ROWS,
              header: DataFrame | None = None, full: bool = True) -> DataFrame:
    """Years mentioned in a table: (by..., anio, peso, orden).

    A mention in a column name weighs 2, one in the first rows 1; only files with neither have
    every distinct value of theirs read. ``orden`` is 1 for the most weighted, first-seen year.
    """
    votes = _year_votes(_cells(head_rows(grid, head, by), by, "row_idx"), by, 1, 1)
    if header is not None:
        named = header.select(*by, F.lit(0).alias("_row"), F.posexplode("names").alias("_col", "cell"))
        votes = votes.unionByName(_year_votes(named, by, 2, 0))
    near = votes.groupBy(*by, "anio").agg(F.sum("_w").alias("peso"), F.min("_first").alias("_first"))
    key = ["o", "r", "c", "at"]
    near = near.select(*by, "anio", "peso", *[F.col(f"_first.{k}").cast("bigint").alias(f"_{k}") for k in key])
    if not full:
        return _ranked_years(near, by)
    near = pin(near)
    quiet = grid.select(*by).distinct().join(near.select(*by).distinct(), by, "left_anti")
    every = attach(grid, quiet, by, "left_semi").select(
        *by, F.col("_ord").alias("_row"), F.posexplode("cells").alias("_col", "cell"))
    once = every.where("cell IS NOT NULL").groupBy(*by, "_col", "cell").agg(F.min("_row").alias("_row"))
    # in the full read the column comes first, then the row
    far = once.select(*by, F.posexplode(extract_years(F.col("cell"))).alias("_at", "anio"),
                      F.col("_col").cast("bigint").alias("_a"), F.col("_row").alias("_b"))
    far = far.groupBy(*by, "anio").agg(
        F.count(F.lit(1)).alias("peso"),
        F.min(F.struct(F.lit(0).alias("o"), F.col("_a").alias("r"), F.col("_b").alias("c"),
                       F.col("_at").alias("at"))).alias("_first"))
    both = near.unionByName(
        far.select(*by, "anio", "peso", *[F.col(f"_first.{k}").cast("bigint").alias(f"_{k}") for k in key]))
    return _ranked_years(both, by)


def _ranked_years(votes: DataFrame, by: list[str]) -> DataFrame:
    """At most 201 years per file are ranked."""
    w = Window.partitionBy(*by).orderBy(F.desc("peso"), F.asc("_o"), F.asc("_r"), F.asc("_c"), F.asc("_at"))
    return votes.withColumn("orden", F.row_number().over(w)).select(
        *by, "anio", F.col("peso").cast("bigint").alias("peso"), F.col("orden").cast("bigint").alias("orden"))


def scanned_year(scan: DataFrame, by: list[str] = FILE, out: str = "anio") -> DataFrame:
    return scan.where("orden = 1").select(*by, F.col("anio").alias(out))


def best_year_column(headers: DataFrame, by: list[str] = FILE) -> DataFrame:
    """Header most similar to the year key, the first on a tie, at or above the threshold.

    ``headers``: (by..., pos, name).
    """
    sim = key_similarity(match_key(F.col("name")), F.lit(K.YEAR_KEY))
    scored = headers.select(*by, "pos", "name", sim.alias("sim")).where(F.col("sim") >= K.YEAR_COLUMN_THRESHOLD)
    best = F.max_by(F.struct("pos", "name", "sim"), F.struct(F.col("sim"), -F.col("pos"))).alias("b")
    return scored.groupBy(*by).agg(best).select(*by, F.col("b.pos").alias("pos"), F.col("b.name").alias("name"),
                                               F.col("b.sim").alias("sim"))


def similar_year_column(spark, columns: list[str]) -> str | None:
    """The one of a few column names most similar to the year key, if similar enough."""
    names = spark.createDataFrame([(0, i, c) for i, c in enumerate(columns)], "f int, pos int, name string")
    best = best_year_column(names, ["f"]).first()
    return best["name"] if best else None


def master_year_column(df: DataFrame, order: str = "_ord", sample: int = 200) -> str | None:
    """Year column of a table: by exact name, by similar name, else the first column whose first
    ``sample`` values mention the year the table's text speaks of most."""
    columns = [c for c in df.columns if not c.startswith("_")]
    exact = next((c for c in columns if match_key_text(c) == K.YEAR_KEY), None)
    found = exact or similar_year_column(df.sparkSession, columns)
    if found:
        return found
    texts = [F.col(f"`{c}`").cast("string") for c in columns]
    grid = df.select(F.lit("t").alias("_path"), F.col(order).alias("_ord"), F.array(*texts).alias("cells"))
    heads = df.sparkSession.createDataFrame([("t", columns)], "_path string, names array<string>")
    top = year_scan(grid, header=heads).where("orden = 1").first()
    if top is None:
        return None
    # where each column first says it, as the number of rows before; a prefix that says nothing leads on to a longer one
    mention = [F.contains(t, F.lit(str(top["anio"]))) for t in texts]
    first = df.agg(*[F.min(F.when(m, F.col(order))).alias(str(i)) for i, m in enumerate(mention)]).first()
    if all(v is None for v in first):
        return None
    before = df.agg(*[F.count_if(F.col(order) < F.lit(v)).alias(str(i)) for i, v in enumerate(first) if v is not None]).first().asDict()
    while min(before.values()) >= sample:
        sample *= 2
    return next(c for i, c in enumerate(columns) if before.get(str(i), sample) < sample)


def valid_years(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Distinct valid years of a column (per file when ``by`` is given)."""
    by = by or []
    return df.select(*by, parse_year(F.col(f"`{column}`")).alias("anio")).where("anio IS NOT NULL").distinct()


def dataset_year(cells: DataFrame, scan: DataFrame, by: list[str] = FILE, on_multiple: str = "min") -> DataFrame:
    """Year of each file: the years of its year column, else the best mention in its text.

    ``cells``: (by..., valor) of the year column. Several valid years: the smallest, or with
    ``on_multiple='error'`` no year, so the file is rejected.
    """
    one = F.min("y") if on_multiple == "min" else F.when(F.count_distinct("y") == 1, F.min("y"))
    stated = (cells.select(*by, parse_year(F.col("valor")).alias("y")).where("y IS NOT NULL")
              .groupBy(*by).agg(one.alias("_stated"), F.lit(True).alias("_has")))
    said = scanned_year(scan, by, "_said")
    both = stated.join(said, by, "full")
    return both.select(*by, F.when(F.col("_has"), F.col("_stated")).otherwise(F.col("_said")).alias("anio"))


def text_year(lines: DataFrame, limit: int = K.YEAR_TEXT_BYTES, by: list[str] = FILE) -> DataFrame:
    """First year in the first ``limit`` bytes of each file: (by..., anio).

    ``lines``: (by..., _ord, value). A line takes at least one byte, so at most ``limit`` lines of
    a file are looked at.
    """
    head = head_rows(lines, limit, by)
    w = Window.partitionBy(*by).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("value") + 1
    begun = head.withColumn("_before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("_before") < limit)
    # the last line is cut where the byte budget ends
    part = F.decode(F.substring(F.encode("value", "UTF-8"), F.lit(1), (F.lit(limit) - F.col("_before")).cast("int")), "UTF-8")
    first = F.get(extract_years(F.when(F.col("_before") + size > limit, part).otherwise(F.col("value"))), F.lit(0))
    return (begun.select(*by, "row_idx", first.alias("y")).where("y IS NOT NULL")
            .groupBy(*by).agg(F.min_by("y", "row_idx").alias("anio")))


def file_year(grid: DataFrame, rows: int = K.YEAR_ROWS, sheets: int = 8) -> DataFrame:
    """Year of each file without knowing its columns: (_path, anio, origen).

    First rows of up to 8 sheets (each sheet's years vote 4, 3, 2, 1, 1...), else the first bytes
    of the text, else the file name. Only files in which all of these are silent are read to their end, for the first
    year anywhere in them (``texto`` too).
    """
    pos = F.col("_sheet_pos") if "_sheet_pos" in grid.columns else F.col("_sheet")
    tagged = grid.withColumn("_pos", pos)
    order = Window.partitionBy("_path").orderBy("_pos")
    names = tagged.select("_path", "_sheet", "_pos").distinct().withColumn("_s", F.dense_rank().over(order))
    near = head_rows(tagged, rows, SHEET)
    scan = year_scan(near.select("_path", "_sheet", "_ord", "cells"), SHEET, rows, full=False)
    votes = scan.join(names.where(F.col("_s") <= sheets), SHEET).withColumn(
        "_v", F.greatest(F.lit(1), 5 - F.col("orden")))
    best = votes.groupBy("_path", "anio").agg(F.sum("_v").alias("v"), F.min(F.struct("_s", "orden")).alias("f"))
    from_grid = best.groupBy("_path").agg(
        F.max_by("anio", F.struct("v", -F.col("f._s"), -F.col("f.orden"))).alias("g"))
    lines = grid.select("_path", "_ord", F.array_join("cells", ",").alias("value"))
    from_text = text_year(lines).withColumnRenamed("anio", "t")
    from_name = grid.select("_path").distinct().withColumn(
        "n", F.get(extract_years(F.regexp_extract("_path", "([^/]+)$", 1)), F.lit(0)))
    out = from_name.join(from_grid, "_path", "left").join(from_text, "_path", "left")
    origin = F.when(F.col("g").isNotNull(), "filas").when(F.col("t").isNotNull(), "texto").when(
        F.col("n").isNotNull(), "nombre")
    out = pin(out.select("_path", F.coalesce("g", "t", "n").alias("anio"), origin.alias("origen")))    # one row per file
    silent = out.where("anio IS NULL").select("_path")
    if silent.isEmpty():
        return out
    return out.join(_first_year(tagged, silent), "_path", "left").select(
        "_path", F.coalesce("anio", "_far").alias("anio"), F.when(F.col("_far").isNotNull(), "texto").otherwise(F.col("origen")).alias("origen"))


def _first_year(tagged: DataFrame, files: DataFrame) -> DataFrame:
    """(_path, _far): the first year anywhere in the given files, by sheet and row. Rows are not brought together."""
    years = extract_years(F.array_join("cells", ","))
    said = attach(tagged, files, FILE, "left_semi", ready=True).select("_path", "_pos", "_ord", F.get(years, F.lit(0)).alias("y"))
    return said.where("y IS NOT NULL").groupBy("_path").agg(F.min_by("y", F.struct("_pos", "_ord")).alias("_far"))


def header_names(header_cells: Column) -> Column:
    """Column names of a header row: blanks are numbered, repeats get a numeric tail."""
    filled = F.transform(header_cells, lambda v, i: F.when(
        v.isNull() | (trimmed(v) == ""), F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(v))
    return F.transform(filled, lambda v, i: _numbered(filled, v, i))


def _numbered(names: Column, v: Column, i: Column) -> Column:
    before = F.size(F.filter(F.slice(names, F.lit(1), i), lambda o: o == v))
    return F.when(before > 0, F.concat(v, F.lit("."), before.cast("string"))).otherwise(v)


def file_headers(grid: DataFrame, by: list[str] = FILE) -> DataFrame:
    """(by..., names, _header_ord): the cleaned header of each file."""
    head = pin(head_rows(grid, K.HEADER_ROWS, by))  # a score of rows per file, read once
    row = head.join(_best_row(head, by), by).where(F.col("row_idx") == F.col("header_idx"))
    return row.select(*by, "_header_ord", F.col("header_idx"),
                      F.transform(header_names(F.col("cells")), clean_header).alias("names"))


def explode_headers(headers: DataFrame, by: list[str] = FILE) -> DataFrame:
    return headers.select(*by, F.posexplode("names").alias("pos", "name"))
