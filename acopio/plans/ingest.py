"""From raw grids to year-partitioned masters, all files of a category at once.

What is learnt about a file (sheet, header row, column mapping, end of the table, year) is one
small row per file; it is attached to the grid rows, and grid rows are never gathered per file.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import cleaning as C
from ..operators import grid as G
from ..operators.joins import attach
from ..operators.matching import mapping_arrays, match_columns, match_scores
from ..session import pin, stage
from ..sources.files import file_name, folder_category
from . import snapshots
from .snapshots import KEYS

FILE = ["_path"]


class Ingested(NamedTuple):
    rows: DataFrame      # _path, _ord, _anio, canonical columns
    files: DataFrame     # _path, anio, motivo (null when integrated)


def canonical_columns(category: str, headers: DataFrame | None = None) -> list[str]:
    """Fixed list of a category, else the cleaned headers of its first file, else nothing."""
    if category in K.CANONICAL_HEADERS:
        return K.CANONICAL_HEADERS[category]
    if headers is None:
        return []
    first = headers.orderBy("_path").select("names").first()
    return list(first["names"]) if first else []


def canonical_table(spark: SparkSession) -> DataFrame:
    rows = [(t, i, h) for t, hs in K.CANONICAL_HEADERS.items() for i, h in enumerate(hs)]
    return spark.createDataFrame(rows, "tipo string, pos int, name string")


def align_rows(grid: DataFrame, plan: DataFrame, canonical: list[str]) -> DataFrame:
    """Canonical columns in order: mapped cells by position, the rest null.

    ``plan``: (_path, _header_ord, mapping); rows up to the header are not data.
    """
    rows = attach(grid, plan, FILE, "inner").where(F.col("_ord") > F.col("_header_ord"))
    cols = [F.get("cells", F.get("mapping", F.lit(i))).alias(c) for i, c in enumerate(canonical)]
    return rows.select("_path", "_ord", *cols)


def chosen_year(aligned: DataFrame, grid: DataFrame, canonical: list[str], on_multiple: str = "min",
                default_year: int | None = None) -> DataFrame:
    """(_path, anio): year column, else text of the table, else text or name of the file, else default."""
    target = C.year_column(canonical) or G.similar_year_column(grid.sparkSession, canonical)
    files = aligned.select("_path").distinct()
    if target is not None:
        years = pin(aligned.select("_path", G.parse_year(F.col(f"`{target}`")).alias("y"))
                    .where("y IS NOT NULL").groupBy("_path")
                    .agg(F.min("y").alias("_lo"), F.max("y").alias("_hi")))
        one = F.col("_lo") if on_multiple == "min" else F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
        years = years.select("_path", one.alias("_col"), F.lit(True).alias("_stated"))
        silent = pin(files.join(years, "_path", "left_anti"))
    else:
        years, silent = None, pin(files)
    out = files
    if years is not None:
        out = out.join(years, "_path", "left")
    else:
        out = out.withColumn("_col", F.lit(None).cast("int")).withColumn("_stated", F.lit(None).cast("boolean"))
    if silent.isEmpty():
        return out.select("_path", F.col("_col").alias("anio"))
    # only files whose year column says nothing are read again
    cells = F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in canonical])
    own = attach(aligned, silent, FILE, "left_semi", ready=True).select("_path", "_ord", cells.alias("cells"))
    heads = silent.withColumn("names", F.array(*[F.lit(c) for c in canonical]))
    said = G.scanned_year(G.year_scan(own, header=heads), out="_said")
    raw = attach(grid, silent, FILE, "left_semi", ready=True)
    named = G.file_year(raw).select("_path", F.col("anio").alias("_file"))
    out = out.join(said, "_path", "left").join(named, "_path", "left")
    found = F.coalesce("_said", "_file", F.lit(default_year).cast("int"))
    return out.select("_path", F.when(F.col("_stated"), F.col("_col")).otherwise(found).alias("anio"))


def filled_headers(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """(_path, pos, name) of the header cells whose column holds a cell below the header.

    Tasks collapse the positions before the shuffle; what meets is one row per file and column.
    """
    below = attach(grid, headers.select("_path", "_header_ord"), FILE, "inner").where(F.col("_ord") > F.col("_header_ord"))
    filled = (below.select("_path", F.posexplode("cells").alias("pos", "cell")).where("cell <> ''")
              .select("_path", "pos").distinct())
    return G.explode_headers(headers).join(filled, ["_path", "pos"], "left_semi")


def ingest_grid(grid: DataFrame, category: str, canonical: list[str] | None = None,
                on_multiple: str = "min", default_year: int | None = None, sheets: bool | None = None) -> Ingested:
    """Integrate all files of one category. ``sheets``: whether files can have several sheets
    (delimited text cannot); None looks."""
    if sheets is None:
        per_file = grid.select("_path", "_sheet").distinct().groupBy("_path").count()
        sheets = not per_file.where("count > 1").isEmpty()
    if sheets:
        grid = attach(grid, G.detect_data_sheet(grid).select("_path", "_sheet"), G.SHEET, "left_semi")
    headers = pin(G.file_headers(grid))
    canonical = canonical or canonical_columns(category, headers)
    # an empty column of the file must not take a canonical place from a filled one
    scores = match_scores(pin(filled_headers(grid, headers)), canonical, FILE)
    mapping = mapping_arrays(match_columns(scores, FILE, len(canonical)), FILE, len(canonical))
    plan = pin(headers.join(mapping, "_path", "left").select("_path", "_header_ord", "mapping"))
    # text is parsed and aligned once; the passes below read columns of the written table
    aligned = stage(C.drop_all_null_rows(align_rows(grid, plan, canonical)), "aligned")
    aligned = C.trim_footer(aligned, "_ord", "_path", canonical)
    years = pin(chosen_year(aligned, grid, canonical, on_multiple, default_year))
    dated = attach(aligned, years.where("anio IS NOT NULL"), FILE, "inner", ready=True)
    target = C.year_column(canonical)
    rows = dated.select("_path", "_ord", F.col("anio").alias("_anio"), *[
        (F.col("anio").cast("string").alias(c) if c == target else F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c))
        for c in canonical])
    seen = grid.select("_path").distinct().join(years, "_path", "left")
    have = years.select("_path").withColumn("_rows", F.lit(True))
    files = seen.join(have, "_path", "left").select("_path", "anio", F.when(
        F.col("_rows").isNull(), "sin datos").when(F.col("anio").isNull(), "sin año").alias("motivo"))
    return Ingested(rows, files)


def latest_file_wins(files: DataFrame, by: list[str], path: str = "_path") -> DataFrame:
    """Per (category, year) the file with the last path."""
    return files.groupBy(*by).agg(F.max(path).alias(path))


def consolidate(parts: dict[str, Ingested]) -> DataFrame:
    """One row per winning file: (tipo, anio, _path)."""
    frames = [p.files.where("motivo IS NULL").withColumn("tipo", F.lit(t)) for t, p in parts.items()]
    return latest_file_wins(reduce(DataFrame.unionByName, frames), ["tipo", "anio"])


def assign_year(df: DataFrame, years: DataFrame, column: str, by: str = "_path") -> DataFrame:
    """Overwrite (or add) the year column with the year of each row's file."""
    dated = attach(df, years.select(by, F.col("anio").alias("_y")), [by], "left")
    keep = [F.col(f"`{c}`") for c in df.columns if c != column]
    return dated.select(*keep, F.coalesce(F.col("_y").cast("string"), F.col(f"`{column}`") if column in df.columns
                                          else F.lit(None)).alias(column))


# --- masters on disk ------------------------------------------------------------------------------------------

def upsert_by_year(rows: DataFrame, root: str, on_duplicate: str = "replace") -> None:
    """Write rows (tipo, anio, ...) into a master; years they bring replace the stored ones.

    Readers see all of it at once or nothing (``snapshots``), and writing the same rows again changes nothing.
    ``on_duplicate='skip'`` leaves years that are already stored alone.
    """
    spark = rows.sparkSession
    if on_duplicate != "skip":
        snapshots.commit(spark, root, snapshots.put_all(snapshots.write(rows, root)))
        return
    have = stored_years(spark, root)
    if have is not None:
        rows = attach(rows, have, KEYS, "left_anti")
    written = snapshots.write(rows, root)

    def decide(state: snapshots.State) -> list[dict]:
        new = [written.put(k) for k in written.folders if k not in state.held]
        return [written.declared(), *new] if new else []
    snapshots.commit(spark, root, decide)


def stored_years(spark: SparkSession, root: str) -> DataFrame | None:
    """(tipo, anio) of what a master holds, from its log alone; None when it holds nothing."""
    state = snapshots.current(spark, root)
    return snapshots.stored(spark, state) if state.held else None


def read_master(spark: SparkSession, root: str, category: str | None = None, year: int | None = None,
                state: snapshots.State | None = None) -> DataFrame:
    """The rows of a master as last published (or as of ``state``); only folders of the asked categories and years
    are opened."""
    state = state or snapshots.current(spark, root)
    if not state.schemas:
        raise FileNotFoundError(f"no master at {root}")
    keys = [k for k in state.held if category in (None, k[0]) and year in (None, k[1])]
    return snapshots.read(spark, root, state, keys)


def rewrite_master(df: DataFrame, root: str, category: str, base: snapshots.State | None = None) -> DataFrame:
    """Replace one category's contents by what was derived from the master itself; a year of which nothing is left
    goes. One commit publishes all of it, and it is refused (``snapshots.Conflict``) if the category is not any more
    what it was at ``base``, the state that ``df`` was read from."""
    spark = df.sparkSession
    base = base or snapshots.current(spark, root)
    written = snapshots.write(df, root)
    snapshots.commit(spark, root, snapshots.rewritten(written, category, base))
    return read_master(spark, root, category)


def delete_stored(spark: SparkSession, root: str, category: str, year: int | None = None) -> int:
    """Delete one year of a category, or the category, from a stored master; the number of years deleted.

    The log says so; ``snapshots.vacuum`` removes the files. What is not stored deletes nothing.
    """
    gone: list[dict] = []

    def decide(state: snapshots.State) -> list[dict]:
        gone[:] = snapshots.drop(lambda k: k[0] == category and year in (None, k[1]))(state)
        return list(gone)
    snapshots.commit(spark, root, decide)
    return len(gone)


def clean_master(spark: SparkSession, root: str, category: str, out: str | None = None,
                 institutions: list[str] | None = None) -> DataFrame:
    """Base cleaning of one category's master, in place or to another folder."""
    keep = K.CANONICAL_HEADERS.get(category)
    base = snapshots.current(spark, root)
    df = read_master(spark, root, category, state=base)
    data = [c for c in (keep or df.columns) if c in df.columns and c not in ("tipo", "anio")]
    tech = [c for c in df.columns if c.startswith("_")]
    df = df.select(F.col("tipo").alias("_tipo"), F.col("anio").alias("_anio"), *tech, *[f"`{c}`" for c in data])
    clean = C.base_clean(df, institutions=institutions).withColumnsRenamed({"_tipo": "tipo", "_anio": "anio"})
    if out is None:
        # masters stay text, so that every category keeps one schema across years
        texts = [F.col(f"`{c}`").cast("string").alias(c) if c in data else F.col(f"`{c}`") for c in clean.columns]
        return rewrite_master(clean.select(*texts), root, category, base)
    upsert_by_year(clean, out)
    return read_master(spark, out, category)


def ingest_listing(spark: SparkSession, grids: DataFrame, **options) -> dict[str, Ingested]:
    """Integrate a grid that mixes categories, by the folder its files lie in."""
    tagged = grids.withColumn("_tipo", folder_category(F.col("_path")))
    out = {}
    for category in [r["_tipo"] for r in tagged.select("_tipo").distinct().collect() if r["_tipo"]]:
        out[category] = ingest_grid(tagged.where(F.col("_tipo") == category).drop("_tipo"), category, **options)
    return out


def short_name(df: DataFrame) -> DataFrame:
    return df.withColumn("archivo", file_name(F.col("_path")))
