"""A run over categories: integrate new files, clean the masters, build the star once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..sources.masters import stage_all
from . import ingest as I
from . import star as S

RESULT = "categoria string, ok boolean, etapa string, detalle string"
DONE, INTEGRATE, CLEAN, STAR = "completado", "integracion_csv_maestro", "limpieza_csv", "construccion_estrella"


def run_category(spark: SparkSession, category: str, grid: DataFrame | None, root: str, **options) -> DataFrame:
    """Result rows of one category: one for each file that could not be integrated, or one in all.

    The other files reach the master and are cleaned all the same; a failure does not touch other categories.
    """
    stage, failed = INTEGRATE, None
    try:
        if grid is not None:
            done = I.ingest_grid(grid, category, **options)
            files = I.pin(done.files.withColumn("tipo", F.lit(category)))
            detail = F.concat_ws(": ", "_path", "motivo")
            failed = files.where("motivo IS NOT NULL").select(
                F.lit(category).alias("categoria"), F.lit(False).alias("ok"), F.lit(stage).alias("etapa"), detail.alias("detalle"))
            winners = I.latest_file_wins(files.where("motivo IS NULL"), ["tipo", "anio"])
            rows = I.attach(done.rows.withColumnRenamed("_anio", "anio"), winners, ["_path", "anio"], "inner")
            I.upsert_by_year(rows, root)
        stage = CLEAN
        if failed is None or failed.isEmpty() or _has_master(spark, root, category):
            I.clean_master(spark, root, category)
        if failed is not None and not failed.isEmpty():
            return failed
        result = (category, True, DONE, "")
    except Exception as e:  # reported per category
        result = (category, False, stage, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
    rest = spark.createDataFrame([result], RESULT)
    return rest if failed is None else rest.union(failed)


def _has_master(spark: SparkSession, root: str, category: str) -> bool:
    have = I.stored_years(spark, root)
    return have is not None and not have.where(F.col("tipo") == category).isEmpty()


def master_frames(spark: SparkSession, root: str, categories) -> dict[str, DataFrame]:
    """Stored masters with the reading order the dimensions need: year, then row."""
    have = I.stored_years(spark, root)
    stored = set() if have is None else {r["tipo"] for r in have.select("tipo").distinct().collect()}
    out = {}
    for category in categories:
        if category not in stored:
            continue
        df = I.read_master(spark, root, category)
        order = F.col("anio").cast("bigint") * F.lit(1 << 44) + F.col("_ord")
        out[category] = df.select(order.alias("_ord"), *[f"`{h}`" for h in K.CANONICAL_HEADERS[category] if h in df.columns])
    return out


def run(spark: SparkSession, grids: dict[str, DataFrame | None], root: str, star_root: str, **options) -> DataFrame:
    """``grids``: category -> raw grid of its new files, or None when there are none.

    Without new files the stored master is still cleaned. The star is built once at the end from
    all stored masters.
    """
    results = [run_category(spark, c, g, root, **options) for c, g in grids.items()]
    try:
        S.write_star(S.build_star(stage_all(master_frames(spark, root, K.CATEGORIES))), star_root)
    except Exception as e:  # the previous star version stays published
        results.append(spark.createDataFrame([("GLOBAL", False, STAR, str(e).splitlines()[0])], RESULT))
    return reduce(DataFrame.union, results) if results else spark.createDataFrame([], RESULT)
