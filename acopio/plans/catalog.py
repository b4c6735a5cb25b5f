"""Metadata of the masters: rows per (category, year), replacements, previews, deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import to_int_or_zero

KEYS = ["tipo", "anio"]


def metadata_counts(master: DataFrame) -> DataFrame:
    return master.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("registros"))


def metadata_totals(metadata: DataFrame) -> DataFrame:
    """Rows and datasets per category with the total of the years as rows where anio is null."""
    return (metadata.rollup(*KEYS).agg(F.sum("registros").alias("registros"), F.count(F.lit(1)).alias("datasets"),
                                       F.grouping("tipo").alias("_g"))
            .where("_g = 0").drop("_g"))


def metadata_upsert(metadata: DataFrame, fresh: DataFrame, category: str | Column) -> DataFrame:
    """Rows of a category replaced by ``fresh``, other categories kept."""
    return metadata.where(F.col("tipo") != category).unionByName(fresh)


def replace_categories(metadata: DataFrame, fresh: DataFrame) -> DataFrame:
    """The same for every category present in ``fresh``; categories are a handful."""
    touched = fresh.select("tipo").distinct()
    return metadata.join(touched, "tipo", "left_anti").unionByName(fresh)


def reload_aligned(df: DataFrame, canonical: list[str], year: str) -> DataFrame:
    """A stored master under its canonical columns: missing ones empty, rows without a year left out,
    the year of each row in ``_anio``."""
    rows = df.withColumn("_anio", to_int_or_zero(F.col(f"`{year}`"))).where("_anio <> 0")
    tech = [c for c in rows.columns if c.startswith("_")]
    return rows.select(*tech, *[F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in canonical])


def dataset_preview(master: DataFrame, where: Column, order: list[str], n: int) -> DataFrame:
    """First n rows of one dataset, each with the total row count of the dataset."""
    rows = master.where(where)
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy(*order).limit(n).withColumn("total", total.scalar())


def run_summary(results: DataFrame) -> DataFrame:
    """Successes and failures of a run, and per failing stage."""
    return results.groupBy("etapa").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("exitos"),
        F.count_if(~F.col("ok")).alias("fallos"))


def report_filter(report: DataFrame, column: str | None) -> DataFrame:
    return report if column is None else report.where(F.col("columna") == column)


def report_sorted(report: DataFrame, by: str, descending: bool = False) -> DataFrame:
    return report.orderBy(F.desc(by) if descending else F.asc(by))
