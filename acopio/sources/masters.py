"""Staging frames: a master under its canonical headers becomes fixed snake_case columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.fold import match_key_text
from ..functions.text import to_int_or_zero


def alias_names(columns: list[str]) -> dict[str, str]:
    """Header -> staging name; per staging name the first spelling found among the headers."""
    by_key = {match_key_text(c): c for c in columns if not c.startswith("_")}
    out = {}
    for name, spellings in K.STAGING_ALIASES.items():
        hit = next((by_key[k] for k in map(match_key_text, spellings) if k in by_key), None)
        if hit is not None:
            out[hit] = name
    return out


def alias_rename(df: DataFrame) -> DataFrame:
    names = alias_names(df.columns)
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def _stage(df: DataFrame, columns: list[str], measure: str | None = None) -> DataFrame:
    df = alias_rename(df)
    tech = [c for c in df.columns if c.startswith("_")]
    missing = F.lit(None).cast("string")
    out = []
    for c in columns:
        if c == measure:
            out.append((to_int_or_zero(F.col(c)) if c in df.columns else F.lit(0).cast("bigint")).alias(c))
        else:
            out.append(F.col(c) if c in df.columns else missing.alias(c))
    return df.select(*tech, *out)


def stage_admin(df: DataFrame) -> DataFrame:
    return _stage(df, K.IES_COLUMNS + ["anio", "semestre"] + K.ADMIN_MEASURES)


def stage_staff(df: DataFrame) -> DataFrame:
    return _stage(df, K.IES_COLUMNS + K.STAFF_TEXTS + ["anio", "semestre", "num_docentes"])


def stage_students(df: DataFrame, measure: str) -> DataFrame:
    return _stage(df, K.IES_COLUMNS + K.PROGRAM_COLUMNS + K.OFFER_COLUMNS
                  + ["sexo", "anio", "semestre", measure], measure)


def stage_all(masters: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Category -> staging frame for the categories the star is built from."""
    out = {}
    if "Administrativos" in masters:
        out["Administrativos"] = stage_admin(masters["Administrativos"])
    if "Docentes" in masters:
        out["Docentes"] = stage_staff(masters["Docentes"])
    for category, measure in K.STUDENT_MEASURES.items():
        if category in masters:
            out[category] = stage_students(masters[category], measure)
    return out
