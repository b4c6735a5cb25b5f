import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from acopio.functions import similarity as S
from acopio.functions import text as T
from acopio.functions import years as Y
from acopio.functions.fold import match_key_text, strip_accents, strip_accents_text


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_numeric_code(spark):
    got = apply(spark, T.numeric_code, ["1101", "1101.0", "05", "05.00", "0", "000", "1101.5", "A1", "-3", " 7 ", None])
    assert got == ["1101", "1101", "05", "05", None, None, None, None, None, "7", None]
    assert apply(spark, lambda c: T.numeric_code(c, allow_zero=True), ["0", "000"]) == ["0", "000"]


def test_to_int_or_zero(spark):
    got = apply(spark, T.to_int_or_zero, ["12", "12.7", "-3.9", "1e3", " 5 ", "1,000", "", "nan", "1d", "+7", None, "1e400", ".5", "5."])
    assert got == [12, 12, -3, 1000, 5, 0, 0, 0, 0, 7, 0, 0, 0, 5]


def test_null_tokens(spark):
    null = ["", "  ", "Sin información", "N/A", "n.d.", "NaN", "No aplica", "NINGUNO"]
    kept = ["0", "-", ".", "sin", "N A", "Bogotá"]
    assert apply(spark, T.nullified, null) == [None] * len(null)
    assert apply(spark, T.nullified, kept) == kept


def test_sex(spark):
    male, female = ["Hombre", "m", "Hombres", "Varón", "Male"], ["MUJER", "F", "W", "Mujeres", "femenina", "femeni", "fmale"]
    same = ["No binario", "1", "Masculino/Femenino", "Sin información", "hom", "x", "", None]
    assert apply(spark, S.map_sex, male) == ["Masculino"] * len(male)
    assert apply(spark, S.map_sex, female) == ["Femenino"] * len(female)
    assert apply(spark, S.map_sex, same) == same


def test_years(spark):
    got = apply(spark, Y.parse_year, ["2020", "2020.0", " 2020 ", "2020.5", "1899", "2101", "2.02e3", "<NA>", None])
    assert got == [2020, 2020, 2020, None, None, None, 2020, None, None]
    assert apply(spark, Y.extract_years, ["Corte 2018 - AÑO_2024 2100 x2101 2024.0", None]) == [[2018, 2100, 2024], []]


@pytest.mark.parametrize("a,b,lev,jac", [
    ("Año", "AÑO", 1.0, 1.0), ("Año", "Anio", 0.75, 0.0),
    ("Código del Municipio (IES)", "CÓDIGO DEL MUNICIPIO", 0.8333, 0.75),
    ("No. de Docentes", "N° de docentes", 0.9286, 0.5), ("AÑO", "Año de reporte", 0.2143, 0.3333),
    ("Sector IES", "Carácter IES", 0.5833, 0.3333), ("ID Sexo", "Sexo", 0.5714, 0.5), ("", "", 1.0, 1.0), ("", "x", 0.0, 0.0)])
def test_similarity(spark, a, b, lev, jac):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    r = df.select(S.levenshtein_ratio(F.col("a"), F.col("b")).alias("l"), S.jaccard_similarity(F.col("a"), F.col("b")).alias("j"),
                  S.combined_similarity(F.col("a"), F.col("b")).alias("s")).first()
    assert (round(r.l, 4), round(r.j, 4), round(r.s, 4)) == (lev, jac, max(lev, jac))


def test_headers(spark):
    assert apply(spark, T.clean_header, ['\n "Año  de\nreporte" ', "'x'"]) == ["Año de reporte", "x"]
    assert apply(spark, T.normalize_text, [" Institución  Ñ° ", "", None]) == ["INSTITUCION N", "", None]


def test_fold_covers_every_letter(spark):
    chars = [chr(c) for c in range(0x80, 0x2FFFF) if unicodedata.normalize("NFKD", chr(c)) != chr(c)
             and not 0xAC00 <= c <= 0xD7A3]
    assert apply(spark, strip_accents, chars) == [strip_accents_text(c) for c in chars]
    assert apply(spark, T.match_key, chars) == [match_key_text(c) for c in chars]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=60))
def test_match_key_is_stable(spark, values):
    values = [v.replace("\x00", "") for v in values if not any(0xD800 <= ord(c) <= 0xDFFF for c in v)]
    if not values:
        return
    once = apply(spark, T.match_key, values)
    assert apply(spark, T.match_key, once) == once
    assert all(set(k) <= set("abcdefghijklmnopqrstuvwxyz0123456789 ") for k in once)
