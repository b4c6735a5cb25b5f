from pyspark.sql import functions as F

from acopio import constants as K
from acopio.plans import ingest, runs, star
from acopio.session import new_path
from acopio.sources.files import raw_grid
from acopio.streaming import incremental


def test_files_to_star(spark, tmp_path):
    """Two yearly staff files (one delivered twice) become a master and a star."""
    head = ",".join(f'"{h}"' for h in K.CANONICAL_HEADERS["Docentes"])

    def row(code, name, sex, year, n):
        return f'{code},,{name},Principal,Oficial,Universidad,05,Antioquia,05001,Medellín,{sex},Maestría,Completo,Fijo,{year},1,{n}'
    folder = tmp_path / "Docentes"
    folder.mkdir()
    blank = "," * 16
    (folder / "a_2020.csv").write_text("\n".join([f"Informe{blank}", head, row("1101", "Alfa", "Hombre", 2020, 5), f"Fuente: entidad{blank}"]), "utf-8")
    (folder / "b_2020.csv").write_text("\n".join([head, row("1101.0", "Alfa", "Hombre", 2020, 7), row("1102", "Béta", "F", 2020, 2)]), "latin-1")
    (folder / "c_2021.csv").write_text("\n".join([head, row("1101", "Alfa", "Mujer", 2021, 3), f"Nota: x{blank}"]), "utf-8")
    grid = raw_grid(spark, [str(folder)])
    root, star_root = new_path(spark, "run"), new_path(spark, "star")
    out = runs.run(spark, {"Docentes": grid}, root, star_root, sheets=False)
    assert [(r.categoria, r.ok, r.etapa, r.detalle) for r in out.collect()] == [("Docentes", True, "completado", "")]
    tables = star.current_star(spark, star_root)
    assert {r.nombre for r in tables["INSTITUCION"].collect()} == {"ALFA", "BETA"}
    fact = tables["HECHO_DOCENTES"].join(tables["SEXO"].select(F.col("id").alias("sexo_id"), "nombre"), "sexo_id", "left")
    assert sorted((r.institucion_codigo, r.anio, r.nombre, r.num_docentes) for r in fact.collect()) == [
        ("1101", 2020, "Masculino", 7), ("1101", 2021, "Femenino", 3), ("1102", 2020, "Femenino", 2)]
    again = runs.run(spark, {"Docentes": None}, root, star_root)
    assert again.first().ok and star.current_star(spark, star_root)["HECHO_DOCENTES"].count() == 3


HEAD = K.CANONICAL_HEADERS["Docentes"]


def staff(code, year, n, sex="Hombre"):
    return f"{code},,Alfa,Principal,Oficial,Universidad,05,Antioquia,05001,Medellín,{sex},Maestría,Completo,Fijo,{year},1,{n}"


def test_a_bad_file_keeps_the_good_ones(spark, tmp_path):
    folder = tmp_path / "Docentes"
    folder.mkdir()
    head = ",".join(f'"{h}"' for h in HEAD)
    (folder / "a_2020.csv").write_text("\n".join([head, staff("1101", 2020, 5)]), "utf-8")
    (folder / "b.csv").write_text(head + "\n", "utf-8")     # a header and no rows
    (folder / "c_2021.csv").write_text("\n".join([head, staff("1101", 2021, 7)]), "utf-8")
    root = new_path(spark, "run")
    out = runs.run(spark, {"Docentes": raw_grid(spark, [str(folder)])}, root, new_path(spark, "star"), sheets=False).collect()
    assert [(r.ok, r.etapa) for r in out] == [(False, "integracion_csv_maestro")] and "b.csv: sin datos" in out[0].detalle
    assert {r.anio for r in ingest.read_master(spark, root, "Docentes").collect()} == {2020, 2021}


def test_an_empty_column_takes_no_canonical_place(spark):
    grid = spark.createDataFrame([("f", "0", 0, ["Código", "Sexo del Docente", "Sexo", "Año"]), ("f", "0", 1, ["1", "", "Hombre", "2020"]),
                                  ("f", "0", 2, ["2", "", "Mujer", "2020"])], "_path string, _sheet string, _ord bigint, cells array<string>")
    rows = ingest.ingest_grid(grid, "Docentes", canonical=["Código", "Sexo del docente", "Año"], sheets=False).rows.collect()
    assert sorted(r["Sexo del docente"] for r in rows) == ["Hombre", "Mujer"]


def test_masters_shrink(spark):
    df = spark.createDataFrame([("Docentes", y, i, "Alfa", code) for i, (y, code) in enumerate(
        [(2020, "1"), (2020, "2"), (2021, "3"), (2022, "4")])], "tipo string, anio int, _ord bigint, nombre string, codigo string")
    root = new_path(spark, "shrink")
    ingest.upsert_by_year(df, root)
    ingest.rewrite_master(ingest.read_master(spark, root, "Docentes").where("anio <> 2021"), root, "Docentes")
    assert sorted(r.anio for r in ingest.read_master(spark, root).collect()) == [2020, 2020, 2022]
    assert ingest.delete_stored(spark, root, "Docentes", 2020) == 1 and ingest.delete_stored(spark, root, "Docentes", 1999) == 0
    assert [r.anio for r in ingest.read_master(spark, root).collect()] == [2022]
    assert ingest.delete_stored(spark, root, "Docentes") == 1 and ingest.stored_years(spark, root) is None


def test_a_delivery_of_several_part_files_is_kept_whole(spark):
    root, path, ledger = new_path(spark, "upsert"), new_path(spark, "in"), new_path(spark, "ledger")
    sink = incremental.upsert_sink(root, F.lit("t"), F.lit(2020))
    for n, rows in enumerate((10, 100, 60)):
        spark.range(rows).repartition(4).write.parquet(f"{path}/entrega-{n}")
        if n:    # the first two arrive together: the later one wins
            incremental.run_available(incremental.file_stream(spark, f"{path}/*", spark.range(1).schema), sink, ledger)
            assert ingest.read_master(spark, root).count() == rows
