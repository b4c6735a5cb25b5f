"""Star schema from staging frames: dimensions, facts, references, constraints, load."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.similarity import sex_of_key
from ..functions.text import clean_value, match_key, numeric_code, to_int_or_zero
from ..operators.aggregates import distinct_first, first_non_empty, number_rows
from ..operators.counts import Counts
from ..operators.joins import attach, fk_hierarchy, fk_nullify, fk_semi, fk_text, outer_merge
from ..session import new_path, pin, stage

ORDER = "_ord"
TEXT_TABLES = {
    "AREA_CONOCIMIENTO": "area_conocimiento", "NBC": "nbc", "CINE_CAMPO_AMPLIO": "cine_campo_amplio",
    "NIVEL_FORMACION_DOCENTE": "nivel_formacion_docente", "TIEMPO_DEDICACION": "tiempo_dedicacion",
    "TIPO_CONTRATO": "tipo_contrato",
}


#: What each dimension with codes takes from a staging frame: its columns, the code first, under the names they have
#: there. A dimension with several entries reads all of them from one row.
CODED = {
    "DEPARTAMENTO": [{"codigo": "departamento_ies_codigo", "nombre": "departamento_ies_nombre"},
                     {"codigo": "departamento_programa_codigo", "nombre": "departamento_programa_nombre"}],
    "MUNICIPIO": [{"codigo": "municipio_ies_codigo", "nombre": "municipio_ies_nombre", "departamento_codigo": "departamento_ies_codigo"},
                  {"codigo": "municipio_programa_codigo", "nombre": "municipio_programa_nombre",
                   "departamento_codigo": "departamento_programa_codigo"}],
    "INSTITUCION": [{"codigo": "institucion_codigo", "nombre": "institucion_nombre", "sector": "sector_ies", "caracter": "caracter_ies",
                     "tipo": "principal_seccional", "municipio_codigo": "municipio_ies_codigo", "ies_padre_codigo": "ies_padre_codigo"}],
    "PROGRAMA": [{K.PROGRAM_KEY: "programa_codigo", "nombre": "programa_nombre", "nivel_academico": "nivel_academico",
                  "nivel_formacion": "nivel_formacion_programa", "metodologia": "metodologia", "area_conocimiento": "area_conocimiento",
                  "nbc": "nbc", "cine_campo_amplio": "cine_campo_amplio", "cine_campo_especifico": "cine_campo_especifico",
                  "cine_detallado": "cine_detallado"}],
}
CODES = {"codigo", "departamento_codigo", "municipio_codigo", "ies_padre_codigo", K.PROGRAM_KEY}


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def dimension_scan(frames: list[DataFrame], tables: list[str] | None = None, texts: list[str] | None = None) -> DataFrame:
    """(tabla, valores, _ord): what all dimensions need of all frames, from one read of each.

    A row of a frame gives one entry for every dimension with codes (``tables``, all by default) and for every text
    column (``texts``), uncleaned; equal entries collapse to their first position before they are moved. The
    dimensions are cut from this small table (``dim_institution`` and the others take it in place of the frames).
    Frame number and row order make one BIGINT that orders all rows: ``_ord`` must stay below 2**56 (year * 2**44 +
    row, or a plain row number).
    """
    parts = []
    for pos, df in enumerate(frames):
        entries = [(t, list(names.values())) for t in (CODED if tables is None else tables) for names in CODED[t]]
        entries += [(c, [c]) for c in texts or []]
        found = [F.struct(F.lit(t).alias("tabla"), F.array(*[F.col(c).cast("string") for c in columns]).alias("valores"))
                 for t, columns in entries if all(c in df.columns for c in columns)]
        if found:
            order = F.lit(pos).cast("bigint") * F.lit(1 << 56) + F.col(ORDER)
            parts.append(df.select(order.alias(ORDER), F.inline(F.array(*found))).where(F.col("valores")[0].isNotNull()))
    if not parts:
        return frames[0].select(F.lit("").alias("tabla"), F.array(F.lit("")).alias("valores"), F.col(ORDER)).limit(0)
    return _union(parts).groupBy("tabla", "valores").agg(F.min(ORDER).alias(ORDER))


def _entries(source: list[DataFrame] | DataFrame, table: str) -> DataFrame:
    scan = dimension_scan(source, [table]) if isinstance(source, list) else source
    return scan.where(F.col("tabla") == table)


def _coded(source: list[DataFrame] | DataFrame, table: str, every: bool = False) -> DataFrame:
    """First non-empty value of every column per code; codes left without a name are dropped, unless ``every`` code is
    asked for."""
    names = list(CODED[table][0])
    cells = [(numeric_code if c in CODES else clean_value)(F.col("valores")[i]).alias(c) for i, c in enumerate(names)]
    rows = _entries(source, table).select(*cells, ORDER).where(F.col(names[0]).isNotNull())
    if "ies_padre_codigo" in names:     # an institution is not its own parent
        rows = rows.withColumn("ies_padre_codigo", F.nullif("ies_padre_codigo", "codigo"))
    found = first_non_empty(rows, names[0], names[1:], ORDER)
    return found if every else found.where(F.col("nombre").isNotNull())


def _known(every: DataFrame, table: str, frames: list[DataFrame]) -> DataFrame | None:
    """The codes of a dimension for ``fk_semi``'s ``among``; None if some frame gave the scan no entries of it."""
    if any(c not in f.columns for f in frames for c in CODED[table][0].values()):
        return None
    return every.select(next(iter(CODED[table][0])))


def dim_department(source: list[DataFrame] | DataFrame) -> DataFrame:
    return _coded(source, "DEPARTAMENTO")


def dim_municipality(source: list[DataFrame] | DataFrame) -> DataFrame:
    return _coded(source, "MUNICIPIO")


def dim_institution(source: list[DataFrame] | DataFrame, every: bool = False) -> DataFrame:
    """Institutions before any reference is checked; a parent equal to the code itself is null."""
    return _coded(source, "INSTITUCION", every)


def dim_program_texts(source: list[DataFrame] | DataFrame, every: bool = False) -> DataFrame:
    """Programmes with their classification still as text."""
    return _coded(source, "PROGRAMA", every)


def text_dims(source: list[DataFrame] | DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """Several text dimensions from one pass: column -> (id, nombre).

    Distinct texts are kept in order of first appearance, case and accents ignored, and numbered per column.
    """
    scan = dimension_scan(source, [], columns) if isinstance(source, list) else source
    cells = scan.where(F.col("tabla").isin(columns)).select(F.col("tabla").alias("columna"), clean_value(F.col("valores")[0]).alias("nombre"), ORDER)
    names = pin(distinct_first(cells, "nombre", ORDER, by=["columna"]))
    numbered = pin(number_rows(names, ["columna", ORDER, "nombre"]))
    # one row per dimension
    first = F.broadcast(numbered.groupBy("columna").agg(F.min("id").alias("_first")))
    own = pin(numbered.join(first, "columna").select("columna", (F.col("id") - F.col("_first") + 1).alias("id"), "nombre"))
    return {c: own.where(F.col("columna") == c).select("id", "nombre") for c in columns}


def dim_text(source: list[DataFrame] | DataFrame, column: str) -> DataFrame:
    return text_dims(source, [column])[column]


def texts_of(scan: DataFrame, column: str) -> DataFrame:
    """The distinct texts of one column, as they stand in the frames (for ``fk_text``'s ``texts``)."""
    return scan.where(F.col("tabla") == column).select(F.col("valores")[0].alias(column))


def sex_values(source: list[DataFrame] | DataFrame) -> DataFrame:
    """Category of each distinct sex text with its first position; few rows reach the fuzzy step."""
    scan = dimension_scan(source, [], ["sexo"]) if isinstance(source, list) else source
    once = scan.where("tabla = 'sexo'").select(F.col("valores")[0].alias("sexo"), ORDER)
    keyed = once.withColumn("_key", match_key(F.col("sexo")))
    return keyed.select(clean_value(sex_of_key(F.col("sexo"), F.col("_key"))).alias("nombre"), ORDER)


def dim_sex(source: list[DataFrame] | DataFrame) -> DataFrame:
    names = distinct_first(pin(sex_values(source)), "nombre", ORDER)
    return number_rows(names, [ORDER, "nombre"]).select("id", "nombre")


def dim_child(rows: DataFrame, name: str, parent_id: str, order: str) -> DataFrame:
    """(id, nombre, parent): distinct (name, parent) pairs, rows lacking either dropped."""
    have = rows.where(F.col(name).isNotNull() & F.col(parent_id).isNotNull())
    exact = have.groupBy(F.col(name).alias("nombre"), parent_id).agg(F.min(order).alias("_first"))
    best = F.min(F.struct("_first", "nombre")).alias("_best")
    once = exact.groupBy(parent_id, F.collate("nombre", "UNICODE_CI_AI_RTRIM").alias("_ci")).agg(best)
    flat = once.select(F.col("_best.nombre").alias("nombre"), parent_id, F.col("_best._first").alias(ORDER))
    return number_rows(flat, [ORDER, "nombre", parent_id]).select("id", "nombre", parent_id)


def program_order(programs: DataFrame) -> DataFrame:
    """Programmes are read in code order; equal-length padding makes that a BIGINT when it can be."""
    return programs.withColumn(ORDER, F.coalesce(F.col(K.PROGRAM_KEY).try_cast("bigint"), F.lit((1 << 62))))


def dim_cine_specific(programs: DataFrame, broad: DataFrame) -> DataFrame:
    rows = fk_text(program_order(programs), "cine_campo_amplio", broad, "campo_amplio_id", ready=True)
    return dim_child(rows, "cine_campo_especifico", "campo_amplio_id", ORDER)


def dim_cine_detail(programs: DataFrame, broad: DataFrame, specific: DataFrame) -> DataFrame:
    rows = fk_hierarchy(program_order(programs), [
        ("cine_campo_amplio", broad, None), ("cine_campo_especifico", specific, "campo_amplio_id")],
        "campo_especifico_id", ready=True)
    out = dim_child(rows, "cine_detallado", "campo_especifico_id", ORDER)
    return out.select("id", "nombre", F.col("nombre").alias("codigo"), "campo_especifico_id")


def dim_program(programs: DataFrame, area: DataFrame, nbc: DataFrame, broad: DataFrame,
                specific: DataFrame, detail: DataFrame) -> DataFrame:
    out = fk_text(programs, "area_conocimiento", area, "area_id", ready=True)
    out = fk_text(out, "nbc", nbc, "nbc_id", ready=True)
    out = fk_hierarchy(out, [("cine_campo_amplio", broad, None),
                             ("cine_campo_especifico", specific, "campo_amplio_id"),
                             ("cine_detallado", detail, "campo_especifico_id")], "cine_detallado_id",
                       ready=True)
    return out.select(K.PROGRAM_KEY, "nombre", "nivel_academico", "nivel_formacion", "metodologia",
                      "area_id", "nbc_id", "cine_detallado_id")


# --- facts ---------------------------------------------------------------------------------------------

def fact_admin(admin: DataFrame) -> DataFrame:
    rows = admin.select(numeric_code(F.col("institucion_codigo")).alias("institucion_codigo"),
                        *[to_int_or_zero(F.col(c)).alias(c) for c in ["anio", "semestre", *K.ADMIN_MEASURES]])
    return (rows.where("institucion_codigo IS NOT NULL").groupBy("institucion_codigo", "anio", "semestre")
            .agg(*[F.sum(m).alias(m) for m in K.ADMIN_MEASURES]))


def fact_staff(staff: DataFrame) -> DataFrame:
    """Sums by seven keys; null texts are groups of their own."""
    rows = staff.select(numeric_code(F.col("institucion_codigo")).alias("institucion_codigo"),
                        *[clean_value(F.col(c)).alias(c) for c in K.STAFF_TEXTS],
                        *[to_int_or_zero(F.col(c)).alias(c) for c in ["anio", "semestre", "num_docentes"]])
    return (rows.where("institucion_codigo IS NOT NULL")
            .groupBy("institucion_codigo", *K.STAFF_TEXTS, "anio", "semestre")
            .agg(F.sum("num_docentes").alias("num_docentes")))


def student_measure(df: DataFrame, measure: str) -> DataFrame:
    codes = ["institucion_codigo", "programa_codigo", "municipio_programa_codigo"]
    rows = df.select(*[numeric_code(F.col(c)).alias(c) for c in codes], clean_value(F.col("sexo")).alias("sexo"),
                     *[to_int_or_zero(F.col(c)).alias(c) for c in ["anio", "semestre", measure]])
    return rows.where("institucion_codigo IS NOT NULL AND programa_codigo IS NOT NULL")


def fact_students(students: dict[str, DataFrame]) -> DataFrame:
    """``students``: measure -> staging frame. All four measures always appear in the result."""
    frames = [(student_measure(df, m), m) for m, df in students.items()]
    fact = outer_merge(frames, K.STUDENT_KEYS)
    zero = F.lit(0).cast("bigint")
    return fact.select(*K.STUDENT_KEYS, *[F.col(m) if m in fact.columns else zero.alias(m)
                                          for m in K.STUDENT_MEASURES.values()])


def valid_parent_links(institutions: DataFrame, counts: Counts | None = None) -> DataFrame:
    """(codigo, ies_padre_codigo) whose both ends exist and differ. ``counts`` gets the links that name a parent and
    are left out as ``omitidas``."""
    links = institutions.select("codigo", "ies_padre_codigo").where("ies_padre_codigo IS NOT NULL")
    other = F.col("ies_padre_codigo") != F.col("codigo")
    if counts is None:
        return fk_semi(links.where(other), "ies_padre_codigo", institutions, "codigo")
    known = fk_nullify(links.withColumn("_parent", F.col("ies_padre_codigo")), "_parent", institutions, "codigo")
    valid = F.col("_parent").isNotNull() & other
    return counts.watch(known, omitidas=~valid).where(valid).drop("_parent")


def with_valid_parents(institutions: DataFrame, counts: Counts | None = None) -> DataFrame:
    return fk_nullify(institutions, "ies_padre_codigo", institutions, "codigo", ready=True, counts=counts)


# --- whole star -------------------------------------------------------------------------------------------

def build_star(staged: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All 16 tables. Each frame is read once for all dimensions (``dimension_scan``) and once for its fact;
    dimensions are computed once (reliable checkpoints), facts stay lazy. The scan knows every code of the facts, so
    they only meet the codes that no dimension row has."""
    students = {K.STUDENT_MEASURES[c]: staged[c] for c in K.STUDENT_MEASURES if c in staged}
    admin, staff = staged.get("Administrativos"), staged.get("Docentes")
    frames = [f for f in (admin, staff, *students.values()) if f is not None]
    texts = [] if staff is None else ["nivel_formacion_docente", "tiempo_dedicacion", "tipo_contrato"]
    texts += ["area_conocimiento", "nbc", "cine_campo_amplio"] if students else []
    sexed = staff is not None or bool(students)
    scan = stage(dimension_scan(frames, None, texts + ["sexo"] * sexed), "dimension-scan")
    star: dict[str, DataFrame] = {}
    star["DEPARTAMENTO"] = pin(dim_department(scan))
    star["MUNICIPIO"] = pin(fk_nullify(dim_municipality(scan), "departamento_codigo",
                                       star["DEPARTAMENTO"], "codigo", ready=True))
    every = pin(dim_institution(scan, every=True))
    known = _known(every, "INSTITUCION", frames)
    inst = pin(fk_nullify(every.where("nombre IS NOT NULL"), "municipio_codigo", star["MUNICIPIO"], "codigo", ready=True))
    star["INSTITUCION"] = pin(with_valid_parents(inst))
    if sexed:
        star["SEXO"] = pin(dim_sex(scan))
    if texts:
        dims = text_dims(scan, texts)
        star.update({t: dims[c] for t, c in TEXT_TABLES.items() if c in dims})
    if students:
        every = pin(dim_program_texts(scan, every=True))
        programs = every.where("nombre IS NOT NULL")
        star["CINE_CAMPO_ESPECIFICO"] = pin(dim_cine_specific(programs, star["CINE_CAMPO_AMPLIO"]))
        star["CINE_DETALLADO"] = pin(dim_cine_detail(programs, star["CINE_CAMPO_AMPLIO"],
                                                     star["CINE_CAMPO_ESPECIFICO"]))
        star["PROGRAMA"] = pin(dim_program(programs, star["AREA_CONOCIMIENTO"], star["NBC"],
                                           star["CINE_CAMPO_AMPLIO"], star["CINE_CAMPO_ESPECIFICO"],
                                           star["CINE_DETALLADO"]))
        fact = fk_semi(fact_students(students), "institucion_codigo", star["INSTITUCION"], "codigo", ready=True, among=known)
        fact = fk_semi(fact, "programa_codigo", star["PROGRAMA"], K.PROGRAM_KEY, ready=True,
                       among=_known(every, "PROGRAMA", list(students.values())))
        fact = fk_nullify(fact, "municipio_programa_codigo", star["MUNICIPIO"], "codigo", ready=True)
        fact = fk_text(fact, "sexo", star["SEXO"], "sexo_id", ready=True)
        star["HECHO_ESTUDIANTES"] = fact.select(*[c[0] for c in K.STAR["HECHO_ESTUDIANTES"]["columns"]])
    if admin is not None:
        fact = fk_semi(fact_admin(admin), "institucion_codigo", star["INSTITUCION"], "codigo", ready=True, among=known)
        star["HECHO_ADMINISTRATIVOS"] = fact.select(*[c[0] for c in K.STAR["HECHO_ADMINISTRATIVOS"]["columns"]])
    if staff is not None:
        fact = fk_semi(fact_staff(staff), "institucion_codigo", star["INSTITUCION"], "codigo", ready=True, among=known)
        for source, table, out in (
                ("sexo", "SEXO", "sexo_id"),
                ("nivel_formacion_docente", "NIVEL_FORMACION_DOCENTE", "nivel_formacion_id"),
                ("tiempo_dedicacion", "TIEMPO_DEDICACION", "tiempo_dedicacion_id"),
                ("tipo_contrato", "TIPO_CONTRATO", "tipo_contrato_id")):
            fact = fk_text(fact, source, star[table], out, ready=True)
        star["HECHO_DOCENTES"] = fact.select(*[c[0] for c in K.STAR["HECHO_DOCENTES"]["columns"]])
    return star


def table_counts(star: dict[str, DataFrame]) -> DataFrame:
    rows = [df.agg(F.count(F.lit(1)).alias("filas")).select(F.lit(t).alias("tabla"), "filas")
            for t, df in star.items()]
    return _union(rows)


# --- loading ----------------------------------------------------------------------------------------------

def insert_ignore(existing: DataFrame, incoming: DataFrame, key: list[str], order: str,
                  collation: str = "UNICODE_CI_AI_RTRIM") -> DataFrame:
    """Rows of ``incoming`` to add: first one per key, keys equal but for case and accents included,
    and none whose key the target already has."""
    ci = [F.collate(F.col(k), collation).alias(f"_ci{i}") if dict(incoming.dtypes)[k] == "string"
          else F.col(k).alias(f"_ci{i}") for i, k in enumerate(key)]
    names = [f"_ci{i}" for i in range(len(key))]
    row = F.struct(*[F.col(c) for c in [order, *[c for c in incoming.columns if c != order]]])
    once = incoming.select(*ci, row.alias("_row")).groupBy(*names).agg(F.min("_row").alias("_row"))
    have = existing.select(*ci).distinct()
    fresh = once.join(have, names, "left_anti")
    return fresh.select(*[F.col(f"_row.{c}").alias(c) for c in incoming.columns])


def insert_if_empty(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` when the target holds no row, otherwise nothing of it."""
    return incoming if existing.isEmpty() else incoming.limit(0)


def constraint_violations(star: dict[str, DataFrame], schema: dict = K.STAR) -> DataFrame:
    """(tabla, regla, n) for every primary key, unique key, NOT NULL, length and reference."""
    out = []
    for table, df in star.items():
        spec = schema[table]
        checks = {}
        for name, kind, length, nullable in spec["columns"]:
            if not nullable:
                checks[f"not_null({name})"] = F.count_if(F.col(name).isNull())
            if length:
                checks[f"length({name})"] = F.count_if(F.char_length(name) > length)
        flat = df.agg(*[v.alias(k) for k, v in checks.items()])
        out.append(flat.unpivot([], [F.col(f"`{k}`") for k in checks], "regla", "n").withColumn("tabla", F.lit(table)))
        for kind, keys in [("primary", [spec["pk"]] if spec["pk"] else []), ("unique", spec["unique"])]:
            for cols in keys:
                key = [F.collate(F.col(c), "UNICODE_CI_AI_RTRIM").alias(c)
                       if dict(df.dtypes)[c] == "string" and kind == "unique" else F.col(c) for c in cols]
                dup = df.select(*key).groupBy(*cols).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
                out.append(dup.agg(F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("n")).select(
                    F.lit(f"{kind}({', '.join(cols)})").alias("regla"), "n", F.lit(table).alias("tabla")))
        for column, parent, parent_key in spec["fks"]:
            if parent not in star:
                continue
            keys = star[parent].select(F.col(parent_key).alias(column)).distinct()
            lost = attach(df.select(column).where(F.col(column).isNotNull()), keys, [column], "left_anti")
            out.append(lost.agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(f"foreign({column}->{parent})").alias("regla"), "n", F.lit(table).alias("tabla")))
    return _union([d.select("tabla", "regla", F.col("n").cast("bigint").alias("n")) for d in out])


def write_star(star: dict[str, DataFrame], root: str, recreate: bool = True) -> str:
    """All-or-nothing load: every table goes to a fresh version folder, the pointer moves last.

    A failed load leaves the pointer, and so every reader, on the previous version. With
    ``recreate=False`` facts are only written when the current version has none.
    """
    spark = next(iter(star.values())).sparkSession
    version = new_path(spark, "v").rsplit("/", 1)[1]
    old = current_star(spark, root)
    for table, df in star.items():
        if not recreate and old and table in old and table.startswith("HECHO_") and not old[table].isEmpty():
            df = old[table]
        elif table.startswith("HECHO_"):
            df = df.select(F.monotonically_increasing_id().alias("id"), *df.columns,
                           F.current_timestamp().alias("created_at"))
        df.write.parquet(f"{root}/{version}/{table}")
    # the pointer is a log: appending one row publishes the version, nothing is ever replaced
    (spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("loaded_at"))
     .write.mode("append").parquet(f"{root}/versions"))
    return version


def current_star(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of the last published version, empty when there is none."""
    try:
        log = spark.read.schema("version string, loaded_at timestamp").parquet(f"{root}/versions")
        version = log.agg(F.max_by("version", "loaded_at").alias("v")).first()["v"]
    except AnalysisException:  # nothing published yet
        return {}
    out = {}
    for table in K.STAR:
        try:
            out[table] = spark.read.parquet(f"{root}/{version}/{table}")
        except AnalysisException:  # table not part of that load
            continue
    return out


def write_jdbc(star: dict[str, DataFrame], url: str, properties: dict[str, str], batch: int = 10_000,
               partitions: int = 16) -> None:
    """Optional copy to a relational database; URL and driver come from the caller."""
    for table in [t for t in K.STAR if t in star]:
        # computed with all tasks first; only the connections are few
        (stage(star[table], "jdbc").repartition(partitions).write.mode("append").option("batchsize", batch)
         .jdbc(url, table, properties=properties))
