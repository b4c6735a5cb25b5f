"""Results depend on these exact texts, so they are listed as they are."""

# --- categories and their canonical headers (fixed values) ------------------------------------

CATEGORIES = (
    "Estudiantes admitidos",
    "Estudiantes inscritos",
    "Estudiantes matriculados",
    "Estudiantes matriculados en primer curso",
    "Estudiantes graduados",
    "Docentes",
    "Administrativos",
)

CANONICAL_HEADERS = {
    "Administrativos": [
        "Código de la Institución", "IES PADRE", "Institución de Educación Superior (IES)",
        "Principal o Seccional", "Sector IES", "Carácter IES",
        "Código del departamento (IES)", "Departamento de domicilio de la IES",
        "Código del Municipio (IES)", "Municipio de domicilio de la IES",
        "Año", "Semestre", "Auxiliar", "Técnico", "Profesional", "Directivo", "Total",
    ],
    "Estudiantes admitidos": [
        "CÓDIGO DE LA INSTITUCIÓN", "IES_PADRE", "INSTITUCIÓN DE EDUCACIÓN SUPERIOR (IES)",
        "PRINCIPAL O SECCIONAL", "SECTOR IES", "CARACTER IES",
        "CÓDIGO DEL DEPARTAMENTO (IES)", "DEPARTAMENTO DE DOMICILIO DE LA IES",
        "CÓDIGO DEL MUNICIPIO IES", "MUNICIPIO DE DOMICILIO DE LA IES",
        "CÓDIGO SNIES DEL PROGRAMA", "PROGRAMA ACADÉMICO", "NIVEL ACADÉMICO", "NIVEL DE FORMACIÓN",
        "METODOLOGÍA", "ÁREA DE CONOCIMIENTO", "NÚCLEO BÁSICO DEL CONOCIMIENTO (NBC)",
        "DESC CINE CAMPO AMPLIO", "DESC CINE CAMPO ESPECIFICO", "DESC CINE CODIGO DETALLADO",
        "CÓDIGO DEL DEPARTAMENTO (PROGRAMA)", "DEPARTAMENTO DE OFERTA DEL PROGRAMA",
        "CÓDIGO DEL MUNICIPIO (PROGRAMA)", "MUNICIPIO DE OFERTA DEL PROGRAMA",
        "SEXO", "AÑO", "SEMESTRE", "ADMITIDOS",
    ],
    "Estudiantes graduados": [
        "CÓDIGO DE LA INSTITUCIÓN", "IES_PADRE", "INSTITUCIÓN DE EDUCACIÓN SUPERIOR (IES)",
        "PRINCIPAL O SECCIONAL", "SECTOR IES", "CARACTER IES",
        "CÓDIGO DEL DEPARTAMENTO (IES)", "DEPARTAMENTO DE DOMICILIO DE LA IES",
        "CÓDIGO DEL MUNICIPIO", "MUNICIPIO DE DOMICILIO DE LA IES",
        "CÓDIGO SNIES DEL PROGRAMA", "PROGRAMA ACADÉMICO", "NIVEL ACADÉMICO", "NIVEL DE FORMACIÓN",
        "METODOLOGÍA", "ÁREA DE CONOCIMIENTO", "NÚCLEO BÁSICO DEL CONOCIMIENTO (NBC)",
        "DESC CINE CAMPO AMPLIO", "DESC CINE CAMPO ESPECIFICO", "DESC CINE CODIGO DETALLADO",
        "CÓDIGO DEL DEPARTAMENTO (PROGRAMA)", "DEPARTAMENTO DE OFERTA DEL PROGRAMA",
        "CÓDIGO DEL MUNICIPIO (PROGRAMA)", "MUNICIPIO DE OFERTA DEL PROGRAMA",
        "SEXO", "AÑO", "SEMESTRE", "GRADUADOS",
    ],
    "Estudiantes inscritos": [
        "CÓDIGO DE LA INSTITUCIÓN", "IES_PADRE", "INSTITUCIÓN DE EDUCACIÓN SUPERIOR (IES)",
        "PRINCIPAL O SECCIONAL", "SECTOR IES", "CARACTER IES",
        "CÓDIGO DEL DEPARTAMENTO (IES)", "DEPARTAMENTO DE DOMICILIO DE LA IES",
        "CÓDIGO DEL MUNICIPIO (IES)", "MUNICIPIO DE DOMICILIO DE LA IES",
        "CÓDIGO SNIES DEL PROGRAMA", "PROGRAMA ACADÉMICO", "NIVEL ACADÉMICO", "NIVEL DE FORMACIÓN",
        "METODOLOGÍA", "ÁREA DE CONOCIMIENTO", "NÚCLEO BÁSICO DEL CONOCIMIENTO (NBC)",
        "DESC CINE CAMPO AMPLIO", "DESC CINE CAMPO ESPECIFICO", "DESC CINE CODIGO DETALLADO",
        "CÓDIGO DEL DEPARTAMENTO (PROGRAMA)", "DEPARTAMENTO DE OFERTA DEL PROGRAMA",
        "CÓDIGO DEL MUNICIPIO (PROGRAMA)", "MUNICIPIO DE OFERTA DEL PROGRAMA",
        "SEXO", "AÑO", "SEMESTRE", "INSCRITOS",
    ],
    "Estudiantes matriculados": [
        "Código de la Institución", "IES PADRE", "Institución de Educación Superior (IES)",
        "Principal o Seccional", "Sector IES", "Caracter IES",
        "Código del departamento (IES)", "Departamento de domicilio de la IES",
        "Código del Municipio (IES)", "Municipio de domicilio de la IES",
        "Código SNIES del programa", "Programa Académico", "Nivel Académico", "Nivel de Formación",
        "Metodología", "Área de Conocimiento", "Núcleo Básico del Conocimiento (NBC)",
        "Código del Departamento (Programa)", "Departamento de oferta del programa",
        "Código del Municipio (Programa)", "Municipio de oferta del programa",
        "Sexo", "Año", "Semestre", "Matriculados",
    ],
    "Estudiantes matriculados en primer curso": [
        "CÓDIGO DE LA INSTITUCIÓN", "IES_PADRE", "INSTITUCIÓN DE EDUCACIÓN SUPERIOR (IES)",
        "PRINCIPAL O SECCIONAL", "SECTOR IES", "CARACTER IES",
        "CÓDIGO DEL DEPARTAMENTO (IES)", "DEPARTAMENTO DE DOMICILIO DE LA IES",
        "CÓDIGO DEL MUNICIPIO (IES)", "MUNICIPIO DE DOMICILIO DE LA IES",
        "CÓDIGO SNIES DEL PROGRAMA", "PROGRAMA ACADÉMICO", "NIVEL ACADÉMICO", "NIVEL DE FORMACIÓN",
        "METODOLOGÍA", "ÁREA DE CONOCIMIENTO", "NÚCLEO BÁSICO DEL CONOCIMIENTO (NBC)",
        "DESC CINE CAMPO AMPLIO", "DESC CINE CAMPO ESPECIFICO", "DESC CINE CODIGO DETALLADO",
        "CÓDIGO DEL DEPARTAMENTO (PROGRAMA)", "DEPARTAMENTO DE OFERTA DEL PROGRAMA",
        "CÓDIGO DEL MUNICIPIO (PROGRAMA)", "MUNICIPIO DE OFERTA DEL PROGRAMA",
        "SEXO", "AÑO", "SEMESTRE", "PRIMER CURSO",
    ],
    "Docentes": [
        "Código de la Institución", "IES PADRE", "Institución de Educación Superior (IES)",
        "Principal o Seccional", "Sector IES", "Caracter IES",
        "Código del departamento (IES)", "Departamento de domicilio de la IES",
        "Código del Municipio (IES)", "Municipio de domicilio de la IES",
        "Sexo del Docente", "Máximo nivel de formación del docente",
        "Tiempo de dedicación del Docente", "Tipo de contrato del Docente",
        "Año", "Semestre", "No. de Docentes",
    ],
}

# Import folder -> category (fixed values); two folder spellings share a category.
FOLDER_CATEGORY = {
    "Estudiantes_admitidos": "Estudiantes admitidos",
    "Estudiantes_inscritos": "Estudiantes inscritos",
    "Estudiantes_matriculados": "Estudiantes matriculados",
    "Estudiantes_matriculados_en_primer_curso": "Estudiantes matriculados en primer curso",
    "Estudiantes_matriculados_primer_curso": "Estudiantes matriculados en primer curso",
    "Estudiantes_graduados": "Estudiantes graduados",
    "Docentes": "Docentes",
    "Administrativos": "Administrativos",
}

FILE_EXTENSIONS = (".xlsx", ".xls", ".csv")

# Student category -> measure in the star (fixed values).
STUDENT_MEASURES = {
    "Estudiantes admitidos": "admitidos",
    "Estudiantes inscritos": "inscritos",
    "Estudiantes matriculados": "matriculados",
    "Estudiantes graduados": "graduados",
}

# --- header spellings -> staging names (fixed values) -----------------------------------------

STAGING_ALIASES = {
    "institucion_codigo": ["Código de la Institución"],
    "ies_padre_codigo": ["IES PADRE", "IES_PADRE"],
    "institucion_nombre": ["Institución de Educación Superior (IES)"],
    "principal_seccional": ["Principal o Seccional"],
    "sector_ies": ["Sector IES"],
    "caracter_ies": ["Carácter IES"],
    "departamento_ies_codigo": ["Código del departamento (IES)"],
    "departamento_ies_nombre": ["Departamento de domicilio de la IES"],
    "municipio_ies_codigo": ["Código del Municipio (IES)"],
    "municipio_ies_nombre": ["Municipio de domicilio de la IES"],
    "anio": ["Año"],
    "semestre": ["Semestre"],
    "auxiliar": ["Auxiliar"],
    "tecnico": ["Técnico"],
    "profesional": ["Profesional"],
    "directivo": ["Directivo"],
    "total": ["Total"],
    "programa_codigo": ["Código SNIES del programa"],
    "programa_nombre": ["Programa Académico"],
    "nivel_academico": ["Nivel Académico"],
    "nivel_formacion_programa": ["Nivel de Formación"],
    "metodologia": ["Metodología"],
    "area_conocimiento": ["Área de Conocimiento"],
    "nbc": ["Núcleo Básico del Conocimiento (NBC)"],
    "cine_campo_amplio": ["DESC CINE CAMPO AMPLIO"],
    "cine_campo_especifico": ["DESC CINE CAMPO ESPECIFICO"],
    "cine_detallado": ["DESC CINE CODIGO DETALLADO"],
    "departamento_programa_codigo": ["Código del Departamento (Programa)"],
    "departamento_programa_nombre": ["Departamento de oferta del programa"],
    "municipio_programa_codigo": ["Código del Municipio (Programa)"],
    "municipio_programa_nombre": ["Municipio de oferta del programa"],
    "sexo": ["Sexo", "Sexo del Docente"],
    "nivel_formacion_docente": ["Máximo nivel de formación del docente"],
    "tiempo_dedicacion": ["Tiempo de dedicación del Docente"],
    "tipo_contrato": ["Tipo de contrato del Docente"],
    "num_docentes": [
        "No. de Docentes", "Nro. de docentes", "N° de Docentes", "Nro. docentes", "DOCENTES", "DOCENTE",
    ],
    "admitidos": ["ADMITIDOS"],
    "inscritos": ["INSCRITOS"],
    "matriculados": ["Matriculados", "Matriculados 2017"],
    "graduados": ["GRADUADOS"],
}

IES_COLUMNS = [
    "institucion_codigo", "ies_padre_codigo", "institucion_nombre", "principal_seccional",
    "sector_ies", "caracter_ies", "departamento_ies_codigo", "departamento_ies_nombre",
    "municipio_ies_codigo", "municipio_ies_nombre",
]

ADMIN_MEASURES = ["auxiliar", "tecnico", "profesional", "directivo", "total"]
STAFF_TEXTS = ["sexo", "nivel_formacion_docente", "tiempo_dedicacion", "tipo_contrato"]
PROGRAM_COLUMNS = [
    "programa_codigo", "programa_nombre", "nivel_academico", "nivel_formacion_programa",
    "metodologia", "area_conocimiento", "nbc", "cine_campo_amplio", "cine_campo_especifico",
    "cine_detallado",
]
OFFER_COLUMNS = [
    "departamento_programa_codigo", "departamento_programa_nombre",
    "municipio_programa_codigo", "municipio_programa_nombre",
]
STUDENT_KEYS = [
    "institucion_codigo", "programa_codigo", "municipio_programa_codigo", "sexo", "anio", "semestre",
]
PROGRAM_KEY = "codigo_snies"

# --- cleaning vocabularies (fixed values) -----------------------------------------------------

NUMERIC_HEADERS = [
    "Total", "Auxiliar", "Técnico", "Profesional", "Directivo", "ADMITIDOS", "GRADUADOS",
    "INSCRITOS", "Matriculados", "No. de Docentes", "No de Docentes", "Nro. de docentes",
    "Nro de Docentes", "N° de Docentes", "N° de docentes", "Nro. De DOCENTES", "PRIMER CURSO",
]

# Match keys that mean "no information".
NULL_TOKENS = [
    "sin informacion", "sin info", "sinformacion", "sin informacion disponible", "no disponible",
    "nd", "na", "no aplica", "no data", "no registra", "no registrado", "sin dato", "sin datos",
    "sin registro", "desconocido", "desconocida", "ninguno", "ninguna", "null", "none", "nan",
    "no hay informacion", "no hay datos",
]

FOOTER_HINTS = [
    "fuente", "nota", "elaborado por", "elaboracion", "ministerio", "fecha de corte", "corte a",
    "pagina", "metodologia", "observacion", "www", "http", "total general",
]

# Match keys of the category patterns.
MALE_PATTERNS = [
    "masculino", "hombre", "male", "varon", "masc", "m", "h", "masculino hombre", "hombre masculino",
]
FEMALE_PATTERNS = [
    "femenino", "mujer", "female", "fem", "f", "w", "muj", "femenino mujer", "mujer femenino",
]
SEX_THRESHOLD = 0.7
MALE, FEMALE = "Masculino", "Femenino"

SEX_COLUMN_WORDS = ["sexo", "genero"]
NAME_COLUMN_WORDS = [
    "institucion", "ies", "municipio", "departamento", "programa", "metodologia", "area", "nucleo",
]
VARIANT_THRESHOLD = 0.85
VARIANT_TOP = 200

# --- header matching (fixed values) -----------------------------------------------------------

MATCH_THRESHOLD = 0.6
SEX_HEADER_WORDS = ["sexo", "genero", "sex", "gender"]
# Match keys of headers that name the same field.
HEADER_ALIAS_GROUPS = [
    ["principal o seccional", "tipo ies", "tipo de ies"],
    ["admitidos", "admisiones", "admision"],
    ["inscritos", "inscripciones", "inscripcion", "inscrito"],
    ["matriculados", "matriculados 2017"],
    ["no de docentes", "nro de docentes", "docentes", "docente"],
]
# Pairs of stems that name the same field whatever follows them.
HEADER_STEM_PAIRS = [("admitid", "admision"), ("inscrit", "inscrip"), ("matriculad", "matriculad")]
SCORE_EXACT, SCORE_SEX, SCORE_ALIAS, ID_PENALTY = 1.0, 0.98, 0.97, 0.8

# --- years (fixed values) ---------------------------------------------------------------------

YEAR_MIN, YEAR_MAX = 1900, 2100
YEAR_KEY = "ano"
YEAR_COLUMN_THRESHOLD = 0.7
YEAR_TEXT_BYTES = 12000
HEADER_ROWS, SHEET_ROWS, SHEET_YEAR_ROWS, YEAR_ROWS, SCAN_ROWS = 20, 30, 120, 40, 10
PREVIEW_ROWS = 300

# --- segmentation (fixed values) --------------------------------------------------------------

FEATURES = [
    "Total_Matriculados", "Total_Graduados", "Total_Inscritos", "Total_Admitidos", "Total_Docentes",
    "Tasa_Graduacion", "Tasa_Admision", "Tasa_Absorcion", "Ratio_Docentes_Matriculados",
]
K_FINAL, K_SWEEP, KMEANS_SEED, KMEANS_INITS = 3, range(2, 11), 42, 10

# --- star schema (fixed values) ---------------------------------------------------------------
# table -> columns as (name, type, char length or None, nullable), primary key, unique keys, and
# foreign keys as (column, parent table, parent column).

STAR = {
    "DEPARTAMENTO": dict(
        columns=[("codigo", "string", 5, False), ("nombre", "string", 255, False)],
        pk=["codigo"], unique=[], fks=[]),
    "MUNICIPIO": dict(
        columns=[("codigo", "string", 5, False), ("nombre", "string", 255, False),
                 ("departamento_codigo", "string", 5, True)],
        pk=["codigo"], unique=[], fks=[("departamento_codigo", "DEPARTAMENTO", "codigo")]),
    "INSTITUCION": dict(
        columns=[("codigo", "string", 10, False), ("nombre", "string", 255, False),
                 ("sector", "string", 255, True), ("caracter", "string", 255, True),
                 ("tipo", "string", 255, True), ("municipio_codigo", "string", 5, True),
                 ("ies_padre_codigo", "string", 10, True)],
        pk=["codigo"], unique=[],
        fks=[("municipio_codigo", "MUNICIPIO", "codigo"), ("ies_padre_codigo", "INSTITUCION", "codigo")]),
    "AREA_CONOCIMIENTO": dict(
        columns=[("id", "bigint", None, False), ("nombre", "string", 255, False)],
        pk=["id"], unique=[["nombre"]], fks=[]),
    "NBC": dict(
        columns=[("id", "bigint", None, False), ("nombre", "string", 255, False)],
        pk=["id"], unique=[["nombre"]], fks=[]),
    "CINE_CAMPO_AMPLIO": dict(
        columns=[("id", "bigint", None, False), ("nombre", "string", 255, False)],
        pk=["id"], unique=[["nombre"]], fks=[]),
    "CINE_CAMPO_ESPECIFICO": dict(
        columns=[("id", "bigint", None, False), ("nombre", "string", 255, False),
                 ("campo_amplio_id", "bigint", None, False)],
        pk=["id"], unique=[["nombre", "campo_amplio_id"]],
        fks=[("campo_amplio_id", "CINE_CAMPO_AMPLIO", "id")]),
    "CINE_DETALLADO": dict(
        columns=[("id", "bigint", None, False), ("nombre", "string", 255, False),
                 ("codigo", "string", 255, False), ("campo_especifico_id", "bigint", None, False)],
        pk=["id"], unique=[["codigo", "campo_especifico_id"]],
        fks=[("campo_especifico_id", "CINE_CAMPO_ESPECIFICO", "id")]),
    "SEXO": dict(
        columns=[("id", "bigint", None, False), ("nombre", "string", 50, False)],
        pk=["id"], unique=[["nombre"]], fks=[]),
    "NIVEL_FORMACION_DOCENTE": dict(
        columns=[("id", "bigint", None, False), ("nombre", "string", 255, False)],
        pk=["id"], unique=[["nombre"]], fks=[]),
    "TIEMPO_DEDICACION": dict(
        columns=[("id", "bigint", None, False), ("nombre", "string", 255, False)],
        pk=["id"], unique=[["nombre"]], fks=[]),
    "TIPO_CONTRATO": dict(
        columns=[("id", "bigint", None, False), ("nombre", "string", 255, False)],
        pk=["id"], unique=[["nombre"]], fks=[]),
    "PROGRAMA": dict(
        columns=[(PROGRAM_KEY, "string", 15, False), ("nombre", "string", 255, False),
                 ("nivel_academico", "string", 255, True), ("nivel_formacion", "string", 255, True),
                 ("metodologia", "string", 255, True), ("area_id", "bigint", None, True),
                 ("nbc_id", "bigint", None, True), ("cine_detallado_id", "bigint", None, True)],
        pk=[PROGRAM_KEY], unique=[],
        fks=[("area_id", "AREA_CONOCIMIENTO", "id"), ("nbc_id", "NBC", "id"),
             ("cine_detallado_id", "CINE_DETALLADO", "id")]),
    "HECHO_ADMINISTRATIVOS": dict(
        columns=[("institucion_codigo", "string", 10, False), ("anio", "bigint", None, False),
                 ("semestre", "bigint", None, False), ("auxiliar", "bigint", None, False),
                 ("tecnico", "bigint", None, False), ("profesional", "bigint", None, False),
                 ("directivo", "bigint", None, False), ("total", "bigint", None, False)],
        pk=[], unique=[], fks=[("institucion_codigo", "INSTITUCION", "codigo")]),
    "HECHO_DOCENTES": dict(
        columns=[("institucion_codigo", "string", 10, False), ("sexo_id", "bigint", None, True),
                 ("nivel_formacion_id", "bigint", None, True),
                 ("tiempo_dedicacion_id", "bigint", None, True),
                 ("tipo_contrato_id", "bigint", None, True), ("anio", "bigint", None, False),
                 ("semestre", "bigint", None, False), ("num_docentes", "bigint", None, False)],
        pk=[], unique=[],
        fks=[("institucion_codigo", "INSTITUCION", "codigo"), ("sexo_id", "SEXO", "id"),
             ("nivel_formacion_id", "NIVEL_FORMACION_DOCENTE", "id"),
             ("tiempo_dedicacion_id", "TIEMPO_DEDICACION", "id"),
             ("tipo_contrato_id", "TIPO_CONTRATO", "id")]),
    "HECHO_ESTUDIANTES": dict(
        columns=[("institucion_codigo", "string", 10, False), ("programa_codigo", "string", 15, False),
                 ("municipio_programa_codigo", "string", 5, True), ("sexo_id", "bigint", None, True),
                 ("anio", "bigint", None, False), ("semestre", "bigint", None, False),
                 ("admitidos", "bigint", None, False), ("inscritos", "bigint", None, False),
                 ("matriculados", "bigint", None, False), ("graduados", "bigint", None, False)],
        pk=[], unique=[],
        fks=[("institucion_codigo", "INSTITUCION", "codigo"), ("programa_codigo", "PROGRAMA", PROGRAM_KEY),
             ("municipio_programa_codigo", "MUNICIPIO", "codigo"), ("sexo_id", "SEXO", "id")]),
}
