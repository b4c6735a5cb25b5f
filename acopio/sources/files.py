"""Files: listing by category folder, delimited text as raw grids, masters as text tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.text import sanitize_name
from ..operators.joins import attach, left_minus
from ..session import pin, stage

MOST_COLUMNS = 1 << 20  # the parser reports an error beyond, it never cuts


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)$", 1)


def folder_category(path: Column) -> Column:
    """Category of the folder a file lies in, null for other folders."""
    folder = F.regexp_extract(path, "([^/]+)/[^/]+$", 1)
    out = F.lit(None).cast("string")
    for name, category in K.FOLDER_CATEGORY.items():
        out = F.when(folder == name, F.lit(category)).otherwise(out)
    return out


def with_category(paths: DataFrame, path: str = "path", extensions=K.FILE_EXTENSIONS) -> DataFrame:
    """(tipo, carpeta, archivo, path) of files in category folders with a supported extension."""
    c = F.col(path)
    rows = paths.where(extension(c).isin(*extensions)).select(
        folder_category(c).alias("tipo"), F.regexp_extract(c, "([^/]+)/[^/]+$", 1).alias("carpeta"),
        file_name(c).alias("archivo"), c.alias("path"))
    return rows.where("tipo IS NOT NULL")


def list_category_files(spark: SparkSession, root: str, extensions=K.FILE_EXTENSIONS) -> DataFrame:
    """Listing of the import folders; only names are read, never contents."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "length", "modificationTime"))
    return with_category(found, extensions=extensions)


def files_per_category(files: DataFrame, integrated: DataFrame | None = None) -> DataFrame:
    """Files per category, and how many of them were integrated when that is known."""
    if integrated is None:
        return files.groupBy("tipo").agg(F.count(F.lit(1)).alias("archivos"))
    done = files.join(integrated.select("path").distinct().withColumn("_ok", F.lit(True)), "path", "left")
    return done.groupBy("tipo").agg(
        F.count(F.lit(1)).alias("archivos"), F.count_if(F.col("_ok")).alias("integrados"),
        F.count_if(F.col("_ok").isNull()).alias("fallidos"))


def new_files(files: DataFrame, ledger: DataFrame, key: str = "path") -> DataFrame:
    """Files not in the ledger of processed ones."""
    return left_minus(files, ledger, [key])


def safe_name(name: Column) -> Column:
    return sanitize_name(name)


# --- delimited text ---------------------------------------------------------------------------------

def _separators(text: Column, sep: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sep), F.lit("")))


def _at() -> Column:
    """Place of a line, growing along its file: a line takes at least one byte and only the last split of a file shares
    a task with other files, so byte offset of the split + row number in the task."""
    return F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def _lines(spark: SparkSession, paths: list[str], ends: str | None = None) -> DataFrame:
    """(_path, _block, _at, value) of every line; ``ends`` is the only line end if it is given."""
    reader = spark.read if ends is None else spark.read.option("lineSep", ends)
    return reader.text(paths).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
                                     _at().alias("_at"), "value")


def profile_files(spark: SparkSession, paths: list[str], sep: str = ",") -> DataFrame:
    """(_path, latin, multiline, width), a row per file from one splittable scan: does UTF-8 fail, do records span
    lines, and how wide is a line at most.

    A quoted line break leaves an odd number of quotes on a line; a line of invalid UTF-8 sends its file to ISO-8859-1.
    """
    line = F.col("value")
    return _lines(spark, paths).groupBy("_path").agg(
        F.max(~F.is_valid_utf8(line)).alias("latin"),
        F.max(_separators(line, '"') % 2 == 1).alias("multiline"),
        (F.max(_separators(line, sep)) + 1).cast("int").alias("width"))


def _decoded(latin: Column) -> Column:
    return F.when(latin, F.decode(F.col("value").cast("binary"), "ISO-8859-1")).otherwise(F.col("value"))


def _spanning(lines: DataFrame, sep: str) -> DataFrame:
    """(_path, _at, text, width) of records that span lines. ``lines`` has (_path, _block, _at, value).

    A line begins a record if the quotes before it in its file are even. They are counted inside splits, and the splits
    of a file, a row each, are added up: no task holds more than a split or one record.
    """
    quotes = _separators(F.col("value"), '"')
    blocks = lines.groupBy("_path", "_block").agg(F.sum(quotes).alias("_q"))
    ahead = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pin(blocks.select("_path", "_block", F.coalesce(F.sum("_q").over(ahead), F.lit(0)).alias("_ahead")))
    inside = Window.partitionBy("_path", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    begun = lines.withColumn("_q", F.coalesce(F.sum(quotes).over(inside), F.lit(0)))
    begun = attach(begun, blocks, ["_path", "_block"], "inner", ready=True).withColumn("_begins", (F.col("_q") + F.col("_ahead")) % 2 == 0)
    # a line belongs to the last record that has begun; one that reaches over splits begins in the last split with a beginning
    upto = Window.partitionBy("_path", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    own = stage(begun.select("_path", "_block", "_at", "value", F.last(F.when(F.col("_begins"), F.col("_at")), True).over(upto).alias("_record")), "spanning")
    last = own.groupBy("_path", "_block").agg(F.max("_record").alias("_last"))
    last = pin(last.select("_path", "_block", F.last("_last", True).over(ahead).alias("_open")))
    whole = attach(own, last, ["_path", "_block"], "inner", ready=True).select("_path", F.coalesce("_record", "_open").alias("_record"), "_at", "value")
    records = whole.groupBy("_path", "_record").agg(F.array_sort(F.collect_list(F.struct("_at", "value"))).alias("_l"))
    text = F.regexp_replace(F.array_join(F.transform("_l", lambda x: x["value"]), "\n"), "\r$", "")
    return records.select("_path", F.col("_record").alias("_at"), text.alias("text")).withColumn("width", _separators(F.col("text"), sep) + 1)


def _filled() -> Column:
    return F.col("text").rlike("[^\\x00-\\x20]")


def _cells(records: DataFrame, sep: str, width: int) -> DataFrame:
    """(_path, _at, cells, text) of records (_path, _at, text, width); blank ones are no records. A missing cell is empty."""
    names = [f"c{i}" for i in range(width)]
    options = {"sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
               "multiLine": "true", "maxColumns": str(MOST_COLUMNS), "maxCharsPerColumn": "-1", "mode": "PERMISSIVE"}
    parsed = records.where(_filled()).select(
        "_path", "_at", "width", "text", F.from_csv("text", ", ".join(f"{c} string" for c in names), options).alias("_r"))
    cells = F.array(*[F.coalesce(F.col(f"_r.{c}"), F.lit("")) for c in names])
    return parsed.select("_path", "_at", F.slice(cells, F.lit(1), "width").alias("cells"), "text")


def _texts(spark: SparkSession, paths: list[str], sep: str, encoding: str | None = None,
           multiline: bool | None = None) -> list[tuple[DataFrame, int | None]]:
    """Records (_path, _at, text, width) of delimited files of any kind and number, not yet parsed: those of one line each
    with the width of their file and the largest of all, those that span lines with their own width and no largest. What
    each file needs is a row of its profile, joined to its lines. Only numbers come to the driver."""
    prof = profile_files(spark, paths, sep)
    if encoding is not None:
        prof = prof.withColumn("latin", F.lit(encoding.upper() not in ("UTF-8", "UTF8")))
    if multiline is not None:
        prof = prof.withColumn("multiline", F.lit(multiline))
    prof = pin(prof)
    kinds = prof.groupBy("multiline").agg(F.max("width").alias("w")).collect()      # at most two
    widths = {bool(r["multiline"]): r["w"] for r in kinds}
    if not widths:
        raise ValueError("no delimited files among the given paths")
    parts = []
    if False in widths:
        lines = attach(_lines(spark, paths), prof.where("NOT multiline").drop("multiline"), ["_path"], "inner", ready=True)
        parts.append((lines.select("_path", "_at", _decoded(F.col("latin")).alias("text"), "width"), widths[False]))
    if True in widths:
        lines = attach(_lines(spark, paths, "\n"), prof.where("multiline").select("_path", "latin"), ["_path"], "inner", ready=True)
        parts.append((stage(_spanning(lines.withColumn("value", _decoded(F.col("latin"))).drop("latin"), sep), "records"), None))
    return parts


def _records(spark: SparkSession, paths: list[str], sep: str) -> DataFrame:
    """(_path, _at, cells, text) of delimited files of any kind and number, in one plan; a record has as many cells as the
    widest of its file."""
    parts = []
    for records, widest in _texts(spark, paths, sep):
        if widest is None:
            wide = pin(records.groupBy("_path").agg(F.max("width").alias("width")))
            records = attach(records.drop("width"), wide, ["_path"], "inner", ready=True)
            widest = wide.agg(F.max("width")).first()[0]
        parts.append(_cells(records, sep, widest))
    return reduce(DataFrame.unionByName, parts)


def raw_grid(spark: SparkSession, paths: list[str], sep: str = ",") -> DataFrame:
    """Delimited files as raw grids (_path, _sheet, _ord, cells); encoding and line mode are settled per file."""
    return _records(spark, paths, sep).select("_path", F.lit("0").alias("_sheet"), F.col("_at").alias("_ord"), "cells")


def grid_of(df: DataFrame, path: Column, order: Column, columns: list[Column],
            sheet: Column | None = None) -> DataFrame:
    """A raw grid from table rows, for grids that arrive as parquet."""
    return df.select(path.alias("_path"), (sheet if sheet is not None else F.lit("0")).alias("_sheet"),
                     order.cast("bigint").alias("_ord"),
                     F.array(*[c.cast("string") for c in columns]).alias("cells"))


# --- masters ------------------------------------------------------------------------------------------

def _column_names(header: list[str]) -> list[str]:
    """Names of a header's columns: one without a name gets its number, repeats (case ignored) get theirs behind."""
    header = [h.lstrip("\ufeff") for h in header]
    low = [h.lower() for h in header]
    return [f"_c{i}" if not h else f"{h}{i}" if low.count(h.lower()) > 1 else h for i, h in enumerate(header)]


def scan_master(spark: SparkSession, path, columns: list[str] | None = None, sep: str = ",",
                encoding: str = "UTF-8", multiline: bool | None = None) -> DataFrame:
    """Delimited masters as all-text columns; missing cells are empty, not null.

    Each file is read under its own header, so files may order or name their columns differently; a column that only
    some of them have is empty for the others. ``columns`` selects and orders. All files are read in one plan: a file's
    header is a row that says where each column of the result stands, joined to its records. The driver sees the
    different headers, not the files. Records are parsed once, as far as the widest header reaches: a separator inside a
    text makes no column. ``multiline=None`` finds out per file whether records span lines.
    """
    if encoding.upper() not in ("UTF-8", "UTF8", "ISO-8859-1", "LATIN1", "LATIN-1"):
        raise ValueError(f"masters are UTF-8 or ISO-8859-1, not {encoding}")
    paths = [path] if isinstance(path, str) else list(path)
    texts = reduce(DataFrame.unionByName, [t.select("_path", "_at", "text") for t, _ in _texts(spark, paths, sep, encoding, multiline)])
    first = pin(texts.where(_filled()).groupBy("_path").agg(F.min("_at").alias("_head")))
    heads = attach(texts, first, ["_path"], "inner", ready=True).where("_at = _head")
    # as many columns as the header names, whatever its longest record has
    own = _separators(F.regexp_replace("text", '"(?:[^"]|"")*"', ""), sep) + 1
    heads = pin(heads.select("_path", "_at", "text", own.alias("width")))
    widest = heads.agg(F.max("width")).first()[0] or 1
    heads = pin(_cells(heads, sep, widest).select("_path", F.col("_at").alias("_head"), F.col("cells").alias("header")))
    headers = [list(r["header"]) for r in heads.select("header").distinct().collect()]      # the different headers
    named = {tuple(h): _column_names(h) for h in headers}
    wanted = columns or list(dict.fromkeys(c for h in sorted(named) for c in named[h]))
    places = [(list(h), [names.index(c) if c in names else None for c in wanted]) for h, names in named.items()]
    known = spark.createDataFrame(places, "header array<string>, places array<int>")
    plan = pin(heads.join(F.broadcast(known), "header").select("_path", "_head", "places"))
    records = _cells(texts.withColumn("width", F.lit(widest)), sep, widest)
    rows = attach(records, plan, ["_path"], "inner", ready=True).where(F.col("_at") > F.col("_head"))
    cell = lambda i: F.coalesce(F.get("cells", F.get("places", F.lit(i))), F.lit(""))
    return rows.select(*[cell(i).alias(c) for i, c in enumerate(wanted)])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV export. Parquet is the master format; CSV is what other tools read."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").option("nullValue", "").option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def read_features(spark: SparkSession, path) -> DataFrame:
    """Institution features, semicolon-separated: two names and nine numbers."""
    names = ["Nombre_IES", "Departamento"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names]
                          + [T.StructField(f, T.DoubleType()) for f in K.FEATURES])
    return spark.read.schema(schema).option("header", True).option("sep", ";").csv(path)
