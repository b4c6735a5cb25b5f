"""Incremental ingestion: a file stream whose checkpoint is the ledger of processed files."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import snapshots
from ..plans.ingest import latest_file_wins


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                glob: str | None = None, max_files: int | None = None, **options) -> DataFrame:
    """Rows of files not seen before, with the file they came from in ``_path``."""
    reader = spark.readStream.format(fmt).schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select("*", F.col("_metadata.file_path").alias("_path"))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what has arrived and stop. A new checkpoint folder means a full re-ingest."""
    query = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def delivery_of(path: Column) -> Column:
    """What arrives as one: the folder of part files, else the file itself."""
    return F.when(path.rlike("/part-[^/]*$"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(path)


def ledger_of(spark: SparkSession) -> str:
    """The id of the stream whose batch is at hand: the same after a restart, a new one with a new checkpoint folder."""
    name = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if name is None:
        raise RuntimeError("a delivery sink works inside foreachBatch only")
    return name


def upsert_sink(root: str, tipo: Column, anio: Column, delivery: Column | None = None,
                late: str = "ignore") -> Callable[[DataFrame, int], None]:
    """Batch -> master: the newest delivery of each (category, year), with all its files, whichever batches they come in.

    ``delivery`` orders the deliveries and tells them apart; by default ``delivery_of`` the path. Parts of the delivery
    that is stored add to it, a later delivery replaces it. An earlier delivery that arrives late is ignored, or
    replaces it with ``late="replace"``. Readers see a batch whole or not at all; a batch that is run again after a
    failure, or that is in already, changes nothing. A new checkpoint folder is a full re-ingest: each delivery
    starts anew with its first part.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        source, state = ledger_of(spark), snapshots.current(spark, root)
        if state.done.get(source, -1) >= epoch:
            return
        batch.persist()    # read once for the winners and once for their rows
        try:
            named = delivery_of(F.col("_path")) if delivery is None else delivery
            dated = batch.withColumns({"tipo": tipo, "anio": anio, "_delivery": named})
            last = latest_file_wins(dated.select("tipo", "anio", "_delivery").distinct(), ["tipo", "anio"], "_delivery")
            won = {(r["tipo"], r["anio"]): r["_delivery"] for r in last.collect()}    # categories and calendar years
            stored = {k: h.delivery for k, h in state.held.items()}
            if late != "replace":
                won = {k: d for k, d in won.items() if stored.get(k) is None or d >= stored[k]}
            chosen = spark.createDataFrame([(*k, d) for k, d in won.items()], dated.select("tipo", "anio", "_delivery").schema)
            mine = dated.alias("b").join(F.broadcast(chosen.alias("c")), F.expr(    # one row per category and year
                "b.tipo <=> c.tipo AND b.anio <=> c.anio AND b._delivery = c._delivery"), "left_semi")
            written = snapshots.write(mine.drop("_delivery"), root)
            snapshots.commit(spark, root, snapshots.deliver(written, won, source, epoch, late))
        finally:
            batch.unpersist()
    return sink


MERGE = 20     # batches of changed counts after which they are merged into one


def stream_counts(stream: DataFrame, keys: list[Column], checkpoint: str, table: str) -> None:
    """Running record counts per key. A batch writes the keys it changed and publishes them in one commit; a batch that
    fails leaves the last counts to readers (``read_counts``), and one that is run again changes nothing. A new
    checkpoint folder counts from nothing."""
    counts = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("registros"))

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        source, state = ledger_of(spark), snapshots.current(spark, table)
        if state.done.get(source, -1) < epoch:
            _publish_counts(batch, table, source, epoch, [k for k, h in state.held.items() if h.source != source])
        held = snapshots.current(spark, table).held
        if len(held) > MERGE:
            _publish_counts(read_counts(spark, table), table, source, epoch, list(held))

    query = (counts.writeStream.foreachBatch(sink).outputMode("update")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def _publish_counts(rows: DataFrame, table: str, source: str, epoch: int, instead_of: list[tuple]) -> None:
    """Rows of one batch, in place of the batches ``instead_of``."""
    written = snapshots.write(rows.withColumns({"tipo": F.lit("conteos"), "anio": F.lit(epoch).cast("bigint")}), table)

    def decide(_state: snapshots.State) -> list[dict]:
        gone = [{"op": "drop", "tipo": k[0], "anio": k[1]} for k in instead_of]
        new = [written.declared(), *[written.put(k, None, source) for k in written.folders]] if written.folders else []
        return [*gone, *new, {"op": "batch", "source": source, "batch": epoch}]
    snapshots.commit(rows.sparkSession, table, decide)


def read_counts(spark: SparkSession, table: str) -> DataFrame:
    """The counts as last published: of every key the one of its latest batch."""
    state = snapshots.current(spark, table)
    rows = snapshots.read(spark, table, state, state.held)
    keys = [f"`{c}`" for c in rows.columns if c not in ("tipo", "anio", "registros")]
    return rows.groupBy(*keys).agg(F.max_by("registros", "anio").alias("registros"))
