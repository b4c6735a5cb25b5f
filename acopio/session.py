"""Session settings, the shared work folder, and lineage cuts that survive a lost executor."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "acopio", master: str | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): str(v) for k, v in conf.items()},
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share. A cluster names it in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="acopio-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/acopio/{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Compute a small intermediate once and cut its lineage with a reliable checkpoint."""
    work_dir(df.sparkSession)
    return df.checkpoint()


def stage(df: DataFrame, label: str = "stage", partition_by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """Write a large intermediate as a parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.option("compression", codec) if codec else df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_name(path: str) -> str:
    return os.path.basename(path.rstrip("/"))
