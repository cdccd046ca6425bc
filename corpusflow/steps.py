"""Steps of a job as written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in spark.checkpoint.dir.

    A folder of our own is made only for a local master whose session names none, as in tests, where driver and tasks are
    one process; a cluster without the setting is an error.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='corpusflow-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def steps_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corpusflow-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a step as a table in the shared folder and read it back.

    Cuts the lineage with committed files, so a lost executor costs no recomputation
    of what came before, and gives later reads one fixed content. All steps of an application stand in one folder, which
    `discard_steps` deletes; results that are still lazy read from it, so only the caller knows when.
    """
    spark = df.sparkSession
    path = f"{steps_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.step_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*steps: DataFrame) -> None:
    """Delete steps on which nothing that is still lazy depends."""
    for df in steps:
        if path := getattr(df, "step_path", None):
            _delete(df.sparkSession, path)


def discard_steps(spark: SparkSession) -> None:
    """Delete what this application's steps wrote; for the end of a job, once its results are written elsewhere."""
    _delete(spark, steps_dir(spark))
