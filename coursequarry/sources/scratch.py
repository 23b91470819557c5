"""Intermediate tables in the shared folder the cluster names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`.

    Where the session names none, a local session gets a folder of its own; on a cluster that would leave
    each executor with a part of the rows, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get(_SETTING)
        if not folder:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError(f"{_SETTING} must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="cursos-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "paso") -> DataFrame:
    """The rows written to a table in the shared folder and read back.

    Later steps do not repeat the earlier ones and survive lost executors, and the optimizer knows the
    size of what was written.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove this session's intermediate tables; results built on them must have been written before."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
