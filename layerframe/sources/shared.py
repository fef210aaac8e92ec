"""Working tables in the folder that all executors can reach."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PREFIX = "layerframe-"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only in local mode, where one machine does everything, a folder is made and
    set if none is named. On a cluster that is an error: each executor would
    write to a disk of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not _is_local(context.master):
            raise ValueError(
                "set spark.checkpoint.dir to a folder that the driver and all executors share"
            )
        context.setCheckpointDir(tempfile.mkdtemp(prefix=PREFIX))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{PREFIX}{label}-{uuid.uuid4().hex}"


def arrow_uri(path: str) -> str:
    """A path or URI with Hadoop's spellings of schemes in the form Arrow knows."""
    return re.sub("^s3[an]://", "s3://", re.sub("^file:/+", "file:///", path))


def written_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once and go on from the files.

    Cuts the lineage, is computed once, survives lost executors and leaves
    column pruning, filter pushdown and real sizes to the reader. The schema
    is read from the files, so files that the driver can't see are an error and
    not an empty table.
    """
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def remove_working_tables(spark: SparkSession) -> int:
    """Delete all working tables from the shared folder; returns their number.

    For the end of a job: results that are read from them are lost, and so are
    those of other jobs that use the folder just then.
    """
    paths = spark._jvm.org.apache.hadoop.fs
    folder = paths.Path(shared_dir(spark))
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    made = system.globStatus(paths.Path(folder, f"{PREFIX}*")) or []
    for status in made:
        system.delete(status.getPath(), True)
    return len(made)
