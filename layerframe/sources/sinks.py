"""Exclusive creation of files and of tables laid out by key.

A writer first makes a claim, a file that only one can create. It writes to a
folder that no listing shows and gives it its name when all is there, so of
several writers one wins and no reader meets a part of a result. Claims and
folders of failed writes are removed; those of a driver that died stay, and the
error that the next writer gets names the claim to delete.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerframe.operators.keys import Keys, key_list
from layerframe.sources.shared import arrow_uri


def save_new(
    df: DataFrame,
    path: str,
    file_format: str = "parquet",
    partition_by: list[str] | None = None,
) -> None:
    """Write ``df`` to ``path``; an error if there is anything already.

    Of several writers at once one wins, the others get the same error. The path
    has all files from the moment it exists, on file systems that rename
    folders in one step; on others its ``_SUCCESS`` file comes last.
    """
    with _staged(df.sparkSession, path) as staged:
        writer = df.write.format(file_format).mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.save(staged.toString())


def save_new_files(files: DataFrame, path: str, name: str = "name", content: str = "content") -> None:
    """Write each row as a file of its own below ``path``; an error if that exists.

    ``name`` is the file's path below ``path``, ``content`` its text, written as
    UTF-8; a NULL makes an empty file. Names that repeat or are NULL are an error.
    The tasks write the files themselves, so that no name passes through the
    driver; ``path`` must be one that Arrow can open on every executor. A file gets
    its name when it is whole, and a task that runs again passes over what is there.
    """
    # Before any task writes: one that still runs would make a deleted folder anew.
    counts = files.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))
    if wrong := counts.where("name IS NULL OR n > 1").take(1):
        raise AnalysisException(f"files: name is NULL or repeated: {wrong[0]['name']}")
    with _staged(files.sparkSession, path) as staged:
        uri = arrow_uri(staged.toString())

        def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            store, base = fs.FileSystem.from_uri(uri)
            begun = f"{base}/{_BEGUN}/{uuid.uuid4().hex}"
            store.create_dir(f"{base}/{_BEGUN}", recursive=True)
            made = set()
            for batch in batches:
                for file, text in zip(batch["name"], batch["content"]):
                    place = f"{base}/{file}"
                    folder = place.rpartition("/")[0]
                    if folder not in made:
                        store.create_dir(folder, recursive=True)
                        made.add(folder)
                    if store.get_file_info(place).type != fs.FileType.NotFound:
                        continue
                    with store.open_output_stream(begun) as stream:
                        stream.write((text or "").encode())
                    store.move(begun, place)
                yield pd.DataFrame({"n": [len(batch)]})

        rows = files.select(F.col(name).alias("name"), F.col(content).cast("string").alias("content"))
        rows.mapInPandas(write, "n long").agg(F.sum("n")).collect()
        system, begun = located(files.sparkSession, f"{staged.toString()}/{_BEGUN}")
        system.mkdirs(begun)  # without rows no task has made the folder
        system.delete(begun, True)


_BEGUN = ".begun"


def save_new_table(df: DataFrame, name: str, keys: Keys, buckets: int) -> None:
    """Save ``df`` as a table bucketed and sorted by ``keys``; an error if it exists.

    Tables with the same keys and number of buckets are paired without any
    shuffle, which pays for a base that is overlaid again and again. Of several
    writers at once one wins. The catalog knows the table when it is written.
    """
    keys = key_list(keys)
    spark = df.sparkSession
    with claimed(spark, f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}"):
        (
            # one task per bucket, so one file per bucket
            df.repartition(buckets, *keys)
            .write.mode("errorifexists")
            .bucketBy(buckets, *keys)
            .sortBy(*keys)
            .saveAsTable(name)
        )


@contextmanager
def _staged(spark: SparkSession, path: str) -> Iterator[Any]:
    """A folder beside ``path``, claimed, that gets its name when this ends well."""
    system, target = located(spark, path)
    with claimed(spark, path):
        if system.exists(target):
            raise AnalysisException(f"{path} already exists")
        staged = _beside(spark, target, f".{target.getName()}.writing-{uuid.uuid4().hex}")
        try:
            yield staged
            if not system.rename(staged, target):
                raise AnalysisException(f"{path} could not be named")
        finally:
            system.delete(staged, True)


@contextmanager
def claimed(spark: SparkSession, path: str) -> Iterator[None]:
    """While this lasts nobody else can claim ``path``; an error if somebody has."""
    system, target = located(spark, path)
    claim = _beside(spark, target, f".{target.getName()}.claim")
    system.mkdirs(claim.getParent())
    if not _create(spark, system, claim):
        raise AnalysisException(f"{path} already exists or is being written, as {claim} claims")
    try:
        yield
    finally:
        system.delete(claim, False)


def located(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The Hadoop file system of a path and the path in full."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(at)


def _beside(spark: SparkSession, target: Any, name: str) -> Any:
    return spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), name)


def _create(spark: SparkSession, system: Any, file: Any) -> bool:
    """Make an empty file; False if there is one. One step, whoever else tries."""
    if file.toUri().getScheme() == "file":
        # Hadoop's own local file system looks first and creates then.
        return spark._jvm.java.io.File(file.toUri().getPath()).createNewFile()
    try:
        system.create(file, False).close()
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True
