"""Trees of profile folders as rows, one row per file."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerframe.sources.shared import arrow_uri, new_shared_path, written_table


def load_items(
    spark: SparkSession,
    root: str,
    profiles: Sequence[str] | None = None,
    with_content: bool = False,
) -> DataFrame:
    """Files below ``root/<profile>/<item>`` as (profile, item, path, n_bytes).

    ``path`` is relative to the profile, so a file directly in the profile has
    ``path = item``. ``profiles`` reads only those folders. ``with_content``
    adds the UTF-8 text; without it no file is opened, only listed.

    All names and sizes pass through the driver, which keeps Spark's file index:
    for trees of very many files :func:`list_items` is the one to take.
    Spark's listing passes over names starting with ``.`` or ``_``, empty
    files and empty folders; :func:`list_items` sees those too.
    """
    base = _qualified(spark, root)
    folders = [base] if profiles is None else [f"{base}/{name}" for name in profiles]
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(folders)
        .withColumn("inside", F.substr("path", F.lit(len(base) + 2)))
    )
    columns = [
        F.substring_index("inside", "/", 1).alias("profile"),
        F.split_part("inside", F.lit("/"), F.lit(2)).alias("item"),
        F.substr("inside", F.locate("/", F.col("inside")) + 1).alias("path"),
        F.col("length").alias("n_bytes"),
    ]
    if with_content:
        columns.append(F.decode("content", "UTF-8").alias("content"))
    return files.where(F.contains("inside", F.lit("/"))).select(*columns)


FOLDERS_A_TASK = 256
"""Folders that a task lists one after the other, where there are many."""


def list_items(profiles: DataFrame, root: str, with_content: bool = False) -> DataFrame:
    """Everything below the folders of ``profiles``, blanks included.

    Same columns as :func:`load_items`; an empty item folder is a row with a
    NULL ``path``, a profile without a folder gives none. ``root`` must be a path
    or URI that Arrow can open on every executor.

    Folders are rows: each round lists those that the one before has found, dealt
    out anew, so that however they are nested all tasks have some. There are as
    many rounds as levels of folders. What a round found is written to the
    shared folder, so a lost executor costs no earlier round, and no name passes
    through the driver. ``with_content`` adds the UTF-8 text, read by the tasks
    from the files of the last listing.
    """

    uri = arrow_uri(root)

    def list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for profile, folder in zip(batch["profile"], batch["folder"]):
                place = f"{base}/{profile}/{folder}" if folder else f"{base}/{profile}"
                inside = f"{folder}/" if folder else ""
                selector = fs.FileSelector(place, allow_not_found=True)
                yield pd.DataFrame(
                    [
                        (profile, f"{inside}{e.base_name}", e.type == fs.FileType.Directory, e.size)
                        for e in store.get_file_info(selector)
                    ],
                    columns=["profile", "path", "is_folder", "n_bytes"],
                )

    spark = profiles.sparkSession
    root_of_rounds = new_shared_path(spark, "listing")
    listing = "profile string, path string, is_folder boolean, n_bytes long"
    found: list[DataFrame] = []
    folders = written_table(
        profiles.select(F.col("profile").cast("string"), F.lit("").alias("folder")), f"{root_of_rounds}/0"
    )
    while (n := folders.count()) or not found:
        dealt = folders.repartition(_tasks(spark, n))
        found.append(written_table(dealt.mapInPandas(list_folders, listing), f"{root_of_rounds}/{len(found) + 1}"))
        folders = found[-1].where("is_folder").select("profile", F.col("path").alias("folder"))
    everything = reduce(DataFrame.unionByName, found)
    files = everything.where("NOT is_folder").select(
        "profile", F.substring_index("path", "/", 1).alias("item"), "path", "n_bytes"
    )
    # A folder right below a profile is an item.
    items = everything.where("is_folder AND NOT contains(path, '/')").select("profile", F.col("path").alias("item"))
    empty = items.join(files.select("profile", "item").distinct(), ["profile", "item"], "left_anti")
    blank = [F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("n_bytes")]
    listed = files.unionByName(empty.select("profile", "item", *blank))
    return _with_texts(listed, uri) if with_content else listed


def _tasks(spark: SparkSession, folders: int) -> int:
    """So many tasks that none lists very many folders, and all cores have some."""
    few = min(folders, spark.sparkContext.defaultParallelism)
    return max(1, few, -(-folders // FOLDERS_A_TASK))


def _with_texts(listed: DataFrame, uri: str) -> DataFrame:
    """``listed`` with the text of each file, NULL where there is no path."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            # A file at a time, so that a batch of large ones is never held at once.
            for i in range(len(batch)):
                row = batch.iloc[i : i + 1]
                profile, path = row["profile"].iloc[0], row["path"].iloc[0]
                text = None
                if path is not None:
                    with store.open_input_stream(f"{base}/{profile}/{path}") as stream:
                        text = stream.read().decode("utf-8", "replace")
                yield row.assign(content=[text])

    dealt = listed.repartition("profile", "item", "path")
    return dealt.mapInPandas(read, "profile string, item string, path string, n_bytes long, content string")


def _qualified(spark: SparkSession, root: str) -> str:
    # File rows carry fully qualified paths; the root has to look the same.
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    file_system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return file_system.makeQualified(path).toString().rstrip("/")
