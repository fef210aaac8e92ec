"""Owned state kept in buckets, of which a change rewrites only those it touches.

The rows of a state lie in folders by a hash of the bucket keys. A manifest, one
small file for each version, names the folder of each bucket; it lists buckets
only, so it is as short as there are buckets. A change reads the buckets
of the keys that come in, writes them to new folders and then makes the next
manifest, which only one writer can. Readers go by the latest manifest, or by
one they name, and never meet a half of a change.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerframe.operators.keys import Keys, key_list
from layerframe.operators.managed import managed_apply, managed_remove
from layerframe.sources.shared import new_shared_path, written_table
from layerframe.sources.sinks import claimed, located


@dataclass(frozen=True)
class StateVersion:
    """What a manifest says: the folder of each bucket that has rows."""

    root: str
    version: int
    bucket_by: list[str]
    buckets: int
    schema: T.StructType
    folders: dict[int, str]

    def bucket(self) -> Column:
        # Cast, because equal keys of other types have other hashes.
        types = {f.name: f.dataType for f in self.schema}
        hashed = F.xxhash64(*[F.col(k).cast(types[k]) for k in self.bucket_by])
        return F.pmod(hashed, F.lit(self.buckets)).cast("int")

    def rows(self, spark: SparkSession, buckets: set[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; no other file is opened."""
        places = [
            f"{self.root}/{folder}"
            for bucket, folder in sorted(self.folders.items())
            if buckets is None or bucket in buckets
        ]
        if not places:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*places)


def create_state(df: DataFrame, root: str, bucket_by: Keys, buckets: int) -> StateVersion:
    """Lay ``df`` out in buckets as version 0; an error if there is a state already."""
    first = StateVersion(root.rstrip("/"), -1, key_list(bucket_by), buckets, df.schema, {})
    return _next_version(df.sparkSession, first, df, set(range(buckets)))


def state_version(spark: SparkSession, root: str, version: int | None = None) -> StateVersion:
    """The latest version of a state, or the one asked for."""
    root = root.rstrip("/")
    if version is None:
        system, folder = located(spark, f"{root}/manifests")
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        version = max(int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0] != ".")
    said = json.loads(spark.read.text(_manifest(root, version), wholetext=True).first()[0])
    return StateVersion(
        root,
        version,
        said["bucket_by"],
        said["buckets"],
        T.StructType.fromJson(said["schema"]),
        {int(b): f for b, f in said["folders"].items()},
    )


def read_state(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """All rows of a state, as of its latest version or of the one asked for."""
    return state_version(spark, root, version).rows(spark)


def apply_to_state(
    spark: SparkSession, root: str, incoming: DataFrame, keys: Keys, is_owned: Column
) -> DataFrame:
    """:func:`managed_apply` on a kept state; what became of the rows of ``incoming``.

    ``keys`` have to hold those the state is laid out by. Buckets that no key of
    ``incoming`` falls into are neither read nor written. Returned are the keys and
    the ``outcome`` of the rows that came in.
    """
    keys = key_list(keys)
    state = state_version(spark, root)
    _require_bucket_keys(state, keys)
    incoming = written_table(incoming, new_shared_path(spark, "incoming"))
    touched = _touched(state, incoming)
    applied = managed_apply(state.rows(spark, touched), incoming, keys, is_owned)
    applied = written_table(applied, new_shared_path(spark, "applied"))
    _next_version(spark, state, applied.drop("outcome"), touched)
    return applied.where("outcome <> 'kept'").select(*keys, "outcome")


def remove_from_state(
    spark: SparkSession, root: str, scope: DataFrame, keys: Keys, is_owned: Column
) -> StateVersion:
    """:func:`managed_remove` on a kept state; the version after it.

    ``scope`` has ``keys``, among them those the state is laid out by; only
    their buckets are read and written.
    """
    keys = key_list(keys)
    state = state_version(spark, root)
    _require_bucket_keys(state, keys)
    scope = written_table(scope.select(*keys), new_shared_path(spark, "scope"))
    touched = _touched(state, scope)
    left = managed_remove(state.rows(spark, touched), scope, keys, is_owned)
    return _next_version(spark, state, left, touched)


def _require_bucket_keys(state: StateVersion, keys: list[str]) -> None:
    if missing := set(state.bucket_by) - set(keys):
        raise ValueError(f"the state is laid out by columns that are no keys here: {sorted(missing)}")


def _touched(state: StateVersion, rows: DataFrame) -> set[int]:
    # At most as many as there are buckets.
    return {r[0] for r in rows.select(state.bucket()).distinct().collect()}


def _next_version(
    spark: SparkSession, state: StateVersion, rows: DataFrame, touched: set[int]
) -> StateVersion:
    """Write the rows of the buckets ``touched``, then say so in the next manifest."""
    version = state.version + 1
    folder = f"data/{version}-{uuid.uuid4().hex}"
    if touched:
        laid_out = rows.select(*state.schema.names, state.bucket().alias("__bucket"))
        laid_out = laid_out.repartition(len(touched), "__bucket")
        laid_out.write.mode("errorifexists").partitionBy("__bucket").parquet(f"{state.root}/{folder}")
    folders = {b: f for b, f in state.folders.items() if b not in touched}
    system, written = located(spark, f"{state.root}/{folder}")
    for status in system.listStatus(written) if touched else []:
        name = status.getPath().getName()
        if name.startswith("__bucket="):
            folders[int(name.split("=")[1])] = f"{folder}/{name}"
    made = StateVersion(state.root, version, state.bucket_by, state.buckets, state.schema, folders)
    _publish(spark, made)
    return made


def _manifest(root: str, version: int) -> str:
    return f"{root}/manifests/{version:09d}.json"


def _publish(spark: SparkSession, made: StateVersion) -> None:
    text = json.dumps(
        {
            "bucket_by": made.bucket_by,
            "buckets": made.buckets,
            "schema": made.schema.jsonValue(),
            "folders": made.folders,
        }
    )
    path = _manifest(made.root, made.version)
    with claimed(spark, path):
        system, target = located(spark, path)
        if system.exists(target):
            raise AnalysisException(f"{path} already exists: the state was changed meanwhile")
        draft = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
        out = system.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        system.rename(draft, target)
