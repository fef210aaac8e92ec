"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_shared_path, written_table


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a and b, long).

    The component is the smallest node that links lead to. Nodes hang themselves
    under the smallest neighbour, from both sides in turns, until nothing moves:
    rounds grow with the logarithm of the longest chain. A round's links are
    written to the shared folder, and none makes more links than it had.
    """
    spark = links.sparkSession

    def written(df: DataFrame) -> DataFrame:
        return written_table(df, new_shared_path(spark, "components"))

    now = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("b", "m").where("b <> m").toDF("a", "b")
        now = written(small.unionByName(least.toDF("a", "b")).distinct())
        after = _state(now)
        if after == state:
            break
        state = after
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
