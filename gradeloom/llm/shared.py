"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.session import checkpoint_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back.

    Cuts the lineage as ``checkpoint()`` does, in columns and compressed.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def whole_text(column: str = "text") -> Column:
    """The text, a null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def range_blocks(df: DataFrame, column: str, blocks: int) -> tuple[DataFrame, int]:
    """``df`` with ``__block``: which of up to ``blocks`` value ranges holds ``column``.

    Ranges rise with the column and equal values share one. The bounds are approximate
    quantiles of the whole column; only those ``blocks`` numbers reach the driver. Nulls
    fall into block 0.
    """
    steps = [i / blocks for i in range(1, blocks)]
    found = df.agg(F.percentile_approx(F.col(column).cast("double"), steps, 100 * blocks)).first()[0]
    splits = sorted(set(found or []))
    if not splits:
        return df.withColumn("__block", F.lit(0)), 1
    cut = Bucketizer(
        splits=[-float("inf"), *splits, float("inf")], inputCol="__value", outputCol="__at"
    )
    value = F.coalesce(F.col(column).cast("double"), F.lit(-float("inf")))
    placed = cut.transform(df.withColumn("__value", value))
    return placed.withColumn("__block", F.col("__at").cast("int")).drop("__value", "__at"), len(splits) + 1


#: Edges that one task of ``connected`` reads, where there are not more tasks anyway.
EDGES_A_TASK = 100_000


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``: the smallest node reachable.

    Alternating large and small stars. Each round is two groupings and two joins over at
    most as many edges as before, kept in the shared checkpoint folder; rounds grow with
    the logarithm of a component. The driver sees one count and one checksum a round.
    """

    def summary(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    current = checkpointed(
        edges.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = summary(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        # A small graph needs few tasks, and leaves few files behind in each round.
        current = current.coalesce(1 + before[0] // EDGES_A_TASK)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (
            both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        ).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(least, "a")
            .where("b != low")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(least.select("a", F.col("low").alias("b")))
            .distinct()
        )
        current = checkpointed(small)
        after = summary(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
