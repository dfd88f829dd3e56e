"""Building blocks that keep one hot key from landing in one task.

Every helper is exact. They share one idea: summarise below the key first (by
value or by a monotone coarse bucket of the order), so that what reaches the
per-key step is a small summary and never the rows of the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.session import written

#: Rows of a key that one task may order.
CROWDED = 100_000


def join_on_keys(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Equi-join in which a NULL key matches a NULL key; the left keys are kept."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    )
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("right", "full", "full_outer", "outer"):
        merged = [F.coalesce(F.col(k), F.col(f"__r_{k}")).alias(k) for k in keys]
        rest = [c for c in joined.columns if c not in keys and not c.startswith("__r_")]
        return joined.select(*merged, *rest)
    return joined.drop(*[f"__r_{k}" for k in keys])


def value_counts(rows: DataFrame, keys: Sequence[str], value: str, count: str = "n") -> DataFrame:
    """Rows per (key, value): partial sums before the shuffle, spread by value."""
    return rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(count))


def _in_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``rows`` with ``__bucket``: which range of (key, order) holds the row.

    Spark takes the bounds from the rows. They are written, which fixes the ranges: one that
    was computed anew from other bounds would not fit the rest.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(tasks, *keys, *order)
    return written(dealt.withColumn("__bucket", F.spark_partition_id()))


def exact_quantiles(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    count: str = "n",
) -> DataFrame:
    """Linear-interpolated quantiles per key from a (key, value, count) table.

    Values lie in ranges whose bounds come from the data, so an outlier fills no
    range with all the rest; a running total over the range totals finds the one or
    two ranges that hold each wanted rank, and only their values are ordered. No step
    sorts or holds a whole key.
    """
    keys = list(keys)
    sizes = counts.groupBy(*keys).agg(F.sum(count).alias("__n"))
    placed = join_on_keys(_in_ranges(counts, keys, [value]), sizes, keys)

    totals = placed.groupBy(*keys, "__bucket", "__n").agg(F.sum(count).alias("__total"))
    running = Window.partitionBy(*keys).orderBy("__bucket")
    starts = totals.withColumn(
        "__start", F.sum("__total").over(running) - F.col("__total")
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("__n") - 1)).alias("at"))
            for name, p in probabilities.items()
        ]
    )
    # A bucket is needed when it holds the rank below or above a wanted position.
    def holds(position: Column) -> Column:
        low, high = F.floor(position["at"]), F.ceil(position["at"])
        end = F.col("__start") + F.col("__total")
        return ((low >= F.col("__start")) & (low < end)) | (
            (high >= F.col("__start")) & (high < end)
        )

    needed = (
        starts.withColumn("__wanted", F.filter(wanted, holds))
        .where(F.size("__wanted") > 0)
        .select(*keys, "__bucket", "__start", "__wanted")
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(value)
    ranked = (
        join_on_keys(placed, needed, [*keys, "__bucket"])
        .withColumn("__end", F.sum(count).over(inside) + F.col("__start"))
        .withColumn("__first", F.col("__end") - F.col(count))
    )
    exploded = ranked.select(*keys, value, "__first", "__end", F.explode("__wanted").alias("w"))
    low, high = F.floor("w.at"), F.ceil("w.at")
    below = (low >= F.col("__first")) & (low < F.col("__end"))
    above = (high >= F.col("__first")) & (high < F.col("__end"))
    picks = (
        exploded.where(below | above)
        .groupBy(*keys, F.col("w.name").alias("__name"), F.col("w.at").alias("__at"))
        .agg(
            F.max(F.when(below, F.col(value))).alias("__below"),
            F.max(F.when(above, F.col(value))).alias("__above"),
        )
        .withColumn(
            "__q",
            F.col("__below")
            + (F.col("__above") - F.col("__below")) * (F.col("__at") - F.floor("__at")),
        )
    )
    return picks.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("__name") == name, F.col("__q"))).alias(name)
            for name in probabilities
        ]
    )


def with_median_ranks(counts: DataFrame, keys: Sequence[str], value: str, count: str = "n") -> DataFrame:
    """A (key, value, count) table with ``__middle``: the value where it is a median one.

    The median of a key is ``median_of()`` over its rows. Values lie in ranges of (key,
    value); totals of the ranges tell where each begins, and counts run on inside a range.
    No task holds a key's values.
    """
    keys = list(keys)
    placed = _in_ranges(counts, keys, [value])
    totals = placed.groupBy(*keys, "__bucket").agg(F.sum(count).alias("__sum"))
    whole = Window.partitionBy(*keys)
    starts = totals.withColumn(
        "__start", F.sum("__sum").over(whole.orderBy("__bucket")) - F.col("__sum")
    ).withColumn("__all", F.sum("__sum").over(whole)).drop("__sum")
    inside = Window.partitionBy(*keys, "__bucket").orderBy(value)
    ranked = join_on_keys(placed, starts, [*keys, "__bucket"]).withColumn(
        "__end", F.sum(count).over(inside) + F.col("__start")
    )

    def holds(rank: Column) -> Column:
        return (rank >= F.col("__end") - F.col(count)) & (rank < F.col("__end"))

    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    return ranked.withColumn("__middle", F.when(holds(low) | holds(high), F.col(value))).drop(
        "__bucket", "__start", "__all", "__end"
    )


def median_of() -> Column:
    """The aggregate that turns ``__middle`` into the median."""
    return (F.min("__middle") + F.max("__middle")) / 2


def grouped_with_median(
    rows: DataFrame, keys: Sequence[str], value: str, aggregates: Sequence[Column]
) -> DataFrame:
    """One row per key with ``aggregates``, in which ``median`` is the key's median value.

    ``rows`` are read from storage, like those of ``written``: they are read for the sizes of
    the keys and again for the rest. A key of at most ``CROWDED`` rows is ordered in one
    task, and one shuffle by key serves the order and the aggregates. The others, of which
    there is at most one for every ``CROWDED`` rows, go by ranges of their distinct values.
    """
    keys = list(keys)
    placed = rows.withColumn("__key", F.xxhash64(*keys))
    sizes = placed.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    crowded = [r["__key"] for r in sizes.where(F.col("__n") > CROWDED).select("__key").collect()]
    # The number comes first: it orders most rows without a look at the keys.
    whole = Window.partitionBy("__key", *keys)
    rank, size = F.row_number().over(whole.orderBy(value)), F.count(F.lit(1)).over(whole)
    low, high = F.floor((F.col("__size") + 1) / 2), F.floor(F.col("__size") / 2) + 1
    grouped = (
        placed.where(~F.col("__key").isin(crowded))
        .withColumn("__rank", rank)
        .withColumn("__size", size)
        .withColumn("__middle", F.when(F.col("__rank").isin(low, high), F.col(value)))
        .withColumn("median", (F.min("__middle").over(whole) + F.max("__middle").over(whole)) / 2)
        .groupBy("__key", *keys)
        .agg(*aggregates)
        .drop("__key")
    )
    if not crowded:
        return grouped
    large = placed.where(F.col("__key").isin(crowded)).drop("__key")
    medians = (
        with_median_ranks(value_counts(large, keys, value), keys, value)
        .groupBy(*keys)
        .agg(median_of().alias("median"))
    )
    return grouped.unionByName(join_on_keys(large, medians, keys).groupBy(*keys).agg(*aggregates))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Consecutive numbers per key in ``order``, from 1.

    Rows are dealt into ranges of (key, order) whose bounds come from the rows
    themselves, so neither a hot key nor a common beginning fills one range. Range
    sizes are counted and accumulated per key, then each range is numbered on its own.
    """
    keys = list(keys)
    placed = _in_ranges(rows, keys, order)
    sizes = placed.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__size"))
    running = Window.partitionBy(*keys).orderBy("__bucket")
    offsets = sizes.withColumn(
        "__offset", F.sum("__size").over(running) - F.col("__size")
    ).drop("__size")
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    return (
        join_on_keys(placed, offsets, [*keys, "__bucket"])
        .withColumn(name, F.row_number().over(inside).cast("long") + F.col("__offset"))
        .drop("__bucket", "__offset")
    )


def with_previous(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], take: Sequence[str], name: str = "previous"
) -> DataFrame:
    """Each row with a struct of ``take`` from the row before it in ``order``.

    Rows lie in ranges of (key, order) whose bounds come from the rows themselves. Inside a
    range this is a plain ``lag``; the first row of a range gets the last row of the key's
    previous range, which comes from one summary row per range. A key may hold any share of
    the rows, all within a moment.
    """
    keys = list(keys)
    placed = _in_ranges(rows, keys, order).withColumn("__take", F.struct(*take))
    lasts = placed.groupBy(*keys, "__bucket").agg(
        F.max_by("__take", F.struct(*order)).alias("__last")
    )
    before = lasts.withColumn(
        "__carried", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__bucket"))
    ).drop("__last")
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    lagged = placed.withColumn("__lag", F.lag("__take").over(inside))
    return (
        join_on_keys(lagged, before, [*keys, "__bucket"])
        .withColumn(name, F.coalesce("__lag", "__carried"))
        .drop("__bucket", "__take", "__lag", "__carried")
    )
