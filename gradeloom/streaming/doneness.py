"""Doneness kept up to date from a stream of trial results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradeloom.functions.predicates import is_stage
from gradeloom.operators import keys as K
from gradeloom.operators.planning import is_done
from gradeloom.sources.staging import Files, commit, finish, new_stage

_KEPT = [*K.TRIAL, *K.ITEM]
#: The columns of a trial that ``valid_trials`` reads.
COLUMNS = ["stage", "outcome", *_KEPT]
#: Batch folders of like size that are merged into one.
MERGED = 8


def valid_trials(trials: DataFrame, stage: str) -> DataFrame:
    """Trials that count as done; an attempt retried in place counts once valid."""
    return trials.where(is_stage(stage) & is_done()).dropna(subset=K.ITEM).select(*_KEPT)


def running_totals(stream: DataFrame, stage: str) -> DataFrame:
    """Stateful totals per item, each trial once.

    Trial keys never expire, so the state holds every valid trial. It suits
    streams of moderate size; ``fold_trials`` keeps the trials in a table instead.
    """
    once = valid_trials(stream, stage).dropDuplicates(K.TRIAL)
    return once.groupBy(*K.ITEM).agg(F.count(F.lit(1)).alias("existing"))


def folders_to_merge(sizes: Sequence[tuple[int, int]]) -> list[int]:
    """Which of the batch folders ``(batch, bytes)`` to merge: none, or ``MERGED`` and more.

    From the newest back, as long as a folder is at most twice as large as all newer ones
    together. So a folder is merged only with about its own size, each row is written again
    a number of times that is logarithmic in the table, and so is the number of folders.
    """
    taken, total = [], 0
    for batch, size in sorted(sizes, reverse=True):
        if taken and size > 2 * max(total, 1):
            break
        taken.append(batch)
        total += size
    return taken if len(taken) >= MERGED else []


def merge_batches(spark: SparkSession, target: str, before: int) -> None:
    """Merge folders of batches before ``before``, where there are many of like size.

    Those batches are complete and never retried. One commit puts the merged folder in the
    place of the others; readers complete one that was interrupted.
    """
    finish(spark, target, writing=True)
    files = Files(spark, target)
    named = [n for n in files.names() if n.startswith("batch=")]
    batches = [int(n.removeprefix("batch=")) for n in named]
    chosen = folders_to_merge([(b, files.size(f"batch={b}")) for b in batches if b < before])
    if not chosen:
        return
    stage, newest = new_stage(), f"batch={max(chosen)}"
    rows = _appearances(spark, target).where(F.col("batch").isin(chosen)).drop("batch")
    rows.write.parquet(f"{target}/{stage}/{newest}")
    commit(files, stage, [newest], [f"batch={b}" for b in chosen if b != max(chosen)])


def fold_trials(stream: DataFrame, stage: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's valid trials to a table; no state is kept.

    A batch is written to its own folder, replaced as a whole when the batch is
    retried, and reads nothing of the earlier ones, so a lost driver or executor changes
    nothing and a batch costs what its own rows cost, however long the history is. Which
    trials were seen before is told when the table is read (``stored_trials``). Folders of
    earlier batches are merged on the way (``merge_batches``), so files follow the number
    of rows and not that of batches. Nothing expires: a trial seen once is never counted
    again.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        merge_batches(batch.sparkSession, target, batch_id)
        fresh = valid_trials(batch, stage).dropDuplicates(K.TRIAL).withColumn("seen", F.lit(batch_id))
        fresh.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _appearances(spark: SparkSession, target: str) -> DataFrame:
    """The folded rows as they came, with the batch that brought them in ``seen``."""
    finish(spark, target)
    ddl = ", ".join(f"{c} string" for c in _KEPT) + ", seen int, batch int"
    return spark.read.schema(ddl).parquet(target)


def stored_trials(spark: SparkSession, target: str) -> DataFrame:
    """Each trial folded so far as the first batch brought it; without a whole key, once a batch."""
    unnamed = F.col("job_name").isNull() | F.col("trial_name").isNull()
    return (
        _appearances(spark, target)
        .groupBy(*K.TRIAL, F.when(unnamed, F.col("seen")).alias("__of"))
        .agg(F.min(F.struct("seen", *K.ITEM)).alias("first"))
        .select(*K.TRIAL, *[f"first.{c}" for c in K.ITEM])
    )


def stored_totals(spark: SparkSession, target: str) -> DataFrame:
    """Done trials per item over everything folded so far."""
    return (
        stored_trials(spark, target).groupBy(*K.ITEM).agg(F.count(F.lit(1)).alias("existing"))
    )
