"""Consistency of repeated gradings of one item under one config."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import constants as C
from gradeloom.functions.predicates import is_valid_grading
from gradeloom.operators import keys as K
from gradeloom.operators.spread import grouped_with_median, join_on_keys
from gradeloom.session import written

_FIRST = ["job_name", "trial_name", "student_id", "submission_source", "rubric_sha256"]


def trial_ref() -> Column:
    return F.concat(F.col("job_name"), F.lit("/"), F.col("trial_name"))


def score_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(key, score) with its row count and the first row in (job, trial) order.

    Partial aggregation shrinks a hot item to its distinct scores before the
    shuffle, and the rows of one item spread over tasks by score.
    """
    return rows.groupBy(*keys, "score_pct").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*_FIRST)).alias("first")
    )


def repeat_groups(trials: DataFrame) -> DataFrame:
    """Items with two or more valid gradings: count, median, range, deviants, first row."""
    rows = written(trials.where(is_valid_grading()).select(*K.REPEAT, "score_pct", *_FIRST))
    deviation = F.abs(F.col("score_pct") - F.col("median"))
    grouped = grouped_with_median(
        rows,
        K.REPEAT,
        "score_pct",
        [
            F.sum(F.lit(1)).alias("n_gradings"),
            F.min(F.struct(*_FIRST)).alias("first"),
            F.max("median").alias("median_score_pct"),
            F.min("score_pct").alias("low"),
            F.max("score_pct").alias("high"),
            F.count_if(deviation > C.REPEAT_DEVIATION_FLAG_PCT).alias("n_deviant_gradings"),
        ],
    ).where(F.col("n_gradings") >= 2)
    spread = F.col("high") - F.col("low")
    return grouped.select(
        *K.REPEAT,
        *[F.col(f"first.{c}").alias(c) for c in _FIRST[2:]],
        "n_gradings",
        "median_score_pct",
        spread.alias("range_score_pct"),
        (spread > C.REPEAT_RANGE_FLAG_PCT).alias("range_flagged"),
        F.greatest(
            F.col("high") - F.col("median_score_pct"), F.col("median_score_pct") - F.col("low")
        ).alias("reach"),
        "n_deviant_gradings",
    )


def deviant_gradings(trials: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Long form: one row per grading farther from its item's median than the bound."""
    groups = repeat_groups(trials) if groups is None else groups
    # Most items have no deviant at all, which their extremes already tell.
    suspects = groups.where(F.col("reach") > C.REPEAT_DEVIATION_FLAG_PCT).select(
        *K.REPEAT, "median_score_pct", "n_gradings"
    )
    rows = trials.where(is_valid_grading()).select(*K.REPEAT, *K.TRIAL, "score_pct")
    return join_on_keys(rows, suspects, K.REPEAT).where(
        F.abs(F.col("score_pct") - F.col("median_score_pct")) > C.REPEAT_DEVIATION_FLAG_PCT
    )


def repeat_scores(trials: DataFrame) -> DataFrame:
    """Long form of the score lists: every item's distinct scores with counts."""
    return score_table(trials.where(is_valid_grading()), K.REPEAT).drop("first")


def repeat_consistency(trials: DataFrame) -> DataFrame:
    """One row per repeated item with its spread, flags and number of deviant gradings.

    The scores are rows of ``repeat_scores``, the deviant gradings of ``deviant_gradings``.
    """
    return repeat_groups(trials).drop("reach")
