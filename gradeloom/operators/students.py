"""Student, class and grader-check tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.predicates import (
    is_pseudo,
    is_student_row,
    is_valid_grading,
    known,
    pseudo_role,
)
from gradeloom.operators import keys as K
from gradeloom.operators.spread import exact_quantiles, join_on_keys, value_counts


def student_grades(trials: DataFrame) -> DataFrame:
    """Real students: scores over valid gradings, failure and flag counts over all."""
    valid = is_valid_grading()
    score = F.when(valid, F.col("score_pct"))
    counted = (
        trials.where(is_student_row() & ~is_pseudo())
        .groupBy(*K.STUDENT)
        .agg(
            F.count(F.lit(1)).alias("n_all"),
            F.count_if(valid).alias("n_valid_gradings"),
            F.avg(score).alias("mean_score_pct"),
            F.stddev_samp(score).alias("sd_score_pct"),
            F.count_if(known(F.col("superseded"))).alias("n_superseded"),
            F.count_if(known(~F.col("sums_consistent"))).alias("n_sums_inconsistent"),
            F.count_if(known(F.col("late_exception"))).alias("n_late_exception"),
            F.count_if(known(F.col("grading_load_error"))).alias("n_load_error"),
        )
    )
    failed = F.col("n_all") - F.col("n_valid_gradings") - F.col("n_superseded")
    return counted.select(
        *K.STUDENT,
        "n_valid_gradings",
        "mean_score_pct",
        "sd_score_pct",
        failed.alias("n_failed_gradings"),
        "n_superseded",
        "n_sums_inconsistent",
        "n_late_exception",
        "n_load_error",
    )


def class_distribution(student_table: DataFrame) -> DataFrame:
    """Distribution of per-student means; a class without any mean keeps a row of zeros."""
    summary = student_table.groupBy(*K.CLASS).agg(
        F.count("mean_score_pct").alias("n_students"),
        F.avg("mean_score_pct").alias("mean"),
        F.stddev_samp("mean_score_pct").alias("sd"),
    )
    counts = value_counts(
        student_table.where(F.col("mean_score_pct").isNotNull()), K.CLASS, "mean_score_pct"
    )
    quantiles = exact_quantiles(
        counts, K.CLASS, "mean_score_pct", {"median": 0.5, "q25": 0.25, "q75": 0.75}
    )
    return join_on_keys(summary, quantiles, K.CLASS, "left").select(
        *K.CLASS, "n_students", "mean", "median", "sd", "q25", "q75"
    )


def grader_checks(trials: DataFrame) -> DataFrame:
    """Pseudo-students only: role and raw score summary."""
    valid = is_valid_grading()
    score = F.when(valid, F.col("score_pct"))
    return (
        trials.where(is_student_row() & is_pseudo())
        .groupBy(*K.STUDENT)
        .agg(
            F.count_if(valid).alias("n_valid_gradings"),
            F.avg(score).alias("mean_score_pct"),
            F.min(score).alias("min_score_pct"),
            F.max(score).alias("max_score_pct"),
        )
        .select(*K.STUDENT, pseudo_role().alias("role"), "n_valid_gradings", "mean_score_pct",
                "min_score_pct", "max_score_pct")
    )
