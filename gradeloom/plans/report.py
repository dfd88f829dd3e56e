"""The assessment report: filters, then the derived tables from two tidy ones."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom import constants as C
from gradeloom.functions.predicates import matches_filter
from gradeloom.operators import (
    accounting,
    ladder,
    quality,
    repeats,
    review,
    students,
)
from gradeloom.operators import keys as K


def filter_tables(
    trials: DataFrame,
    criteria: DataFrame,
    courses: Iterable[str] | None = None,
    assignments: Iterable[str] | None = None,
    configs: Iterable[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted courses, assignments and configs, and only their criteria.

    A config name keeps a row by its own or by its solver's config.
    """
    kept = trials.where(
        matches_filter("course_id", courses)
        & matches_filter("assignment_id", assignments)
        & (matches_filter("config_name", configs) | matches_filter("solver_config_name", configs))
    )
    return kept, criteria.join(kept.select(*K.TRIAL), K.TRIAL, "left_semi")


def report_tables(
    trials: DataFrame,
    criteria: DataFrame,
    rubric_criteria: DataFrame,
    seed: int = C.DEFAULT_SEED,
) -> dict[str, DataFrame]:
    """Every table of the report by file name, lazily.

    ``trials`` must already carry supersession: it is decided over all rows,
    before any filter. Persist it first when several tables are written.
    """
    student_table = students.student_grades(trials)
    per_assignment = ladder.grades_by_assignment(trials)
    return {
        "trials": trials,
        "criteria": criteria,
        "solve_summary": ladder.solve_summary(trials),
        "grades_by_assignment": per_assignment,
        "grades_by_course": ladder.grades_by_course(per_assignment, trials, seed),
        "judge_quality": quality.judge_quality(trials, criteria, rubric_criteria),
        "student_grades": student_table,
        "class_distribution": students.class_distribution(student_table),
        "grader_checks": students.grader_checks(trials),
        "failure_accounting": accounting.failure_accounting(trials),
        "ungraded_solve_trials": accounting.ungraded_solve_trials(trials),
        "repeat_consistency": repeats.repeat_consistency(trials),
        "repeat_scores": repeats.repeat_scores(trials),
        "deviant_gradings": repeats.deviant_gradings(trials),
        "review_queue": review.review_queue(trials),
        "initial_gradings": review.initial_gradings(trials),
        "final_gradings": review.final_gradings(trials),
        "unseen_initial_gradings": review.unseen_initial_gradings(trials),
        "near_timeouts": accounting.near_timeouts(trials),
    }


def sources(trials: DataFrame) -> DataFrame:
    """Long form: every config and job that a report was made from, with its trials."""
    return trials.groupBy("stage", *K.CONFIG, "job_name").agg(F.count(F.lit(1)).alias("n_trials"))


def provenance(
    trials: DataFrame,
    criteria: DataFrame,
    courses: list[str] | None = None,
    assignments: list[str] | None = None,
    configs: list[str] | None = None,
    seed: int = C.DEFAULT_SEED,
) -> DataFrame:
    """One row that says what a report was made from.

    Configs and jobs are counted here; ``sources`` lists them, a row each.
    """
    def given(values: list[str] | None):
        kind = "array<string>"
        return F.lit(None).cast(kind) if values is None else F.array(*map(F.lit, values)).cast(kind)

    one_row = sources(trials).agg(
        F.coalesce(F.sum("n_trials"), F.lit(0)).alias("n_trials"),
        F.count_distinct(
            F.coalesce("config_name", F.lit("")), F.coalesce("config_identity", F.lit("")),
            F.coalesce("stage", F.lit("")),
        ).alias("n_configs"),
        F.count_distinct(F.when(F.col("stage") == "solve", F.col("job_name"))).alias("n_solve_jobs"),
        F.count_distinct(F.when(F.col("stage") == "grade", F.col("job_name"))).alias("n_grade_jobs"),
    )
    rows = criteria.agg(F.count(F.lit(1)).alias("n_criteria_rows"))
    return one_row.crossJoin(rows).select(
        given(courses).alias("courses"),
        given(assignments).alias("assignments"),
        given(configs).alias("config_filter"),
        F.lit(seed).alias("seed"),
        F.lit(C.BOOTSTRAP_RESAMPLES).alias("resamples"),
        F.lit(C.BOOTSTRAP_CONFIDENCE).alias("confidence"),
        F.lit(C.MIN_BOOTSTRAP_CLUSTERS).alias("min_clusters"),
        F.lit(C.REPEAT_RANGE_FLAG_PCT).alias("repeat_range_pct"),
        F.lit(C.REPEAT_DEVIATION_FLAG_PCT).alias("repeat_deviation_pct"),
        F.lit(C.NEAR_TIMEOUT_FRACTION).alias("near_timeout_fraction"),
        "n_configs",
        "n_solve_jobs",
        "n_grade_jobs",
        "n_trials",
        "n_criteria_rows",
    )
