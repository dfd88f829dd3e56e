"""Row predicates and classifications as Column expressions (never NULL)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom import constants as C


def known(condition: Column) -> Column:
    """The condition with NULL read as false."""
    return F.coalesce(condition, F.lit(False))


def is_stage(stage: str, column: str = "stage") -> Column:
    return known(F.col(column) == stage)


def is_valid_grading() -> Column:
    """Completed, scored and not superseded; NULL in any part is false."""
    return (
        is_stage("grade")
        & known(F.col("outcome") == "completed")
        & F.col("score_pct").isNotNull()
        & ~known(F.col("superseded"))
    )


def is_student_row() -> Column:
    """A grading row that carries a student id, pseudo-students included."""
    return is_stage("grade") & F.col("student_id").isNotNull()


def is_pseudo(column: str | Column = "student_id") -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return known(value.startswith("_"))


def pseudo_role(column: str | Column = "student_id") -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return (
        F.when(value.startswith("_reference"), "reference")
        .when(value.startswith("_irrelevant"), "irrelevant")
        .otherwise("other")
    )


def matches_filter(column: str, wanted: Iterable[str] | None) -> Column:
    """``None`` keeps every row; an empty list keeps none; NULL never matches."""
    if wanted is None:
        return F.lit(True)
    wanted = list(wanted)
    return known(F.col(column).isin(wanted)) if wanted else F.lit(False)


def exception_outcome(exception_type: Column) -> Column:
    """The outcome family of an exception class name."""
    return (
        F.when(exception_type.isin(*C.TIMEOUT_EXCEPTIONS), "timeout")
        .when(exception_type.isin(*C.CANCELLED_EXCEPTIONS), "cancelled")
        .when(exception_type.isin(*C.AGENT_EXCEPTIONS), "agent_error")
        .when(exception_type.isin(*C.INFRA_EXCEPTIONS), "infra_error")
        .otherwise("unknown")
    )


def trial_outcome(
    stage: Column, verified: Column, has_base_pct: Column, reward: Column, exception_type: Column
) -> Column:
    """A verified trial is judged by its reward file, any other by its exception."""
    measured = F.when(
        stage == "grade",
        F.when(has_base_pct, "completed").otherwise("contract_failed"),
    ).otherwise(F.when(known(reward == 0), "contract_failed").otherwise("completed"))
    return F.when(verified, measured).otherwise(exception_outcome(exception_type))


def is_bookkeeping_part(part: Column) -> Column:
    by_suffix = F.lit(False)
    for suffix in C.BOOKKEEPING_SUFFIXES:
        by_suffix = by_suffix | part.endswith(suffix)
    framed = (F.length(part) > 2) & part.startswith("#") & part.endswith("#")
    return part.isin(*C.BOOKKEEPING_NAMES) | by_suffix | framed


def is_bookkeeping_path(path: Column) -> Column:
    return F.exists(F.split(path, "/"), is_bookkeeping_part)


def is_safe_member_path(path: Column) -> Column:
    """A relative POSIX path without empty, dot or backslash parts."""
    parts = F.split(path, "/")
    return ~path.contains("\\") & F.forall(parts, lambda p: ~p.isin("", ".", ".."))


def is_safe_component(value: Column) -> Column:
    return ~value.isin("", ".", "..") & ~value.contains("/") & ~value.contains("\\")
