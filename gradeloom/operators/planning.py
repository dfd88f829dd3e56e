"""Planning over stored results: doneness, deficits, samples, prior gradings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.predicates import is_pseudo, is_stage, known
from gradeloom.operators import keys as K


def is_done() -> Column:
    """A solve is done when verified, a grading only with a valid result."""
    verified = F.col("outcome").isin("completed", "contract_failed")
    return known(
        F.when(F.col("stage") == "grade", F.col("outcome") == "completed").otherwise(verified)
    )


def grading_sources(
    submissions: DataFrame,
    course: str | None = None,
    student: str | None = None,
    assignment: str | None = None,
    solve_config: str | None = None,
) -> DataFrame:
    """Submissions a grading run would cover; ``None`` does not narrow."""
    rows = submissions
    for column, value in (
        ("course_id", course),
        ("student_id", student),
        ("assignment_id", assignment),
        ("config_name", solve_config),
    ):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def done_totals(trials: DataFrame, stage: str, check: Column | None = None) -> DataFrame:
    """Done trials per (item, identity), pooled over all jobs of the stage."""
    return (
        trials.where(is_stage(stage) & (is_done() if check is None else known(check)))
        .dropna(subset=K.ITEM)
        .groupBy(*K.ITEM)
        .agg(F.count(F.lit(1)).alias("existing"))
    )


def deficits(planned: DataFrame, totals: DataFrame, repeats: int, force: bool = False) -> DataFrame:
    """How many trials each planned item still needs, and its status."""
    existing = F.coalesce("existing", F.lit(0))
    joined = planned.join(totals, K.ITEM, "left").withColumn("existing", existing)
    if force:
        missing, status = F.lit(repeats).cast("long"), F.lit("forced")
    else:
        missing = F.greatest(F.lit(repeats) - F.col("existing"), F.lit(0))
        status = (
            F.when(F.col("existing") == 0, "pending").when(missing > 0, "partial")
            .otherwise("complete")
        )
    return joined.select(*K.ITEM, "existing", missing.alias("deficit"), status.alias("status"))


def deficit_groups(deficit_table: DataFrame) -> DataFrame:
    """Items per deficit: each becomes one job, since attempts are set per job."""
    return (
        deficit_table.where(F.col("deficit") > 0)
        .groupBy("deficit")
        .agg(F.count(F.lit(1)).alias("n_items"))
    )


def configuration_changes(planned: DataFrame, totals: DataFrame) -> DataFrame:
    """Planned items not done under their identity but done under another one."""
    done = totals.where(F.col("existing") > 0)
    pending = planned.select(*K.ITEM).join(done.select(*K.ITEM), K.ITEM, "left_anti")
    return pending.join(done.select("item_id"), "item_id", "left_semi")


def hash_order_sample(submissions: DataFrame, size: int) -> DataFrame:
    """Per assignment, the first ``size`` real students in hash order.

    The order depends on course and student only, so samples are nested in size
    and shared by assignments. Each task keeps only its own first ``size`` rows
    of a group before the shuffle.
    """
    key = F.sha2(F.concat("course_id", F.lit("/"), "student_id"), 256)
    order = Window.partitionBy("course_id", "assignment_id").orderBy("__hash", "student_id")
    return (
        submissions.where(F.col("student_id").isNotNull() & ~is_pseudo())
        .withColumn("__hash", key)
        .withColumn("sample_rank", F.row_number().over(order))
        .where(F.col("sample_rank") <= size)
        .drop("__hash")
    )


def sample_summary(submissions: DataFrame, size: int) -> DataFrame:
    """Per assignment, how many were chosen, submitted, and left out as pseudo."""
    real = F.col("student_id").isNotNull() & ~is_pseudo()
    return submissions.groupBy("course_id", "assignment_id").agg(
        F.least(F.count_if(real), F.lit(size)).alias("n_chosen"),
        F.count_if(real).alias("n_submitted"),
        F.count_if(is_pseudo()).alias("n_pseudo"),
    )


def prior_grading_counts(requested: DataFrame, pool: DataFrame) -> DataFrame:
    """Usable, missing and stale stored gradings of each requested judge item.

    ``requested``: item_id, item_identity (under the context config) and the
    submission's current digest. ``pool``: stored valid gradings with the digest
    they measured and whether their artifacts are still there.
    """
    stored = pool.select(*K.ITEM, "has_artifacts", F.col("submission_sha256").alias("graded_sha256"))
    joined = requested.join(stored, K.ITEM, "left")
    there = known(F.col("has_artifacts"))
    same = known(F.col("graded_sha256") == F.col("submission_sha256"))
    return joined.groupBy(*K.ITEM).agg(
        F.count_if(there & same).alias("n_usable"),
        F.count_if(known(~F.col("has_artifacts"))).alias("n_missing"),
        F.count_if(there & ~same).alias("n_stale"),
    )


def first_prior_gradings(requested: DataFrame, pool: DataFrame, gradings: int) -> DataFrame:
    """The first ``gradings`` usable priors of every item that has that many."""
    stored = pool.where(known(F.col("has_artifacts"))).select(
        *K.ITEM, *K.TRIAL, "submission_sha256"
    )
    usable = requested.join(stored, [*K.ITEM, "submission_sha256"])
    order = Window.partitionBy(*K.ITEM).orderBy(*K.TRIAL)
    first = usable.withColumn("position", F.row_number().over(order)).where(
        F.col("position") <= gradings
    )
    # An item has enough when one of its rows reached the last position.
    enough = first.where(F.col("position") == gradings).select(*K.ITEM)
    return first.join(enough, K.ITEM, "left_semi").select(*K.ITEM, *K.TRIAL, "position")


def solve_submissions(trials: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Solve trials with the reason they yield no gradable submission, if any.

    ``artifacts`` lists the files of submission artifacts by (job, trial).
    """
    filed = artifacts.groupBy(*K.TRIAL).agg(F.count(F.lit(1)).alias("n_files"))
    verified = F.col("outcome").isin("completed", "contract_failed")
    return (
        trials.where(is_stage("solve"))
        .join(filed, K.TRIAL, "left")
        .select(
            "course_id",
            "assignment_id",
            *K.TRIAL,
            F.when(~verified, "solve-failed")
            .when(F.col("n_files").isNull(), "empty-submission")
            .alias("reason"),
        )
    )


def assignments_without_submission(selection: DataFrame) -> DataFrame:
    """Assignments where nothing is gradable; an all-empty one needs forcing."""
    return (
        selection.groupBy("course_id", "assignment_id")
        .agg(
            F.count_if(F.col("reason").isNull()).alias("n_gradable"),
            F.bool_and(known(F.col("reason") == "empty-submission")).alias("needs_force"),
        )
        .where(F.col("n_gradable") == 0)
        .drop("n_gradable")
    )


def run_accounting(
    launched: DataFrame, before: DataFrame, new_valid: DataFrame, repeats: int, force: bool = False
) -> DataFrame:
    """Requested, succeeded, failed and incomplete items of one run, as one row.

    ``launched``: item and attempts of its job; ``before`` and ``new_valid``:
    valid trials per item before the run and from it.
    """
    joined = (
        launched.join(before.withColumnRenamed("existing", "n_before"), K.ITEM, "left")
        .join(new_valid.withColumnRenamed("existing", "n_new"), K.ITEM, "left")
    )
    n_before = F.coalesce("n_before", F.lit(0))
    total = n_before + F.coalesce("n_new", F.lit(0))
    target = n_before + F.col("attempts") if force else F.lit(repeats)
    return joined.agg(
        F.count(F.lit(1)).alias("n_requested"),
        F.count_if(total > 0).alias("n_succeeded"),
        F.count_if(total == 0).alias("n_failed"),
        F.count_if((total > 0) & (total < target)).alias("n_incomplete"),
    )
