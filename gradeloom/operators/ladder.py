"""Benchmark ladder: solve outcomes, assignment means, course means, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import constants as C
from gradeloom.functions.predicates import is_stage, is_valid_grading, known
from gradeloom.operators import keys as K
from gradeloom.operators.spread import join_on_keys, numbered

_RESAMPLE_CHUNK = 100


def outcome_counts(prefix: str = "n_") -> list[Column]:
    return [
        F.count_if(F.col("outcome") == outcome).alias(prefix + outcome) for outcome in C.OUTCOMES
    ]


def solve_summary(trials: DataFrame) -> DataFrame:
    """Solve outcome counts and contract pass rate per config, course, assignment."""
    counted = (
        trials.where(is_stage("solve"))
        .groupBy(*K.SOLVE)
        .agg(
            F.count(F.lit(1)).alias("n_trials"),
            *outcome_counts(),
            F.count_if(known(F.col("late_exception"))).alias("n_late_exception"),
        )
    )
    verified = F.col("n_completed") + F.col("n_contract_failed")
    return counted.select(
        *K.SOLVE,
        "n_trials",
        *[f"n_{outcome}" for outcome in C.OUTCOMES],
        verified.alias("n_verified"),
        F.try_divide("n_completed", verified).alias("contract_pass_rate"),
        "n_late_exception",
    )


def grades_by_assignment(trials: DataFrame) -> DataFrame:
    """Means over per-item means of solve-derived gradings, so repeats never weigh."""
    derived = trials.where(
        is_valid_grading() & known(F.col("submission_source") == "solve-trial")
    ).withColumnsRenamed(
        {"config_name": "grading_config_name", "config_identity": "grading_config_identity"}
    )
    per_item = derived.groupBy(*K.LADDER_ASSIGNMENT, *K.ITEM).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score_pct").alias("item_mean")
    )
    return per_item.groupBy(*K.LADDER_ASSIGNMENT).agg(
        F.count(F.lit(1)).alias("n_solve_trials"),
        F.sum("n").alias("n_gradings"),
        F.avg("item_mean").alias("mean_score_pct"),
        F.stddev_samp("item_mean").alias("sd_score_pct"),
    )


def rubric_version_counts(per_assignment: DataFrame) -> DataFrame:
    """How many rubric versions each assignment of a course row was graded under."""
    return per_assignment.groupBy(*K.LADDER_COURSE, "assignment_id").agg(
        F.count(F.lit(1)).alias("n_versions"),
        F.max("mean_score_pct").alias("mean_score_pct"),
    )


def grades_by_course(
    per_assignment: DataFrame,
    trials: DataFrame,
    seed: int = C.DEFAULT_SEED,
    resamples: int = C.BOOTSTRAP_RESAMPLES,
) -> DataFrame:
    """Macro mean over single-version assignments, with coverage and an interval.

    ``per_assignment`` is the ``grades_by_assignment`` table. It is read several
    times, so callers keep it (persisted or written) rather than recompute it.
    """
    versions = rubric_version_counts(per_assignment)
    single = F.col("n_versions") == 1
    courses = versions.groupBy(*K.LADDER_COURSE).agg(
        F.count_if(single).alias("n_assignments"),
        F.count_if(~single).alias("n_assignments_mixed_rubric"),
        F.avg(F.when(single, F.col("mean_score_pct"))).alias("macro_mean_score_pct"),
    )
    attempted = (
        trials.where(is_stage("solve"))
        .groupBy(
            F.col("config_identity").alias("solver_config_identity"),
            F.col("course_id"),
        )
        .agg(F.count_distinct("assignment_id").alias("n_attempted"))
    )
    # Plain equality: an unknown solver identity matches no solve row.
    covered = courses.join(attempted, ["solver_config_identity", "course_id"], "left")
    values = versions.where(single).select(*K.LADDER_COURSE, "assignment_id", "mean_score_pct")
    intervals = bootstrap_intervals(values, K.LADDER_COURSE, "assignment_id", seed, resamples)
    return join_on_keys(covered, intervals, K.LADDER_COURSE, "left").select(
        *K.LADDER_COURSE,
        "n_assignments",
        "n_assignments_mixed_rubric",
        F.greatest(
            F.coalesce("n_attempted", F.lit(0)),
            F.col("n_assignments") + F.col("n_assignments_mixed_rubric"),
        ).alias("n_assignments_total"),
        "macro_mean_score_pct",
        "ci_low",
        "ci_high",
    )


def _draw(seed: int, key: Column, resample: Column, draw: Column, n: Column) -> Column:
    """A 0-based index below ``n`` from a counter hash, the same on any partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), key, resample.cast("string"), draw.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bootstrap_intervals(
    values: DataFrame,
    keys: list[str],
    order: str,
    seed: int = C.DEFAULT_SEED,
    resamples: int = C.BOOTSTRAP_RESAMPLES,
) -> DataFrame:
    """Percentile bootstrap of the mean for every key with enough values.

    Draws come from a hash of (seed, key, resample, draw), so the interval does
    not depend on partitioning. Values are numbered within their key, draws are
    spread over tasks in chunks of resamples and joined to the numbered values, and
    sums are built before the shuffle; no cell grows with the key.
    """
    label = F.concat_ws("|", *[F.coalesce(F.col(k), F.lit("")) for k in keys])
    sizes = (
        values.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__size"))
        .where(F.col("__size") >= C.MIN_BOOTSTRAP_CLUSTERS)
        .withColumn("__label", label)
        # Unlike the label, which is hashed, this tells an absent part from an empty one.
        .withColumn("__key", F.to_json(F.array(*[F.col(k).cast("string") for k in keys])))
    )
    placed = numbered(join_on_keys(values, sizes, keys), keys, [order], "__position")
    chunk_starts = F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(_RESAMPLE_CHUNK))
    chunk = F.sequence(
        F.col("__from"), F.least(F.col("__from") + (_RESAMPLE_CHUNK - 1), F.lit(resamples - 1))
    )
    pick = _draw(seed, F.col("__label"), F.col("__resample"), F.col("__position"), F.col("__size"))
    draws = (
        placed.select("__key", "__label", "__size", "__position")
        .withColumn("__from", F.explode(chunk_starts))
        # A fixed count: the rows are few, but each stands for much work, so they
        # must not be coalesced by size. A resample's draws stay together.
        .repartition(_tasks(values), "__key", "__from")
        .withColumn("__resample", F.explode(chunk))
        .select("__key", "__resample", (pick + 1).alias("__position"))
    )
    drawn = draws.join(placed.select("__key", "__position", "mean_score_pct"), ["__key", "__position"])
    means = drawn.groupBy("__key", "__resample").agg(F.avg("mean_score_pct").alias("__mean"))
    tail = (1.0 - C.BOOTSTRAP_CONFIDENCE) / 2.0
    bounds = means.groupBy("__key").agg(
        F.percentile("__mean", F.array(F.lit(tail), F.lit(1.0 - tail))).alias("__ci")
    )
    return sizes.join(bounds, "__key").select(
        *keys, F.col("__ci")[0].alias("ci_low"), F.col("__ci")[1].alias("ci_high")
    )


def ladder_drilldown(courses: DataFrame, per_assignment: DataFrame) -> DataFrame:
    """Assignment rows under their course row; a NULL key matches a NULL key."""
    macro = courses.select(
        *K.LADDER_COURSE, F.col("macro_mean_score_pct"), F.col("n_assignments")
    )
    return join_on_keys(per_assignment, macro, K.LADDER_COURSE)
