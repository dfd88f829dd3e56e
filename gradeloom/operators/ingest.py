"""Ingest planning: archive matching, missing rows, apply decisions, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.predicates import is_safe_member_path, known
from gradeloom.functions.scalars import archive_layout_of, archive_series, assignment_series


def archive_layouts(members: DataFrame) -> DataFrame:
    """Layout per archive from its members' top-level directories."""
    in_directory = F.col("name").contains("/")
    kind = F.when(in_directory, archive_layout_of(F.split("name", "/")[0]))
    seen = members.groupBy("archive").agg(
        F.bool_or(known(kind == "unrecognized")).alias("strange"),
        F.bool_or(known(kind == "brightspace")).alias("uploads"),
        F.bool_or(known(kind == "gradescope")).alias("scans"),
    )
    return seen.select(
        "archive",
        F.when(F.col("strange"), "unrecognized")
        .when(F.col("uploads") & F.col("scans"), "mixed")
        .when(F.col("uploads"), "brightspace")
        .when(F.col("scans"), "gradescope")
        .otherwise("empty")
        .alias("layout"),
    )


def unsafe_members(members: DataFrame) -> DataFrame:
    """Members below a top directory whose path could leave it."""
    below = F.regexp_replace("name", "^[^/]*/", "")
    return members.where(
        F.col("name").contains("/") & ~F.col("name").endswith("/") & ~is_safe_member_path(below)
    )


def match_archives(archives: DataFrame, known_ids: DataFrame, explicit: DataFrame) -> DataFrame:
    """Assignment of each archive: an explicit mapping first, else its one name match."""
    keys = ["course_id", "series", "number"]
    parsed = archives.withColumn("parsed", archive_series(F.col("archive"))).select(
        "course_id", "archive", F.col("parsed.series"), F.col("parsed.number")
    )
    candidates = (
        known_ids.select("course_id", "assignment_id", assignment_series(F.col("assignment_id")).alias("p"))
        .where(F.col("p").isNotNull())
        .groupBy("course_id", F.col("p.series").alias("series"), F.col("p.number").alias("number"))
        .agg(
            F.count_distinct("assignment_id").alias("n_matches"),
            F.min("assignment_id").alias("match"),
        )
    )
    mapped = explicit.select("course_id", "archive", F.col("assignment_id").alias("mapped"))
    joined = parsed.join(candidates, keys, "left").join(mapped, ["course_id", "archive"], "left")
    unique = F.col("n_matches") == 1
    return joined.select(
        "course_id",
        "archive",
        F.coalesce("mapped", F.when(unique, F.col("match"))).alias("assignment_id"),
        F.when(F.col("mapped").isNotNull(), F.lit(None))
        .when(F.col("series").isNull(), "unparsed_name")
        .when(F.col("n_matches").isNull(), "no_match")
        .when(~unique, "ambiguous")
        .alias("error"),
    )


#: Parts that the students of a course are dealt into.
COURSE_PARTS = 32


def missing_rows(outcomes: DataFrame, students: DataFrame) -> DataFrame:
    """A ``missing`` row for every known student without one, per ingested assignment.

    The join on the course is the table asked for: one row per (assignment,
    student) that is not there. Students of a course are dealt into parts, and its
    assignments go to each part, so that a large course is many tasks.
    """
    covered = outcomes.select("course_id", "assignment_id").distinct().withColumn(
        "__part", F.explode(F.sequence(F.lit(0), F.lit(COURSE_PARTS - 1)))
    )
    present = outcomes.where(F.col("student_id") != "").select(
        "course_id", "assignment_id", "student_id"
    )
    return (
        students.select("course_id", "student_id")
        .withColumn("__part", F.pmod(F.xxhash64("student_id"), F.lit(COURSE_PARTS)).cast("int"))
        .join(covered, ["course_id", "__part"])
        .join(present, ["course_id", "assignment_id", "student_id"], "left_anti")
        .select(
            "course_id",
            "assignment_id",
            "student_id",
            F.lit("missing").alias("status"),
            F.lit(0).cast("long").alias("uploads"),
            F.lit(0).cast("long").alias("files"),
        )
    )


def frozen_submissions(run_items: DataFrame) -> DataFrame:
    """Student submissions that some grading run refers to."""
    keys = ["course_id", "student_id", "assignment_id"]
    return (
        run_items.where(known(F.col("submission_source") == "student"))
        .select(*keys)
        .dropna(subset=keys)
        .distinct()
    )


def apply_decisions(staged: DataFrame, existing: DataFrame, frozen: DataFrame) -> DataFrame:
    """What applying each staged submission would do: write, nothing, or refuse."""
    keys = ["course_id", "student_id", "assignment_id"]
    joined = staged.join(
        existing.select(*keys, F.col("sha256").alias("existing_sha256")), keys, "left"
    ).join(frozen.withColumn("frozen", F.lit(True)), keys, "left")
    exists = F.col("existing_sha256").isNotNull()
    same = known(F.col("existing_sha256") == F.col("sha256"))
    refused = exists & ~same & known(F.col("frozen"))
    return joined.select(
        *keys,
        F.when(refused, "frozen").otherwise("ready").alias("status"),
        F.when(same, "none").when(refused, "refuse").when(exists, "replace").otherwise("create")
        .alias("action"),
        F.when(refused, "frozen_submission_changed").otherwise("").alias("flags"),
    )


def status_counts(outcomes: DataFrame) -> DataFrame:
    """Outcomes per course, assignment and status, with those that need a human."""
    return outcomes.groupBy("course_id", "assignment_id").agg(
        *[
            F.count_if(F.col("status") == s).alias(f"n_{s}")
            for s in ("ready", "skipped", "frozen", "missing")
        ],
        F.count_if(F.col("status").isin("skipped", "frozen")).alias("attention"),
    )


def merge_receipts(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Attention per assignment: a re-ingested assignment replaces its old count."""
    keys = ["course_id", "assignment_id"]
    old = previous.select(*keys, F.col("attention").alias("old_attention"))
    return current.join(old, keys, "full_outer").select(
        *keys, F.coalesce("attention", "old_attention").alias("attention")
    )
