"""Identities: pseudonyms, name matching, enrichment and integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import constants as C
from gradeloom.functions.predicates import is_pseudo, known
from gradeloom.functions.scalars import is_blank, name_key, username_key
from gradeloom.operators.spread import numbered



def highest_number(students: DataFrame) -> DataFrame:
    """Per course, the highest number an ``S`` id carries."""
    number = F.regexp_extract("student_id", C.STUDENT_ID_PATTERN, 1).try_cast("long")
    return students.groupBy("course_id").agg(F.coalesce(F.max(number), F.lit(0)).alias("highest"))


def _with_ids(newcomers: DataFrame, students: DataFrame) -> DataFrame:
    number = F.coalesce("highest", F.lit(0)) + F.col("__position")
    return (
        newcomers.join(highest_number(students), "course_id", "left")
        .withColumn("student_id", F.format_string("S%03d", number))
        .drop("highest", "__position")
    )


def allocate_people(latest: DataFrame, students: DataFrame) -> DataFrame:
    """New student rows for people without one, numbered by person id.

    ``latest`` has one row per (course_id, person_id) with its newest username
    and display name. Known people keep their ids.
    """
    taken = students.where(F.col("lms_person_id") != "").select(
        "course_id", F.col("lms_person_id").alias("person_id")
    )
    fresh = latest.join(taken, ["course_id", "person_id"], "left_anti").withColumn(
        "__number", F.col("person_id").cast("long")
    )
    placed = numbered(fresh, ["course_id"], ["__number"], "__position")
    return _with_ids(placed, students).select(
        "student_id",
        "course_id",
        F.col("person_id").alias("lms_person_id"),
        F.col("username").alias("lms_username"),
        "display_name",
        F.lit("brightspace").alias("source"),
    )


def _names(students: DataFrame) -> DataFrame:
    return students.groupBy("course_id", name_key(F.col("display_name")).alias("key")).agg(
        F.count(F.lit(1)).alias("n_same_name"), F.min("student_id").alias("name_student")
    )


def scan_identities(scans: DataFrame, overrides: DataFrame, students: DataFrame) -> DataFrame:
    """Each scanned submission with the student or new name it belongs to.

    ``scans``: course_id, assignment_id, submission_id, extracted_name, problem.
    ``overrides``: course_id, submission_id, override. An override that is a
    student id settles the identity; any other override is read as a name.
    """
    by_id = students.select(
        "course_id", F.col("student_id").alias("override"), F.lit(True).alias("known_id")
    )
    override = F.col("override")
    is_id = known(override.rlike(C.STUDENT_ID_PATTERN))
    manual = override.isNotNull()
    joined = (
        scans.join(overrides, ["course_id", "submission_id"], "left")
        .join(by_id, ["course_id", "override"], "left")
        .withColumn("name", F.when(manual & ~is_id, override).when(~manual, F.col("extracted_name")))
        .withColumn("key", name_key(F.col("name")))
        .join(_names(students), ["course_id", "key"], "left")
    )
    same = F.coalesce("n_same_name", F.lit(0))
    from_manifest = F.when(manual, F.lit("identity_from_manifest"))
    problem = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(is_id & F.col("known_id").isNull(), "unknown_student_id")
        .when(~is_id & F.col("name").isNull(), "identity_unresolved")
        .when(~is_id & (same > 1), "ambiguous_identity")
    )
    flags = (
        F.when(F.col("problem").isNotNull(), F.array(F.col("problem")))
        .when(
            problem == "unknown_student_id",
            F.array(F.lit("identity_from_manifest"), F.lit("unknown_student_id")),
        )
        .otherwise(F.array_compact(F.array(problem, from_manifest)))
    )
    return joined.select(
        "course_id",
        "assignment_id",
        "submission_id",
        "name",
        "key",
        flags.alias("flags"),
        problem.alias("unresolved"),
        F.when(problem.isNull(), F.when(is_id, override).when(same == 1, F.col("name_student")))
        .alias("student_id"),
    )


def allocate_names(identified: DataFrame, students: DataFrame) -> DataFrame:
    """New student rows for names that match nobody, numbered by normalized name."""
    fresh = (
        identified.where(F.col("unresolved").isNull() & F.col("student_id").isNull())
        .groupBy("course_id", "key")
        .agg(
            F.min_by("name", F.struct("assignment_id", "submission_id")).alias("display_name")
        )
    )
    placed = numbered(fresh, ["course_id"], ["key"], "__position")
    return _with_ids(placed, students).select(
        "student_id",
        "course_id",
        F.lit("").alias("lms_person_id"),
        F.lit("").alias("lms_username"),
        "display_name",
        F.lit("gradescope").alias("source"),
        "key",
    )


def scan_outcomes(identified: DataFrame, newcomers: DataFrame) -> DataFrame:
    """Outcomes of name-based submissions; the first of a student wins."""
    owner = ["course_id", "assignment_id", "student_id"]
    fresh = newcomers.select("course_id", "key", F.col("student_id").alias("new_id"))
    settled = identified.join(fresh, ["course_id", "key"], "left").withColumn(
        "student_id",
        F.when(F.col("unresolved").isNull(), F.coalesce("student_id", "new_id")),
    )
    first = (
        settled.where(F.col("student_id").isNotNull())
        .groupBy(*owner)
        .agg(F.min("submission_id").alias("first_id"))
    )
    joined = settled.join(first, owner, "left")
    skipped = F.col("student_id").isNull()
    duplicate = known(F.col("submission_id") != F.col("first_id"))
    return joined.select(
        "course_id",
        "assignment_id",
        F.coalesce("student_id", F.lit("")).alias("student_id"),
        F.lit("gradescope").alias("source"),
        F.col("submission_id").alias("source_ref"),
        F.when(skipped | duplicate, "skipped").otherwise("ready").alias("status"),
        F.lit(1).cast("long").alias("uploads"),
        F.when(skipped | duplicate, 0).otherwise(1).cast("long").alias("files"),
        F.when(duplicate, F.lit("duplicate_student"))
        .otherwise(F.array_join("flags", ";"))
        .alias("flags"),
    )


def enrich(table: DataFrame, students: DataFrame) -> DataFrame:
    """Display name and username beside the student id; blank when unmapped."""
    names = students.select("course_id", "student_id", "display_name", "lms_username")
    position = table.columns.index("student_id") + 1
    order = [*table.columns[:position], "display_name", "lms_username", *table.columns[position:]]
    joined = table.join(names, ["course_id", "student_id"], "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit("")) for c in ("display_name", "lms_username")}
    ).select(*order)


def unmapped_students(trials: DataFrame, students: DataFrame) -> DataFrame:
    """Real students of the trials that the identity table does not know."""
    keys = ["course_id", "student_id"]
    real = trials.where(
        F.col("course_id").isNotNull() & known(F.col("student_id") != "") & ~is_pseudo()
    )
    return real.select(*keys).distinct().join(students.select(*keys), keys, "left_anti")


def key_violations(table: DataFrame, keys: Sequence[str], key: Column, rule: str) -> DataFrame:
    """Blank and repeated keys of a table as (keys..., rule, detail, n) rows."""
    keyed = table.groupBy(*keys, key.alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    blank = F.col("subject").isNull() | is_blank(F.col("subject"))
    return keyed.where(blank | (F.col("n") > 1)).select(
        *keys,
        F.lit(rule).alias("rule"),
        F.coalesce("subject", F.lit("")).alias("subject"),
        F.when(blank, "blank").otherwise("duplicate").alias("detail"),
        "n",
    )


def identity_violations(students: DataFrame, roster: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Key integrity of the identity, roster and enrollment tables."""
    with_account = students.where(~is_blank(F.col("lms_username")))
    return (
        key_violations(students, ["course_id"], F.col("student_id"), "student_id")
        .unionByName(
            key_violations(
                with_account, ["course_id"], username_key(F.col("lms_username")), "username"
            )
        )
        .unionByName(
            key_violations(
                enrollments, ["course_id"], username_key(F.col("lms_username")), "enrollment"
            )
        )
        .unionByName(
            key_violations(
                roster.withColumn("course_id", F.lit("")),
                ["course_id"],
                username_key(F.col("username")),
                "roster",
            )
        )
    )
