"""Merging several timestamped uploads of one person into one submission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import constants as C
from gradeloom.functions.predicates import known
from gradeloom.functions.scalars import username_key
from gradeloom.operators.digests import directory_digests
from gradeloom.operators.spread import with_previous

OWNER = ["course_id", "assignment_id", "person_id"]
FILE = [*OWNER, "relpath"]
_WHEN = ["submitted_at", "dir_name"]


def latest_upload(uploads: DataFrame, keys: list[str]) -> DataFrame:
    """The newest upload folder per key, ties broken by folder name."""
    shown = F.struct("dir_name", "username", "display_name", "submitted_at")
    return uploads.groupBy(*keys).agg(F.max_by(shown, F.struct(*_WHEN)).alias("latest"))


def surviving_files(uploads: DataFrame) -> DataFrame:
    """Per path, the version of the last upload that holds it."""
    return uploads.groupBy(*FILE).agg(
        F.max_by(F.struct("digest", *_WHEN), F.struct(*_WHEN)).alias("last")
    ).select(*FILE, "last.*")


def file_versions(uploads: DataFrame) -> DataFrame:
    """Every file version with the version it supersedes, if any.

    Versions are chained inside ranges of the data and then across them, so that a path
    uploaded any number of times, on one day or many, is never ordered in one task.
    """
    return with_previous(
        uploads.select(*FILE, *_WHEN, "digest"), FILE, _WHEN, ["digest", "submitted_at"]
    )


def replaced_files(versions: DataFrame) -> DataFrame:
    """Long form: each changed re-upload with the time of the version it replaced."""
    return versions.where(
        F.col("previous").isNotNull() & (F.col("previous.digest") != F.col("digest"))
    ).select(*FILE, *_WHEN, F.col("previous.submitted_at").alias("replaced_at"))


def merge_flags(versions: DataFrame, survivors: DataFrame) -> DataFrame:
    """Per owner: re-upload flags, several uploads, possibly stale solutions."""
    previous = F.col("previous.digest")
    upload = F.struct(*_WHEN)
    by_owner = versions.groupBy(*OWNER).agg(
        F.bool_or(known(previous == F.col("digest"))).alias("duplicate_reupload"),
        F.bool_or(known(previous != F.col("digest"))).alias("replaced_files"),
        (F.min(upload) != F.max(upload)).alias("merged_uploads"),
    )
    suffix = F.lower(F.regexp_extract("relpath", r"(?<=[^/])(\.[^./]+)$", 1))
    stale = (
        survivors.where(suffix.isin(*C.SOLUTION_SUFFIXES))
        .groupBy(*OWNER, suffix.alias("suffix"))
        .agg((F.min(upload) != F.max(upload)).alias("several"))
        .groupBy(*OWNER)
        .agg(F.bool_or("several").alias("possible_stale_solution"))
    )
    return by_owner.join(stale, OWNER, "left").withColumn(
        "possible_stale_solution",
        known(F.col("possible_stale_solution")) & F.col("merged_uploads"),
    )


def flag_list(*names: str) -> Column:
    """The names of the true flag columns, sorted."""
    return F.array_compact(
        F.array(*[F.when(known(F.col(n)), F.lit(n)) for n in sorted(names)])
    )


def select_uploads(
    uploads: DataFrame, selections: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept files, excluded folders, and selections that point at nothing."""
    keys = ["assignment_id", "person_id"]
    chosen = selections.select(*keys, "folder")
    joined = uploads.join(chosen, keys, "left")
    kept = joined.where(F.col("folder").isNull() | (F.col("folder") == F.col("dir_name")))
    excluded = (
        joined.where(F.col("folder") != F.col("dir_name")).select(*OWNER, "dir_name").distinct()
    )
    present = uploads.select(*keys, F.col("dir_name").alias("folder"))
    unmatched = selections.join(present, [*keys, "folder"], "left_anti")
    return kept.drop("folder"), excluded, unmatched


def merged_submissions(uploads: DataFrame, kept: DataFrame) -> DataFrame:
    """Per owner: upload and file counts, flags, latest kept folder."""
    survivors = surviving_files(kept)
    flags = merge_flags(file_versions(kept), survivors)
    files = survivors.groupBy(*OWNER).agg(F.count(F.lit(1)).alias("files"))
    n_uploads = uploads.groupBy(*OWNER).agg(F.count_distinct(*_WHEN).alias("uploads"))
    return (
        n_uploads.join(files, OWNER)
        .join(flags, OWNER)
        .join(latest_upload(kept, OWNER), OWNER)
    )


def upload_outcomes(
    uploads: DataFrame,
    selections: DataFrame,
    students: DataFrame,
) -> DataFrame:
    """One ``ready`` outcome per (assignment, person) of upload-based archives.

    ``students`` must already hold the people of these uploads (see
    ``identity.allocate_people``). Which files were replaced and which folders excluded
    is in ``replaced_files`` and ``select_uploads``, a row each.
    """
    kept, excluded, _ = select_uploads(uploads, selections)
    merged = merged_submissions(uploads, kept)
    people = students.where(F.col("lms_person_id") != "").select(
        "course_id",
        F.col("lms_person_id").alias("person_id"),
        "student_id",
        F.struct("lms_username", "display_name").alias("identity"),
    )
    chosen = selections.select("assignment_id", "person_id", "folder", "reason")
    replaced = replaced_files(file_versions(kept)).groupBy(*OWNER).agg(
        F.count(F.lit(1)).alias("n_replaced_files")
    )
    left_out = excluded.groupBy(*OWNER).agg(F.count(F.lit(1)).alias("n_excluded_uploads"))
    flags = flag_list(
        "duplicate_reupload", "replaced_files", "merged_uploads", "possible_stale_solution",
        "upload_selected", "identity_changed",
    )
    shown = F.struct(
        F.col("latest.username").alias("lms_username"),
        F.col("latest.display_name").alias("display_name"),
    )
    return (
        merged.join(people, ["course_id", "person_id"])
        .join(chosen, ["assignment_id", "person_id"], "left")
        .join(replaced, OWNER, "left")
        .join(left_out, OWNER, "left")
        .withColumn("upload_selected", F.col("folder").isNotNull())
        .withColumn("identity_changed", ~shown.eqNullSafe(F.col("identity")))
        .select(
            "course_id",
            "assignment_id",
            "student_id",
            F.lit("brightspace").alias("source"),
            F.col("person_id").alias("source_ref"),
            F.lit("ready").alias("status"),
            F.date_format("latest.submitted_at", "yyyy-MM-dd'T'HH:mm").alias("submitted_at"),
            "uploads",
            "files",
            F.array_join(flags, ";").alias("flags"),
            F.coalesce("n_replaced_files", F.lit(0)).alias("n_replaced_files"),
            F.coalesce("folder", F.lit("")).alias("selected_upload"),
            F.coalesce("n_excluded_uploads", F.lit(0)).alias("n_excluded_uploads"),
            F.coalesce("reason", F.lit("")).alias("selection_reason"),
        )
    )


def submission_digests(uploads: DataFrame, selections: DataFrame) -> DataFrame:
    """Per owner: digest of the merged files and the folder that gets the feedback."""
    kept, _, _ = select_uploads(uploads, selections)
    digests = directory_digests(surviving_files(kept), OWNER)
    return digests.join(latest_upload(kept, OWNER), OWNER).select(
        *OWNER, "sha256", "n_files", "latest.dir_name", "latest.username", "latest.display_name"
    )


def username_conflicts(uploads: DataFrame) -> DataFrame:
    """People whose uploads name more than one account."""
    return (
        uploads.groupBy(*OWNER)
        .agg(
            F.min(username_key(F.col("username"))).alias("lowest"),
            F.max(username_key(F.col("username"))).alias("highest"),
        )
        .where(F.col("lowest") != F.col("highest"))
    )
