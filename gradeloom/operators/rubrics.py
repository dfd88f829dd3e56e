"""Rubric texts and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import constants as C
from gradeloom.functions import json_fields as J
from gradeloom.functions.predicates import known
from gradeloom.functions.scalars import strip

_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_TRIGGER = "- `"


def parse_rubrics(files: DataFrame, text: str = "text") -> DataFrame:
    """Each rubric text with its criteria, in order, and its errors.

    A line that starts like a criterion must follow the whole format; all other
    lines are prose. A rubric is usable exactly when ``errors`` is empty.
    """
    def parse(line: Column) -> Column:
        def group(index: int) -> Column:
            return F.regexp_extract(line["text"], C.RUBRIC_LINE_PATTERN, index)

        return F.struct(
            line["number"].alias("line"),
            line["text"].rlike(C.RUBRIC_LINE_PATTERN).alias("matches"),
            group(1).alias("id"),
            strip(group(4)).alias("title"),
            group(2).try_cast("double").alias("max_points"),
            (group(3) != "").alias("bonus"),
        )

    numbered = F.transform(
        F.split(F.col(text), _LINE_BREAK, -1),
        lambda line, i: F.struct((i + 1).alias("number"), strip(line).alias("text")),
    )
    lines = F.transform(F.filter(numbered, lambda x: x["text"].startswith(_TRIGGER)), parse)
    # Behind a generator: each check of each line would read the whole text again.
    parsed = files.withColumn("__lines", J.once(lines)).withColumn("__ids", F.col("__lines.id"))

    def line_error(line: Column, index: Column) -> Column:
        code = (
            F.when(~line["matches"], "format")
            .when(line["id"].rlike(r"(?U)\s"), "id_has_space")
            .when(line["max_points"] <= 0, "points_not_positive")
            .when(F.array_position("__ids", line["id"]) <= index, "duplicate_id")
        )
        return F.concat(F.lit("line "), line["line"].cast("string"), F.lit(": "), code)

    usable = F.filter("__lines", lambda x: x["matches"])
    whole = F.array_compact(
        F.array(
            F.when(F.size("__lines") == 0, F.lit("no_criteria")),
            F.when(
                (F.size(usable) > 0) & F.forall(usable, lambda x: x["bonus"]), F.lit("all_bonus")
            ),
        )
    )
    return (
        parsed.withColumn(
            "errors", F.concat(F.array_compact(F.transform("__lines", line_error)), whole)
        )
        .withColumn(
            "criteria",
            F.transform(
                usable,
                lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"),
                                   x["max_points"].alias("max_points"), x["bonus"].alias("bonus")),
            ),
        )
        .drop("__lines", "__ids", text)
    )


def rubric_criteria(parsed: DataFrame) -> DataFrame:
    """Criteria rows of the usable rubric versions (needs course, assignment, sha256)."""
    return parsed.where(F.size("errors") == 0).select(
        "course_id", "assignment_id", "sha256", F.inline("criteria")
    ).withColumnRenamed("id", "criterion_id")


def rubric_versions(files: DataFrame) -> DataFrame:
    """One row per distinct rubric bytes; a selectable path wins over an archived one."""
    # The data root itself may lie below a folder of that name.
    archived = F.col("path").rlike("(^|/)rubrics/[^/]+/archive/[^/]+$")
    return files.groupBy(
        "course_id", "assignment_id", F.sha2("content", 256).alias("sha256")
    ).agg(
        F.min_by("path", F.struct(archived, F.col("path"))).alias("path"),
        F.any_value("content").alias("content"),
    )


def recorded_rubric_jobs(run_items: DataFrame) -> DataFrame:
    """Long form: which grading job refers to which rubric version under which name."""
    return (
        run_items.where(known(F.col("stage") == "grade"))
        .dropna(subset=["course_id", "assignment_id", "rubric_sha256"])
        .select("course_id", "assignment_id", "rubric_name", "rubric_sha256", "job_name")
        .distinct()
    )


def recorded_rubrics(run_items: DataFrame) -> DataFrame:
    """Every rubric version that grading records refer to, with its jobs counted."""
    return (
        recorded_rubric_jobs(run_items)
        .groupBy("course_id", "assignment_id", "rubric_name", "rubric_sha256")
        .agg(F.count(F.lit(1)).alias("n_jobs"), F.min("job_name").alias("first_job"))
    )


def orphaned_rubrics(recorded: DataFrame, versions: DataFrame) -> DataFrame:
    """Recorded versions whose bytes are stored nowhere."""
    stored = versions.select("course_id", "assignment_id", F.col("sha256").alias("rubric_sha256"))
    return recorded.join(stored, stored.columns, "left_anti")
