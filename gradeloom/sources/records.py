"""File sources: stored JSON documents, tables and manifests of a data root.

Layout (all below one root): ``solving|grading/<job>/`` with a run record and one
directory per trial, ``courses/<course>/rubrics/<assignment>/*.md``,
``submissions/<course>/<student>/<assignment>/``, ``tables/<course>/*.csv``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom import constants as C
from gradeloom import schemas
from gradeloom.functions.json_fields import accept_duplicate_keys
from gradeloom.functions.scalars import is_blank, username_key

STAGE_FOLDERS = {"solve": "solving", "grade": "grading"}


def _documents(spark: SparkSession, pattern: str, parts: str, names: list[str]) -> DataFrame:
    """Whole files as text with columns cut out of their paths; none found is empty."""
    accept_duplicate_keys(spark)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "text"]])
    try:
        files = spark.read.text(pattern, wholetext=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    return files.select(
        *[F.regexp_extract(path, parts, i + 1).alias(n) for i, n in enumerate(names)],
        F.col("value").alias("text"),
    )


def _per_stage(spark: SparkSession, root: str, tail: str, parts: str, names: list[str]) -> DataFrame:
    frames = [
        _documents(spark, f"{root}/{folder}/{tail}", f"/{folder}/{parts}$", names).select(
            F.lit(stage).alias("stage"), *names, "text"
        )
        for stage, folder in STAGE_FOLDERS.items()
    ]
    return frames[0].unionByName(frames[1])


def read_run_records(spark: SparkSession, root: str) -> DataFrame:
    """(stage, job_name, text) of every job's run record."""
    return _per_stage(
        spark, root, f"*/{C.RUN_RECORD_FILE}", rf"([^/]+)/{C.RUN_RECORD_FILE}", ["job_name"]
    )


def read_trial_results(spark: SparkSession, root: str) -> DataFrame:
    """(stage, job_name, trial_name, text) of every trial's result."""
    return _per_stage(
        spark,
        root,
        f"*/*/{C.TRIAL_RESULT_FILE}",
        rf"([^/]+)/([^/]+)/{C.TRIAL_RESULT_FILE}",
        ["job_name", "trial_name"],
    )


def read_grading_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(job_name, trial_name, text) of every stored grading artifact."""
    tail = f"artifacts/app/grading_output/{C.GRADING_RESULT_FILE}"
    return _documents(
        spark,
        f"{root}/grading/*/*/{tail}",
        rf"/grading/([^/]+)/([^/]+)/{tail}$",
        ["job_name", "trial_name"],
    )


def _binary(spark: SparkSession, pattern: str) -> DataFrame | None:
    try:
        return spark.read.format("binaryFile").load(pattern)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def read_rubric_files(spark: SparkSession, root: str) -> DataFrame:
    """(course_id, assignment_id, path, content) of selectable and archived rubrics."""
    schema = "course_id string, assignment_id string, path string, content binary"
    combined = spark.createDataFrame([], schema)
    for tail in ("*.md", "archive/*.md"):
        files = _binary(spark, f"{root}/courses/*/rubrics/*/{tail}")
        if files is not None:
            where = r"/courses/([^/]+)/rubrics/([^/]+)/"
            combined = combined.unionByName(
                files.select(
                    F.regexp_extract("path", where, 1).alias("course_id"),
                    F.regexp_extract("path", where, 2).alias("assignment_id"),
                    "path",
                    "content",
                )
            )
    return combined


def read_file_manifest(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """(relpath, digest) of every file below a folder, hashed where it is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(f"{root}/{folder}")
    )
    relpath = F.regexp_extract("path", rf"/{folder}/(.*)$", 1)
    return files.select(relpath.alias("relpath"), F.sha2("content", 256).alias("digest"))


def submissions_of_paths(paths: DataFrame) -> DataFrame:
    """Distinct student submissions named by file paths below ``submissions/``."""
    where = r"/submissions/([^/]+)/([^/]+)/([^/]+)/."

    def part(index: int) -> Column:
        return F.regexp_extract("path", where, index)

    return (
        paths.where(F.col("path").rlike(where))
        .select(
            part(1).alias("course_id"), part(2).alias("student_id"), part(3).alias("assignment_id")
        )
        .distinct()
        .withColumn("item_id", F.concat_ws("/", "course_id", "student_id", "assignment_id"))
    )


def list_submissions(spark: SparkSession, root: str) -> DataFrame:
    """Student submissions of a data root; file contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(f"{root}/submissions")
    )
    return submissions_of_paths(files.select("path"))


def parse_students(lines: DataFrame) -> DataFrame:
    """Identity rows from CSV lines (without the header)."""
    ddl = ", ".join(f"{f.name} string" for f in schemas.STUDENTS.fields)
    return lines.select(F.from_csv("line", ddl).alias("s")).select("s.*")


def read_csv_table(spark: SparkSession, pattern: str, required: list[str]) -> DataFrame:
    """A CSV table with a header; a required column that is absent fails the read."""
    table = spark.read.option("header", "true").option("escape", '"').csv(pattern)
    named = [c.lstrip("\ufeff") for c in table.columns]
    table = table.toDF(*named)
    absent = [c for c in required if c not in named]
    if absent:
        raise ValueError(f"{pattern} lacks the columns {', '.join(absent)}")
    return table.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in required])


def read_students(spark: SparkSession, root: str, course: str = "*") -> DataFrame:
    return read_csv_table(
        spark, f"{root}/tables/{course}/students.csv", schemas.STUDENTS.fieldNames()
    )


def read_enrollments(spark: SparkSession, root: str, course: str) -> DataFrame:
    table = read_csv_table(
        spark, f"{root}/tables/{course}/enrollments.csv", schemas.ENROLLMENTS.fieldNames()
    )
    return table.withColumn("course_id", F.lit(course))


def checked_enrollments(rows: DataFrame) -> DataFrame:
    """Enrollment rows with their account key and the first problem of each."""
    account = username_key(F.col("lms_username"))
    any_blank = F.lit(False)
    for name in schemas.ENROLLMENTS.fieldNames():
        any_blank = any_blank | F.col(name).isNull() | is_blank(F.col(name))
    keyed = rows.withColumn("account", account).withColumn("blank", any_blank)
    repeated = (
        keyed.groupBy("course_id", "account")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .withColumn("repeated", F.lit(True))
        .drop("n")
    )
    return keyed.join(repeated, ["course_id", "account"], "left").select(
        "course_id",
        "account",
        F.trim("rubric").alias("rubric"),
        F.trim("source").alias("source"),
        F.when(F.col("blank"), "blank_field")
        .when(F.col("account") == "", "empty_username")
        .when(F.col("repeated"), "duplicate_username")
        .alias("problem"),
    )


def grade_column_of(headers: list[str]) -> tuple[str, str, float]:
    """(header, grade column, maximum) of a gradebook export's one grade column."""
    import math
    import re

    matches = [(h, re.fullmatch(C.GRADE_COLUMN_PATTERN.strip("^$"), h)) for h in headers
               if " Points Grade" in h]
    needed = {"Username", "End-of-Line Indicator"} - set(headers)
    if len(set(headers)) != len(headers) or needed or len(matches) != 1 or matches[0][1] is None:
        raise ValueError("the export needs Username, one numeric Points Grade column and "
                         "End-of-Line Indicator")  # fmt: skip
    header, match = matches[0]
    maximum = float(match[2])
    if not math.isfinite(maximum) or maximum <= 0:
        raise ValueError("the gradebook maximum must be finite and positive")
    return header, match[1], maximum


def roster_from_table(table: DataFrame) -> DataFrame:
    """Roster rows of a gradebook export with the first problem of each row."""
    _, grade_column, maximum = grade_column_of(table.columns)
    keyed = table.select(
        F.col("Username").alias("username"),
        username_key(F.col("Username")).alias("account"),
        F.col("End-of-Line Indicator").alias("row_end"),
    )
    repeated = (
        keyed.groupBy("account")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .withColumn("repeated", F.lit(True))
        .drop("n")
    )
    return keyed.join(repeated, "account", "left").select(
        "username",
        "account",
        F.lit(grade_column).alias("grade_column"),
        F.lit(maximum).alias("maximum"),
        F.when(F.coalesce("row_end", F.lit("")) != "#", "bad_row_end")
        .when(F.coalesce("account", F.lit("")) == "", "blank_username")
        .when(F.col("repeated"), "duplicate_username")
        .alias("problem"),
    )


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """A gradebook roster export; an empty one fails the release, not this read."""
    table = spark.read.option("header", "true").option("escape", '"').csv(path)
    return roster_from_table(table.toDF(*[c.lstrip("\ufeff") for c in table.columns]))
