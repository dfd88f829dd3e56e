"""Sinks: report tables, scoped overwrites, one-document records."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import keys as K
from gradeloom.operators.review import priority_order
from gradeloom.sources.staging import Files, commit, finish, new_stage

REPORT_KEYS = {
    "trials": ["stage", *K.TRIAL],
    "criteria": K.TRIAL,
    "solve_summary": K.SOLVE,
    "grades_by_assignment": K.LADDER_ASSIGNMENT,
    "grades_by_course": K.LADDER_COURSE,
    "judge_quality": K.CONFIG,
    "student_grades": K.STUDENT,
    "class_distribution": K.CLASS,
    "grader_checks": K.STUDENT,
    "failure_accounting": [*K.STAGE_CONFIG, "outcome"],
    "ungraded_solve_trials": [*K.SOLVE, *K.TRIAL],
    "repeat_consistency": K.REPEAT,
    "repeat_scores": [*K.REPEAT, "score_pct"],
    "deviant_gradings": [*K.REPEAT, *K.TRIAL],
    "initial_gradings": [*K.REPEAT, "initial_trial"],
    "final_gradings": [*K.JUDGE, "final_trial"],
    "unseen_initial_gradings": ["judge_config_name", "judge_config_identity", *K.REPEAT, "initial_trial"],
    "near_timeouts": K.JOB_CONFIG,
}


def in_report_order(name: str, table: DataFrame) -> DataFrame:
    """The table by its keys, NULL last: a range-partitioned sort."""
    if name == "review_queue":
        return priority_order(table)
    order = [F.col(k).asc_nulls_last() for k in REPORT_KEYS[name]]
    if name == "criteria" and "position" in table.columns:
        return table.orderBy(*order, "position").drop("position")
    return table.orderBy(*order)


def write_report(tables: dict[str, DataFrame], target: str, kind: str = "csv") -> None:
    """Each table in its own folder below ``target``, in report order."""
    for name, table in tables.items():
        writer = in_report_order(name, table).write.mode("overwrite")
        if kind == "csv":
            writer = writer.option("header", "true").option("emptyValue", "")
        writer.format(kind).save(f"{target}/{name}")


# The characters that partition folders spell as a percent sign and hex digits.
_ESCAPED = {chr(i) for i in [*range(1, 32), 127]} | set("\"#%'*/:=?\\{[]^")


def _folder(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in value)


SCOPE = ["course_id", "assignment_id"]


def write_scoped(
    table: DataFrame, target: str, assignments: Iterable[tuple[str, str]] | None = None
) -> None:
    """Replace the (course, assignment) partitions in scope and no other.

    The scope is ``assignments``; rows outside it are an error of the caller and left out.
    A named assignment that the table has no rows for ends up empty. Without a scope it is
    whatever the table has rows for.

    The new partitions are staged beside the old ones, by one job for any number of names,
    and then put in their place by one commit. So ``table`` may read from ``target``, and a
    write that fails leaves the target as it was. ``read_scoped`` completes a write that was
    interrupted after its commit, and so does the next write.
    """
    spark = table.sparkSession
    finish(spark, target, writing=True)
    files, stage = Files(spark, target), new_stage()
    rows = table
    if assignments is not None:
        assignments = set(assignments)
        scope = spark.createDataFrame(list(assignments), "course_id string, assignment_id string")
        rows = table.join(scope, SCOPE, "left_semi")
    rows.write.partitionBy(*SCOPE).parquet(f"{target}/{stage}")
    folders = [
        f"{course}/{assignment}"
        for course in files.names(stage) if course.startswith("course_id=")
        for assignment in files.names(f"{stage}/{course}")
    ]
    if assignments is not None:
        named = {f"course_id={_folder(c)}/assignment_id={_folder(a)}" for c, a in assignments}
        if emptied := sorted(named.difference(folders)):
            # One file without rows, copied to every folder that ends up empty.
            table.drop(*SCOPE).limit(0).write.parquet(f"{target}/{stage}/_empty")
            for folder in emptied:
                files.copy(f"{stage}/_empty", f"{stage}/{folder}")
            folders += emptied
    commit(files, stage, folders)


def read_scoped(spark: SparkSession, target: str, ddl: str | None = None) -> DataFrame:
    """What ``write_scoped`` keeps in ``target``."""
    finish(spark, target)
    return (spark.read.schema(ddl) if ddl else spark.read).parquet(target)


def write_record(row: DataFrame, target: str) -> None:
    """A one-row record as a JSON document."""
    row.coalesce(1).write.mode("overwrite").json(target)


def write_gradebook(rows: DataFrame, target: str) -> None:
    """The upload file, in roster order of the username."""
    rows.orderBy("Username").write.mode("overwrite").option("header", "true").csv(target)


def file_digests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, length, sha256`` of every file of the given files and folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def row_digests(table: DataFrame) -> DataFrame:
    """``rows, rows_digest``: a digest of a table's rows as JSON, in any order and layout.

    The first 15 hexadecimal digits of each row's SHA-256, summed: equal tables have equal
    digests however they were partitioned.
    """
    row = F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"})
    number = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return table.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("rows_digest")
    )


def write_release(
    manifest: DataFrame, outputs: dict[str, DataFrame], target: str, name: str, inputs: Sequence[str] = ()
) -> None:
    """A release folder ``target/name`` that appears whole, its manifest written last.

    Every output is staged as CSV, read back and hashed file by file. The manifest has three
    parts, all as JSON lines: ``entries`` (the rows of ``manifest``), ``inputs`` (each file of
    the given paths with its digest) and ``outputs`` (each written file with its digest, and
    its table's row count and row digest). One rename then puts the folder in place; a write
    that fails before leaves nothing but staged files, which the next write drops.

    A name that is taken is an error: releases are never replaced. Hashing reads a file
    into one task, so files are bounded by what Spark writes to one (outputs) or by the
    caller (inputs).
    """
    spark = manifest.sparkSession
    finish(spark, target, writing=True)
    files, stage = Files(spark, target), new_stage()
    if files.exists(name):
        raise FileExistsError(f"{target}/{name}")
    folder = f"{target}/{stage}"
    described = None
    for output, table in outputs.items():
        table.write.option("header", "true").option("emptyValue", "").csv(f"{folder}/{output}")
        written = spark.read.option("header", "true").schema(table.schema).csv(f"{folder}/{output}")
        parts = file_digests(spark, [f"{folder}/{output}"]).select(
            F.lit(output).alias("output"), F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256"
        )
        part = parts.crossJoin(row_digests(written))
        described = part if described is None else described.unionByName(part)
    if described is not None:
        described.coalesce(1).write.json(f"{folder}/manifest/outputs")
    if inputs:
        file_digests(spark, inputs).write.json(f"{folder}/manifest/inputs")
    manifest.write.json(f"{folder}/manifest/entries")
    files.rename(stage, name)


def changed_files(spark: SparkSession, target: str, name: str) -> DataFrame:
    """Files of a release that are missing, new or other than its manifest says."""
    ddl = "output string, file string, length long, sha256 string, rows long, rows_digest string"
    told = spark.read.schema(ddl).json(f"{target}/{name}/manifest/outputs").select("output", "file", "sha256")
    outputs = [n for n in Files(spark, target).names(name) if n != "manifest"]
    found = file_digests(spark, [f"{target}/{name}/{n}" for n in outputs]).select(
        F.element_at(F.split("path", "/"), -2).alias("output"),
        F.element_at(F.split("path", "/"), -1).alias("file"),
        F.col("sha256").alias("found_sha256"),
    )
    both = told.join(found, ["output", "file"], "full_outer")
    return both.where(~F.col("sha256").eqNullSafe(F.col("found_sha256")))
