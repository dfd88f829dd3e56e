from __future__ import annotations

import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gradeloom import constants as C
from gradeloom.functions.scalars import duration_seconds
from gradeloom.operators import contract, planning, rubrics, trials
from gradeloom.plans import report
from gradeloom.sources import records, sinks
from gradeloom.streaming import doneness


def _write(path: Path, value) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def _artifact(points=8, **more):
    return {
        "schema_version": 1, "overall_comment": "ok", "base_points": points, "base_max": 10,
        "bonus_points": 0, "bonus_max": 0,
        "criteria": [{"id": "a", "title": "A", "points": points, "max_points": 10, "evidence": "e"}],
        **more,
    }


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("data")
    item = {"item_id": "C/HW1", "item_identity": "I", "course_id": "C", "assignment_id": "HW1",
            "task_dir_name": "t"}
    _write(base / "solving/s1/aat-run.json",
           {"stage": "solve", "config": {"name": "solver", "model": "m"}, "config_identity": "cs",
            "items": [item]})
    _write(base / "solving/s1/r1/result.json",
           {"task_name": "t", "verifier_result": {"rewards": {"reward": 1}}})
    grade = {**item, "item_id": "s1/r1", "submission_source": "solve-trial", "solve_job_name": "s1",
             "solve_trial_name": "r1", "input_hashes": {"rubric": "abc"}}
    _write(base / "grading/g1/aat-run.json",
           {"stage": "grade", "config": {"name": "grader", "rubric": "default"},
            "config_identity": "cg", "items": [grade]})
    full = {
        "task_name": "t", "verifier_result": {"rewards": {"reward": 80, "base_pct": 80}},
        "config": {"timeout_multiplier": 2},
        "agent_result": {"n_input_tokens": 12345, "n_cache_tokens": 2345, "n_output_tokens": 678,
                         "cost_usd": 0.1234},
        "environment_setup": {"started_at": "2026-01-01T00:00:00Z", "finished_at": "2026-01-01T00:00:30.5Z"},
        "agent_execution": {"started_at": "2026-01-01T00:01:00Z", "finished_at": "2026-01-01T00:11:00Z"},
        "exception_info": {"exception_type": "AgentTimeoutError"},
    }
    _write(base / "grading/g1/x1/result.json", full)
    _write(base / "grading/g1/x1/artifacts/app/grading_output/grading_result.json", _artifact())
    _write(base / "grading/g1/x2/result.json", {**full, "exception_info": None})
    _write(base / "grading/g1/x3/result.json", {"task_name": "t", "exception_info": {"exception_type": "ApiError"}})
    _write(base / "grading/g1/x4/result.json", "{broken")
    _write(base / "grading/g1/x5/result.json", {"task_name": "unclaimed"})
    _write(base / "grading/wrong/aat-run.json", {"stage": "solve", "items": [item]})
    _write(base / "grading/wrong/y/result.json", full)
    _write(base / "courses/C/rubrics/HW1/default.md", "- `a` (10 points): A\n")
    _write(base / "courses/C/rubrics/HW1/archive/old.md", "- `a` (10 points): A\n")
    _write(base / "submissions/C/S1/HW1/src/main.py", "x")
    _write(base / "tables/C/students.csv",
           "student_id,course_id,lms_person_id,lms_username,display_name,source\n"
           'S001,C,9,ann,"Ann, B",brightspace\n')  # fmt: skip
    return str(base)


def _load(spark, root):
    settings = spark.createDataFrame(
        [("g1", "t", 600.0)], "job_name string, task_name string, timeout_sec double"
    )
    return trials.load_tables(
        records.read_run_records(spark, root),
        records.read_trial_results(spark, root),
        records.read_grading_artifacts(spark, root),
        settings,
    )


def test_loading_a_data_root(spark, root):
    table, criteria = _load(spark, root)
    rows = {(r.job_name, r.trial_name): r for r in table.collect()}
    assert set(rows) == {("s1", "r1"), ("g1", "x1"), ("g1", "x2"), ("g1", "x3")}
    x1, x2, x3 = (rows["g1", f"x{i}"] for i in (1, 2, 3))
    assert (x1.outcome, x1.late_exception, x1.score_pct, x1.sums_consistent) == ("completed", True, 80.0, True)
    assert (x1.n_input_tokens, x1.cost_usd) == (12345, 0.1234)
    assert (x1.environment_setup_sec, x1.agent_execution_sec, x1.agent_timeout_sec) == (30.5, 600.0, 1200.0)
    assert (x1.solver_config_name, x1.solver_config_identity, x1.solver_model) == ("solver", "cs", "m")
    assert (x1.rubric_name, x1.rubric_sha256) == ("default", "abc")
    assert x2.grading_load_error and x2.score_pct == 80.0 and x2.sums_consistent is None
    assert (x3.outcome, x3.score_pct, x3.reward) == ("agent_error", None, None)
    assert [(r.trial_name, r.criterion_id, r.points) for r in criteria.collect()] == [("x1", "a", 8.0)]


def test_a_trial_meets_its_artifact_in_one_join(spark, root, tmp_path):
    """Who is replaced is marked before the join, so artifacts are parsed once for all trials."""
    records.read_grading_artifacts(spark, root).write.parquet(f"{tmp_path}/stored_artifacts")
    settings = spark.createDataFrame(
        [("g1", "t", 600.0)], "job_name string, task_name string, timeout_sec double"
    )
    table, criteria = trials.load_tables(
        records.read_run_records(spark, root),
        records.read_trial_results(spark, root),
        spark.read.parquet(f"{tmp_path}/stored_artifacts"),
        settings,
    )
    for rows in (table, criteria):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"FileScan parquet \[[^\]]*\btext#", plan)) == 1
    assert table.count() == 4 and criteria.count() == 1


def test_a_root_without_results_is_empty(spark, tmp_path):
    table, criteria = _load(spark, str(tmp_path))
    assert table.count() == 0 and criteria.count() == 0 and len(table.columns) == 44


def test_other_sources(spark, root):
    (version,) = rubrics.rubric_versions(records.read_rubric_files(spark, root)).collect()
    assert version.path.endswith("/HW1/default.md")
    (work,) = records.list_submissions(spark, root).collect()
    assert work.item_id == "C/S1/HW1"
    (student,) = records.read_students(spark, root).collect()
    assert student.display_name == "Ann, B"
    manifest = records.read_file_manifest(spark, root, "submissions/C/S1/HW1").collect()
    assert [r.relpath for r in manifest] == ["src/main.py"]
    with pytest.raises(ValueError):
        records.read_csv_table(spark, f"{root}/tables/C/students.csv", ["nope"])


def test_report_and_scoped_overwrite(spark, root, tmp_path):
    table, criteria = _load(spark, root)
    rubric = spark.createDataFrame(
        [], "course_id string, assignment_id string, sha256 string, criterion_id string, "
        "max_points double, bonus boolean"
    )
    tables = report.report_tables(table, criteria, rubric)
    assert len(tables) == 19
    sinks.write_report(tables, str(tmp_path / "out"))
    written = spark.read.option("header", "true").csv(str(tmp_path / "out/grades_by_assignment"))
    assert written.first().mean_score_pct == "80.0"
    sinks.write_record(report.provenance(table, criteria), str(tmp_path / "record"))
    assert spark.read.json(str(tmp_path / "record")).first().n_trials == 4

    target = str(tmp_path / "scoped")
    ddl = "course_id string, assignment_id string, status string"
    both = [("C", "HW1", "old"), ("C", "HW2", "old")]
    sinks.write_scoped(spark.createDataFrame(both, ddl), target)
    sinks.write_scoped(spark.createDataFrame([("C", "HW1", "new")], ddl), target)
    got = {(r.assignment_id, r.status) for r in spark.read.parquet(target).collect()}
    assert got == {("HW1", "new"), ("HW2", "old")}
    odd = [("C", "HW1"), ("C", "HW2"), ("C", "a/b: 100%")]
    sinks.write_scoped(spark.createDataFrame([("C", "a/b: 100%", "odd")], ddl), target)
    sinks.write_scoped(spark.createDataFrame([("C", "HW2", "newer")], ddl), target, odd)
    got = {(r.assignment_id, r.status) for r in spark.read.schema(ddl).parquet(target).collect()}
    assert got == {("HW2", "newer")}


def test_names_with_plus_percent_and_space_are_kept(spark, tmp_path):
    names = ["a+b", "a b", "a%20b", "a%b"]
    for name in names:
        folder = tmp_path / "solving" / name
        folder.mkdir(parents=True)
        (folder / C.RUN_RECORD_FILE).write_text("{}")
    got = {r.job_name for r in records.read_run_records(spark, str(tmp_path)).collect()}
    assert got == set(names)


def test_repeated_keys_are_read_without_a_file_reader(spark):
    spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
    rows = [("solve", "J", '{"stage": "grade", "stage": "solve", "config": {}}'), ("solve", "K", '{"stage": "solve"}')]
    records_ = trials.parse_run_records(spark.createDataFrame(rows, "stage string, job_name string, text string"))
    assert {r.job_name for r in records_.select("job_name").collect()} == {"J", "K"}


def test_a_root_below_an_archive_folder_archives_nothing(spark):
    base = "/archive/root/courses/C/rubrics/HW1"
    rows = [("C", "HW1", f"{base}/zz.md", b"x"), ("C", "HW1", f"{base}/archive/aa.md", b"x")]
    files = spark.createDataFrame(rows, "course_id string, assignment_id string, path string, content binary")
    assert rubrics.rubric_versions(files).first().path == f"{base}/zz.md"


def _errors(spark, *documents):
    rows = [("J", f"t{i:02d}", d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    df = spark.createDataFrame(rows, "job_name string, trial_name string, text string")
    return [list(r.errors) for r in contract.parse_artifacts(df).orderBy("trial_name").collect()]


def _with(**change):
    criterion = {**_artifact()["criteria"][0], **change}
    return _artifact(criteria=[criterion])


def test_artifact_contract(spark):
    found = _errors(
        spark, _artifact(), "{", "[1]", {}, _artifact(schema_version=True), _artifact(criteria=[]),
        _with(id=5), _with(title=" "), _with(points=True), _with(points=11), _with(max_points="10"),
        _with(bonus=None), _with(bonus=True), _artifact(criteria=["x"]), _artifact(overall_comment=3),
    )
    first = "criteria[0]:"
    assert found == [
        [], ["not_json"], ["not_an_object"],
        ["missing_schema_version", "missing_criteria", "missing_overall_comment"],
        ["schema_version"], ["criteria_empty"], [first + "id"], [first + "title"],
        [first + "points"], [first + "points_range"], [first + "max_points"], [first + "bonus"],
        ["no_base_criterion"], [first + "not_an_object"], ["overall_comment"],
    ]


def test_artifact_sums_tolerance_and_non_finite(spark):
    near = _artifact(base_points=8 + 5e-7)
    far = _artifact(base_points=8.1)
    absent = _artifact()
    del absent["bonus_max"]
    nan = json.dumps(_artifact()).replace('"base_points": 8', '"base_points": NaN')
    bad_points = json.dumps(_artifact()).replace('"points": 8', '"points": Infinity')
    texts = [json.dumps(near), json.dumps(far), json.dumps(absent), nan, bad_points]
    df = spark.createDataFrame(
        [("J", f"t{i}", t) for i, t in enumerate(texts)],
        "job_name string, trial_name string, text string",
    )
    rows = contract.parse_artifacts(df).orderBy("trial_name").collect()
    assert [r.sums_consistent for r in rows] == [True, False, False, False, None]
    assert rows[3].score_pct == 80.0 and list(rows[4].errors) == ["criteria[0]:points"]


def test_durations(spark):
    rows = [
        ("2026-01-01T00:00:00Z", "2026-01-01T00:00:05.25+00:00", 5.25),
        ("2026-01-01T00:00:00", "2026-01-01T01:00:00", 3600.0),
        ("2026-01-01T02:00:00+02:00", "2026-01-01T00:00:01Z", 1.0),
        ("2026-01-01T00:00:00", "2026-01-01T00:00:05Z", None),
        ("yesterday", "2026-01-01T00:00:05Z", None),
    ]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    for row in df.select("want", duration_seconds(F.col("a"), F.col("b")).alias("got")).collect():
        assert row.got == row.want


def test_rubric_parser(spark):
    texts = [
        "# R\r\n- `slope` (8 points): Slope\n  - `x` (2.5  points , bonus): X \n- plain",
        "- `a` (1 point): A\n- `a` (2 points): B", "prose only", "- `b` (1 point, bonus): B",
        "- `c`(1 point): C",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = rubrics.parse_rubrics(df).orderBy("i").collect()
    assert [(c.id, c.title, c.max_points, c.bonus) for c in rows[0].criteria] == [
        ("slope", "Slope", 8.0, False), ("x", "X", 2.5, True),
    ]
    assert [list(r.errors) for r in rows] == [
        [], ["line 2: duplicate_id"], ["no_criteria"], ["all_bonus"], ["line 1: format"],
    ]


def test_a_rubric_text_is_split_once(spark):
    df = spark.createDataFrame([("- `a` (1 point): A",)], "text string")
    plan = rubrics.parse_rubrics(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_an_item_is_read_once_and_its_document_has_one_check(spark):
    item = '{"task_dir_name": "t", "item_id": "X"}'
    texts = [f'{{"stage": "grade", "items": [{item}, 5, {{"item_id": "unnamed"}}]}}', f'[{item}]', '"grade"', "{", None]
    docs = spark.createDataFrame([("grade", f"J{i}", t) for i, t in enumerate(texts)], "stage string, job_name string, text string")
    items = trials.record_items(trials.parse_run_records(docs))
    assert [(r.job_name, r.task_name, r.item_id) for r in items.collect()] == [("J0", "t", "X")]
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructField(task_dir_name") == 1 and plan.count("schemaOfVariant(try_variant_get(doc") == 1


def test_a_batch_reads_nothing_of_the_earlier_ones(spark, make_trials, tmp_path, monkeypatch):
    source, table, progress = (str(tmp_path / n) for n in ("trials", "table", "progress"))

    def fold(*rows):
        make_trials(*rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(make_trials().schema).parquet(source)
        doneness.fold_trials(stream, "grade", table, progress).awaitTermination()

    def unread(*_):
        raise AssertionError("the table was read")

    unnamed = {"trial_name": None, "item_id": "U"}
    monkeypatch.setattr(doneness, "stored_trials", unread)
    fold({"trial_name": "a", "item_id": "X"}, unnamed, unnamed)
    fold({"trial_name": "a", "item_id": "Y"}, {"trial_name": "b", "item_id": "Y"}, unnamed)
    monkeypatch.undo()
    # The first batch tells a trial's item; a trial without a name counts once a batch.
    assert sorted((r.item_id, r.existing) for r in doneness.stored_totals(spark, table).collect()) == [("U", 2), ("X", 1), ("Y", 1)]


def test_streamed_doneness_equals_the_batch(spark, make_trials, tmp_path):
    rows = [{"trial_name": f"t{i}", "item_id": f"X{i % 4}", "outcome": "completed" if i % 3 else "timeout"}
            for i in range(24)]
    source = str(tmp_path / "trials")
    make_trials(*rows[:12]).write.parquet(source)
    table, progress = str(tmp_path / "table"), str(tmp_path / "progress")

    def fold():
        stream = spark.readStream.schema(make_trials().schema).parquet(source)
        doneness.fold_trials(stream, "grade", table, progress).awaitTermination()

    fold()
    # The rest arrives with some trials repeated and one retried until it was valid.
    retried = {**rows[0], "outcome": "completed"}
    make_trials(*rows[6:], retried).write.mode("append").parquet(source)
    fold()
    want = planning.done_totals(make_trials(*rows[1:], retried), "grade")
    got = doneness.stored_totals(spark, table)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stateful_totals_count_each_trial_once(spark, make_trials, tmp_path):
    source = str(tmp_path / "trials")
    make_trials({"trial_name": "a", "item_id": "X"}, {"trial_name": "b", "item_id": "X"}).write.parquet(source)
    make_trials({"trial_name": "a", "item_id": "X"}).write.mode("append").parquet(source)
    stream = spark.readStream.schema(make_trials().schema).parquet(source)
    query = (
        doneness.running_totals(stream, "grade").writeStream.outputMode("complete")
        .format("memory").queryName("totals").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert [(r.item_id, r.existing) for r in spark.table("totals").collect()] == [("X", 2)]
