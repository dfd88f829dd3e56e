from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import scalars as N
from gradeloom.operators import ingest, planning, release, uploads
from gradeloom.sources.records import grade_column_of


@pytest.mark.parametrize(
    ("policy", "base", "base_max", "bonus", "maximum", "points"),
    [
        ("scaled", 75.0, 100.0, 0.0, 100.0, 80.0),
        ("scaled", 97.0, 100.0, 0.0, 100.0, 100.0),
        ("scaled", 8.0, 10.0, 0.0, 20.0, 17.0),
        ("scaled", 9.7, 10.0, 1.0, 10.0, 11.0),
        ("scaled", 0.0, 10.0, 0.0, 100.0, 5.0),
        ("earned-points", 8.0, 11.0, 1.0, 10.0, 9.5),
        ("earned-points", 97.0, 110.0, 5.0, 100.0, 102.0),
        ("diagnostic", 9.0, 10.0, 1.0, 50.0, 10.0),
    ],
)
def test_score_policies(spark, policy, base, base_max, bonus, maximum, points):
    value = release.final_points(
        policy, F.lit(base), F.lit(base_max), F.lit(bonus), F.lit(maximum)
    )
    assert spark.range(1).select(value.alias("v")).first().v == pytest.approx(points)


def test_number_formats_equal_python(spark):
    values = [0.0, 85.0, 100000.0, 999999.5, 1e6, 1234567.0, 0.0001, 0.00001234, 66.66666666,
              -2.5, 0.1143375, 99.99995, 123.4565, 1e-7]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", N.format_general(F.col("v")).alias("g"), N.format_grade(F.col("v")).alias("n"))
    for row in rows.collect():
        assert row.g == f"{row.v:g}"
        assert row.n == f"{row.v:.6f}".rstrip("0").rstrip(".")


def test_gradebook_header():
    plain = ["Username", "HW1 Points Grade <Numeric MaxPoints:20 Weight:3>", "End-of-Line Indicator"]
    assert grade_column_of(plain)[1:] == ("HW1 Points Grade", 20.0)
    for bad in (
        plain[:2],
        [*plain, "HW2 Points Grade <Numeric MaxPoints:5>"],
        ["Username", "HW1 Points Grade <Numeric MaxPoints:0>", "End-of-Line Indicator"],
        ["Username", "HW1 Points Grade <Text>", "End-of-Line Indicator"],
    ):
        with pytest.raises(ValueError):
            grade_column_of(bad)


def test_pins_replace_only_their_student(make_trials):
    def final(trial, student, **more):
        return {
            "trial_name": trial, "item_id": f"C/{student}/HW1", "student_id": student,
            "submission_source": "student", "score_pct": 80.0, "context_config_name": "init",
            "context_config_identity": "id-init", "n_prior_gradings": 3, "prior_trials": "J/g", **more,
        }

    trials = make_trials(
        final("a", "S1"), final("b", "S1"), final("c", "S2"), final("d", "S2", n_prior_gradings=5),
        final("e", "S3", superseded=True), final("f", "S4", config_identity="other"),
    )
    candidates = release.candidate_judgments(trials, "C", ["HW1"], "judge", "init")
    assert [r.blocker for r in release.identity_blockers(candidates).collect()] == [
        "several_config_identity"
    ]
    chosen = release.eligible_judgments(candidates, 3, ["J/b"]).collect()
    assert sorted(r.trial_name for r in chosen) == ["b", "c", "f"]


def test_samples_are_nested(spark):
    rows = [("C", f"HW{i % 2}", f"S{i}") for i in range(40)] + [("C", "HW0", "_ref")]
    df = spark.createDataFrame(rows, "course_id string, assignment_id string, student_id string")

    def chosen(size):
        return {(r.assignment_id, r.student_id) for r in planning.hash_order_sample(df, size).collect()}

    assert chosen(3) < chosen(7) and len(chosen(7)) == 14


def test_merge_keeps_the_last_version_of_each_path(spark):
    rows = [
        ("K", "HW1", "9", "2025-09-01 10:00:00", "d1", "a.pdf", "1"),
        ("K", "HW1", "9", "2025-09-01 10:00:00", "d1", "data.csv", "5"),
        ("K", "HW1", "9", "2025-09-03 10:00:00", "d2", "a.pdf", "2"),
        ("K", "HW1", "9", "2025-09-04 10:00:00", "d3", "a.pdf", "2"),
        ("K", "HW1", "9", "2025-09-04 10:00:00", "d3", "b.pdf", "7"),
        ("K", "HW1", "9", "2025-09-02 10:00:00", "d4", "c.pdf", "7"),
    ]
    df = spark.createDataFrame(
        rows,
        "course_id string, assignment_id string, person_id string, at string, dir_name string, "
        "relpath string, digest string",
    ).withColumn("submitted_at", F.col("at").cast("timestamp_ntz"))
    survivors = uploads.surviving_files(df)
    kept = {r.relpath: (r.digest, r.dir_name) for r in survivors.collect()}
    assert kept == {"a.pdf": ("2", "d3"), "data.csv": ("5", "d1"), "b.pdf": ("7", "d3"),
                    "c.pdf": ("7", "d4")}
    versions = uploads.file_versions(df)
    (flags,) = uploads.merge_flags(versions, survivors).collect()
    assert flags.duplicate_reupload and flags.replaced_files and flags.merged_uploads
    assert flags.possible_stale_solution
    (replaced,) = uploads.replaced_files(versions).collect()
    assert (replaced.relpath, str(replaced.replaced_at)) == ("a.pdf", "2025-09-01 10:00:00")


def test_archive_names(spark):
    known = spark.createDataFrame(
        [("C", "HW05"), ("C", "EXAM1"), ("C", "PSO2"), ("C", "PSO02")],
        "course_id string, assignment_id string",
    )
    archives = spark.createDataFrame(
        [("C", n) for n in ("Homework 5.zip", "exam_1 (2).zip", "Problem Set 2.zip", "x.zip", "hw 9.zip")],
        "course_id string, archive string",
    )
    explicit = spark.createDataFrame([], "course_id string, archive string, assignment_id string")
    got = {r.archive: (r.assignment_id, r.error)
           for r in ingest.match_archives(archives, known, explicit).collect()}
    assert got == {
        "Homework 5.zip": ("HW05", None), "exam_1 (2).zip": ("EXAM1", None),
        "Problem Set 2.zip": (None, "ambiguous"), "x.zip": (None, "unparsed_name"),
        "hw 9.zip": (None, "no_match"),
    }


def test_keys_fold_case_as_unicode_does(spark):
    """Every character: two share a key exactly when full case folding makes them equal.

    Left out are those that Python's Unicode does not know, and the one put in for the
    dotless i.
    """
    rows = [(c,) for c in map(chr, range(1, 0x110000)) if unicodedata.category(c) not in ("Cn", "Cs") and c != "\ue000"]
    df = spark.createDataFrame(rows, "c string").select("c", N.case_folded(F.col("c")).alias("key"))
    by_key, by_fold = {}, {}
    for r in df.collect():
        by_key.setdefault(r.key, set()).add(r.c)
        by_fold.setdefault(r.c.casefold(), set()).add(r.c)
    assert {frozenset(g) for g in by_key.values()} == {frozenset(g) for g in by_fold.values()}


def test_names_link_beyond_lower_case(spark):
    pairs = [("Straße", "STRASSE"), ("ΟΔΟΣ", "οδος"), ("Ǆ", "ǆ"), ("oﬃce", "OFFICE"), ("İ", "i̇"), ("Groẞ", "gross")]
    df = spark.createDataFrame([*pairs, ("ı", "i")], "a string, b string")
    rows = df.select("a", (N.name_key(F.col("a")) == N.name_key(F.col("b"))).alias("same"),
                     (N.username_key(F.concat(F.lit("#"), "a")) == N.username_key(F.col("b"))).alias("user")).collect()
    assert [(r.same, r.user) for r in rows] == [(True, True)] * len(pairs) + [(False, False)]
