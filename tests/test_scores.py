from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom import schemas
from gradeloom.operators import accounting, ladder, lineage, quality, repeats, review, students


def solve_derived(trial, item, score, assignment="HW1", rubric="r"):
    return {
        "trial_name": trial, "item_id": item, "score_pct": score, "assignment_id": assignment,
        "rubric_sha256": rubric, "submission_source": "solve-trial", "solve_job_name": "SJ",
        "solve_trial_name": item, "solver_config_name": "solver", "solver_config_identity": "id-s",
    }


def attempt(trial, assignment, **more):
    return {
        "stage": "solve", "job_name": "SJ", "trial_name": trial, "assignment_id": assignment,
        "config_name": "solver", "config_identity": "id-s", "item_id": f"C/{assignment}", **more,
    }


LADDER = [
    solve_derived("g1", "t1", 90.0), solve_derived("g2", "t1", 100.0),
    solve_derived("g3", "t2", 80.0), solve_derived("g4", "t3", 60.0, "HW2"),
    attempt("t1", "HW1"), attempt("t2", "HW1"), attempt("t3", "HW2"), attempt("t4", "HW3"),
]


def test_assignment_mean_is_a_mean_of_item_means(make_trials):
    rows = {r.assignment_id: r for r in ladder.grades_by_assignment(make_trials(*LADDER)).collect()}
    assert rows["HW1"].mean_score_pct == pytest.approx(87.5)
    assert rows["HW1"].sd_score_pct == pytest.approx(math.sqrt(112.5))
    assert (rows["HW1"].n_solve_trials, rows["HW1"].n_gradings) == (2, 3)
    assert rows["HW2"].mean_score_pct == 60.0 and rows["HW2"].sd_score_pct is None


def test_course_mean_counts_attempts_and_needs_five_for_an_interval(make_trials):
    trials = make_trials(*LADDER)
    (row,) = ladder.grades_by_course(ladder.grades_by_assignment(trials), trials).collect()
    assert (row.n_assignments, row.n_assignments_total) == (2, 3)
    assert row.macro_mean_score_pct == pytest.approx(73.75)
    assert row.ci_low is None and row.ci_high is None


def test_mixed_rubrics_are_counted_not_averaged(make_trials):
    trials = make_trials(
        solve_derived("g1", "t1", 90.0, rubric="r1"), solve_derived("g2", "t2", 50.0, rubric="r2"),
        solve_derived("g3", "t3", 80.0, "HW2"),
    )
    (row,) = ladder.grades_by_course(ladder.grades_by_assignment(trials), trials).collect()
    assert (row.n_assignments, row.n_assignments_mixed_rubric, row.n_assignments_total) == (1, 1, 2)
    assert row.macro_mean_score_pct == 80.0


def _values(spark, scores):
    rows = [("s", f"HW{i}", x) for i, x in enumerate(scores)]
    return spark.createDataFrame(rows, "course_id string, assignment_id string, mean_score_pct double")


def test_bootstrap_is_repeatable_and_gated(spark):
    five = _values(spark, [60.0, 70.0, 80.0, 90.0, 100.0])
    (a,) = ladder.bootstrap_intervals(five, ["course_id"], "assignment_id").collect()
    (b,) = ladder.bootstrap_intervals(five.repartition(7), ["course_id"], "assignment_id").collect()
    assert a == b and 60 <= a.ci_low < 80 < a.ci_high <= 100
    four = _values(spark, [1.0, 2.0, 3.0, 4.0])
    assert ladder.bootstrap_intervals(four, ["course_id"], "assignment_id").count() == 0


def test_bootstrap_equals_its_definition(spark):
    values = _values(spark, [float(i * i) for i in range(9)])
    (a,) = ladder.bootstrap_intervals(values, ["course_id"], "assignment_id", resamples=500).collect()
    means = []
    for resample in range(500):
        picks = [
            int(hashlib.md5(f"42|s|{resample}|{i}".encode()).hexdigest()[:8], 16) % 9 for i in range(1, 10)
        ]
        means.append(sum(float(p * p) for p in picks) / 9)
    low, high = np.quantile(means, [0.025, 0.975])
    assert a.ci_low == pytest.approx(low) and a.ci_high == pytest.approx(high)


def graded(trial, item, score, **more):
    return {"trial_name": trial, "item_id": item, "score_pct": score, **more}


def criterion_rows(spark, *rows):
    names = schemas.CRITERIA.fieldNames()
    full = [
        tuple(
            {"job_name": "J", "trial_name": t, "criterion_id": c, "points": p, "max_points": 5.0,
             "bonus": False}.get(n)
            for n in names
        )
        for t, c, p in rows
    ]
    return spark.createDataFrame(full, schemas.CRITERIA)


def test_judge_quality(spark, make_trials):
    trials = make_trials(
        graded("x1", "X", 80.0, sums_consistent=True), graded("x2", "X", 90.0, sums_consistent=True),
        graded("x3", "X", 100.0, sums_consistent=False, late_exception=True),
        graded("y1", "Y", 70.0, grading_load_error=True),
        graded("z1", "Z", None, outcome="timeout"),
    )
    criteria = criterion_rows(
        spark, ("x1", "a", 5.0), ("x2", "a", 5.0), ("x3", "a", 4.0),
        ("x1", "b", 3.0), ("x2", "b", 2.0), ("x3", "b", 3.0), ("x1", "c", 1.0),
    )
    rubric = spark.createDataFrame(
        [], "course_id string, assignment_id string, sha256 string, criterion_id string, "
        "max_points double, bonus boolean"
    )
    (row,) = quality.judge_quality(trials, criteria, rubric).collect()
    assert row.mean_within_item_sd == pytest.approx(10.0) and row.max_within_item_range == 20.0
    assert row.criterion_exact_agreement_rate == pytest.approx(1 / 3)
    assert row.criterion_mean_abs_diff == pytest.approx(2 / 3)
    assert row.rubric_fidelity_rate is None and row.n_rubric_unresolved == 3
    assert row.sums_consistent_rate == pytest.approx(2 / 3)
    assert row.late_exception_rate == pytest.approx(1 / 5)
    assert row.grading_load_error_rate == pytest.approx(1 / 4)
    assert row.rate_completed == pytest.approx(4 / 5)


def test_agreement_shuffles_by_group_once(spark, make_trials):
    """Trials of one name and rows without a name meet as in a join."""
    trials = make_trials(
        *({"trial_name": name, "item_id": item, "score_pct": 1.0} for name, item in (
            ("a", "i"), ("a", "i"), ("a", "k"), ("b", "i"), (None, "i"), ("c", None), ("d", None), ("e", "i"),
        ))
    )
    criteria = spark.createDataFrame(
        [("J", "a", "c1", 1.0), ("J", "b", "c1", 3.0), ("J", "b", None, 3.0), ("J", "e", None, 7.0),
         ("J", None, "c1", 9.0), ("J", "c", "c1", 2.0), ("J", "d", "c1", 7.0), ("J", "x", "c1", 5.0)],
        "job_name string, trial_name string, criterion_id string, points double",
    )
    agreement = quality.criterion_agreement(trials, criteria)
    plan = agreement._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3  # by part, by group, by config
    (row,) = agreement.collect()
    # 1, 1, 3 on c1 of i; 3, 7 on its unnamed one; 2, 7 on c1 of no item.
    assert (row.n_pairs, row.criterion_exact_agreement_rate) == (5, pytest.approx(1 / 5))
    assert row.criterion_mean_abs_diff == pytest.approx((0 + 2 + 2 + 4 + 5) / 5)


def test_agreement_equals_all_pairs_within_tolerance(spark, make_trials):
    points = [1.0, 1.0 + 5e-10, 1.0 + 9e-10, 2.0, 2.0, 3.5, 1.0]
    trials = make_trials(*[graded(f"t{i}", "X", 50.0 + i) for i in range(len(points))])
    criteria = criterion_rows(spark, *[(f"t{i}", "a", p) for i, p in enumerate(points)])
    (row,) = quality.criterion_agreement(trials, criteria).collect()
    pairs = [(a, b) for i, a in enumerate(points) for b in points[i + 1 :]]
    assert row.n_pairs == len(pairs)
    assert row.criterion_mean_abs_diff == pytest.approx(sum(abs(a - b) for a, b in pairs) / len(pairs))
    exact = sum(abs(a - b) <= 1e-9 for a, b in pairs)
    assert row.criterion_exact_agreement_rate == pytest.approx(exact / len(pairs))


def test_repeat_consistency(make_trials):
    scores = {"x1": 90.0, "x2": 8.0, "x3": 95.0, "x4": 92.0, "x5": 97.0}
    (row,) = repeats.repeat_consistency(
        make_trials(*[graded(t, "X", s) for t, s in scores.items()])
    ).collect()
    assert (row.median_score_pct, row.range_score_pct, row.range_flagged) == (92.0, 89.0, True)
    assert row.n_deviant_gradings == 1


def test_repeat_thresholds_are_strict(make_trials):
    rows = [graded("a1", "A", 50.0), graded("a2", "A", 50.0), graded("a3", "A", 65.0),
            graded("b1", "B", 60.0), graded("b2", "B", 80.0)]
    table = {r.item_id: r for r in repeats.repeat_consistency(make_trials(*rows)).collect()}
    assert (table["A"].range_flagged, table["A"].n_deviant_gradings) == (False, 1)
    assert (table["B"].range_flagged, table["B"].n_deviant_gradings) == (False, 0)


def test_long_tables_hold_every_entry_of_a_large_group(spark, make_trials):
    n = 12_000
    one = make_trials(graded("t", "X", 0.0), initial("a", "A", 0.0), judged("f", "A", 75.0, ["a0"]))
    trials = (
        one.crossJoin(spark.range(n))
        .withColumn("trial_name", F.concat("trial_name", F.col("id").cast("string")))
        .withColumn("score_pct", (F.col("id") % 1000) / 3.0)
        .drop("id")
    )
    rows = {r.config_name + r.item_id: r for r in repeats.repeat_consistency(trials).collect()}
    row = rows["judgeX"]
    assert row.n_gradings == n and row.median_score_pct == pytest.approx(166.5)
    assert row.n_deviant_gradings == repeats.deviant_gradings(trials).where("item_id = 'X'").count() == n * 0.94
    assert repeats.repeat_scores(trials).where("item_id = 'X'").agg(F.sum("n")).first()[0] == n
    (queue,) = [r for r in review.review_queue(trials).collect() if r.item_id == "A"]
    assert (queue.n_initial_gradings, queue.n_final_gradings) == (n, n)
    assert review.initial_gradings(trials).where("item_id = 'A'").count() == n
    assert review.final_gradings(trials).where("item_id = 'A'").count() == n
    assert review.unseen_initial_gradings(trials).count() == queue.n_unseen_initial_gradings == n - 1


def initial(trial, item, score, **more):
    return graded(trial, item, score, config_name="init", config_identity="id-init", **more)


def judged(trial, item, score, priors, n=None, **more):
    names = "; ".join(f"J/{p}" for p in priors)
    return graded(
        trial, item, score, context_config_name="init", context_config_identity="id-init",
        prior_trials=names, n_prior_gradings=len(priors) if n is None else n,
        item_identity="K", **more,
    )


def test_review_queue_inside_and_outside(make_trials):
    trials = make_trials(
        initial("a1", "A", 60.0), initial("a2", "A", 90.0), judged("fa", "A", 75.0, ["a1", "a2"]),
        initial("b1", "B", 80.0), initial("b2", "B", 90.0),
        judged("f1", "B", 70.0, ["b1", "b2"]), judged("f2", "B", 74.0, ["b1", "b2"]),
        judged("f3", "B", 95.0, ["b1", "b2"]), initial("c1", "C", 50.0),
    )
    queue = {r.item_id: r for r in review.review_queue(trials).collect()}
    assert queue["A"].final_outside_range is False
    assert queue["A"].final_distance_outside_range_pct == 0.0
    assert queue["A"].prior_range_score_pct == 30.0
    assert queue["A"].review_reasons == "wide_initial_range"
    assert queue["B"].final_score_pct == 74.0 and queue["B"].final_outside_range is True
    assert queue["B"].final_distance_outside_range_pct == 6.0
    assert queue["C"].n_final_gradings == 0 and queue["C"].review_reasons is None


def test_review_queue_incomplete_lineage(make_trials):
    trials = make_trials(
        initial("a1", "A", 60.0), initial("a2", "A", 65.0), initial("a3", "A", 66.0),
        judged("fa", "A", 75.0, ["a1", "gone"], n=3), judged("fb", "B", 10.0, ["lost"]),
    )
    queue = {r.item_id: r for r in review.review_queue(trials).collect()}
    a, b = queue["A"], queue["B"]
    assert a.final_outside_range is None and a.prior_min_score_pct is None
    assert (a.n_resolved_prior_gradings, a.n_missing_prior_gradings) == (1, 2)
    unseen = {r.initial_trial for r in review.unseen_initial_gradings(trials).collect()}
    assert unseen == {"J/a2", "J/a3"} and a.n_unseen_initial_gradings == 2
    assert a.review_reasons == (
        "initial_not_in_judge_context; missing_prior_results; unresolved_prior_lineage"
    )
    assert b.n_initial_gradings == 0 and b.item_identity is None
    assert b.review_reasons == (
        "missing_prior_results; unresolved_prior_lineage; final_without_loaded_initial_group"
    )


def test_priority_order(make_trials):
    trials = make_trials(
        initial("a1", "A", 20.0), initial("a2", "A", 80.0), judged("fa", "A", 50.0, ["a1", "a2"]),
        initial("b1", "B", 50.0), judged("fb", "B", 60.0, ["b1"]),
        initial("c1", "C", 50.0), judged("fc", "C", 70.0, ["c1"]),
    )
    queue = review.review_queue(trials)
    assert [r.item_id for r in review.priority_order(queue).collect()] == ["C", "B", "A"]
    ranks = {r.item_id: r.priority_rank for r in review.priority_rank(queue).collect()}
    assert ranks == {"C": 1, "B": 2, "A": 3}


def test_priority_rank_of_fractions_is_the_priority_order(spark, make_trials):
    # Distances and ranges whose whole parts say nothing about their order.
    shape = {"x1": (0.9, 5.0), "x2": (0.5, 10.0), "x3": (0.2, 30.0), "x4": (1 / 3, 2 / 3), "x5": (1 / 3, 1 / 3)}
    empty = review.review_queue(make_trials())
    rows = [
        {"course_id": "C", "item_id": i, "final_outside_range": True,
         "final_distance_outside_range_pct": d, "initial_range_score_pct": r}
        for i, (d, r) in shape.items()
    ]
    names = empty.columns
    queue = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], empty.schema)
    ranks = {r.item_id: r.priority_rank for r in review.priority_rank(queue).collect()}
    assert ranks == {"x1": 1, "x2": 2, "x4": 3, "x5": 4, "x3": 5}
    assert [r.item_id for r in review.priority_order(queue).collect()] == sorted(ranks, key=ranks.get)


def judgments(spark, sets):
    rows = [("grade", "cfg", "i", g, "; ".join(p), 1.0) for g, p in sets]
    return spark.createDataFrame(
        rows,
        "stage string, config_identity string, item_id string, context_config_identity string, "
        "prior_trials string, score_pct double",
    )


@pytest.mark.parametrize("universe, longest", [(6, 6), (12, 5), (60, 4)])
def test_superseded_sets_equal_brute_force(spark, universe, longest):
    draw = random.Random(universe)
    names = [f"t{i}" for i in range(universe)]
    sets = [(draw.choice("ab"), draw.sample(names, draw.randint(1, longest))) for _ in range(400)]
    distinct = {(g, frozenset(p)) for g, p in sets}
    expected = {(g, p) for g, p in distinct if any(g == h and p < q for h, q in distinct)}
    found = lineage.superseded_sets(judgments(spark, sets)).collect()
    assert {(r.context_config_identity, frozenset(r.priors)) for r in found} == expected
    assert len(found) == len(expected)
    assert lineage.superseded_sets(judgments(spark, sets).where("false")).count() == 0


def test_sets_that_share_an_element_are_not_compared_in_pairs(spark, monkeypatch):
    """No set is inside another, and the rarest member of each is in 40 of them."""
    reached = []
    inside = lineage._inside
    monkeypatch.setattr(
        lineage, "_inside",
        lambda narrow, wide: (reached.append(1) or F.lit(True)) if wide == "wide" else inside(narrow, wide),
    )
    sets = [("a", ["x", "y", f"u{i % 40}", f"v{i // 40}", *([f"w{i}"] if i % 2 else [])]) for i in range(1600)]
    standing, probes = lineage._ranked_sets(judgments(spark, sets))
    assert probes.count() == len(sets) // 2
    pairs = [f.count() for f in lineage._found_by_prefix(probes, standing)]
    assert reached and sum(pairs) <= lineage.PAIRS_A_SET * len(sets)


def test_supersession_needs_a_valid_strict_superset(make_trials):
    trials = make_trials(
        judged("j1", "A", 50.0, ["g1", "g2"]), judged("j2", "A", 50.0, ["g1", "g2", "g3"]),
        judged("j3", "A", 50.0, ["g4"]), judged("j4", "A", None, ["g4", "g5"], outcome="timeout"),
        judged("j5", "A", 50.0, []),
    )
    marked = lineage.mark_superseded(trials).where("superseded").collect()
    assert [r.trial_name for r in marked] == ["j1"]


def test_student_grades_and_class_distribution(make_trials):
    trials = make_trials(
        graded("a", "A", 80.0, student_id="S1"), graded("b", "A", 90.0, student_id="S1"),
        graded("c", "A", None, student_id="S1", outcome="timeout"),
        graded("d", "B", 60.0, student_id="S2", superseded=True),
        graded("e", "R", 100.0, student_id="_reference"),
    )
    table = students.student_grades(trials)
    rows = {r.student_id: r for r in table.collect()}
    assert set(rows) == {"S1", "S2"}
    assert (rows["S1"].mean_score_pct, rows["S1"].n_failed_gradings) == (85.0, 1)
    assert (rows["S2"].n_superseded, rows["S2"].n_failed_gradings) == (1, 0)
    (dist,) = students.class_distribution(table).collect()
    assert (dist.n_students, dist.median, dist.q25, dist.sd) == (1, 85.0, 85.0, None)
    (check,) = students.grader_checks(trials).collect()
    assert (check.role, check.max_score_pct) == ("reference", 100.0)


def test_failure_accounting_has_every_outcome(make_trials):
    table = accounting.failure_accounting(make_trials(graded("a", "A", 1.0))).collect()
    assert len(table) == 7 and sum(r.n_trials for r in table) == 1


def test_empty_inputs_keep_their_columns(spark, make_trials):
    trials = make_trials()
    assert ladder.solve_summary(trials).count() == 0
    assert len(ladder.solve_summary(trials).columns) == 4 + 1 + 7 + 3
    assert review.review_queue(trials).columns == review.COLUMNS
    assert review.review_queue(trials).count() == 0
    conformed = schemas.conform(spark.createDataFrame([], "stage string"), schemas.TRIALS)
    assert conformed.columns == schemas.TRIALS.fieldNames() and len(conformed.columns) == 44


def test_consistency_and_queue_order_each_group_in_one_shuffle(spark, make_trials):
    """No step joins ranges of scores back to the rows, and the trials are read once."""
    scores = [10.0, 30.0, 70.0, 70.0]
    trials = make_trials(
        *({"trial_name": f"t{i}", "item_id": "X", "score_pct": x} for i, x in enumerate(scores))
    )
    table = repeats.repeat_consistency(trials)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    row = table.first()
    assert (row.n_gradings, row.median_score_pct, row.n_deviant_gradings) == (4, 50.0, 4)
