"""Grade release: routing, eligible judgments, decisions, score policies."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import constants as C
from gradeloom.functions.predicates import is_pseudo, is_stage, known
from gradeloom.functions.scalars import format_grade, is_blank, username_key
from gradeloom.operators.repeats import trial_ref


def final_points(policy: str, base: Column, base_max: Column, bonus: Column, maximum: Column) -> Column:
    """Points under a score policy.

    ``scaled`` adds the allowance to the base before scaling to the maximum,
    ``earned-points`` tops up what was earned, ``diagnostic`` leaves it alone.
    """
    earned = base + bonus
    if policy == "diagnostic":
        return earned
    if policy == "earned-points":
        return earned + adjustment_points(policy, base, base_max, bonus, maximum)
    if policy != "scaled":
        raise ValueError(f"unknown score policy {policy!r}")
    adjusted = base + adjustment_points(policy, base, base_max, bonus, maximum)
    return (adjusted + bonus) / base_max * maximum


def adjustment_points(
    policy: str, base: Column, base_max: Column, bonus: Column, maximum: Column
) -> Column:
    """The allowance a policy grants, in rubric points."""
    if policy == "diagnostic":
        return F.lit(0.0)
    if policy == "earned-points":
        short = F.greatest(F.lit(0.0), maximum - (base + bonus))
        return F.least(C.BASE_ADJUSTMENT_FRACTION * maximum, short)
    return F.least(base + C.BASE_ADJUSTMENT_FRACTION * base_max, base_max) - base


def route_rubrics(
    requests: DataFrame, assessments: DataFrame, students: DataFrame, enrollments: DataFrame
) -> DataFrame:
    """Rubric of each request (course, assignment, student, requested, explicit).

    An assignment without declared rubrics keeps the requested one. Otherwise the
    student's one enrollment row decides, and the first failing check is named.
    """
    declared = assessments.select(
        "course_id", F.col("id").alias("assignment_id"), F.col("rubrics").alias("eligible")
    )
    by_id = students.groupBy("course_id", "student_id").agg(
        F.count(F.lit(1)).alias("n_identities"),
        F.min(username_key(F.col("lms_username"))).alias("account"),
    )
    by_account = students.groupBy(
        "course_id", username_key(F.col("lms_username")).alias("account")
    ).agg(F.count(F.lit(1)).alias("n_accounts"))
    enrolled = enrollments.select(
        "course_id",
        username_key(F.col("lms_username")).alias("account"),
        F.trim("rubric").alias("enrolled"),
    )
    joined = (
        requests.join(declared, ["course_id", "assignment_id"], "left")
        .join(by_id, ["course_id", "student_id"], "left")
        .join(by_account, ["course_id", "account"], "left")
        .join(enrolled, ["course_id", "account"], "left")
    )
    nobody = F.col("student_id").isNull() | is_pseudo()
    requested_ok = known(F.array_contains("eligible", F.col("requested")))
    reason = (
        F.when(F.col("eligible").isNull(), F.lit(None))
        .when(nobody, F.when(~(F.col("explicit") & requested_ok), "no_enrolled_student"))
        .when(~known(F.col("n_identities") == 1), "identity_missing_or_conflicting")
        .when(
            is_blank(F.col("account")) | ~known(F.col("n_accounts") == 1),
            "username_missing_or_conflicting",
        )
        .when(F.col("enrolled").isNull(), "not_enrolled")
        .when(~known(F.array_contains("eligible", F.col("enrolled"))), "rubric_not_eligible")
        .when(
            F.col("explicit") & (F.col("requested") != F.col("enrolled")),
            "request_conflicts_with_enrollment",
        )
    )
    rubric = F.when(F.col("eligible").isNull() | nobody, F.col("requested")).otherwise(
        F.col("enrolled")
    )
    return joined.select(
        "course_id",
        "assignment_id",
        "student_id",
        F.when(reason.isNull(), rubric).alias("rubric"),
        F.col("eligible").isNotNull().alias("routed"),
        reason.alias("reason"),
    )


def candidate_judgments(
    trials: DataFrame,
    course_id: str,
    assignments: Sequence[str],
    config: str,
    context: str,
    config_identity: str | None = None,
    context_identity: str | None = None,
) -> DataFrame:
    """Final judgments of the wanted config over the wanted initial config."""
    rows = trials.where(
        is_stage("grade")
        & known(F.col("submission_source") == "student")
        & known(F.col("course_id") == course_id)
        & known(F.col("assignment_id").isin(list(assignments)))
        & known(F.col("config_name") == config)
        & known(F.col("context_config_name") == context)
        & F.col("config_identity").isNotNull()
        & F.col("context_config_identity").isNotNull()
    )
    if config_identity is not None:
        rows = rows.where(F.col("config_identity") == config_identity)
    if context_identity is not None:
        rows = rows.where(F.col("context_config_identity") == context_identity)
    return rows


def identity_blockers(candidates: DataFrame) -> DataFrame:
    """Several config or context identities among the candidates, as blocker rows."""
    rows = None
    for column in ("config_identity", "context_config_identity"):
        part = (
            candidates.agg(F.min(column).alias("low"), F.max(column).alias("high"))
            .where(F.col("low") != F.col("high"))
            .select(F.lit(f"several_{column}").alias("blocker"), F.col("low").alias("subject"))
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def eligible_judgments(
    candidates: DataFrame, gradings: int, pinned: Iterable[str] = ()
) -> DataFrame:
    """Current judgments over exactly ``gradings`` priors; a pin replaces its student's."""
    rows = candidates.where(
        known(F.col("n_prior_gradings") == gradings)
        & ~known(F.col("superseded"))
        & known(F.col("outcome") == "completed")
        & ~known(F.col("grading_load_error"))
    ).withColumn("reference", trial_ref())
    pinned = list(pinned)
    if not pinned:
        return rows
    is_pinned = F.col("reference").isin(pinned)
    settled = rows.where(is_pinned).select("student_id").distinct()
    others = rows.join(settled, "student_id", "left_anti")
    return others.unionByName(rows.where(is_pinned).select(*others.columns))


def unknown_pins(candidates: DataFrame, gradings: int, pinned: DataFrame) -> DataFrame:
    """Pinned references that are no eligible judgment (``pinned``: reference)."""
    return pinned.join(eligible_judgments(candidates, gradings), "reference", "left_anti")


def release_decisions(
    roster: DataFrame,
    submissions: DataFrame,
    students: DataFrame,
    normalized: DataFrame,
    judgments: DataFrame,
    routing: DataFrame,
    known_work: DataFrame,
    policy: str = "scaled",
    zero_missing: bool = False,
    can_exceed: bool = False,
) -> DataFrame:
    """One row per recipient: graded, zero_missing or unresolved with its first reason.

    Inputs, all of one course:

    - ``roster``: username, maximum;
    - ``submissions``: assignment_id, person_id, username, sha256, folder;
    - ``students``: student_id, lms_person_id, lms_username;
    - ``normalized``: student_id, assignment_id, sha256 of the ingested work;
    - ``judgments``: student_id, assignment_id, reference, rubric_name,
      rubric_sha256 and what its record says: n_items, graded_sha256,
      rubric_intact, contract_valid, base_points, base_max, bonus_points;
    - ``routing``: student_id, assignment_id, routed, rubric, reason,
      current_sha256 of the rubric that applies now;
    - ``known_work``: student_id of everyone with stored work or gradings.
    """
    key = username_key(F.col("username"))
    accounts = students.where(~is_blank(F.col("lms_username"))).select(
        username_key(F.col("lms_username")).alias("account"), "student_id", "lms_person_id"
    )
    handed_in = submissions.select(
        key.alias("account"),
        "assignment_id",
        "person_id",
        F.col("sha256").alias("download_sha256"),
        "folder",
    )
    stored = normalized.select(
        "student_id", "assignment_id", F.col("sha256").alias("stored_sha256")
    )
    routes = routing.select(
        "student_id",
        "assignment_id",
        "routed",
        F.col("rubric").alias("routed_rubric"),
        F.col("reason").alias("routing_reason"),
        "current_sha256",
    )
    work = ["student_id", "assignment_id"]
    routed = known(F.col("routed"))
    fits = ~routed | known(
        (F.col("rubric_name") == F.col("routed_rubric"))
        & (F.col("rubric_sha256") == F.col("current_sha256"))
    )
    facts = F.struct(
        "reference", "n_items", "graded_sha256", "rubric_intact", "contract_valid",
        "base_points", "base_max", "bonus_points",
    )
    judged = (
        judgments.join(routes, work, "left")
        .where(fits)
        .groupBy(*work)
        .agg(F.count(F.lit(1)).alias("n_judgments"), F.min(facts).alias("judgment"))
    )
    seen = known_work.select("student_id").distinct().withColumn("known_work", F.lit(True))
    joined = (
        roster.withColumn("account", key)
        .join(accounts, "account", "left")
        .join(handed_in, "account", "left")
        .join(stored, work, "left")
        .join(routes, work, "left")
        .join(judged, work, "left")
        .join(seen, "student_id", "left")
    )
    judgment = {c: F.col(f"judgment.{c}") for c in ("base_points", "base_max", "bonus_points")}
    points = final_points(
        policy, judgment["base_points"], judgment["base_max"], judgment["bonus_points"],
        F.col("maximum"),
    )
    has_work = known(F.col("known_work"))
    absent = F.col("download_sha256").isNull()
    confirmed_zero = absent & ~has_work & F.lit(zero_missing)
    reason = (
        F.when(confirmed_zero, "confirmed_no_submission")
        .when(absent & has_work, "download_omits_known_submission")
        .when(absent, "no_submission_in_download")
        .when(~known(F.col("lms_person_id") == F.col("person_id")), "identity_missing_or_mismatched")
        .when(
            ~known(F.col("stored_sha256") == F.col("download_sha256")),
            "download_differs_from_stored_work",
        )
        .when(routed & F.col("routing_reason").isNotNull(), F.col("routing_reason"))
        .when(routed & F.col("current_sha256").isNull(), "missing_current_rubric")
        .when(F.col("n_judgments").isNull(), "no_current_judgment")
        .when(F.col("n_judgments") > 1, "several_judgments")
        .when(F.col("judgment.n_items") != 1, "judgment_item_not_unique")
        .when(
            ~known(F.col("judgment.graded_sha256") == F.col("download_sha256")),
            "judgment_of_other_work",
        )
        .when(~known(F.col("judgment.rubric_intact")), "rubric_missing_or_changed")
        .when(~known(F.col("judgment.contract_valid")), "judgment_breaks_contract")
        .when(points.isNull() | F.isnan(points) | (F.abs(points) == float("inf")), "grade_not_finite")
        .when((points > F.col("maximum")) & ~F.lit(can_exceed), "grade_exceeds_maximum")
    )
    status = (
        F.when(reason == "confirmed_no_submission", "zero_missing")
        .when(reason.isNotNull(), "unresolved")
        .otherwise("graded")
    )
    return joined.withColumn("reason", reason).withColumn("status", status).select(
        "username",
        "assignment_id",
        "status",
        "reason",
        F.when(F.col("status") == "graded", format_grade(points))
        .when(F.col("status") == "zero_missing", "0")
        .alias("grade"),
        *[
            F.when(F.col("status") == "graded", value).alias(name)
            for name, value in (
                ("student_id", F.col("student_id")),
                ("trial", F.col("judgment.reference")),
                ("folder", F.col("folder")),
                ("submission_sha256", F.col("download_sha256")),
                ("rubric_base_max", judgment["base_max"]),
                ("raw_earned_points", judgment["base_points"] + judgment["bonus_points"]),
                (
                    "rubric_base_adjustment_points",
                    adjustment_points(
                        policy, judgment["base_points"], judgment["base_max"],
                        judgment["bonus_points"], F.col("maximum"),
                    ),
                ),
            )
        ],
    )


def release_blockers(
    submissions: DataFrame, roster: DataFrame, students: DataFrame, decisions: DataFrame,
    allow_partial: bool = False, has_destination: bool = False,
) -> DataFrame:
    """Everything that stops a whole release, as (blocker, subject) rows."""
    account = username_key(F.col("username"))
    handed_in = submissions.withColumn("account", account)
    listed = roster.select(account.alias("account"))

    def rows(df: DataFrame, blocker: str, subject: Column) -> DataFrame:
        return df.select(F.lit(blocker).alias("blocker"), subject.cast("string").alias("subject"))

    def repeated(df: DataFrame, column: Column) -> DataFrame:
        return df.groupBy(column.alias("subject")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    parts = [
        rows(handed_in.join(listed, "account", "left_anti"), "submitter_not_on_roster", F.col("account")),
        rows(repeated(handed_in, F.col("account")), "duplicate_student", F.col("subject")),
        rows(repeated(handed_in, F.col("person_id")), "duplicate_person", F.col("subject")),
        rows(
            repeated(
                students.where(~is_blank(F.col("lms_username"))), username_key(F.col("lms_username"))
            ),
            "identity_conflict",
            F.col("subject"),
        ),
        rows(repeated(students, F.col("student_id")), "identity_conflict", F.col("subject")),
    ]
    if not has_destination:
        placeholder = F.split("folder", " - ")[0].endswith("-0")
        parts.append(rows(submissions.where(placeholder), "placeholder_assignment", F.col("folder")))
    if not allow_partial:
        unresolved = decisions.where(F.col("status") == "unresolved")
        parts.append(rows(unresolved, "unresolved_recipient", F.col("username")))
    included = decisions.agg(F.count_if(F.col("status") != "unresolved").alias("n")).where("n = 0")
    parts.append(rows(included, "nothing_included", F.lit("")))
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part)
    return combined


def gradebook_rows(decisions: DataFrame, grade_column: str) -> DataFrame:
    """The upload file: unresolved recipients are left out."""
    return decisions.where(F.col("status") != "unresolved").select(
        F.col("username").alias("Username"),
        F.col("grade").alias(grade_column),
        F.lit("#").alias("End-of-Line Indicator"),
    )


LINEAGE = ["item_identity", "config_identity", "context_config_identity", "prior_trials"]


def with_lineage(
    decisions: DataFrame, judgments: DataFrame, hashes: DataFrame, selections: DataFrame
) -> DataFrame:
    """Decisions with where each grade comes from.

    - ``judgments``: reference and the ``LINEAGE`` columns; ``prior_trials`` lists the
      gradings that the judgment saw, which are as many as the release asks for;
    - ``hashes``: student_id, assignment_id, source, sha256: what a grade was built from
      (the work, the rubric, the record), one row each;
    - ``selections``: folder, reason, excluded: the reviewed choice of an upload folder.

    Only graded rows have lineage and hashes; ``upload_selection`` is NULL where nobody
    chose.
    """
    lineage = judgments.select(F.col("reference").alias("trial"), *LINEAGE)
    sources = hashes.groupBy("student_id", "assignment_id").agg(
        F.map_from_entries(F.sort_array(F.collect_set(F.struct("source", "sha256")))).alias("hashes")
    )
    chosen = selections.select(
        "folder", F.struct("folder", "reason", "excluded").alias("upload_selection")
    )
    return (
        decisions.join(lineage, "trial", "left")
        .join(sources, ["student_id", "assignment_id"], "left")
        .join(chosen, "folder", "left")
        .select(*decisions.columns, *LINEAGE, "hashes", "upload_selection")
    )


def release_manifest(decisions: DataFrame, course_id: str, policy: str, **parameters) -> DataFrame:
    """The release record in long form: one JSON document per recipient."""
    return decisions.select(
        F.lit(course_id).alias("course_id"),
        F.lit(policy).alias("score_policy"),
        *[F.lit(value).alias(name) for name, value in sorted(parameters.items())],
        "username",
        F.to_json(F.struct(*decisions.columns)).alias("entry"),
        F.sha2(F.to_json(F.struct(*decisions.columns)), 256).alias("entry_sha256"),
    )
