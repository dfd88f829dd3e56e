"""Planning and grade release."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gradeloom.checks.registry import ORACLE_VIEWS, query, rounded
from gradeloom.checks.views import VIEWS
from gradeloom.functions import scalars as N
from gradeloom.operators import keys as K
from gradeloom.operators import planning, release
from gradeloom.session import checkpoint_dir
from gradeloom.sources import sinks

VIEWS["f_student_work"] = """
select distinct course_id, assignment_id, student_id from f_trials0
where submission_source = 'student' and student_id is not null"""

ORACLE_VIEWS["o_done"] = """
select item_id, item_identity, count(*) as existing from f_trials0
where stage = 'grade' and outcome = 'completed' group by all"""


@query(
    "p11_grading_sources",
    """select course_id, assignment_id, student_id from f_student_work
    where course_id = 'C4' and assignment_id = 'HW7'""",
)
def grading_sources(v):
    return planning.grading_sources(v.student_work, course="C4", assignment="HW7")


@query("g07_done_totals", "select * from o_done")
def done_totals(v):
    return planning.done_totals(v.trials0, "grade")


@query(
    "g07_solve_totals",
    """select item_id, item_identity, count(*) as existing from f_trials0
    where stage = 'solve' and outcome in ('completed', 'contract_failed') group by all""",
)
def solve_totals(v):
    return planning.done_totals(v.trials0, "solve")


ORACLE_VIEWS["o_deficit"] = """
select p.item_id, p.item_identity, coalesce(existing, 0) as existing,
  greatest(3 - coalesce(existing, 0), 0) as deficit,
  case when coalesce(existing, 0) = 0 then 'pending' when existing < 3 then 'partial'
    else 'complete' end as status
from f_planned p left join o_done using (item_id, item_identity)"""


@query("g08_deficits", "select * from o_deficit")
def deficits(v):
    return planning.deficits(v.planned, planning.done_totals(v.trials0, "grade"), 3)


@query(
    "g08_deficit_groups",
    "select deficit, count(*) as n_items from o_deficit where deficit > 0 group by deficit",
)
def deficit_groups(v):
    table = planning.deficits(v.planned, planning.done_totals(v.trials0, "grade"), 3)
    return planning.deficit_groups(table)


@query(
    "g08_forced_deficits",
    """select item_id, item_identity, existing, cast(2 as bigint) as deficit, 'forced' as status
    from o_deficit""",
)
def forced_deficits(v):
    return planning.deficits(v.planned, planning.done_totals(v.trials0, "grade"), 2, force=True)


@query(
    "g09_configuration_changes",
    """select item_id, item_identity from o_deficit p where existing = 0
      and item_id in (select item_id from o_done)""",
)
def configuration_changes(v):
    return planning.configuration_changes(v.planned, planning.done_totals(v.trials0, "grade"))


@query(
    "w01_hash_order_sample",
    """select * from (select course_id, assignment_id, student_id, row_number() over (
        partition by course_id, assignment_id
        order by sha256(course_id || '/' || student_id), student_id) as sample_rank
      from f_student_work where not starts_with(student_id, '_')) s where sample_rank <= 5""",
)
def hash_order_sample(v):
    return planning.hash_order_sample(v.student_work, 5)


@query(
    "w01_sample_summary",
    """select course_id, assignment_id,
      least(count(*) filter (not starts_with(student_id, '_')), 5) as n_chosen,
      count(*) filter (not starts_with(student_id, '_')) as n_submitted,
      count(*) filter (starts_with(student_id, '_')) as n_pseudo
    from f_student_work group by all""",
)
def sample_summary(v):
    return planning.sample_summary(v.student_work, 5)


VIEWS["f_pool"] = """
select t.item_id, t.item_identity, t.job_name, t.trial_name, l.pk % 7 <> 0 as has_artifacts,
  case when l.pk % 11 = 0 then null when l.pk % 5 = 0 then 'old' else 'now' end as submission_sha256
from f_trials0 t join f_lines l on t.trial_name = l.trial_name
where t.stage = 'grade' and t.outcome = 'completed' and t.context_config_identity is null"""

VIEWS["f_judge_requests"] = """
select distinct item_id, item_identity, 'now' as submission_sha256 from f_trials0
where stage = 'grade' and context_config_identity is null"""

ORACLE_VIEWS["o_prior_counts"] = """
select r.item_id, r.item_identity,
  count(*) filter (has_artifacts and p.submission_sha256 = 'now') as n_usable,
  count(*) filter (not has_artifacts) as n_missing,
  count(*) filter (has_artifacts and p.submission_sha256 is distinct from 'now') as n_stale
from f_judge_requests r left join f_pool p using (item_id, item_identity)
group by all"""


@query("w02_prior_counts", "select * from o_prior_counts")
def prior_counts(v):
    return planning.prior_grading_counts(v.judge_requests, v.pool)


@query(
    "w02_first_prior_gradings",
    """select item_id, item_identity, job_name, trial_name, position from (
      select *, row_number() over (partition by item_id, item_identity
        order by job_name, trial_name) as position
      from f_pool where has_artifacts and submission_sha256 = 'now') p
    join o_prior_counts using (item_id, item_identity)
    where position <= 2 and n_usable >= 2""",
)
def first_prior_gradings(v):
    return planning.first_prior_gradings(v.judge_requests, v.pool, 2)


VIEWS["f_artifact_files"] = """
select t.job_name, t.trial_name, 'f' || i as relpath
from f_trials0 t join f_lines l on t.trial_name = l.trial_name
  cross join (select * from (values (1), (2)) v(i)) c
where t.stage = 'solve' and l.pk % 3 <> 0 and l.ck % 40 <> 7"""

ORACLE_VIEWS["o_solves"] = """
select course_id, assignment_id, job_name, trial_name,
  case when outcome not in ('completed', 'contract_failed') then 'solve-failed'
    when trial_name not in (select trial_name from f_artifact_files) then 'empty-submission' end
    as reason
from f_trials0 where stage = 'solve'"""


@query("j18_solve_submissions", "select * from o_solves")
def solve_submissions(v):
    return planning.solve_submissions(v.trials0, v.artifact_files)


@query(
    "j18_ungradable_assignments",
    """select course_id, assignment_id || '/' || right(trial_name, 2) as assignment_id,
      count(*) filter (reason = 'solve-failed') = 0 as needs_force
    from o_solves group by all having count(*) filter (reason is null) = 0""",
)
def ungradable_assignments(v):
    selection = planning.solve_submissions(v.trials0, v.artifact_files)
    # Finer assignments, so that some of them have no submission at all.
    part = F.concat("assignment_id", F.lit("/"), F.expr("right(trial_name, 2)"))
    return planning.assignments_without_submission(selection.withColumn("assignment_id", part))


@query(
    "a24_run_accounting",
    """select count(*) as n_requested, count(*) filter (total > 0) as n_succeeded,
      count(*) filter (total = 0) as n_failed,
      count(*) filter (total > 0 and total < 3) as n_incomplete
    from (select coalesce(b.existing, 0) + coalesce(n.n, 0) as total from f_planned p
      left join o_done b using (item_id, item_identity)
      left join (select item_id, item_identity, count(*) as n from f_trials0 where stage = 'grade'
        and outcome = 'completed' and config_name = 'judge' group by all) n
        using (item_id, item_identity)) x""",
)
def run_accounting(v):
    before = planning.done_totals(v.trials0, "grade")
    new = planning.done_totals(v.trials0.where("config_name = 'judge'"), "grade")
    return planning.run_accounting(v.planned, before, new, 3)


VIEWS["f_rel_students"] = """
select 'S' || c_custkey as student_id, 'CX' as course_id,
  cast(case when c_custkey % 29 = 0 then 0 - c_custkey else c_custkey end as varchar(20))
    as lms_person_id, 'User' || c_custkey as lms_username, c_name as display_name, c_custkey
from customer where c_custkey % 23 <> 0"""
VIEWS["f_rel_submissions"] = """
select 'HW1' as assignment_id, cast(c_custkey as varchar(20)) as person_id,
  '#user' || c_custkey as username, 'h' || c_custkey as sha256,
  c_custkey || case when c_custkey % 50 = 3 then '-0' else '-9001' end || ' - user' as folder, c_custkey
from customer where c_custkey % 3 <> 0"""
VIEWS["f_rel_normalized"] = """
select 'S' || c_custkey as student_id, 'HW1' as assignment_id,
  case when c_custkey % 19 = 0 then 'other' else 'h' || c_custkey end as sha256, c_custkey
from customer where c_custkey % 31 <> 0"""
# Every order is a judgment. A customer's newest, and some older ones, which must be told
# apart, are of the released assignment; the rest are of others.
VIEWS["f_rel_judgments"] = """
select 'S' || o_custkey as student_id,
  case when o_orderkey = newest or o_orderkey % 40 = 0 then 'HW1'
    else 'HW' || (2 + o_orderkey % 5) end as assignment_id, 'J/' || o_orderkey as reference,
  case when o_orderkey % 7 = 0 then 'BUILDING' else c_mktsegment end as rubric_name,
  'sha-' || c_mktsegment as rubric_sha256,
  case when o_orderkey % 37 = 0 then 2 else 1 end as n_items,
  case when o_orderkey % 41 = 0 then 'x' else 'h' || o_custkey end as graded_sha256,
  o_orderkey % 43 <> 0 as rubric_intact, o_orderkey % 47 <> 0 as contract_valid,
  cast(o_orderkey % 101 as double) as base_points, cast(100 as double) as base_max,
  cast(o_orderkey % 17 as double) as bonus_points, o_orderkey, o_custkey
from (select *, max(o_orderkey) over (partition by o_custkey) as newest from orders) o
  join customer on o_custkey = c_custkey"""
VIEWS["f_rel_enrollments"] = """
select 'CX' as course_id, '#USER' || c_custkey as lms_username, c_mktsegment as rubric,
  'registrar' as source
from customer where c_custkey % 13 <> 0"""
VIEWS["f_rel_requests"] = """
select 'CX' as course_id, case when c_custkey % 2 = 0 then 'HW1' else 'HW2' end as assignment_id,
  case when c_custkey % 60 = 1 then null when c_custkey % 60 = 2 then '_ref' || c_custkey
    else 'S' || c_custkey end as student_id,
  case when c_custkey % 3 = 0 then 'BUILDING' else 'default' end as requested,
  c_custkey % 4 = 0 or c_custkey % 60 < 3 as explicit
from customer"""


def _assessments(v):
    """The assignments that are requested; the first routes three rubrics."""
    eligible = F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE")))
    asked = v.rel_requests.select("course_id", F.col("assignment_id").alias("id")).distinct()
    return asked.withColumn("rubrics", F.when(F.col("id") == "HW1", eligible))


def _route_sql(requests: str) -> str:
    return f"""
select r.*, case when assignment_id <> 'HW1' then null
    when r.student_id is null or starts_with(r.student_id, '_') then
      case when explicit and requested in ('AUTOMOBILE', 'BUILDING', 'FURNITURE') then null
        else 'no_enrolled_student' end
    when s.student_id is null then 'identity_missing_or_conflicting'
    when e.rubric is null then 'not_enrolled'
    when e.rubric not in ('AUTOMOBILE', 'BUILDING', 'FURNITURE') then 'rubric_not_eligible'
    when explicit and requested <> e.rubric then 'request_conflicts_with_enrollment' end as reason,
  case when assignment_id <> 'HW1' or r.student_id is null or starts_with(r.student_id, '_')
    then requested else e.rubric end as rubric0
from {requests} r left join f_rel_students s on s.student_id = r.student_id
  left join f_rel_enrollments e on lower(ltrim(e.lms_username, '#')) = lower(s.lms_username)"""


ORACLE_VIEWS["o_routes"] = _route_sql("f_rel_requests")
ORACLE_VIEWS["o_release_requests"] = """
select 'CX' as course_id, 'HW1' as assignment_id, student_id, 'default' as requested,
  false as explicit from f_rel_students"""
ORACLE_VIEWS["o_release_routes"] = _route_sql("o_release_requests")


@query(
    "j12_routed_rubrics",
    """select course_id, assignment_id, student_id, assignment_id = 'HW1' as routed, reason,
      case when reason is null then rubric0 end as rubric from o_routes""",
)
def routed_rubrics(v):
    return release.route_rubrics(
        v.rel_requests, _assessments(v), v.rel_students, v.rel_enrollments
    )


def _release(v, **options):
    requests = v.rel_students.select(
        "course_id",
        F.regexp_replace("student_id", "^.*$", "HW1").alias("assignment_id"),
        "student_id",
        F.lit("default").alias("requested"),
        F.lit(False).alias("explicit"),
    )
    routing = release.route_rubrics(
        requests, _assessments(v), v.rel_students, v.rel_enrollments
    ).withColumn(
        "current_sha256",
        F.when(F.col("rubric") != "FURNITURE", F.concat(F.lit("sha-"), "rubric")),
    )
    return release.release_decisions(
        v.roster,
        v.rel_submissions,
        v.rel_students,
        v.rel_normalized,
        v.rel_judgments,
        routing,
        v.rel_judgments.where("o_custkey % 2 = 0"),
        **options,
    )


ORACLE_VIEWS["o_fit"] = """
select j.*, count(*) over (partition by j.student_id) as n_judgments
from f_rel_judgments j join o_release_routes r using (student_id, assignment_id)
where j.rubric_name = r.rubric0 and r.reason is null and r.rubric0 <> 'FURNITURE'
  and j.rubric_sha256 = 'sha-' || r.rubric0"""
ORACLE_VIEWS["o_release"] = """
select r.username, case when m.c_custkey is not null then 'HW1' end as assignment_id, maximum,
  s.student_id, j.reference, m.folder, m.sha256, j.base_max, base_points, bonus_points,
  (least(base_points + 5, 100) + bonus_points) / 100 * maximum as points,
  case when m.c_custkey is null then case when s.student_id in (select student_id from f_rel_judgments
        where o_custkey % 2 = 0) then 'download_omits_known_submission'
      else 'confirmed_no_submission' end
    when s.lms_person_id is distinct from m.person_id then 'identity_missing_or_mismatched'
    when n.sha256 is distinct from m.sha256 then 'download_differs_from_stored_work'
    when t.reason is not null then t.reason
    when t.rubric0 = 'FURNITURE' then 'missing_current_rubric'
    when j.n_judgments is null then 'no_current_judgment'
    when j.n_judgments > 1 then 'several_judgments'
    when j.n_items <> 1 then 'judgment_item_not_unique'
    when j.graded_sha256 <> m.sha256 then 'judgment_of_other_work'
    when not j.rubric_intact then 'rubric_missing_or_changed'
    when not j.contract_valid then 'judgment_breaks_contract'
    when (least(base_points + 5, 100) + bonus_points) / 100 * maximum > maximum
      then 'grade_exceeds_maximum' end as reason
from f_roster r left join f_rel_submissions m on m.c_custkey = r.c_custkey
  left join f_rel_students s on s.c_custkey = r.c_custkey
  left join f_rel_normalized n on n.c_custkey = r.c_custkey
  left join o_release_routes t on t.student_id = s.student_id
  left join (select * from o_fit qualify row_number() over (partition by student_id
    order by reference) = 1) j on j.student_id = s.student_id and m.c_custkey is not null"""
ORACLE_VIEWS["o_decisions"] = """
select username, assignment_id, reason, maximum, points, student_id as sid, reference, folder as fold,
  sha256, base_max, base_points, bonus_points,
  case when reason = 'confirmed_no_submission' then 'zero_missing' when reason is not null
    then 'unresolved' else 'graded' end as status
from o_release"""
_GRADE = """case when status = 'zero_missing' then '0' when status = 'graded' then
  rtrim(rtrim(format('{:.6f}', points), '0'), '.') end"""


@query(
    "j13_release_decisions",
    f"""select username, assignment_id, status, reason, {_GRADE} as grade,
      case when status = 'graded' then sid end as student_id,
      case when status = 'graded' then reference end as trial,
      case when status = 'graded' then fold end as folder,
      case when status = 'graded' then sha256 end as submission_sha256,
      case when status = 'graded' then base_max end as rubric_base_max,
      case when status = 'graded' then base_points + bonus_points end as raw_earned_points,
      case when status = 'graded' then round(least(base_points + 5, 100) - base_points, 6) end
        as rubric_base_adjustment_points
    from o_decisions""",
)
def release_decisions(v):
    return rounded(_release(v, zero_missing=True))


@query(
    "j13_release_blockers",
    """select 'submitter_not_on_roster' as blocker, 'user' || c_custkey as subject
    from f_rel_submissions where c_custkey % 11 = 0
    union all select 'placeholder_assignment', folder from f_rel_submissions where c_custkey % 50 = 3
    union all select 'unresolved_recipient', username from o_decisions where status = 'unresolved'""",
)
def release_blockers(v):
    decisions = _release(v, zero_missing=True)
    return release.release_blockers(v.rel_submissions, v.roster, v.rel_students, decisions)


@query(
    "s14_gradebook_rows",
    f"""select username as "Username", {_GRADE} as "HW1 Points Grade", '#' as "End-of-Line Indicator"
    from o_decisions where status <> 'unresolved'""",
)
def gradebook_rows(v):
    return release.gradebook_rows(_release(v, zero_missing=True), "HW1 Points Grade")


@query(
    "s16_release_manifest",
    f"""select 'CX' as course_id, 'scaled' as score_policy, 3 as gradings, username, status,
      {_GRADE} as grade, reason from o_decisions""",
)
def release_manifest(v):
    manifest = release.release_manifest(_release(v, zero_missing=True), "CX", "scaled", gradings=3)
    return manifest.select(
        "course_id",
        "score_policy",
        "gradings",
        "username",
        *[F.get_json_object("entry", f"$.{c}").alias(c) for c in ("status", "grade", "reason")],
    )


def _lineage(v, decisions):
    """Decisions with lineage that the orders tell: three priors each, two or three hashes."""
    order = F.col("o_orderkey").cast("string")
    judgments = v.rel_judgments.select(
        "reference",
        F.concat(F.lit("i"), order).alias("item_identity"),
        F.concat(F.lit("c"), F.col("o_orderkey") % 3).alias("config_identity"),
        F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("x"), F.col("o_orderkey") % 5)).alias(
            "context_config_identity"
        ),
        F.array(*[F.concat(F.lit(f"P{n}/"), order) for n in (1, 2, 3)]).alias("prior_trials"),
    )
    work = v.rel_normalized.select("student_id", "assignment_id", F.lit("work").alias("source"), "sha256")
    rubric = v.rel_judgments.where("rubric_intact").select(
        "student_id", "assignment_id", F.lit("rubric").alias("source"), F.col("rubric_sha256").alias("sha256")
    )
    selections = v.rel_submissions.where("c_custkey % 5 = 0").select(
        "folder", F.lit("reviewed").alias("reason"),
        F.array(F.concat("folder", F.lit(" old"))).alias("excluded"),
    )
    return release.with_lineage(decisions, judgments, work.unionByName(rubric), selections)


@query(
    "s16_release_lineage",
    f"""select username, status, {_GRADE} as grade, case when status = 'graded' then reference end as trial,
      case when status = 'graded' then 'i' || k end as item_identity,
      case when status = 'graded' then 'c' || k % 3 end as config_identity,
      case when status = 'graded' and k % 4 <> 0 then 'x' || k % 5 end as context_config_identity,
      case when status = 'graded' then 'P1/' || k || ';P2/' || k || ';P3/' || k end as prior_trials,
      case when status = 'graded' then sha256 end as work_sha256,
      case when status = 'graded' then (select max(rubric_sha256) from f_rel_judgments j
        where j.student_id = o.sid and j.assignment_id = o.assignment_id and rubric_intact) end as rubric_sha256,
      case when status = 'graded' and cast(split_part(fold, '-', 1) as bigint) % 5 = 0 then fold end as selected_folder,
      case when status = 'graded' and cast(split_part(fold, '-', 1) as bigint) % 5 = 0
        then fold || ' old' end as excluded_uploads
    from (select *, cast(substr(reference, 3) as bigint) as k from o_decisions) o""",
)
def release_lineage(v):
    """The manifest's entries, read back from their JSON."""
    told = _lineage(v, _release(v, zero_missing=True))
    manifest = release.release_manifest(told, "CX", "scaled", gradings=3)
    entry = F.from_json("entry", told.schema)
    return manifest.select("username", entry.alias("e")).select(
        "username", "e.status", "e.grade", "e.trial", "e.item_identity", "e.config_identity",
        "e.context_config_identity", F.array_join("e.prior_trials", ";").alias("prior_trials"),
        F.col("e.hashes")["work"].alias("work_sha256"), F.col("e.hashes")["rubric"].alias("rubric_sha256"),
        F.col("e.upload_selection.folder").alias("selected_folder"),
        F.array_join("e.upload_selection.excluded", ";").alias("excluded_uploads"),
    )


@query(
    "s16_release_files",
    f"""select output, count(*) as rows,
      cast(sum(cast(('0x' || substr(sha256(line), 1, 15)) as hugeint)) as varchar) as rows_digest,
      true as files_agree
    from (
      select 'grades' as output, '{{"Username":"' || username || '","HW1 Points Grade":"' || {_GRADE}
        || '","End-of-Line Indicator":"#"}}' as line
      from o_decisions where status <> 'unresolved'
      union all
      select 'unresolved', '{{"username":"' || username || '","reason":"' || reason || '"}}'
      from o_decisions where status = 'unresolved') group by output""",
)
def release_files(v):
    """Two outputs written as a release; what the manifest says of them."""
    decisions = _lineage(v, _release(v, zero_missing=True)).persist()
    target = f"{checkpoint_dir(v.spark)}/s16-{uuid.uuid4().hex}"
    outputs = {
        "grades": release.gradebook_rows(decisions, "HW1 Points Grade"),
        "unresolved": decisions.where("status = 'unresolved'").select("username", "reason"),
    }
    sinks.write_release(release.release_manifest(decisions, "CX", "scaled"), outputs, target, "HW1")
    decisions.unpersist()
    changed = sinks.changed_files(v.spark, target, "HW1").select("output").distinct()
    ddl = "output string, rows long, rows_digest string"
    told = v.spark.read.schema(ddl).json(f"{target}/HW1/manifest/outputs").distinct()
    marked = changed.withColumn("changed", F.lit(True))
    return told.join(marked, "output", "left").select(*told.columns, F.col("changed").isNull().alias("files_agree"))


@query(
    "g10_score_policies",
    """select reference, round((least(base_points + 5, 100) + bonus_points) / 100 * 20, 6) as scaled,
      round(base_points + bonus_points + least(1, greatest(0, 20 - base_points - bonus_points)), 6)
        as earned,
      round(base_points + bonus_points, 6) as diagnostic
    from f_rel_judgments""",
)
def score_policies(v):
    parts = [F.col("base_points"), F.col("base_max"), F.col("bonus_points"), F.lit(20.0)]
    return rounded(
        v.rel_judgments.select(
            "reference",
            release.final_points("scaled", *parts).alias("scaled"),
            release.final_points("earned-points", *parts).alias("earned"),
            release.final_points("diagnostic", *parts).alias("diagnostic"),
        )
    )


@query(
    "n08_grade_numbers",
    """select l_orderkey, l_linenumber, rtrim(rtrim(format('{:.6f}', x), '0'), '.') as grade
    from (select l_orderkey, l_linenumber, l_extendedprice * l_discount / 128 as x from lineitem) l""",
)
def grade_numbers(v):
    value = F.col("l_extendedprice") * F.col("l_discount") / 128
    return v.lineitem.select("l_orderkey", "l_linenumber", N.format_grade(value).alias("grade"))





@query(
    "j14_eligible_judgments",
    """select job_name, trial_name, student_id, item_identity from o_trials
    where stage = 'grade' and submission_source = 'student' and course_id = 'C7'
      and assignment_id in ('HW1', 'HW2', 'HW3', 'HW5') and config_name = 'judge'
      and context_config_name = 'grader-a' and n_prior_gradings = 1 and not superseded
      and outcome = 'completed' and not grading_load_error""",
)
def eligible_judgments(v):
    candidates = release.candidate_judgments(
        v.trials, "C7", ["HW1", "HW2", "HW3", "HW5"], "judge", "grader-a"
    )
    return release.eligible_judgments(candidates, 1).select(
        *K.TRIAL, "student_id", "item_identity"
    )
