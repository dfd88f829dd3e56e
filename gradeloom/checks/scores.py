"""Scores: ladder, students, repeats, review queue, judge quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom import schemas
from gradeloom.checks.registry import ORACLE_VIEWS, query, rounded
from gradeloom.functions import predicates as P
from gradeloom.operators import accounting, ladder, lineage, quality, release, repeats, review, students
from gradeloom.operators import keys as K
from gradeloom.plans import report

ORACLE_VIEWS["o_judged"] = """
select config_identity, item_id, context_config_identity, trial_name,
  list_sort(list_distinct(string_split(prior_trials, '; '))) as priors
from f_trials0 where stage = 'grade' and context_config_identity is not null
  and prior_trials is not null and score_pct is not null"""

ORACLE_VIEWS["o_super"] = """
select distinct a.trial_name as super_trial from o_judged a join o_judged b
  on a.config_identity = b.config_identity and a.item_id = b.item_id
  and a.context_config_identity = b.context_config_identity
where len(a.priors) < len(b.priors) and list_has_all(b.priors, a.priors)"""

ORACLE_VIEWS["o_trials"] = """
select t.* exclude (superseded), super_trial is not null as superseded,
  job_name || '/' || trial_name as ref
from f_trials0 t left join o_super on trial_name = super_trial"""

ORACLE_VIEWS["o_valid"] = """
select * from o_trials where stage = 'grade' and outcome = 'completed'
  and score_pct is not null and not superseded"""

OUTCOME_NAMES = "completed contract_failed agent_error infra_error timeout cancelled unknown".split()
_COUNTS = ", ".join(f"count(*) filter (outcome = '{o}') as n_{o}" for o in OUTCOME_NAMES)
_RATES = ", ".join(
    f"round(count(*) filter (outcome = '{o}') / count(*), 6) as rate_{o}" for o in OUTCOME_NAMES
)


@query(
    "p01_valid_gradings",
    "select job_name, trial_name, score_pct from o_valid",
)
def valid_gradings(v):
    return v.trials.where(P.is_valid_grading()).select(*K.TRIAL, "score_pct")


@query(
    "p02_student_rows",
    """select trial_name, student_id, left(student_id, 1) = '_' as is_pseudo
    from f_trials0 where stage = 'grade' and student_id is not null""",
)
def student_rows(v):
    return v.trials0.where(P.is_student_row()).select(
        "trial_name", "student_id", P.is_pseudo().alias("is_pseudo")
    )


@query(
    "p03_report_filters",
    """select job_name, trial_name, criterion_id, points from f_criteria
    where trial_name in (select trial_name from f_trials0
      where course_id in ('C1', 'C2', 'C4') and (config_name in ('solver', 'judge')
        or solver_config_name in ('solver', 'judge')))""",
)
def report_filters(v):
    trials, criteria = report.filter_tables(
        v.trials0, v.criteria, courses=["C1", "C2", "C4"], configs=["solver", "judge"]
    )
    return criteria.select(*K.TRIAL, "criterion_id", "points")


@query(
    "p07_pseudo_roles",
    """select trial_name, case when starts_with(student_id, '_reference') then 'reference'
      when starts_with(student_id, '_irrelevant') then 'irrelevant' else 'other' end as role
    from f_trials0 where starts_with(student_id, '_')""",
)
def pseudo_roles(v):
    return v.trials0.where(P.is_pseudo()).select("trial_name", P.pseudo_role().alias("role"))


@query(
    "p12_conformed_trials",
    """select stage, count(*) as n, count(reward) as n_reward, count(started_at) as n_started,
      44 as n_columns from f_trials0 group by stage""",
)
def conformed(v):
    full = schemas.conform(v.trials0.drop("started_at"), schemas.TRIALS)
    return full.groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("reward").alias("n_reward"),
        F.count("started_at").alias("n_started"),
        F.lit(len(full.columns)).alias("n_columns"),
    )


@query(
    "a01_solve_summary",
    f"""select config_name, config_identity, course_id, assignment_id, count(*) as n_trials, {_COUNTS},
      count(*) filter (outcome in ('completed', 'contract_failed')) as n_verified,
      round(count(*) filter (outcome = 'completed') / nullif(count(*) filter (
        outcome in ('completed', 'contract_failed')), 0), 6) as contract_pass_rate,
      count(*) filter (late_exception) as n_late_exception
    from f_trials0 where stage = 'solve' group by all""",
)
def solve_summary(v):
    return rounded(ladder.solve_summary(v.trials0))


ORACLE_VIEWS["o_assignment"] = """
select solver_config_name, solver_config_identity, config_name as grading_config_name,
  config_identity as grading_config_identity, course_id, assignment_id, rubric_sha256,
  count(*) as n_solve_trials, cast(sum(n) as bigint) as n_gradings, avg(m) as mean_score_pct,
  stddev_samp(m) as sd_score_pct
from (select solver_config_name, solver_config_identity, config_name, config_identity, course_id,
        assignment_id, rubric_sha256, item_id, item_identity, count(*) as n, avg(score_pct) as m
      from o_valid where submission_source = 'solve-trial' group by all) i
group by all"""


@query(
    "a02_grades_by_assignment",
    """select * replace (round(mean_score_pct, 6) as mean_score_pct,
      round(sd_score_pct, 6) as sd_score_pct) from o_assignment""",
)
def grades_by_assignment(v):
    return rounded(ladder.grades_by_assignment(v.trials))


ORACLE_VIEWS["o_versions"] = """
select solver_config_name, solver_config_identity, grading_config_name, grading_config_identity,
  course_id, assignment_id, count(*) as n_versions, max(mean_score_pct) as m
from o_assignment group by all"""
ORACLE_VIEWS["o_boot_values"] = """
select solver_config_name as a, solver_config_identity as b, grading_config_name as c,
  grading_config_identity as d, course_id as e, list(m order by assignment_id) as vals,
  concat_ws('|', solver_config_name, solver_config_identity, grading_config_name,
    grading_config_identity, course_id) as label
from o_versions where n_versions = 1 group by all having count(*) >= 5"""
ORACLE_VIEWS["o_boot_draws"] = """
select a, b, c, d, e, r.range as resample, vals[1 + cast('0x' || substr(md5('42|' || label || '|'
  || r.range || '|' || i.range), 1, 8) as bigint) % len(vals)] as pick
from o_boot_values, range(0, 10000) r, lateral (select range from range(1, len(vals) + 1)) i"""
ORACLE_VIEWS["o_boot"] = """
select a, b, c, d, e, quantile_cont(m, 0.025) as ci_low, quantile_cont(m, 0.975) as ci_high
from (select a, b, c, d, e, resample, avg(pick) as m from o_boot_draws group by all) x
group by all"""


@query(
    "a03_grades_by_course",
    """select c.solver_config_name, c.solver_config_identity, c.grading_config_name,
      c.grading_config_identity, c.course_id, n_assignments, n_assignments_mixed_rubric,
      greatest(coalesce(n_attempted, 0), n_assignments + n_assignments_mixed_rubric)
        as n_assignments_total,
      round(macro, 6) as macro_mean_score_pct, round(ci_low, 6) as ci_low,
      round(ci_high, 6) as ci_high
    from (select solver_config_name, solver_config_identity, grading_config_name,
        grading_config_identity, course_id, count(*) filter (n_versions = 1) as n_assignments,
        count(*) filter (n_versions > 1) as n_assignments_mixed_rubric,
        avg(m) filter (n_versions = 1) as macro from o_versions group by all) c
    left join (select config_identity, course_id, count(distinct assignment_id) as n_attempted
        from f_trials0 where stage = 'solve' group by all) s
      on s.config_identity = c.solver_config_identity and s.course_id = c.course_id
    left join o_boot on a = c.solver_config_name and b = c.solver_config_identity
      and c = c.grading_config_name and d = c.grading_config_identity and e = c.course_id""".replace(
        "and c = c.grading", "and o_boot.c = c.grading"
    ),
)
def grades_by_course(v):
    return rounded(ladder.grades_by_course(v.per_assignment, v.trials))


@query(
    "a04_bootstrap_intervals",
    """select a as solver_config_name, b as solver_config_identity, c as grading_config_name,
      d as grading_config_identity, e as course_id, round(ci_low, 6) as ci_low,
      round(ci_high, 6) as ci_high from o_boot""",
)
def bootstrap(v):
    versions = ladder.rubric_version_counts(v.per_assignment)
    values = versions.where(F.col("n_versions") == 1)
    return rounded(ladder.bootstrap_intervals(values, K.LADDER_COURSE, "assignment_id"))


@query(
    "w08_rubric_multiplicity",
    "select * exclude (m), round(m, 6) as mean_score_pct from o_versions",
)
def rubric_multiplicity(v):
    return rounded(ladder.rubric_version_counts(v.per_assignment))


@query(
    "j20_ladder_drilldown",
    """select a.* replace (round(mean_score_pct, 6) as mean_score_pct,
        round(sd_score_pct, 6) as sd_score_pct),
      c.n_assignments, round(c.macro, 6) as macro_mean_score_pct
    from o_assignment a join (select solver_config_name, solver_config_identity,
        grading_config_name, grading_config_identity, course_id,
        count(*) filter (n_versions = 1) as n_assignments,
        avg(m) filter (n_versions = 1) as macro from o_versions group by all) c
      on a.solver_config_name is not distinct from c.solver_config_name
      and a.solver_config_identity is not distinct from c.solver_config_identity
      and a.grading_config_name is not distinct from c.grading_config_name
      and a.grading_config_identity is not distinct from c.grading_config_identity
      and a.course_id is not distinct from c.course_id""",
)
def ladder_drilldown(v):
    courses = ladder.grades_by_course(v.per_assignment, v.trials)
    return rounded(ladder.ladder_drilldown(courses, v.per_assignment))


@query(
    "a05_item_stability",
    """select config_name, config_identity, count(*) as n_items_repeated,
      round(avg(sd), 6) as mean_within_item_sd, round(max(spread), 6) as max_within_item_range
    from (select config_name, config_identity, item_id, item_identity, stddev_samp(score_pct) as sd,
        max(score_pct) - min(score_pct) as spread from o_valid group by all having count(*) >= 2) i
    group by all""",
)
def item_stability(v):
    return rounded(quality.item_stability(v.trials))


ORACLE_VIEWS["o_agreement"] = """
select a.config_name, a.config_identity, count(*) as n_pairs,
  avg(case when abs(ca.points - cb.points) <= 1e-9 then 1 else 0 end) as exact_rate,
  avg(abs(ca.points - cb.points)) as mean_diff
from o_valid a join o_valid b on a.config_name = b.config_name
  and a.config_identity = b.config_identity and a.item_id = b.item_id
  and a.item_identity = b.item_identity and a.ref < b.ref
  join f_criteria ca on ca.trial_name = a.trial_name
  join f_criteria cb on cb.trial_name = b.trial_name and ca.criterion_id = cb.criterion_id
group by all"""


@query(
    "a06_criterion_agreement",
    """select v.config_name, v.config_identity, coalesce(n_pairs, 0) as n_pairs,
      round(exact_rate, 6) as criterion_exact_agreement_rate,
      round(mean_diff, 6) as criterion_mean_abs_diff
    from (select distinct config_name, config_identity from o_valid
      where trial_name in (select trial_name from f_criteria)) v
    left join o_agreement a on a.config_name = v.config_name
      and a.config_identity = v.config_identity""",
)
def criterion_agreement(v):
    return rounded(quality.criterion_agreement(v.trials, v.criteria))


ORACLE_VIEWS["o_shapes"] = """
select t.config_name, t.config_identity, t.job_name, t.trial_name,
  bool_or(r.sha256 is not null) as has_any,
  exists (select 1 from f_rubric_criteria k where k.course_id = t.course_id
    and k.assignment_id = t.assignment_id and k.sha256 = t.rubric_sha256) as resolved,
  bool_and(r.sha256 is not null and abs(c.max_points - r.max_points) <= 1e-9
    and c.bonus = r.bonus) and count(*) = 4 as faithful
from o_valid t join f_criteria c on c.trial_name = t.trial_name
  left join f_rubric_criteria r on r.course_id = t.course_id
    and r.assignment_id = t.assignment_id and r.sha256 = t.rubric_sha256
    and r.criterion_id = c.criterion_id
group by t.config_name, t.config_identity, t.job_name, t.trial_name, t.course_id,
  t.assignment_id, t.rubric_sha256"""
ORACLE_VIEWS["o_fidelity"] = """
select config_name, config_identity,
  count(*) filter (resolved and faithful) / nullif(count(*) filter (resolved), 0) as fidelity,
  count(*) filter (not resolved) as n_unresolved from o_shapes group by all"""


@query(
    "a07_rubric_fidelity",
    """select config_name, config_identity, round(fidelity, 6) as rubric_fidelity_rate,
      n_unresolved as n_rubric_unresolved from o_fidelity""",
)
def rubric_fidelity(v):
    return rounded(quality.rubric_fidelity(v.trials, v.criteria, v.rubric_criteria))


@query(
    "j06_resolved_rubrics",
    """select job_name, trial_name, exists (select 1 from f_rubric_criteria k
      where k.course_id = t.course_id and k.assignment_id = t.assignment_id
        and k.sha256 = t.rubric_sha256) as resolved
    from o_valid t""",
)
def resolved_rubrics(v):
    return quality.resolved_rubrics(v.trials, v.rubric_criteria).select(*K.TRIAL, "resolved")


@query(
    "j07_shape_matches",
    """select job_name, trial_name, resolved, resolved and faithful as faithful from o_shapes""",
)
def shape_matches(v):
    return quality.shape_matches(v.trials, v.criteria, v.rubric_criteria).select(
        *K.TRIAL, "resolved", "faithful"
    )


@query(
    "a08_judge_quality",
    f"""select g.*, coalesce(n_items, 0) as n_items_repeated, round(sd, 6) as mean_within_item_sd,
      round(spread, 6) as max_within_item_range,
      round(exact_rate, 6) as criterion_exact_agreement_rate,
      round(mean_diff, 6) as criterion_mean_abs_diff,
      round(fidelity, 6) as rubric_fidelity_rate,
      coalesce(n_unresolved, 0) as n_rubric_unresolved,
      n_valid_gradings, sums_consistent_rate, grading_load_error_rate
    from (select config_name, config_identity, count(*) as n_trials,
        round(count(*) filter (late_exception) / count(*), 6) as late_exception_rate, {_RATES}
      from o_trials where stage = 'grade' group by config_name, config_identity) g
    left join (select config_name, config_identity, count(*) as n_valid_gradings,
        round(count(*) filter (sums_consistent) / nullif(count(sums_consistent), 0), 6)
          as sums_consistent_rate,
        round(count(*) filter (grading_load_error) / count(*), 6) as grading_load_error_rate
      from o_valid group by all) w using (config_name, config_identity)
    left join (select config_name, config_identity, count(*) as n_items, avg(s) as sd,
        max(d) as spread
      from (select config_name, config_identity, stddev_samp(score_pct) as s,
          max(score_pct) - min(score_pct) as d
        from o_valid group by config_name, config_identity, item_id, item_identity
        having count(*) >= 2) x group by all) i
      using (config_name, config_identity)
    left join o_agreement using (config_name, config_identity)
    left join o_fidelity using (config_name, config_identity)""".replace(
        "select g.*,", "select g.* ,"
    ),
)
def judge_quality(v):
    return rounded(quality.judge_quality(v.trials, v.criteria, v.rubric_criteria))


ORACLE_VIEWS["o_students"] = """
select config_name, config_identity, course_id, assignment_id, student_id, rubric_sha256,
  count(*) filter (ok) as n_valid_gradings, avg(score_pct) filter (ok) as mean_score_pct,
  stddev_samp(score_pct) filter (ok) as sd_score_pct,
  count(*) filter (not ok and not superseded) as n_failed_gradings,
  count(*) filter (superseded) as n_superseded,
  count(*) filter (sums_consistent = false) as n_sums_inconsistent,
  count(*) filter (late_exception) as n_late_exception,
  count(*) filter (grading_load_error) as n_load_error
from (select *, outcome = 'completed' and score_pct is not null and not superseded as ok
      from o_trials where stage = 'grade' and student_id is not null
        and not starts_with(student_id, '_')) s
group by all"""


@query(
    "a09_student_grades",
    """select * replace (round(mean_score_pct, 6) as mean_score_pct,
      round(sd_score_pct, 6) as sd_score_pct) from o_students""",
)
def student_grades(v):
    return rounded(students.student_grades(v.trials))


@query(
    "a10_class_distribution",
    """select config_name, config_identity, course_id, assignment_id, rubric_sha256,
      count(mean_score_pct) as n_students, round(avg(mean_score_pct), 6) as mean,
      round(quantile_cont(mean_score_pct, 0.5), 6) as median,
      round(stddev_samp(mean_score_pct), 6) as sd,
      round(quantile_cont(mean_score_pct, 0.25), 6) as q25,
      round(quantile_cont(mean_score_pct, 0.75), 6) as q75
    from o_students group by all""",
)
def class_distribution(v):
    return rounded(students.class_distribution(v.student_table))


@query(
    "a11_grader_checks",
    """select config_name, config_identity, course_id, assignment_id, student_id, rubric_sha256,
      case when starts_with(student_id, '_reference') then 'reference'
        when starts_with(student_id, '_irrelevant') then 'irrelevant' else 'other' end as role,
      count(*) filter (ok) as n_valid_gradings,
      round(avg(score_pct) filter (ok), 6) as mean_score_pct,
      round(min(score_pct) filter (ok), 6) as min_score_pct,
      round(max(score_pct) filter (ok), 6) as max_score_pct
    from (select *, outcome = 'completed' and score_pct is not null and not superseded as ok
      from o_trials where starts_with(student_id, '_') and stage = 'grade') s
    group by all""",
)
def grader_checks(v):
    return rounded(students.grader_checks(v.trials))


@query(
    "a12_failure_accounting",
    f"""select g.stage, g.config_name, g.config_identity, o.outcome,
      count(t.trial_name) as n_trials,
      round(count(t.trial_name) / any_value(g.n_all), 6) as share
    from (select stage, config_name, config_identity, count(*) as n_all from f_trials0 group by all) g
      cross join (select unnest({OUTCOME_NAMES!r}) as outcome) o
      left join f_trials0 t on t.stage = g.stage and t.config_identity = g.config_identity
        and t.outcome = o.outcome
    group by all""",
)
def failure_accounting(v):
    return rounded(accounting.failure_accounting(v.trials0))


ORACLE_VIEWS["o_repeats"] = """
select *, list_filter(refs, lambda r: abs(r.s - median_score_pct) > 10) as far
from (select config_name, config_identity, course_id, assignment_id, item_id, item_identity,
    count(*) as n_gradings, min_by(student_id, ref) as student_id,
    min_by(submission_source, ref) as submission_source, min_by(rubric_sha256, ref) as rubric_sha256,
    quantile_cont(score_pct, 0.5) as median_score_pct,
    max(score_pct) - min(score_pct) as range_score_pct,
    list({'r': ref, 's': score_pct} order by ref) as refs
  from o_valid group by all having count(*) >= 2) g"""


@query(
    "a13_repeat_consistency",
    """select * exclude (refs, far) replace (round(median_score_pct, 6) as median_score_pct,
        round(range_score_pct, 6) as range_score_pct),
      range_score_pct > 20 as range_flagged, cast(len(far) as bigint) as n_deviant_gradings
    from o_repeats""",
)
def repeat_consistency(v):
    return rounded(repeats.repeat_consistency(v.trials))


@query(
    "a13_deviant_gradings",
    """select config_name, config_identity, item_id, item_identity, d.r as ref,
      round(d.s, 6) as score_pct, round(median_score_pct, 6) as median_score_pct
    from (select *, unnest(far) as d from o_repeats) x""",
)
def deviant_gradings(v):
    return rounded(
        repeats.deviant_gradings(v.trials).select(
            *K.JUDGE, repeats.trial_ref().alias("ref"), "score_pct", "median_score_pct"
        )
    )


@query(
    "w06_first_of_group",
    """select config_name, config_identity, course_id, assignment_id, item_id, item_identity,
      min_by(trial_name, job_name || ' ' || trial_name) as trial_name,
      min_by(job_name, job_name || ' ' || trial_name) as job_name
    from o_valid group by all""",
)
def first_of_group(v):
    table = repeats.score_table(v.trials.where(P.is_valid_grading()), K.REPEAT)
    firsts = table.groupBy(*K.REPEAT).agg(F.min("first").alias("first"))
    return firsts.select(*K.REPEAT, "first.trial_name", "first.job_name")


@query(
    "a14_near_timeouts",
    """select stage, job_name, config_name, config_identity, count(*) as n_trials,
      count(*) filter (agent_execution_sec is not null and agent_timeout_sec is not null)
        as n_measured,
      count(*) filter (agent_execution_sec is null or agent_timeout_sec is null) as n_unmeasured,
      count(*) filter (agent_execution_sec > 0.6 * agent_timeout_sec) as n_near_timeout,
      max(agent_execution_sec) as max_agent_execution_sec,
      max(agent_timeout_sec) as agent_timeout_sec
    from f_trials0 group by all""",
)
def near_timeouts(v):
    return rounded(accounting.near_timeouts(v.trials0))


@query(
    "j04_supersession",
    "select job_name, trial_name from o_trials where superseded",
)
def supersession(v):
    return lineage.mark_superseded(v.trials0).where("superseded").select(*K.TRIAL)


@query(
    "j09_ungraded_solve_trials",
    """select config_name, config_identity, course_id, assignment_id, job_name, trial_name, outcome
    from f_trials0 s where stage = 'solve' and not exists (select 1 from o_valid g
      where g.solve_job_name = s.job_name and g.solve_trial_name = s.trial_name)""",
)
def ungraded(v):
    return accounting.ungraded_solve_trials(v.trials)


ORACLE_VIEWS["o_initial"] = """
select config_name, config_identity, course_id, assignment_id, item_id, item_identity,
  min_by(student_id, ref) as student_id, min_by(submission_source, ref) as submission_source,
  min_by(rubric_sha256, ref) as rubric_sha256, count(*) as n_initial_gradings,
  quantile_cont(score_pct, 0.5) as initial_median_score_pct,
  max(score_pct) - min(score_pct) as initial_range_score_pct, list(ref order by ref) as names,
  row_number() over () as gid
from o_valid where context_config_identity is null group by all"""
ORACLE_VIEWS["o_initial_of"] = """
select gid, unnest(names) as name from o_initial"""
ORACLE_VIEWS["o_final"] = """
select config_name as judge_config_name, config_identity as judge_config_identity, item_id as jitem,
  item_identity as jident, count(*) as n_final_gradings,
  quantile_cont(score_pct, 0.5) as final_score_pct, min(ref) as first_final_trial,
  min_by({'student_id': student_id, 'source': submission_source, 'rubric': rubric_sha256,
    'course': course_id, 'assignment': assignment_id, 'ctx': context_config_name,
    'ctxid': context_config_identity, 'n': n_prior_gradings, 'priors': prior_trials}, ref) as f,
  row_number() over () as jid
from o_valid where context_config_identity is not null group by all"""
ORACLE_VIEWS["o_final_prior"] = """
select jid, name, gid, s.score_pct from (select jid, unnest(string_split(f.priors, '; ')) as name
    from o_final) p
  left join o_initial_of i using (name) left join o_valid s on s.ref = name and gid is not null"""
ORACLE_VIEWS["o_final_stats"] = """
select jid, count(*) as n_listed, count(gid) as n_resolved, count(distinct name) as n_names,
  count(distinct gid) as n_groups, min(gid) as gid, min(score_pct) as low, max(score_pct) as high,
  string_agg(format('{:g}', score_pct), '; ' order by score_pct) as prior_values,
  list(name) as listed
from o_final_prior group by jid"""
_PATHS = (
    "list_transform({0}, lambda n: 'grading/' || n || "
    "'/artifacts/app/grading_output/justification.md')"
)
ORACLE_VIEWS["o_queue0"] = f"""
select j.*, s.*, i.* exclude (gid), i.gid as igid,
  greatest(f.n - coalesce(n_resolved, 0), coalesce(n_listed, 0) - coalesce(n_resolved, 0))
    as missing0,
  coalesce(f.n = n_listed and n_names = n_listed and n_resolved > 0 and n_groups = 1
    and greatest(f.n - n_resolved, n_listed - n_resolved) = 0, false) as complete,
  list_sort(list_filter(i.names, lambda n: not list_contains(listed, n))) as unseen,
  array_to_string({_PATHS.format("string_split(f.priors, '; ')")}, '; ') as prior_paths
from o_final j left join o_final_stats s on s.jid = j.jid
  left join o_initial i on i.gid = s.gid and s.n_groups = 1"""
ORACLE_VIEWS["o_queue1"] = """
select case when igid is null then f.ctx else config_name end as config_name,
  case when igid is null then f.ctxid else config_identity end as config_identity,
  case when igid is null then f.course else course_id end as course_id,
  case when igid is null then f.assignment else assignment_id end as assignment_id,
  case when igid is null then jitem else item_id end as item_id, item_identity,
  case when igid is null then f.student_id else student_id end as student_id,
  case when igid is null then f.source else submission_source end as submission_source,
  case when igid is null then f.rubric else rubric_sha256 end as rubric_sha256,
  coalesce(n_initial_gradings, 0) as n_initial_gradings,
  initial_median_score_pct, initial_range_score_pct, names,
  judge_config_name, judge_config_identity, n_final_gradings, final_score_pct,
  f.n as n_prior_gradings, coalesce(n_resolved, 0) as n_resolved_prior_gradings,
  case when f.n is not null then missing0 end as n_missing_prior_gradings,
  prior_values as prior_score_pct_values,
  case when complete then low end as prior_min_score_pct,
  case when complete then high end as prior_max_score_pct,
  case when complete then high - low end as prior_range_score_pct, f.priors as prior_trials,
  prior_paths as prior_justification_paths,
  case when igid is not null then cast(len(unseen) as bigint) end as n_unseen_initial_gradings,
  case when igid is not null then nullif(array_to_string(unseen, '; '), '') end
    as unseen_initial_trials,
  case when complete then final_score_pct < low or final_score_pct > high end
    as final_outside_range,
  case when complete then greatest(low - final_score_pct, final_score_pct - high, 0) end
    as final_distance_outside_range_pct, first_final_trial,
  not complete as unresolved, igid is null as standalone
from o_queue0
union all by name
select * exclude (gid), 0 as n_final_gradings, false as unresolved, false as standalone
from o_initial where gid not in (select igid from o_queue0 where igid is not null)"""
ORACLE_VIEWS["o_queue"] = """
select * exclude (names, unresolved, standalone),
  nullif(concat_ws('; ', case when final_outside_range then 'final_outside_prior_range' end,
    case when initial_range_score_pct > 20 then 'wide_initial_range' end,
    case when n_unseen_initial_gradings > 0 then 'initial_not_in_judge_context' end,
    case when n_missing_prior_gradings > 0 then 'missing_prior_results' end,
    case when unresolved then 'unresolved_prior_lineage' end,
    case when standalone then 'final_without_loaded_initial_group' end), '') as review_reasons
from o_queue1"""


@query("j05_review_queue", "select * exclude (unseen_initial_trials) from o_queue")
def review_queue(v):
    return rounded(review.review_queue(v.trials))


_PATH = "'grading/' || ref || '/artifacts/app/grading_output/justification.md' as justification_path"


@query(
    "j05_initial_gradings",
    f"""select config_name, config_identity, course_id, assignment_id, item_id, item_identity,
      ref as initial_trial, round(score_pct, 6) as score_pct, {_PATH}
    from o_valid where context_config_identity is null""",
)
def initial_gradings(v):
    return rounded(review.initial_gradings(v.trials))


@query(
    "j05_final_gradings",
    f"""select config_name, config_identity, item_id, item_identity,
      ref as final_trial, round(score_pct, 6) as score_pct, {_PATH}
    from o_valid where context_config_identity is not null""",
)
def final_gradings(v):
    return rounded(review.final_gradings(v.trials))


@query(
    "j13_identity_blockers",
    """select 'several_config_identity' as blocker, min(config_identity) as subject from o_trials
      having min(config_identity) <> max(config_identity)
    union all select 'several_context_config_identity', min(context_config_identity) from o_trials
      having min(context_config_identity) <> max(context_config_identity)""",
)
def identity_blockers(v):
    return release.identity_blockers(v.trials)


@query(
    "j13_unknown_pins",
    """select ref as reference from o_trials
    where stage = 'grade' and not (coalesce(n_prior_gradings = 2, false) and not superseded
      and coalesce(outcome = 'completed', false) and not grading_load_error)""",
)
def unknown_pins(v):
    pins = v.trials.where("stage = 'grade'").select(repeats.trial_ref().alias("reference"))
    return release.unknown_pins(v.trials, 2, pins)


@query(
    "a13_repeat_scores",
    """select config_name, config_identity, course_id, assignment_id, item_id, item_identity,
      round(score_pct, 6) as score_pct, count(*) as n from o_valid group by all""",
)
def repeat_scores(v):
    return rounded(repeats.repeat_scores(v.trials))


@query(
    "w07_priority_rank",
    """select course_id, config_identity, item_id, item_identity, judge_config_identity,
      review_reasons,
      row_number() over (partition by course_id order by coalesce(final_outside_range, false) desc,
        coalesce(final_distance_outside_range_pct, 0) desc, initial_range_score_pct desc nulls last,
        config_name nulls last, config_identity nulls last, assignment_id nulls last,
        item_id nulls last, item_identity nulls last, judge_config_name nulls last,
        judge_config_identity nulls last, first_final_trial nulls last) as priority_rank
    from o_queue""",
)
def priority_rank(v):
    ranked = review.priority_rank(v.queue)
    return ranked.select(
        "course_id", "config_identity", "item_id", "item_identity", "judge_config_identity",
        "review_reasons", "priority_rank",
    )


@query(
    "x02_unseen_initial_gradings",
    """select judge_config_identity, config_identity, item_id, item_identity,
      unnest(string_split(unseen_initial_trials, '; ')) as initial_trial
    from o_queue where unseen_initial_trials is not null""",
)
def unseen(v):
    return review.unseen_initial_gradings(v.trials).select(
        "judge_config_identity", "config_identity", *K.ITEM, "initial_trial"
    )


@query(
    "a23_headline_counts",
    """select * from (select count(*) as n_repeated_items,
        count(*) filter (range_score_pct > 20 or len(far) > 0) as n_flagged,
        cast(coalesce(sum(len(far)), 0) as bigint) as n_deviant_gradings from o_repeats) r
      cross join (select count(*) as n_queue_rows, count(*) filter (n_final_gradings > 0) as n_final,
        count(*) filter (final_outside_range) as n_outside,
        count(*) filter (initial_range_score_pct > 20) as n_wide,
        count(*) filter (n_unseen_initial_gradings > 0) as n_unseen,
        count(*) filter (n_missing_prior_gradings > 0) as n_missing from o_queue) q
      cross join (select
        count(*) filter (agent_execution_sec > 0.6 * agent_timeout_sec) as n_near_timeout,
        count(*) filter (agent_execution_sec is not null and agent_timeout_sec is not null)
          as n_measured,
        count(*) filter (agent_execution_sec is null or agent_timeout_sec is null) as n_unmeasured
        from f_trials0) t""",
)
def headline_counts(v):
    return accounting.headline_counts(
        repeats.repeat_consistency(v.trials),
        v.queue,
        accounting.near_timeouts(v.trials),
    )
