"""Stored JSON documents, artifacts and rubric texts, derived from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gradeloom.checks.registry import ORACLE_VIEWS, query, rounded
from gradeloom.checks.views import VIEWS
from gradeloom.functions import json_fields as J
from gradeloom.functions import predicates as P
from gradeloom.functions import scalars as N
from gradeloom.operators import accounting, contract, lineage, rubrics, trials
from gradeloom.operators import keys as K
from gradeloom.plans import report
from gradeloom.session import checkpoint_dir, written
from gradeloom.sources import records as source
from gradeloom.sources import sinks

# Every line has its own job 'R' || trial: a run record, a result and an artifact.
# pk % 23 = 0 breaks the record's JSON, pk % 29 = 0 puts it under the wrong stage.
VIEWS["f_record_docs"] = """
select t.stage, 'R' || t.trial_name as job_name,
  '{"stage": "' || case when l.pk % 29 = 0 then 'other' else t.stage end || '", "config_identity": "'
  || config_identity || '", "config": {"name": "' || config_name || '", "agent": "' || agent
  || '", "model": "' || model || '", "reasoning_effort": '
  || case when reasoning_effort is null then '7' else '"' || reasoning_effort || '"' end
  || ', "rubric": "default"}, "items": [{"item_id": "stale", "task_dir_name": "task-' || t.trial_name
  || '"}, 5, {"item_id": "unnamed"}, {"task_dir_name": "task-' || t.trial_name || '", "item_id": "'
  || item_id || '", "item_identity": "' || item_identity || '", "course_id": "' || course_id
  || '", "assignment_id": "' || assignment_id || '"'
  || case when submission_source is null then '' else ', "submission_source": "' || submission_source
    || '", "input_hashes": {"rubric": "' || rubric_sha256 || '", "submission": "sub' || l.pk || '"}' end
  || case when student_id is null then ', "student_id": null' else ', "student_id": "' || student_id
    || '"' end
  || case when solve_job_name is null then '' else ', "solve_job_name": "R' || solve_trial_name
    || '", "solve_trial_name": "' || solve_trial_name || '"' end
  || case when context_config_name is null then '' else ', "context_config_name": "'
    || context_config_name || '", "context_config_identity": "' || context_config_identity || '"' end
  || case when prior_trials is null then '' when prior_trials = '' then ', "prior_trials": []'
    when l.pk % 37 = 0 then ', "prior_trials": [{"job_name": "J1"}]'
    else ', "prior_trials": [{"job_name": "' || replace(replace(prior_trials, '/',
      '", "trial_name": "'), '; ', '"}, {"job_name": "') || '"}]' end
  || '}]' || case when l.pk % 23 = 0 then '' else '}' end as text
from f_trials0 t join f_lines l on t.trial_name = l.trial_name"""

VIEWS["f_result_docs"] = """
select t.stage, 'R' || t.trial_name as job_name, t.trial_name,
  '{"task_name": "task-' || t.trial_name || '", "config": {"timeout_multiplier": '
  || case l.pk % 5 when 0 then '2' when 1 then '"x"' when 2 then '0' else 'null' end || '}, '
  || case when reward is null then '"verifier_result": null'
    else '"verifier_result": {"rewards": {"reward": ' || cast(cast(reward as int) as varchar(10))
      || case when score_pct is not null then ', "base_pct": 50' else '' end || '}}' end
  || case when exception_type is null then '' else ', "exception_info": {"exception_type": "'
    || exception_type || '"}' end
  || case when l.pk % 4 = 0 then ', "step_results": [{"agent_result": {"n_input_tokens": ' || l.pk
      || ', "n_cache_tokens": true, "n_output_tokens": 3.5, "cost_usd": 1}}, {}, {"agent_result": '
      || '{"n_input_tokens": 10, "cost_usd": 0.25}}]'
    else ', "agent_result": {"n_input_tokens": ' || l.pk || ', "n_output_tokens": ' || l.sk || '}' end
  || ', "agent_execution": {"started_at": "2025-01-01T00:00:00Z", "finished_at": "2025-01-01T'
  || lpad(cast(cast(floor(agent_execution_sec / 3600) as int) as varchar(4)), 2, '0') || ':'
  || lpad(cast(cast(floor(agent_execution_sec / 60) as int) % 60 as varchar(4)), 2, '0') || ':'
  || lpad(cast(cast(agent_execution_sec as int) % 60 as varchar(4)), 2, '0') || '.5'
  || case when l.pk % 10 = 3 then '' else '+00:00' end || '"}}' as text
from f_trials0 t join f_lines l on t.trial_name = l.trial_name"""

# x = 7 leaves the artifact out; pk % 41 = 0 breaks its contract in several ways.
VIEWS["f_artifact_docs"] = """
select 'R' || t.trial_name as job_name, t.trial_name,
  '{"schema_version": ' || case when l.pk % 41 = 0 and l.ln = 2 then '1.0' else '1' end
  || ', "criteria": ['
  || '{"id": "c1", "title": "T 1", "points": ' || (l.pk + l.sk + l.ln) % 11
  || ', "max_points": 10, "evidence": "e", "bonus": false}, '
  || '{"id": "' || case when l.pk % 41 = 0 and l.ln = 3 then 'c1' else 'c2' end
  || '", "title": "T 2", "points": ' || (l.pk + 2 * l.sk + l.ln) % 16
  || ', "max_points": ' || case when l.pk % 41 = 0 and l.ln = 4 then '"15"' else '15' end
  || ', "evidence": "e"}, '
  || '{"id": "c3", "title": ' || case when l.pk % 41 = 0 and l.ln = 5 then '" "' else '"T 3"' end
  || ', "points": ' || (l.pk + 3 * l.sk + l.ln) % 26
  || ', "max_points": ' || case when l.pk % 41 = 0 and l.ln = 6 then '1' else '25' end
  || ', "evidence": "e"}, '
  || '{"id": "c4", "title": "T 4", "points": ' || (l.pk + 4 * l.sk + l.ln) % 6
  || ', "max_points": 5, "evidence": "e", "bonus": '
  || case when l.pk % 41 = 0 and l.ln = 7 then '1' else 'true' end || '}]'
  || ', "base_max": 50, "bonus_max": 5, "bonus_points": ' || (l.pk + 4 * l.sk + l.ln) % 6
  || ', "base_points": ' || case when l.x = 6 then 'NaN' else cast((l.pk + l.sk + l.ln) % 11
    + (l.pk + 2 * l.sk + l.ln) % 16 + (l.pk + 3 * l.sk + l.ln) % 26 as varchar(10)) end
  || ', "overall_comment": "ok"}' as text, l.pk, l.ln, l.x, l.sk
from f_trials0 t join f_lines l on t.trial_name = l.trial_name
where t.score_pct is not null and not t.grading_load_error"""

VIEWS["f_task_settings"] = """
select 'R' || trial_name as job_name, 'task-' || trial_name as task_name,
  case x when 0 then cast(null as double) when 1 then cast(-5 as double)
    else cast(7200 as double) end as timeout_sec
from f_lines"""

ORACLE_VIEWS["o_lines_ok"] = "select *, pk % 23 <> 0 and pk % 29 <> 0 as record_ok from f_lines"


def _records(v):
    return trials.parse_run_records(v.record_docs)


@query(
    "s01_run_records",
    """select t.stage, 'R' || t.trial_name as job_name, config_name, config_identity, agent, model,
      reasoning_effort, 'default' as config_rubric
    from f_trials0 t join o_lines_ok l on t.trial_name = l.trial_name where record_ok""",
)
def run_records(v):
    return trials.record_configs(_records(v))


@query(
    "s02_items",
    """select t.stage, 'R' || t.trial_name as job_name, 'task-' || t.trial_name as task_name, item_id,
      item_identity, course_id, assignment_id, submission_source, student_id, rubric_sha256,
      case when pk % 37 = 0 and prior_trials <> '' then null else prior_trials end as prior_trials,
      case when prior_trials is null or (pk % 37 = 0 and prior_trials <> '') then null
        when prior_trials = '' then cast(0 as bigint)
        else len(string_split(prior_trials, '; ')) end as n_prior_gradings
    from f_trials0 t join o_lines_ok l on t.trial_name = l.trial_name where record_ok""",
)
def items(v):
    return trials.record_items(_records(v)).select(
        "stage", "job_name", "task_name", "item_id", "item_identity", "course_id",
        "assignment_id", "submission_source", "student_id", "rubric_sha256", "prior_trials",
        "n_prior_gradings",
    )


@query(
    "s03_trial_results",
    """select t.trial_name, reward is not null as verified, score_pct is not null as has_base_pct,
      reward, exception_type
    from f_trials0 t""",
)
def trial_results(v):
    return trials.parse_trial_results(v.result_docs).select(
        "trial_name", "verified", "has_base_pct", "reward", "exception_type"
    )


@query(
    "p04_verified_trials",
    """select stage, count(*) filter (reward is not null) as n_verified,
      count(*) filter (score_pct is not null) as n_graded from f_trials0 group by stage""",
)
def verified_trials(v):
    return (
        trials.parse_trial_results(v.result_docs)
        .groupBy("stage")
        .agg(
            F.count_if("verified").alias("n_verified"), F.count_if("has_base_pct").alias("n_graded")
        )
    )


@query(
    "p05_outcomes",
    """select trial_name, outcome, late_exception from f_trials0""",
)
def outcomes(v):
    parsed = trials.parse_trial_results(v.result_docs)
    outcome = P.trial_outcome(
        F.col("stage"), F.col("verified"), F.col("has_base_pct"), F.col("reward"), F.col("exception_type")
    )
    return parsed.select(
        "trial_name",
        outcome.alias("outcome"),
        (F.col("verified") & F.col("has_exception")).alias("late_exception"),
    )


@query("p06_scores", "select trial_name, score_pct from f_trials0 where stage = 'grade'")
def scores(v):
    parsed = trials.parse_trial_results(v.result_docs).where("stage = 'grade'")
    return parsed.select("trial_name", F.when(F.col("has_base_pct"), F.col("reward")).alias("score_pct"))


@query(
    "p10_typed_fields",
    """select trial_name, case pk % 5 when 0 then cast(2 as double) when 2 then cast(0 as double) end
        as multiplier,
      case when pk % 5 = 1 then 'x' end as multiplier_text,
      case when pk % 4 <> 0 then sk end as n_output_tokens
    from f_lines""",
)
def typed_fields(v):
    parsed = v.result_docs.select("trial_name", J.parse_document(F.col("text")).alias("d"))
    doc = F.col("d")
    return parsed.select(
        "trial_name",
        J.number_field(doc, "$.config.timeout_multiplier").alias("multiplier"),
        J.text_field(doc, "$.config.timeout_multiplier").alias("multiplier_text"),
        J.int_field(doc, "$.agent_result.n_output_tokens").alias("n_output_tokens"),
    )


@query(
    "a15_token_totals",
    """select trial_name, case when pk % 4 = 0 then pk + 10 else pk end as n_input_tokens,
      cast(null as bigint) as n_cache_tokens, case when pk % 4 <> 0 then sk end as n_output_tokens,
      case when pk % 4 = 0 then cast(1.25 as double) end as cost_usd from f_lines""",
)
def token_totals(v):
    return trials.parse_trial_results(v.result_docs).select(
        "trial_name", "n_input_tokens", "n_cache_tokens", "n_output_tokens", "cost_usd"
    )


@query(
    "n05_durations",
    """select trial_name, case when pk % 10 <> 3 then agent_execution_sec + 0.5 end
      as agent_execution_sec from f_trials0 join f_lines using (trial_name)""",
)
def durations(v):
    return trials.parse_trial_results(v.result_docs).select("trial_name", "agent_execution_sec")


@query(
    "s11_agent_timeouts",
    """select trial_name, case when x > 1 then case pk % 5 when 0 then cast(14400 as double)
      when 3 then cast(7200 as double) when 4 then cast(7200 as double) end end as agent_timeout_sec
    from f_lines""",
)
def agent_timeouts(v):
    results = trials.parse_trial_results(v.result_docs)
    return trials.effective_timeouts(results, v.task_settings).select(
        "trial_name", "agent_timeout_sec"
    )


ORACLE_VIEWS["o_artifact"] = """
select job_name, trial_name, pk, ln, x, sk, case when pk % 41 <> 0 then '' else case ln
    when 2 then 'schema_version' when 3 then 'criteria[1]:duplicate_id'
    when 4 then 'criteria[1]:max_points'
    when 5 then 'criteria[2]:title'
    when 6 then case when (pk + 3 * sk + ln) % 26 > 1 then 'criteria[2]:points_range' else '' end
    when 7 then 'criteria[3]:bonus' end end as errors
from f_artifact_docs"""
ORACLE_VIEWS["o_artifact_sums"] = """
select a.*, errors = '' as ok,
  case when pk % 41 = 0 and ln = 6 then 26 else 50 end as base_max,
  (pk + sk + ln) % 11 + (pk + 2 * sk + ln) % 16 + (pk + 3 * sk + ln) % 26 as base_points,
  (pk + 4 * sk + ln) % 6 as bonus_points from o_artifact a"""


@query("a19_contract_violations", "select job_name, trial_name, errors from o_artifact")
def contract_violations(v):
    return contract.parse_artifacts(v.artifact_docs).select(
        *K.TRIAL, F.array_join("errors", ";").alias("errors")
    )


@query(
    "a16_artifact_scores",
    """select trial_name, case when ok then cast(base_points as double) end as base_points,
      case when ok then cast(base_max as double) end as base_max,
      case when ok then cast(bonus_points as double) end as bonus_points,
      case when ok then x <> 6 and base_max = 50 end as sums_consistent,
      case when ok then round(100 * (base_points + bonus_points) / base_max, 6) end as score_pct,
      case when ok then round(100 * base_points / base_max, 6) end as base_pct
    from o_artifact_sums""",
)
def artifact_scores(v):
    return rounded(
        contract.parse_artifacts(v.artifact_docs).select(
            "trial_name", "base_points", "base_max", "bonus_points", "sums_consistent",
            "score_pct", "base_pct",
        )
    )


@query(
    "a16_criteria_sums",
    """select job_name, trial_name, sum(points) filter (not bonus) as base_points,
      sum(max_points) filter (not bonus) as base_max, sum(points) filter (bonus) as bonus_points,
      sum(max_points) filter (bonus) as bonus_max,
      round(100 * sum(points) / sum(max_points) filter (not bonus), 6) as score_pct,
      round(100 * sum(points) filter (not bonus) / sum(max_points) filter (not bonus), 6) as base_pct
    from f_criteria group by all""",
)
def criteria_sums(v):
    return rounded(contract.criteria_sums(v.criteria))


def _loaded(v):
    return v.kept_pair(
        "loaded",
        lambda: trials.load_tables(
            v.record_docs, v.result_docs, v.artifact_docs, v.task_settings, keep=written
        ),
    )


ORACLE_VIEWS["o_loaded0"] = """
select t.* exclude (job_name, late_exception, superseded, n_prior_gradings, prior_trials,
    sums_consistent, grading_load_error, agent_timeout_sec, agent_execution_sec, n_input_tokens,
    n_cache_tokens, n_output_tokens, cost_usd, solve_job_name, solver_config_name,
    solver_config_identity, solver_model),
  'R' || t.trial_name as job_name, reward is not null and exception_type is not null as late_exception,
  case when l.pk % 37 = 0 and prior_trials <> '' then null else prior_trials end as prior_trials,
  case when prior_trials is null or (l.pk % 37 = 0 and prior_trials <> '') then null
    when prior_trials = '' then cast(0 as bigint)
    else len(string_split(prior_trials, '; ')) end as n_prior_gradings,
  case when score_pct is not null and s.ok then s.x <> 6 and s.base_max = 50 end as sums_consistent,
  score_pct is not null and not coalesce(s.ok, false) as grading_load_error,
  case when l.x > 1 then case l.pk % 5 when 0 then cast(14400 as double)
    when 3 then cast(7200 as double) when 4 then cast(7200 as double) end end as agent_timeout_sec,
  case when l.pk % 10 <> 3 then agent_execution_sec + 0.5 end as agent_execution_sec,
  case when l.pk % 4 = 0 then l.pk + 10 else l.pk end as n_input_tokens,
  cast(null as bigint) as n_cache_tokens, case when l.pk % 4 <> 0 then l.sk end as n_output_tokens,
  case when l.pk % 4 = 0 then cast(1.25 as double) end as cost_usd,
  'R' || solve_trial_name as solve_job_name,
  case when k.record_ok then 'solver' end as solver_config_name,
  case when k.record_ok then 'id-solver' end as solver_config_identity,
  case when k.record_ok then 'model-solver' end as solver_model
from f_trials0 t join o_lines_ok l on t.trial_name = l.trial_name
  left join o_artifact_sums s on s.trial_name = t.trial_name
  left join o_lines_ok k on k.trial_name = t.solve_trial_name
where l.record_ok"""
ORACLE_VIEWS["o_loaded_sets"] = """
select config_identity, item_id, context_config_identity, trial_name,
  list_sort(list_distinct(string_split(prior_trials, '; '))) as priors
from o_loaded0 where stage = 'grade' and context_config_identity is not null
  and prior_trials is not null and score_pct is not null"""


@query(
    "j01_trials",
    """select t.* replace (round(agent_execution_sec, 6) as agent_execution_sec),
      exists (select 1 from o_loaded_sets a join o_loaded_sets b
        on a.config_identity = b.config_identity and a.item_id = b.item_id
          and a.context_config_identity = b.context_config_identity
        where a.trial_name = t.trial_name and len(a.priors) < len(b.priors)
          and list_has_all(b.priors, a.priors)) as superseded
    from o_loaded0 t""",
)
def loaded_trials(v):
    return rounded(_loaded(v)[0])


@query(
    "j02_solver_join",
    """select trial_name, solver_config_name, solver_config_identity, solver_model from o_loaded0
    where stage = 'grade'""",
)
def solver_join(v):
    grades = v.trials0.where("stage = 'grade'").withColumn(
        "solve_job_name", F.concat(F.lit("R"), "solve_trial_name")
    )
    known = grades.join(
        _records(v).select(F.col("job_name"), F.lit(True).alias("has_record")).withColumn(
            "trial_name", F.expr("substr(job_name, 2)")
        ).drop("job_name"),
        "trial_name",
        "left_semi",
    )
    solvers = trials.record_configs(_records(v)).where("stage = 'solve'")
    return lineage.with_solver(known, solvers).select(
        "trial_name", "solver_config_name", "solver_config_identity", "solver_model"
    )


@query(
    "j03_criteria",
    """select s.job_name, s.trial_name, 'c' || i as criterion_id, 'T ' || i as title,
      cast((pk + i * sk + ln) % m as double) as points,
      cast(case when i = 3 and pk % 41 = 0 and ln = 6 then 1 else m - 1 end as double) as max_points,
      i = 4 as bonus, i - 1 as position
    from o_artifact_sums s join o_loaded0 t on t.trial_name = s.trial_name
      cross join (values (1, 11), (2, 16), (3, 26), (4, 6)) v(i, m)
    where ok""",
)
def loaded_criteria(v):
    return _loaded(v)[1].select(
        *K.TRIAL, "criterion_id", "title", "points", "max_points", "bonus", "position"
    )


@query(
    "j08_expected_criteria_diff",
    """select * from (select job_name, trial_name, criterion_id,
        cast(case when hit then null else emax end as double) as expected_max,
        case when dropped then null else max_points end as got_max,
        case when dropped then 'missing' when hit then 'not_in_rubric'
          when emax <> max_points then 'max_points' end as problem
      from (select *, criterion_id = 'c2' and length(trial_name) % 5 = 0 as dropped,
          criterion_id = 'c4' and length(trial_name) % 7 = 0 as hit,
          case when criterion_id = 'c3' and length(trial_name) % 3 = 0 then 20 else max_points end as emax
        from f_criteria) c) d where problem is not null""",
)
def expected_diff(v):
    size = F.length("trial_name")
    authored = v.criteria.where(~((F.col("criterion_id") == "c2") & (size % 5 == 0)))
    expected = v.criteria.where(~((F.col("criterion_id") == "c4") & (size % 7 == 0))).withColumn(
        "max_points",
        F.when((F.col("criterion_id") == "c3") & (size % 3 == 0), 20.0).otherwise(F.col("max_points")),
    )
    return contract.expected_criteria_diff(expected, authored)


@query(
    "s04_load_errors",
    """select trial_name, pk % 41 <> 0 or (ln = 6 and (pk + 3 * sk + ln) % 26 <= 1) as valid
    from f_artifact_docs""",
)
def load_errors(v):
    return contract.parse_artifacts(v.artifact_docs).select(
        "trial_name", (F.size("errors") == 0).alias("valid")
    )


@query(
    "s17_deliverable_errors",
    """select 'J' as job_name, cast(doc_id as varchar) as trial_name,
      case when doc_id % 6 = 5 then 'a/b.md' else 'feedback.md' end as name,
      case when doc_id % 6 = 5 then 'malformed_declaration' when doc_id % 6 = 1 then 'missing'
        when doc_id % 6 = 2 then 'not_utf8' else 'empty' end as problem
    from documents where doc_id % 6 in (1, 2, 3, 5)""",
)
def deliverables(v):
    kind = F.col("doc_id") % 6
    base = v.documents.select(
        F.lit("J").alias("job_name"), F.col("doc_id").cast("string").alias("trial_name"), "doc_id", "text"
    )
    declared = base.select(
        *K.TRIAL, F.when(kind == 5, "a/b.md").otherwise("feedback.md").alias("name")
    )
    content = (
        F.when(kind == 2, F.unhex(F.lit("FFFE41")))
        .when(kind == 3, F.encode(F.lit(" \n\t"), "UTF-8"))
        .otherwise(F.encode("text", "UTF-8"))
    )
    files = base.where(kind != 1).select(
        *K.TRIAL, F.lit("feedback.md").alias("name"), content.alias("content")
    )
    return contract.deliverable_errors(declared, files)


# Rubric texts: one per part, with prose, four criterion lines and planted errors.
VIEWS["f_rubric_texts"] = """
select p_brand as course_id, 'A' || p_partkey as assignment_id, p_partkey,
  '# Rubric' || chr(10) || '- `c1` (10 points): First ' || p_name || chr(10)
  || '  - `c2` (' || p_size || ' points): Second' || chr(10) || 'prose - `x`' || chr(10)
  || case p_partkey % 7 when 1 then '- `c 3` (5 points): Spaced' when 2 then '- `c1` (5 points): Again'
    when 3 then '- `c3` (0 points): Zero' when 4 then '- `c3` (five points): Words'
    else '- `c3` (2.5 points): Third' end || chr(10)
  || '- `c4` (1 point , bonus): Extra' as text
from part"""


@query(
    "n15_rubric_lines",
    """select p_partkey, case p_partkey % 7 when 1 then 'line 5: id_has_space'
        when 2 then 'line 5: duplicate_id' when 3 then 'line 5: points_not_positive'
        when 4 then 'line 5: format' else '' end as errors,
      case when p_partkey % 7 = 4 then 3 else 4 end as n_criteria,
      10 + p_size + 1 + case p_partkey % 7 when 1 then 5 when 2 then 5 when 3 then 0 when 4 then 0
        else 2.5::double end as total
    from part""",
)
def rubric_lines(v):
    parsed = rubrics.parse_rubrics(v.rubric_texts)
    return parsed.select(
        "p_partkey",
        F.array_join("errors", ";").alias("errors"),
        F.size("criteria").alias("n_criteria"),
        F.aggregate("criteria", F.lit(0.0), lambda a, c: a + c["max_points"]).alias("total"),
    )


@query(
    "n15_rubric_criteria",
    """select course_id, assignment_id, sha256(text) as sha256, 'c' || i as criterion_id,
      cast(case i when 1 then 10 when 2 then p_size when 3 then 2.5 else 1 end as double) as max_points,
      i = 4 as bonus,
      case i when 1 then 'First ' || p_name when 2 then 'Second' when 3 then 'Third' else 'Extra' end
        as title
    from f_rubric_texts join part using (p_partkey) cross join (values (1), (2), (3), (4)) v(i)
    where p_partkey % 7 not in (1, 2, 3, 4)""",
)
def parsed_criteria(v):
    # The parts are a small file, and each stands for much work.
    texts = v.rubric_texts.repartition(v.spark.sparkContext.defaultParallelism)
    return rubrics.rubric_criteria(
        rubrics.parse_rubrics(texts.withColumn("sha256", F.sha2("text", 256)))
    )


VIEWS["f_rubric_files"] = """
select course_id, assignment_id, 'rubrics/' || assignment_id || '/'
  || case i when 1 then 'default.md' when 2 then 'archive/a.md' else 'archive/b.md' end as path,
  case when i = 3 and p_partkey % 3 = 0 then text || ' old' when i = 2 and p_partkey % 2 = 0
    then text || ' older' else text end as text
from f_rubric_texts cross join (select * from (values (1), (2), (3)) v(i)) c"""


@query(
    "s08_rubric_versions",
    """select course_id, assignment_id, sha256(text) as sha256,
      coalesce(min(path) filter (not contains(path, '/archive/')), min(path)) as path
    from f_rubric_files group by all""",
)
def rubric_versions(v):
    files = v.rubric_files.withColumn("content", F.encode("text", "UTF-8"))
    return rubrics.rubric_versions(files).drop("content")


def _run_items(v):
    return v.trials0.select(
        "stage", "course_id", "assignment_id", "rubric_name", "rubric_sha256", "job_name"
    )


@query(
    "a18_recorded_rubrics",
    """select course_id, assignment_id, rubric_name, rubric_sha256,
      count(distinct job_name) as n_jobs, min(job_name) as first_job
    from f_trials0 where stage = 'grade' group by all""",
)
def recorded_rubrics(v):
    return rubrics.recorded_rubrics(_run_items(v))


@query(
    "a18_recorded_rubric_jobs",
    """select distinct course_id, assignment_id, rubric_name, rubric_sha256, job_name
    from f_trials0 where stage = 'grade'""",
)
def recorded_rubric_jobs(v):
    return rubrics.recorded_rubric_jobs(_run_items(v))


@query(
    "j15_orphaned_rubrics",
    """select distinct course_id, assignment_id, rubric_sha256 from f_trials0 t
    where stage = 'grade' and not exists (select 1 from f_rubric_criteria r
      where r.course_id = t.course_id and r.assignment_id = t.assignment_id
        and r.sha256 = t.rubric_sha256)""",
)
def orphaned_rubrics(v):
    orphans = rubrics.orphaned_rubrics(rubrics.recorded_rubrics(_run_items(v)), v.rubric_criteria)
    return orphans.select("course_id", "assignment_id", "rubric_sha256").distinct()


@query(
    "s09_submission_listing",
    """select distinct course_id, student_id, assignment_id,
      course_id || '/' || student_id || '/' || assignment_id as item_id
    from f_student_work""",
)
def submission_listing(v):
    paths = v.student_work.select(
        F.concat(
            F.lit("file:/data/submissions/"), "course_id", F.lit("/"), "student_id", F.lit("/"),
            "assignment_id", F.lit("/src/main.py"),
        ).alias("path")
    )
    return source.submissions_of_paths(paths)


@query(
    "s05_students",
    """select student_id, course_id, lms_person_id, lms_username, display_name, source
    from f_students""",
)
def students_csv(v):
    line = F.to_csv(
        F.struct("student_id", "course_id", "lms_person_id", "lms_username", "display_name", "source")
    )
    return source.parse_students(v.students.select(line.alias("line")))


@query(
    "s06_enrollments",
    """select course_id, lower(ltrim(lms_username, '#')) as account, rubric, source,
      case when source = '' then 'blank_field' end as problem
    from (select course_id, lms_username, rubric, case when rubric = 'MACHINERY' then '' else source end
      as source from f_enrollments) e""",
)
def enrollments(v):
    rows = v.enrollments.withColumn(
        "source", F.when(F.col("rubric") == "MACHINERY", "").otherwise(F.col("source"))
    )
    return source.checked_enrollments(rows)


@query(
    "s07_roster",
    """select username, lower(ltrim(username, '#')) as account, 'Exam 1 Points Grade' as grade_column,
      cast(100 as double) as maximum, case when c_custkey % 5 = 0 then 'bad_row_end' end as problem
    from f_roster""",
)
def roster(v):
    headers = [
        "Username",
        "Exam 1 Points Grade <Numeric MaxPoints:100 Weight:5>",
        "End-of-Line Indicator",
    ]
    rows = v.roster.select(
        F.col("username").alias(headers[0]),
        F.lit("").alias(headers[1]),
        F.when(F.col("c_custkey") % 5 == 0, "").otherwise("#").alias(headers[2]),
    )
    return source.roster_from_table(rows)


@query(
    "s15_provenance",
    """select 42 as seed, count(*) as n_trials,
      (select count(*) from f_criteria) as n_criteria_rows,
      (select count(*) from (select distinct stage, config_name, config_identity from f_trials0) c)
        as n_configs,
      count(distinct job_name) filter (stage = 'solve') as n_solve_jobs,
      count(distinct job_name) filter (stage = 'grade') as n_grade_jobs
    from f_trials0""",
)
def provenance(v):
    return report.provenance(v.trials0, v.criteria).select(
        "seed", "n_trials", "n_criteria_rows", "n_configs", "n_solve_jobs", "n_grade_jobs"
    )


@query(
    "s15_sources",
    """select stage, config_name, config_identity, job_name, count(*) as n_trials
    from f_trials0 group by all""",
)
def sources(v):
    return report.sources(v.trials0)


def _target(v, name: str) -> str:
    return f"{checkpoint_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "s12_written_report",
    """select config_name, config_identity, course_id, assignment_id, job_name, trial_name, outcome
    from f_trials0 s where stage = 'solve' and not exists (select 1 from o_valid g
      where g.solve_job_name = s.job_name and g.solve_trial_name = s.trial_name)""",
)
def written_report(v):
    """The report's table of ungraded trials, written and read back."""
    target = _target(v, "s12")
    table = accounting.ungraded_solve_trials(v.trials)
    sinks.write_report({"ungraded_solve_trials": table}, target, "parquet")
    return v.spark.read.schema(table.schema).parquet(f"{target}/ungraded_solve_trials")


@query(
    "s13_scoped_overwrite",
    """select trial_name, course_id, assignment_id, 'old' as run from f_trials0
      where not (course_id in ('C1', 'C2', 'C3'))
    union all
    select trial_name, course_id, assignment_id, 'new' from f_trials0
      where course_id in ('C1', 'C2') and assignment_id <> 'HW0'""",
)
def scoped_overwrite(v):
    """Everything written once; then three courses again, without C3 and without HW0.

    C3 and the HW0 of C1 and C2 are in the scope and have no rows: they end up empty.
    """
    target = _target(v, "s13")
    rows = v.trials0.select("trial_name", "course_id", "assignment_id")
    sinks.write_scoped(rows.withColumn("run", F.lit("old")), target)
    scope = [(f"C{c}", f"HW{a}") for c in (1, 2, 3) for a in range(12)]
    again = rows.where("course_id in ('C1', 'C2') and assignment_id != 'HW0'")
    sinks.write_scoped(again.withColumn("run", F.lit("new")), target, scope)
    return sinks.read_scoped(v.spark, target, "trial_name string, run string, course_id string, assignment_id string")


@query(
    "n06_general_format",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, format('{:g}', x) as big,
      format('{:g}', x / 1e9) as small
    from (select *, l_extendedprice * l_quantity / 7 as x from lineitem) l""",
)
def general_format(v):
    x = F.col("l_extendedprice") * F.col("l_quantity") / 7
    return v.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        N.format_general(x).alias("big"), N.format_general(x / 1e9).alias("small"),
    )


def _blob(label: str, value: str) -> str:
    """One labelled, length-prefixed part as DuckDB blob SQL; an absent value adds nothing."""
    return (
        f"coalesce(encode('{label}') || unhex('00') || unhex(format('{{:016x}}', strlen({value})))"
        f" || encode({value}), unhex(''))"
    )


_HEADER = "encode('aat-parts-sha256-v1') || unhex('00')"


@query(
    "n10_parts_digest",
    f"""select o_orderkey, sha256({_HEADER} || {_blob("status", "o_orderstatus")}
      || {_blob("priority", "case when o_orderkey % 2 = 0 then o_orderpriority end")}) as digest
    from orders""",
)
def parts_digest(v):
    parts = [
        ("status", F.col("o_orderstatus"), None),
        ("priority", F.col("o_orderpriority"), F.col("o_orderkey") % 2 == 0),
    ]
    return v.orders.select("o_orderkey", N.parts_digest(parts).alias("digest"))


@query(
    "n11_item_identities",
    f"""select o_orderkey, config_identity, sha256({_HEADER}
      || {_blob("config-identity", "config_identity")} || {_blob("environment", "'environment'")}
      || {_blob("rubric", "case when o_orderkey % 3 = 0 then o_orderpriority end")}
      || {_blob("prior-gradings", "case when o_orderkey % 5 = 0 then md5(o_orderstatus) end")})
      as item_identity
    from (select *, sha256({_HEADER} || {_blob("config", "o_orderstatus")}
        || {_blob("prompt", "o_orderpriority")} || {_blob("verifier", "'verify'")}
        || {_blob("task-toml", "'settings'")}
        || {_blob("rubric-override", "case when o_orderkey % 2 = 0 then 'strict' end")})
        as config_identity from orders) o""",
)
def item_identities(v):
    config = N.config_identity(
        F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit("verify"), F.lit("settings"),
        rubric_override=F.when(F.col("o_orderkey") % 2 == 0, F.lit("strict")),
    )
    identity = N.item_identity(
        F.col("config_identity"),
        F.lit("environment"),
        rubric=F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")),
        prior_gradings_hash=F.when(F.col("o_orderkey") % 5 == 0, F.md5("o_orderstatus")),
    )
    return (
        v.orders.withColumn("config_identity", config)
        .withColumn("item_identity", identity)
        .select("o_orderkey", "config_identity", "item_identity")
    )


@query(
    "n17_justification_paths",
    """select trial_name, 'grading/' || job_name || '/' || trial_name
      || '/artifacts/app/grading_output/justification.md' as path
    from f_trials0 where stage = 'grade'""",
)
def paths(v):
    names = F.array(F.concat("job_name", F.lit("/"), "trial_name"))
    return v.trials0.where("stage = 'grade'").select(
        "trial_name", N.justification_paths(names)[0].alias("path")
    )
