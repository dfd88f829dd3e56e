"""Assessment-shaped views of the given test tables.

Each view is one SELECT in SQL common to Spark and DuckDB, so that a query and
its oracle start from the same rows. Views name each other and the base tables;
dependencies are found by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.json_fields import once
from gradeloom.operators.ladder import grades_by_assignment
from gradeloom.operators.lineage import mark_superseded, superseded_sets
from gradeloom.operators.review import review_queue
from gradeloom.operators.students import student_grades

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

VIEWS["f_lines"] = """
select l_orderkey as ok, l_partkey as pk, l_suppkey as sk, l_linenumber as ln, o_custkey as ck,
  l_extendedprice as ep, cast(round(l_discount * 100) as int) as d,
  cast(round(l_tax * 100) as int) as x,
  't' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
    || cast(round(l_extendedprice * 100) as bigint) as trial_name,
  'J' || (l_suppkey % 7) as job_name
from lineitem join orders on l_orderkey = o_orderkey"""

VIEWS["f_solve_link"] = """
select ok as link_ok, min(trial_name) as solve_trial, min_by(job_name, trial_name) as solve_job
from f_lines where ln = 1 group by ok"""

# The first three scored grader-a trials of an order are all a judge can have seen.
VIEWS["f_first_gradings"] = """
select ok as first_ok, max(case when rn = 1 then ref end) as p1,
  max(case when rn = 2 then ref end) as p2, max(case when rn = 3 then ref end) as p3
from (
  select ok, job_name || '/' || trial_name as ref,
    row_number() over (partition by ok order by job_name, trial_name) as rn
  from f_lines where ln in (2, 4, 6) and d between 3 and 9
) numbered where rn <= 3 group by ok"""

VIEWS["f_priors"] = """
select trial_name as judge_trial,
  case when pk % 3 >= 2 and p3 is not null then p1 || '; ' || p2 || '; ' || p3
       when pk % 3 >= 1 and p2 is not null then p1 || '; ' || p2
       when p1 is not null then p1
       when pk % 2 = 0 then '' end as prior_trials,
  case when pk % 3 >= 2 and p3 is not null then 3
       when pk % 3 >= 1 and p2 is not null then 2
       when p1 is not null then 1
       when pk % 2 = 0 then 0 end
    + case when pk % 10 = 0 then 1 else 0 end as n_prior
from (select * from f_lines where ln = 7) j left join f_first_gradings on ok = first_ok"""

VIEWS["f_trials0"] = """
select case when ln = 1 then 'solve' else 'grade' end as stage, job_name, trial_name,
  case when ln = 1 then course_id || '/' || assignment_id
       when derived then solve_job || '/' || solve_trial
       else course_id || '/' || who || '/' || assignment_id end as item_id,
  'I' || ok || '-' || config_name as item_identity, course_id, assignment_id, config_name,
  'id-' || config_name as config_identity, 'agent' || (ln % 2) as agent,
  'model-' || config_name as model, case when ln = 1 then null else 'high' end as reasoning_effort,
  case d when 0 then 'timeout' when 1 then 'agent_error' when 2 then 'contract_failed'
    when 10 then 'unknown' else 'completed' end as outcome,
  (x = 8 and d not in (0, 1, 10)) as late_exception,
  case when d = 0 then 'AgentTimeoutError' when d = 1 then 'ApiRateLimitError'
    when d = 10 then 'OddError' when x = 8 then 'KeyboardInterrupt' end as exception_type,
  case when d in (0, 1, 10) then cast(null as double)
    when ln = 1 then case when d = 2 then cast(0 as double) else cast(1 as double) end
    when d = 2 then cast(0 as double) else score end as reward,
  case when ln <> 1 and d between 3 and 9 then score end as score_pct,
  case when ln <> 1 and d between 3 and 9 and x <> 7 then x <> 6 end as sums_consistent,
  (ln <> 1 and d between 3 and 9 and x = 7) as grading_load_error,
  cast(case when pk % 11 = 0 then null else pk * 10 + ln end as bigint) as n_input_tokens,
  cast(case when pk % 13 = 0 then null else pk end as bigint) as n_cache_tokens,
  cast(case when pk % 17 = 0 then null else sk * 3 end as bigint) as n_output_tokens,
  case when pk % 19 = 0 then null else cast(sk as double) / 4 end as cost_usd,
  cast(null as double) as environment_setup_sec, cast(null as double) as agent_setup_sec,
  cast(cast(floor(ep) as bigint) % 9000 as double) as agent_execution_sec,
  cast(null as double) as verifier_sec,
  case when x = 0 then cast(null as double) else cast(7200 as double) end as agent_timeout_sec,
  cast(null as varchar(20)) as started_at, cast(null as varchar(20)) as finished_at,
  case when ln <> 1 then case when derived then 'solve-trial' else 'student' end
    end as submission_source,
  case when ln <> 1 and not derived then who end as student_id,
  case when ln <> 1 then 'default' end as rubric_name,
  case when ln <> 1 then case when ok % 12 = 4 then case when ok % 24 >= 12 then 'r1' else 'r0' end
    else 'r' || (ok % 3) end end as rubric_sha256,
  case when derived then solve_job end as solve_job_name,
  case when derived then solve_trial end as solve_trial_name,
  case when derived then 'solver' end as solver_config_name,
  case when derived then 'id-solver' end as solver_config_identity,
  case when derived then 'model-solver' end as solver_model,
  case when ln = 7 then 'grader-a' end as context_config_name,
  case when ln = 7 then 'id-grader-a' end as context_config_identity,
  cast(n_prior as bigint) as n_prior_gradings, prior_trials, false as superseded
from (
  select l.*, solve_job, solve_trial, prior_trials, n_prior,
    'C' || (ck % 25) as course_id, 'HW' || (ok % 12) as assignment_id,
    case when ln = 1 then 'solver' when ln = 7 then 'judge' when ln % 2 = 0 then 'grader-a'
      else 'grader-b' end as config_name,
    case ck % 50 when 0 then '_reference' when 1 then '_irrelevant' when 2 then '_x'
      else 'S' end || ck as who,
    (ln <> 1 and solve_trial is not null and ok % 2 = 0 and not (ck % 25 = 3 and ok % 12 = 0))
      as derived,
    cast((pk + sk + ln) % 11 + (pk + 2 * sk + ln) % 16 + (pk + 3 * sk + ln) % 26
      + (pk + 4 * sk + ln) % 6 as double) * 2 as score
  from f_lines l left join f_solve_link on ok = link_ok
    left join f_priors on trial_name = judge_trial
) shaped"""

VIEWS["f_criteria"] = """
select t.job_name, t.trial_name, item_id, item_identity, config_name, config_identity,
  'c' || i as criterion_id, 'Criterion ' || i as title,
  cast((pk + i * sk + ln) % (mx + 1) as double) as points, cast(mx as double) as max_points,
  i = 4 as bonus
from f_trials0 t join f_lines l on t.trial_name = l.trial_name
  cross join (select * from (values (1, 10), (2, 15), (3, 25), (4, 5)) v(i, mx)) c
where score_pct is not null and not grading_load_error"""

# Rubric versions: r0 faithful, r1 with another maximum, r2 nowhere on disk.
VIEWS["f_rubric_criteria"] = """
select course_id, assignment_id, sha256, 'c' || i as criterion_id,
  cast(case when sha256 = 'r1' and i = 3 then 20 else mx end as double) as max_points,
  i = 4 as bonus
from (select distinct 'C' || (o_custkey % 25) as course_id, 'HW' || (o_orderkey % 12) as assignment_id
      from orders) a
  cross join (select * from (values ('r0'), ('r1')) v(sha256)) s
  cross join (select * from (values (1, 10), (2, 15), (3, 25), (4, 5)) v(i, mx)) c"""

VIEWS["f_uploads"] = """
select event_type as assignment_id, cast(user_id as varchar(20)) as person_id,
  date_trunc('minute', ts) as submitted_at, user_id || '-' || event_id as dir_name,
  'f' || (k % 4) || case k % 3 when 0 then '.pdf' when 1 then '.ipynb' else '.csv' end as relpath,
  'd' || (k % 5) as digest, 'K' || (user_id % 3) as course_id,
  'u' || user_id as username, 'User ' || user_id || case when k % 29 = 0 then ' Jr' else '' end
    as display_name, user_id, event_id, k
from (select event_type, user_id, event_id, ts,
        cast(regexp_replace(props, '[^0-9]', '', 'g') as int) as k from events) e"""

VIEWS["f_selections"] = """
select assignment_id, person_id, min(dir_name) as folder, 'reviewed' as reason
from f_uploads where user_id % 17 = 0 group by assignment_id, person_id"""

VIEWS["f_known_people"] = """
select 'S' || case when user_id < 999 then lpad(cast(user_id + 1 as varchar(20)), 3, '0')
    else cast(user_id + 1 as varchar(20)) end as student_id,
  'K' || (user_id % 3) as course_id, cast(user_id as varchar(20)) as lms_person_id,
  'u' || user_id as lms_username, 'User ' || user_id as display_name, 'brightspace' as source
from (select distinct user_id from events where user_id % 10 <> 0) e"""

VIEWS["f_students"] = """
select 'S' || c_custkey as student_id, 'C' || (c_custkey % 25) as course_id,
  cast(c_custkey as varchar(20)) as lms_person_id,
  case when c_custkey % 7 = 0 then '#' else '' end || 'User' ||
    case when c_custkey % 97 = 0 and c_custkey > 0 then c_custkey - 25 else c_custkey end
    as lms_username,
  c_name as display_name, 'brightspace' as source, c_custkey
from customer"""

VIEWS["f_roster"] = """
select '#USER' || c_custkey as username, cast(100 as double) as maximum, c_custkey
from customer where c_custkey % 11 <> 0"""

VIEWS["f_enrollments"] = """
select 'C' || (c_custkey % 25) as course_id, 'user' || c_custkey as lms_username,
  c_mktsegment as rubric, 'registrar' as source
from customer where c_custkey % 13 <> 0"""

VIEWS["f_assessments"] = """
select p_brand as course_id, 'A' || p_partkey as id, p_name as title,
  case p_partkey % 7 when 0 then 'homework' when 1 then 'exam' when 2 then 'practice'
    when 3 then 'project' when 4 then 'attendance' when 5 then 'other' end as type,
  case p_partkey % 4 when 0 then 'take_home' when 1 then 'in_person' when 2 then 'online_exam' end
    as scope,
  case when p_partkey % 1000 = 999 then cast(null as double) else cast(p_size as double) end
    as weight_pct,
  p_type as category,
  case p_partkey % 3 when 0 then 'allowed' when 1 then 'not_allowed' end as ai_policy,
  case when p_partkey % 5 = 0 then null else p_partkey % 2 = 0 end as ai_use_possible,
  case when p_size > 45 then 'not offered' end as excluded,
  case p_partkey % 6 when 0 then 'authored' when 1 then 'handout' when 2 then 'applied_scheme'
    when 3 then 'professor_rubric' end as rubric_provenance,
  p_size % 5 = 0 as routed, p_partkey, p_size
from part"""

VIEWS["f_materials"] = """
select p_brand as course_id, 'A' || p_partkey as assignment_id, p_partkey
from part join (select distinct l_partkey from lineitem where l_suppkey % 10 = 0) m
  on p_partkey = l_partkey"""

VIEWS["f_planned"] = """
select item_id, item_identity, cast(3 as bigint) as attempts, 'grade' as stage
from (select distinct item_id, item_identity from f_trials0 where stage = 'grade') p
union all
select item_id, item_identity || '-new', cast(3 as bigint), 'grade'
from (select distinct t.item_id, t.item_identity from f_trials0 t join f_lines l
      on t.trial_name = l.trial_name where t.stage = 'grade' and l.ok % 5 = 0) q"""

VIEWS["f_manifest"] = """
select source as dir, lang || '/' || doc_id || case when doc_id % 41 = 0 then '.swp' else '.txt' end
  as relpath, doc_id
from documents"""

VIEWS["f_pages"] = """
select cast(page_id as varchar(20)) || '.pdf' as path, i as page, page_id,
  case when page_id % 9 = 0 then cast(null as double)
    else cast((page_id * 7 + i) % 40 as double) / 10000 end as ink,
  cast(length(html) % 3000 as bigint) as content_bytes, page_id % 8 <> 0 as render_exists,
  500 * (1 + page_id % 4) as side,
  case when page_id % 6 = 0 then cast(null as double)
    else cast((page_id + i) % 30 as double) / 1000 end as nonwhite,
  case when page_id % 5 = 0 then 'smask' else 'image' end as image_type
from pages cross join (select * from (values (1), (2), (3)) v(i)) c"""

# For Spark, what the joins by order and by trial name tell is told by windows over the lines
# of an order, which a trial name holds: lines are shuffled once, by order, as whole numbers,
# and sorted once. Lines of one name meet each other as in the joins.
_CASES = VIEWS["f_priors"]
_PRIOR = _CASES[_CASES.index("case when") : _CASES.index(" as prior_trials")]
_N_PRIOR = _CASES[_CASES.index("case", _CASES.index(" as prior_trials")) : _CASES.index(" as n_prior")]
# What a view that joins trials to their lines may name of a line.
_LINE = "ok, ck, ln, pk, sk, x"
SPARK_VIEWS: dict[str, str] = {
    "f_whole_lines": """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
  cast(round(l_discount * 100) as int) as d, cast(round(l_tax * 100) as int) as x
from lineitem""",
    "f_lines": VIEWS["f_lines"]
    .replace("cast(round(l_discount * 100) as int) as d", "d")
    .replace("cast(round(l_tax * 100) as int) as x", "x")
    .replace("from lineitem", "from f_whole_lines"),
    "f_order_places": f"""
select *, case when ln in (2, 4, 6) and d between 3 and 9 then job_name || '/' || trial_name end as ref,
  sum(case when ln in (2, 4, 6) and d between 3 and 9 then 1 else 0 end) over (
    partition by ok order by job_name, trial_name rows between unbounded preceding and current row
  ) as place,
  count(*) over (partition by ok, job_name, trial_name) as n_same,
  collect_list(struct({_LINE})) over (partition by ok, job_name, trial_name) as lines
from f_lines""",
    "f_order_links": """
select *, min(case when ln = 1 then trial_name end) over (partition by ok) as solve_trial,
  min_by(job_name, case when ln = 1 then trial_name end) over (partition by ok) as solve_job,
  max(case when place = 1 then ref end) over (partition by ok) as p1,
  max(case when place = 2 then ref end) over (partition by ok) as p2,
  max(case when place = 3 then ref end) over (partition by ok) as p3
from f_order_places""",
    "f_order_priors": f"""
select ok, pk, sk, ln, ck, ep, d, x, trial_name, job_name, solve_trial, solve_job,
  case when trial_name is not null then lines end as same,
  case when ln = 7 and trial_name is not null then {_PRIOR} end as prior_trials,
  case when ln = 7 and trial_name is not null then {_N_PRIOR} end as n_prior,
  explode(case when ln = 7 and trial_name is not null then array_repeat(0, cast(n_same as int))
    else array(0) end) as again
from f_order_links""",
    "f_order_trials": VIEWS["f_trials0"]
    .replace("select case when ln = 1", "select same, case when ln = 1", 1)
    .replace("select l.*, solve_job, solve_trial, prior_trials, n_prior,", "select l.*,", 1)
    .replace(
        """from f_lines l left join f_solve_link on ok = link_ok
    left join f_priors on trial_name = judge_trial""",
        "from f_order_priors l",
    ),
}
_BY_NAME = "f_trials0 t join f_lines l on t.trial_name = l.trial_name"
_BY_ORDER = f"f_order_trials t join lateral inline(t.same) as l({_LINE})"

_SHARED: dict[tuple[str, str], SparkViews] = {}


def shared_views(spark: SparkSession, folder: str) -> SparkViews:
    """One set of views per application and folder, so kept tables are reused."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SHARED:
        _SHARED[key] = SparkViews(spark, folder)
    return _SHARED[key]


_NAME = re.compile(r"\b([fo]_\w+)\b")
_TABLE = re.compile(r"\b(?:from|join)\s+(" + "|".join(BASE_TABLES) + r")\b")


def view_dependencies(sql: str, known: dict[str, str]) -> list[str]:
    return [n for n in dict.fromkeys(_NAME.findall(sql)) if n in known]


class SparkViews:
    """The views as lazy DataFrames over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self._built: dict[str, DataFrame] = {}
        self._pairs: dict[str, tuple[DataFrame, ...]] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._built[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in BASE_TABLES:
            return self.table(name)
        if name not in self._built:
            if name == "trials0":
                self._built[name] = self.order_trials.drop("same")
            else:
                view = self.sql({**VIEWS, **SPARK_VIEWS}["f_" + name])
                if name.endswith("_docs"):
                    # Stands for stored files: the text is built once for each reader.
                    view = view.withColumn("text", once(F.col("text")))
                self._built[name] = view
        return self._built[name]

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table that several queries read, persisted on first use."""
        if name not in self._built:
            self._built[name] = build().persist(StorageLevel.MEMORY_AND_DISK)
        return self._built[name]

    def kept_pair(self, name: str, build: Callable[[], tuple[DataFrame, ...]]):
        """Several derived tables built together; whole rows are not held."""
        if name not in self._pairs:
            self._pairs[name] = build()
        return self._pairs[name]

    def build_fixture(self) -> None:
        """The given tables in the shapes of stored files: what stands before the engine."""
        for df in (self.trials0, self.record_docs, self.result_docs, self.artifact_docs):
            df.count()

    def forget_derived(self) -> None:
        """Drops every kept table that an operator made, so that the next query starts cold."""
        for name in ("replaced_sets", "per_assignment"):
            if name in self._built:
                self._built.pop(name).unpersist()
        self._built.pop("trials", None)
        self._pairs.clear()

    @property
    def trials(self) -> DataFrame:
        """The trials view with superseded judgments marked.

        Whole rows are not kept: a query computes the columns that it reads, which costs
        less than rows of all columns held on disk. What is kept is who is replaced.
        """
        if "trials" not in self._built:
            replaced = self.kept("replaced_sets", lambda: superseded_sets(self.trials0))
            self._built["trials"] = mark_superseded(self.trials0, replaced)
        return self._built["trials"]

    @property
    def per_assignment(self) -> DataFrame:
        return self.kept("per_assignment", lambda: grades_by_assignment(self.trials))

    @property
    def student_table(self) -> DataFrame:
        return student_grades(self.trials)

    @property
    def queue(self) -> DataFrame:
        return review_queue(self.trials)

    def sql(self, text: str) -> DataFrame:
        """Run common SQL with views and base tables bound by name."""
        text = text.replace("'[^0-9]', '', 'g'", "'[^0-9]', ''").replace(_BY_NAME, _BY_ORDER)
        text = text.replace("{", "{{").replace("}", "}}")
        text = re.sub(r"(?<!\w)(f_\w+)", lambda m: "{" + m[1] + "}" if m[1] in VIEWS or m[1] in SPARK_VIEWS else m[1], text)
        text = _TABLE.sub(lambda m: m[0].replace(m[1], "{" + m[1] + "}"), text)
        bound = {}
        for name in set(re.findall(r"(?<!\{)\{(\w+)\}", text)):
            bound[name] = getattr(self, name[2:] if name.startswith("f_") else name)
        return self.spark.sql(text, **bound)


def duckdb_sql(body: str, extra: dict[str, str] | None = None) -> str:
    """The body with every view it needs as a WITH clause in dependency order."""
    known = {**VIEWS, **(extra or {})}
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in view_dependencies(sql, known):
            if name not in ordered:
                visit(known[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body
    clauses = ",\n".join(f"{name} as materialized ({known[name]})" for name in ordered)
    return f"with {clauses}\n{body}"
