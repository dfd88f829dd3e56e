"""Course audits, document evidence, and the streaming fold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gradeloom.checks.registry import ORACLE_VIEWS, query, rounded
from gradeloom.checks.views import VIEWS
from gradeloom.functions import scalars as N
from gradeloom.operators import audit, evidence
from gradeloom.session import checkpoint_dir
from gradeloom.streaming import doneness

VIEWS["f_listing"] = """
select course_id, 'assignments/A' || p_partkey as path, true as is_dir from f_materials
union all select course_id, 'assignments/A' || p_partkey || '/handout.pdf', false from f_materials
  where p_partkey % 50 <> 0
union all select p_brand, 'assignments/A' || p_partkey || '.toml', false from part where p_partkey % 20 = 3
union all select p_brand, 'assignments/notes' || p_partkey || '.txt', false from part
  where p_partkey % 301 = 1
union all select p_brand, 'rubrics/A' || p_partkey || '/default.md', false from part
  where p_partkey % 3 <> 0
union all select p_brand, 'rubrics/A' || p_partkey || '/source/r.pdf', false from part
  where p_partkey % 8 = 1
union all select p_brand, 'rubrics/A' || p_partkey || '/source', false from part where p_partkey % 97 = 6
union all select p_brand, 'rubrics/A' || p_partkey || '/source', true from part where p_partkey % 89 = 7
union all select p_brand, 'rubrics/A' || p_partkey || '/archive', false from part where p_partkey % 101 = 2
union all select p_brand, 'rubrics/Z' || p_partkey || '/default.md', false from part where p_partkey % 211 = 0
union all select p_brand, 'reference_solutions/A' || p_partkey || '/s.py', false from part
  where p_partkey % 4 <> 1
union all select p_brand, 'reference_solutions/Y' || p_partkey, true from part where p_partkey % 307 = 0
union all select p_brand, 'tmp' || p_partkey || '/x', false from part where p_partkey % 401 = 0
union all select distinct p_brand, 'course.toml', false from part where p_brand <> 'Brand#3'
union all select distinct p_brand, 'syllabus/s.pdf', false from part where length(p_brand) = 8"""

VIEWS["f_environments"] = """
select course_id, assignment_id, case p_partkey % 9 when 0 then cast(null as varchar(20))
  when 1 then 'grading' when 2 then 'quantum' else 'data-science' end as environment
from f_materials"""

VIEWS["f_raw_registry"] = """
select p_brand as course_id, case when p_partkey % 60 = 1 then 'A 1' when p_partkey % 60 = 2 then null
    when p_partkey % 60 = 3 then 'dup' || p_size else 'A' || p_partkey end as id,
  case when p_partkey % 10 = 0 then 'quiz' when p_partkey % 10 = 1 then null else 'exam' end as type,
  case when p_partkey % 11 = 0 then 'moon' else 'take_home' end as scope,
  case p_partkey % 12 when 0 then 'heavy' when 1 then '-1' when 2 then 'NaN' when 3 then null
    else cast(p_size as varchar(10)) end as weight_pct,
  case when p_partkey % 13 = 0 then 'maybe' else 'allowed' end as ai_policy,
  case when p_partkey % 14 = 0 then 'yes' else 'true' end as ai_use_possible,
  case p_partkey % 15 when 0 then '2026-02-30' when 1 then '2026-02-06T10:00:00' else '2026-02-06' end
    as due,
  case when p_partkey % 16 = 0 then 'guess' else 'authored' end as rubric_provenance,
  case p_partkey % 17 when 0 then 'a' when 1 then 'a,a' when 2 then 'a,b c' when 3 then 'a,b'
    end as rubric_names, p_partkey
from part"""


@query(
    "a26_field_violations",
    """select course_id, coalesce(id, '') as id, field from (
      select *, unnest(list_filter([
        case when id is null or contains(id, ' ') then 'id' end,
        case when type = 'quiz' then 'type' end, case when scope = 'moon' then 'scope' end,
        case when weight_pct in ('heavy', '-1', 'NaN') then 'weight_pct' end,
        case when ai_policy = 'maybe' then 'ai_policy' end,
        case when ai_use_possible = 'yes' then 'ai_use_possible' end,
        case when due <> '2026-02-06' then 'due' end,
        case when rubric_provenance = 'guess' then 'rubric_provenance' end,
        case when rubric_names in ('a', 'a,a', 'a,b c') then 'rubrics' end],
        lambda f: f is not null)) as field from f_raw_registry) x
    union all select course_id, id, 'duplicate_id' from f_raw_registry where id is not null
    group by course_id, id having count(*) > 1""",
)
def field_violations(v):
    registry = v.raw_registry.withColumn("rubrics", F.split("rubric_names", ","))
    return audit.field_violations(registry)


ORACLE_VIEWS["o_coverage"] = """
select a.course_id, count(*) as n_registered, count(m.p_partkey) as n_with_materials,
  count(excluded) as n_excluded,
  case when count(*) = count(weight_pct) then sum(weight_pct) end as weight_sum,
  count(*) = count(weight_pct) and abs(sum(weight_pct) - 100) > 0.01 as weight_violation,
  case when count(m.p_partkey) = count(m.p_partkey) filter (weight_pct is not null)
    then coalesce(sum(weight_pct) filter (m.p_partkey is not null), 0) end as covered_weight,
  count(*) = count(weight_pct) as weights_complete
from f_assessments a left join f_materials m on m.course_id = a.course_id and m.assignment_id = a.id
group by a.course_id"""


@query(
    "a22_registry_coverage",
    """select * replace (round(weight_sum, 6) as weight_sum, round(covered_weight, 6) as covered_weight)
    from o_coverage""",
)
def registry_coverage(v):
    return rounded(audit.registry_coverage(v.assessments, v.materials))


ORACLE_VIEWS["o_subjects"] = """
select a.*, m.p_partkey is not null as handout, p_partkey % 3 <> 0 as has_default,
  case a.p_partkey % 9 when 0 then null when 1 then 'grading' when 2 then 'quantum'
    else 'data-science' end as environment,
  a.p_partkey as k
from f_assessments a left join (select p_partkey from f_materials) m using (p_partkey)"""
_RULES = [
    ("violation", "assignment_empty", "handout and k % 50 = 0"),
    ("violation", "no_environment", "handout and k % 9 = 0"),
    ("violation", "reserved_environment", "handout and k % 9 = 1"),
    ("violation", "unknown_environment", "handout and k % 9 = 2"),
    ("violation", "excluded_with_materials", "handout and excluded is not null"),
    ("violation", "rubric_archive_is_file", "k % 101 = 2"),
    ("violation", "rubric_source_is_file", "k % 97 = 6"),
    (
        "violation",
        "rubric_source_empty",
        "k % 89 = 7 and k % 8 <> 1 and k % 97 <> 6",
    ),
    ("violation", "provenance_without_rubric", "rubric_provenance is not null and not has_default"),
    (
        "violation",
        "provenance_below_source",
        "rubric_provenance in ('handout', 'authored') and k % 8 = 1",
    ),
    ("gap", "no_materials", "not handout and excluded is null"),
    ("gap", "no_weight_pct", "weight_pct is null"),
    ("gap", "no_type", "type is null"),
    ("gap", "no_ai_policy", "ai_policy is null"),
    ("gap", "no_ai_use_possible", "ai_use_possible is null"),
    ("gap", "no_default_rubric", "handout and not has_default"),
    ("gap", "rubric_without_provenance", "has_default and rubric_provenance is null"),
    ("gap", "no_reference_solution", "handout and k % 4 = 1"),
]


@query(
    "j19_subject_findings",
    " union all ".join(
        f"select course_id, '{severity}' as severity, '{rule}' as rule, id as subject "
        f"from o_subjects where {test}"
        for severity, rule, test in _RULES
    )
    + """ union all select p_brand, 'violation', 'rubric_of_nothing', 'Z' || p_partkey from part
      where p_partkey % 211 = 0
    union all select p_brand, 'violation', 'reference_of_nothing', 'Y' || p_partkey from part
      where p_partkey % 307 = 0""",
)
def subject_findings(v):
    facts = audit.folder_facts(v.listing)
    return audit.subject_findings(v.assessments, facts, v.environments)


@query(
    "j19_folder_findings",
    """select p_brand as course_id, 'violation' as severity, 'sidecar_without_assignment' as rule,
      'A' || p_partkey as subject from part
    where p_partkey % 20 = 3 and p_partkey not in (select p_partkey from f_materials)
    union all select p_brand, 'gap', 'stray_file_in_assignments', 'notes' || p_partkey || '.txt'
      from part where p_partkey % 301 = 1
    union all select p_brand, 'gap', 'unexpected_entry', 'tmp' || p_partkey from part
      where p_partkey % 401 = 0
    union all select distinct p_brand, 'gap', 'no_syllabus', '' from part where length(p_brand) <> 8
    union all select distinct p_brand, 'gap', 'no_course_record', '' from part
      where p_brand = 'Brand#3'""",
)
def folder_findings(v):
    return audit.folder_findings(v.listing, audit.folder_facts(v.listing))


@query(
    "j19_course_findings",
    """select 'N' || n_nationkey as course_id, 'gap' as severity, r.rule, '' as subject
    from nation cross join (values ('no_title', 2), ('no_term', 3)) r(rule, m)
    where n_nationkey % r.m = 1
    union all select 'N' || n_nationkey, 'gap', 'no_registry', '' from nation where n_nationkey % 5 = 0
    union all select 'N' || n_nationkey, 'violation', 'weight_sum', '' from nation
      where n_nationkey % 5 <> 0 and n_nationkey <> 7""",
)
def course_findings(v):
    number = F.col("n_nationkey")
    courses = v.nation.select(
        F.concat(F.lit("N"), number).alias("course_id"),
        F.when(number % 2 != 1, "T").alias("title"),
        F.lit("I").alias("institution"),
        F.when(number % 3 != 1, "2025").alias("term"),
    )
    registry = v.nation.where(number % 5 != 0).select(
        F.concat(F.lit("N"), number).alias("course_id"),
        F.col("n_name").alias("id"),
        F.when(number == 7, 100.0).otherwise(90.0).alias("weight_pct"),
        F.lit(None).cast("string").alias("excluded"),
    )
    none = v.materials.where("false")
    return audit.course_findings(courses, audit.registry_coverage(registry, none))


@query(
    "j19_enrollment_findings",
    """select 'C' || i as course_id, 'violation' as severity, 'declared_rubric_missing' as rule,
      'HW1/BUILDING' as subject from (select distinct c_custkey % 25 as i from customer) c where i % 2 = 1
    union all select distinct course_id, 'violation', 'enrollment_rubric_undeclared', rubric
      from f_enrollments where rubric in ('MACHINERY', 'HOUSEHOLD')
    union all select course_id, 'gap', 'work_without_enrollment', 'HW1 ' || count(*) from (
      select w.course_id from f_student_work w left join f_enrollments e
        on lower(e.lms_username) = 'user' || substr(w.student_id, 2) and e.course_id = w.course_id
      where w.assignment_id = 'HW1' and starts_with(w.student_id, 'S')
        and (e.rubric is null or e.rubric not in ('AUTOMOBILE', 'BUILDING', 'FURNITURE'))) x
    group by course_id""",
)
def enrollment_findings(v):
    from gradeloom.operators import release

    course = v.enrollments.select("course_id").distinct()
    names = F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE")))
    assessments = course.select("course_id", F.lit("HW1").alias("id"), names.alias("rubrics"))
    declared = assessments.select("course_id", "id", F.explode("rubrics").alias("rubric"))
    number = F.expr("cast(substr(course_id, 2) as int)")
    on_disk = declared.where(~((F.col("rubric") == "BUILDING") & (number % 2 == 1))).select(
        "course_id", F.col("id").alias("assignment_id"), "rubric"
    )
    work = v.student_work.where("assignment_id = 'HW1'")
    # One identity per student, so that only enrollment decides here.
    students = v.customer.select(
        F.concat(F.lit("S"), "c_custkey").alias("student_id"),
        F.concat(F.lit("C"), F.col("c_custkey") % 25).alias("course_id"),
        F.concat(F.lit("user"), "c_custkey").alias("lms_username"),
    )
    requests = work.withColumn("requested", F.lit("default")).withColumn("explicit", F.lit(False))
    routes = release.route_rubrics(requests, assessments, students, v.enrollments)
    return audit.enrollment_findings(declared, on_disk, v.enrollments, work, routes)


def _pages(v):
    image = F.struct(
        F.col("image_type").alias("type"),
        F.col("side").alias("width"),
        F.col("side").alias("height"),
        F.col("nonwhite").alias("nonwhite_fraction"),
    )
    known_bytes = F.when(F.col("page_id") % 7 != 0, F.col("content_bytes"))
    return v.pages_measured.select(
        "path",
        "page",
        F.col("ink").alias("ink_fraction"),
        "render_exists",
        (F.col("page_id") % 16 != 0).alias("renderer_ran"),
        known_bytes.alias("content_stream_bytes"),
        F.array(image).alias("images"),
        F.col("content_bytes").alias("drawable_stream_bytes"),
        (F.col("page_id") % 14 != 0).alias("content_accounting_ran"),
    )


VIEWS["f_pages_measured"] = VIEWS.pop("f_pages")
ORACLE_VIEWS["o_pages"] = """
select *, image_type = 'image' and side >= 1000 as scan,
  case when not render_exists then page_id % 16 <> 0 else coalesce(ink < 0.001, false) end as low_ink,
  (page_id % 7 <> 0 and content_bytes >= 1024) or coalesce(nonwhite >= 0.001, false)
    or (image_type = 'image' and side >= 1000 and nonwhite is null)
    or (page_id % 14 <> 0 and page_id % 7 = 0 and content_bytes >= 1024) as substance,
  coalesce(ink >= 0.001 and image_type = 'image' and side >= 1000 and nonwhite >= 0.001
    and ink * 4 < nonwhite, false) as partial_render
from f_pages_measured"""
ORACLE_VIEWS["o_page_flags"] = """
select *, case when low_ink and substance then 'DISCREPANCY' when partial_render
  then 'PARTIAL_RENDER' end as flag from o_pages"""


@query("q01_page_tests", "select path, page, low_ink, substance, partial_render from o_pages")
def page_tests(v):
    return evidence.with_page_flags(_pages(v)).select(
        "path", "page", "low_ink", "substance", "partial_render"
    )


@query(
    "q02_scan_images",
    """select path, page, case when scan and nonwhite is not null then nonwhite end as scan_ink,
      scan and nonwhite is null as unmeasured from o_pages""",
)
def scan_images(v):
    return _pages(v).select(
        "path",
        "page",
        F.try_element_at(evidence.scan_ink_fractions(F.col("images")), F.lit(1)).alias("scan_ink"),
        evidence.has_unmeasured_scan(F.col("images")).alias("unmeasured"),
    )


@query("q03_page_flags", "select path, page, flag from o_page_flags")
def page_flags(v):
    return evidence.with_page_flags(_pages(v)).select("path", "page", "flag")


VIEWS["f_files_measured"] = """
select cast(page_id as varchar(20)) || '.pdf' as path, page_id,
  case page_id % 10 when 0 then 'zip' when 1 then 'text' else 'pdf' end as kind, page_id % 10 = 0 as converted,
  case when page_id % 12 = 0 then 'errors' when page_id % 12 = 1 then 'unavailable' else 'ok' end
    as qpdf_check,
  case when page_id % 25 = 3 then 'bad xref' end as parse_error,
  cast(null as varchar(20)) as render_error,
  case when page_id % 13 <> 0 then cast(length(html) % 90 as bigint) end as text_chars_total,
  case when page_id % 16 = 0 then 'pdftoppm' when page_id % 14 = 0 then 'pypdf' else '' end as tool
from pages"""


def _files(v):
    tools = F.filter(F.array("tool"), lambda t: t != "")
    files = v.files_measured.withColumn("tools_unavailable", tools)
    return evidence.file_flags(files, evidence.with_page_flags(_pages(v)))


ORACLE_VIEWS["o_files"] = """
select f.*, list_filter([case when d then 'DISCREPANCY' end, case when p then 'PARTIAL_RENDER' end,
    case when qpdf_check = 'errors' or parse_error is not null then 'DAMAGED' end,
    case when text_chars_total < 50 then 'NO_TEXT_LAYER' end,
    case when tool <> '' then 'TOOL_UNAVAILABLE' end], lambda x: x is not null) as flags
from f_files_measured f join (select path, coalesce(bool_or(flag = 'DISCREPANCY'), false) as d,
    coalesce(bool_or(flag = 'PARTIAL_RENDER'), false) as p from o_page_flags group by path) g
  using (path)"""


@query("q04_file_flags", "select path, array_to_string(flags, ';') as flags from o_files")
def file_flags(v):
    return _files(v).select("path", F.array_join("flags", ";").alias("flags"))


@query(
    "q05_readability_gaps",
    """select 'unreadable' as gap, path as subject, array_to_string(list_filter(flags,
        lambda f: f in ('DAMAGED', 'DISCREPANCY', 'PARTIAL_RENDER')), ', ') as detail from o_files
    where list_has_any(flags, ['DAMAGED', 'DISCREPANCY', 'PARTIAL_RENDER'])
    union all select distinct 'tool_unavailable', tool, '' from o_files where tool <> ''""",
)
def readability_gaps(v):
    return evidence.readability_gaps(_files(v))


@query(
    "a25_evidence_summary",
    """select count(*) filter (kind = 'pdf') as pdf_files, count(*) filter (converted) as office_files,
      count(*) filter (kind <> 'pdf' and not converted) as other_files,
      count(*) filter (len(flags) > 0) as flagged_files from o_files""",
)
def evidence_summary(v):
    return evidence.evidence_summary(_files(v))


@query(
    "n12_content_kinds",
    """select doc_id, case doc_id % 7 when 0 then 'pdf' when 1 then 'zip' when 2 then 'png'
      when 3 then 'jpeg' when 4 then 'empty' when 5 then 'binary' else 'text' end as kind
    from documents""",
)
def content_kinds(v):
    text = F.encode(F.translate("text", "%", ""), "UTF-8")
    # ASCII keeps the 1024-byte head from ending inside a character.
    ascii_text = F.encode(F.regexp_replace("text", r"[^\x01-\x7e]|%PDF-", ""), "UTF-8")
    which = F.col("doc_id") % 7

    def bytes_of(hexed: str):
        return F.unhex(F.lit(hexed))

    content = (
        F.when(which == 0, F.concat(bytes_of("0A0A255044462D312E37"), text))
        .when(which == 1, F.concat(bytes_of("504B0304"), text))
        .when(which == 2, F.concat(bytes_of("89504E470D0A1A0A"), text))
        .when(which == 3, F.concat(bytes_of("FFD8FF"), text))
        .when(which == 4, bytes_of(""))
        .when(which == 5, F.concat(bytes_of("4100"), text))
        .otherwise(F.concat(bytes_of("41"), ascii_text))
    )
    return v.documents.select("doc_id", N.sniff_kind(content).alias("kind"))


@query(
    "n13_ink_fractions",
    """select page_id, case when page_id % 11 = 0 then cast(0 as double) else round(
      list_sum(list_transform(range(0, 247), lambda i: (page_id * 7 + i) % 13))
      / list_sum(list_transform(range(0, 256), lambda i: (page_id * 7 + i) % 13)), 6) end as ink
    from pages""",
)
def ink_fractions(v):
    bins = F.transform(
        F.sequence(F.lit(0), F.lit(255)),
        lambda i: F.when(F.col("page_id") % 11 == 0, 0).otherwise((F.col("page_id") * 7 + i) % 13),
    )
    return rounded(v.pages.select("page_id", N.ink_fraction(bins).alias("ink")))


@query(
    "n14_image_sizes",
    """select page_id, case page_id % 5 when 0 then page_id % 999
      when 1 then cast(floor((page_id % 200 + 0.5) * 1024) as bigint)
      when 2 then (page_id % 50) * 1048576 else cast(0 as bigint) end as bytes
    from pages""",
)
def image_sizes(v):
    k = F.col("page_id")
    size = (
        F.when(k % 5 == 0, F.concat((k % 999).cast("string"), F.lit("B")))
        .when(k % 5 == 1, F.concat((k % 200).cast("string"), F.lit(".5K")))
        .when(k % 5 == 2, F.concat((k % 50).cast("string"), F.lit(".0M")))
        .when(k % 5 == 3, F.concat((k % 50).cast("string"), F.lit("X")))
        .otherwise("oneK")
    )
    return v.pages.select("page_id", N.image_size_bytes(size).alias("bytes"))


@query(
    "n18_text_chars",
    r"""select doc_id, cast(length(regexp_replace(text, '\s', '', 'g')) as bigint) as text_chars
    from documents""",
)
def text_chars(v):
    return v.documents.select("doc_id", N.text_chars(F.col("text")).cast("long").alias("text_chars"))


@query(
    "t01_incremental_doneness",
    """select item_id, item_identity, count(*) as existing from f_trials0
    where stage = 'grade' and outcome = 'completed' group by all""",
)
def incremental_doneness(v):
    folder = f"{checkpoint_dir(v.spark)}/t01-{uuid.uuid4().hex}"
    # Every trial, in the columns that doneness is told from.
    rows = v.trials0.select(*doneness.COLUMNS)
    rows.write.parquet(f"{folder}/trials")
    # The same files twice: a trial already folded must not count again.
    rows.write.mode("append").parquet(f"{folder}/trials")
    stream = (
        v.spark.readStream.schema(rows.schema)
        .option("maxFilesPerTrigger", "6")
        .parquet(f"{folder}/trials")
    )
    query_ = doneness.fold_trials(stream, "grade", f"{folder}/table", f"{folder}/progress")
    query_.awaitTermination()
    return doneness.stored_totals(v.spark, f"{folder}/table")
