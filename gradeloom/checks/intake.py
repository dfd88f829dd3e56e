"""Uploads, identities and ingest planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.checks.registry import ORACLE_VIEWS, query
from gradeloom.checks.views import VIEWS
from gradeloom.functions import predicates as P
from gradeloom.functions import scalars as N
from gradeloom.operators import digests, identity, ingest, uploads

VIEWS["f_folders"] = """
select event_id, user_id, cast(user_id as varchar(20)) as person_id, 'u' || user_id as username,
  'User ' || user_id as display_name, date_trunc('minute', ts) as submitted_at,
  user_id || '-' || (9000 + event_id % 3) || ' - u' || user_id || ' User ' || user_id || ' - Jan '
  || day(ts) || ', 2024 ' || case hour(ts) % 12 when 0 then 12 else hour(ts) % 12 end
  || lpad(cast(minute(ts) as varchar(4)), 2, '0') || case when hour(ts) < 12 then ' AM' else ' PM' end
  as folder
from events"""

VIEWS["f_members"] = """
select 'arc' || (event_id % 500) as archive,
  case when event_id % 500 % 5 = 0 then 'assignment_' || event_id || '_export/' || event_id || '.pdf'
    when event_id % 500 % 5 = 1 and event_id % 7 = 0 then 'assignment_' || event_id || '_export/x.pdf'
    when event_id % 500 % 5 = 2 and event_id % 11 = 0 then 'notes/readme.txt'
    when event_id % 500 % 5 = 4 then 'index.html'
    else folder || case event_id % 13 when 0 then '/../x.py' when 1 then '//x.py'
      else '/src/x.py' end end as name
from f_folders"""

VIEWS["f_archives"] = """
select p_brand as course_id, p_partkey as archive_key,
  case p_partkey % 6 when 0 then 'Homework ' || p_size || ' export'
    when 1 then 'hw_' || p_size when 2 then 'Problem Set ' || p_size || ' final'
    when 3 then 'PSO' || p_size when 4 then 'Exam ' || p_size else 'misc upload' end
  || ' ' || p_partkey || '.zip' as archive
from part"""

VIEWS["f_known_ids"] = """
select distinct p_brand as course_id,
  case p_size % 3 when 0 then 'HW' when 1 then 'pso' else 'Exam' end
    || case when p_size < 10 then '0' else '' end || p_size as assignment_id
from part where p_size % 4 <> 0
union all
select distinct p_brand, 'HW' || case when p_size < 10 then '00' else '0' end || p_size from part
where p_size % 12 = 6"""

VIEWS["f_explicit"] = """
select course_id, archive, 'HW01' as assignment_id from f_archives where archive_key % 17 = 0"""

VIEWS["f_scans"] = """
select 'C' || (c_custkey % 25) as course_id, 'HW' || i as assignment_id,
  's' || (c_custkey * 3 + i) as submission_id,
  case when c_custkey % 9 = 0 then null
    when c_custkey % 5 = 0 then 'New  Person ' || (c_custkey % 40)
    when c_custkey % 7 = 0 then 'SAME NAME' else 'customer#' || substr(c_name, 10) end
    as extracted_name,
  case when c_custkey % 31 = 0 then 'unreadable_pdf' when c_custkey % 37 = 0 then 'no_split_marker'
    end as problem
from customer cross join (select * from (values (1), (2)) v(i)) c"""

VIEWS["f_overrides"] = """
select 'C' || (c_custkey % 25) as course_id, 's' || (c_custkey * 3 + 1) as submission_id,
  case when c_custkey % 2 = 0 then 'S' || (c_custkey + 25) when c_custkey % 3 = 0 then 'Same name'
    else 'Fresh Face' end as override
from customer where c_custkey % 10 = 9"""

# Students for name matching: padded ids so that the pseudonym pattern holds.
VIEWS["f_named_students"] = """
select 'S' || lpad(cast(c_custkey as varchar(20)), 6, '0') as student_id,
  'C' || (c_custkey % 25) as course_id, cast(c_custkey as varchar(20)) as lms_person_id,
  'user' || c_custkey as lms_username,
  case when c_custkey % 7 = 0 then 'Same  Name' else c_name end as display_name,
  'brightspace' as source
from customer"""


@query(
    "n01_username_keys",
    r"""select c_custkey, lower(regexp_replace(trim(lms_username), '^#+', '')) as key
    from f_students""",
)
def username_keys(v):
    return v.students.select("c_custkey", N.username_key(F.col("lms_username")).alias("key"))


@query(
    "n02_name_keys",
    r"""select submission_id, lower(trim(regexp_replace(extracted_name, '\s+', ' ', 'g'))) as key
    from f_scans""",
)
def name_keys(v):
    return v.scans.select("submission_id", N.name_key(F.col("extracted_name")).alias("key"))


@query(
    "n03_upload_folders",
    """select event_id, person_id, cast(9000 + event_id % 3 as varchar) as lms_assignment_id,
      username, display_name, strftime(submitted_at, '%Y-%m-%d %H:%M') as submitted_at
    from f_folders""",
)
def upload_folders(v):
    parsed = v.folders.select("event_id", N.upload_folder(F.col("folder")).alias("p"))
    return parsed.select("event_id", "p.*").withColumn(
        "submitted_at", F.date_format("submitted_at", "yyyy-MM-dd HH:mm")
    )


@query(
    "n04_archive_series",
    r"""select archive, case when w <> '' then case replace(w, ' ', '') when 'homework' then 'HW'
        when 'hw' then 'HW' when 'pso' then 'PSO' when 'problemset' then 'PSO' else 'EXAM' end end
        as series,
      case when w <> '' then cast(n as bigint) end as number
    from (select archive,
        lower(regexp_extract(archive, '(?i)\b(homework|hw|pso|problem\s*set|exam)\s*_?\s*(\d+)\b', 1))
          as w,
        regexp_extract(archive, '(?i)\b(homework|hw|pso|problem\s*set|exam)\s*_?\s*(\d+)\b', 2) as n
      from f_archives) a""",
)
def archive_series(v):
    parsed = v.archives.select("archive", N.archive_series(F.col("archive")).alias("p"))
    return parsed.select("archive", "p.series", "p.number")


@query(
    "p09_unsafe_members",
    r"""select archive, name from f_members where contains(name, '/') and not ends_with(name, '/')
      and regexp_matches(regexp_replace(name, '^[^/]*/', ''), '(^|/)(\.{0,2})(/|$)|\\')""",
)
def unsafe_members(v):
    return ingest.unsafe_members(v.members)


@query(
    "g01_archive_layouts",
    r"""select archive, case when count(*) filter (kind = 'u') > 0 then 'unrecognized'
        when count(*) filter (kind = 'b') > 0 and count(*) filter (kind = 'g') > 0 then 'mixed'
        when count(*) filter (kind = 'b') > 0 then 'brightspace'
        when count(*) filter (kind = 'g') > 0 then 'gradescope' else 'empty' end as layout
    from (select archive, case when not contains(name, '/') then null
        when regexp_matches(split_part(name, '/', 1), '^assignment_\d+_export$') then 'g'
        when regexp_matches(split_part(name, '/', 1),
          '^\d+-\d+ - \S+ .+ - [A-Z][a-z][a-z] \d+, \d{4} \d{3,4} (AM|PM)$') then 'b'
        else 'u' end as kind from f_members) m
    group by archive""",
)
def archive_layouts(v):
    return ingest.archive_layouts(v.members)


ORACLE_VIEWS["o_series"] = r"""
select course_id, assignment_id, upper(regexp_extract(assignment_id, '^[A-Za-z]+')) as series,
  cast(regexp_extract(assignment_id, '\d+$') as bigint) as number from f_known_ids"""


@query(
    "j11_archive_matches",
    r"""select a.course_id, a.archive, coalesce(any_value(e.assignment_id),
        case when count(distinct k.assignment_id) = 1 then min(k.assignment_id) end) as assignment_id,
      case when any_value(e.assignment_id) is not null then null
        when any_value(a.series) is null then 'unparsed_name'
        when count(distinct k.assignment_id) = 0 then 'no_match'
        when count(distinct k.assignment_id) > 1 then 'ambiguous' end as error
    from (select course_id, archive, archive_key,
        case archive_key % 6 when 0 then 'HW' when 1 then 'HW' when 2 then 'PSO' when 3 then 'PSO'
          when 4 then 'EXAM' end as series,
        cast(regexp_extract(archive, '(?i)(?:homework |hw_|set |pso|exam )(\d+)', 1) as varchar) as n
      from f_archives) a
    left join o_series k on k.course_id = a.course_id and k.series = a.series
      and k.number = try_cast(a.n as bigint)
    left join f_explicit e on e.course_id = a.course_id and e.archive = a.archive
    group by a.course_id, a.archive""",
)
def archive_matches(v):
    return ingest.match_archives(v.archives, v.known_ids, v.explicit)


ORACLE_VIEWS["o_kept"] = """
select u.* from f_uploads u left join f_selections s using (assignment_id, person_id)
where s.folder is null or s.folder = u.dir_name"""
ORACLE_VIEWS["o_versions_of"] = """
select *, lag(digest) over w as before_digest, lag(submitted_at) over w as before_at,
  row_number() over (partition by course_id, assignment_id, person_id, relpath
    order by submitted_at desc, dir_name desc) as age
from o_kept
window w as (partition by course_id, assignment_id, person_id, relpath
  order by submitted_at, dir_name)"""
ORACLE_VIEWS["o_latest"] = """
select course_id, assignment_id, person_id, username, display_name, submitted_at, dir_name
from (select *, row_number() over (partition by course_id, assignment_id, person_id
    order by submitted_at desc, dir_name desc) as r from o_kept) x where r = 1"""


@query(
    "w03_latest_upload",
    """select course_id, assignment_id, person_id, dir_name, username, display_name from o_latest""",
)
def latest_upload(v):
    kept, _, _ = uploads.select_uploads(v.uploads, v.selections)
    return uploads.latest_upload(kept, uploads.OWNER).select(
        *uploads.OWNER, "latest.dir_name", "latest.username", "latest.display_name"
    )


@query(
    "w04_surviving_files",
    """select course_id, assignment_id, person_id, relpath, digest, dir_name
    from o_versions_of where age = 1""",
)
def surviving_files(v):
    kept, _, _ = uploads.select_uploads(v.uploads, v.selections)
    return uploads.surviving_files(kept).drop("submitted_at")


@query(
    "w04_replaced_files",
    """select course_id, assignment_id, person_id, relpath, dir_name,
      strftime(before_at, '%Y-%m-%dT%H:%M') as replaced_at
    from o_versions_of where before_digest <> digest""",
)
def replaced_files(v):
    kept, _, _ = uploads.select_uploads(v.uploads, v.selections)
    rows = uploads.replaced_files(uploads.file_versions(kept))
    return rows.withColumn(
        "replaced_at", F.date_format("replaced_at", "yyyy-MM-dd'T'HH:mm")
    ).drop("submitted_at")


ORACLE_VIEWS["o_flags"] = r"""
select course_id, assignment_id, person_id,
  coalesce(bool_or(before_digest = digest), false) as duplicate_reupload,
  coalesce(bool_or(before_digest <> digest), false) as replaced_files,
  count(distinct dir_name) > 1 as merged_uploads,
  count(distinct dir_name) filter (age = 1 and ends_with(relpath, '.pdf')) > 1
    or count(distinct dir_name) filter (age = 1 and ends_with(relpath, '.ipynb')) > 1
    as possible_stale_solution,
  count(*) filter (age = 1) as files
from o_versions_of group by all"""


@query(
    "w04_merge_flags",
    "select * exclude (files) from o_flags",
)
def merge_flags(v):
    kept, _, _ = uploads.select_uploads(v.uploads, v.selections)
    return uploads.merge_flags(uploads.file_versions(kept), uploads.surviving_files(kept))


@query(
    "x01_excluded_uploads",
    """select distinct course_id, assignment_id, person_id, dir_name
    from f_uploads join f_selections using (assignment_id, person_id) where dir_name <> folder""",
)
def excluded_uploads(v):
    return uploads.select_uploads(v.uploads, v.selections)[1]


@query(
    "g07_username_conflicts",
    """select course_id, assignment_id, person_id, min(u) as lowest, max(u) as highest
    from (select *, lower(ltrim(username, '#')) || case when digest in ('d1', 'd3') then 'x' else '' end
      as u from f_uploads) x
    group by all having min(u) <> max(u)""",
)
def username_conflicts(v):
    # Some versions of a person's files name another account.
    other = F.concat("username", F.when(F.col("digest").isin("d1", "d3"), "x").otherwise(""))
    return uploads.username_conflicts(v.uploads.withColumn("username", other))


@query(
    "x01_unmatched_selections",
    """select assignment_id, person_id, folder from f_selections where length(folder) % 2 = 0""",
)
def unmatched_selections(v):
    # Every even-length folder name is misspelled, so exactly those must be reported.
    wrong = v.selections.withColumn(
        "folder", F.when(F.length("folder") % 2 == 0, F.concat("folder", F.lit("x"))).otherwise(F.col("folder"))
    )
    unmatched = uploads.select_uploads(v.uploads, wrong)[2]
    return unmatched.select(
        "assignment_id", "person_id", F.expr("substr(folder, 1, length(folder) - 1)").alias("folder")
    )


def _people(v):
    newest = uploads.latest_upload(v.uploads, ["course_id", "person_id"])
    latest = newest.select("course_id", "person_id", "latest.username", "latest.display_name")
    return identity.allocate_people(latest, v.known_people)


ORACLE_VIEWS["o_new_people"] = """
select course_id, person_id, username as lms_username, display_name,
  format('S{:03d}', h + n) as student_id
from (select u.course_id, u.person_id, max_by(username, (submitted_at, dir_name)) as username,
    max_by(display_name, (submitted_at, dir_name)) as display_name,
    row_number() over (partition by u.course_id order by cast(u.person_id as bigint)) as n,
    any_value(h) as h
  from f_uploads u join (select course_id,
      max(cast(regexp_extract(student_id, '^S([0-9]{3,})$', 1) as bigint)) as h
      from f_known_people group by course_id) k using (course_id)
  where (u.course_id, u.person_id) not in (select course_id, lms_person_id from f_known_people)
  group by u.course_id, u.person_id) x"""


@query(
    "w05_allocated_people",
    """select student_id, course_id, person_id as lms_person_id, lms_username, display_name,
      'brightspace' as source from o_new_people""",
)
def allocated_people(v):
    return _people(v)


@query(
    "g02_upload_outcomes",
    """select l.course_id, l.assignment_id, p.student_id, 'brightspace' as source,
      l.person_id as source_ref, 'ready' as status,
      strftime(l.submitted_at, '%Y-%m-%dT%H:%M') as submitted_at,
      n.uploads, f.files,
      concat_ws(';', case when duplicate_reupload then 'duplicate_reupload' end,
        case when (l.username, l.display_name) is distinct from (p.lms_username, p.display_name)
          then 'identity_changed' end,
        case when merged_uploads then 'merged_uploads' end,
        case when possible_stale_solution and merged_uploads then 'possible_stale_solution' end,
        case when replaced_files then 'replaced_files' end,
        case when s.folder is not null then 'upload_selected' end) as flags,
      coalesce(r.n, 0) as n_replaced_files, coalesce(s.folder, '') as selected_upload,
      coalesce(x.n, 0) as n_excluded_uploads, coalesce(s.reason, '') as selection_reason
    from o_latest l join o_flags f using (course_id, assignment_id, person_id)
    join (select course_id, assignment_id, person_id, count(distinct dir_name) as uploads
      from f_uploads group by all) n using (course_id, assignment_id, person_id)
    join (select course_id, person_id, student_id, lms_username, display_name from o_new_people
      union all select course_id, lms_person_id, student_id, lms_username, display_name
      from f_known_people) p on p.course_id = l.course_id and p.person_id = l.person_id
    left join f_selections s on s.assignment_id = l.assignment_id and s.person_id = l.person_id
    left join (select course_id, assignment_id, person_id, count(*) as n
      from o_versions_of where before_digest <> digest group by all) r
      on r.course_id = l.course_id and r.assignment_id = l.assignment_id and r.person_id = l.person_id
    left join (select assignment_id, person_id, count(distinct dir_name) as n
      from f_uploads join f_selections using (assignment_id, person_id) where dir_name <> folder
      group by all) x on x.assignment_id = l.assignment_id and x.person_id = l.person_id""",
)
def upload_outcomes(v):
    students = v.known_people.unionByName(_people(v))
    return uploads.upload_outcomes(v.uploads, v.selections, students)


ORACLE_VIEWS["o_dir"] = """
select course_id, assignment_id, person_id, count(*) as n_files,
  sha256('aat-dir-sha256-v1' || chr(0) || string_agg(relpath || chr(0) || digest || chr(10), ''
    order by relpath)) as sha256
from o_versions_of where age = 1 group by all"""


@query(
    "a17_directory_digests",
    """select source as dir, count(*) as n_files, sha256('aat-dir-sha256-v1' || chr(0) || string_agg(
      relpath || chr(0) || sha256(text) || chr(10), '' order by relpath)) as sha256
    from (select f.dir as source, relpath, text from f_manifest f join documents using (doc_id)) d
    group by source""",
)
def directory_digests(v):
    return digests.directory_digests(_manifest(v), ["dir"])


def _manifest(v):
    return v.manifest.join(v.documents.select("doc_id", "text"), "doc_id").select(
        "dir", "relpath", F.sha2("text", 256).alias("digest"), "doc_id"
    )


@query(
    "s10_file_manifest",
    """select dir, relpath, sha256(text) as digest from f_manifest join documents using (doc_id)""",
)
def file_manifest(v):
    return _manifest(v).drop("doc_id")


@query(
    "p08_bookkeeping_entries",
    "select dir, relpath from f_manifest where ends_with(relpath, '.swp')",
)
def bookkeeping(v):
    return digests.bookkeeping_entries(v.manifest)


@query(
    "x04_contract_violations",
    """select dir, count(*) filter (doc_id % 41 <> 0) as n_files,
      count(*) filter (doc_id % 41 = 0) as n_bookkeeping,
      count(*) filter (doc_id % 41 <> 0 and doc_id % 3 = 0 and dir <> 'src7') as n_changed,
      concat_ws(';', case when count(*) filter (doc_id % 41 = 0) > 0 then 'bookkeeping_entries' end,
        case when count(*) filter (doc_id % 41 <> 0) = 0 then 'no_files'
          when count(*) filter (doc_id % 41 <> 0 and doc_id % 3 = 0 and dir <> 'src7') = 0
            then 'all_files_unchanged' end) as violations
    from f_manifest group by dir""",
)
def contract_violations(v):
    manifest = _manifest(v)
    changed = (F.col("doc_id") % 3 == 0) & (F.col("dir") != "src7")
    given = manifest.withColumn(
        "digest", F.when(changed, F.concat("digest", F.lit("x"))).otherwise(F.col("digest"))
    )
    return digests.contract_violations(manifest, given).withColumn(
        "violations", F.array_join("violations", ";")
    )


@query(
    "x05_conflicting_digests",
    """select course_id, person_id, relpath, min(digest) as lowest, max(digest) as highest
    from f_uploads group by all having count(distinct digest) > 1""",
)
def conflicting_digests(v):
    return digests.conflicting_values(v.uploads, ["course_id", "person_id", "relpath"], "digest")


@query(
    "x03_requested_absent",
    """select distinct course_id, assignment_id from f_assignments_wanted w
    where not exists (select 1 from f_trials0 t where t.course_id = w.course_id
      and t.assignment_id = w.assignment_id and t.stage = 'grade' and t.student_id is not null)""",
)
def requested_absent(v):
    have = v.trials0.where(P.is_student_row())
    return digests.requested_but_absent(
        v.assignments_wanted, have, ["course_id", "assignment_id"]
    )


VIEWS["f_assignments_wanted"] = """
select 'C' || (n_nationkey % 27) as course_id, 'HW' || i as assignment_id
from nation cross join (select * from (values (1), (8), (13)) v(i)) c"""


@query(
    "g05_submission_digests",
    """select course_id, assignment_id, person_id, sha256, n_files, dir_name, username, display_name
    from o_dir join o_latest using (course_id, assignment_id, person_id)""",
)
def submission_digests(v):
    return uploads.submission_digests(v.uploads, v.selections)


VIEWS["f_existing_files"] = """
select course_id, assignment_id, person_id, relpath,
  case when user_id % 8 = 1 then digest || 'old' else digest end as digest, user_id,
  submitted_at, dir_name
from f_uploads where user_id % 4 <> 0"""


@query(
    "g04_apply_decisions",
    """select d.course_id, d.assignment_id, d.person_id as student_id,
      case when c % 8 = 1 and frozen then 'frozen' else 'ready' end as status,
      case when c % 4 = 0 then 'create' when c % 8 <> 1 then 'none' when frozen then 'refuse'
        else 'replace' end as action,
      case when c % 8 = 1 and frozen then 'frozen_submission_changed' else '' end as flags
    from (select *, cast(person_id as bigint) as c, person_id in (select cast(o_custkey as varchar)
        from orders where o_orderkey % 3 = 0) as frozen
      from (select distinct course_id, assignment_id, person_id from f_uploads) u) d""",
)
def apply_decisions(v):
    # Of the customers, those with an order of the first third are frozen by an earlier run.
    as_student = [
        "course_id", "assignment_id", F.col("person_id").alias("student_id"), "sha256",
    ]
    staged = digests.directory_digests(uploads.surviving_files(v.uploads), uploads.OWNER)
    existing = digests.directory_digests(uploads.surviving_files(v.existing_files), uploads.OWNER)
    frozen_items = v.sql(
        """select distinct u.course_id, u.assignment_id, cast(u.user_id as varchar(20)) as student_id,
          'student' as submission_source
        from f_uploads u join orders on o_custkey = u.user_id where o_orderkey % 3 = 0"""
    )
    return ingest.apply_decisions(
        staged.select(*as_student),
        existing.select(*as_student),
        ingest.frozen_submissions(frozen_items),
    )


@query(
    "g06_source_status",
    """select 'N' || n_nationkey as course_id, case when n_nationkey % 4 = 3 or n_nationkey % 5 = 0
      or (n_nationkey % 3 = 1 and n_nationkey % 2 = 1) then 'pending' else 'done' end as status
    from nation""",
)
def source_status(v):
    raw = digests.directory_digests(
        v.nation.select(
            F.concat(F.lit("N"), "n_nationkey").alias("course_id"),
            F.col("n_name").alias("relpath"),
            F.sha2("n_name", 256).alias("digest"),
        ),
        ["course_id"],
    )
    number = F.regexp_replace("course_id", "N", "").cast("int")
    receipts = raw.where(number % 4 != 3).select(
        "course_id",
        F.when(number % 5 == 0, "stale").otherwise(F.col("sha256")).alias("receipt_sha256"),
        F.when(number % 3 == 1, F.array(F.lit("HW1"), F.lit("HW2"))).alias("scope"),
    )
    requested = raw.select(
        "course_id",
        F.when(number % 2 == 0, F.array(F.lit("HW1"))).otherwise(
            F.array(F.lit("HW1"), F.lit("HW3"))
        ).alias("assignment_ids"),
    )
    return digests.source_status(raw, receipts, requested)


ORACLE_VIEWS["o_scan"] = r"""
select s.course_id, s.assignment_id, s.submission_id, s.problem, o.override,
  coalesce(regexp_matches(o.override, '^S[0-9]{3,}$'), false) as is_id,
  coalesce(case when not coalesce(regexp_matches(o.override, '^S[0-9]{3,}$'), false) then o.override
    end, case when o.override is null then s.extracted_name end) as name,
  exists (select 1 from f_named_students k where k.course_id = s.course_id
    and k.student_id = o.override) as known_id
from f_scans s left join f_overrides o using (course_id, submission_id)"""
ORACLE_VIEWS["o_scan_id"] = r"""
select s.*, lower(regexp_replace(name, '\s+', ' ', 'g')) as key, n.n as same,
  case when problem is not null then problem when is_id and not known_id then 'unknown_student_id'
    when not is_id and name is null then 'identity_unresolved'
    when not is_id and n.n > 1 then 'ambiguous_identity' end as unresolved,
  case when is_id then override when n.n = 1 then n.sid end as sid0
from o_scan s left join (select course_id, lower(regexp_replace(display_name, '\s+', ' ', 'g')) as k,
    count(*) as n, min(student_id) as sid from f_named_students group by 1, 2) n
  on n.course_id = s.course_id and n.k = lower(regexp_replace(s.name, '\s+', ' ', 'g'))"""
ORACLE_VIEWS["o_newcomers"] = """
select course_id, key, name as display_name, format('S{:03d}', h + n) as student_id
from (select course_id, key, min_by(name, (assignment_id, submission_id)) as name,
    row_number() over (partition by course_id order by key) as n
  from o_scan_id where unresolved is null and sid0 is null group by course_id, key) x
join (select course_id, max(cast(substr(student_id, 2) as bigint)) as h from f_named_students
  group by 1) k using (course_id)"""
ORACLE_VIEWS["o_scan_out"] = """
select i.*, case when unresolved is null then coalesce(sid0, c.student_id) end as sid,
  row_number() over (partition by i.course_id, assignment_id,
    case when unresolved is null then coalesce(sid0, c.student_id) end order by submission_id) as r
from o_scan_id i left join o_newcomers c on c.course_id = i.course_id and c.key = i.key"""


@query(
    "g03_scan_newcomers",
    "select course_id, student_id, display_name from o_newcomers",
)
def scan_newcomers(v):
    identified = identity.scan_identities(v.scans, v.overrides, v.named_students)
    return identity.allocate_names(identified, v.named_students).select(
        "course_id", "student_id", "display_name"
    )


@query(
    "g03_scan_outcomes",
    """select course_id, assignment_id, coalesce(sid, '') as student_id, 'gradescope' as source,
      submission_id as source_ref,
      case when sid is null or r > 1 then 'skipped' else 'ready' end as status, cast(1 as bigint) as uploads,
      case when sid is null or r > 1 then 0 else cast(1 as bigint) end as files,
      case when sid is not null and r > 1 then 'duplicate_student'
        when problem is not null then problem
        when unresolved = 'unknown_student_id' then 'identity_from_manifest;unknown_student_id'
        else concat_ws(';', unresolved, case when override is not null then 'identity_from_manifest'
          end) end as flags
    from o_scan_out""",
)
def scan_outcomes(v):
    identified = identity.scan_identities(v.scans, v.overrides, v.named_students)
    newcomers = identity.allocate_names(identified, v.named_students)
    return identity.scan_outcomes(identified, newcomers)


def _outcomes(v):
    """A mixed outcome table over customers: some without a student.

    The orders left out (one in three) are the rows that are to be found missing.
    """
    return v.sql(
        """select 'C' || (o_custkey % 25) as course_id, 'HW' || (o_orderkey % 12) as assignment_id,
          case when o_custkey % 50 = 7 then '' else 'S' || o_custkey end as student_id,
          case o_orderkey % 5 when 0 then 'skipped' when 1 then 'frozen' else 'ready' end as status
        from orders where o_orderkey % 3 <> 1"""
    )


ORACLE_VIEWS["o_outcomes"] = """
select 'C' || (o_custkey % 25) as course_id, 'HW' || (o_orderkey % 12) as assignment_id,
  case when o_custkey % 50 = 7 then '' else 'S' || o_custkey end as student_id,
  case o_orderkey % 5 when 0 then 'skipped' when 1 then 'frozen' else 'ready' end as status
from orders where o_orderkey % 3 <> 1"""


@query(
    "j16_missing_rows",
    """select s.course_id, assignment_id, s.student_id, 'missing' as status,
      cast(0 as bigint) as uploads, cast(0 as bigint) as files
    from f_students s join (select distinct course_id, assignment_id from o_outcomes) c
      on c.course_id = s.course_id
    where not exists (select 1 from o_outcomes o where o.course_id = s.course_id
      and o.assignment_id = c.assignment_id and o.student_id = s.student_id)""",
)
def missing_rows(v):
    return ingest.missing_rows(_outcomes(v), v.students)


@query(
    "a21_status_counts",
    """select course_id, assignment_id, count(*) filter (status = 'ready') as n_ready,
      count(*) filter (status = 'skipped') as n_skipped, count(*) filter (status = 'frozen') as n_frozen,
      count(*) filter (status = 'missing') as n_missing,
      count(*) filter (status in ('skipped', 'frozen')) as attention
    from o_outcomes group by all""",
)
def status_counts(v):
    return ingest.status_counts(_outcomes(v))


@query(
    "a21_receipt_merge",
    """select course_id, assignment_id, case when assignment_id in ('HW2', 'HW3', 'HW5')
        then count(*) filter (status in ('skipped', 'frozen')) else cast(7 as bigint) end as attention
    from o_outcomes group by course_id, assignment_id""",
)
def receipt_merge(v):
    counts = ingest.status_counts(_outcomes(v)).select("course_id", "assignment_id", "attention")
    previous = counts.withColumn("attention", F.lit(7).cast("long"))
    current = counts.where(F.col("assignment_id").isin("HW2", "HW3", "HW5"))
    return ingest.merge_receipts(previous, current)


@query(
    "j17_frozen_submissions",
    """select distinct course_id, student_id, assignment_id from f_trials0
    where submission_source = 'student' and student_id is not null""",
)
def frozen_submissions(v):
    return ingest.frozen_submissions(v.trials0)


@query(
    "j10_enriched_students",
    """select g.* exclude (mean_score_pct, sd_score_pct), coalesce(s.display_name, '') as display_name,
      coalesce(s.lms_username, '') as lms_username
    from o_students g left join f_students s on s.course_id = g.course_id
      and s.student_id = g.student_id and s.c_custkey % 4 <> 0""",
)
def enriched_students(v):
    known = v.students.where(F.col("c_custkey") % 4 != 0)
    return identity.enrich(v.student_table.drop("mean_score_pct", "sd_score_pct"), known)


@query(
    "j10_unmapped_students",
    """select distinct course_id, student_id from f_trials0 t
    where student_id is not null and not starts_with(student_id, '_') and not exists (select 1
      from f_students s where s.course_id = t.course_id and s.student_id = t.student_id
        and s.c_custkey % 4 <> 0)""",
)
def unmapped_students(v):
    return identity.unmapped_students(v.trials0, v.students.where(F.col("c_custkey") % 4 != 0))


@query(
    "a20_identity_violations",
    """select course_id, rule, subject, detail, n from (
      select course_id, 'username' as rule, lower(ltrim(lms_username, '#')) as subject,
        'duplicate' as detail, count(*) as n from f_students group by all having count(*) > 1
      union all select course_id, 'enrollment', lower(ltrim(lms_username, '#')), 'duplicate', count(*)
        from (select * from f_enrollments union all
          select course_id, '#' || upper(lms_username), rubric, source from f_enrollments
          where rubric = 'BUILDING') e group by 1, 3 having count(*) > 1
      union all select '', 'roster', '', 'blank', count(*) from f_roster
        where c_custkey % 101 = 5 having count(*) > 0) x""",
)
def identity_violations(v):
    doubled = v.enrollments.unionByName(
        v.enrollments.where(F.col("rubric") == "BUILDING").withColumn(
            "lms_username", F.concat(F.lit("#"), F.upper("lms_username"))
        )
    )
    blanked = v.roster.withColumn(
        "username",
        F.when(F.col("c_custkey") % 101 == 5, " # ").otherwise(F.col("username")),
    )
    blanked = blanked.withColumn(
        "username", F.when(F.col("username") == " # ", "#").otherwise(F.col("username"))
    )
    return identity.identity_violations(v.students, blanked, doubled)
