"""Course audit: registry fields, coverage, and consistency of a course folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import constants as C
from gradeloom.functions.predicates import is_pseudo, known

_AREAS = ["assignments", "rubrics", "reference_solutions"]
# Environments an assignment may ask for.
ENVIRONMENTS = ("data-science", "grading", "optimization", "scientific-python")


def _codes(checks: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(known(t), F.lit(c)) for t, c in checks]))


def field_violations(registry: DataFrame) -> DataFrame:
    """One row per broken field of a raw registry (values as written, NULL = absent).

    Columns: course_id, id, type, scope, weight_pct, ai_policy, ai_use_possible,
    due, rubric_provenance (all text) and rubrics (array of text).
    """
    def outside(column: str, domain: tuple[str, ...]) -> Column:
        return F.col(column).isNotNull() & ~F.col(column).isin(*domain)

    weight = F.col("weight_pct").try_cast("double")
    bad_weight = F.col("weight_pct").isNotNull() & (
        weight.isNull() | F.isnan(weight) | (weight == float("inf")) | (weight < 0)
    )
    names = F.col("rubrics")
    bad_rubrics = names.isNotNull() & (
        (F.size(names) < 2)
        | (F.size(F.array_distinct(names)) != F.size(names))
        | F.exists(names, lambda n: known(~n.rlike(r"^(?U)[\p{Alnum}_-]+$")) | n.isNull())
    )
    bad_id = F.col("id").isNull() | (F.col("id") == "") | F.col("id").rlike(r"(?U)[\s/]")
    checks = [
        (bad_id, "id"),
        (outside("type", C.ASSESSMENT_TYPES), "type"),
        (outside("scope", C.ASSESSMENT_SCOPES), "scope"),
        (outside("ai_policy", C.AI_POLICIES), "ai_policy"),
        (bad_weight, "weight_pct"),
        (
            F.col("ai_use_possible").isNotNull() & ~F.col("ai_use_possible").isin("true", "false"),
            "ai_use_possible",
        ),
        (
            F.col("due").isNotNull()
            & (~F.col("due").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.col("due").try_cast("date").isNull()),
            "due",
        ),
        (outside("rubric_provenance", C.RUBRIC_PROVENANCES), "rubric_provenance"),
        (bad_rubrics, "rubrics"),
    ]
    fields = registry.select(
        "course_id", F.coalesce("id", F.lit("")).alias("id"), F.explode(_codes(checks)).alias("field")
    )
    repeated = (
        registry.where(F.col("id").isNotNull())
        .groupBy("course_id", "id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("course_id", "id", F.lit("duplicate_id").alias("field"))
    )
    return fields.unionByName(repeated)


def registry_coverage(assessments: DataFrame, materials: DataFrame) -> DataFrame:
    """Per course: registered, with materials, excluded, and the weights they carry."""
    have = materials.select(
        "course_id", F.col("assignment_id").alias("id"), F.lit(True).alias("has_materials")
    ).distinct()
    joined = assessments.join(have, ["course_id", "id"], "left")
    covered = known(F.col("has_materials"))
    weight = F.col("weight_pct")
    complete = F.count_if(weight.isNull()) == 0
    total = F.coalesce(F.sum(weight), F.lit(0.0))
    return joined.groupBy("course_id").agg(
        F.count(F.lit(1)).alias("n_registered"),
        F.count_if(covered).alias("n_with_materials"),
        F.count_if(F.col("excluded").isNotNull()).alias("n_excluded"),
        F.when(complete, total).alias("weight_sum"),
        (complete & (F.abs(total - 100.0) > C.WEIGHT_SUM_TOLERANCE)).alias("weight_violation"),
        F.when(
            F.count_if(covered & weight.isNull()) == 0,
            F.coalesce(F.sum(F.when(covered, weight)), F.lit(0.0)),
        ).alias("covered_weight"),
        complete.alias("weights_complete"),
    )


def folder_facts(listing: DataFrame) -> DataFrame:
    """Per (course, area, name): what a course folder holds there.

    ``listing`` has one row per entry: course_id, path below the course folder,
    and ``is_dir``.
    """
    parts = F.split("path", "/")
    entries = listing.select(
        "course_id",
        parts[0].alias("area"),
        F.try_element_at(parts, F.lit(2)).alias("name"),
        F.try_element_at(parts, F.lit(3)).alias("third"),
        F.size(parts).alias("depth"),
        "is_dir",
    ).where(F.col("area").isin(*_AREAS) & F.col("name").isNotNull())
    is_file = ~F.col("is_dir")

    def seen(test: Column) -> Column:
        return F.bool_or(known(test))

    third, depth = F.col("third"), F.col("depth")
    return entries.groupBy("course_id", "area", "name").agg(
        seen(F.col("is_dir") | (depth > 2)).alias("is_dir"),
        seen(is_file & (depth > 2)).alias("has_files"),
        seen(is_file & (depth == 3) & (third == "default.md")).alias("has_default"),
        seen(is_file & (depth == 3) & (third == "archive")).alias("archive_is_file"),
        seen(is_file & (depth == 3) & (third == "source")).alias("source_is_file"),
        seen((third == "source") & (F.col("is_dir") | (depth > 3))).alias("source_is_dir"),
        seen(is_file & (depth > 3) & (third == "source")).alias("source_has_files"),
    )


def _area(facts: DataFrame, area: str, prefix: str, columns: list[str]) -> DataFrame:
    rows = facts.where((F.col("area") == area) & F.col("is_dir"))
    return rows.select(
        "course_id",
        F.col("name").alias("id"),
        F.lit(True).alias(prefix),
        *[F.col(c).alias(f"{prefix}_{c}") for c in columns],
    )


def subject_findings(
    assessments: DataFrame, facts: DataFrame, environments: DataFrame
) -> DataFrame:
    """Findings about one assignment or assessment: (course_id, severity, rule, subject).

    ``environments`` gives each assignment's resolved environment: its own
    setting or else the course default.
    """
    registry = assessments.select(
        "course_id", "id", "excluded", "type", "ai_policy", "ai_use_possible", "weight_pct",
        "rubric_provenance", F.lit(True).alias("registered"),
    )
    with_registry = assessments.select("course_id").distinct().withColumn(
        "has_registry", F.lit(True)
    )
    key = ["course_id", "id"]
    table = (
        registry.join(_area(facts, "assignments", "handout", ["has_files"]), key, "full_outer")
        .join(
            _area(
                facts,
                "rubrics",
                "rubric",
                ["has_default", "archive_is_file", "source_is_file", "source_is_dir",
                 "source_has_files"],
            ),
            key,
            "full_outer",
        )
        .join(_area(facts, "reference_solutions", "reference", ["has_files"]), key, "full_outer")
        .join(environments.withColumnRenamed("assignment_id", "id"), key, "left")
        .join(with_registry, "course_id", "left")
    )
    flag = {
        c: known(F.col(c))
        for c in (
            "registered", "handout", "handout_has_files", "rubric", "rubric_has_default",
            "rubric_archive_is_file", "rubric_source_is_file", "rubric_source_is_dir",
            "rubric_source_has_files", "reference", "reference_has_files", "has_registry",
        )
    }
    registered, handout = flag["registered"], flag["handout"]
    identified = registered | handout
    default = flag["rubric_has_default"]
    provenance = F.col("rubric_provenance")
    environment = F.col("environment")
    violations = [
        (handout & ~flag["handout_has_files"], "assignment_empty"),
        (handout & environment.isNull(), "no_environment"),
        (handout & (environment == C.RESERVED_ENVIRONMENT), "reserved_environment"),
        (handout & ~environment.isin(*ENVIRONMENTS), "unknown_environment"),
        (handout & flag["has_registry"] & ~registered, "not_in_registry"),
        (handout & F.col("excluded").isNotNull(), "excluded_with_materials"),
        (flag["rubric"] & ~identified, "rubric_of_nothing"),
        (flag["rubric_archive_is_file"], "rubric_archive_is_file"),
        (flag["rubric_source_is_file"], "rubric_source_is_file"),
        (
            flag["rubric_source_is_dir"] & ~flag["rubric_source_has_files"]
            & ~flag["rubric_source_is_file"],
            "rubric_source_empty",
        ),
        (registered & provenance.isNotNull() & ~default, "provenance_without_rubric"),
        (
            provenance.isin("handout", "authored") & flag["rubric_source_has_files"],
            "provenance_below_source",
        ),
        (flag["reference"] & ~identified, "reference_of_nothing"),
    ]
    gaps = [
        (registered & ~handout & F.col("excluded").isNull(), "no_materials"),
        (registered & F.col("weight_pct").isNull(), "no_weight_pct"),
        (registered & F.col("type").isNull(), "no_type"),
        (registered & F.col("ai_policy").isNull(), "no_ai_policy"),
        (registered & F.col("ai_use_possible").isNull(), "no_ai_use_possible"),
        (handout & ~default, "no_default_rubric"),
        (registered & default & provenance.isNull(), "rubric_without_provenance"),
        (handout & ~flag["reference_has_files"], "no_reference_solution"),
    ]

    def found(severity: str, checks: list[tuple[Column, str]]) -> Column:
        return F.transform(
            _codes(checks), lambda c: F.struct(F.lit(severity).alias("severity"), c.alias("rule"))
        )

    return table.select(
        "course_id",
        F.col("id").alias("subject"),
        F.inline(F.concat(found("violation", violations), found("gap", gaps))),
    ).select("course_id", "severity", "rule", "subject")


def folder_findings(listing: DataFrame, facts: DataFrame) -> DataFrame:
    """Stray files, sidecars without an assignment, unexpected entries, no syllabus."""
    strays = facts.where(~F.col("is_dir"))
    sidecar = (F.col("area") == "assignments") & F.col("name").endswith(".toml")
    handouts = facts.where((F.col("area") == "assignments") & F.col("is_dir")).select(
        "course_id", "name"
    )
    lonely = (
        strays.where(sidecar)
        .withColumn("name", F.regexp_replace("name", r"\.toml$", ""))
        .join(handouts, ["course_id", "name"], "left_anti")
    )
    top = F.split("path", "/")[0]
    entries = listing.groupBy("course_id", top.alias("top")).agg(
        F.bool_or(~F.col("is_dir") & F.col("path").contains("/")).alias("has_files")
    )
    unexpected = entries.where(~F.col("top").isin(*C.EXPECTED_COURSE_ENTRIES))
    bare = (
        entries.groupBy("course_id")
        .agg(
            F.bool_or((F.col("top") == "syllabus") & F.col("has_files")).alias("syllabus"),
            F.bool_or(F.col("top") == "assignments").alias("assignments"),
            F.bool_or(F.col("top") == "course.toml").alias("record"),
        )
        .select(
            "course_id",
            F.explode(
                _codes(
                    [
                        (~F.col("syllabus"), "no_syllabus"),
                        (~F.col("assignments"), "no_assignments"),
                        (~F.col("record"), "no_course_record"),
                    ]
                )
            ).alias("rule"),
        )
    )

    def rows(df: DataFrame, severity: str, rule: Column, subject: Column) -> DataFrame:
        return df.select(
            "course_id", F.lit(severity).alias("severity"), rule.alias("rule"), subject.alias("subject")
        )

    return (
        rows(lonely, "violation", F.lit("sidecar_without_assignment"), F.col("name"))
        .unionByName(
            rows(
                strays.where(~sidecar),
                "gap",
                F.concat(F.lit("stray_file_in_"), F.col("area")),
                F.col("name"),
            )
        )
        .unionByName(rows(unexpected, "gap", F.lit("unexpected_entry"), F.col("top")))
        .unionByName(rows(bare, "gap", F.col("rule"), F.lit("")))
    )


def course_findings(courses: DataFrame, coverage: DataFrame) -> DataFrame:
    """Findings about a course record: absent facts, no registry, weights off."""
    joined = courses.join(coverage, "course_id", "left")
    gaps = [
        (F.col("title").isNull(), "no_title"),
        (F.col("institution").isNull(), "no_institution"),
        (F.col("term").isNull(), "no_term"),
        (F.col("n_registered").isNull(), "no_registry"),
    ]
    found = F.concat(
        F.transform(
            _codes(gaps), lambda c: F.struct(F.lit("gap").alias("severity"), c.alias("rule"))
        ),
        F.transform(
            _codes([(F.col("weight_violation"), "weight_sum")]),
            lambda c: F.struct(F.lit("violation").alias("severity"), c.alias("rule")),
        ),
    )
    return joined.select("course_id", F.inline(found)).withColumn("subject", F.lit(""))


def enrollment_findings(
    declared: DataFrame,
    rubric_names: DataFrame,
    enrollments: DataFrame,
    submissions: DataFrame,
    routes: DataFrame,
) -> DataFrame:
    """Findings about rubric routing.

    ``declared``: course_id, id, rubric of every routed assessment;
    ``rubric_names``: rubrics on disk; ``submissions``: stored student work;
    ``routes``: routing of that work.
    """
    on_disk = rubric_names.select("course_id", F.col("assignment_id").alias("id"), "rubric")
    absent = declared.join(on_disk, ["course_id", "id", "rubric"], "left_anti")
    routed = declared.select("course_id").distinct()
    in_scope = enrollments.join(routed, "course_id", "left_semi")
    undeclared = in_scope.join(
        declared.select("course_id", "rubric"), ["course_id", "rubric"], "left_anti"
    ).select("course_id", "rubric").distinct()
    none = routed.join(enrollments.select("course_id"), "course_id", "left_anti")
    work = ["course_id", "assignment_id", "student_id"]
    unrouted = (
        routes.where(F.col("routed") & F.col("reason").isNotNull() & ~is_pseudo())
        .join(submissions.select(*work), work, "left_semi")
        .groupBy("course_id", "assignment_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def rows(df: DataFrame, severity: str, rule: str, subject: Column) -> DataFrame:
        return df.select(
            "course_id",
            F.lit(severity).alias("severity"),
            F.lit(rule).alias("rule"),
            subject.alias("subject"),
        )

    return (
        rows(absent, "violation", "declared_rubric_missing", F.concat_ws("/", "id", "rubric"))
        .unionByName(rows(undeclared, "violation", "enrollment_rubric_undeclared", F.col("rubric")))
        .unionByName(rows(none, "gap", "no_enrollments", F.lit("")))
        .unionByName(
            rows(unrouted, "gap", "work_without_enrollment",
                 F.concat_ws(" ", "assignment_id", F.col("n").cast("string")))
        )
    )
