"""Review queue: each initial grading group beside the final judgments over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import constants as C
from gradeloom.functions.predicates import is_valid_grading, known
from gradeloom.functions.scalars import format_general, justification_paths
from gradeloom.operators import keys as K
from gradeloom.operators.lineage import prior_names
from gradeloom.operators.repeats import trial_ref
from gradeloom.operators.spread import grouped_with_median, join_on_keys, numbered
from gradeloom.session import written

_SHOWN = ["student_id", "submission_source", "rubric_sha256"]
_JUDGE_FIRST = [
    *K.TRIAL, *_SHOWN, "course_id", "assignment_id", "context_config_name",
    "context_config_identity", "n_prior_gradings", "prior_trials",
]

# The columns of the queue. What a group lists one by one is in the long
# tables below.
COLUMNS = [
    *K.REPEAT, *_SHOWN, "n_initial_gradings", "initial_median_score_pct",
    "initial_range_score_pct", "judge_config_name", "judge_config_identity",
    "n_final_gradings", "final_score_pct", "n_prior_gradings", "n_resolved_prior_gradings",
    "n_missing_prior_gradings", "prior_score_pct_values", "prior_min_score_pct",
    "prior_max_score_pct", "prior_range_score_pct", "prior_trials",
    "prior_justification_paths", "n_unseen_initial_gradings", "final_outside_range",
    "final_distance_outside_range_pct", "first_final_trial", "review_reasons",
]


def _joined(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.array_join(names, "; "))


def _sides(trials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid gradings without and with a judge's context."""
    return _split(trials.where(is_valid_grading()))


def _held_sides(trials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same in the columns of the queue, written once: several steps read them."""
    columns = dict.fromkeys([*K.REPEAT, "score_pct", *_JUDGE_FIRST])
    return _split(written(trials.where(is_valid_grading()).select(*columns)))


def _split(valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    is_judge = F.col("context_config_identity").isNotNull()
    return valid.where(~is_judge), valid.where(is_judge)


def initial_groups(rows: DataFrame) -> DataFrame:
    """One row per initial grading group, single gradings included.

    ``rows`` are read twice, like those of ``judge_groups``.
    """
    shown = [*K.TRIAL, *_SHOWN]
    return grouped_with_median(
        rows.select(*K.REPEAT, "score_pct", *shown),
        K.REPEAT,
        "score_pct",
        [
            F.sum(F.lit(1)).alias("n_initial_gradings"),
            F.min(F.struct(*shown)).alias("first"),
            F.max("median").alias("initial_median_score_pct"),
            (F.max("score_pct") - F.min("score_pct")).alias("initial_range_score_pct"),
        ],
    ).select(
        *K.REPEAT,
        *[F.col(f"first.{c}").alias(c) for c in _SHOWN],
        "n_initial_gradings",
        "initial_median_score_pct",
        "initial_range_score_pct",
    )


def judge_groups(rows: DataFrame) -> DataFrame:
    """One row per judge item: the final median and the first row's recorded lineage."""
    return grouped_with_median(
        rows.select(*dict.fromkeys([*K.JUDGE, "score_pct", *_JUDGE_FIRST])),
        K.JUDGE,
        "score_pct",
        [
            F.sum(F.lit(1)).alias("n_final_gradings"),
            F.max("median").alias("final_score_pct"),
            F.min(F.struct(*_JUDGE_FIRST)).alias("first"),
            F.min(trial_ref()).alias("first_final_trial"),
        ],
    )


def resolved_priors(judges: DataFrame, initial_rows: DataFrame) -> DataFrame:
    """Judge items with their recorded priors matched to loaded initial gradings."""
    carried = [c for c in judges.columns if c not in K.JUDGE]
    names = prior_names("first.prior_trials")
    listed = judges.select(
        *K.JUDGE,
        F.struct(*carried).alias("judge"),
        F.coalesce(F.size(F.array_distinct(names)).cast("long"), F.lit(0)).alias("n_names"),
        F.explode_outer(names).alias("prior_name"),
    )
    where_graded = initial_rows.select(
        trial_ref().alias("prior_name"),
        F.struct(*K.REPEAT).alias("group"),
        F.col("score_pct").alias("prior_score"),
    )
    return (
        listed.join(where_graded, "prior_name", "left")
        .groupBy(*K.JUDGE)
        .agg(
            F.any_value("judge").alias("judge"),
            F.count("prior_name").alias("n_listed"),
            F.count("group").alias("n_resolved"),
            F.max("n_names").alias("n_distinct"),
            # As long as the recorded list, which is one cell of the source.
            F.size(F.collect_set(F.when(F.col("group").isNotNull(), F.col("prior_name"))))
            .cast("long")
            .alias("n_distinct_resolved"),
            F.min("group").alias("group"),
            F.max("group").alias("group_high"),
            F.min("prior_score").alias("low"),
            F.max("prior_score").alias("high"),
            F.array_sort(F.collect_list("prior_score")).alias("prior_scores"),
        )
        .withColumn(
            "group", F.when(F.col("group").eqNullSafe(F.col("group_high")), F.col("group"))
        )
        .drop("group_high")
        .select("*", "judge.*")
        .drop("judge")
    )


def _reasons() -> Column:
    """Reason codes in their fixed order; the codes are fixed values."""
    checks = [
        (F.col("final_outside_range"), "final_outside_prior_range"),
        (F.col("initial_range_score_pct") > C.REPEAT_RANGE_FLAG_PCT, "wide_initial_range"),
        (F.col("n_unseen_initial_gradings") > 0, "initial_not_in_judge_context"),
        (F.col("n_missing_prior_gradings") > 0, "missing_prior_results"),
        (F.col("lineage_unresolved"), "unresolved_prior_lineage"),
        (F.col("without_initial"), "final_without_loaded_initial_group"),
    ]
    codes = F.array_compact(F.array(*[F.when(known(test), F.lit(code)) for test, code in checks]))
    return _joined(codes)


def review_queue(trials: DataFrame) -> DataFrame:
    """The unsorted review queue; see ``priority_order`` for the report order."""
    initial_rows, judge_rows = _held_sides(trials)
    initial = initial_groups(initial_rows)
    judges = judge_groups(judge_rows)
    matched = resolved_priors(judges, initial_rows)

    recorded = F.col("first.n_prior_gradings")
    n_resolved, n_listed = F.col("n_resolved"), F.col("n_listed")
    missing = F.when(
        recorded.isNotNull(), F.greatest(recorded - n_resolved, n_listed - n_resolved)
    )
    listed_names = prior_names("first.prior_trials")
    prior_texts = F.transform("prior_scores", format_general)
    finals = matched.select(
        F.col("group"),
        F.col("first"),
        F.col("config_name").alias("judge_config_name"),
        F.col("config_identity").alias("judge_config_identity"),
        F.col("item_id").alias("judge_item_id"),
        "n_final_gradings",
        "final_score_pct",
        recorded.alias("n_prior_gradings"),
        n_resolved.alias("n_resolved_prior_gradings"),
        missing.alias("n_missing_prior_gradings"),
        _joined(prior_texts).alias("prior_score_pct_values"),
        # An empty recorded list is still a recorded list of one empty name.
        F.col("first.prior_trials").alias("prior_trials"),
        F.array_join(justification_paths(listed_names), "; ").alias("prior_justification_paths"),
        "first_final_trial",
        "n_distinct_resolved",
        "low",
        "high",
        known(
            (recorded == n_listed)
            & (F.col("n_distinct") == n_listed)
            & (missing == 0)
            & (n_resolved > 0)
            & F.col("group").isNotNull()
        ).alias("complete"),
    )

    attached = finals.where(F.col("group").isNotNull()).select(
        *[F.col(f"group.{k}").alias(k) for k in K.REPEAT],
        *[c for c in finals.columns if c not in ("group", "first", "judge_item_id")],
    )
    low = F.when(F.col("complete"), F.col("low"))
    high = F.when(F.col("complete"), F.col("high"))
    final = F.col("final_score_pct")
    # Groups that no final judgment resolves to keep their row, without judge columns.
    with_initial = (
        join_on_keys(initial, attached, K.REPEAT, "left")
        .withColumn("n_final_gradings", F.coalesce("n_final_gradings", F.lit(0)))
        .withColumn("prior_min_score_pct", low)
        .withColumn("prior_max_score_pct", high)
        .withColumn("prior_range_score_pct", high - low)
        .withColumn(
            "n_unseen_initial_gradings",
            F.col("n_initial_gradings") - F.col("n_distinct_resolved"),
        )
        .withColumn("final_outside_range", (final < low) | (final > high))
        .withColumn(
            "final_distance_outside_range_pct",
            F.when(F.col("complete"), F.greatest(low - final, final - high, F.lit(0.0))),
        )
        .withColumn("lineage_unresolved", ~F.col("complete"))
    )
    standalone = (
        finals.where(F.col("group").isNull())
        .withColumn("config_name", F.col("first.context_config_name"))
        .withColumn("config_identity", F.col("first.context_config_identity"))
        .withColumn("course_id", F.col("first.course_id"))
        .withColumn("assignment_id", F.col("first.assignment_id"))
        .withColumn("item_id", F.col("judge_item_id"))
        .withColumn("item_identity", F.lit(None).cast("string"))
        .withColumns({c: F.col(f"first.{c}") for c in _SHOWN})
        .withColumn("n_initial_gradings", F.lit(0).cast("long"))
        .withColumn("lineage_unresolved", F.lit(True))
        .withColumn("without_initial", F.lit(True))
        .drop("group", "first", "judge_item_id")
    )
    combined = with_initial.unionByName(standalone, allowMissingColumns=True)
    return (
        combined.withColumn("review_reasons", _reasons())
        .select(*COLUMNS)
    )


def _one_path(ref: str) -> Column:
    return justification_paths(F.array(ref))[0]


def initial_gradings(trials: DataFrame) -> DataFrame:
    """Long form: every grading of every initial group, with its justification's path."""
    rows = _sides(trials)[0].select(*K.REPEAT, trial_ref().alias("initial_trial"), "score_pct")
    return rows.withColumn("justification_path", _one_path("initial_trial"))


def final_gradings(trials: DataFrame) -> DataFrame:
    """Long form: every final judgment of every judge item."""
    rows = _sides(trials)[1].select(*K.JUDGE, trial_ref().alias("final_trial"), "score_pct")
    return rows.withColumn("justification_path", _one_path("final_trial"))


def unseen_initial_gradings(trials: DataFrame) -> DataFrame:
    """Long form: initial gradings of a judged group that the judge did not see."""
    initial_rows, judge_rows = _held_sides(trials)
    judges = judge_groups(judge_rows)
    one_group = resolved_priors(judges, initial_rows).where(F.col("group").isNotNull())
    attached = one_group.select(
        F.col("config_name").alias("judge_config_name"),
        F.col("config_identity").alias("judge_config_identity"),
        *[F.col(f"group.{k}").alias(k) for k in K.REPEAT],
    )
    seen = judges.select(
        F.col("config_name").alias("judge_config_name"),
        F.col("config_identity").alias("judge_config_identity"),
        F.explode(prior_names("first.prior_trials")).alias("initial_trial"),
    )
    everyone = join_on_keys(
        initial_rows.select(*K.REPEAT, trial_ref().alias("initial_trial")), attached, K.REPEAT
    )
    return join_on_keys(
        everyone,
        seen.distinct(),
        ["judge_config_name", "judge_config_identity", "initial_trial"],
        "left_anti",
    )


def _priority() -> list[Column]:
    return [
        F.coalesce("final_outside_range", F.lit(False)).desc(),
        F.coalesce("final_distance_outside_range_pct", F.lit(0.0)).desc(),
        F.col("initial_range_score_pct").desc_nulls_last(),
        *[F.col(k).asc_nulls_last() for k in K.REPEAT],
        F.col("judge_config_name").asc_nulls_last(),
        F.col("judge_config_identity").asc_nulls_last(),
        F.col("first_final_trial").asc_nulls_last(),
    ]


def priority_order(queue: DataFrame) -> DataFrame:
    """The queue in report order: a range-partitioned sort, for the sink only."""
    return queue.orderBy(*_priority())


def priority_rank(queue: DataFrame) -> DataFrame:
    """The queue with its priority rank inside each course."""
    return numbered(queue, ["course_id"], _priority(), "priority_rank")
