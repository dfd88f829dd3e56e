"""Every registered query beside its oracle, and the shape of the plans."""

from __future__ import annotations

import random
import re

import pytest

import __spark_entry__
from gradeloom.checks import load_queries
from gradeloom.checks.compare import compare, oracle_connection, rows_of
from gradeloom.checks.registry import oracle_queries, spark_queries
from gradeloom.checks.views import SparkViews
from gradeloom.operators import ladder, quality, repeats, review

FOLDER = "/root/testdata/sf0.001"

load_queries()
QUERIES, ORACLES = spark_queries(), oracle_queries()
# Only these read Python workers: a hash fed batch by batch.
HASHED = {
    "a17_directory_digests", "g04_apply_decisions", "g05_submission_digests", "g06_source_status",
}


@pytest.fixture(scope="module")
def con():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, con, name):
    status, detail = compare(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name))
    assert status == "OK", detail


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) >= set(QUERIES)
    assert set(__spark_entry__.queries()) >= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_stay_distributed(spark, name):
    physical = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bBatchEvalPython|ArrowEvalPython|CartesianProduct\b", physical)
    if name not in HASHED:
        assert "MapInPandas" not in physical
    # The views cross small literal tables in; nothing else is nested or crossed.
    for nested in re.findall(r"BroadcastNestedLoopJoin[^\n]*", physical):
        assert re.search(r"Cross|Inner", nested)


def test_results_do_not_depend_on_partitioning(spark):
    views = SparkViews(spark, FOLDER)
    trials = views.trials
    shuffled = trials.repartition(13, "trial_name").sortWithinPartitions("reward", "job_name")

    def snapshot(df):
        return rows_of(df.columns, df.collect())

    builders = [
        lambda t: repeats.repeat_consistency(t),
        lambda t: review.review_queue(t),
        lambda t: quality.criterion_agreement(t, views.criteria).drop("criterion_mean_abs_diff"),
        lambda t: ladder.grades_by_assignment(t).select("course_id", "n_gradings", "n_solve_trials"),
    ]
    for build in builders:
        before = snapshot(build(trials))
        spark.conf.set("spark.sql.shuffle.partitions", str(random.choice([1, 31])))
        try:
            assert snapshot(build(shuffled)) == before
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
