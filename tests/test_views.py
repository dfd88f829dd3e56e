"""The Spark form of the shared views: same rows as their SQL, and no whole rows held."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gradeloom.checks import load_queries
from gradeloom.checks import views as V
from gradeloom.operators.lineage import mark_superseded


@pytest.fixture
def folder(spark, tmp_path):
    """Orders of seven lines; some lines and orders twice, some keys null."""
    orders = spark.range(1, 60).select(
        F.col("id").alias("o_orderkey"), (F.col("id") * 7 % 53).alias("o_custkey")
    )
    orders = orders.union(orders.where("o_orderkey % 20 = 0")).union(
        spark.sql("select cast(null as bigint), 5L")
    )
    lines = spark.range(1, 60 * 7).select(
        (F.col("id") % 60).alias("l_orderkey"),
        (F.col("id") * 13 % 97).alias("l_partkey"),
        (F.col("id") * 5 % 11).alias("l_suppkey"),
        (F.floor(F.col("id") / 60) + 1).cast("int").alias("l_linenumber"),
        (F.col("id") * 10.25).alias("l_extendedprice"),
        (F.col("id") % 11 / 100).alias("l_discount"),
        (F.col("id") % 9 / 100).alias("l_tax"),
    )
    lines = lines.union(lines.where("l_orderkey % 9 = 0")).union(
        spark.sql("values (null, 1L, 1L, 7, 10.0d, 0.05d, 0.01d), (5L, null, 1L, 7, 10.0d, 0.05d, 0.01d)")
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


load_queries()


class Plain(V.SparkViews):
    """The views as their SQL says."""

    def __getattr__(self, name):
        if name.startswith("_") or name in V.BASE_TABLES:
            return super().__getattr__(name)
        if name not in self._built:
            self._built[name] = self.sql(V.VIEWS["f_" + name])
        return self._built[name]


@pytest.mark.parametrize("name", ["priors", "trials0", "criteria", "record_docs", "result_docs", "artifact_docs"])
def test_views_by_order_have_the_rows_of_their_sql(spark, folder, name, monkeypatch):
    mine = sorted(map(repr, getattr(V.SparkViews(spark, folder), name).collect()))
    monkeypatch.setattr(V, "_BY_ORDER", V._BY_NAME)
    plain = getattr(Plain(spark, folder), name)
    assert mine == sorted(map(repr, plain.collect()))
    assert mine


@pytest.mark.parametrize("name", ["artifact_files", "pool", "planned"])
def test_views_may_name_what_they_need_of_a_line(spark, folder, name, monkeypatch):
    """The files of a submission depend on the customer of the order."""
    mine = sorted(map(repr, getattr(V.SparkViews(spark, folder), name).collect()))
    monkeypatch.setattr(V, "_BY_ORDER", V._BY_NAME)
    assert mine == sorted(map(repr, getattr(Plain(spark, folder), name).collect()))
    assert mine


def test_trials_are_not_shuffled_by_name(spark, folder):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = V.SparkViews(spark, folder).trials0._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(l_orderkey" in plan
    assert "hashpartitioning(trial_name" not in plan


def test_lines_are_shuffled_once_by_order(spark, folder):
    """Neither the trials nor the stored files of them read the lines a second time."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        views = V.SparkViews(spark, folder)
        for name in ("trials0", "record_docs"):
            plan = getattr(views, name)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 2, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_whole_rows_are_held(spark, folder):
    views = V.SparkViews(spark, folder)
    for name in ("trials0", "trials", "student_table", "queue", "record_docs", "result_docs", "artifact_docs"):
        level = getattr(views, name).storageLevel
        assert not (level.useMemory or level.useDisk), name


def test_rows_without_a_judgment_need_no_shuffle(spark, make_trials):
    context = {"context_config_identity": "x", "item_id": "i", "score_pct": 1.0}
    trials = make_trials(
        {**context, "trial_name": "narrow", "prior_trials": "a"},
        {**context, "trial_name": "wide", "prior_trials": "a; b"},
        {**context, "trial_name": "other", "prior_trials": "a", "item_id": None},
        {"trial_name": "plain", "superseded": True},
        {"trial_name": "staged", "stage": None, "prior_trials": "a", "score_pct": 1.0},
    )
    marked = mark_superseded(trials)
    assert {r.trial_name: r.superseded for r in marked.collect()} == {
        "narrow": True, "wide": False, "other": False, "plain": False, "staged": False
    }
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union")
