"""Lineage between final judgments and the gradings they were shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.predicates import is_stage, known
from gradeloom.operators.spread import join_on_keys
from gradeloom.session import written

GROUP = ["config_identity", "item_id", "context_config_identity"]


def prior_names(column: str = "prior_trials") -> Column:
    """The recorded priors as an array; an empty record is the one-element array ``[""]``."""
    return F.split(F.col(column), "; ", -1)


def _judged() -> Column:
    return (
        is_stage("grade")
        & F.col("context_config_identity").isNotNull()
        & F.col("prior_trials").isNotNull()
        & F.col("score_pct").isNotNull()
    )


def _set() -> Column:
    return F.array_sort(F.array_distinct(prior_names()))


#: Pairs that a node may compare for each of its sets, at most; one with more is divided.
PAIRS_A_SET = 4


def _ranked_sets(trials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct prior sets by number, and those that may have a superset with members by rarity.

    An element that only one set has rules out any superset of it. ``largest`` is the
    largest set with the rarest element.
    """
    sets = written(
        trials.where(_judged())
        .groupBy(*GROUP, _set().alias("priors"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .drop("n_rows")
        # Tells an absent part of the group from an empty one.
        .withColumn("group", F.to_json(F.array(*[F.col(k).cast("string") for k in GROUP])))
        .withColumn("set_id", F.monotonically_increasing_id())
        .withColumn("size", F.size("priors"))
        # Written: that fixes the numbers, and the trials are read once.
    )
    members = sets.select("group", "set_id", "size", "priors", F.explode("priors").alias("member"))
    by_member = members.groupBy("group", "member").agg(
        F.count(F.lit(1)).alias("n_sets"),
        F.max(F.struct("size", "priors")).alias("largest"),
    )
    rarity = F.struct("n_sets", "member")
    ranked = (
        members.drop("priors", "size")
        .join(by_member, ["group", "member"])
        .groupBy("set_id")
        .agg(
            F.array_sort(F.collect_list(rarity)).alias("ranked"),
            F.min_by("largest.priors", rarity).alias("largest"),
        )
        .where(F.col("ranked")[0]["n_sets"] > 1)
        .select("set_id", F.col("ranked.member").alias("ranked"), "largest")
    )
    return sets, written(sets.join(ranked, "set_id"))


def _inside(narrow: str, wide: str) -> Column:
    return (F.size(narrow) < F.size(wide)) & (F.size(F.array_except(narrow, wide)) == 0)


def _found_by_prefix(probes: DataFrame, standing: DataFrame) -> list[DataFrame]:
    """Numbers of ``probes`` that are strict subsets of a set in ``standing``.

    A prefix tree over the probes' members, rarest first, is walked level by level. A node
    knows the probes that begin with its members and the larger standing sets that hold
    them all. A probe that ends at a node is inside any such set. A node with few probes or
    few sets compares them; another one hands both on to its children, where a set reaches
    only those children whose member it holds. So sets that share a few elements only part
    ways at the next one, and no level makes more than ``PAIRS_A_SET`` pairs for a set.
    """
    node = ["group", "prefix"]
    live = probes.select("group", "set_id", "size", "priors", "ranked", F.slice("ranked", 1, 1).alias("prefix"))
    reach = standing.select(
        "group", F.col("size").alias("wide_size"), F.col("priors").alias("wide"), F.explode("priors").alias("member")
    ).select("group", "wide_size", "wide", F.array("member").alias("prefix"))
    found, level = [], 1
    while not live.isEmpty():
        nodes = live.groupBy(*node).agg(F.count(F.lit(1)).alias("n_live"), F.min("size").alias("least"))
        reach = written(reach.join(nodes, node).where(F.col("wide_size") > F.col("least")))
        widest = reach.groupBy(*node).agg(
            F.count(F.lit(1)).alias("n_wide"), F.max("wide_size").alias("widest"), F.max("n_live").alias("n_live")
        )
        few = (F.col("n_live") <= PAIRS_A_SET) | (F.col("n_wide") <= PAIRS_A_SET)
        widest = written(widest.withColumn("few", few))
        waiting = written(live.join(widest.drop("n_live"), node).where(F.col("size") < F.col("widest")))
        found.append(waiting.where(F.col("size") == level).select("set_id"))
        longer = waiting.where(F.col("size") > level)
        found.append(
            longer.where("few").select("set_id", "priors", *node)
            .join(reach.select("wide", *node), node).where(_inside("priors", "wide")).select("set_id")
        )
        crowded = widest.where(~F.col("few")).select(*node)
        live = longer.where(~F.col("few")).select(
            "group", "set_id", "size", "priors", "ranked", F.slice("ranked", 1, level + 1).alias("prefix")
        )
        reach = (
            reach.join(crowded, node)
            .select("group", "wide_size", "wide", "prefix", F.explode(F.array_except("wide", "prefix")).alias("member"))
            .select("group", "wide_size", "wide", F.concat("prefix", F.array("member")).alias("prefix"))
        )
        level += 1
    return found


def superseded_sets(trials: DataFrame) -> DataFrame:
    """Prior sets, per judge group, that are a strict subset of another set there.

    Repeats of one judge item share a set, so sets are made distinct first. Every
    superset of a set contains the set's rarest element. The largest set with that
    element is tried first, one candidate for each set: nested sets end there. What is
    left is looked up in the sets that no other has replaced, as a replaced one is itself
    inside another, by a prefix tree. Null parts of a group are equal; without judgments
    there are no rows.

    Only the group, the recorded priors, stage and score of a trial are needed. The
    distinct sets are written to the folder of checkpoints.
    """
    sets, probes = _ranked_sets(trials)
    first = probes.where(_inside("priors", "largest")).select("set_id")
    left = probes.where(~_inside("priors", "largest"))
    standing = sets.join(first, "set_id", "left_anti")
    found = reduce(DataFrame.unionByName, [first, *_found_by_prefix(left, standing)])
    return sets.join(found.distinct(), "set_id").select(*GROUP, "priors")


def mark_superseded(trials: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """Trials with ``superseded`` set on judgments replaced by a wider one.

    ``replaced`` are the ``superseded_sets``, where the caller has them from less than
    the whole rows. Only valid judgments meet them; all other rows pass without a shuffle,
    so ``trials`` is read once for either.
    """
    columns = trials.columns
    replaced = superseded_sets(trials) if replaced is None else replaced
    marks = replaced.withColumnRenamed("priors", "__priors").withColumn("__superseded", F.lit(True))
    is_judged = known(_judged())
    judged = (
        join_on_keys(trials.where(is_judged).withColumn("__priors", _set()), marks, [*GROUP, "__priors"], "left")
        .withColumn("superseded", F.coalesce("__superseded", F.lit(False)))
        .select(*columns)
    )
    others = trials.where(~is_judged).withColumn("superseded", F.lit(False)).select(*columns)
    return others.unionByName(judged)


def with_solver(trials: DataFrame, solve_jobs: DataFrame) -> DataFrame:
    """Solver config name, identity and model on rows that name a solve job."""
    solver = solve_jobs.select(
        F.col("job_name").alias("solve_job_name"),
        F.col("config_name").alias("solver_config_name"),
        F.col("config_identity").alias("solver_config_identity"),
        F.col("model").alias("solver_model"),
    )
    kept = trials.drop("solver_config_name", "solver_config_identity", "solver_model")
    return kept.join(solver, "solve_job_name", "left")
