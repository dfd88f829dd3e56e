"""Mixing sources by temperature, to a target entropy or a limit of repetition.

A source's weight is its share of tokens to the power of an exponent, normalised. The
exponent is bisected: 1 keeps the natural shares, 0 makes all sources alike. A budget of
tokens is then dealt by weight and realised block by block: a source's documents lie in
hashed blocks; every epoch takes the blocks in a keyed permutation of its own, and the last
epoch ends where the source's budget does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.shared import stored, whole_text

MAX_REPEATS = 2.0
BLOCK_TOKENS = 65_536
#: First bits of a block's order that name its range.
RANGE_BITS = 16
#: Sections of the exponent's interval that one job tries at once, and jobs.
SECTIONS, JOBS = 32, 6
#: Sources up to which their table is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def tokens(text: Column) -> Column:
    """Words between white space: the measure of shares and budgets."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def _sections(low: float, high: float) -> list[float]:
    return [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]


def exponent(
    shares: DataFrame, max_repeats: float | None = None, target_entropy: float | None = None,
    budget_share: float | None = None,
) -> float:
    """The exponent for sources with positive ``share``.

    ``target_entropy`` is a part (0 to 1) of the entropy of equal weights: the largest
    exponent that reaches it. ``max_repeats``: the smallest exponent at which no source is
    repeated more often, when ``budget_share`` (budget over all tokens) is dealt, or, if
    that is None, when every source is used at least once. With both, the repetition limit
    holds first. Every try is a sum over all sources in Spark; the driver sees two numbers
    for each exponent.
    """
    n = shares.count()
    if n < 2:
        return 1.0
    p = F.col("share")

    def measured(tries: list[float]) -> list[tuple[float, float]]:
        sums = []
        for i, a in enumerate(tries):
            power = F.pow(p, F.lit(a))
            sums += [
                F.sum(power).alias(f"z{i}"), F.sum(power * F.log(p)).alias(f"l{i}"),
                F.max(F.pow(p, F.lit(a - 1))).alias(f"most{i}"), F.max(F.pow(p, F.lit(1 - a))).alias(f"least{i}"),
            ]
        row = shares.agg(*sums).first()
        out = []
        for i, a in enumerate(tries):
            z = row[f"z{i}"]
            entropy = math.log(z) - a * row[f"l{i}"] / z
            cover = budget_share if budget_share is not None else row[f"least{i}"] * z
            out.append((entropy, cover * row[f"most{i}"] / z))
        return out

    def bisected(holds) -> tuple[float, float]:
        """The last exponent where it holds and the first where it does not, from 0 up."""
        low, high = 0.0, 1.0
        for _ in range(JOBS):
            tries = _sections(low, high)
            good = [holds(*m) for m in measured(tries)]
            if good[-1]:
                return tries[-1], tries[-1]
            if not good[0]:
                return tries[0], tries[0]
            last = max(i for i, g in enumerate(good) if g and all(good[: i + 1]))
            low, high = tries[last], tries[last + 1]
        return low, high

    found = 0.0 if target_entropy is None else bisected(lambda h, _: h >= target_entropy * math.log(n))[0]
    if max_repeats is not None:
        limit = max_repeats * (1 + 1e-9)
        found = max(found, bisected(lambda _, most: most > limit)[1])
    return found


def plan(
    rows: DataFrame, budget: int | None = None, max_repeats: float | None = MAX_REPEATS,
    target_entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 42,
) -> DataFrame:
    """One row per source: weight, budget, epochs, and where its last epoch ends.

    ``rows`` has ``source, tokens, doc_key``.
    """
    totals = stored(rows.groupBy("source").agg(F.sum("tokens").alias("total")).where("total > 0"))
    every = totals.agg(F.sum("total")).first()[0]
    if every is None:
        every = 1
    shares = totals.withColumn("share", F.col("total") / F.lit(every))
    a = exponent(shares, max_repeats, target_entropy, None if budget is None else budget / every)
    power = F.pow("share", F.lit(a))
    sums = shares.agg(F.sum(power), F.max(F.pow("share", F.lit(1 - a)))).first()
    z, least = sums[0] or 1.0, sums[1] or 1.0
    dealt = float(budget) if budget is not None else every * least * z
    weighted = shares.select(
        "source", "total", (power / z).alias("weight"),
        F.greatest(F.lit(1), F.ceil(F.col("total") / block_tokens)).cast("long").alias("blocks"),
    ).withColumn("budget", F.round(F.col("weight") * dealt).cast("long"))
    epochs = weighted.withColumn("full", F.floor(F.col("budget") / F.col("total")).cast("long")).withColumn(
        "rest", F.col("budget") - F.col("full") * F.col("total")
    )
    # The last epoch: whole blocks in their order, then documents of the block where it ends.
    placed = with_sources(rows, epochs).withColumn("block", block_of(F.col("doc_key"), F.col("blocks"))).withColumn(
        "block_order", block_order(F.lit(seed), F.col("source"), F.col("full") + 1, F.col("block"))
    )
    # Orders are hashes, so their first bits are even ranges: at most 2 ** RANGE_BITS a source.
    # Their totals name the one range of a source where the budget ends.
    placed = placed.withColumn("range", F.shiftright("block_order", 64 - RANGE_BITS))
    sizes = stored(placed.groupBy("source", "range", "block_order", "rest").agg(F.sum("tokens").alias("size")))
    ranges = sizes.groupBy("source", "range", "rest").agg(F.sum("size").alias("size"))
    last_range = (
        ranges.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("range")))
        .where("upto > rest").groupBy("source")
        .agg(F.min(F.struct("range", (F.col("upto") - F.col("size")).alias("before"))).alias("at"))
        .select(F.col("source").alias("of"), F.col("at.range").alias("in"), F.col("at.before").alias("before"))
    )
    along = Window.partitionBy("source").orderBy("block_order")
    ends = (
        sizes.join(last_range, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
        .withColumn("upto", F.col("before") + F.sum("size").over(along)).where("upto > rest").groupBy("source")
        .agg(F.min(F.struct("block_order", (F.col("rest") - F.col("upto") + F.col("size")).alias("room"))).alias("at"))
        .select("source", F.col("at.block_order").alias("last_block"), F.col("at.room").alias("room"))
    )
    epochs = _with(epochs, ends)
    inside = (
        with_sources(rows, epochs).withColumn("block", block_of(F.col("doc_key"), F.col("blocks")))
        .where(block_order(F.lit(seed), F.col("source"), F.col("full") + 1, F.col("block")) == F.col("last_block"))
        .groupBy("source", "doc_key", "room").agg(F.sum("tokens").alias("tokens"))
        .withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("doc_key")))
        .where("upto <= room").groupBy("source").agg(F.max("doc_key").alias("last_doc"))
    )
    return _with(epochs, inside)


def _with(sources: DataFrame, more: DataFrame) -> DataFrame:
    side = more.withColumnRenamed("source", "__other")
    return sources.join(side, F.col("source").eqNullSafe(F.col("__other")), "left").drop("__other")


def block_of(doc_key: Column, blocks: Column) -> Column:
    return F.pmod(doc_key, blocks)


def block_order(seed: Column, source: Column, epoch: Column, block: Column) -> Column:
    return F.xxhash64(seed, source, epoch, block)


def with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source; rows of other sources go."""
    side = sources.withColumnRenamed("source", "__source")
    if sources.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    return rows.join(side, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def mixed(
    docs: DataFrame, budget: int | None = None, max_repeats: float | None = MAX_REPEATS,
    target_entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 42,
) -> DataFrame:
    """``docs``, each as often as its source's budget takes it.

    Adds ``tokens``, ``weight`` (of its source), ``epoch`` from 1, ``block``, and
    ``block_order``: within an epoch, blocks of all sources follow that order, and the
    documents of a block follow ``doc_order``. Columns of these names are replaced.
    Without ``budget`` it is the smallest at which every source is used whole at least
    once, so no document is lost. A null source is a source. Documents without words have
    no share of any budget; they are used once if their source is used whole, and go with
    it otherwise. Repeated rows each count, and fall together at a budget's end. An empty
    table gives no rows.

    Texts stay where they are: what a document needs to know is one row per source.
    """
    added = ["tokens", "weight", "epoch", "block", "block_order", "doc_order"]
    # The caller's columns ride in a struct, so that none of them meets a name used here.
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("source").cast("string").alias("source"),
        tokens(whole_text()).alias("tokens"), F.xxhash64(F.lit(seed), "doc_id", whole_text()).alias("doc_order"),
    )
    slim = stored(keyed.select("source", "tokens", F.col("doc_order").alias("doc_key")))
    sources = stored(plan(slim, budget, max_repeats, target_entropy, block_tokens, seed))
    placed = with_sources(keyed, sources).withColumn("block", block_of(F.col("doc_order"), F.col("blocks")))
    order = block_order(F.lit(seed), F.col("source"), F.col("full") + 1, F.col("block"))
    partly = (order < F.col("last_block")) | (
        (order == F.col("last_block")) & (F.col("doc_order") <= F.col("last_doc"))
    )
    copies = (F.col("full") + F.coalesce(partly, F.lit(False)).cast("long")).cast("int")
    used = placed.withColumn("copies", copies).where("copies > 0")
    spread = used.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    kept = [
        F.col("source") if c == "source" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added
    ]
    return spread.withColumn(
        "block_order", block_order(F.lit(seed), F.col("source"), F.col("epoch").cast("long"), F.col("block"))
    ).select(*kept, *added)
