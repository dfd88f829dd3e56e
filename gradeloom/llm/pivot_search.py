"""Exact search for the largest inner products, with a table of distances to pivots.

Vectors are whole numbers. With one more component, which gives every candidate the length
of the longest (and a query none), the nearest candidate is the one of largest inner
product: d(q, x)^2 = longest^2 + |q|^2 - 2 q.x. The table holds each candidate's distance to
many pivots. As distances obey the triangle inequality, d(q, x) is at least the largest
|d(q, p) - d(x, p)| over the pivots p, which bounds the product from above. A query takes
the candidates in the order of these bounds, computes their products, and stops at the
first bound below the ``k``-th product found: nothing behind it can be among the ``k``.

Candidates lie in shards, queries in blocks; a task answers one block in one shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.shared import stored

SHARD_VECTORS, QUERY_BLOCK = 8192, 1024
#: Pivots, and the vectors among which they are chosen.
PIVOTS, SAMPLE = 32, 2048
#: Queries whose bounds are held at once, and products computed between two looks at the threshold.
TOGETHER, STEP = 64, 512
#: Components beyond this have no place in a sum of 64 bits.
LARGEST = 2**31


def whole_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id, vector``: floor(scale * component), for the rows that take part, each once."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("given")
    ).where(
        F.col("vec_id").isNotNull() & F.col("given").isNotNull() & (F.size("given") > 0)
        & F.forall("given", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * scale < LARGEST))
    )
    return rows.select("vec_id", F.transform("given", lambda v: F.floor(v * scale)).alias("vector")).distinct()


def chosen_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of ``sample``, each the farthest from those chosen before it."""
    picked, gap = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(picked) < min(count, len(sample)) and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """``x`` with the component that gives all rows the squared length ``longest``."""
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squared, 0))


def upper_bounds(to_query: np.ndarray, table: np.ndarray, lengths: np.ndarray, longest: float) -> np.ndarray:
    """What the product of each query (rows) and candidate (columns) is at most.

    ``to_query`` are the queries' distances to the pivots, ``lengths`` their squared
    lengths; ``table`` has a row for each pivot. Distances are held in single precision,
    which the last term covers.
    """
    low = np.zeros((len(to_query), table.shape[1]), dtype=np.float32)
    gap = np.empty_like(low)
    for p, to_pivot in enumerate(table):
        np.subtract(to_query[:, p : p + 1], to_pivot, out=gap)
        np.abs(gap, out=gap)
        np.maximum(low, gap, out=low)
    scale = (longest + lengths[:, None]).astype(np.float32)
    low *= low
    return (scale - low) / 2 + np.float32(4e-6) * (scale + 1)


def product_type(longest: float) -> type:
    """The fastest type in which products up to ``longest`` are exact whole numbers."""
    return np.float32 if longest < 2.0**23 else np.float64 if longest < 2.0**52 else np.int64


def answer(
    query: np.ndarray, own: int, bound: np.ndarray, x: np.ndarray, ids: np.ndarray, first: np.ndarray,
    floor: float, k: int,
) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` best ids and products of one query in a shard, and how many it computed.

    Node n has the ids ``ids[first[n] : first[n + 1]]``. ``floor`` is a product that the
    ``k``-th of all answers is known to reach.
    """
    open_ = np.flatnonzero(bound >= floor)
    order = open_[np.argsort(-bound[open_])]
    vec, score, done = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
    while done < len(order) and bound[order[done]] >= floor:
        nodes = order[done : done + STEP]
        done += len(nodes)
        product = (x[nodes] @ query).astype(np.int64)
        near = product >= floor
        nodes, product = nodes[near], product[near]
        counts = first[nodes + 1] - first[nodes]
        place = np.repeat(first[nodes] - np.append(0, np.cumsum(counts))[:-1], counts) + np.arange(counts.sum())
        other = ids[place] != own
        vec, score = np.append(vec, ids[place][other]), np.append(score, np.repeat(product, counts)[other])
        best = np.lexsort((vec, -score))[:k]
        vec, score = vec[best], score[best]
        if len(score) == k:
            floor = max(floor, score[-1])
    return vec, score, done


def exact_nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, pivots: int = PIVOTS,
    shard_vectors: int = SHARD_VECTORS, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of whole vectors.

    Components become floor(``scale`` * component). Queries are rows whose ``vec_id`` is
    divisible by ``every``; candidates are all rows but the query's own id. Ties go to the
    smaller id; fewer candidates than ``k`` are all returned. Every answer is exact.

    Rows with a null id, a null or empty vector, or a null, non-finite or, once scaled,
    over-large component (2**31) take no part. Rows that repeat an id and its vector count
    once; an id with several vectors answers with the best of them. Vectors of different
    lengths have no product: a query meets those of its own length. Other columns do not
    matter; an empty table gives no rows.

    Equal vectors are one node with its ``k + 1`` smallest ids (no more can be among ``k``
    answers), so copies fill no shard. Pivots are chosen, farthest first, among ``SAMPLE``
    vectors of each length; the products with these also give each query its first
    threshold. Shards are copied once for each query block of their length, as every query
    meets every row.
    """
    rows = stored(whole_vectors(vectors, scale).withColumn("size", F.size("vector")))
    same = Window.partitionBy("vector").orderBy("vec_id")
    nodes = stored(
        rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
        .groupBy("size", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    results = [
        _nearest_of_size(rows, nodes, row["size"], row["nodes"], float(row["longest"]), k, every, pivots, shard_vectors, query_block)
        for row in nodes.groupBy("size").agg(F.count(F.lit(1)).alias("nodes"), F.max(_length()).alias("longest")).collect()
    ]
    answers = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    for found in results:
        answers = answers.unionByName(found)
    best = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _length():
    return F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, v: a + v * v)


def _nearest_of_size(
    rows: DataFrame, nodes: DataFrame, size: int, count: int, longest: float, k: int, every: int,
    pivots: int, shard_vectors: int, query_block: int,
) -> DataFrame:
    """``query_id, vec_id, score``: up to ``k`` answers of each shard."""
    own = nodes.where(F.col("size") == size)
    asked = rows.where((F.col("size") == size) & (F.col("vec_id") % every == 0))
    shards, blocks = -(-count // shard_vectors), max(1, -(-asked.count() // query_block))
    sampled = own.orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).collect()
    sample = np.array([r["vector"] for r in sampled], dtype=np.float64)
    # Each sampled vector counts once for each of its ids.
    sample_ids = np.array([i for r in sampled for i in r["ids"]], dtype=np.int64)
    sample_of = np.repeat(np.arange(len(sampled)), [len(r["ids"]) for r in sampled])
    at = chosen_pivots(lengthened(sample, longest), pivots)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["vector"].to_numpy()).astype("<i8")
        ids = [np.asarray(i, dtype=np.int64) for i in group["ids"]]
        return pd.DataFrame({
            "shard": [int(group["shard"].iloc[0])], "n": [len(x)], "vectors": [x.tobytes()],
            "table": [distances(lengthened(x.astype(np.float64), longest), at).T.astype("<f4").tobytes()],
            "ids": [np.concatenate(ids).astype("<i8").tobytes()],
            "counts": [np.array([len(i) for i in ids], dtype="<i4").tobytes()],
        })

    dealt = own.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    index = stored(dealt.groupBy("shard").applyInPandas(build, "shard int, n int, vectors binary, table binary, ids binary, counts binary"))

    def search(key: tuple, index_part: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index_part) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        part = index_part.iloc[0]
        x = np.frombuffer(part["vectors"], dtype="<i8").reshape(int(part["n"]), -1)
        table = np.frombuffer(part["table"], dtype="<f4").reshape(len(at), -1)
        ids = np.frombuffer(part["ids"], dtype="<i8")
        first = np.append(0, np.cumsum(np.frombuffer(part["counts"], dtype="<i4")))
        given = np.stack(queries["vector"].to_numpy()).astype(np.int64)
        names = queries["query_id"].to_numpy()
        x, whole = x.astype(product_type(longest)), given.astype(product_type(longest))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for low in range(0, len(given), TOGETHER):
            q, own_ids = given[low : low + TOGETHER].astype(np.float64), names[low : low + TOGETHER]
            lengths = (q * q).sum(axis=1)
            to_query = distances(np.column_stack([q, np.zeros(len(q))]), at).astype(np.float32)
            bounds = upper_bounds(to_query, table, lengths, longest)
            known = q @ sample.T
            for n, name in enumerate(own_ids):
                others = known[n][sample_of[sample_ids != name]]
                # The k-th largest; a little less, as these products may be rounded.
                floor = np.partition(others, -k)[-k] - 1e-6 * (longest + 1) if len(others) >= k else -np.inf
                vec, score, _ = answer(whole[low + n], name, bounds[n], x, ids, first, floor, k)
                out.append((np.full(len(vec), name), vec, score))
        query, vec, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"query_id": query, "vec_id": vec, "score": score})

    sent = asked.select(
        F.col("vec_id").alias("query_id"), "vector",
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    served = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return (
        served.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block"))
        .applyInPandas(search, "query_id long, vec_id long, score long")
    )
