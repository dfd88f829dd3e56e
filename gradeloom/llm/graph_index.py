"""Approximate nearest neighbours by largest inner product, on robust-pruned graphs.

Distinct vectors are dealt into shards. In a shard each vector gets one more component, so
that all have the length of the longest and the nearest vector is the one of largest inner
product. A directed graph is grown on them: a greedy beam search from the entry points
proposes neighbours, and pruning keeps the nearest one and drops all that are ``ALPHA``
times closer to it than to the vector itself, again and again, so that edges stay diverse.
Reverse edges are added and pruned in the same way. A query runs a beam search in every
shard; the shards' answers are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.shared import stored

SHARD_VECTORS, QUERY_BLOCK = 8192, 4096
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 64, 160, 1.2
#: Vectors that are searched or inserted together, and nodes that a step expands.
BATCH, EXPAND = 512, 4
#: Pairs of candidates that pruning holds at once.
PAIRS = 4_000_000


def _beam(
    x: np.ndarray, edges: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products of the best ``beam`` nodes for each query, best first.

    All queries advance in step: each expands its best unexpanded nodes, until a beam
    holds none. Missing neighbours are -1; places without a node have product -inf.
    """
    n, q = len(x), len(queries)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), dtype=bool)
    seen[:, n] = True  # the place of missing neighbours
    ids = np.full((q, beam), n, dtype=np.int64)
    score = np.full((q, beam), -np.inf, dtype=np.float32)
    start = entry[:beam]
    ids[:, : len(start)] = start
    score[:, : len(start)] = queries @ x[start].T
    seen[:, start] = True
    order = np.argsort(-score, axis=1, kind="stable")
    ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
    done = ~np.isfinite(score)
    while True:
        active = np.flatnonzero((~done).any(axis=1))
        if not len(active):
            return ids, score
        # The first unexpanded places of each active beam.
        place = np.argsort(done[active], axis=1, kind="stable")[:, :EXPAND]
        fresh = ~np.take_along_axis(done[active], place, 1)
        node = np.where(fresh, np.take_along_axis(ids[active], place, 1), n)
        done[active[:, None], place] = True
        near = np.where(node[:, :, None] < n, edges[np.minimum(node, n - 1)], -1).reshape(len(active), -1)
        near = np.where(near < 0, n, near)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near = np.where(seen[active[:, None], near], n, near)
        seen[active[:, None], near] = True
        found = np.einsum("qkd,qd->qk", x[np.minimum(near, n - 1)], queries[active])
        found[near == n] = -np.inf
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_score = np.concatenate([score[active], found], axis=1)
        all_done = np.concatenate([done[active], ~np.isfinite(found)], axis=1)
        best = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, best, 1)
        score[active] = np.take_along_axis(all_score, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1)
    return ids, score


def _pruned(x: np.ndarray, own: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning for a batch: of the candidates ``near`` (-1: none) up to ``degree``."""
    n = len(x)
    near = np.where((near < 0) | (near >= n) | (near == own[:, None]), -1, near)
    near = np.sort(near, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    points = x[np.maximum(near, 0)]
    sizes = np.einsum("qkd,qkd->qk", points, points)
    distance = sizes + (x[own] ** 2).sum(axis=1)[:, None] - 2 * np.einsum("qkd,qd->qk", points, x[own])
    between = sizes[:, :, None] + sizes[:, None, :] - 2 * np.einsum("qkd,qjd->qkj", points, points)
    left = near >= 0
    out = np.full((len(own), degree), -1, dtype=np.int32)
    rows, taken = np.arange(len(own)), np.zeros(len(own), dtype=int)
    for _ in range(degree):
        if not left.any():
            break
        best = np.where(left, distance, np.inf).argmin(axis=1)
        has = left[rows, best]
        out[has, taken[has]] = near[rows, best][has]
        taken += has
        # Distances are squared, so the relaxation is too.
        covered = ALPHA**2 * between[rows, best] <= distance
        left &= ~(covered & has[:, None])
        left[rows, best] = False
    return out


def built(vectors: np.ndarray, longest: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each vector (-1: none) and the entry points."""
    x = augmented(vectors, longest)
    n = len(x)
    draw = np.random.default_rng(seed)
    degree = min(DEGREE, max(1, n - 1))
    edges = np.full((n, degree), -1, dtype=np.int32)
    # A few random edges to begin with, so that every search gets about.
    edges[:, : max(1, degree // 4)] = draw.integers(0, n, size=(n, max(1, degree // 4)))
    middle = int((x @ x.mean(axis=0)).argmax())
    entry = np.unique(np.concatenate([[middle], draw.choice(n, size=min(n, 31), replace=False)]))
    if n == 1:
        return edges, entry
    order = draw.permutation(n)
    for at in range(0, n, BATCH):
        own = order[at : at + BATCH]
        found, _ = _beam(x, edges, entry, x[own], BUILD_BEAM)
        edges[own] = _pruned(x, own, np.concatenate([found, edges[own]], axis=1), degree)
        _add_callers(x, edges, own)
    return edges, entry


def _add_callers(x: np.ndarray, edges: np.ndarray, own: np.ndarray) -> None:
    """Edges back to ``own`` from the nodes they chose; nodes without room are pruned."""
    degree = edges.shape[1]
    caller, called = np.repeat(own, degree), edges[own].ravel()
    caller, called = caller[called >= 0], called[called >= 0]
    order = np.argsort(called, kind="stable")
    nodes, first, count = np.unique(called[order], return_index=True, return_counts=True)
    more = np.full((len(nodes), int(count.max(initial=0))), -1, dtype=np.int64)
    column = np.arange(len(order)) - np.repeat(first, count)
    more[np.repeat(np.arange(len(nodes)), count), column] = caller[order]
    used = (edges[nodes] >= 0).sum(axis=1)
    room = used + count <= degree
    # Neighbours are kept to the left, so new ones go behind them.
    for k in range(min(degree, more.shape[1])):
        ok = room & (count > k)
        edges[nodes[ok], used[ok] + k] = more[ok, k]
    full = np.flatnonzero(~room)
    full = full[np.argsort(count[full], kind="stable")]
    lo = 0
    while lo < len(full):
        # Pruning compares candidates in pairs: the more of them, the fewer nodes at once.
        width = degree + int(count[full[min(lo + BATCH, len(full)) - 1]])
        part = full[lo : lo + max(1, min(BATCH, PAIRS // width**2))]
        near = np.concatenate([edges[nodes[part]], more[part, : int(count[part].max())]], axis=1)
        edges[nodes[part]] = _pruned(x, nodes[part], near, degree)
        lo += len(part)


def augmented(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.maximum(longest**2 - (vectors**2).sum(axis=1), 0)
    return np.column_stack([vectors, np.sqrt(rest)]).astype(np.float32)


def searched(
    vectors: np.ndarray, edges: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int = SEARCH_BEAM
) -> np.ndarray:
    """Ids of the found nodes for each query (``len(vectors)``: none)."""
    x = vectors.astype(np.float32)
    parts = [
        _beam(x, edges, entry, queries[at : at + BATCH].astype(np.float32), beam)[0]
        for at in range(0, len(queries), BATCH)
    ]
    return np.concatenate(parts)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector``: rows that take part, each once.

    Vectors that are null, zero, or hold null or non-finite components do not, nor do
    those of another length than most (the longer of equally common lengths).
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    ).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        & F.exists("vector", lambda v: v != 0)
    )
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (common["n"] if common else 0)).distinct()


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, shard_vectors: int = SHARD_VECTORS,
    beam: int = SEARCH_BEAM,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` found of largest inner product.

    Queries are rows whose ``vec_id`` is divisible by ``every``; all rows but the query's
    own id are candidates. Ties go to the smaller id. Products are in double precision
    over the given components. Rows that repeat an id and its vector count once; null ids
    take no part. Fewer candidates than ``k`` are all returned. An empty table gives none.

    Equal vectors are one node that knows its ``k + 1`` smallest ids: no more can be among
    ``k`` answers. So copies do not crowd a graph, and a node is bounded. Shards have about
    ``shard_vectors`` nodes however many rows there are; queries meet them in blocks.
    """
    rows = stored(usable(vectors))
    same = Window.partitionBy("vector").orderBy("vec_id")
    nodes = stored(
        rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
        .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    asked = rows.where(F.col("vec_id") % every == 0)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest")).first()
    shards = max(1, -(-size["n"] // shard_vectors))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    longest = size["longest"] or 0.0

    def build(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["vector"].to_numpy())
        edges, entry = built(x, longest)
        ids = [np.asarray(i, dtype=np.int64) for i in group["ids"]]
        return pd.DataFrame({
            "shard": [int(group["shard"].iloc[0])], "n": [len(x)], "vectors": [x.astype("<f8").tobytes()],
            "edges": [edges.astype("<i4").tobytes()], "entry": [entry.astype("<i4").tobytes()],
            "ids": [np.concatenate(ids).astype("<i8").tobytes()],
            "counts": [np.array([len(i) for i in ids], dtype="<i4").tobytes()],
        })

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    index = stored(
        dealt.groupBy("shard").applyInPandas(
            build, "shard int, n int, vectors binary, edges binary, entry binary, ids binary, counts binary"
        )
    )

    def search(key: tuple, index_part: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index_part) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        part = index_part.iloc[0]
        n = int(part["n"])
        x = np.frombuffer(part["vectors"], dtype="<f8").reshape(n, -1)
        edges = np.frombuffer(part["edges"], dtype="<i4").reshape(n, -1)
        entry = np.frombuffer(part["entry"], dtype="<i4").astype(np.int64)
        counts = np.frombuffer(part["counts"], dtype="<i4")
        ids = np.frombuffer(part["ids"], dtype="<i8")
        first = np.concatenate([[0], np.cumsum(counts)])
        q = np.stack(queries["vector"].to_numpy())
        out_q, out_v, out_s = [], [], []
        found = searched(x, edges, entry, q, beam)
        for query_id, vector, hit in zip(queries["query_id"], q, found, strict=True):
            hit = hit[hit < n]
            score = (x[hit] * vector).sum(axis=1)
            vec = np.concatenate([ids[first[h] : first[h + 1]] for h in hit])
            score = np.repeat(score, counts[hit])
            other = vec != query_id
            vec, score = vec[other], score[other]
            best = np.lexsort((vec, -score))[:k]
            out_q.append(np.full(len(best), query_id))
            out_v.append(vec[best])
            out_s.append(score[best])
        return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    everywhere = F.sequence(F.lit(0), F.lit(shards - 1))
    sent = asked.select(
        F.col("vec_id").alias("query_id"), "vector",
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(everywhere).alias("shard"),
    )
    served = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    answers = (
        served.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block"))
        .applyInPandas(search, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
