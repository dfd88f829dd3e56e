"""Ranked lexical search over hashed max-sketches.

A term's impact in a document rises with its number there, so the sketch of a document is
the coordinatewise maximum over its terms, each hashed to one of ``COORDINATES``: the
largest number of any term that falls there. Coordinates without a term are left out. A
query looks its terms' coordinates up in a batch of documents at once; the weighted sum of
the impacts found is an upper bound of the score, as another term of the document can only
raise a coordinate.

Documents are rescored exactly, by their texts, in descending order of bounds: first the
``k`` best bounds of each query. The last of these ``k`` scores is a threshold that the
result reaches at least, so every document whose bound is not below it is rescored next;
all others are out. No document is left out by a number of candidates.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.shared import stored, whole_text

#: A term that a document lacks meets one of its n coordinates with a chance of n in 2 ** 20.
COORDINATES = 1 << 20
#: The largest number of a term that a sketch holds; the bound of any larger one is LIMIT.
LARGEST, LIMIT = 65_535, 1_000_000
#: Queries, and their different terms, that a pass over the sketches takes along.
QUERIES, QUERY_TERMS = 1024, 200_000
#: Documents whose bounds are held at once, and different terms that a task counts at once.
BATCH, COUNTED = 512, 500_000

#: What each byte of a text becomes: A-Z lower-cased, and a space for all that ends a term.
_TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and other characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


class _Coordinates(dict):
    """The coordinate of each term; what is kept of them is bounded."""

    def __init__(self, size: int) -> None:
        self.size = size

    def __missing__(self, term: bytes) -> int:
        if len(self) > COUNTED:
            self.clear()
        found = self[term] = xxhash.xxh64_intdigest(term) % self.size
        return found


def sketch(counts: dict[bytes, int], coordinate: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates in use, rising, and the largest number of any term in each."""
    at = np.fromiter(map(coordinate.__getitem__, counts), dtype=np.int64, count=len(counts))
    n = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    order = np.lexsort((n, at))
    at, n = at[order], n[order]
    last = np.append(at[1:] != at[:-1], True)[: len(at)]
    return at[last].astype("<u4"), np.minimum(n[last], LARGEST).astype("<u2")


_INDEX = "doc_id long, n long, coordinates binary, numbers binary, term string, df long"


def indexed(docs: DataFrame, coordinates: int = COORDINATES) -> DataFrame:
    """The index: a sketch for each document, and for each term counts of documents by task.

    Rows with ``n`` are documents (``n`` terms; those without terms have no row), rows with
    ``term`` are counts, to be summed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinate, held = _Coordinates(coordinates), Counter()

        def counted() -> Iterator[pa.RecordBatch]:
            found = list(held.items())
            for low in range(0, len(found), 50_000):
                part = found[low : low + 50_000]
                none = [None] * len(part)
                names, n = zip(*part, strict=True)
                yield of([none, none, none, none, [t.decode("utf-8", "surrogatepass") for t in names], n])
            held.clear()

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if counts := Counter(terms(text)):
                    at, n = sketch(counts, coordinate)
                    rows.append((doc_id, counts.total(), at.tobytes(), n.tobytes()))
                    held.update(counts.keys())
            if rows:
                none = [None] * len(rows)
                yield of([*zip(*rows, strict=True), none, none])
            if len(held) > COUNTED:
                yield from counted()
        yield from counted()

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in _INDEX.split(", "))])

    def of(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return stored(rows.mapInArrow(run, _INDEX))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def length_part(n: int, documents: int, total: int) -> int:
    """The part of an impact that a document's length decides (``total`` terms of all)."""
    return 100 - 90 + (90 * n * documents) // total


def impact(number: int, part: int) -> int:
    return (1_000_000_000 * number) // (1000 * number + 8 * part)


def weighted_terms(index: DataFrame, items: DataFrame, documents: int) -> DataFrame:
    """``item_id, term, weight``: each item's terms that any document has, once each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names = [t.decode("utf-8", "surrogatepass") for t in dict.fromkeys(terms(text))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(names), type=pa.int64()), pa.array(names, type=pa.string())], names=["item_id", "term"]
                )

    asked = items.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text")).where("item_id IS NOT NULL")
    asked = asked.mapInArrow(cut, "item_id long, term string").distinct()
    known = index.where("term IS NOT NULL").join(asked.select("term").distinct(), "term", "left_semi")
    counts = known.groupBy("term").agg(F.sum("df").alias("df"))
    ratio = F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)
    return asked.join(counts, "term").select("item_id", "term", F.floor(1000 * F.log(ratio)).cast("long").alias("weight"))


class _Queries:
    """A bounded number of queries as arrays."""

    def __init__(self, rows: list[tuple[int, str, int]], coordinates: int = COORDINATES) -> None:
        self.ids = sorted({item for item, _, _ in rows})
        place = {item: k for k, item in enumerate(self.ids)}
        coordinate = _Coordinates(coordinates)
        own = sorted((coordinate[t.encode("utf-8", "surrogatepass")], place[i], w) for i, t, w in rows)
        at = np.array([c for c, _, _ in own], dtype=np.int64)
        self.query = np.array([q for _, q, _ in own], dtype=np.int64)
        self.weight = np.array([w for _, _, w in own], dtype=np.float64)
        #: The coordinates asked for, rising; the rows of the n-th are first[n] to first[n + 1].
        self.at, first = np.unique(at, return_index=True)
        self.first = np.append(first, len(at))

    def bounds(self, sketches: list[tuple[np.ndarray, np.ndarray]], parts: np.ndarray) -> np.ndarray:
        """An upper bound of each query's score in each document."""
        sizes = np.array([len(at) for at, _ in sketches])
        at = np.concatenate([a for a, _ in sketches]).astype(np.int64)
        n = np.concatenate([m for _, m in sketches]).astype(np.int64)
        row = np.repeat(np.arange(len(sketches)), sizes)
        place = np.minimum(np.searchsorted(self.at, at), len(self.at) - 1)
        used = np.flatnonzero(self.at[place] == at)
        at, n, row = place[used], n[used], row[used]
        asked = self.first[at + 1] - self.first[at]
        value = (1_000_000_000 * n) // (1000 * n + 8 * parts[row])
        value = np.where(n == LARGEST, LIMIT, value)
        # One entry for each coordinate of a document and each query that asks for it.
        entry = np.repeat(self.first[at] - np.append(0, np.cumsum(asked)[:-1]), asked) + np.arange(asked.sum())
        cell = np.repeat(row * len(self.ids), asked) + self.query[entry]
        found = np.bincount(cell, weights=np.repeat(value, asked) * self.weight[entry], minlength=len(sketches) * len(self.ids))
        # Sums of whole numbers are exact up to 2 ** 53; a little more covers larger ones.
        return (found * (1 + 2.0**-40)).reshape(len(sketches), -1)


def _scan(index: DataFrame, queries: _Queries, documents: int, total: int, keep) -> DataFrame:
    """``item_id, doc_id, bound`` of what ``keep`` chooses from the bounds of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        ids = np.array(queries.ids, dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH):
                part = batch.slice(low, BATCH)
                doc = part.column(0).to_numpy()
                size = np.array([length_part(n, documents, total) for n in part.column(1).to_pylist()], dtype=np.int64)
                sketches = [
                    (np.frombuffer(a, dtype="<u4"), np.frombuffer(n, dtype="<u2"))
                    for a, n in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
                ]
                yield from told(keep(state, doc, queries.bounds(sketches, size)), ids)
        yield from told(keep(state, None, None), ids)

    def told(chosen: tuple | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if chosen is not None and len(chosen[0]):
            query, doc, bound = chosen
            yield pa.RecordBatch.from_pydict({"item_id": ids[query], "doc_id": doc, "bound": bound})

    rows = index.where("n IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "n", "coordinates", "numbers")
    return rows.mapInArrow(run, "item_id long, doc_id long, bound double")


def _highest(k: int):
    """Keeps, for each query, a task's ``k`` highest bounds (ties: smaller ids)."""

    def keep(state: dict, doc: np.ndarray | None, bounds: np.ndarray | None) -> tuple | None:
        if doc is None:
            if not state:
                return None
            query = np.repeat(np.arange(state["bound"].shape[0]), state["bound"].shape[1])
            own_doc, bound = state["doc"].ravel(), state["bound"].ravel()
            real = bound > 0
            return query[real], own_doc[real], bound[real]
        order = np.argsort(doc, kind="stable")
        own = np.broadcast_to(doc[order], (bounds.shape[1], len(doc)))
        found = bounds[order].T
        if state:
            own, found = np.concatenate([state["doc"], own], axis=1), np.concatenate([state["bound"], found], axis=1)
            # Equal bounds: the smaller id first, as later batches may hold smaller ids.
            by_id = np.argsort(own, axis=1, kind="stable")
            own, found = np.take_along_axis(own, by_id, 1), np.take_along_axis(found, by_id, 1)
        best = np.argsort(-found, axis=1, kind="stable")[:, :k]
        state["doc"], state["bound"] = np.take_along_axis(own, best, 1), np.take_along_axis(found, best, 1)
        return None

    return keep


def _reaching(threshold: np.ndarray, last: np.ndarray):
    """Keeps all whose bound is over the threshold, or at it with an id up to the last one's."""

    def keep(state: dict, doc: np.ndarray | None, bounds: np.ndarray | None) -> tuple | None:
        if doc is None:
            return None
        over = (bounds > threshold) | ((bounds >= threshold) & (doc[:, None] <= last))
        row, query = np.nonzero(over & (bounds > 0))
        return query, doc[row], bounds[row, query]

    return keep


def _rescored(docs: DataFrame, chosen: DataFrame, asked: dict[int, dict[bytes, int]], documents: int, total: int) -> DataFrame:
    """``item_id, doc_id, score``: exact, from the whole texts of the chosen documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, items in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                counts = Counter(terms(text))
                part = length_part(counts.total(), documents, total) if counts else 1
                impacts: dict[bytes, int] = {}
                for item in set(items):
                    score = 0
                    for term, w in asked[item].items():
                        if term in counts:
                            if term not in impacts:
                                impacts[term] = impact(counts[term], part)
                            score += w * impacts[term]
                    if score > 0:
                        out.append((item, doc_id, score))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], names=["item_id", "doc_id", "score"]
                )

    wanted = chosen.groupBy("doc_id").agg(F.collect_set("item_id").alias("items"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.join(wanted, "doc_id").mapInArrow(run, "item_id long, doc_id long, score long")


def _blocks(weighted: DataFrame, terms_at_once: int) -> Iterator[list[tuple[int, str, int]]]:
    """The queries' terms in runs of bounded size, each query whole."""
    block: list[tuple[int, str, int]] = []
    items = 0
    for row in weighted.orderBy("item_id").toLocalIterator():
        new = not block or block[-1][0] != row["item_id"]
        if new and (items >= QUERIES or len(block) >= terms_at_once):
            yield block
            block, items = [], 0
        items += new
        block.append((row["item_id"], row["term"], row["weight"]))
    if block:
        yield block


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 10, coordinates: int = COORDINATES, terms_at_once: int = QUERY_TERMS
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item.

    Scores are whole numbers as ``weight``, ``length_part`` and ``impact`` give them, summed
    over an item's different terms. Documents with score 0 are left out; equal scores go by
    ascending ``doc_id``; fewer documents than ``k`` are all returned.

    A null or empty text has no terms: such a document counts nowhere, such an item has no
    rows. Documents with a null ``doc_id`` count for the weights and lengths, but cannot be
    named and are not ranked; items with a null id are left out. Rows that repeat a
    ``doc_id`` are documents of their own for weights and lengths, of which the best one is
    ranked; rows that repeat an ``item_id`` are one item of all their terms. Very long texts
    are whole. Other columns do not matter; an empty table gives no rows.

    Queries go over the sketches in blocks of at most ``QUERIES`` (about
    ``terms_at_once`` terms); only such a block, its ``k`` best bounds and its thresholds meet the driver.
    """
    spark = docs.sparkSession
    index = indexed(docs, coordinates)
    size = index.agg(F.count("n").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    documents, total = size["documents"], size["total"]
    empty = spark.createDataFrame([], "item_id long, doc_id long, score long")
    scores = empty
    for block in _blocks(stored(weighted_terms(index, items, documents)), terms_at_once):
        scores = scores.unionByName(_searched(docs, index, _Queries(block, coordinates), block, documents, total, k))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    one = scores.groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searched(
    docs: DataFrame, index: DataFrame, queries: _Queries, block: list[tuple[int, str, int]],
    documents: int, total: int, k: int,
) -> DataFrame:
    """Exact scores of all documents that can be among the ``k`` best of a block's queries."""
    asked: dict[int, dict[bytes, int]] = {}
    for item, term, w in block:
        asked.setdefault(item, {})[term.encode("utf-8", "surrogatepass")] = w
    by_bound = Window.partitionBy("item_id").orderBy(F.desc("bound"), "doc_id")
    tops = _scan(index, queries, documents, total, _highest(k))
    first = stored(tops.withColumn("at", F.row_number().over(by_bound)).where(F.col("at") <= k))
    scored = stored(_rescored(docs, first, asked, documents, total))
    by_score = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    one = scored.groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
    kth = one.withColumn("at", F.row_number().over(by_score)).where(F.col("at") == k).collect()
    place = {item: n for n, item in enumerate(queries.ids)}
    # Without k scores anything over zero is still in.
    threshold = np.zeros(len(queries.ids))
    last = np.full(len(queries.ids), np.iinfo(np.int64).max)
    for row in kth:
        threshold[place[row["item_id"]]], last[place[row["item_id"]]] = row["score"], row["doc_id"]
    rest = _scan(index, queries, documents, total, _reaching(threshold, last))
    rest = stored(rest.join(first.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti"))
    return stored(scored.unionByName(_rescored(docs, rest, asked, documents, total)))
