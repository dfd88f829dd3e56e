"""Groups of documents whose five-word shingles are alike to 0.8 or more, by SimHash.

At a likeness of 0.8 two 64-bit fingerprints differ in about ten bits, out of reach of an
index of exact distances. So the fingerprint is widened to ``BITS`` bits and cut into
segments of ``SEGMENT`` bits; near documents agree, or differ in one bit, in some segment.
The index holds each segment as it is, and once without each of its ``WEAK`` weakest bits
(those whose majority was narrowest, where near documents differ first). Equal keys are
joined. A candidate pair whose bits are not far apart is verified by the distinct shingles
themselves.

Members of a key meet only its leaders, so rows grow with members and not with pairs. That
links most copies, and not all. An exact check follows: two texts alike to the threshold
share a shingle among the first of each, in any order of all shingles that is the same for
both. Those prefixes are dealt by shingle, rare ones first, and every pair of unlinked parts
that meets there and is not ruled out by its sizes and places is verified. Where more than
``HOT`` members share a shingle, no pairs are listed: the parts that meet are a family, whose
members are compared chunk by chunk, in arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.shared import connected, stored, whole_text
from gradeloom.llm.simhash import bit_counts, shingle_hashes

WIDTH, SIMILARITY = 5, 0.8
SEGMENTS, SEGMENT, WEAK = 16, 24, 10
BITS = SEGMENTS * SEGMENT
#: Bits of another part of the fingerprint that ride along in the index, and how many of
#: these 64 may differ before a pair is no candidate.
RIDER_BITS, RIDER_LIMIT = 64, 19
#: Members of one key that are read at a time.
CHUNK = 4096
#: Texts whose common shingles are counted together, and how many of the most frequent
#: shingles are told to all tasks. Both set the order of shingles only, and so the work.
COUNTED, KNOWN = 1000, 1 << 20
#: Members of one shingle that are compared as listed pairs.
HOT = 512
#: About so many members, and bytes of their shingles, are one chunk of a family; shingles
#: counted at once.
MEMBERS, SET_BYTES, COLUMNS_AT_ONCE = 512, 8_000_000, 4096


def differing_share(similarity: float) -> float:
    """Expected share of differing bits for equally long texts of a Jaccard likeness."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def wide_print(text: str, width: int = WIDTH) -> tuple[bytes, bytes]:
    """The fingerprint of the distinct shingles, and for each segment the places of its weakest bits."""
    return _print_of(np.unique(shingle_hashes(text, width)))


def _print_of(hashes: np.ndarray) -> tuple[bytes, bytes]:
    if not len(hashes):
        return bytes(BITS // 8), bytes(np.tile(np.arange(WEAK, dtype=np.uint8), SEGMENTS))
    steps = (np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).tolist()
    counts = np.concatenate([bit_counts(_mixed(hashes + np.uint64(s))) for s in steps])
    margin = (2 * counts - len(hashes)).reshape(SEGMENTS, SEGMENT)
    weak = np.argsort(np.abs(margin), axis=1, kind="stable")[:, :WEAK]
    return np.packbits(margin.ravel() > 0, bitorder="little").tobytes(), weak.astype(np.uint8).tobytes()


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - 2**63


def prints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, text_key, node, print, weak`` for every row; equal sets of shingles are a node.

    ``common``, in one row of up to ``COUNTED``: shingles that several of their sets hold, and
    in how many.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, COUNTED):
                batch = rows.slice(at, COUNTED)
                sets = [np.unique(shingle_hashes(t, width)) for t in batch.column(2).to_pylist()]
                made = [_print_of(s) for s in sets]
                nodes = [_node(s) for s in sets]
                held, n = np.unique(np.concatenate(list(dict(zip(nodes, sets, strict=True)).values())), return_counts=True)
                common = np.column_stack([held[n > 1].view(np.int64), n[n > 1]]).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()),
                     pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary()),
                     pa.array([common] + [None] * (len(sets) - 1), pa.binary())],
                    names=["doc_id", "text_key", "node", "print", "weak", "common"],
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_key"),
        whole_text().alias("text"),
    )
    return rows.mapInArrow(compute, "doc_id long, text_key long, node long, print binary, weak binary, common binary")


def index(nodes: DataFrame, whole: bool) -> DataFrame:
    """``key, node, part, rider``: a row for each whole segment, or for each left-out bit."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = np.arange(SEGMENTS, dtype=np.int64)[None, :, None]
        for rows in batches:
            for at in range(0, rows.num_rows, 1000):
                batch = rows.slice(at, 1000)
                n = batch.num_rows
                octets = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(n, -1)
                weak = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(n, SEGMENTS, WEAK)
                bits = np.unpackbits(octets, axis=1, bitorder="little").reshape(n, SEGMENTS, SEGMENT)
                value = (bits.astype(np.int64) << np.arange(SEGMENT)).sum(axis=2)[:, :, None]
                place = weak.astype(np.int64)
                open_keys = (value & ~(1 << place)) | (which << 32) | ((place + 1) << 24)
                keys = value | (which << 32) if whole else open_keys
                # The rider comes from segments behind the key's own.
                words = octets.view("<u8").view(np.int64)
                own = which[0, :, 0] * SEGMENT // 64
                rider = words[:, (own + 2) % words.shape[1]]
                per = keys.shape[2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), SEGMENTS * per)),
                     pa.array(np.repeat(batch.column(3).to_numpy(), SEGMENTS * per)),
                     pa.array(np.repeat(rider.ravel(), per))],
                    names=["key", "node", "part", "rider"],
                )

    return nodes.select("node", "print", "weak", "part").mapInArrow(
        explode, "key long, node long, part long, rider long"
    )


def candidates(rows: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of nodes that share a key and whose riders are near.

    Members of a key are read in chunks. Each joins the first leader that is near it, or
    becomes a leader; so a key gives fewer pairs than it has members, and only its leaders
    are held. Nodes of one ``part`` are linked already and give no pair.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nobody = np.empty((0, 3), dtype=np.int64)
        rest = np.empty((0, 4), dtype=np.int64)
        leaders, of_key = nobody, None

        def near(rider, riders):
            return np.bitwise_count((riders ^ rider).view(np.uint64)) <= RIDER_LIMIT

        def run(members: np.ndarray, leaders: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
            """Links of one key's ``(node, part, rider)`` rows, and its leaders after them."""
            out, left = [], members

            def follow(leader: np.ndarray) -> None:
                nonlocal left
                hit = near(leader[2], left[:, 2])
                if hit.any():
                    new = left[hit & (left[:, 1] != leader[1]), 0]
                    out.append(np.column_stack([np.full(len(new), leader[0]), new]))
                    left = left[~hit]

            for leader in leaders:
                follow(leader)
                if not len(left):
                    return out, leaders
            fresh = []
            while len(left):
                leader, left = left[0], left[1:]
                fresh.append(leader)
                follow(leader)
            return out, np.concatenate([leaders, np.array(fresh)])

        for batch in batches:
            block = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            block = np.concatenate([rest, block])
            keys = block[:, 0]
            start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.append(start, len(keys)))
            found: list[np.ndarray] = []
            last = len(start) - 1
            two = start[:last][size[:last] == 2]
            ok = near(block[two, 3], block[two + 1, 3]) & (block[two, 2] != block[two + 1, 2])
            found.append(np.column_stack([block[two, 1][ok], block[two + 1, 1][ok]]))
            if of_key is not None and keys[0] != of_key:
                leaders, of_key = nobody, None
            for i in range(len(start)):
                carried = i == 0 and of_key is not None
                if i < last and size[i] == 2 and not carried:
                    continue
                if i < last and size[i] == 1 and not carried:
                    continue
                if i == last and size[i] < CHUNK and not carried:
                    break
                known = leaders if carried else nobody
                out, known = run(block[start[i] : start[i] + size[i], 1:], known)
                found += out
                if i == last:
                    leaders, of_key = known, keys[start[i]]
                else:
                    leaders, of_key = nobody, None
            rest = block[start[last] :] if of_key is None else block[:0]
            yield from emit(found)
        if len(rest):
            yield from emit(run(rest[:, 1:], nobody)[0])

    def emit(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs = np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)
        pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    dealt = rows.repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(scan, "a long, b long").distinct()


def _shingles(rows: DataFrame, width: int) -> DataFrame:
    """``node, shingles``: the sorted distinct 32-bit shingle hashes of a text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width).astype(np.uint32)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return rows.mapInArrow(compute, "node long, shingles binary")


def near(nodes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose bits are not too far apart for ``similarity``; they rule out what is far."""
    middle = differing_share(similarity)
    slack = 2 * math.sqrt(middle * (1 - middle) / BITS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
                for i in (2, 3)
            )
            share = np.bitwise_count(a ^ b).sum(axis=1) / BITS
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], names=["a", "b", "share"])

    one = nodes.select(F.col("node").alias("a"), F.col("print").alias("print_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("print").alias("print_b"))
    return (
        pairs.join(one, "a").join(two, "b").select("a", "b", "print_a", "print_b")
        .mapInArrow(measure, "a long, b long, share double").where(F.col("share") <= middle + 2 * slack).select("a", "b")
    )


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted (doc_id, text_key, ...)`` with their ``text``; a repeated document repeats its row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("__id"), F.xxhash64(whole_text()).alias("__key"), whole_text().alias("text")
    )
    return rows.join(
        wanted, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__key") == F.col("text_key"))
    ).drop("__id", "__key", "doc_id", "text_key")


def _sets_of(docs: DataFrame, nodes: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """``node, shingles`` of the nodes in ``asked (node)``, each from one text."""
    wanted = nodes.join(asked, "node").select("node", "doc_id", "text_key")
    return _shingles(_texts_of(docs, wanted).select("node", "text"), width).dropDuplicates(["node"])


def frequent(made: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The up to ``KNOWN`` most frequent shingles of ``made (common)``, sorted, and how often they were seen."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                both = np.frombuffer(cell, dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, i].copy()) for i in (0, 1)], names=["shingle", "n"])

    rows = made.where("common is not null").select("common").mapInArrow(listed, "shingle long, n long")
    seen = stored(rows.groupBy("shingle").agg(F.sum("n").alias("n")).withColumn("power", F.floor(F.log2("n"))))
    least, total = 64, 0
    for power, n in sorted(seen.groupBy("power").count().collect(), reverse=True):
        total += n
        if total > KNOWN:
            break
        least = power
    told = seen.where(F.col("power") >= least).select("shingle", "n").toArrow()
    shingle, n = (told.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(shingle)
    return shingle[order], n[order].astype(np.int32)


def prefixes(texts: DataFrame, known: tuple[np.ndarray, np.ndarray], width: int, similarity: float) -> DataFrame:
    """``key, node, part, size, place``: the first shingles of each of ``texts (node, part, text)``.

    Shingles are ordered by how often ``known`` saw them, then by their hash. A text of
    ``size`` shingles shares at least ``similarity`` times as many with whatever is alike, so
    one of those is among all but the last of so many.
    """
    told = texts.sparkSession.sparkContext.broadcast(known)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = told.value
        for rows in batches:
            for at in range(0, rows.num_rows, COUNTED):
                batch = rows.slice(at, COUNTED)
                sets = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in batch.column(2).to_pylist()]
                size = np.array([len(s) for s in sets], dtype=np.int64)
                every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
                often = np.zeros(len(every), dtype=np.int32)
                if len(shingle):
                    found = np.minimum(np.searchsorted(shingle, every), len(shingle) - 1)
                    often = np.where(shingle[found] == every, seen[found], 0)
                order = np.lexsort((every, often, owner))
                place = np.arange(len(every)) - np.repeat(np.cumsum(size) - size, size)
                # A little less than the bound, so that no rounding leaves a shingle out.
                first = place <= (size - np.ceil(similarity * size - 1e-6))[owner]
                whose = owner[first]
                columns = [every[order][first], batch.column(0).to_numpy()[whose], batch.column(1).to_numpy()[whose],
                           size[whose].astype(np.int32), place[first].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "part", "size", "place"])

    return texts.select("node", "part", "text").mapInArrow(compute, "key long, node long, part long, size int, place int")


def sharing(rows: DataFrame, similarity: float) -> DataFrame:
    """``a, b, hot``: nodes of different parts that share one of their ``prefixes``.

    Every pair that can be alike: at the first shingle that two texts share, what follows in
    both is long enough for all that they must share. Where more than ``HOT`` members hold
    a shingle, rows ``hot`` chain their parts instead.
    """

    def pairs_of(group: np.ndarray) -> list[np.ndarray]:
        a, b = (group[i] for i in np.triu_indices(len(group), 1))
        return possible(a, b)

    def possible(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        both = similarity / (1 + similarity) * (a[:, 3] + b[:, 3]) - 1e-6
        ok = (a[:, 2] != b[:, 2]) & (np.minimum(a[:, 3] - a[:, 4], b[:, 3] - b[:, 4]) >= both)
        ok &= np.minimum(a[:, 3], b[:, 3]) >= similarity * np.maximum(a[:, 3], b[:, 3]) - 1e-6
        return [np.column_stack([a[ok, 1], b[ok, 1]])]

    def chain(group: np.ndarray) -> list[np.ndarray]:
        at = np.flatnonzero(group[1:, 2] != group[:-1, 2])
        return [np.column_stack([group[at, 1], group[at + 1, 1]])]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, hot_key = np.empty((0, 5), dtype=np.int64), None
        for batch in batches:
            block = np.concatenate([rest, np.column_stack([c.to_numpy() for c in batch.columns])])
            start = np.flatnonzero(np.concatenate(([True], block[1:, 0] != block[:-1, 0])))
            end = np.append(start[1:], len(block))
            # Members lie in order of their parts. The last key may go on.
            open_key = (block[start, 2] != block[end - 1, 2]) & (end < len(block))
            two = start[open_key & (end - start == 2)]
            pairs, chains = possible(block[two], block[two + 1]), []
            for low, high in zip(start[open_key].tolist(), end[open_key].tolist(), strict=True):
                if high - low > HOT or block[low, 0] == hot_key:
                    chains += chain(block[low:high])
                elif high - low > 2:
                    pairs += pairs_of(block[low:high])
            rest = block[start[-1] :]
            if len(rest) > HOT or rest[0, 0] == hot_key:
                chains += chain(rest)
                rest, hot_key = rest[-1:], rest[0, 0]
            yield from emit(pairs, chains)
        if len(rest) and rest[0, 0] != hot_key:
            yield from emit(pairs_of(rest), [])

    def emit(pairs: list[np.ndarray], chains: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for found, hot in ((pairs, False), (chains, True)):
            rows = np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else ()
            if len(rows):
                ends = [pa.array(rows[:, i].copy()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ends, pa.array(np.full(len(rows), hot))], names=["a", "b", "hot"])

    dealt = rows.repartition("key").sortWithinPartitions("key", "part", "node")
    return dealt.mapInArrow(scan, "a long, b long, hot boolean").distinct()


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs that are alike by their distinct shingles."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stored(_sets_of(docs, nodes, asked, width))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(both >= similarity * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right``."""
    values = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, column = np.unique(values, return_inverse=True)
    ours = row < len(left)
    n = int(column.max()) + 1 if len(column) else 0
    shared = (np.bincount(column[ours], minlength=n) > 0) & (np.bincount(column[~ours], minlength=n) > 0)
    place = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    for start in range(0, int(shared.sum()), COLUMNS_AT_ONCE):
        low, high = np.searchsorted(column, [start, start + COLUMNS_AT_ONCE])
        held = np.zeros((len(left) + len(right), COLUMNS_AT_ONCE), dtype=np.float32)
        held[row[low:high], column[low:high] - start] = 1
        total += (held[: len(left)] @ held[len(left) :].T).astype(np.int64)
    return total


def forest(left: list[tuple], right: list[tuple], similarity: float) -> list[tuple[int, int]]:
    """Links of ``(node, part, shingles)`` members alike to ``similarity`` that join their parts."""
    sets = [[np.frombuffer(m[2], dtype=np.uint32) for m in side] for side in (left, right)]
    size = [np.array([len(s) for s in side]) for side in sets]
    both = overlaps(*sets)
    parts, which = np.unique([m[1] for m in (*left, *right)], return_inverse=True)
    one, two = which[: len(left)], which[len(left) :]
    alike = both >= similarity * (size[0][:, None] + size[1][None, :] - both)
    a, b = np.nonzero(alike & (one[:, None] != two[None, :]))
    # One pair for two parts is enough.
    _, first = np.unique(np.sort(np.column_stack([one[a], two[b]]), axis=1), axis=0, return_index=True)
    above = np.arange(len(parts)).tolist()

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    links = []
    for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True):
        x, y = top(int(one[i])), top(int(two[j]))
        if x != y:
            above[x] = y
            links.append((left[i][0], right[j][0]))
    return links


def within_families(
    docs: DataFrame, nodes: DataFrame, parts: DataFrame, pairs: DataFrame, width: int, similarity: float
) -> DataFrame:
    """Links ``(a, b)`` between parts of a family whose pairs were not listed.

    A part of ``parts (node, part)`` is verified already. A family is a component of parts
    that ``pairs`` (members of a shingle held by many) join. In a family every two members of different
    parts are compared: members lie in chunks of about ``MEMBERS`` and ``SET_BYTES``, each
    two chunks of a family are one row, whole shingle sets are compared in arrays, and only
    a forest of links comes out. A part that fills chunks has its own, which are not
    compared among themselves, so a large group that is linked already costs one pass.
    """
    one, two = (parts.select(F.col("node").alias(x), F.col("part").alias(f"part_{x}")) for x in "ab")
    met = pairs.join(one, "a").join(two, "b").where("part_a != part_b")
    families = connected(met.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")))
    asked = stored(parts.join(families.select(F.col("node").alias("part"), F.col("root").alias("family")), "part"))
    held = stored(asked.join(_sets_of(docs, nodes, asked.select("node"), width), "node"))
    weight = held.groupBy("family", "part").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.length("shingles")).alias("octets")
    ).withColumn("chunks", F.greatest(F.col("size") / MEMBERS, F.col("octets") / SET_BYTES))
    lane_of = weight.select("family", "part", "chunks", F.when(F.col("chunks") >= 1, F.col("part")).alias("lane"))
    lanes = lane_of.groupBy("family", "lane").agg(F.ceil(F.sum("chunks")).cast("long").alias("chunks"))
    placed = (
        held.join(lane_of.select("family", "part", "lane"), ["family", "part"])
        .join(lanes.withColumnsRenamed({"family": "f", "lane": "l"}), (F.col("family") == F.col("f")) & F.col("lane").eqNullSafe(F.col("l")))
        .withColumn("chunk", F.xxhash64(F.col("lane"), F.pmod(F.xxhash64("node"), F.col("chunks"))))
    )
    chunks = stored(
        placed.groupBy("family", "lane", "chunk").agg(F.collect_list(F.struct("node", "part", "shingles")).alias("held"))
    )
    heads = chunks.select("family", "lane", "chunk")
    one, two = (heads.select("family", F.col("lane").alias(f"lane_{x}"), F.col("chunk").alias(x)) for x in "ab")
    meeting = one.join(two, "family").where("a <= b and (lane_a is null or lane_b is null or lane_a != lane_b)")
    left, right = (chunks.select("family", F.col("chunk").alias(x), F.col("held").alias(f"held_{x}")) for x in "ab")
    rows = meeting.select("family", "a", "b").join(left, ["family", "a"]).join(right, ["family", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: set[tuple[int, int]] = set()
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                sides = [[tuple(m.values()) for m in side.as_py()] for side in (x, y)]
                part_of = {m[0]: m[1] for side in sides for m in side}
                links |= {(part_of[a], part_of[b]) for a, b in forest(*sides, similarity)}
            ends = [pa.array([link[i] for link in links], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    return rows.select("held_a", "held_b").mapInArrow(compare, "a long, b long")


def _parts(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """``node, part``: the component of each node, or itself."""
    joined = connected(linked).withColumnRenamed("root", "part")
    return nodes.select("node").join(joined, "node", "left").withColumn("part", F.coalesce("part", "node"))


def one_of_each(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, in all columns, that stand for their group of near documents.

    Groups are the components of pairs alike to ``similarity`` or more; the row of the
    smallest ``doc_id`` stays (nulls rank last, then by a hash of the text). Documents with
    equal words are always one group, so of all documents without words one stays. Null
    texts are empty. Repeated rows are a group; an empty table gives no rows. No pair is left
    out: what the segments do not show, the shared prefixes do.
    """
    made = stored(prints(docs, width))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key"))
    nodes = stored(
        made.groupBy("node").agg(F.min(rank).alias("first"), F.min("print").alias("print"), F.min("weak").alias("weak")).select(
            "node", "print", "weak",
            F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"),
        )
    )
    # Whole segments come first, so that a large group of copies is linked before its members
    # meet again under their other keys.
    whole = stored(near(nodes, candidates(index(nodes.withColumn("part", F.col("node")), whole=True)), similarity))
    linked = stored(verified(docs, nodes, whole, width, similarity))
    parts = connected(linked)
    placed = stored(nodes.join(parts, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root"))
    more = stored(
        near(nodes, candidates(index(placed, whole=True).unionByName(index(placed, whole=False))), similarity)
    )
    linked = stored(linked.unionByName(verified(docs, nodes, more, width, similarity)))
    # What no segment showed, or met only its leader, meets by the shingles themselves.
    parts = stored(_parts(nodes, linked))
    texts = _texts_of(docs, nodes.join(parts, "node").select("node", "part", "doc_id", "text_key"))
    shared = stored(sharing(prefixes(texts, frequent(made), width, similarity), similarity))
    listed = shared.where("not hot").select("a", "b")
    linked = stored(linked.unionByName(verified(docs, nodes, listed, width, similarity)))
    parts = stored(_parts(nodes, linked))
    hidden = stored(within_families(docs, nodes, parts, shared.where("hot").select("a", "b"), width, similarity))
    roots = connected(hidden).withColumnRenamed("node", "part")
    placed = nodes.join(parts, "node").join(roots, "part", "left")
    grouped = placed.groupBy(F.coalesce("root", "part").alias("root"))
    staying = grouped.agg(F.min(rank).alias("first")).select(
        F.col("first.doc_id").alias("id"), F.col("first.text_key").alias("key")
    )
    # The caller's columns ride in a struct, so that none of them meets a name used here.
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.xxhash64(whole_text()).alias("key"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
    ).alias("rows")
    staying = staying.alias("staying")
    kept = rows.join(
        staying, F.col("rows.id").eqNullSafe(F.col("staying.id")) & (F.col("rows.key") == F.col("staying.key")), "left_semi"
    )
    # Rows that repeat an id and its text: one of them.
    once = Window.partitionBy("id", "key").orderBy("key")
    return kept.withColumn("n", F.row_number().over(once)).where("n = 1").select("row.*")
