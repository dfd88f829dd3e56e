"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is the bitwise majority over the hashes of a text's shingles. To
find all fingerprints that differ in at most two bits, a fingerprint is cut into only two
segments: then one of them differs in at most one bit, and the index holds it with one
bit left out (a wildcard). Equal keys are joined and the distance is verified.

A key fixes one half more closely, so that no bucket can grow with the data. With high
half A and low half B, a pair at distance 1 or 2 is one of

* A equal: B differs in at most two bits, so one 16-bit part of B in at most one. Key: A,
  and that part without one of its bits.
* B equal: the same with A and B exchanged.
* A and B differ in one bit each: one 16-bit part of B is equal. Key: A without one of its
  bits, and that part.

Every key fixes 47 bits, so a bucket of distinct fingerprints holds at most 2**17.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import connected, stored, whole_text

SEED = 42
MAX_BITS = 2


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words; of all words, if there are fewer.

    Bytes split on ASCII white space and lower-case only A-Z, as the definition asks.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    runs = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(run), SEED) for run in runs), dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes set each of the 64 bits, lowest bit first.

    Bits are unpacked to bytes and summed eight at a time in 64-bit lanes; a lane of
    eight bytes takes 255 rows before it could overflow.
    """
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 255):
        octets = hashes[at : at + 255].astype("<u8").view(np.uint8)
        bits = np.unpackbits(octets, bitorder="little").view(np.uint64).reshape(-1, 8)
        total += bits.sum(axis=0, dtype=np.uint64).view(np.uint8)
    return total


def fingerprint(text: str, width: int = 3) -> int:
    """The 64-bit fingerprint; 0 for a text without words."""
    hashes = shingle_hashes(text, width)
    set_bits = bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id`` and ``bits``, the fingerprint as a signed 64-bit number."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "bits"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(compute, "doc_id long, bits long")


def _keys(bits: str) -> Column:
    """The 128 keys of a fingerprint: 47 fixed bits and 10 bits that say which."""
    low, high = f"({bits} & 4294967295L)", f"shiftrightunsigned({bits}, 32)"
    part = "(shiftright({0}, 16 * h) & 65535)"
    kinds = []
    for kind, (exact, other) in enumerate(((high, low), (low, high))):
        half = part.format(other)
        kinds.append(
            f"flatten(transform(array(0, 1), h -> transform(sequence(0, 15), q -> "
            f"shiftleft({exact}, 16) | ({half} & ~shiftleft(1L, q)) "
            f"| shiftleft(cast({kind} * 32 + h * 16 + q as bigint), 48))))"
        )
    half = part.format(low)
    kinds.append(
        f"flatten(transform(array(0, 1), h -> transform(sequence(0, 31), q -> "
        f"shiftleft({high} & ~shiftleft(1L, q), 16) | {half} "
        f"| shiftleft(cast(64 + h * 32 + q as bigint), 48))))"
    )
    return F.expr(f"concat({', '.join(kinds)})")


def _bucket_links(members: np.ndarray, near) -> list[tuple[int, int]]:
    """Links that join what the bucket shows to be near: one fewer than members at most."""
    out, left = [], members
    while len(left) > 1:
        # Breadth first from the smallest: whatever is reached hangs on it.
        root, reached, left = left[0], left[:1], left[1:]
        while len(reached) and len(left):
            hit = np.zeros(len(left), dtype=bool)
            for one in reached:
                hit |= near(one, left)
            reached = left[hit]
            out += [(int(root), int(x)) for x in reached]
            left = left[~hit]
    return out


def close_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``(a, b)`` that connect distinct fingerprints at ``max_bits`` (1 or 2) or fewer.

    ``prints`` has one row for each distinct ``bits``. Within a bucket the links form a
    forest over its near members, so they stay fewer than the index rows; the components
    are those of all near pairs.
    """
    if max_bits not in (1, 2):
        raise ValueError("two segments with one wildcard find one or two differing bits")

    def near(one: np.int64, others: np.ndarray) -> np.ndarray:
        return np.bitwise_count((others ^ one).view(np.uint64)) <= max_bits

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k = rest_b = np.empty(0, dtype=np.int64)
        for batch in batches:
            keys = np.concatenate([rest_k, batch.column(0).to_numpy()])
            bits = np.concatenate([rest_b, batch.column(1).to_numpy()])
            # The last key may go on in the next batch.
            done = int(np.searchsorted(keys, keys[-1], side="left")) if len(keys) else 0
            yield from emit(keys[:done], bits[:done])
            rest_k, rest_b = keys[done:], bits[done:]
        yield from emit(rest_k, rest_b)

    def emit(keys: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys) < 2:
            return
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(start, len(keys)))
        two = start[size == 2]
        a, b = bits[two], bits[two + 1]
        ok = np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits
        pairs = [np.stack([a[ok], b[ok]], axis=1)]
        for at, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            found = _bucket_links(np.sort(bits[at : at + n]), near)
            if found:
                pairs.append(np.array(found, dtype=np.int64))
        every = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
        if len(every):
            yield pa.RecordBatch.from_arrays(
                [pa.array(every[:, 0].copy()), pa.array(every[:, 1].copy())], names=["a", "b"]
            )

    # Distinct fingerprints are small and would be read by a few tasks; each makes many keys.
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = prints.repartition(tasks, "bits").select(F.explode(_keys("bits")).alias("key"), "bits")
    return index.repartition("key").sortWithinPartitions("key").mapInArrow(links, "a long, b long")


def components(docs: DataFrame, width: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``.

    ``component_id`` is the smallest ``doc_id`` that can be reached over links between
    fingerprints that differ in ``max_bits`` or fewer, the document's own included. A null
    text is empty; a text without words has fingerprint zero and is linked like any other.
    A null ``doc_id`` keeps its row and takes the smallest id of its component (null if
    there is none). Repeated rows stay repeated; an empty table gives no rows.

    Equal fingerprints are merged before the index is built, so copies add nothing to it.
    """
    prints = stored(fingerprints(docs, width))
    distinct = prints.groupBy("bits").agg(F.min("doc_id").alias("first"))
    roots = connected(close_links(distinct.select("bits"), max_bits))
    placed = distinct.join(roots, distinct["bits"] == roots["node"], "left").select(
        "bits", "first", F.coalesce("root", "bits").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = placed.join(named, "root").select("bits", "component_id")
    return prints.join(classes, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )
