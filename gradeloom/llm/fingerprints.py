"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed left to right into the shortest phrases not met before. The set of
phrases is its dictionary: texts that compress alike share phrases. Each phrase is
hashed, and the fingerprint keeps, for each of ``SLOTS`` hash functions, 16 bits of the
smallest phrase hash. The share of equal slots estimates the Jaccard likeness of the two
phrase sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import range_blocks, whole_text

SLOTS = 128
EMPTY = "f" * (4 * SLOTS)
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = pow(BASE, -1, 2**64)


def phrase_ends(text: str, known: list[int] | None = None) -> list[int]:
    """Where each phrase of ``text`` ends.

    ``known`` are the ends of the phrases of an equal prefix; the parse goes on from
    there. A rest that repeats an earlier phrase adds none.
    """
    ends = list(known or ())
    seen = {text[a:b] for a, b in zip([0, *ends], ends, strict=False)}
    start = ends[-1] if ends else 0
    for end in range(start + 1, len(text) + 1):
        phrase = text[start:end]
        if phrase not in seen:
            seen.add(phrase)
            ends.append(end)
            start = end
    return ends


def _powers(base: int, n: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    have = kept.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), base, dtype=np.uint64)
        steps[0] = 1
        have = kept[base] = np.multiply.accumulate(steps)
    return have[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_DRAWN = np.random.default_rng(20).integers(0, 2**63, size=(2, SLOTS), dtype=np.uint64)
FACTORS, SHIFTS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]


def phrase_hashes(text: str, ends: list[int]) -> np.ndarray:
    """One 64-bit hash for each phrase, from running polynomial sums over the text."""
    if not ends:
        return np.empty(0, dtype=np.uint64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes + np.uint64(1)) * _powers(BASE, len(codes)), out=sums[1:])
    stop = np.asarray(ends)
    start = np.concatenate(([0], stop[:-1]))
    return _mixed((sums[stop] - sums[start]) * _powers(BASE_INVERSE, len(codes))[start])


def lowest(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash under each of the hash functions; the largest number, if none."""
    low = np.full(SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        block = hashes[at : at + 2048, None] * FACTORS + SHIFTS
        np.minimum(low, block.min(axis=0), out=low)
    return low


def slots(low: np.ndarray, any_phrase: bool) -> np.ndarray:
    """16 bits of each of the smallest hashes."""
    if not any_phrase:
        return np.full(SLOTS, 0xFFFF, dtype=np.uint16)
    return (_mixed(low) >> np.uint64(48)).astype(np.uint16)


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 bits of the smallest hash under each of the hash functions."""
    return slots(lowest(hashes), len(hashes) > 0)


def as_text(values: np.ndarray) -> str:
    return values.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / SLOTS


def fingerprint(text: str) -> str:
    """The fingerprint of one text, as hexadecimal digits."""
    return as_text(signature(phrase_hashes(text, phrase_ends(text))))


def with_edits(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of an edited text, and their likeness.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. The edited text
    replaces the last third (rounded down, in code points) by as many code points from
    the start of the next document (all of it, if shorter), in falling order of
    ``doc_id``; after the last comes the first. A null text is empty; an empty text has
    the fingerprint ``EMPTY``. Null ids come last, equal ids go by their text; repeated
    rows each count. An empty table gives no rows; a single document is its own next.

    Documents go once through a shuffle, into ranges of ids. Each range also gets a copy
    of the first document of the range after it, so no range waits for another. Inside a
    range rows stream in order; a task holds two documents and one Arrow batch.
    """
    spark = docs.sparkSession
    blocks = blocks or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    placed, _ = range_blocks(rows, "doc_id", blocks)
    # Only ids are read here: the highest id of each range, and the range above it.
    heads = placed.groupBy("__block").agg(F.max("doc_id").alias("doc_id")).orderBy(F.desc("__block")).collect()
    if not heads:
        return _edited(placed.withColumn("__real", F.lit(True)))
    above = [(heads[i - 1]["__block"], row["__block"], row["doc_id"]) for i, row in enumerate(heads)]
    # At most ``blocks`` rows: how many ranges there are does not grow with the documents.
    link = spark.createDataFrame(above, "__above int, __own int, __head long").coalesce(1)
    first = (
        placed.join(
            F.broadcast(link), (placed["__block"] == link["__own"]) & placed["doc_id"].eqNullSafe(link["__head"])
        )
        .groupBy("__above")
        .agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"))
        .select("doc_id", "text", F.col("__above").alias("__block"), F.lit(False).alias("__real"))
    )
    dealt = placed.withColumn("__real", F.lit(True)).unionByName(first)
    return _edited(dealt.repartition("__block"))


def _edited(dealt: DataFrame) -> DataFrame:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        # The row before: its range, id, text, phrase ends up to the edit, the smallest hashes
        # of these phrases, and its signature.
        held = None

        def row(block, doc_id, text):
            ends = phrase_ends(text)
            hashes = phrase_hashes(text, ends)
            known = int(np.searchsorted(ends, len(text) - len(text) // 3, side="right"))
            low = lowest(hashes[:known])
            own = slots(np.minimum(low, lowest(hashes[known:])), len(ends) > 0)
            return block, doc_id, text, ends[:known], low, own

        def result(of, after):
            _, doc_id, text, known, low, own = of
            cut = len(text) - len(text) // 3
            edited = text[:cut] + after[2][: len(text) - cut]
            ends = phrase_ends(edited, known)
            # Hashes do not depend on the place, so only what follows the kept phrases is hashed.
            start = known[-1] if known else 0
            new = lowest(phrase_hashes(edited[start:], [e - start for e in ends[len(known) :]]))
            new = slots(np.minimum(low, new), len(ends) > 0)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return (
                doc_id, len(text), digest, as_text(own), as_text(new),
                likeness(own, new), likeness(own, after[5]),
            )

        for batch in batches:
            out = []
            columns = [batch.column(n).to_pylist() for n in ("__block", "doc_id", "text", "__real")]
            for block, doc_id, text, real in zip(*columns, strict=True):
                now = row(block, doc_id, text)
                if held is not None and held[0] == block:
                    out.append(result(held, now))
                # The range's last row is the copy of the next range's first; it ends the range.
                held = now if real else None
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=NAMES
                )

    ordered = dealt.sortWithinPartitions("__block", F.desc("__real"), F.desc_nulls_last("doc_id"), "text")
    return ordered.select("__block", "doc_id", "text", "__real").mapInArrow(compare, SCHEMA)


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
