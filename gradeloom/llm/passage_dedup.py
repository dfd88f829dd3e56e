"""Removal of repeated passages by hashing lines and parts of them.

A text has two kinds of units: its lines, and its pieces. A piece ends after each word whose
hash says so, about every ``PIECE_WORDS`` words, so equal passages have equal pieces inside,
whatever sentences they start and end in; two neighbouring pieces are hashed together, as
short pieces repeat by chance. Words are normalised (lower case, single spaces). Digests are
grouped over all documents, and the earliest occurrence, ranked by ``doc_id`` and place, is
kept. What later occurrences cover goes, where it has at least ``MIN_WORDS`` words in a row.

A line of fewer words goes only as boilerplate: if it has ``LINE_WORDS`` words and
``LINE_DOCS`` documents hold it. The cleaned text comes with the original offsets of all
that was taken out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import stored

MIN_WORDS, PIECE_WORDS = 12, 6
LINE_WORDS, LINE_DOCS = 3, 10
#: Code points of texts that are cut at once.
TOGETHER = 2_000_000
#: Which code points are white space; none lies beyond the last of these.
_WHITE = np.array([chr(i).isspace() for i in range(0x3002)])
#: The halves of a digest are two polynomials over the hashes of the words.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    have = kept.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), base, dtype=np.uint64)
        have = kept[base] = np.multiply.accumulate(steps)
    return have[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_digests(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """128 bits, as two numbers, for each run of words ``start`` to ``end`` (not empty).

    Differences of running polynomial sums; a run's place is multiplied away by the inverse
    power, so equal runs are equal wherever they lie. ``kind`` and length are mixed in.
    """
    out, n = np.empty((2, len(start)), dtype=np.int64), len(hashes)
    for half, base in enumerate(_BASES):
        powers = _powers(base, n + 1)
        inverse = _powers(pow(base, -1, 2**64), n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_mixed(hashes + np.uint64(half)) * powers[:n], out=sums[1:])
        found = (sums[end] - sums[start]) * inverse[start] * np.uint64(base)
        out[half] = _mixed(found + (end - start).astype(np.uint64) * np.uint64(2) + kind.astype(np.uint64)).view(np.int64)
    return out


class Units:
    """The lines and pieces of several texts, as numbers of words counted through all of them."""

    def __init__(self, texts: list[str]) -> None:
        # The one letter whose lower case is longer becomes a plain i, so that places hold.
        plain = "\n".join(texts).replace("\u0130", "i").lower()
        codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        white = np.concatenate([[True], _WHITE[np.minimum(codes, len(_WHITE) - 1)], [True]])
        edges = np.flatnonzero(white[1:] != white[:-1])
        #: Where each word starts, in the joined texts.
        self.at, stop = edges[::2], edges[1::2]
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASES[0], len(codes) + 1)[: len(codes)], out=sums[1:])
        inverse = _powers(pow(_BASES[0], -1, 2**64), len(codes) + 1)
        self.hashes = _mixed((sums[stop] - sums[self.at]) * inverse[self.at])
        breaks = np.flatnonzero(codes == 10)
        #: The words of line n go from line_starts[n] to line_ends[n].
        self.line_starts = np.concatenate([[0], np.searchsorted(self.at, breaks)])
        self.line_ends = np.append(self.line_starts[1:], len(self.at))
        #: Where the texts begin: in code points, lines and words, and the end of all.
        sizes = np.array([len(t) + 1 for t in texts])
        self.begins = np.concatenate([[0], np.cumsum(sizes)])
        self.first_line = np.searchsorted(breaks, self.begins[:-1]).astype(np.int64)
        self.first_word = np.searchsorted(self.at, self.begins)
        ends = np.flatnonzero(self.hashes % np.uint64(PIECE_WORDS) == 0) + 1
        #: Pieces go from one of these to the next; every text begins one.
        self.cuts = np.unique(np.concatenate([ends, self.first_word]))
        self.first_cut = np.searchsorted(self.cuts, self.first_word)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, place, first and last word (exclusive) of each unit that is hashed.

        Places count in the text. Those of lines are even, twice the line's number; those of
        two neighbouring pieces odd, twice the number of the first and one.
        """
        lines = np.flatnonzero(self.line_ends > self.line_starts)
        of_line = np.searchsorted(self.first_line, lines, side="right") - 1
        pairs = np.arange(max(len(self.cuts) - 2, 0))
        of_pair = np.searchsorted(self.first_word, self.cuts[pairs], side="right") - 1
        inside = self.cuts[pairs + 2] <= self.first_word[of_pair + 1]
        pairs, of_pair = pairs[inside], of_pair[inside]
        place = np.concatenate([2 * (lines - self.first_line[of_line]), 2 * (pairs - self.first_cut[of_pair]) + 1])
        start = np.concatenate([self.line_starts[lines], self.cuts[pairs]])
        end = np.concatenate([self.line_ends[lines], self.cuts[pairs + 2]])
        return np.concatenate([of_line, of_pair]), place, start, end

    def covered(self, text: int, places: list[tuple[int, int | None]]) -> tuple[np.ndarray, np.ndarray]:
        """Words of a text that repeats cover, and its lines that go whole however short.

        A repeat is its place and, if its earliest occurrence is in the same text, the
        place of that one, which stays.
        """
        base, line, cut = self.first_word[text], self.first_line[text], self.first_cut[text]
        n_lines = (self.first_line[text + 1] if text + 1 < len(self.first_line) else len(self.line_ends)) - line
        words = np.zeros(self.first_word[text + 1] - base, dtype=bool)
        lines = np.zeros(n_lines, dtype=bool)
        for place, own in places:
            n = place >> 1
            if place % 2 == 0:
                a, b = self.line_starts[line + n], self.line_ends[line + n]
                words[a - base : b - base] = True
                lines[n] = b - a < MIN_WORDS
            else:
                first = n if own is None else max(n, (own >> 1) + 2)
                if first < n + 2:
                    words[self.cuts[cut + first] - base : self.cuts[cut + n + 2] - base] = True
        return words, lines

    def spans(self, text: int, size: int, words: np.ndarray, lines: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
        """``(start, length)`` of what goes from a text of ``size`` code points, in order.

        ``words`` and ``lines`` tell for each of the text whether it repeats; a run of
        repeated words goes if it has ``min_words`` or is made of ``lines`` alone. A span
        reaches to the next word that stays, over the line break between.
        """
        base, line = self.first_word[text], self.first_line[text]
        at = np.append(self.at[base : self.first_word[text + 1]] - self.begins[text], size).tolist()
        low, high = self.line_starts[line : line + len(lines)] - base, self.line_ends[line : line + len(lines)] - base
        edges = np.flatnonzero(np.diff(np.concatenate([[0], words.astype(np.int8), [0]])))
        spans: list[tuple[int, int]] = []
        for a, b in edges.reshape(-1, 2).tolist():
            runs = [(a, b)]
            if b - a < min_words:
                # A short run: only its whole lines.
                whole = np.flatnonzero(lines & (low >= a) & (high <= b) & (high > low))
                runs = [(int(low[n]), int(high[n])) for n in whole]
            for c, d in runs:
                start, end = at[c] if c else 0, at[d]
                if spans and spans[-1][1] == start:
                    spans[-1] = (spans[-1][0], end)
                else:
                    spans.append((start, end))
        return [(a, b - a) for a, b in spans]


def in_parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of about ``TOGETHER`` code points, with the number of the first."""
    low, size = 0, 0
    for n, text in enumerate(texts):
        size += len(text)
        if size > TOGETHER or n == len(texts) - 1:
            yield low, texts[low : n + 1]
            low, size = n + 1, 0


def _row_key(text: str) -> int:
    """Tells rows of the same id with different texts apart."""
    return xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")) - 2**31


_UNITS = "high long, low long, doc_id long, row_key int, place int, lead int, short boolean"


def units(docs: DataFrame) -> DataFrame:
    """A row for every line that has words and every two neighbouring pieces.

    ``high, low`` are the digest; ``lead`` is 1 for the first of equal units of a text, so
    that its sum counts documents; ``short`` marks lines of fewer than ``MIN_WORDS`` words.
    Shorter ones than ``LINE_WORDS`` are left out.
    """
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(n, types[t]) for n, t in (c.split() for c in _UNITS.split(", "))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in in_parts(batch.column(1).to_pylist()):
                yield from batches_of(batch.column(0).slice(low, len(texts)), texts)

    def batches_of(doc_ids: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
        own = Units(texts)
        text, place, start, end = own.runs()
        short = (place % 2 == 0) & (end - start < MIN_WORDS)
        use = ~short | (end - start >= LINE_WORDS)
        text, place, start, end, short = text[use], place[use], start[use], end[use], short[use]
        made = run_digests(own.hashes, start, end, place % 2)
        lead = np.ones(len(text), dtype=np.int32)
        # Only lines are counted by documents: the first of equal ones of a text.
        lines = np.flatnonzero(short)
        _, first = np.unique(np.stack([text[lines], made[0, lines]]), axis=1, return_index=True)
        lead[lines] = 0
        lead[lines[first]] = 1
        keys = np.array([_row_key(t) for t in texts])
        whole = pa.RecordBatch.from_arrays(
            [pa.array(made[0]), pa.array(made[1]), doc_ids.take(pa.array(text)), pa.array(keys[text].astype(np.int32)),
             pa.array(place.astype(np.int32)), pa.array(lead), pa.array(short)], schema=schema,
        )
        for low in range(0, len(text), 50_000):
            yield whole.slice(low, 50_000)

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, _UNITS)


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, cleaned ``text``, ``n_removed`` spans and their ``removed`` offsets.

    Occurrences rank by ``doc_id`` (nulls last), then by place. ``removed`` lists
    ``start`` and ``length`` in code points of the original text, in order. A null text
    stays null, an empty one empty; both lose nothing. Rows that repeat an id and its text
    are one document and get the same result; rows that share only the id are told apart.
    Very long texts are whole. Other columns are ignored. An empty table gives no rows.

    Digests are pre-aggregated before they are shuffled, and only those seen twice are
    joined back, so a line that everybody has is one row of the joined side, and its
    occurrences on the other side can be split over tasks.
    """
    found = units(docs)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key", "place")
    # Written first: then both sides of the join are dealt out for it alone, and Spark can
    # split the part of a digest that many documents share.
    repeated = stored(
        found.groupBy("high", "low")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("lead").alias("n_docs"), F.max("short").alias("short"), F.min(rank).alias("first"))
        .where((F.col("n") > 1) & (~F.col("short") | (F.col("n_docs") >= LINE_DOCS)))
        .select("high", "low", F.col("first.doc_id").alias("first_id"), F.col("first.row_key").alias("first_key"), F.col("first.place").alias("first_place"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("row_key") == F.col("first_key"))
    later = (
        found.select("high", "low", "doc_id", "row_key", "place").join(repeated, ["high", "low"])
        .where(~(same & (F.col("place") == F.col("first_place"))))
        # Places of one text: as many at most as the text has units.
        .groupBy("doc_id", "row_key")
        .agg(F.collect_set(F.struct("place", F.when(same, F.col("first_place")).alias("own"))).alias("places"))
        .withColumnRenamed("doc_id", "of_id")
        .withColumnRenamed("row_key", "of_key")
    )

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if t is None else _row_key(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.int32())], names=["doc_id", "text", "row_key"]
            )

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, all_places = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            touched = [n for n, places in enumerate(all_places) if places]
            found: dict[int, list[tuple[int, int]]] = {}
            for low, own_texts in in_parts([given[n] for n in touched]):
                own = Units(own_texts)
                for k, n in enumerate(touched[low : low + len(own_texts)]):
                    repeats = [(p["place"], p["own"]) for p in all_places[n]]
                    found[n] = own.spans(k, len(given[n]), *own.covered(k, repeats), min_words)
            texts, spans = [], []
            for n, text in enumerate(given):
                out = found.get(n, [])
                at, kept = 0, []
                for start, length in out:
                    kept.append(text[at:start])
                    at = start + length
                texts.append(None if text is None else "".join([*kept, text[at:]]))
                spans.append([{"start": a, "length": n} for a, n in out])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int32()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))],
                names=["doc_id", "text", "n_removed", "removed"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.mapInArrow(keys, "doc_id long, text string, row_key int")
    joined = keyed.join(
        later, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row_key") == F.col("of_key")), "left"
    )
    return joined.select("doc_id", "text", "places").mapInArrow(
        clean, "doc_id long, text string, n_removed int, removed array<struct<start: long, length: long>>"
    )
