"""Packing documents into sequences by minimum bin slack.

A document's ids are cut into full windows and one remainder. Remainders are packed by
their lengths alone: the longest one left opens a window, and a subset-sum program over a
bitset of reachable sums picks how many remainders of each length fill the rest of the
window closest to its end. Counts are read back from the kept bitsets. A filling that
worked is repeated as often as the counts allow, so the work follows the number of
different lengths, not of documents.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import whole_text

WINDOW = 2048
END_ID = 1
#: Documents of a task whose remainder may be cut to fill what the others leave open.
RESERVE = 64


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(name: str = "byte_bpe_50k.json") -> dict[str, int]:
    """Strings that the vocabulary's JSON splits out of any text, and their ids."""
    with open(tokenizer_path(name), encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def encoder(path: str, added: dict[str, int] | None = None) -> Callable[[str], list[int]]:
    """Ids of a text under a file of ranks and added tokens (those of the JSON by default).

    The ranks hold the vocabulary and merges of ``byte_bpe_50k.json``; both libraries give
    the same ids, and this one gives them about five times faster. Added tokens are split
    out of the text first, as the JSON's library does without being asked.
    """
    import public_tokenizers
    import tiktoken

    added = added_tokens() if added is None else added
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    ranks = {token: i for token, i in ranks.items() if token.decode("utf-8", "replace") not in added}
    model = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added
    )

    def encode(text: str) -> list[int]:
        if any(token in text for token in added):
            return model.encode(text, allowed_special="all")
        return model.encode_ordinary(text)

    return encode


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take, so that the sum is the largest up to ``room``.

    ``reach`` has bit s set when s can be made. It is kept before each added piece, so the
    counts can be read back from the last piece to the first.
    """
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted((n for n in counts if n <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            more = reach | (reach << length) & full
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + 1
            at -= length
    return taken


def fillings(lengths: dict[int, int], window: int) -> Iterator[tuple[dict[int, int], int]]:
    """Fillings of windows and how often each is used, until no remainder is left."""
    counts = dict(lengths)
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        taken = best_fill({n: c for n, c in counts.items() if c}, window - longest)
        counts[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in taken.items())
        for n, k in taken.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        yield taken, times


class _Packer:
    """The pieces of one task: arrays of numbers, and the ids of the reserve only."""

    def __init__(self, window: int, reserve: int):
        self.window, self.reserve_size = window, reserve
        self.doc, self.start, self.length, self.crc, self.tokens = [], [], [], [], []
        self.reserve: list[tuple] = []

    def piece(self, doc_id, start, ids: np.ndarray, total) -> int:
        self.doc.append(doc_id)
        self.start.append(start)
        self.length.append(len(ids))
        self.crc.append(zlib.crc32(ids.tobytes()))
        self.tokens.append(total)
        return len(self.doc) - 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, full = len(ids), len(ids) // self.window * self.window
        for at in range(0, full, self.window):
            self.piece(doc_id, at, ids[at : at + self.window], total)
        if full == total:
            return
        self.reserve.append((doc_id, full, ids[full:].copy(), total))
        if len(self.reserve) > self.reserve_size:
            old = self.reserve.pop(0)
            self.piece(*old)

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and offset of each piece, in the order the pieces were made."""
        waiting: dict[int, list[int]] = {}
        place: dict[int, tuple[int, int]] = {}
        made = 0
        for i, n in enumerate(self.length):
            if n == self.window:
                place[i] = (made, 0)
                made += 1
            else:
                waiting.setdefault(n, []).append(i)
        left = [r for r in self.reserve]
        for taken, times in fillings({n: len(v) for n, v in waiting.items()}, self.window):
            for _ in range(times):
                at = 0
                for n in sorted(taken, reverse=True):
                    for _ in range(taken[n]):
                        place[waiting[n].pop()] = (made, at)
                        at += n
                while at < self.window and left:
                    at += self._cut(left, self.window - at, place, made, at)
                made += 1
        # What is left of the reserve: full windows, then powers of two, which need no padding.
        rest = sum(len(r[2]) for r in left)
        while rest:
            size = min(self.window, 1 << (rest.bit_length() - 1))
            at = 0
            while at < size:
                at += self._cut(left, size - at, place, made, at)
            made, rest = made + 1, rest - size
        order = [place[i] for i in range(len(self.doc))]
        return np.array([o[0] for o in order], dtype=np.int64), np.array([o[1] for o in order], dtype=np.int64)

    def _cut(self, left: list, room: int, place: dict, sequence: int, at: int) -> int:
        """Puts up to ``room`` ids of the reserve's last remainder there; how many."""
        doc_id, start, ids, total = left.pop()
        i = self.piece(doc_id, start, ids[:room], total)
        place[i] = (sequence, at)
        if len(ids) > room:
            left.append((doc_id, start + room, ids[room:], total))
        return min(room, len(ids))


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def pack(
    docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, path: str | None = None,
    reserve: int = RESERVE,
) -> DataFrame:
    """One row per piece: where it lies in its document, and in which sequence.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Every document ends
    with ``end_id``, so a null or empty text is one id. Repeated rows and null ids are
    packed like any other document. An empty table gives no rows.

    Each input partition packs its own documents in one pass without a shuffle; a
    sequence's number starts with its partition's. A task holds about a hundred bytes per
    piece and the ids of ``reserve`` remainders. Windows that subset sums leave open are
    filled by cutting those, and what is left of them goes into powers of two, which need
    no padding. So a task pads only if its reserve runs out.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = encoder(path), _Packer(window, reserve)
        for batch in batches:
            texts = batch.column(1)
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids = np.array([*encode(text.as_py()), end_id], dtype="<u4")
                packer.add(doc_id, ids)
        sequence, offset = packer.sequences()
        first = TaskContext.get().partitionId() << 36
        columns = [packer.doc, packer.start, packer.length, packer.crc, packer.tokens, sequence + first, offset]
        for at in range(0, len(sequence), 10_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[at : at + 10_000], pa.int64()) for c in columns], names=NAMES
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, SCHEMA)
