"""Alignment of two tokenizers over the bytes of the same texts.

Both tokenizers give spans in characters: ``tokenizers`` as offsets, sentencepiece as the
begin and end of each piece of its result. Where a span ends on a character that the next
one does not share, that is a cut in bytes. Characters that several tokens share (letters of
many bytes, byte-fallback pieces, the added first space) are cut by the tokens' own bytes.
The tokens' bytes must join to the text, or it has no tokens.

Tokens A and B that end at the same byte end a group. Two overlapping tokens share exactly
one stretch between neighbouring ends of either kind, so a text's links are its stretches.

A text is cut into short units where neither tokenizer can join what lies on both sides
(checked on both vocabularies), and each different unit is encoded once. Documents are kept
as numbers of units in blocks of bounded size; the counts of id pairs over the corpus meet
a block once for each of its different pairs, not once for each link.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import stored, whole_text

#: Bytes of text in a block, and its blocks that a task can number.
BLOCK_BYTES, RUNS = 6_000_000, 1 << 24
#: Units whose alignment a worker remembers since it last forgot some; before that, as many again.
REMEMBERED = 240_000
#: An id pair as one number: a * WIDTH + b.
WIDTH = 1 << 20
_SPACE = "▁"
#: A space behind a character other than a space and before one that is no white space.
_WORDS = re.compile("(?<=[^ ])(?= [^\\s᠎])")
#: A space that does not begin a word; without any, the cuts are at all spaces.
_ODD_SPACE = re.compile(r" (?:[\s\u180e]|\Z)")
#: Latin and Cyrillic letters.
_LETTER = "[A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ӿ]"
#: Between a letter and a stop; before and behind a single line break.
_PARTS = re.compile(rf"(?<={_LETTER})(?=[.,;:!?])|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")

#: Tokens A, tokens B, groups, the groups as text, id pairs of the links (64-bit numbers).
Record = tuple[int, int, int, str, bytes]


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, all other bytes take the characters
    from 256 on, in order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def token_ends(spans: np.ndarray, sizes: np.ndarray, last: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The byte where each token ends, for the tokens of many units in a row.

    ``spans`` are ``(low, high)`` in characters of the joined units, ``at`` is the byte of
    each character boundary, ``sizes`` the tokens' own bytes; ``last`` marks the last token
    of a unit, and ``first`` is the byte where each token's unit begins. A span that is not
    empty and does not reach into the next one ends at ``at``: a coarse cut. The tokens
    between two such cuts end after their own bytes.
    """
    low, high = spans[:, 0], spans[:, 1]
    following = np.append(low[1:], len(at))
    coarse = last | ((low < high) & (high <= following))
    total = np.cumsum(sizes)
    cut = np.where(coarse, at[high], 0)
    # The nearest coarse cut before each token, or the unit's beginning.
    place = np.arange(len(low))
    begins = np.append(True, last[:-1])
    anchor = np.maximum.accumulate(np.where(np.append(False, coarse[:-1]) | begins, place, 0))
    from_byte = np.where(begins, first, np.append(0, cut[:-1]))[anchor]
    return np.where(coarse, cut, from_byte + total - (total - sizes)[anchor])


class Pair:
    """Two tokenizers, the bytes of their ids, and the alignment of units."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        alphabet = byte_alphabet()
        self.a_bytes = [
            bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
            for token in (self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size()))
        ]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace(_SPACE, " ").encode()
            for i, name in enumerate(names)
        ]
        plain = [n for i, n in enumerate(names) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.separable = self._separable(plain)
        #: Units met since the last change, and those met between the two changes before.
        self.known: dict[str, Record | None] = {}
        self.earlier: dict[str, Record | None] = {}
        self.a_sizes = np.array([len(t) for t in self.a_bytes])
        self.b_sizes = np.array([len(t) for t in self.b_bytes])
        # An id as it stands inside a group, and at the end of its half of the group.
        self.a_names = np.array([[f"{i},", f"{i}|"] for i in range(len(self.a_bytes))], dtype=object)
        self.b_names = np.array([[f"{i},", f"{i};"] for i in range(len(self.b_bytes))], dtype=object)

    def _separable(self, plain: list[str]) -> bool:
        """No piece holds two characters that a cut would part, and neither side rewrites text."""
        import json

        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(self.b.serialized_model_proto())
        rules, kind = model.normalizer_spec, model.trainer_spec.model_type
        before = json.loads(self.a.to_str())["pre_tokenizer"] or {}
        joins = re.compile(f"[^{_SPACE}]{_SPACE}|{_LETTER}[.,;:!?]|\\n")
        return (
            not any(joins.search(p) for p in plain)
            and kind == model.trainer_spec.BPE and rules.add_dummy_prefix
            and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
            and self.a.normalizer is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        )

    def words(self, text: str) -> list[str]:
        """The added space and ``text``, cut before spaces."""
        if not self.separable:
            return [" " + text]
        joined = " " + text
        return _WORDS.split(joined) if _ODD_SPACE.search(joined) else [" " + w for w in text.split(" ")]

    def align(self, words: list[str]) -> list[Record | None]:
        """The record of each word; None where the tokens' bytes are not the word's."""
        cut = _PARTS.split if self.separable else lambda w: [w]
        parts = [[w] if w[1:].isalpha() else cut(w) for w in words]
        new = set(chain.from_iterable(parts)).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            # What has not been met for long is forgotten; what has, stays or comes back.
            self.known, self.earlier = {}, self.known
            new = set(chain.from_iterable(parts))
        met = new.intersection(self.earlier)
        self.known.update(zip(met, map(self.earlier.__getitem__, met), strict=True))
        units = list(new - met)
        self.known.update(zip(units, self._aligned(units), strict=True))
        known, out = self.known, []
        for each in parts:
            if len(each) == 1:
                out.append(known[each[0]])
                continue
            found = [known[p] for p in each]
            if None in found:
                out.append(None)
            else:
                n_a, n_b, groups, texts, pairs = zip(*found, strict=True)
                out.append((sum(n_a), sum(n_b), sum(groups), ";".join(texts), b"".join(pairs)))
        return out

    def _aligned(self, units: list[str]) -> list[Record | None]:
        if not units:
            return []
        encoded = self.a.encode_batch(units, add_special_tokens=False)
        a_ids, a_spans = [e.ids for e in encoded], [e.offsets for e in encoded]
        # Units without a space in front go behind a line break, which joins with nothing.
        lead = [u.startswith(" ") for u in units]
        bare = [u[1:] if led else "\n" + u for u, led in zip(units, lead, strict=True)]
        mapped = self.b.encode(bare, return_type="offset_mapping", num_threads=1)
        b_ids = [m["ids"] if led else m["ids"][2:] for m, led in zip(mapped, lead, strict=True)]
        b_spans = [m["offsets"] if led else m["offsets"][2:] for m, led in zip(mapped, lead, strict=True)]
        whole = [u.encode() for u in units]

        def joined(ids: list[list[int]], raw: list[bytes]) -> bytes:
            return b"".join(map(raw.__getitem__, chain.from_iterable(ids)))

        if joined(a_ids, self.a_bytes) == b"".join(whole) == joined(b_ids, self.b_bytes):
            good = range(len(units))
        else:
            good = [
                n for n, w in enumerate(whole)
                if joined(a_ids[n : n + 1], self.a_bytes) == w == joined(b_ids[n : n + 1], self.b_bytes)
            ]
        out: list[Record | None] = [None] * len(units)
        if good:
            own = ([each[n] for n in good] for each in (units, whole, a_ids, a_spans, b_ids, b_spans))
            for n, record in zip(good, self._together(*own), strict=True):
                out[n] = record
        return out

    def _together(
        self, units: list[str], whole: list[bytes], a_ids: list, a_spans: list, b_ids: list, b_spans: list
    ) -> list[Record]:
        """Records of units whose tokens join to their bytes, all units in a row."""
        octets = np.frombuffer(b"".join(whole), dtype=np.uint8)
        at = np.append(np.flatnonzero((octets & 0xC0) != 0x80), len(octets))
        ends = np.cumsum([len(w) for w in whole])
        begins = ends - [len(w) for w in whole]
        chars = np.cumsum([0, *map(len, units)])[:-1]

        def side(ids: list, spans: list, sizes: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            ids = np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(counts.sum()))
            flat = chain.from_iterable(chain.from_iterable(spans))
            spans = np.fromiter(flat, dtype=np.int64, count=2 * len(ids)).reshape(-1, 2)
            last = np.zeros(len(ids), dtype=bool)
            last[np.cumsum(counts) - 1] = True
            spans = np.maximum(spans + np.repeat(chars + shift, counts)[:, None], 0)
            return ids, counts, token_ends(spans, sizes[ids], last, at, np.repeat(begins, counts))

        a_ids, a_counts, a_ends = side(a_ids, a_spans, self.a_sizes, np.zeros(len(units), dtype=np.int64))
        # B's characters begin behind the added space, or behind the line break.
        shift = np.array([1 if u.startswith(" ") else -1 for u in units])
        b_ids, b_counts, b_ends = side(b_ids, b_spans, self.b_sizes, shift)
        cuts = np.union1d(a_ends, b_ends)
        pairs = a_ids[np.searchsorted(a_ends, cuts)] * WIDTH + b_ids[np.searchsorted(b_ends, cuts)]
        links = np.searchsorted(cuts, ends, side="right")
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
        groups = np.diff(np.searchsorted(shared, ends, side="right"), prepend=0).tolist()
        # Group by group, its tokens A and then its tokens B.
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        named = np.empty(len(a_ids) + len(b_ids), dtype=object)
        named[np.arange(len(a_ids)) + np.searchsorted(b_group, a_group)] = self.a_names[a_ids, (a_ends == shared[a_group]).astype(int)]
        named[np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, side="right")] = self.b_names[b_ids, (b_ends == shared[b_group]).astype(int)]
        named, packed = named.tolist(), pairs.astype("<i8").tobytes()
        out, token, link = [], 0, 0
        for n_a, n_b, n, to in zip(a_counts.tolist(), b_counts.tolist(), groups, links.tolist(), strict=True):
            text = "".join(named[token : token + n_a + n_b])[:-1]
            out.append((n_a, n_b, n, text, packed[8 * link : 8 * to]))
            token, link = token + n_a + n_b, to
        return out


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(byte_level: str, pieces: str) -> Pair:
    """The tokenizers, kept by a worker from task to task."""
    if (byte_level, pieces) not in _PAIRS:
        _PAIRS[byte_level, pieces] = Pair(byte_level, pieces)
    return _PAIRS[byte_level, pieces]


class _Block:
    """Words of a run of documents, numbered as they come, with their alignments."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        #: Tokens A, tokens B, groups of each word; -1 in a word without an alignment.
        self.counts = np.empty((0, 3), dtype=np.int64)
        self.texts: list[str] = []
        self.pairs: list[bytes] = []
        self.uses: list[np.ndarray] = []
        self.size = 0

    def take(self, texts: list[str], pair: Pair) -> Iterator[tuple]:
        """For each text: tokens A and B, groups, the digest of the groups, its words."""
        cut = [pair.words(t) if t else [] for t in texts]
        new = list(set().union(*cut).difference(self.number))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        records = [r or (-1, -1, -1, "", b"") for r in pair.align(new)]
        if records:
            a, b, groups, names, pairs = zip(*records, strict=True)
            self.counts = np.concatenate([self.counts, np.array([a, b, groups]).T])
            self.texts += names
            self.pairs += pairs
        self.size += sum(map(len, texts))
        for words in cut:
            used = np.fromiter(map(self.number.__getitem__, words), dtype=np.int32, count=len(words))
            counts = self.counts[used]
            if not words or counts.min() < 0:
                yield 0, 0, 0, "", b""
                continue
            text = ";".join(map(self.texts.__getitem__, used.tolist()))
            self.uses.append(used)
            yield (*counts.sum(axis=0).tolist(), hashlib.sha256(text.encode()).hexdigest(), used.tobytes())

    def closed(self) -> dict[str, bytes]:
        """The block's different id pairs, how often it links each, and each word's pairs."""
        sizes = np.array([len(p) // 8 for p in self.pairs], dtype=np.int64)
        links = np.frombuffer(b"".join(self.pairs), dtype="<i8")
        pairs, place = np.unique(links, return_inverse=True)
        used = np.concatenate(self.uses) if self.uses else np.empty(0, dtype=np.int32)
        uses = np.bincount(used, minlength=len(sizes))
        tally = np.bincount(place, weights=np.repeat(uses, sizes), minlength=len(pairs))
        return {
            "pairs": pairs.astype("<i8").tobytes(), "tally": tally.astype("<i8").tobytes(),
            "links": place.astype("<i4").tobytes(), "sizes": sizes.astype("<i4").tobytes(),
        }


_ENCODED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, words binary, "
    "pairs binary, tally binary, links binary, sizes binary"
)


def encoded(docs: DataFrame, byte_level: str, pieces: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document as numbers of its block's words, and a row for each block's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Millions of small tuples, none in a cycle: collecting would only walk over them.
        gc.disable()
        pair, task, count, block = _pair(byte_level, pieces), TaskContext.get().partitionId(), 0, _Block()

        def end() -> pa.RecordBatch:
            made = block.closed()
            return pa.RecordBatch.from_pylist([{"block": task * RUNS + count, **made}], schema=schema)

        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                rows = list(block.take(part.column(1).to_pylist(), pair))
                columns = [[task * RUNS + count] * len(rows), part.column(0).to_pylist(), *zip(*rows, strict=True)]
                none = [None] * len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip([*columns, none, none, none, none], schema, strict=True)],
                    schema=schema,
                )
                if block.size >= block_bytes:
                    yield end()
                    count, block = count + 1, _Block()
        if block.size:
            yield end()

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in _ENCODED.split(", "))])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, _ENCODED)


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``block, place, pair, n`` of all blocks; ``pair, count, best`` over the corpus.

    ``best`` tells whether no pair with the same B id has a higher count.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs = np.frombuffer(row["pairs"], dtype="<i8")
                for low in range(0, len(pairs), 100_000):
                    part = pairs[low : low + 100_000]
                    n = np.frombuffer(row["tally"], dtype="<i8")[low : low + 100_000]
                    place = np.arange(low, low + len(part), dtype=np.int32)
                    yield pa.RecordBatch.from_pydict(
                        {"block": np.full(len(part), row["block"], dtype=np.int64), "place": place, "pair": part, "n": n}
                    )

    rows = blocks.where("pairs IS NOT NULL").select("block", "pairs", "tally").mapInArrow(
        listed, "block long, place int, pair long, n long"
    )
    counts = rows.groupBy("pair").agg(F.sum("n").alias("count")).where("count > 0")
    counts = stored(counts.withColumn("b", F.col("pair") % WIDTH))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    rated = counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    return rows, rated


def aligned(docs: DataFrame, byte_level: str, pieces: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """How the tokens of two tokenizers meet in each text: one row for each document.

    ``byte_level`` is a file of ``tokenizers``, which encodes a space and the text;
    ``pieces`` one of sentencepiece, which adds that space itself. Strings of special
    tokens are plain text. Returns ``doc_id``, ``n_a`` and ``n_b`` tokens, ``n_groups``,
    ``n_links``; ``n_best``, the links whose id pair has the highest count of its B id over
    all documents (ties included); ``count_sum``, the counts summed over the links; and
    ``groups_sha256``, the digest of the groups as ``a1,a2|b1;a3|b2,b3``.

    A text that is null, empty, or whose tokens do not join to its bytes (for example with
    the character that sentencepiece uses for a space) has no tokens: zeros and an empty
    digest. Rows with a null or repeated ``doc_id`` and repeated texts are rows of their
    own. Very long texts are whole; one of more than ``block_bytes`` makes a block of its
    size. Other columns of ``docs`` do not matter; an empty table gives no rows.
    """
    blocks = stored(encoded(docs, byte_level, pieces, block_bytes))
    rows, rated = pair_counts(blocks)
    told = rows.join(rated, "pair").select("block", "place", "count", "best")

    def summed(answers: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        is_words = members["pairs"].notna()
        own = members[~is_words]
        out = pd.DataFrame({c: own[c] for c in ("doc_id", "n_a", "n_b", "n_groups")})
        out["n_links"] = own["n_a"] + own["n_b"] - own["n_groups"]
        best, total = [0] * len(own), [0] * len(own)
        if is_words.any():
            words = members[is_words].iloc[0]
            sizes = np.frombuffer(words["sizes"], dtype="<i4")
            links = np.frombuffer(words["links"], dtype="<i4")
            counts = np.zeros((2, len(words["pairs"]) // 8), dtype=np.int64)
            counts[0, answers["place"]] = answers["count"]
            counts[1, answers["place"]] = answers["best"]
            # Running totals over the links, read where each word begins and ends.
            sums = np.concatenate([np.zeros((2, 1), dtype=np.int64), np.cumsum(counts[:, links], axis=1)], axis=1)
            ends = np.cumsum(sizes)
            by_word = sums[:, ends] - sums[:, ends - sizes]
            for k, used in enumerate(own["words"]):
                total[k], best[k] = by_word[:, np.frombuffer(used, dtype="<i4")].sum(axis=1).tolist()
        out["n_best"], out["count_sum"] = best, total
        out["groups_sha256"] = own["groups_sha256"]
        return out

    return told.groupBy("block").cogroup(blocks.groupBy("block")).applyInPandas(
        summed,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
    )
