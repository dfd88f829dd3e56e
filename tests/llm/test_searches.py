"""Token alignment and the two exact searches, against plain versions of what they define."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gradeloom.llm import alignment, lexical_search, packing, pivot_search, queries

FOLDER = "/root/testdata/sf0.001"
BYTES, PIECES = packing.tokenizer_path("byte_bpe_50k.json"), packing.tokenizer_path("piece_bpe_32k.model")


# --- alignment ---------------------------------------------------------------------------


def brute_alignment(docs: list[tuple]) -> dict:
    """Whole texts, an owner for each byte, counts in a dictionary."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(BYTES)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = alignment.byte_alphabet()
    found, counts = {}, Counter()
    for doc_id, text in docs:
        found[doc_id] = None
        if not text:
            continue
        a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
        raw_a = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
        raw_b = [
            bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i)
            else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b
        ]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            continue
        owner_a = [k for k, t in enumerate(raw_a) for _ in t]
        owner_b = [k for k, t in enumerate(raw_b) for _ in t]
        links = [(a[i], b[j]) for i, j in dict.fromkeys(zip(owner_a, owner_b, strict=True))]
        groups, i, j, low = [], 0, 0, 0
        for at in range(len(owner_a)):
            end = at + 1 == len(owner_a) or (owner_a[at] != owner_a[at + 1] and owner_b[at] != owner_b[at + 1])
            if end:
                groups.append(
                    ",".join(str(a[k]) for k in dict.fromkeys(owner_a[low : at + 1]))
                    + "|" + ",".join(str(b[k]) for k in dict.fromkeys(owner_b[low : at + 1]))
                )
                low = at + 1
        counts.update(links)
        found[doc_id] = (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return {
        doc_id: (0, 0, 0, 0, 0, 0, "") if own is None else (
            *own[:3], len(own[3]), sum(counts[x] == best[x[1]] for x in own[3]), sum(counts[x] for x in own[3]), own[4],
        )
        for doc_id, own in found.items()
    }


AWKWARD = [
    "", None, " ", "  ", "\n", "\n\n", "a", " a", "a ", "a  b", "a\nb", " \nabc", "a \n b", "x\n\ny",
    "<|endoftext|>hi</s><s><unk><0x41>", "a▁b", "▁", "é\U0001f600x \U0001f9a5\U0001fae8z",
    "don't they're I'll x's", "end. Next, one; two: 3! 4? 5", "\t\ttab\n  indent\n\treturn x",
    "日本語のテキスト。", " nb sp", "a᠎ b　c", "\x00 nul \x1c x",
    "x². y³, z;.", "é combining", "\r\n crlf\r\nx", "a" * 3000, "\U0001f9a5" * 50, "‍﻿x", "1,000.50 $3.00",
]


def rows_of(df) -> dict:
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("block", [alignment.BLOCK_BYTES, 2_000])
def test_alignment_equals_brute_force_over_awkward_and_random_texts(spark, block):
    draw, letters = random.Random(5), " \n\t.,;'aäéßZ9\U0001f9a5日 -<|>s"
    texts = AWKWARD + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 60))) for _ in range(400)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows_of(alignment.aligned(df, BYTES, PIECES, block)) == brute_alignment(docs)


def test_alignment_equals_brute_force_over_the_given_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert rows_of(queries.op11_token_alignment(spark, FOLDER)) == brute_alignment(docs)


def test_whole_texts_where_vocabularies_cannot_be_cut():
    pair = alignment.Pair(BYTES, PIECES)
    assert pair.separable
    cut = {w: r for w in AWKWARD if w for r in [_joined(pair, w)]}
    pair.separable = False
    pair.known.clear()
    assert {w: pair.align([" " + w])[0] for w in cut} == cut


def _joined(pair, text):
    parts = pair.align(pair.words(text))
    if None in parts:
        return None
    a, b, groups, texts, links = zip(*parts, strict=True)
    return sum(a), sum(b), sum(groups), ";".join(texts), b"".join(links)


def test_alignment_keeps_awkward_rows(spark, awkward, awkward_rows, nothing):
    rows = alignment.aligned(awkward, BYTES, PIECES).collect()
    assert len(rows) == len(awkward_rows)
    assert len({tuple(r) for r in rows if r.doc_id == 12}) == 1
    assert alignment.aligned(nothing, BYTES, PIECES).count() == 0


# --- lexical search ----------------------------------------------------------------------


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def brute_ranking(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    held = [(d, Counter(plain_terms(t))) for d, t in docs if plain_terms(t)]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df, out = Counter(t for _, c in held for t in c), []
    for item, text in items:
        scores = []
        for doc_id, c in held:
            m = 100 - 90 + (90 * c.total() * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(plain_terms(text)) if t in c
            )
            if score > 0:
                scores.append((-score, doc_id))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def listed(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.collect())


def test_terms_are_the_defined_ones():
    for text in ["A_b9 Äé-x\x85y z\U0001f600 `~{|}", "", None, "\x7f\x00", "ABCK"]:
        assert [t.decode() for t in lexical_search.terms(text)] == plain_terms(text)


def test_search_equals_brute_force_over_the_given_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert listed(queries.op12_sketch_search(spark, FOLDER)) == brute_ranking(docs, items)


@pytest.mark.parametrize(("coordinates", "terms"), [(1 << 20, 200_000), (64, 60)])
def test_search_is_exact_with_copies_ties_crowded_sketches_and_blocks(spark, coordinates, terms):
    """A third of all rows are copies; 64 coordinates make nearly every bound too high."""
    draw = random.Random(1)
    words = [f"w{i}" for i in range(300)] + ["Ü", "é1", "A_B"]
    docs = [(i, " ".join(draw.choice(words[: draw.choice([5, 40, 303])]) for _ in range(draw.randint(0, 80)))) for i in range(400)]
    docs += [(1000 + i, "w1 w2 w2 w200") for i in range(200)]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 20)))) for i in range(6)]
    items += [(50, "w1 w2 w200"), (51, None), (52, "!!"), (53, "nowhere")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert listed(lexical_search.ranked(df, asked, 10, coordinates, terms)) == brute_ranking(docs, items)


def test_a_number_beyond_the_sketch_bounds_its_score():
    text = {b"x": 70_000, b"y": 2}
    at, n = lexical_search.sketch(text, lexical_search._Coordinates(1 << 20))
    found = lexical_search._Queries([(1, "x", 3), (1, "y", 5), (2, "y", 7)])
    part = lexical_search.length_part(70_002, 10, 100_000)
    bounds = found.bounds([(at, n)], np.array([part]))[0]
    exact = [3 * lexical_search.impact(70_000, part) + 5 * lexical_search.impact(2, part), 7 * lexical_search.impact(2, part)]
    assert (bounds >= exact).all() and bounds[0] <= 3 * 10**6 + exact[1]


def test_search_takes_awkward_and_empty_tables(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "a b one"), (None, "one"), (2, "")], "item_id long, text string")
    rows = listed(lexical_search.ranked(awkward, items))
    assert rows and all(r[0] == 1 and r[2] is not None for r in rows)
    assert len({r[2] for r in rows}) == len(rows)
    assert listed(lexical_search.ranked(nothing, items)) == []
    assert listed(lexical_search.ranked(awkward, items.where("false"))) == []


# --- pivot search ------------------------------------------------------------------------


def brute_nearest(rows: list[tuple], k: int = 20) -> list[tuple]:
    taken = {(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    whole, out = [(i, [math.floor(64 * c) for c in v]) for i, v in taken], []
    for i, q in whole:
        if i % 20 == 0:
            best: dict[int, int] = {}
            for j, x in whole:
                if j != i and len(x) == len(q):
                    product = sum(a * b for a, b in zip(q, x, strict=True))
                    best[j] = max(best.get(j, product), product)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted((-s, j) for j, s in best.items())[:k], 1)]
    return sorted(out)


def test_nearest_equals_brute_force_over_the_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    assert listed(queries.op13_pivot_search(spark, FOLDER)) == brute_nearest(rows)


def test_nearest_is_exact_with_copies_ties_lengths_and_bad_vectors(spark):
    draw = random.Random(3)
    rows = [(i, [draw.choice([0.0, 0.5, -0.5, 0.25, 3.0]) for _ in range(draw.choice([3, 3, 3, 5]))]) for i in range(500)]
    rows += [(700 + i, [1.0, 1.0, 1.0]) for i in range(250)]
    rows += [
        (2000, None), (2001, []), (None, [1.0, 2.0, 3.0]), (2002, [float("nan"), 1.0, 1.0]), (2003, [None, 1.0, 1.0]),
        (2020, [0.0, 0.0, 0.0]), (2021, [float("inf"), 0.0, 0.0]), (5, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.0]), (40, [9.0] * 7),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = pivot_search.exact_nearest(df, shard_vectors=100, query_block=7, pivots=8)
    assert listed(found) == brute_nearest(rows)
    assert pivot_search.exact_nearest(df.where("false")).count() == 0


def test_bounds_hold_and_stop_early_where_vectors_are_apart():
    draw = np.random.default_rng(1)
    centres = draw.integers(-400, 400, size=(40, 4))
    x = (centres[draw.integers(0, 40, 4000)] + draw.integers(-3, 4, size=(4000, 4))).astype(np.float64)
    longest = float((x * x).sum(axis=1).max())
    pivots = pivot_search.chosen_pivots(pivot_search.lengthened(x[:500], longest), 32)
    table = pivot_search.distances(pivot_search.lengthened(x, longest), pivots).T.astype(np.float32)
    # Queries as long as the longest candidate: the direction decides.
    q = x[::400] * np.sqrt(longest / (x[::400] ** 2).sum(axis=1))[:, None] // 1
    to_query = pivot_search.distances(np.column_stack([q, np.zeros(len(q))]), pivots).astype(np.float32)
    bounds = pivot_search.upper_bounds(to_query, table, (q * q).sum(axis=1), longest)
    assert (bounds >= q @ x.T).all()
    assert [pivot_search.product_type(n) for n in (5.0, 2.0**24, 2.0**60)] == [np.float32, np.float64, np.int64]
    ids, first, looked = np.arange(4000), np.arange(4001), []
    for one, bound in zip(q, bounds, strict=True):
        vec, score, done = pivot_search.answer(one, -1, bound, x, ids, first, -np.inf, 20)
        order = np.lexsort((ids, -(x @ one)))[:20]
        assert vec.tolist() == order.tolist() and score.tolist() == (x @ one)[order].astype(int).tolist()
        looked.append(done)
    assert np.mean(looked) < 2500


def test_units_met_again_are_not_encoded_again(monkeypatch):
    """More units than are remembered, and some that all batches hold: those are encoded once."""
    monkeypatch.setattr(alignment, "REMEMBERED", 300)
    pair, encoded = alignment.Pair(BYTES, PIECES), []
    made = pair._aligned
    monkeypatch.setattr(pair, "_aligned", lambda units: (encoded.extend(units), made(units))[1])
    often = [" " + "abcdefghij"[i] * 3 for i in range(10)]
    for batch in range(12):
        words = [*often, *(f" word{batch}x{i}" for i in range(100))]
        assert pair.align(words) == [alignment.Pair.align(pair, [w])[0] for w in words]
    assert all(encoded.count(w) == 1 for w in often)
    assert len(pair.known) + len(pair.earlier) <= 600


def test_cuts_before_words_are_those_of_the_pattern():
    pair = alignment.Pair(BYTES, PIECES)
    assert pair.separable
    parts = ["a", "b.", " ", "  ", "\n", "\t", "᠎", "　", "\x1c", "é", "▁", "-"]
    draw = np.random.default_rng(3)
    for _ in range(5000):
        text = "".join(parts[i] for i in draw.integers(0, len(parts), draw.integers(0, 9)))
        assert pair.words(text) == alignment._WORDS.split(" " + text)
