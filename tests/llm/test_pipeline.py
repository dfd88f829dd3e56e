"""The pipeline's stages, each held against what it was given."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from gradeloom.llm.shared import stored

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stored(stage(spark, docs, FOLDER))
    return {name: df.collect() for name, df in out.items()}


def test_stages_keep_the_columns_of_documents(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert list(stages[name][0].asDict()) == corpus_pipeline.COLUMNS


def test_rejected_documents_go_and_good_ones_stay(stages):
    labels = dict(duckdb.sql(f"select doc_id, quality from '{FOLDER}/labels.parquet'").fetchall())
    kept = {r.doc_id for r in stages["quality"]}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.98 * len(good)
    assert sum(i in kept for i in bad) <= 0.05 * len(bad)


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_one_document_of_each_near_group_stays(stages):
    before = {r.doc_id: shingles(r.text) for r in stages["quality"]}
    kept = {r.doc_id for r in stages["near duplicates"]}
    found = missed = 0
    for i, own in before.items():
        best = max((len(own & o) / len(own | o) for j, o in before.items() if j < i and own & o), default=0)
        if best < 0.8:
            assert i in kept
        else:
            found += 1
            missed += i in kept
    assert missed <= max(1, 0.1 * found)


def test_personal_data_is_replaced_in_place(stages):
    before = {r.doc_id: r for r in stages["near duplicates"]}
    after = {r.doc_id: r for r in stages["personal data"]}
    assert set(before) == set(after)
    changed = 0
    for i, r in after.items():
        assert (r.lang, r.source, r.n_chars) == (before[i].lang, before[i].source, len(r.text))
        changed += r.text != before[i].text
    assert 0 < changed < 0.5 * len(after)


def test_the_mixture_loses_no_document_and_packing_no_token(stages):
    before = {r.doc_id for r in stages["personal data"]}
    mixed = [r.doc_id for r in stages["mixing"]]
    assert set(mixed) == before
    pieces = stages["packing"]
    total = {r.doc_id: r.doc_tokens for r in pieces}
    assert sum(r.length for r in pieces) == sum(total[i] for i in mixed)


def test_run_is_the_stages_in_a_row(spark, stages):
    rows = __spark_entry__.queries()["pipeline"](spark, FOLDER).collect()
    key = ["doc_id", "doc_tokens", "length"]
    assert sum(r.length for r in rows) == sum(r.length for r in stages["packing"])
    assert {r.doc_id for r in rows} == {r.doc_id for r in stages["packing"]} and all(k in rows[0] for k in key)


def test_every_dealt_operator_is_registered_once():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
