from __future__ import annotations

import datetime
import hashlib
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import digests, spread
from gradeloom.operators.spread import (
    exact_quantiles,
    grouped_with_median,
    join_on_keys,
    median_of,
    numbered,
    value_counts,
    with_median_ranks,
    with_previous,
)


def test_quantiles_equal_linear_interpolation_with_a_hot_key(spark):
    rng = random.Random(5)
    groups = {"hot": [rng.choice([rng.uniform(0, 100), 50.0]) for _ in range(3000)], "one": [7.0],
              "two": [1.0, 2.0], None: [3.0, 9.0, 10.0]}
    rows = [(k, x) for k, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "k string, x double")
    wanted = {"q25": 0.25, "median": 0.5, "q75": 0.75, "top": 1.0}
    result = exact_quantiles(value_counts(df, ["k"], "x"), ["k"], "x", wanted).collect()
    assert len(result) == len(groups)
    for row in result:
        for name, p in wanted.items():
            assert row[name] == pytest.approx(np.quantile(groups[row.k], p))


def test_numbers_are_consecutive_per_key(spark):
    rows = [(i % 3, i * 7 % 1000) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, x int").distinct()
    out = numbered(df, ["k"], ["x"], "n").collect()
    for key in range(3):
        ordered = sorted((r for r in out if r.k == key), key=lambda r: r.x)
        assert [r.n for r in ordered] == list(range(1, len(ordered) + 1))


def test_numbers_follow_any_order_of_random_rows(spark):
    draw = random.Random(11)
    rows = [
        (draw.choice(["a", None]), draw.choice([0.1, 0.25, 1 / 3, None]), f"same beginning {draw.random()}")
        for _ in range(2000)
    ]
    df = spark.createDataFrame(rows, "k string, x double, name string")
    order = [F.col("x").desc_nulls_last(), F.col("name").asc()]
    out = numbered(df, ["k"], order, "n").collect()
    for key in ("a", None):
        mine = [r for r in out if r.k == key]
        mine.sort(key=lambda r: (r.x is None, -(r.x or 0), r.name))
        assert [r.n for r in mine] == list(range(1, len(mine) + 1))
    # Names that all begin alike still fill many ranges.
    spread_out = df.repartitionByRange(4, "k", *order).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in spread_out) < 0.5 * len(rows)


def _largest_range(spark, df, keys, order):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(tasks, *keys, *order).groupBy(F.spark_partition_id()).count()
    return max(r["count"] for r in dealt.collect()) / df.count()


def test_previous_row_crosses_ranges(spark):
    rows = [("a", x) for x in (1, 2, 15, 99, 100)] + [("b", 50), (None, 3), (None, 4)]
    df = spark.createDataFrame(rows, "k string, x int")
    out = with_previous(df, ["k"], ["x"], ["x"]).collect()
    got = {(r.k, r.x): r.previous and r.previous.x for r in out}
    assert got == {("a", 1): None, ("a", 2): 1, ("a", 15): 2, ("a", 99): 15, ("a", 100): 99,
                   ("b", 50): None, (None, 3): None, (None, 4): 3}


def test_a_third_of_all_versions_on_one_path_and_day(spark):
    """One path is uploaded again and again within a day; no range holds all of it."""
    start = datetime.datetime(2024, 5, 1)
    hot = [("hot", start + datetime.timedelta(seconds=i), f"d{i % 7}") for i in range(3000)]
    rest = [(f"p{i % 500}", start + datetime.timedelta(hours=i), "d") for i in range(6000)]
    df = spark.createDataFrame(hot + rest, "k string, at timestamp_ntz, digest string").repartition(7)
    out = with_previous(df, ["k"], ["at"], ["digest", "at"]).where("k = 'hot'").orderBy("at").collect()
    assert [r.previous and (r.previous.digest, r.previous.at) for r in out] == [
        None, *[(d, at) for _, at, d in hot[:-1]]
    ]
    # Versions of one moment in the key and a third of all rows still fill several ranges.
    assert _largest_range(spark, df, ["k"], ["at"]) < 0.5


def test_median_of_an_item_with_a_third_of_all_rows(spark):
    draw = random.Random(4)
    values = {"hot": [draw.random() for _ in range(3001)], None: [5.0], "two": [1.0, 2.0]}
    values |= {f"k{i}": [float(draw.randint(0, 3)) for _ in range(draw.randint(1, 40))] for i in range(300)}
    rows = [(k, x) for k, own in values.items() for x in own]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    counts = value_counts(df, ["k"], "x")
    found = with_median_ranks(counts, ["k"], "x").groupBy("k").agg(median_of().alias("m"))
    assert {r.k: r.m for r in found.collect()} == {k: statistics.median(own) for k, own in values.items()}
    assert _largest_range(spark, counts, ["k"], ["x"]) < 0.5


@pytest.mark.parametrize("crowded", [spread.CROWDED, 20])
def test_grouped_median_by_key_and_by_ranges(spark, tmp_path, monkeypatch, crowded):
    """Keys of few rows share one shuffle; larger ones go by ranges; both give the same rows."""
    monkeypatch.setattr(spread, "CROWDED", crowded)
    draw = random.Random(8)
    values = {("hot", None): [draw.random() for _ in range(501)], (None, "x"): [5.0, 5.0], ("two", "y"): [1.0, 2.0]}
    values |= {(f"k{i}", None): [float(draw.randint(0, 3)) for _ in range(draw.randint(1, 40))] for i in range(60)}
    rows = [(*k, x) for k, own in values.items() for x in own]
    spark.createDataFrame(rows, "k string, l string, x double").write.parquet(f"{tmp_path}/rows")
    stored = spark.read.parquet(f"{tmp_path}/rows")
    above = F.count_if(F.col("x") > F.col("median")).alias("above")
    found = grouped_with_median(
        stored, ["k", "l"], "x", [F.count(F.lit(1)).alias("n"), F.max("median").alias("m"), above]
    )
    shuffles = found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert (shuffles == 1) == (crowded > 20)
    assert {(r.k, r.l): (r.n, r.m, r.above) for r in found.collect()} == {
        k: (len(own), statistics.median(own), sum(x > statistics.median(own) for x in own))
        for k, own in values.items()
    }


def test_null_keys_join(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("b", 20)], "k string, y int")
    assert {(r.k, r.x, r.y) for r in join_on_keys(left, right, ["k"]).collect()} == {(None, 1, 10)}
    assert join_on_keys(left, right, ["k"], "left_anti").count() == 1


def test_directory_digest_is_the_documented_hash(spark):
    files = {"d1": {"b.txt": "22", "a/é.txt": "11"}, "d2": {"x": "33"}}
    rows = [(d, p, h) for d, m in files.items() for p, h in m.items()]
    manifest = spark.createDataFrame(rows, "dir string, relpath string, digest string")
    result = {r.dir: r for r in digests.directory_digests(manifest, ["dir"]).collect()}
    for name, content in files.items():
        h = hashlib.sha256(b"aat-dir-sha256-v1\0")
        for path, digest in sorted(content.items()):
            h.update(path.encode() + b"\0" + digest.encode() + b"\n")
        assert result[name].sha256 == h.hexdigest() and result[name].n_files == len(content)


def test_large_directories_are_hashed_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = [("big", f"f{i:05d}", f"{i:x}") for i in range(2500)] + [("small", "a", "1")]
        manifest = spark.createDataFrame(rows, "dir string, relpath string, digest string")
        result = {r.dir: r for r in digests.directory_digests(manifest, ["dir"]).collect()}
        h = hashlib.sha256(b"aat-dir-sha256-v1\0")
        for _, path, digest in rows[:-1]:
            h.update(f"{path}\0{digest}\n".encode())
        assert result["big"].sha256 == h.hexdigest() and result["big"].n_files == 2500
        assert result["small"].n_files == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
