"""Directory digests and comparisons of file manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom import constants as C
from gradeloom.functions.predicates import is_bookkeeping_path, known


def directory_digests(
    manifest: DataFrame, keys: Sequence[str], path: str = "relpath", digest: str = "digest"
) -> DataFrame:
    """SHA-256 over each directory's sorted ``path NUL digest LF`` entries.

    Spark shuffles by directory and sorts; the hash is then fed batch by batch,
    so a directory of any size needs the memory of one Arrow batch. The digest is
    sequential by definition, hence one task per directory; file contents were
    hashed in parallel before.
    """
    keys = list(keys)
    entry = F.concat(F.col(path), F.unhex(F.lit("00")).cast("string"), F.col(digest), F.lit("\n"))
    ordered = (
        manifest.select(*[F.col(k).cast("string").alias(k) for k in keys], path, entry.alias("entry"))
        .repartition(*keys)
        .sortWithinPartitions(*keys, path)
        .drop(path)
    )

    def hash_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, hasher, count = None, None, 0

        def finished() -> pd.DataFrame:
            return pd.DataFrame([[*current, hasher.hexdigest(), count]], columns=[*keys, "sha256", "n_files"])

        for batch in batches:
            done = []
            for key, entries in batch.groupby(keys, sort=False, dropna=False)["entry"]:
                if key != current:
                    if current is not None:
                        done.append(finished())
                    current, count = key, 0
                    hasher = hashlib.sha256((C.DIRECTORY_HASH_HEADER + "\0").encode())
                hasher.update("".join(entries).encode("utf-8"))
                count += len(entries)
            if done:
                yield pd.concat(done)
        if current is not None:
            yield finished()

    schema = T.StructType(
        [T.StructField(k, T.StringType()) for k in keys]
        + [T.StructField("sha256", T.StringType()), T.StructField("n_files", T.LongType())]
    )
    return ordered.mapInPandas(hash_runs, schema)


def bookkeeping_entries(manifest: DataFrame) -> DataFrame:
    """Long form: every file whose path has a bookkeeping part."""
    return manifest.where(is_bookkeeping_path(F.col("relpath"))).select("dir", "relpath")


def contract_violations(manifest: DataFrame, inputs: DataFrame) -> DataFrame:
    """Per submission directory, why it breaks the output contract.

    ``inputs`` are the files handed out with the task. A directory whose every
    file is an unchanged copy of one of them holds no work.
    """
    given = inputs.select("dir", "relpath", F.col("digest").alias("given_digest"))
    counted = (
        manifest.join(given, ["dir", "relpath"], "left")
        .withColumn("bookkeeping", is_bookkeeping_path(F.col("relpath")))
        .groupBy("dir")
        .agg(
            F.count_if(~F.col("bookkeeping")).alias("n_files"),
            F.count_if("bookkeeping").alias("n_bookkeeping"),
            F.count_if(
                ~F.col("bookkeeping") & ~known(F.col("digest") == F.col("given_digest"))
            ).alias("n_changed"),
        )
    )
    codes = F.array_compact(
        F.array(
            F.when(F.col("n_bookkeeping") > 0, "bookkeeping_entries"),
            F.when(F.col("n_files") == 0, "no_files"),
            F.when((F.col("n_files") > 0) & (F.col("n_changed") == 0), "all_files_unchanged"),
        )
    )
    return counted.withColumn("violations", codes)


def conflicting_values(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys that carry more than one distinct value, with the two extremes."""
    return (
        rows.groupBy(*keys)
        .agg(F.min(value).alias("lowest"), F.max(value).alias("highest"))
        .where(F.col("lowest") != F.col("highest"))
    )


def requested_but_absent(
    requested: DataFrame, available: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Requested keys without any available row."""
    return requested.join(available.select(*keys), list(keys), "left_anti")


def source_status(
    raw_digests: DataFrame,
    receipts: DataFrame,
    requested: DataFrame | None = None,
) -> DataFrame:
    """Per course, whether its raw dump still has to be processed.

    A receipt counts when its digest is the dump's and its scope covers the
    request: no recorded scope covers all, a recorded one only the assignments
    it lists. ``requested`` holds (course_id, assignment_ids); without a row a
    course is requested whole.
    """
    joined = raw_digests.join(receipts, "course_id", "left")
    if requested is None:
        wanted = F.lit(None).cast("array<string>")
    else:
        joined = joined.join(requested, "course_id", "left")
        wanted = F.col("assignment_ids")
    in_scope = F.col("scope").isNull() | known(
        F.size(F.array_except(wanted, F.col("scope"))) == 0
    )
    done = known(F.col("receipt_sha256") == F.col("sha256")) & in_scope
    return joined.select("course_id", F.when(done, "done").otherwise("pending").alias("status"))
