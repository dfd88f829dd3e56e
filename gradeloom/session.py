"""A session with the settings the operators expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gradeloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all
    runs in one process, as in tests, a local folder is used; on a cluster its executors
    could not see it, so there a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all of {master} can reach")
        named = tempfile.mkdtemp(prefix="gradeloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    spark.sparkContext.setCheckpointDir(named)
    return named


def written(rows: DataFrame) -> DataFrame:
    """The rows written to the shared folder as Parquet and read again.

    They stay as they are, like those of a checkpoint, in a fraction of its bytes.
    """
    spark = rows.sparkSession
    target = f"{checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(target)
    return spark.read.schema(rows.schema).parquet(target)
