"""Staged writes: scoped overwrites and releases that count whole or not at all."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import planning
from gradeloom.session import checkpoint_dir
from gradeloom.sources import sinks, staging
from gradeloom.streaming import doneness

DDL = "course_id string, assignment_id string, status string"


def rows_in(spark, target):
    return sorted((r.course_id, r.assignment_id, r.status) for r in sinks.read_scoped(spark, target, DDL).collect())


@pytest.fixture
def target(spark, tmp_path):
    path = str(tmp_path / "table")
    old = [("C", "A", "old"), ("C", "B", "old"), ("D", "A", "old")]
    sinks.write_scoped(spark.createDataFrame(old, DDL), path)
    return path


def test_rows_may_come_from_the_target_itself(spark, target):
    again = spark.read.schema(DDL).parquet(target).withColumn("status", F.concat("status", F.lit("+")))
    sinks.write_scoped(again, target, [("C", "A")])
    assert rows_in(spark, target) == [("C", "A", "old+"), ("C", "B", "old"), ("D", "A", "old")]


def test_a_failed_write_leaves_the_old_rows(spark, target):
    broken = spark.createDataFrame([("C", "A", "new")], DDL).withColumn(
        "status", F.when(F.col("status") == "new", F.raise_error(F.lit("no"))).otherwise(F.col("status"))
    )
    with pytest.raises(Exception, match="no"):
        sinks.write_scoped(broken, target, [("C", "A"), ("C", "B")])
    assert rows_in(spark, target) == [("C", "A", "old"), ("C", "B", "old"), ("D", "A", "old")]
    # What it staged is dropped by the next write.
    sinks.write_scoped(spark.createDataFrame([("D", "A", "new")], DDL), target)
    assert staging.Files(spark, target).names(staging.STAGED) == []
    assert rows_in(spark, target)[2] == ("D", "A", "new")


@pytest.mark.parametrize("before_failure", [1, 2, 3])
def test_an_interrupted_commit_is_completed_by_the_next_reader(spark, target, monkeypatch, before_failure):
    real, calls = staging.Files.rename, []

    def failing(self, old, new):
        calls.append(old)
        if len(calls) > before_failure:
            raise OSError("driver lost")
        real(self, old, new)

    monkeypatch.setattr(staging.Files, "rename", failing)
    new = spark.createDataFrame([("C", "A", "new"), ("C", "B", "new")], DDL)
    scope = [("C", "A"), ("C", "B"), ("D", "A")]
    with pytest.raises(OSError, match="lost"):
        sinks.write_scoped(new, target, scope)
    monkeypatch.undo()
    # The first rename is the commit.
    assert rows_in(spark, target) == [("C", "A", "new"), ("C", "B", "new")]
    assert staging.Files(spark, target).names(staging.STAGED) == []


def test_a_write_that_never_committed_does_not_count(spark, target, monkeypatch):
    def failing(self, old, new):
        raise OSError("driver lost")

    monkeypatch.setattr(staging.Files, "rename", failing)
    with pytest.raises(OSError, match="lost"):
        sinks.write_scoped(spark.createDataFrame([("C", "A", "new")], DDL), target)
    monkeypatch.undo()
    assert rows_in(spark, target)[0] == ("C", "A", "old")


def test_jobs_do_not_grow_with_the_names_in_scope(spark, target):
    def jobs(scope):
        context = spark.sparkContext
        context.setJobGroup(f"scope-{len(scope)}", "")
        sinks.write_scoped(spark.createDataFrame([("C", "A", "new")], DDL), target, scope)
        context.setJobGroup("", "")
        return len(context.statusTracker().getJobIdsForGroup(f"scope-{len(scope)}"))

    assert jobs([("C", "A"), *[("E", f"n{i}") for i in range(30)]]) == jobs([("C", "A"), ("E", "x")])
    assert rows_in(spark, target) == [("C", "A", "new"), ("C", "B", "old"), ("D", "A", "old")]


def test_a_cluster_without_a_shared_folder_is_told_so():
    class Conf(dict):
        def set(self, name, value):
            self[name] = value

    def session(master, **conf):
        context = SimpleNamespace(master=master, setCheckpointDir=lambda path: None)
        return SimpleNamespace(sparkContext=context, conf=Conf(conf))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(session("spark://host:7077"))
    assert checkpoint_dir(session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://x"})) == "hdfs://x"
    assert checkpoint_dir(session("local[4]"))


# --- releases ----------------------------------------------------------------------------


@pytest.fixture
def release_of(spark, tmp_path):
    source = tmp_path / "roster.csv"
    source.write_text("Username\n")
    entries = spark.createDataFrame([("ann", "{}")], "username string, entry string")

    def write(name, grade="5", entries=entries):
        grades = spark.createDataFrame([("ann", grade), ("bob", None)], "Username string, Grade string")
        target = str(tmp_path / "releases")
        sinks.write_release(entries, {"grades": grades}, target, name, [str(source)])
        return target

    return write


def test_manifest_tells_every_input_and_output(spark, release_of):
    target = release_of("r1")
    told = spark.read.json(f"{target}/r1/manifest/outputs").collect()
    assert {(r.output, r.rows) for r in told} == {("grades", 2)} and all(len(r.sha256) == 64 for r in told)
    (source,) = spark.read.json(f"{target}/r1/manifest/inputs").collect()
    assert source.path.endswith("roster.csv") and source.length == 9
    assert spark.read.json(f"{target}/r1/manifest/entries").first().username == "ann"
    assert sinks.changed_files(spark, target, "r1").count() == 0


def test_a_changed_byte_changes_the_manifest_and_is_found(spark, release_of, tmp_path):
    target = release_of("r1")
    release_of("r2", grade="6")

    def digests(name):
        return {(r.sha256, r.rows_digest) for r in spark.read.json(f"{target}/{name}/manifest/outputs").collect()}

    assert not digests("r1") & digests("r2")
    part = next(p for p in sorted((tmp_path / "releases/r1/grades").glob("part-*.csv")) if "ann" in p.read_text())
    part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
    part.write_text(part.read_text().replace("5", "9"))
    assert [r.file for r in sinks.changed_files(spark, target, "r1").collect()] == [part.name]
    part.unlink()
    assert [r.found_sha256 for r in sinks.changed_files(spark, target, "r1").collect()] == [None]


def test_an_interrupted_release_leaves_none(spark, release_of, monkeypatch):
    broken = spark.range(1).select(F.raise_error(F.lit("no")).cast("string").alias("username"))
    with pytest.raises(Exception, match="no"):
        release_of("r1", entries=broken)
    target = release_of("r2")
    files = staging.Files(spark, target)
    assert [n for n in files.names() if not n.startswith("_")] == ["r2"] and files.names(staging.STAGED) == []
    with pytest.raises(FileExistsError):
        release_of("r2")


def test_row_digest_does_not_depend_on_the_layout(spark):
    table = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("x"))
    digests = {tuple(sinks.row_digests(t).first()) for t in (table, table.orderBy(F.desc("id")), table.repartition(7))}
    assert len(digests) == 1
    assert tuple(sinks.row_digests(table.where("id != 5")).first()) not in digests
    assert tuple(sinks.row_digests(table.limit(0)).first()) == (0, "0")


# --- folders of a stream -----------------------------------------------------------------


def test_folders_stay_few_and_are_rarely_written_again():
    sizes, written = [], 0
    for batch in range(3000):
        if chosen := doneness.folders_to_merge(sizes):
            merged = sum(s for b, s in sizes if b in chosen)
            sizes = [(b, s) for b, s in sizes if b not in chosen] + [(max(chosen), merged)]
            written += merged
        sizes.append((batch, 10))
        assert len(sizes) <= 40
    assert sum(s for _, s in sizes) == 30_000 and written < 8 * 30_000
    assert doneness.folders_to_merge([(0, 10**6), *[(b, 1) for b in range(1, 6)]]) == []


@pytest.fixture
def folded(spark, make_trials, tmp_path):
    source, table, progress = (str(tmp_path / n) for n in ("trials", "table", "progress"))

    def fold(*names):
        rows = [{"trial_name": n, "item_id": f"X{n[-1]}"} for n in names]
        make_trials(*rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(make_trials().schema).parquet(source)
        doneness.fold_trials(stream, "grade", table, progress).awaitTermination()

    fold.table, fold.progress = table, tmp_path / "progress"
    fold.want = lambda *names: sorted(
        map(tuple, planning.done_totals(make_trials(*[{"trial_name": n, "item_id": f"X{n[-1]}"} for n in names]), "grade").collect())
    )
    fold.got = lambda: sorted(map(tuple, doneness.stored_totals(spark, table).collect()))
    return fold


def test_many_batches_leave_few_folders(spark, folded):
    names = [f"t{i}" for i in range(11)]
    for k, name in enumerate(names):
        folded(name, names[max(0, k - 3)])
    folders = [n for n in staging.Files(spark, folded.table).names() if n.startswith("batch=")]
    assert len(folders) < doneness.MERGED and folded.got() == folded.want(*names)


@pytest.mark.parametrize("at", ["before the commit", "between the folders", "after the batch"])
def test_a_driver_lost_while_merging_changes_nothing(spark, folded, monkeypatch, at):
    names = [f"t{i}" for i in range(doneness.MERGED + 1)]
    for name in names[:-1]:
        folded(name)
    real, calls = staging.Files.rename, []

    def failing(self, old, new):
        calls.append(old)
        if len(calls) > (0 if at == "before the commit" else 1):
            raise OSError("driver lost")
        real(self, old, new)

    if at == "after the batch":
        folded(names[-1], names[0])
        # The batch is done, and the stream has not written that down.
        last = max((folded.progress / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        last.unlink()
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
        folded(names[1])
    else:
        monkeypatch.setattr(staging.Files, "rename", failing)
        with pytest.raises(Exception, match="lost"):
            folded(names[-1], names[0])
        monkeypatch.undo()
        assert folded.got() == folded.want(*names[:-1])
        folded(names[1])
    assert folded.got() == folded.want(*names)
