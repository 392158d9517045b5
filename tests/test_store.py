"""Runs that die half-way, deletion and compaction of the run store."""

import os

import pytest
from pyspark.sql import functions as F

from tabscope.sources import artifacts
from tabscope.sources.artifacts import compact, drop_superseded, expire_runs, load_artifact, lookup_run, sweep, write_artifact, write_profile
from tabscope.sources.files import Files


def failing(spark, after=0):
    """Rows until a task dies."""
    return spark.range(10).select(F.when(F.col("id") >= after, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def folders(base, key):
    path = f"{base}/data/{key}"
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def test_a_rerun_that_dies_leaves_the_earlier_run(spark, tmp_path):
    base = str(tmp_path / "runs")
    write_profile({"a": spark.range(2), "b": spark.range(3)}, base, "k", {"t": 1}, "1")
    with pytest.raises(Exception, match="lost"):
        write_profile({"a": spark.range(7), "b": failing(spark, 5)}, base, "k", {"t": 1}, "1")
    assert ids(load_artifact(spark, base, "k", "a")) == [0, 1]
    assert ids(load_artifact(spark, base, "k", "b")) == [0, 1, 2]
    assert lookup_run(spark, base, "k") and len(folders(base, "k")) == 2
    # What is left of it goes once nothing has touched it for long enough.
    assert sweep(spark, base) == 0 and sweep(spark, base, grace_hours=0) == 1
    assert len(folders(base, "k")) == 1 and ids(load_artifact(spark, base, "k", "a")) == [0, 1]


def test_a_first_run_that_dies_is_not_found(spark, tmp_path):
    base = str(tmp_path / "runs")
    with pytest.raises(Exception, match="lost"):
        write_profile({"a": spark.range(2), "b": failing(spark)}, base, "k")
    assert load_artifact(spark, base, "k", "a") is None and not lookup_run(spark, base, "k")
    assert sweep(spark, base, grace_hours=0) == 1 and folders(base, "k") == []


def test_single_results_and_reruns(spark, tmp_path):
    base = str(tmp_path / "runs")
    write_artifact(spark.range(1), base, "k", "a")
    write_artifact(spark.range(2), base, "k", "b")
    assert not lookup_run(spark, base, "k")
    artifacts.store_run(spark, base, "k", {}, "1")
    assert lookup_run(spark, base, "k")
    write_artifact(spark.range(5), base, "k", "a")
    assert ids(load_artifact(spark, base, "k", "a")) == [0, 1, 2, 3, 4] and ids(load_artifact(spark, base, "k", "b")) == [0, 1]
    assert drop_superseded(spark, base) == 1
    assert len(folders(base, "k")) == 2 and lookup_run(spark, base, "k")
    assert ids(load_artifact(spark, base, "k", "a")) == [0, 1, 2, 3, 4]


def test_expired_folders_are_gone(spark, tmp_path):
    base = str(tmp_path / "runs")
    write_profile({"a": spark.range(2)}, base, "k")
    write_profile({"a": spark.range(2)}, base, "j")
    assert expire_runs(spark, base) == 0 and folders(base, "k")
    assert expire_runs(spark, base, ttl_days=0) == 2
    assert folders(base, "k") == folders(base, "j") == []
    assert load_artifact(spark, base, "k", "a") is None and not lookup_run(spark, base, "k")
    assert artifacts.manifest(spark, base).count() == 0 and expire_runs(spark, base, ttl_days=0) == 0
    write_profile({"a": spark.range(4)}, base, "k")
    assert ids(load_artifact(spark, base, "k", "a")) == [0, 1, 2, 3]


def test_a_deletion_that_dies_hides_the_run_first(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "runs")
    write_profile({"a": spark.range(2)}, base, "k")
    with monkeypatch.context() as m:
        m.setattr(Files, "delete", lambda self, path: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            expire_runs(spark, base, ttl_days=0)
    assert not lookup_run(spark, base, "k") and load_artifact(spark, base, "k", "a") is None
    assert folders(base, "k") and sweep(spark, base, grace_hours=0) == 1 and not folders(base, "k")


def test_a_manifest_line_is_whole_or_not_there(spark, tmp_path):
    base = str(tmp_path / "runs")
    files = Files(spark, base)
    files.publish(f"{base}/manifest/lines/x.json", '{"attempt": "x", "key": "k", "complete": true, "stored_micros": 1}\n')
    # A draft that was never renamed has a hidden name, which readers pass over.
    (tmp_path / "runs/manifest/lines/.y.json-0").write_text('{"attempt": "y", "key": "k", "comp')
    assert artifacts.attempts(spark, base).count() == 1


def test_compaction_keeps_the_runs_in_few_files(spark, tmp_path):
    base = str(tmp_path / "runs")
    for i in range(5):
        write_profile({"a": spark.range(i + 1)}, base, f"k{i}")
    expire = artifacts.attempts(spark, base).filter("key = 'k0'")
    assert artifacts._remove(spark, base, expire.select("key", "attempt")) == 1
    before = artifacts.manifest(spark, base).count()
    # Within the grace nothing is deleted, and what is in both places counts once.
    assert compact(spark, base) == 0 and artifacts.manifest(spark, base).count() == before == 4
    assert compact(spark, base, grace_hours=0) >= 6
    assert [f for f in os.listdir(f"{base}/manifest/lines") if f.endswith(".json")] == []
    assert [f for f in os.listdir(f"{base}/manifest/removed") if f.endswith(".json")] == []
    assert len(os.listdir(f"{base}/manifest/snapshots")) == 1
    assert artifacts.manifest(spark, base).count() == 4 and load_artifact(spark, base, "k0", "a") is None
    assert ids(load_artifact(spark, base, "k3", "a")) == [0, 1, 2, 3]
    write_profile({"a": spark.range(9)}, base, "k3")
    assert len(ids(load_artifact(spark, base, "k3", "a"))) == 9
    assert compact(spark, base, grace_hours=0) == 2 and len(ids(load_artifact(spark, base, "k3", "a"))) == 9


def test_a_compaction_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "runs")
    for i in range(3):
        write_profile({"a": spark.range(i + 1)}, base, f"k{i}")
    with monkeypatch.context() as m:
        m.setattr(Files, "delete", lambda self, path: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            compact(spark, base, grace_hours=0)
    # A snapshot that was not finished is not read.
    os.makedirs(f"{base}/manifest/snapshots/99999999999999999999-x")
    assert artifacts.manifest(spark, base).count() == 3 and compact(spark, base, grace_hours=0) >= 4
    assert artifacts.manifest(spark, base).count() == 3
