"""The staged sink and snapshots: what fails leaves no trace."""

from __future__ import annotations

import os
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.sources.staged import SnapshotError, StagedStore


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def tree(root):
    top = Path(root.removeprefix("file://"))
    return sorted(str(p.relative_to(top)) for p in top.rglob("*") if p.is_file() and p.suffix == ".parquet" and p.parts[-2] != "pointer" and p.parts[-2] != "manifest")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_appear_whole(spark, root):
    store = StagedStore(spark, root)
    df = spark.range(1000, numPartitions=6).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("é"), "id")).alias("text"), F.array("id").alias("a"))
    store.publish(df, "one")
    assert store.active() == "one" and rows(store.read()) == rows(df)
    files = store.files("one").collect()
    assert len(files) == 6 and sum(f["n_rows"] for f in files) == 1000 and store.problems("one") == []
    store.publish(df.where("id < 10"), "two")
    assert store.active() == "two" and store.read().count() == 10 and store.read("one").count() == 1000
    store.activate("one")
    assert store.active() == "one"
    with pytest.raises(Exception, match="exists"):
        store.publish(df, "two")
    assert store.read("two").count() == 10


def test_a_failing_task_leaves_nothing(spark, root):
    store = StagedStore(spark, root)
    store.publish(spark.range(50, numPartitions=2).toDF("id"), "good")
    before = tree(root)
    bad = spark.range(400, numPartitions=8).select(F.when(F.col("id") == 333, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken row"):
        store.publish(bad, "bad")
    # Tasks that were still running may leave files in the stage, which no list names.
    assert store.active() == "good" and [f for f in tree(root) if not f.startswith("stage/")] == before
    assert rows(store.read()) == [(i,) for i in range(50)]
    store.publish(spark.range(9, numPartitions=2).toDF("id"), "bad")
    assert store.active() == "bad" and rows(store.read()) == [(i,) for i in range(9)] and store.problems("bad") == []
    assert not os.path.exists(f"{root.removeprefix('file://')}/stage/bad")


def test_a_failing_check_leaves_nothing(spark, root):
    store = StagedStore(spark, root)
    store.publish(spark.range(5).toDF("id"), "good")
    before = tree(root)

    def refuse(df):
        assert df.count() == 7
        raise RuntimeError("not good enough")

    with pytest.raises(RuntimeError):
        store.publish(spark.range(7).toDF("id"), "next", refuse)
    assert store.active() == "good" and tree(root) == before
    store.publish(spark.range(7).toDF("id"), "next")  # the name is free again
    assert store.active() == "next"


def test_no_rows(spark, root):
    store = StagedStore(spark, root)
    store.publish(spark.range(0).toDF("id"), "none")
    assert store.active() == "none" and store.files("none").count() == 0


def part(root, version):
    return next(Path(f"{root.removeprefix('file://')}/data/version={version}").glob("part-*"))


def test_snapshots_are_checked(spark, root, tmp_path):
    source = StagedStore(spark, f"file://{tmp_path}/source")
    for v in ("a", "b", "c", "d", "e"):
        source.publish(spark.range(100, numPartitions=3).toDF("id"), v)
    store = StagedStore(spark, root)
    seen = []
    store.import_snapshot(source.root, "a", 1 << 20, lambda df: seen.append(df.count()))
    assert store.active() == "a" and seen == [100] and rows(store.read()) == [(i,) for i in range(100)]
    before = tree(root)
    p = part(source.root, "b")
    p.write_bytes(p.read_bytes()[:-1] + b"x")
    part(source.root, "c").unlink()
    p = part(source.root, "d")
    p.write_bytes(p.read_bytes() + b"x")
    listed = Path(f"{tmp_path}/source/files/e.parquet")
    table = pq.read_table(listed)
    pq.write_table(table.set_column(0, "name", [["../../x"] + table["name"].to_pylist()[1:]]), listed)
    for version, why in (("b", "digest"), ("c", "missing"), ("d", "size"), ("e", "leads out")):
        with pytest.raises(SnapshotError, match=why):
            store.import_snapshot(source.root, version, 1 << 20)
    source.publish(spark.range(100).toDF("id"), "f")
    with pytest.raises(SnapshotError, match="more than"):
        store.import_snapshot(source.root, "f", 10)
    with pytest.raises(ZeroDivisionError):
        store.import_snapshot(source.root, "f", 1 << 20, lambda df: 1 / 0)
    with pytest.raises(SnapshotError, match="exists"):
        store.import_snapshot(source.root, "a", 1 << 20)
    assert store.active() == "a" and tree(root) == before
    store.import_snapshot(source.root, "f", 1 << 20)
    assert store.active() == "f"


def test_later_damage_is_seen(spark, root):
    store = StagedStore(spark, root)
    store.publish(spark.range(100, numPartitions=3).toDF("id"), "v")
    p = part(root, "v")
    (p.parent / "part-stray.parquet").write_bytes(b"x")
    p.write_bytes(b"")
    assert store.problems("v") == [f"size of {p.name}", "unlisted part-stray.parquet"]
