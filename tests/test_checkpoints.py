import pathlib

from pyspark.sql import functions as F

from quern.sources import checkpoints

SCHEMA = "job string, url string, n int"


def state(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


A, B, C = [("a", "u1", 1), ("b", "u2", None)], [("a", "u1", 1), ("a", "u3", 2), ("b", "u2", 5)], [("a", "u1", 1), ("a", "u3", 2), ("a", "u4", 3), (None, "x", 1)]


def files(folder, part, version):
    return sorted(pathlib.Path(f"{folder}/{part}/version={version}").glob("part-*"))


def test_the_newest_version_of_each_job_comes_back(spark, tmp_path):
    at = str(tmp_path)
    assert checkpoints.load(spark, at) is None
    assert [checkpoints.save(state(spark, x), at) for x in (A, B, C)] == [1, 2, 3]
    assert rows_of(checkpoints.load(spark, at)) == sorted([(*r, 3) for r in C] + [("b", "u2", 5, 2)], key=str)


def test_a_torn_version_is_skipped_job_by_job(spark, tmp_path):
    at = str(tmp_path)
    for x in (A, B, C):
        checkpoints.save(state(spark, x).repartition(1), at)
    checkpoints.write_rows(state(spark, [r for r in C if r[1] != "u4"]), at, 3)  # a lost row
    assert rows_of(checkpoints.load(spark, at)) == sorted([("a", "u1", 1, 2), ("a", "u3", 2, 2), ("b", "u2", 5, 2), (None, "x", 1, 3)], key=str)
    checkpoints.write_rows(state(spark, [(j, u, 9) for j, u, n in B]), at, 2)  # another value
    assert rows_of(checkpoints.load(spark, at)) == sorted([("a", "u1", 1, 1), ("b", "u2", None, 1), (None, "x", 1, 3)], key=str)


def test_broken_files_and_missing_commits_are_skipped(spark, tmp_path):
    at = str(tmp_path)
    for x in (A, B, C):
        checkpoints.save(state(spark, x).repartition(1), at)
    for f in files(at, "rows", 3):
        f.write_bytes(f.read_bytes()[: f.stat().st_size // 2])
        f.with_name(f".{f.name}.crc").unlink()
    assert rows_of(checkpoints.load(spark, at)) == sorted([(*r, 2) for r in B], key=str)
    for f in files(at, "commits", 2):
        f.unlink()
    assert rows_of(checkpoints.load(spark, at)) == sorted([(*r, 1) for r in A], key=str)
    checkpoints.write_rows(state(spark, C), at, 4)  # died before its commit
    assert rows_of(checkpoints.load(spark, at)) == sorted([(*r, 1) for r in A], key=str)
    assert checkpoints.save(state(spark, B), at) == 5
    assert {r.version for r in checkpoints.load(spark, at).collect()} == {5}


def test_old_versions_go_and_columns_may_be_added(spark, tmp_path):
    at = str(tmp_path)
    for k in range(5):
        checkpoints.save(state(spark, A), at, keep=2)
    assert sorted(p.name for p in (tmp_path / "rows").iterdir()) == ["version=4", "version=5"] == sorted(p.name for p in (tmp_path / "commits").iterdir())
    checkpoints.save(state(spark, [("c", "u", 1)]).withColumn("more", F.lit("m")), at)
    assert rows_of(checkpoints.load(spark, at)) == sorted([(*r, None, 5) for r in A] + [("c", "u", 1, "m", 6)], key=str)


def test_rows_that_repeat_count_and_an_empty_state_is_a_version(spark, tmp_path):
    at = str(tmp_path)
    checkpoints.save(state(spark, A + A), at)
    assert len(rows_of(checkpoints.load(spark, at))) == 4
    checkpoints.write_rows(state(spark, A), at, 1)
    assert rows_of(checkpoints.load(spark, at)) == []
    assert checkpoints.save(state(spark, []), at) == 2 and rows_of(checkpoints.load(spark, at)) == []
