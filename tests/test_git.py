from __future__ import annotations

import subprocess

from affinis.sources import files, git


def made(root):
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (root / "sub").mkdir()

    def commit(k):
        (root / f"f{k % 3}.py").write_text(f"x = {k}\n")
        (root / "sub" / f"g {k % 2}.md").write_text(f"{k}\n")
        run("add", ".")
        run("commit", "-q", "-m", str(k), "--date", f"2024-01-{k + 1:02d}T00:00:00Z")

    return run, commit


def test_history_equals_the_log(spark, tmp_path):
    run, commit = made(tmp_path)
    for k in range(7):
        commit(k)
    run("rm", "-q", "f1.py")
    run("commit", "-q", "-m", "gone")
    root = str(tmp_path)
    want = sorted(map(tuple, files.commits(spark, root).collect()))
    got = git.history(spark, root)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 14
    assert got.rdd.getNumPartitions() == files.COMMITS // git.RANGE == 4
    assert sorted(map(tuple, git.history(spark, root, 2).collect())) == sorted(map(tuple, files.commits(spark, root, 2).collect()))


def test_stream_goes_on_from_a_commit(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    _, commit = made(root)
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def follow():
        q = git.new_commits(spark, str(root)).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    for k in range(3):
        commit(k)
    assert len(follow()) == 6
    commit(3)
    assert follow() == follow() == sorted(map(tuple, files.commits(spark, str(root)).collect()))
