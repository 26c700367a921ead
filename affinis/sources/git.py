"""The history of a git checkout as a Spark data source, read by the tasks themselves.

``spark.read.format("git-history")`` gives (commit, ts, item) of a checkout that the executors can reach, in ranges of
commits; ``spark.readStream`` gives what came since the last commit that was read.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .files import COMMITS

SCHEMA = "commit string, ts timestamp, item string"
#: Commits that one task reads.
RANGE = 100


def said(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout


def rows(root: str, *args: str) -> Iterator[tuple]:
    """(commit, ts, item) of what git's log tells."""
    commit, ts = "", datetime.fromtimestamp(0, UTC)
    for line in said(root, "log", "--numstat", "--no-renames", "--diff-filter=AMR", "--format=%x01%H %ct", *args, "--", ".").split("\n"):
        if line.startswith("\x01"):
            sha, seconds = line[1:].split(" ")
            commit, ts = sha, datetime.fromtimestamp(int(seconds), UTC)
        elif line.count("\t") == 2:
            yield commit, ts, line.split("\t")[2]


class Range(InputPartition):
    def __init__(self, *args: str):
        super().__init__(0)
        self.args = args


class HistoryReader(DataSourceReader):
    """The last ``most`` commits, RANGE a task; nothing is asked of git to plan that."""

    def __init__(self, root: str, most: int):
        self.root, self.most = root, most

    def partitions(self) -> list[Range]:
        return [Range(f"--skip={k}", f"--max-count={min(RANGE, self.most - k)}") for k in range(0, self.most, RANGE)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return rows(self.root, *partition.args)


class HistoryStream(DataSourceStreamReader):
    """What the checkout's branch gained since the last offset, which is a commit; the first batch has all before."""

    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:  # noqa: N802
        return {"commit": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"commit": said(self.root, "rev-parse", "HEAD").strip()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if start["commit"] == end["commit"]:
            return []
        span = f"{start['commit']}..{end['commit']}" if start["commit"] else end["commit"]
        n = int(said(self.root, "rev-list", "--count", span))
        return [Range(span, f"--skip={k}", f"--max-count={min(RANGE, n - k)}") for k in range(0, n, RANGE)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return rows(self.root, *partition.args)

    def commit(self, end: dict) -> None:
        pass


class GitHistory(DataSource):
    """Options: path, the checkout; most, how many commits a batch read looks back."""

    @classmethod
    def name(cls) -> str:
        return "git-history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options["path"], int(self.options.get("most", COMMITS)))

    def streamReader(self, schema) -> HistoryStream:  # noqa: N802
        return HistoryStream(self.options["path"])


def history(spark: SparkSession, root: str, most: int = COMMITS) -> DataFrame:
    """(commit, ts, item) of the last ``most`` commits, read by tasks."""
    spark.dataSource.register(GitHistory)
    return spark.read.format("git-history").option("most", most).load(root)


def new_commits(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (commit, ts, item): all there is, then what each commit adds."""
    spark.dataSource.register(GitHistory)
    return spark.readStream.format("git-history").load(root)
