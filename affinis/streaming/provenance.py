"""Who changed a file: mutations followed from one content to another."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinis.functions import paths as P

#: How many mutations are kept and for how long.
KEPT, DAYS = 2048, 7


def journal(mutations: DataFrame, now_ms: int, most: int = KEPT, days: int = DAYS, root: str | None = None) -> DataFrame:
    """Mutations (file, before_sha, after_sha, owner, tool_call_id, commit_order, at) worth keeping, numbered in order.

    Those that change nothing or are too old go; the last ``most`` stay, by time, owner, commit order and call. With
    ``root`` files are paths as tools tell them: they are told relative to it, and those outside of it go.
    """
    if root is not None:
        mutations = mutations.withColumn("file", P.within(F.col("file"), root)).where("file is not null")
    rows = mutations.where(~F.col("before_sha").eqNullSafe(F.col("after_sha")) & (F.col("at") >= now_ms - days * 86_400_000))
    back = [F.desc("at"), F.desc("owner"), F.asc_nulls_first(-F.col("commit_order")), F.desc("tool_call_id")]
    rows = rows.orderBy(*back).limit(most)
    order = Window.orderBy("at", "owner", F.asc_nulls_last("commit_order"), "tool_call_id")
    return rows.withColumn("seq", F.row_number().over(order))


def attribute(rows: DataFrame, changes: DataFrame, session: str) -> DataFrame:
    """(file, owners, kind) of changes (file, before_sha, after_sha) by the journal's rows.

    From before_sha on, each mutation in order leads from a content reached so far to its own, and its owner joins
    those of that content; a null content is a deleted file. kind is current, other, mixed or unattributed. A file's
    mutations are folded in one task; there are KEPT at most.
    """

    def fold(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        none = lambda x: None if pd.isna(x) else x
        for before, after in zip(right["before_sha"], right["after_sha"], strict=True):
            reached: dict = {none(before): frozenset()}
            for r in left.sort_values("seq").itertuples(index=False):
                if none(r.before_sha) in reached:
                    to = none(r.after_sha)
                    reached[to] = reached.get(to, frozenset()) | reached[none(r.before_sha)] | {r.owner}
            owners = sorted(reached.get(none(after), ()))
            kind = "unattributed" if not owners else "mixed" if len(owners) > 1 else "current" if owners[0] == session else "other"
            out.append((right["file"].iloc[0], owners, kind))
        return pd.DataFrame(out, columns=["file", "owners", "kind"])

    return rows.groupBy("file").cogroup(changes.groupBy("file")).applyInPandas(fold, "file string, owners array<string>, kind string")


def summary(attributed: DataFrame) -> DataFrame:
    """(kind) of a whole verdict: the one kind that all its files have, mixed with several, unattributed with none."""
    kinds = F.collect_set("kind")
    return attributed.agg(F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).when(F.size(kinds) > 1, F.lit("mixed")).otherwise(F.lit("unattributed")).alias("kind"))
