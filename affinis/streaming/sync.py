"""Drift between snapshots, and a gate that speaks only of what is new."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions.scores import LEDGER_HOURS, SURPRISE

#: Least mass that is remembered, and how many nodes are.
FORGOTTEN, LEDGER = 1e-9, 4096


def version(files: DataFrame) -> DataFrame:
    """(version): 12 hex digits for a snapshot's files (file, sha), from their own digest in order of file.

    A digest over all lines in order needs them in one place, so this is for source trees, which ``files.FILES`` bounds;
    ``tree_version`` is for snapshots of any size.
    """
    lines = F.sort_array(F.collect_list(F.concat_ws(":", "file", "sha")))
    return files.agg(F.left(F.sha1(F.array_join(lines, "\n").cast("binary")), F.lit(12)).alias("version"))


def tree_version(files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, version): 12 hex digits for files (file, sha, *by) of any number: a digest of the digests of 4,096 parts.

    A file is of the part that its own digest names; a part's digest is of its count and sums, so no order is needed.
    """
    own = F.sha2(F.concat_ws(":", F.col("file").cast("string"), "sha"), 256)
    whole = lambda k: F.sum(F.conv(F.substring("own", k, 12), 16, 10).cast("decimal(30)")).cast("string")
    digests = files.select(*by, own.alias("own")).groupBy(*by, F.substring("own", 62, 3).alias("part")).agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *(whole(k) for k in (1, 13, 25, 37))), 256).alias("digest"))
    lines = F.sort_array(F.collect_list(F.concat_ws(":", "part", "digest")))
    return digests.groupBy(*by).agg(F.left(F.sha1(F.array_join(lines, "\n").cast("binary")), F.lit(12)).alias("version"))


def fingerprint(facts: Column) -> Column:
    """Digest of a list of facts whatever their order, with runs of white space as one."""
    return F.sha1(F.array_join(F.sort_array(F.transform(facts, lambda x: F.regexp_replace(F.trim(x), r"\s+", " "))), "\n").cast("binary"))


def drift(before: DataFrame, after: DataFrame, key: str = "file", sha: str = "sha") -> DataFrame:
    """(key, change): added, removed or changed between two snapshots; what is alike is left out."""
    a, b = before.select(key, F.col(sha).alias("old")), after.select(key, F.col(sha).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, key, "full_outer").withColumn("change", change).where("change is not null").select(key, "change")


def semantic(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed files whose facts (file, fingerprint) differ too."""
    a, b = before.select("file", F.col("fingerprint").alias("old")), after.select("file", F.col("fingerprint").alias("new"))
    return changes.where("change = 'changed'").join(a, "file").join(b, "file").where("old <> new").select("file")


def evidence(deltas: DataFrame, changes: DataFrame) -> DataFrame:
    """Anchor changes (anchor, file, ...) with whether their file changed too; the others are only suspected."""
    carriers = changes.select("file", F.lit(True).alias("carried")).distinct()
    return deltas.join(carriers, "file", "left").withColumn("evidential", F.coalesce("carried", F.lit(False))).drop("carried")


def refresh(known: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dirty, kept, vanished) of a manifest (file, size, version) against what is there now: only dirty is read again."""
    same = ["file", "size", "version"]
    return seen.join(known.select(*same), same, "left_anti"), known.join(seen.select(*same), same, "left_semi"), known.join(seen.select("file"), "file", "left_anti")


@dataclass
class Ledger:
    """What a session was told: mass and time by node, and whether the gate is armed."""

    told: dict = field(default_factory=dict)
    armed: bool = True

    def step(self, now: float, warmed: dict, structural: bool, skipped: frozenset = frozenset(), theta: float = SURPRISE, half_life: float = LEDGER_HOURS) -> dict:
        """One verdict at ``now`` (hours) on warmed nodes ({node: mass times channel}).

        In this order: the ledger cools and forgets; surprise is what exceeds it; the gate fires if armed and
        surprised, or on structural evidence, and is armed again at half the threshold; what fired is told.
        """
        cooled = {n: m * 0.5 ** (max(0.0, now - t) / half_life) for n, (m, t) in self.told.items()}
        cooled = {n: m for n, m in cooled.items() if m > FORGOTTEN}
        if len(cooled) > LEDGER:
            cooled = dict(sorted(cooled.items(), key=lambda x: (-x[1], str(x[0])))[:LEDGER])
        surprise = sum(d for n, m in warmed.items() if n not in skipped and (d := m - cooled.get(n, 0.0)) > FORGOTTEN)
        red = structural or (self.armed and surprise >= theta)
        if red:
            self.armed = False
            for n, m in warmed.items():
                if n not in skipped:
                    cooled[n] = max(cooled.get(n, 0.0), m)
        elif surprise <= theta / 2:
            self.armed = True
        self.told = {n: (m, now) for n, m in cooled.items()}
        return {"surprise": surprise, "red": red, "armed": self.armed, "remembered": len(self.told)}


VERDICT = "session string, step long, surprise double, red boolean, armed boolean, remembered long"


def _verdicts(ledger: Ledger, rows: pd.DataFrame, theta: float, half_life: float) -> list[tuple]:
    out = []
    for step, part in rows.sort_values(["step", "node"]).groupby("step", sort=True):
        warmed = part.groupby("node", sort=True)["mass"].max().to_dict()
        v = ledger.step(float(part["hours"].iloc[0]), warmed, bool(part["structural"].any()), theta=theta, half_life=half_life)
        out.append((str(part["session"].iloc[0]), int(step), v["surprise"], v["red"], v["armed"], v["remembered"]))
    return out


def gate(batches: DataFrame, theta: float = SURPRISE, half_life: float = LEDGER_HOURS) -> DataFrame:
    """A verdict for each step of each session, over (session, step, hours, node, mass, structural).

    The order of steps matters, so each session's rows are folded in one task; sessions are independent.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_verdicts(Ledger(), rows, theta, half_life), columns=["session", "step", "surprise", "red", "armed", "remembered"])

    return batches.groupBy("session").applyInPandas(fold, VERDICT)


def stream_gate(stream: DataFrame, theta: float = SURPRISE, half_life: float = LEDGER_HOURS) -> DataFrame:
    """``gate`` over a stream: each micro-batch continues the session's ledger, which is Spark's state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ledger = Ledger()
        if state.exists:
            names, masses, times, ledger.armed = state.get
            ledger.told = {n: (m, t) for n, m, t in zip(names, masses, times, strict=True)}
        out = _verdicts(ledger, pd.concat(list(parts), ignore_index=True), theta, half_life)
        state.update(([str(n) for n in ledger.told], [m for m, _ in ledger.told.values()], [t for _, t in ledger.told.values()], ledger.armed))
        yield pd.DataFrame(out, columns=["session", "step", "surprise", "red", "armed", "remembered"])

    rows = stream.withColumn("node", F.col("node").cast("string"))
    return rows.groupBy("session").applyInPandasWithState(fold, VERDICT, "names array<string>, masses array<double>, times array<double>, armed boolean", "append", GroupStateTimeout.NoTimeout)


def channel(reasons: Column) -> Column:
    """Prior of an impact by the best of its reasons (an array); 0.5 without any that is known."""
    from affinis.functions.scores import CHANNELS

    weights = F.create_map(*(F.lit(x) for kv in CHANNELS.items() for x in kv))
    known = F.filter(F.transform(reasons, lambda r: F.try_element_at(weights, r)), lambda w: w.isNotNull())
    return F.coalesce(F.array_max(known), F.lit(0.5))


def structural(deltas: DataFrame, degraded: bool = False) -> DataFrame:
    """(red): anchors (change, implicit, evidential) or files without tests that came or went on evidence."""
    added = (F.col("change") == "added") & ~F.col("implicit")
    removed = (F.col("change") == "removed") & F.lit(not degraded)
    return deltas.agg(F.coalesce(F.bool_or(F.col("evidential") & (added | removed)), F.lit(False)).alias("red"))


def assembled(lines: list[str], budget: int) -> str:
    """A message of first, last and as many lines between as fit the budget, dropped from before the last."""
    out = list(lines)
    while len(out) > 2 and -(-len("\n".join(out)) // 4) > budget:
        del out[-2]
    return "\n".join(out)
