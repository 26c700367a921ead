"""What a session is told as its tree changes: a baseline that follows snapshots, within the folders it attends to."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.functions import paths as P
from affinis.functions.scores import SURPRISE

from . import sync


@dataclass
class Snapshot:
    """A generation of a tree: files (file, sha), facts (file, fingerprint), anchors (anchor, file, implicit)."""

    version: str
    files: DataFrame
    facts: DataFrame
    anchors: DataFrame
    checkout: bool = False
    degraded: bool = False


@dataclass
class Outcome:
    """``state`` is indexing, unchanged, established, outside or drift; a drift has its tables and is red or not."""

    state: str
    red: bool = False
    changed: DataFrame | None = None
    semantic: DataFrame | None = None
    deltas: DataFrame | None = None
    surprise: float = 0.0
    delivery: str | None = None
    details: dict = field(default_factory=dict)


def attended(rows: DataFrame, scopes: list[str] | DataFrame | None) -> DataFrame:
    """Rows (file, ...) below the top folders that a session attends to, a list or a table (scope); all without scopes."""
    if scopes is None:
        return rows
    if isinstance(scopes, list):
        return rows.where(P.top_segment(F.col("file")).isin(scopes))
    return rows.withColumn("scope", P.top_segment(F.col("file"))).join(scopes.select("scope").distinct(), "scope", "left_semi").drop("scope")


def anchor_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(anchor, file, change, implicit): anchors that came, with their file now, or went, with the file they had."""
    a, b = before.select("anchor", F.col("file").alias("old"), F.col("implicit").alias("was")), after.select("anchor", F.col("file").alias("new"), F.col("implicit").alias("is"))
    both = a.join(b, "anchor", "full_outer").where("old is null or new is null")
    return both.select("anchor", F.coalesce("new", "old").alias("file"), F.when(F.col("old").isNull(), "added").otherwise("removed").alias("change"), F.coalesce("is", "was").alias("implicit"))


def in_order(surprise: DataFrame) -> DataFrame:
    """(file, surprise) most first, files of tests last among equals, then by name."""
    return surprise.orderBy(F.desc("surprise"), P.is_test_scope(F.col("file")).cast("int"), "file")


def deliver(kind: str | None) -> str:
    """A change by another session can wait for the next prompt; any other steers at once."""
    return "next-prompt" if kind in ("other", "other-session") else "steer"


class Baseline:
    """The state machine of one session: what it was last told of, its ledger and whether the gate is armed."""

    def __init__(self, theta: float = SURPRISE):
        self.seen: Snapshot | None = None
        self.ledger = sync.Ledger()
        self.theta = theta

    def reset(self) -> None:
        self.seen, self.ledger = None, sync.Ledger()

    def step(self, now: Snapshot | None, hours: float = 0.0, warmed: dict | None = None, scopes: list[str] | None = None, provenance: str | None = None, disclosed: frozenset = frozenset()) -> Outcome:
        """The outcome of a snapshot; ``warmed`` is {node: mass} of the impact of what changed.

        Without a snapshot the tree is being indexed. The first one, and one after a checkout, becomes the baseline
        and says nothing; a checkout forgets the ledger. One of the same version says nothing. Changes outside of the
        session's scopes are taken over in silence. Otherwise the gate decides on structure and surprise.
        """
        if now is None:
            return Outcome("indexing")
        if self.seen is None or now.checkout:
            self.ledger = sync.Ledger() if now.checkout else self.ledger
            self.seen = now
            return Outcome("established", details={"anchors": now.anchors.count(), "checkout": now.checkout})
        before, self.seen = self.seen, now
        if before.version == now.version:
            return Outcome("unchanged")
        changes = sync.drift(before.files, now.files)
        here = attended(changes, scopes)
        deltas = attended(anchor_deltas(before.anchors, now.anchors), scopes)
        if here.isEmpty() and deltas.isEmpty():
            return Outcome("outside", details={"ignored": changes.count(), "scopes": sorted(scopes or [])})
        semantic = sync.semantic(here, before.facts, now.facts)
        deltas = sync.evidence(deltas, here)
        gone = here.where("change = 'removed'").where(~P.is_test_scope(F.col("file")))
        structural = sync.structural(deltas, now.degraded).first()["red"] or not gone.isEmpty()
        verdict = self.ledger.step(hours, warmed or {}, structural, disclosed, self.theta)
        return Outcome("drift", verdict["red"], here, semantic, deltas, verdict["surprise"], deliver(provenance) if verdict["red"] else None, verdict)
