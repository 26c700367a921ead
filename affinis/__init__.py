"""Affinity-graph analytics on PySpark: ``Engine`` answers questions to a graph, ``Baseline`` follows its changes."""

from affinis.config import Options, resolved
from affinis.plans.engine import Engine, Result
from affinis.streaming.baseline import Baseline, Outcome, Snapshot

__all__ = ["Baseline", "Engine", "Options", "Outcome", "Result", "Snapshot", "resolved"]
