"""Options and their bounds."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace


def env_int(name: str, default: int, least: int, most: int) -> int:
    """A whole number from the environment within its bounds; anything else is the default."""
    try:
        return max(least, min(most, int(os.environ[name])))
    except (KeyError, ValueError):
        return default


@dataclass(frozen=True)
class SyncOptions:
    """How drift is told: mode (enabled, hidden, disabled), scope (session, repository), size and threshold of a message."""

    mode: str = "enabled"
    scope: str = "session"
    budget: int = 512
    steer_threshold: float = 0.15
    push_focus: bool = True
    ack_clean: bool = False
    warm_mutations: bool = True


@dataclass(frozen=True)
class Options:
    """Defaults are fixed values; what a caller gives is checked by ``resolved``."""

    default_budget: int = 512
    timeout_ms: int = 120_000
    sync: SyncOptions = field(default_factory=SyncOptions)


def resolved(given: dict | None = None) -> Options:
    """Options from a dictionary of the same names; values of another type or outside of their set are left out."""
    given = given or {}
    sync = {k: v for k, v in (given.get("sync") or {}).items() if k in SyncOptions.__dataclass_fields__ and type(v) in (type(getattr(SyncOptions(), k)), int) and type(v) is not bool or isinstance(getattr(SyncOptions(), k, None), bool) and isinstance(v, bool)}
    if sync.get("mode", "enabled") not in ("enabled", "hidden", "disabled"):
        del sync["mode"]
    if sync.get("scope", "session") not in ("session", "repository"):
        del sync["scope"]
    top = {k: v for k, v in given.items() if k in ("default_budget", "timeout_ms") and type(v) is int and v > 0}
    return replace(Options(), **top, sync=replace(SyncOptions(), **sync))
