"""The surprise gate over a stream, its ledger and baseline in Spark's own state, steps closed by the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from affinis.functions.scores import LEDGER_HOURS, SURPRISE

from .baseline import attended
from .sync import VERDICT, Ledger

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class GateProcessor(StatefulProcessor):
    """One session: what steps that are still open have warmed, what was told, and whether the gate is armed.

    A step is judged when the watermark passes its end, so its rows may come in any order and in any number of batches;
    steps are judged in order. Everything that a verdict needs is in the state, so a restart goes on where it was.
    """

    def __init__(self, theta: float, half_life: float):
        self.theta, self.half_life = theta, half_life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "ends long, step long, node string", "mass double, hours double, structural boolean")
        self.told = handle.getMapState("told", "node string", "mass double, hours double")
        self.gate = handle.getValueState("gate", "armed boolean, judged long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        judged = self.gate.get()[1] if self.gate.exists() else None
        for part in rows:
            for ends, step, node, mass, hours, structural in part[["ends", "step", "node", "mass", "hours", "structural"]].itertuples(index=False):
                if judged is not None and step <= judged:
                    continue
                at = (int(ends), int(step), str(node))
                had = self.open.getValue(at) if self.open.containsKey(at) else None
                self.open.updateValue(at, (max(float(mass), had[0]) if had else float(mass), float(hours), bool(structural) or bool(had and had[2])))
            for ends in part["ends"].unique():
                self.handle.registerTimer(int(ends))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = int(expiredTimerInfo.getExpiryTimeInMs())
        steps: dict[tuple[int, int], list] = {}
        for at, value in list(self.open.iterator()):
            if at[0] <= due:
                steps.setdefault((at[1], at[0]), []).append((at, value))
        ledger = Ledger({n[0]: (v[0], v[1]) for n, v in self.told.iterator()}, self.gate.get()[0] if self.gate.exists() else True)
        before, out = set(ledger.told), []
        for (step, _), held in sorted(steps.items()):
            v = ledger.step(held[0][1][1], {at[2]: value[0] for at, value in sorted(held)}, any(value[2] for _, value in held), theta=self.theta, half_life=self.half_life)
            out.append((str(key[0]), step, v["surprise"], v["red"], v["armed"], v["remembered"]))
            for at, _ in held:
                self.open.removeKey(at)
            self.gate.update((ledger.armed, step))
        if out:
            for n in before - set(ledger.told):
                self.told.removeKey((n,))
            for n, (m, t) in ledger.told.items():
                self.told.updateValue((n,), (m, t))
            return iter((pd.DataFrame(out, columns=["session", "step", "surprise", "red", "armed", "remembered"]),))
        return iter(())

    def close(self) -> None:
        pass


def gate(stream: DataFrame, scopes: DataFrame | None = None, theta: float = SURPRISE, half_life: float = LEDGER_HOURS, late: str = "1 hour") -> DataFrame:
    """``sync.gate`` over a stream (session, ends, step, hours, node, mass, structural), a verdict once a step is over.

    ends is the event time at which a step ends; rows may be ``late`` by so much, and those of a step that was judged
    already are left out. With ``scopes`` (scope) only what is below the top folders that a session attends to counts;
    the stream has its file then. State is kept by RocksDB, which the session is told to use.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = (stream if scopes is None else attended(stream, scopes)).withWatermark("ends", late)
    rows = rows.select(F.col("session").cast("string").alias("session"), F.unix_millis("ends").alias("ends"), F.col("ends").alias("time"), F.col("step").cast("long").alias("step"), F.col("hours").cast("double").alias("hours"), F.col("node").cast("string").alias("node"), F.col("mass").cast("double").alias("mass"), F.col("structural").cast("boolean").alias("structural"))
    return rows.groupBy("session").transformWithStateInPandas(GateProcessor(theta, half_life), VERDICT, "Append", "EventTime")
