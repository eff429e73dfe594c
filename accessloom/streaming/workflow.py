"""Workflow runs kept on a stream: one state per run with an attempt counter and a timer, and nothing dropped for being late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from accessloom.plans.lifecycle import idempotency_key

#: The setting that keeps state where it can be of any size, and the value it needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATE = "mode string, first_at timestamp, attempts int, status string"
EVENTS = "idempotency_key string, event string, mode string, attempt int, status string, at timestamp"
OPEN, DONE, FAILED = "running", "completed", "failed"


class _Runs(StatefulProcessor):
    """Started by the first delivery of a trigger; later ones fold into it, a delivery to execute turns a dry run into a real
    one. An outcome closes the run or asks for another attempt; so does the timer if no outcome came in time. What
    arrives for a run that is closed is told as late and changes nothing."""

    def __init__(self, retry_ms: int, most: int):
        self.retry_ms, self.most = retry_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", STATE)

    def _next_attempt(self, run: dict, now: int) -> str:
        if run["attempts"] >= self.most:
            run["status"] = FAILED
            return "given_up"
        run["attempts"] += 1
        self.handle.registerTimer(now + self.retry_ms)
        return "attempt"

    def _stop_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        given = pd.concat(list(rows)).sort_values(["at", "kind", "mode"], kind="stable", na_position="first")
        run = dict(zip(("mode", "first_at", "attempts", "status"), self.state.get())) if self.state.exists() else None
        told = []
        for row in given.itertuples():
            if run is None and row.kind == "outcome":
                told.append((key[0], "unknown", None, 0, None, row.at))
                continue
            if run is None:
                run = {"mode": row.mode, "first_at": row.at.to_pydatetime(), "attempts": 0, "status": OPEN}
                self._next_attempt(run, now)
                event = "started"
            elif run["status"] != OPEN:
                event = "late"
            elif row.kind == "trigger":
                event = "duplicate"
                if row.mode == "execute" and run["mode"] != "execute":
                    run["mode"], event = "execute", "turned_real"
            else:
                self._stop_timers()
                if row.succeeded:
                    run["status"], event = DONE, "closed"
                else:
                    event = self._next_attempt(run, now)
            told.append((key[0], event, run["mode"], run["attempts"], run["status"], row.at))
        if run is not None:
            self.state.update((run["mode"], run["first_at"], run["attempts"], run["status"]))
        yield pd.DataFrame(told, columns=[c.split()[0] for c in EVENTS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run = dict(zip(("mode", "first_at", "attempts", "status"), self.state.get())) if self.state.exists() else None
        told = []
        if run is not None and run["status"] == OPEN:
            now = timerValues.getCurrentProcessingTimeInMs()
            event = self._next_attempt(run, now)
            self.state.update((run["mode"], run["first_at"], run["attempts"], run["status"]))
            told.append((key[0], event, run["mode"], run["attempts"], run["status"], pd.Timestamp(now, unit="ms")))
        yield pd.DataFrame(told, columns=[c.split()[0] for c in EVENTS.split(", ")])

    def close(self) -> None:
        pass


def deliveries(triggers: DataFrame, at: str) -> DataFrame:
    """Trigger deliveries (workflow_type, identity_id, trigger_event_id, mode) in the form ``workflow_events`` takes."""
    return triggers.select(
        idempotency_key().alias("idempotency_key"), F.lit("trigger").alias("kind"), "mode", F.lit(None).cast("boolean").alias("succeeded"),
        F.col(at).alias("at"))


def workflow_events(stream: DataFrame, retry_after_seconds: float = 3600, most_attempts: int = 5) -> DataFrame:
    """What happens to each run, a row per event (see EVENTS), from deliveries and outcomes.

    ``stream`` has idempotency_key, kind (trigger or outcome), mode (of a trigger), succeeded (of an outcome) and at. State is
    kept per run and never expires, so a delivery counts however late it comes: as a duplicate while the run is open,
    as late once it is closed. An open run without outcome for ``retry_after_seconds`` is tried again, ``most_attempts`` times
    at most. Outcomes of runs that no trigger started are told as unknown. The session must name the state store of
    ``STATE_STORE``. A query with timers to watch runs on until it is stopped, also where all input has been read.
    """
    return stream.groupBy("idempotency_key").transformWithStateInPandas(
        statefulProcessor=_Runs(int(retry_after_seconds * 1000), most_attempts), outputStructType=EVENTS, outputMode="Append",
        timeMode="ProcessingTime")
