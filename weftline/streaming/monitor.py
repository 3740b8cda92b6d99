"""Replay of a distributed monitor's command log (SR1-SR3), in batch and as a stream.

A command's outcome depends on all before it, so a monitor's commands are taken in
order of their number; different monitors are independent. Signalling moves a waiter
to the enter queue and keeps the mutex; a signal without a waiter is lost.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

OUT = T.StructType([T.StructField("monitor_name", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("status", T.StringType()), T.StructField("woken", T.IntegerType()), T.StructField("owner", T.StringType())])
COLUMNS = ["seq", "monitor_name", "action", "process_id", "condition_name"]


class Monitor:
    """State of one monitor: owner, enter queue, a queue for each condition."""

    def __init__(self, text: str | None = None):
        held = json.loads(text) if text else {"owner": None, "enter": [], "conditions": {}}
        self.owner, self.enter, self.conditions = held["owner"], held["enter"], held["conditions"]

    def dump(self) -> str:
        return json.dumps({"owner": self.owner, "enter": self.enter, "conditions": {k: v for k, v in self.conditions.items() if v}})

    def _release(self) -> None:
        self.owner = self.enter.pop(0) if self.enter else None

    def do(self, action: str | None, who: str | None, condition: str | None) -> tuple[str, int | None]:
        """Status and the number of processes woken (null where none could be)."""
        inside = who is not None and self.owner == who
        if not who or not action or (action in ("WAIT", "SIGNAL", "BROADCAST") and not condition):
            return "error", None
        if action == "ENTER":
            if inside:
                return "error", None
            if self.owner is None and self.enter[:1] in ([], [who]):
                self.enter, self.owner = self.enter[1:], who
                return "granted", None
            if who not in self.enter:
                self.enter.append(who)
            return "queued", None
        if action == "CHECK_GRANT":
            return ("granted" if inside else "queued"), None
        if action == "CHECK_AWAKENED":
            places = [(inside, "granted_after_wait"), (who in self.enter, "queued_after_signal"), (who in self.conditions.get(condition, []), "still_waiting_on_condition")]
            return next((status for hit, status in places if hit), "pending_unknown_state"), None
        if action not in ("EXIT", "WAIT", "SIGNAL", "BROADCAST") or not inside:
            return "error", None
        if action == "EXIT":
            self._release()
            return "success", None
        queue = self.conditions.setdefault(condition, [])
        if action == "WAIT":
            queue.append(who)
            self._release()
            return "waiting_on_condition", None
        n = len(queue) if action == "BROADCAST" else min(1, len(queue))
        self.enter += queue[:n]
        self.conditions[condition] = queue[n:]
        return "success", n


def replay(log: DataFrame) -> DataFrame:
    """The response to each command of a log (seq, monitor_name, action, process_id, condition_name).

    Rows come sorted by monitor and number and are taken one by one: a task holds a
    monitor's state, never its log.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for pdf in batches:
            out = []
            for seq, monitor, action, who, condition in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                if state is None or monitor != name:
                    name, state = monitor, Monitor()
                status, woken = state.do(action, who, condition) if monitor else ("error", None)
                out.append((monitor, int(seq), status, woken, state.owner))
            yield pd.DataFrame(out, columns=OUT.names).astype({"woken": "Int32"})

    return log.select(COLUMNS).repartition("monitor_name").sortWithinPartitions("monitor_name", "seq").mapInPandas(run, OUT)


def replay_stream(log: DataFrame) -> DataFrame:
    """The same over a stream: each monitor's state is kept between batches, in the state store."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        monitor = Monitor(state.get[0] if state.exists else None)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")[COLUMNS]
        out = []
        for seq, name, action, who, condition in rows.astype(object).where(rows.notna(), None).itertuples(index=False):
            status, woken = monitor.do(action, who, condition)
            out.append((name, int(seq), status, woken, monitor.owner))
        state.update((monitor.dump(),))
        yield pd.DataFrame(out, columns=OUT.names).astype({"woken": "Int32"})

    return log.groupBy("monitor_name").applyInPandasWithState(run, OUT, "state string", "append", GroupStateTimeout.NoTimeout)
